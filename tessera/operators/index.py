"""The inverted index: building, looking up, updating, deleting and compacting posting lists.

A corpus is a table with ``doc_id``, ``rel_path``, ``content`` (and what else it has); a document table adds
``words``; postings are (keyword, doc_id), one row each, or chunks of at most so many ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.common import written
from tessera.functions import text

CHUNK_SIZE, BUCKET_CHUNKS, HOT_ROWS = 1000, 64, 10_000


def with_words(corpus: DataFrame, max_size: int | None = None) -> DataFrame:
    """Adds ``words``; with a limit, a file whose ``size`` is above it is kept without words."""
    if max_size is None:
        return corpus.withColumn("words", text.words(F.col("content")))
    return corpus.withColumn("words", text.words_of_file(F.col("content"), F.col("size"), max_size))


def postings(documents: DataFrame, *more: str) -> DataFrame:
    """One row per (keyword, doc_id); ``more`` columns (a workspace) are kept.  Words are distinct, so nothing is shuffled."""
    return documents.select(*more, "doc_id", F.explode("words").alias("keyword"))


def keyword_doc_counts(posts: DataFrame) -> DataFrame:
    return posts.groupBy("keyword").agg(F.count(F.lit(1)).alias("doc_count"))


def prefix_lookup(posts: DataFrame, prefix: str) -> DataFrame:
    """Documents with a keyword that begins with the prefix (a pushed-down ``StringStartsWith`` on stored postings)."""
    return posts.where(F.col("keyword").startswith(prefix)).select("doc_id").distinct()


def _packed(posts: DataFrame, keys: list[str], kept: list[str], count: Column, size: int) -> DataFrame:
    """Distinct (keys, doc_id) as lists of at most ``size`` sorted ids; ``count`` is how many a key may have, ``kept`` follow from the keys.

    One shuffle: by the keys and the id's hash, of as many values as a key of that many ids needs.
    """
    bucket = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.ceil(count / F.lit(size * BUCKET_CHUNKS))).cast("long"))
    routed = posts.select(*keys, *kept, "doc_id", bucket.alias("_b")).repartition(*keys, "_b")
    w = Window.partitionBy(*keys, "_b").orderBy("doc_id")
    ranked = routed.dropDuplicates([*keys, "_b", "doc_id"]).withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))
    return ranked.groupBy(*keys, "_b", "chunk", *kept).agg(F.count(F.lit(1)).alias("doc_count"), F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))


def chunks(posts: DataFrame, *more: str, size: int = CHUNK_SIZE) -> DataFrame:
    """Posting lists of at most ``size`` different ids: ``keyword``, ``part`` (bucket and chunk), ``doc_count``, ``doc_ids`` (sorted).

    A keyword whose ids fill more than BUCKET_CHUNKS lists is cut by the id's hash before anything is shuffled by
    keyword, so that one of any length is never gathered in one task.  Only these keywords, no more than
    postings / (size * BUCKET_CHUNKS), are written and joined.
    """
    keys = [*more, "keyword"]
    hot = written(posts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > size * BUCKET_CHUNKS), "hot-keywords")
    packed = _packed(posts.join(hot, keys, "left"), keys, [], F.coalesce("_n", F.lit(1)), size)
    return packed.select(*keys, F.struct("_b", "chunk").alias("part"), "doc_count", "doc_ids")


def compact(rows: DataFrame, *more: str, size: int = CHUNK_SIZE) -> DataFrame:
    """Rewrites posting rows (``keyword``, ``doc_ids``): lists that are short on average are packed anew, the rest stay.

    As the statistics of a pass, every result row carries ``rows_before`` of its keyword.  Keywords of many rows are
    joined apart from the rest: they are few, and the rest's rows spread evenly.
    """
    keys = [*more, "keyword"]
    per = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_before"), F.sum(F.size("doc_ids")).alias("_ids")), "posting-counts")
    hot = written(per.where(F.col("rows_before") > HOT_ROWS), "hot-keywords")
    tagged = rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(per.where(F.col("rows_before") <= HOT_ROWS), keys))
    keep = (F.col("rows_before") < 2) | (F.col("_ids") / F.col("rows_before") > size)
    kept = tagged.where(keep).select(*keys, "doc_ids", "rows_before")
    again = tagged.where(~keep).select(*keys, "rows_before", "_ids", F.explode("doc_ids").alias("doc_id"))
    return kept.unionByName(_packed(again, keys, ["rows_before"], F.col("_ids"), size).select(*keys, "doc_ids", "rows_before"))


def needs_compaction(rows: DataFrame, *more: str, share: float = 0.25, size: int = CHUNK_SIZE) -> DataFrame:
    """One row, ``rows``, ``rows_after`` (at best) and ``due``: whether packing would save at least the share of all posting rows."""
    keys = [*more, "keyword"]
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("doc_ids")).alias("ids"))
    least = F.when((F.col("n") < 2) | (F.col("ids") / F.col("n") > size), F.col("n")).otherwise(F.least("n", F.ceil(F.col("ids") / size)))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(least), F.lit(0)).alias("rows_after"))
    return total.withColumn("due", (F.col("rows") > 0) & (F.col("rows") - F.col("rows_after") >= share * F.col("rows")))


def compaction_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    a = before.agg(F.count(F.lit(1)).alias("rows_before"), F.count_distinct("keyword").alias("keywords"))
    b = after.agg(F.count(F.lit(1)).alias("rows_after"))
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def word_diff(current: DataFrame, updated: DataFrame) -> DataFrame:
    """Per document of ``updated``: ``added`` and ``removed`` words against ``current``; a new document adds all its words."""
    joined = updated.select("doc_id", F.col("words").alias("_new")).join(current.select("doc_id", F.col("words").alias("_old")), "doc_id", "left")
    none = F.array().cast("array<string>")
    new, old = F.coalesce("_new", none), F.coalesce("_old", none)
    return joined.select("doc_id", F.array_sort(F.array_except(new, old)).alias("added"), F.array_sort(F.array_except(old, new)).alias("removed"))


def remove_postings(posts: DataFrame, gone: DataFrame) -> DataFrame:
    """Postings without the given (keyword, doc_id)."""
    return posts.join(gone, ["keyword", "doc_id"], "left_anti")


def remove_from_chunks(rows: DataFrame, gone: DataFrame, *more: str) -> DataFrame:
    """Posting lists (``keyword``, ``doc_ids`` and what else they have) without the given (keyword, doc_id); empty lists go.

    Only the lists of keywords that lose an id are opened; the ids to remove are gathered by keyword and the id's hash.
    """
    keys = [*more, "keyword"]
    lost = gone.select(*keys, "doc_id").distinct()
    hit = rows.join(lost.select(*keys).distinct(), keys, "left_semi").withColumn("_row", F.struct(*[c for c in rows.columns if c not in (*keys, "doc_ids")], F.xxhash64("doc_ids").alias("_h"), F.monotonically_increasing_id().alias("_m")))
    left = written(hit.select(*keys, "_row", F.explode("doc_ids").alias("doc_id")), "opened-lists").join(lost, [*keys, "doc_id"], "left_anti")
    again = left.groupBy(*keys, "_row").agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))
    again = again.select(*[F.col(c) if c in (*keys, "doc_ids") else F.col(f"_row.{c}").alias(c) for c in rows.columns])
    return rows.join(lost.select(*keys).distinct(), keys, "left_anti").unionByName(again)


def delete_documents(table: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents or postings without those of the given ids."""
    return table.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def upsert(table: DataFrame, updates: DataFrame) -> DataFrame:
    """``updates`` replace or join the documents of the same id."""
    return delete_documents(table, updates).unionByName(updates)


def unchanged(current: DataFrame, stored: DataFrame) -> DataFrame:
    """``doc_id`` and ``state`` of each current document: unchanged_time, unchanged_hash, changed or new."""
    old = stored.select("doc_id", F.col("modified_time").alias("_t"), F.col("hash").alias("_h"), F.lit(True).alias("_there"))
    joined = current.join(old, "doc_id", "left")
    state = F.when(F.col("_there").isNull(), "new").when(F.col("modified_time") == F.col("_t"), "unchanged_time").when(F.col("hash") == F.col("_h"), "unchanged_hash").otherwise("changed")
    return joined.select("doc_id", state.alias("state"))


def starts_with_any(prefixes: list[str], word: Column) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | word.startswith(p)
    return out
