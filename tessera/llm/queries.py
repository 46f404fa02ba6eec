"""Queries of the training-data problems 1, 2, 4, 7, 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.common import table, written
from tessera.functions.text import WORD
from tessera.llm import codefiles, frequent, mixing, ngrams, packing, pii, tokens


def _word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keyword, n, n_files over the current entries of all files."""
    rows = ngrams.latest_records(table(spark, sf_dir, "source_files").select("workspace_id", "doc_id", "last_sync_time", "words"), ["workspace_id", "doc_id"], "last_sync_time")
    records = rows.groupBy("workspace_id", "doc_id").agg(F.collect_set("words").alias("seqs"))
    lower = F.transform("seqs", lambda s: F.transform(s, F.lower))
    return ngrams.ngram_frequencies(records.select(lower.alias("terms")), "terms").select(F.col("ngram")[0].alias("keyword"), F.col("cf").alias("n"), F.col("df").alias("n_files"))


def _doccount_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keyword, n (sum of doccount over different row keys), n_keys."""
    rows = table(spark, sf_dir, "posting_rows").select("row_key", "keyword", "doccount").where("keyword is not null")
    records = rows.groupBy("row_key", "keyword").agg(F.max("doccount").alias("doccount"))
    counted = ngrams.ngram_frequencies(records.select(F.array(F.array("keyword")).alias("terms"), "doccount"), "terms", weight="doccount")
    return counted.select(F.col("ngram")[0].alias("keyword"), F.col("cf").alias("n"), F.col("df").alias("n_keys"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "source_files").select("workspace_id", "doc_id").distinct().count()
    words = ngrams.marked(_word_counts(spark, sf_dir), "n_files", 2, 0.10 * files)
    sums = written(_doccount_sums(spark, sf_dir), "doccount")
    sums = ngrams.marked(sums, "n", 2, 0.004 * (sums.agg(F.sum("n")).first()[0] or 0))
    out = words.select(F.lit("words").alias("field"), "keyword", "mark").unionByName(sums.select(F.lit("doccount").alias("field"), "keyword", "mark"))
    return out.where("mark is not null")


def p1_keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _word_counts(spark, sf_dir)


def p1_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often, and in how many documents, every word and pair of neighbouring words occurs."""
    found = F.transform(F.regexp_extract_all("text", F.lit(WORD), 0), F.lower)
    counted = ngrams.ngram_frequencies(table(spark, sf_dir, "documents").select(F.array(found).alias("terms")), "terms", 2)
    return counted.select(F.array_join("ngram", " ").alias("ngram"), F.col("cf").alias("n"), F.col("df").alias("n_docs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "source_files").select("words")
    entries = files.agg(F.sum(F.when(F.col("words").isNotNull(), F.size("words")))).first()[0] or 0
    word = F.nullif(F.lower(F.col("word")), F.lit(""))
    words = frequent.frequent_items(files.select(F.explode("words").alias("word")), word, k=84, min_share=0.012, total=entries)
    postings = table(spark, sf_dir, "posting_rows").select("keyword")
    keywords = frequent.frequent_items(postings, F.col("keyword"), k=50, min_share=0.02, total=postings.count())
    return words.select(F.lit("words").alias("field"), F.col("item").alias("keyword")).unionByName(keywords.select(F.lit("keyword").alias("field"), F.col("item").alias("keyword")))


def p2_top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 most frequent keywords of all posting rows with exact counts."""
    return frequent.frequent_items(table(spark, sf_dir, "posting_rows").select("keyword"), F.col("keyword"), k=100).select(F.col("item").alias("keyword"), "n")


def _file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").where("file_id is not null")
    return codefiles.classify_files(files, table(spark, sf_dir, "known_packages"), "doc_id", "text", "rel_path", "workspace_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_kinds(spark, sf_dir).where("kind is not null").select("doc_id")


def p4_file_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_kinds(spark, sf_dir)


def _token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return written(tokens.with_token_counts(docs, "text", ["doc_id", "source", "lang", "rel_path"]), "tokens")


def _packings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into containers of each capacity, and into all capacities jointly (plan ``joint``)."""
    sizes = _token_table(spark, sf_dir).select("doc_id", "tokens")
    kinds = table(spark, sf_dir, "containers").select("container_kind", "capacity_tokens").collect()
    plans = [(r[0], [r[1]]) for r in kinds] + [("joint", [r[1] for r in kinds])]
    out = None
    for name, capacities in plans:
        one = packing.pack(sizes, "doc_id", "tokens", capacities).withColumn("plan", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def p7_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packings(spark, sf_dir).select("plan", "bin", "capacity", "doc_id", "piece", "token_start", "n_tokens")


def p7_fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = _packings(spark, sf_dir).groupBy("plan", "bin").agg(F.first("capacity").alias("capacity"), F.sum("n_tokens").alias("used"))
    return bins.groupBy("plan", "capacity").agg(F.count(F.lit(1)).alias("bins"), F.sum("used").alias("tokens"), (F.sum("used") / F.sum("capacity")).alias("fill_rate"))


def p7_least_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All capacities jointly, where a container costs its tokens and the squared share of attention: bins, fill rate and cost by capacity."""
    sizes = _token_table(spark, sf_dir).select("doc_id", "tokens")
    capacities = [r[0] for r in table(spark, sf_dir, "containers").select("capacity_tokens").collect()]
    bins = packing.pack(sizes, "doc_id", "tokens", capacities, lambda c: c + c * c / 8192).groupBy("bin", "capacity").agg(F.sum("n_tokens").alias("used"))
    cost = F.col("capacity") + F.col("capacity") * F.col("capacity") / 8192
    return bins.groupBy("capacity").agg(F.count(F.lit(1)).alias("bins"), F.sum("used").alias("tokens"), (F.sum("used") / F.sum("capacity")).alias("fill_rate"), F.sum(cost).alias("cost"))


def _mixture_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.lower(F.regexp_extract("rel_path", r"\.([A-Za-z0-9]+)$", 1))
    topic = F.when(F.col("rel_path").isNull(), "text").when(ext.isin("md", "txt", "rst"), "prose_file").when(ext.isin("yaml", "yml", "json", "ini", "conf", "lock"), "settings").otherwise("code")
    return _token_table(spark, sf_dir).select("doc_id", mixing.plain_name(F.col("source")).alias("source"), mixing.plain_language(F.col("lang")).alias("language"), topic.alias("topic"), "tokens")


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.mix(_mixture_documents(spark, sf_dir), targets, "doc_id"), targets


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0].select("doc_id", "source", "tokens", "repeats")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mixture(spark, sf_dir))


def p8_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the corpus's tokens with targets for sources, languages and topics; the shares reached in all three.

    Starting from what the source targets imply, languages are flattened (power of 0.8) and settings and prose among
    the files count half as much again, at the expense of code.
    """
    docs, targets = written(_mixture_documents(spark, sf_dir), "mix-corpus"), table(spark, sf_dir, "mix_targets")
    goal = {r["source"]: r["target_share"] for r in targets.collect()}
    cells = docs.where("tokens > 0").groupBy("source", "language", "topic").agg(F.sum("tokens").alias("n")).where(F.col("source").isin(list(goal))).collect()
    have = {s: sum(c["n"] for c in cells if c["source"] == s) for s in goal}
    implied = lambda k: {v: sum(goal[c["source"]] * c["n"] / have[c["source"]] for c in cells if c[k] == v) for v in {c[k] for c in cells}}
    languages, topics = {k: v**0.8 for k, v in implied("language").items()}, implied("topic")
    more = {k: topics[k] / 2 for k in ("settings", "prose_file") if k in topics}
    topics = {k: v + more.get(k, 0.0) - (sum(more.values()) if k == "code" else 0.0) for k, v in topics.items()}
    drawn = written(mixing.mix(docs, targets, "doc_id", sum(have.values()) // 4, languages, topics), "mixture")
    return mixing.marginal_shares(drawn, {"source": goal, "language": languages, "topic": topics})


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.explode(F.array_distinct(F.transform("pii", lambda x: F.struct(x.pii_type.alias("pii_type"), x.pii_text.alias("pii_text"))))).alias("p")).select("doc_id", "p.pii_type", "p.pii_text")


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.col("redacted").alias("text"), F.size("pii").alias("n_replaced"))


QUERIES = {
    "p1_found": p1_found,
    "p1_keyword_counts": p1_keyword_counts,
    "p1_ngrams": p1_ngrams,
    "p2_found": p2_found,
    "p2_top_keywords": p2_top_keywords,
    "p4_found": p4_found,
    "p4_file_classes": p4_file_classes,
    "p7_assignment": p7_assignment,
    "p7_fill_rates": p7_fill_rates,
    "p7_least_cost": p7_least_cost,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p8_marginals": p8_marginals,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
}

_WORDS = """
latest as (select workspace_id, doc_id, words from source_files qualify coalesce(last_sync_time, -1) = max(coalesce(last_sync_time, -1)) over (partition by workspace_id, doc_id)),
seqs as (select distinct workspace_id, doc_id, words from latest where words is not null),
entries as (select workspace_id, doc_id, lower(unnest(words)) as keyword from seqs),
word_counts as (select keyword, count(*) as n, count(distinct workspace_id || ' ' || doc_id) as n_files from entries where keyword is not null and keyword <> '' group by keyword)
"""

SQL = {
    "p1_keyword_counts": f"with {_WORDS} select keyword, n, n_files from word_counts",
    "p1_ngrams": """
with t as (select doc_id, list_transform(regexp_extract_all(text, '[a-zA-Z0-9_][a-zA-Z0-9_-]+'), lambda w: lower(w)) as w from documents),
g as (select doc_id, unnest(w) as ngram from t union all select doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from t)
select ngram, count(*) as n, count(distinct doc_id) as n_docs from g group by ngram
""",
    "p1_found": f"""
with {_WORDS}, files as (select count(*) as n from (select distinct workspace_id, doc_id from source_files)),
keys as (select row_key, keyword, max(doccount) as doccount from posting_rows where keyword is not null group by all),
sums as (select keyword, coalesce(sum(doccount), 0) as n from keys group by keyword), total as (select sum(n) as n from sums)
select 'words' as field, keyword, case when n_files <= 2 then 'rare' else 'common' end as mark from word_counts where n_files <= 2 or n_files > 0.1 * (select n from files)
union all
select 'doccount', keyword, case when n <= 2 then 'rare' else 'common' end from sums where n <= 2 or n > 0.004 * (select n from total)
""",
    "p2_found": """
with entries as (select lower(unnest(words)) as keyword from source_files),
n as (select keyword, count(*) as n from entries where keyword is not null and keyword <> '' group by keyword)
select 'words' as field, keyword from n where n >= 0.012 * (select count(*) from entries)
union all
select 'keyword', keyword from posting_rows where keyword is not null group by keyword having count(*) >= 0.02 * (select count(*) from posting_rows)
""",
    "p2_top_keywords": "select keyword, count(*) as n from posting_rows where keyword is not null group by keyword order by n desc, keyword limit 100",
}
