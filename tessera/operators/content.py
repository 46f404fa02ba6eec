"""Content search: candidate documents, then lines, spans, context and limits, as one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import globs
from tessera.plans.query import Plan
from tessera.plans.settings import Limit

MAX_LINE = 65535  # bytes; a longer line ends the reading of its file
MAX_CONTEXT = 5


def _clause_condition(plan: Plan, has: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (has[t.prefix] for t in c.terms)) for c in plan.clauses))


def candidates_from_postings(posts: DataFrame, plan: Plan) -> DataFrame:
    """``doc_id`` of the candidates; one scan of the postings however many terms there are."""
    hit = reduce(lambda a, b: a | b, (F.col("keyword").startswith(p) for p in plan.prefixes))
    flags = posts.where(hit).groupBy("doc_id").agg(*[F.bool_or(F.col("keyword").startswith(p)).alias(f"_p{k}") for k, p in enumerate(plan.prefixes)])
    return flags.where(_clause_condition(plan, {p: F.col(f"_p{k}") for k, p in enumerate(plan.prefixes)})).select("doc_id")


def is_candidate(plan: Plan, words: Column) -> Column:
    """The same on a document's own word list, without any shuffle."""
    begins = lambda p: F.exists(words, lambda w: w.startswith(p))
    has = {p: begins(p) for p in plan.prefixes}
    return F.coalesce(_clause_condition(plan, has), F.lit(False))


def lines(content: Column) -> Column:
    """A text's lines: one trailing carriage return is dropped, so is the empty end behind a last line feed.

    Reading ends before the first line of more than MAX_LINE bytes.
    """
    parts = F.split(content, "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    long = F.array_position(F.transform(parts, lambda x: (F.octet_length(x) > MAX_LINE).cast("int")), F.lit(1))
    parts = F.when(long > 0, F.slice(parts, F.lit(1), (long - 1).cast("int"))).otherwise(parts)
    return F.transform(parts, lambda x: F.regexp_replace(x, "\\r\\z", ""))


def spans(line: Column, regex: str) -> Column:
    """Array of (start, end) byte offsets of the second group of all matches, left to right.

    A match is its first group, one character or, at most at the line's start, none, and its second.  As the leftmost match
    is the leftmost place of its text behind the match before, one extraction and a search for plain texts place them all.
    """
    whole = F.regexp_extract_all(line, F.lit(regex), 0)
    find = lambda x, at: F.call_function("locate", x, line, at)
    empty = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("places"))
    step = lambda s, x: F.struct((find(x, s["at"]) + F.char_length(x)).alias("at"), F.concat(s["places"], F.array(find(x, s["at"]))).alias("places"))
    placed = F.zip_with(whole, F.aggregate(whole, empty, step)["places"], lambda x, p: F.struct(x.alias("x"), p.alias("p"), F.octet_length(F.substring(line, F.lit(1), p - 1)).alias("before")))
    lead = lambda m: F.when(m["p"] == 1, F.octet_length(F.regexp_extract(line, regex, 1))).otherwise(F.octet_length(F.substring(m["x"], 1, 1)))
    return F.transform(placed, lambda m: F.struct((m["before"] + lead(m)).alias("start"), (m["before"] + F.octet_length(m["x"])).alias("end")))


def line_matches(line: Column, plan: Plan) -> Column:
    """Spans of the first clause that matches the line; null where none does."""
    out: Column | None = None
    for c in plan.clauses:
        hit, found = line.rlike(c.java), spans(line, c.java)
        out = F.when(hit, found) if out is None else out.when(hit, found)
    return out


def path_filter(rel_path: Column, path: str = "", include: str = "", exclude: str = "", workspace_include: list[str] | None = None) -> Column:
    """The files a request wants: below the path, included by the workspace, not excluded, included by the request.

    Lists are separated by commas; the last rule that matches decides; rules for folders never match a file.
    """
    want = F.lit(True)
    if path.strip("/"):
        want = want & F.lower(rel_path).startswith(globs.normal_path(path).strip("/").lower() + "/")
    if workspace_include:
        want = want & globs.listed_column(globs.parse_rules(workspace_include), rel_path, False)
    if exclude:
        want = want & ~globs.listed_column(globs.parse_rules(exclude.split(",")), rel_path, False)
    if include:
        want = want & globs.listed_column(globs.parse_rules(include.split(",")), rel_path, False)
    return want


def matches(documents: DataFrame, plan: Plan, posts: DataFrame | None = None, wanted: Column | None = None, context: int = 0) -> DataFrame:
    """One row per match: ``doc_id``, ``rel_path``, ``line_number``, ``content``, ``start``, ``end`` (and ``before``, ``after``).

    ``documents`` has doc_id, rel_path, content and, unless ``posts`` is given, words.  The candidate test is part
    of the meaning, not only of the speed: a line counts only in a document that has the terms as indexed words.
    """
    docs = documents if wanted is None else documents.where(wanted)
    docs = docs.where(is_candidate(plan, F.col("words"))) if posts is None else docs.join(candidates_from_postings(posts, plan), "doc_id", "left_semi")
    context = max(0, min(MAX_CONTEXT, context))
    hit = lambda x: x.rlike("|".join(f"(?:{c.java})" for c in plan.clauses))
    rows = docs.select("doc_id", "rel_path", lines(F.col("content")).alias("_lines"))
    numbered = F.filter(F.transform("_lines", lambda x, i: F.struct((i + 1).alias("line_number"), x.alias("content"))), lambda s: hit(s.content))
    keep = ["_lines"] if context else []
    rows = rows.select("doc_id", "rel_path", *keep, F.explode(numbered).alias("_l")).select("doc_id", "rel_path", *keep, "_l.line_number", "_l.content")
    rows = rows.withColumn("_s", F.explode(line_matches(F.col("content"), plan)))
    out = [*["doc_id", "rel_path", "line_number", "content"], F.col("_s.start").alias("start"), F.col("_s.end").alias("end")]
    if context:
        n = F.col("line_number")
        first = F.greatest(F.lit(1), n - context)
        out.append(F.slice("_lines", first, n - first).alias("before"))
        out.append(F.when(n < F.size("_lines"), F.slice("_lines", n + 1, F.lit(context))).otherwise(F.array().cast("array<string>")).alias("after"))
    return rows.select(*out)


def per_file(found: DataFrame, most: int) -> DataFrame:
    """The first matches of each file, at most so many; ``file_truncated`` where a file reaches that."""
    files = Window.partitionBy("doc_id")
    capped = found.withColumn("_r", F.row_number().over(files.orderBy("line_number", "start"))).where(F.col("_r") <= most)
    return capped.withColumn("file_truncated", F.count(F.lit(1)).over(files) >= most).drop("_r")


def limited(found: DataFrame, limit: Limit) -> DataFrame:
    """Applies the limits in order of path, line and start; adds ``file_truncated`` and ``truncated``.

    A file gives at most its limit of matches (and counts as truncated when it reaches it).  Over all files the
    line that reaches the limit is still given whole.  Only limit plus file limit rows are ever put in one order.
    A limit of 0 (of batch jobs; a server's limits are always positive) means none: rows stay where they are.
    """
    if limit.max_results <= 0:
        return found.withColumns({"file_truncated": F.lit(False), "truncated": F.lit(False)})
    per_file = Window.partitionBy("doc_id").orderBy("line_number", "start")
    capped = found.withColumn("_r", F.row_number().over(per_file)).where(F.col("_r") <= limit.max_results_per_file)
    order = ["rel_path", "doc_id", "line_number", "start"]
    top = capped.orderBy(*order).limit(limit.max_results + limit.max_results_per_file)
    numbered = top.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))
    whole = numbered.withColumn("_first", F.min("_n").over(Window.partitionBy("doc_id", "line_number"))).where(F.col("_first") <= limit.max_results)
    files = Window.partitionBy("doc_id")
    total = Window.partitionBy(F.lit(1))
    return (
        whole.withColumn("file_truncated", F.count(F.lit(1)).over(files) >= limit.max_results_per_file)
        .withColumn("truncated", F.count(F.lit(1)).over(total) >= limit.max_results)
        .drop("_r", "_n", "_first")
    )


def by_file(found: DataFrame, context: bool = False) -> DataFrame:
    """Matches nested under their file: ``rel_path``, ``lines`` (in order), ``truncate``, ``truncated``."""
    line = F.struct("line_number", "content", F.array("start", "end").alias("match"))
    entry = [F.col("line_number").alias("_n"), F.col("start").alias("_s"), line.alias("line")]
    if context:
        entry += [F.col("before"), F.col("after")]
    cols = ["before", "line", "after"] if context else ["line"]
    g = found.groupBy("doc_id", "rel_path").agg(
        F.sort_array(F.collect_list(F.struct(*entry))).alias("_l"), F.bool_or("file_truncated").alias("truncate"), F.bool_or("truncated").alias("truncated")
    )
    return g.select("doc_id", "rel_path", F.transform("_l", lambda x: F.struct(*[x[c].alias(c) for c in cols])).alias("lines"), "truncate", "truncated")
