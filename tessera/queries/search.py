"""Queries of content search, file search, indexing and the catalogue, with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.common import shared_dir, spread, table
from tessera.engine import ContentRequest, Engine
from tessera.functions import fuzzy, globs, text
from tessera.operators import content, eager, extended, files, index
from tessera.plans.grammar import parse
from tessera.plans.query import compile_query
from tessera.plans.settings import DEFAULT_EXCLUDE, DEFAULT_INCLUDE, Limit, Settings
from tessera.sources import catalog, corpus
from tessera.streaming.ingest import SCHEMA, BucketedIndex, file_changes, index_stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- the corpus and its SQL


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a corpus; those that are no files get a path from source, language and id."""
    source = F.regexp_replace(F.lower(F.trim("source")), "-", "_")
    path = F.coalesce("rel_path", F.concat(source, F.lit("/"), F.coalesce("lang", F.lit("und")), F.lit("/doc_"), F.col("doc_id"), F.lit(".txt")))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("rel_path"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size"))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.with_words(spread(docs(spark, sf_dir)))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(indexed(spark, sf_dir))


_DOCS = """docs as (select doc_id, coalesce(rel_path, replace(lower(trim(source)), '-', '_') || '/' || coalesce(lang, 'und') || '/doc_' || doc_id || '.txt') as rel_path, text as content, strlen(text) as size from documents)"""
_WORDS = "list_sort(list_distinct(list_transform(list_filter(regexp_extract_all({0}, '[a-zA-Z0-9_][a-zA-Z0-9_-]+'), lambda w: length(w) between 3 and 80), lambda w: lower(w))))"
_INDEXED = f"{_DOCS}, indexed as (select *, {_WORDS.format('content')} as words from docs)"
_POSTS = f"{_INDEXED}, posts as (select doc_id, unnest(words) as keyword from indexed)"
_LINES = f"""{_INDEXED}, split as (select doc_id, rel_path, words, string_split(content, chr(10)) as s from indexed),
trimmed as (select doc_id, rel_path, words, case when s[-1] = '' then s[1:-2] else s end as s from split),
cut as (select doc_id, rel_path, words, coalesce(list_position(list_transform(s, lambda x: strlen(x) > 65535), true), 0) as k, s from trimmed),
ended as (select doc_id, rel_path, words, list_transform(case when k > 0 then s[1:k - 1] else s end, lambda x: case when ends_with(x, chr(13)) then x[:-2] else x end) as s from cut),
lines as (select doc_id, rel_path, words, s, unnest(range(1, len(s) + 1))::int as line_number, unnest(s) as content from ended)"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def content_sql(q: str, case_sensitive: bool = False, where: str = "true", cols: str = "doc_id, rel_path, line_number, content, start, \"end\"", tail: str = "") -> str:
    """The matches of a query in SQL, from the same compiled plan; ``tail`` are further steps over ``found``."""
    plan = compile_query(q, case_sensitive)
    opt = "'c'" if case_sensitive else "'i'"
    has = lambda p: f"len(list_filter(words, lambda w: starts_with(w, {_quoted(p)}))) > 0"
    cand = " or ".join("(" + " and ".join(has(t.prefix) for t in c.terms) + ")" for c in plan.clauses)
    which = "case " + " ".join(f"when regexp_matches(content, {_quoted(c.regex)}, {opt}) then {k}" for k, c in enumerate(plan.clauses)) + " end"
    parts = " union all ".join(
        f"select *, regexp_extract_all(content, {_quoted(c.regex)}, 0, {opt}) as m, regexp_extract_all(content, {_quoted(c.regex)}, 1, {opt}) as g1, "
        f"regexp_extract_all(content, {_quoted(c.regex)}, 2, {opt}) as g2, regexp_split_to_array(content, {_quoted(c.regex)}, {opt}) as gaps from hits where clause = {k}"
        for k, c in enumerate(plan.clauses)
    )
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: strlen(y))), 0)"
    return f"""with {_LINES}, hits as (select * from (select *, {which} as clause from lines where ({cand}) and ({where})) where clause is not null),
groups as ({parts}), each as (select *, unnest(range(1, len(m) + 1)) as i from groups),
found as (select doc_id, rel_path, s, line_number, content, ({size('gaps[1:i]')} + {size('m[1:i - 1]')} + strlen(g1[i]))::int as start,
  ({size('gaps[1:i]')} + {size('m[1:i - 1]')} + strlen(g1[i]) + strlen(g2[i]))::int as "end" from each){tail}
select {cols} from {'found' if not tail else 'last'}"""


FLAT = ["doc_id", "rel_path", "line_number", "content", "start", "end"]
NO_LIMIT = Limit(0, 0, 0)


def found(spark: SparkSession, sf_dir: str, q: str, case_sensitive: bool = False, wanted: Column | None = None, context: int = 0) -> DataFrame:
    return content.matches(indexed(spark, sf_dir), compile_query(q, case_sensitive), None, wanted, context)


for _name, _q, _case in (
    ("content_single", "scanner", False),
    ("content_multi", "return error", False),
    ("content_or", "merge keyword | class bridge | indexer", False),
    ("content_case", "Error", True),
    ("content_wildcard", "init* | he*l? | re?d | exp*nd", False),
    ("content_proximity", "var AND map AND string", False),
    ("content_escapes", "fmt.Errorf | size_t: | arr[0]", False),
):
    query(_name, content_sql(_q, _case))(lambda spark, d, q=_q, c=_case: found(spark, d, q, c).select(*FLAT))


@query("content_from_postings", content_sql("merge keyword"))
def content_from_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search with the candidates from the posting table."""
    return content.matches(docs(spark, sf_dir), compile_query("merge keyword"), posts(spark, sf_dir)).select(*FLAT)


def _filtered(name: str, q: str, where: str, **kw) -> None:
    query(name, content_sql(q, where=where))(lambda spark, d: found(spark, d, q, wanted=content.path_filter(F.col("rel_path"), **kw)).select(*FLAT))


_filtered("content_path", "return", "starts_with(lower(rel_path), 'src/')", path="src")
_filtered("content_include", "return", "regexp_matches(rel_path || '/', '^(?:.*/)?[^/]*\\.go/$', 'i')", include="*.go,src/*/nothing.xyz")
_filtered("content_exclude", "error", "not regexp_matches(rel_path || '/', '^(?:.*/)?tests/(?:[^/]+/)*[^/]*/$', 'i') and not regexp_matches(rel_path || '/', '^(?:.*/)?[^/]*\\.js/$', 'i')", exclude="tests/**/*,*.js")

_FILE_CAP = """, ranked as (select *, row_number() over (partition by doc_id order by line_number, start) as r from found), last as (
  select * exclude (r), count(*) over (partition by doc_id) >= 3 as file_truncated from ranked where r <= 3)"""


@query("content_limit_file", content_sql("return", cols='doc_id, line_number, start, "end", file_truncated', tail=_FILE_CAP))
def content_limit_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.per_file(found(spark, sf_dir, "return"), 3).select("doc_id", "line_number", "start", "end", "file_truncated")


_TOTAL_CAP = """, capped as (select * exclude (r) from (select *, row_number() over (partition by doc_id order by line_number, start) as r from found) where r <= 5),
numbered as (select *, row_number() over (order by rel_path, doc_id, line_number, start) as n from capped),
whole as (select *, min(n) over (partition by doc_id, line_number) as f from numbered),
last as (select *, count(*) over (partition by doc_id) >= 5 as file_truncated, count(*) over () >= 100 as truncated from whole where f <= 100)"""


@query("content_limit_total", content_sql("return", cols='doc_id, line_number, start, "end", file_truncated, truncated', tail=_TOTAL_CAP))
def content_limit_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.limited(found(spark, sf_dir, "return"), Limit(100, 5)).select("doc_id", "line_number", "start", "end", "file_truncated", "truncated")


_CONTEXT = """, last as (select *, array_to_string(s[greatest(1, line_number - 2):line_number - 1], chr(10)) as before, array_to_string(s[line_number + 1:line_number + 2], chr(10)) as after from found)"""


@query("content_context", content_sql("scanner", cols='doc_id, line_number, start, before, after', tail=_CONTEXT))
def content_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, "scanner", context=2).select("doc_id", "line_number", "start", F.concat_ws("\n", "before").alias("before"), F.concat_ws("\n", "after").alias("after"))


_BY_FILE = """, last as (select doc_id, rel_path, count(*) as hits, min(line_number) as first_line, max(line_number) as last_line, sum("end" - start)::bigint as bytes from found group by all)"""


@query("content_file_summary", content_sql("import", cols="doc_id, rel_path, hits, first_line, last_line, bytes", tail=_BY_FILE))
def content_file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches nested under their file, then counted from the nested form."""
    rows = found(spark, sf_dir, "import").withColumns({"file_truncated": F.lit(False), "truncated": F.lit(False)})
    nested = content.by_file(rows)
    number = F.transform("lines", lambda x: x.line.line_number)
    size = F.aggregate("lines", F.lit(0).cast("bigint"), lambda s, x: s + (x.line.match[1] - x.line.match[0]))
    return nested.select("doc_id", "rel_path", F.size("lines").cast("bigint").alias("hits"), F.array_min(number).alias("first_line"), F.array_max(number).alias("last_line"), size.alias("bytes"))


@query("engine_content", content_sql("merge keyword | scanner", where="starts_with(lower(rel_path), 'src/')", cols="rel_path, count(*) as hits", tail=", last as (select rel_path from found)").replace("from last", "from last group by rel_path"))
def engine_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole request through the façade: filters, limits and nesting."""
    engine = Engine(indexed(spark, sf_dir), settings=Settings(limit=NO_LIMIT))
    return engine.search_content(ContentRequest("merge keyword | scanner", path="src")).select("rel_path", F.size("lines").cast("bigint").alias("hits")).groupBy("rel_path").agg(F.sum("hits").alias("hits"))


# ---------------------------------------------------------------- words, postings, candidates


@query("tokenize_words", f"with {_INDEXED} select doc_id, len(words)::int as n_words, array_to_string(words, ' ') as words from indexed")
def tokenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir).select("doc_id", F.size("words").alias("n_words"), F.concat_ws(" ", "words").alias("words"))


@query("postings", f"with {_POSTS} select keyword, doc_id from posts")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).select("keyword", "doc_id")


@query("keyword_doc_freq", f"with {_POSTS} select keyword, count(*) as doc_count from posts group by keyword")
def keyword_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.keyword_doc_counts(posts(spark, sf_dir))


@query(
    "posting_chunks",
    f"with {_POSTS}, ranked as (select keyword, doc_id, (row_number() over (partition by keyword order by doc_id) - 1) // 100 as chunk from posts) "
    "select keyword, chunk, count(*) as doc_count, string_agg(doc_id, '|' order by doc_id) as doc_ids from ranked group by all",
)
def posting_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting lists of at most 100 ids (no keyword of these tables has so many that it is cut by the ids' hash as well)."""
    packed = index.chunks(posts(spark, sf_dir), size=100)
    return packed.select("keyword", F.col("part.chunk").alias("chunk"), "doc_count", F.concat_ws("|", "doc_ids").alias("doc_ids"))


_POSTING_LISTS = "lists as (select workspace, keyword, list_distinct(string_split(docids, '|')) as ids from posting_rows where keyword is not null and workspace is not null and docids is not null)"


@query(
    "compaction",
    f"""with {_POSTING_LISTS}, per as (select workspace, keyword, count(*) as rows_before, avg(len(ids)) as m from lists group by all),
again as (select distinct workspace, keyword, rows_before, unnest(ids) as id from lists join per using (workspace, keyword) where rows_before >= 2 and m <= 1000),
ranked as (select *, (row_number() over (partition by workspace, keyword order by id) - 1) // 1000 as chunk from again)
select workspace, keyword, rows_before, string_agg(id, '|' order by id) as doc_ids from ranked group by workspace, keyword, rows_before, chunk
union all select workspace, keyword, rows_before, array_to_string(list_sort(ids), '|') from lists join per using (workspace, keyword) where rows_before < 2 or m > 1000""",
)
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All posting rows compacted to lists of up to 1000 ids, with the rows of their keyword before."""
    rows = table(spark, sf_dir, "posting_rows").where("keyword is not null and workspace is not null and docids is not null")
    rows = rows.select("workspace", "keyword", F.array_distinct(F.split("docids", r"\|")).alias("doc_ids"))
    return index.compact(rows, "workspace").select("workspace", "keyword", "rows_before", F.concat_ws("|", F.sort_array("doc_ids")).alias("doc_ids"))


@query("compaction_due", f"with {_POSTING_LISTS}, per as (select workspace, keyword, count(*) as n, sum(len(ids)) as ids from lists group by all), t as (select sum(n)::bigint as rows, sum(case when n < 2 or ids / n > 1000 then n else least(n, ceil(ids / 1000)) end)::bigint as rows_after from per) select rows, rows_after, rows - rows_after >= 0.25 * rows as due from t")
def compaction_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "posting_rows").where("keyword is not null and workspace is not null and docids is not null")
    return index.needs_compaction(rows.select("workspace", "keyword", F.array_distinct(F.split("docids", r"\|")).alias("doc_ids")), "workspace")


@query(
    "chunk_remove",
    f"""with {_POSTING_LISTS}, each as (select row_number() over () as r, workspace, keyword, ids from lists),
left_ids as (select r, workspace, keyword, unnest(ids) as id from each), kept as (select r, workspace, keyword, id from left_ids where not (keyword like 'c%' and starts_with(id, 'a')))
select workspace, keyword, string_agg(id, '|' order by id) as doc_ids from kept group by r, workspace, keyword""",
)
def chunk_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All posting lists after the files whose id begins with ``a`` have left the keywords that begin with ``c``."""
    rows = table(spark, sf_dir, "posting_rows").where("keyword is not null and workspace is not null and docids is not null")
    rows = rows.select("workspace", "keyword", F.array_distinct(F.split("docids", r"\|")).alias("doc_ids"))
    gone = rows.where("keyword like 'c%'").select("workspace", "keyword", F.explode("doc_ids").alias("doc_id")).where("doc_id like 'a%'")
    return index.remove_from_chunks(rows, gone, "workspace").select("workspace", "keyword", F.concat_ws("|", F.sort_array("doc_ids")).alias("doc_ids"))


@query("prefix_lookup", f"with {_POSTS} select distinct doc_id from posts where starts_with(keyword, 'scan')")
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.prefix_lookup(posts(spark, sf_dir), "scan")


def _candidates(name: str, q: str) -> None:
    plan = compile_query(q)
    test = " or ".join("(" + " and ".join(f"doc_id in (select doc_id from posts where starts_with(keyword, {_quoted(t.prefix)}))" for t in c.terms) + ")" for c in plan.clauses)
    query(name, f"with {_POSTS} select distinct doc_id from posts where {test}")(lambda spark, d: content.candidates_from_postings(posts(spark, d), plan))


_candidates("and_candidates", "return AND import")
_candidates("or_candidates", "scanner | bridge")
_candidates("and_or_candidates", "return import | class bridge | merge")


@query("line_numbers", f"with {_LINES} select doc_id, line_number, md5(content) as line from lines")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(content.lines(F.col("content"))).alias("i", "line"))
    return rows.select("doc_id", (F.col("i") + 1).alias("line_number"), F.md5("line").alias("line"))


# ---------------------------------------------------------------- documents and key ranges


@query("scan_files", f"with {_DOCS} select doc_id, rel_path from docs")
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.scan_paths(docs(spark, sf_dir))


@query("doc_lookup", f"with {_DOCS} select doc_id, rel_path, size from docs where doc_id in (select doc_id from documents where contains(text, 'velvetgrid'))")
def doc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "documents").where(F.col("text").contains("velvetgrid")).select("doc_id")
    return corpus.document_get(docs(spark, sf_dir), wanted).select("doc_id", "rel_path", "size")


@query("key_point_get", "select workspace, keyword, doccount from posting_rows where keyword = 'config'")
def key_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.point_get(table(spark, sf_dir, "posting_rows"), "keyword", "config").select("workspace", "keyword", "doccount")


@query("key_prefix_scan", "select row_key, tick from posting_rows where starts_with(row_key, 'kw:7|s')")
def key_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.prefix_scan(table(spark, sf_dir, "posting_rows"), "row_key", "kw:7|s").select("row_key", "tick")


@query("key_range_scan", "select row_key, tick from posting_rows where row_key >= 'kw:8|a' and row_key < 'kw:8|d'")
def key_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.range_scan(table(spark, sf_dir, "posting_rows"), "row_key", "kw:8|a", "kw:8|d").select("row_key", "tick")


@query(
    "posting_key_codec",
    r"""with k as (select row_key, starts_with(row_key, 'kw:') and len(string_split(substr(row_key, 4), '|')) = 4 and regexp_full_match(row_key, 'kw:[^|]*\|[^|]*\|[0-9]+\|[0-9]+') and try_cast(string_split(row_key, '|')[3] as bigint) is not null and try_cast(string_split(row_key, '|')[4] as bigint) is not null as good,
string_split(substr(row_key, 4), '|') as p from posting_rows)
select row_key, case when good then p[1] end as workspace, case when good then p[2] end as keyword, case when good then p[3]::bigint end as doccount, case when good then p[4]::bigint end as tick from k""",
)
def posting_key_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eager.parse_posting_key(table(spark, sf_dir, "posting_rows").select("row_key")).select("row_key", "workspace", "keyword", "doccount", "tick")


@query("document_json", "select doc_id, rel_path, size, hash, modified_time, last_sync_time from source_files")
def document_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document entries to JSON and back."""
    rows = table(spark, sf_dir, "source_files").select("doc_id", "rel_path", "size", "hash", "modified_time", "last_sync_time")
    stored = corpus.document_json(rows, "doc_id").select("doc_id", "json")
    return corpus.document_of_json(stored, "doc_id", "rel_path string, size bigint, hash string, modified_time bigint, last_sync_time bigint")


# ---------------------------------------------------------------- maintenance

_HALF = f"half as (select doc_id, {_WORDS.format('left(content, (size // 2)::int)')} as words from docs)"


@query(
    "word_diff",
    f"with {_INDEXED}, {_HALF} select h.doc_id, array_to_string(list_sort(list_filter(h.words, lambda w: not list_contains(i.words, w))), ' ') as added, array_to_string(list_sort(list_filter(i.words, lambda w: not list_contains(h.words, w))), ' ') as removed from half h join indexed i using (doc_id)",
)
def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document replaced by its first half (in characters of half its bytes)."""
    current = indexed(spark, sf_dir)
    updated = docs(spark, sf_dir).select("doc_id", text.words(F.call_function("left", F.col("content"), F.floor(F.col("size") / 2).cast("int"))).alias("words"))
    return index.word_diff(current, updated).select("doc_id", F.concat_ws(" ", "added").alias("added"), F.concat_ws(" ", "removed").alias("removed"))


@query("posting_remove", f"with {_POSTS} select keyword, doc_id from posts where not (starts_with(keyword, 'r') and doc_id in (select doc_id from documents where file_id is null))")
def posting_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = posts(spark, sf_dir)
    gone = all_.where(F.col("keyword").startswith("r")).join(table(spark, sf_dir, "documents").where("file_id is null").select("doc_id"), "doc_id", "left_semi")
    return index.remove_postings(all_, gone.select("keyword", "doc_id")).select("keyword", "doc_id")


@query("doc_delete", f"with {_DOCS} select doc_id, rel_path from docs where doc_id not in (select doc_id from documents where n_chars > 500)")
def doc_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.delete_documents(docs(spark, sf_dir), table(spark, sf_dir, "documents").where("n_chars > 500")).select("doc_id", "rel_path")


@query("upsert_docs", f"with {_DOCS} select doc_id, case when size < 300 then md5(content || '!') else md5(content) end as hash from docs")
def upsert_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = docs(spark, sf_dir).select("doc_id", "content", "size")
    changed = stored.where("size < 300").withColumn("content", F.concat("content", F.lit("!")))
    return index.upsert(stored, changed).select("doc_id", F.md5("content").alias("hash"))


@query(
    "unchanged_state",
    """with r as (select workspace_id || '/' || doc_id as doc_id, modified_time, nullif(hash, '') as hash, last_sync_time,
row_number() over (partition by workspace_id, doc_id order by last_sync_time, modified_time, hash nulls first) as a, row_number() over (partition by workspace_id, doc_id order by last_sync_time desc, modified_time desc, hash desc nulls last) as z from source_files)
select c.doc_id, case when o.doc_id is null then 'new' when c.modified_time = o.modified_time then 'unchanged_time' when c.hash = o.hash then 'unchanged_hash' else 'changed' end as state
from (select * from r where z = 1) c left join (select * from r where a = 1) o using (doc_id)""",
)
def unchanged_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entry of every file against its oldest."""
    rows = table(spark, sf_dir, "source_files").select(F.concat_ws("/", "workspace_id", "doc_id").alias("doc_id"), "last_sync_time", "modified_time", F.nullif("hash", F.lit("")).alias("hash"))
    r = F.struct("last_sync_time", "modified_time", "hash")
    both = rows.groupBy("doc_id").agg(F.min(r).alias("a"), F.max(r).alias("z"))
    return index.unchanged(both.select("doc_id", "z.modified_time", "z.hash"), both.select("doc_id", "a.modified_time", "a.hash"))


@query("stream_index", f"with {_INDEXED} select doc_id::varchar as doc_id, rel_path, len(words)::int as n_words from indexed where size >= 200")
def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through a file stream into a bucketed index; small ones are deleted again by a second batch."""
    base = f"{shared_dir(spark)}/tessera/stream-{uuid.uuid4().hex}"
    rows = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "rel_path", "size", F.md5("content").alias("hash"), F.lit(0).cast("long").alias("modified_time"), "content")
    first = rows.withColumns({"op": F.lit("upsert"), "seq": F.lit(1).cast("long")})
    first.write.parquet(f"{base}/in")
    target = BucketedIndex(spark, f"{base}/index", 16)
    schema = SCHEMA.replace(", words array<string>", "") + ", op string, seq bigint"
    index_stream(file_changes(spark, f"{base}/in", schema), target, f"{base}/checkpoint").awaitTermination()
    rows.where("size < 200").withColumns({"op": F.lit("delete"), "seq": F.lit(2).cast("long")}).write.mode("append").parquet(f"{base}/in")
    index_stream(file_changes(spark, f"{base}/in", schema), target, f"{base}/checkpoint").awaitTermination()
    return target.documents().select("doc_id", "rel_path", F.size("words").alias("n_words"))


# ---------------------------------------------------------------- files: kinds, globs, ignore rules, fuzzy search

_EXT = "lower(regexp_extract(rel_path, '(\\.[^./]*)$', 1))"


@query("ext_filter", f"select distinct rel_path from source_files where {_EXT} not in ({', '.join(map(_quoted, text.BINARY_EXTENSIONS))})")
def ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_files").where(text.indexable(F.col("rel_path"))).select("rel_path").distinct()


@query("text_ratio", "select doc_id, round(strlen(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'))::double / strlen(text), 9) as ratio from documents where strlen(text) > 0")
def text_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where(F.octet_length("text") > 0)
    return rows.select("doc_id", F.round(text.printable_ratio(F.encode("text", "UTF-8")), 9).alias("ratio"))


@query("size_gate", f"with {_INDEXED} select doc_id, (case when size > 2000 then 0 else len(words) end)::int as n_words from indexed")
def size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.with_words(docs(spark, sf_dir), 2000).select("doc_id", F.size("words").alias("n_words"))


@query("mime_rules", f"with {_DOCS}, m as (select doc_id, {_EXT} as e from docs) select doc_id, e in ('.json', '.xml', '.js', '.html', '.css', '.txt', '.md', '.csv') as is_text from m")
def mime_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", text.text_mime(corpus.guessed_mime(F.col("rel_path"))).alias("is_text"))


@query("md5_ids", "select s.doc_id, s.doc_id = md5(w.path || '/' || s.rel_path) as same from source_files s join workspaces w on w.id = s.workspace_id")
def md5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "workspaces").select(F.col("id").alias("workspace_id"), "path")
    rows = table(spark, sf_dir, "source_files").join(paths, "workspace_id")
    return rows.select("doc_id", (F.col("doc_id") == text.document_id(F.col("path"), F.col("rel_path"))).alias("same"))


_PATTERNS = ["*.go", "/src/*", "src/**/test?.py", "**/tests/**", "[a-m]*.py", "*-[0-9a-f]*.js", "docs/**"]
_GLOB_SQL = ", ".join(f"(case when regexp_matches(rel_path || '/', {_quoted(globs.parse_rule(p).regex)}, 'i') then 1 else 0 end)::int as g{k}" for k, p in enumerate(_PATTERNS))


@query("glob_rules", f"with {_DOCS} select doc_id, {_GLOB_SQL} from docs")
def glob_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", *[globs.listed_column([globs.parse_rule(p)], F.col("rel_path"), False).cast("int").alias(f"g{k}") for k, p in enumerate(_PATTERNS)])


@query("exclude_pruned", f"""with {_DOCS} select doc_id, rel_path from docs
where not (regexp_matches(rel_path, '(^|/)(node_modules|dist|build|vendor|out|obj|log|logs)/', 'i') or regexp_matches(rel_path, '(^|/)\\.[^/]*(/|$)') or regexp_matches(rel_path, '\\.log(\\.[^/]*)?(/|$)', 'i'))""")
def exclude_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default exclude list; excluded folders are not descended into."""
    path = F.col("rel_path")
    return docs(spark, sf_dir).where(~globs.excluded_with_folders(globs.parse_rules(DEFAULT_EXCLUDE), path) & globs.listed_column(globs.parse_rules(DEFAULT_INCLUDE), path, False)).select("doc_id", "rel_path")


@query("gitignore_files", f"""with {_DOCS} select doc_id, rel_path from docs where not (
  not (starts_with(rel_path, 'src/') and regexp_matches(rel_path, '/[^/]*keep[^/]*$', 'i')) and
  (regexp_matches(rel_path, '(^|/)(dist|tests)/', 'i') or regexp_matches(rel_path, '\\.css$', 'i') or (starts_with(rel_path, 'src/') and regexp_matches(rel_path, '\\.min\\.js$', 'i'))))""")
def gitignore_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"": ["# styles", "*.css", "dist/", "tests/"], "src": ["!*keep*", "*.min.js"]}
    return globs.git_ignored(docs(spark, sf_dir).select("doc_id", "rel_path"), "rel_path", rules).where("not ignored").select("doc_id", "rel_path")


def fuzzy_sql(pattern: str, order: str = "") -> str:
    """The score with one position column per character."""
    low, n = pattern.lower(), len(pattern)

    def score(t: str, base: str) -> tuple[str, str]:
        cols, prev = [], ""
        for k, ch in enumerate(low):
            find = f"instr({t}, {_quoted(ch)})" if k == 0 else f"case when {prev} = 0 or instr(substr({t}, {prev} + 1), {_quoted(ch)}) = 0 then 0 else {prev} + instr(substr({t}, {prev} + 1), {_quoted(ch)}) end"
            prev = f"{base}{k}"
            cols.append(f"{find} as {prev}")
        run = " + ".join(f"(case when {base}{k + 1} = {base}{k} + 1 then 1 else 0 end)" for k in range(n - 1))
        bonus = f"case when {base}0 <= 3 then 25 when substr({t}, ({base}0 - 1)::int, 1) in ('_', '-', ' ', '.', '/', '\\') then 15 else 0 end"
        return ", ".join(cols), f"(trunc({n}::double / length({t}) * 25 + ({run})::double / {n - 1} * 25 + {n}::double / ({base}{n - 1} - {base}0 + 1) * 30)::int + {bonus})"

    a, whole = score("t", "p")
    b, own = score("b", "q")
    sub = "(?s)" + ".*".join(pattern)
    return f"""with {_DOCS}, paths as (select rel_path, lower(rel_path) as t, lower(regexp_extract(rel_path, '([^/]*)$', 1)) as b, regexp_extract(rel_path, '([^/]*)$', 1) as base from docs where regexp_matches(rel_path, {_quoted(sub)})),
placed as (select *, {a}, {b} from paths),
named as (select *, case when contains(rel_path, '/') and regexp_matches(base, {_quoted(sub)}) then (case when contains(b, {_quoted(low)}) then 100 else least(100, {own}) end) * 4 // 5 else 0 end as bonus from placed),
scored as (select rel_path, (case when contains(t, {_quoted(low)}) then 100 when p{n - 1} = 0 then 50 else least(100, {whole} + bonus) end)::int as score from named)
select rel_path, score from scored where score > 50 {order}"""


@query("fuzzy_files", fuzzy_sql("srcgo"))
def fuzzy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.fuzzy_files(docs(spark, sf_dir), "src go")


@query("fuzzy_topk", fuzzy_sql("rankpy", "order by score desc, strlen(rel_path), rel_path limit 25"))
def fuzzy_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.search_files(docs(spark, sf_dir), "rankpy", 25)


@query("files_existing", fuzzy_sql("scnrjs").replace("where score > 50", "where score > 50 and rel_path in (select rel_path from source_files)"))
def files_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.existing(files.fuzzy_files(docs(spark, sf_dir), "scnrjs"), table(spark, sf_dir, "source_files")).select("rel_path", "score")


@query("fuzzy_subsequence", f"with {_DOCS} select doc_id from docs where regexp_matches(rel_path, '(?s)t.*e.*s.*t')")
def fuzzy_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(fuzzy.subsequence(F.col("rel_path"), "test")).select("doc_id")


# ---------------------------------------------------------------- the boolean grammar


@query("grammar_not", f"with {_LINES} select doc_id, line_number from lines where regexp_matches(content, '(?i)(^|[^a-zA-Z0-9_])return([^a-zA-Z0-9_]|$)') and not regexp_matches(content, '(?i)(^|[^a-zA-Z0-9_])null([^a-zA-Z0-9_]|$)')")
def grammar_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extended.matching_lines(docs(spark, sf_dir), parse("return AND NOT null")).select("doc_id", "line_number")


@query("grammar_phrase", f"with {_LINES} select doc_id, line_number from lines where contains(lower(content), 'is dropped when') or regexp_matches(content, '(?i)(^|[^a-zA-Z0-9_])wild') and regexp_matches(content, '(?i)(^|[^a-zA-Z0-9_])here([^a-zA-Z0-9_]|$)')")
def grammar_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extended.matching_lines(docs(spark, sf_dir), parse('"is dropped when" OR wild* here')).select("doc_id", "line_number")


# ---------------------------------------------------------------- the catalogue

_LIST = lambda xs: "[" + ", ".join(map(_quoted, xs)) + "]"


@query("workspace_list", "select id, path, use_global_filters, total_files from workspaces")
def workspace_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.in_order(table(spark, sf_dir, "workspaces")).select("id", "path", "use_global_filters", "total_files")


@query(
    "workspace_filters",
    f"""select id, array_to_string(case when filters is null or coalesce(use_global_filters, false) or coalesce(len(filters.include), 0) = 0 then {_LIST(DEFAULT_INCLUDE)} else filters.include end, ',') as include,
case when filters is null or coalesce(use_global_filters, false) then false else coalesce(filters.exclude.use_git_ignore, false) end as use_git_ignore,
array_to_string(case when filters is null or coalesce(use_global_filters, false) or (not coalesce(filters.exclude.use_git_ignore, false) and coalesce(len(filters.exclude.customized), 0) = 0) then {_LIST(DEFAULT_EXCLUDE)} else filters.exclude.customized end, ',') as customized from workspaces""",
)
def workspace_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.resolved_filters(table(spark, sf_dir, "workspaces"), Settings())
    return rows.select("id", F.concat_ws(",", "include").alias("include"), "use_git_ignore", F.concat_ws(",", "customized").alias("customized"))


@query("workspace_counters", "select workspace_id, count(distinct doc_id) as indexed, max(w.total_files) as total_files from source_files s left join workspaces w on w.id = s.workspace_id group by workspace_id")
def workspace_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.counters(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "workspaces"))
