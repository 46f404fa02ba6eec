"""Queries of the general data-processing problems (3, 5 and 6)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.common import shared_dir, table
from tessera.operators import eager, snapshots, versions


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "file_snapshots").select(
        "snapshot_no", "workspace_id", snapshots.plain_path(F.col("path")).alias("path"), "size", F.floor(F.col("modified_time") / F.lit(10**9)).alias("seconds"), "modified_time"
    )
    return snapshots.diff_snapshots(rows, "snapshot_no", "workspace_id", "path", ["size", "seconds"], "modified_time")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = table(spark, sf_dir, "posting_rows")
    least = 0.01 * postings.count()
    return p5_key_statistics(spark, sf_dir).where(F.col("n_rows") >= F.lit(least)).select("workspace", "keyword")


def p5_key_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eager.posting_key_statistics(table(spark, sf_dir, "posting_rows"), table(spark, sf_dir, "source_files"))


_FILE = ["workspace_id", "doc_id"]
_DIFFERS = versions.Differs("hash", ["modified_time", "size"])


def _feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The feed with the version each row belongs to, one for each successful run, and the runs by version."""
    runs = versions.versions_of_runs(table(spark, sf_dir, "sync_runs").where("status = 'success'").select("run_id", "started_time"), "started_time")
    return versions.with_version(table(spark, sf_dir, "doc_feed"), "arrived_time", runs, "started_time"), runs.select("_version", "run_id")


def _load(log: versions.VersionedTable, feed: DataFrame) -> None:
    log.load_upserts(feed, F.col("_v"), _FILE, ["last_sync_time"], ["hash", "size", "modified_time", "arrived_time", "feed_id"])


def _log_and_sink(spark: SparkSession) -> tuple[versions.VersionedTable, versions.DeltaSink]:
    name = uuid.uuid4().hex
    return versions.VersionedTable(spark, f"{shared_dir(spark)}/tessera/doc-feed-{name}"), versions.DeltaSink(spark, f"{shared_dir(spark)}/tessera/deltas-{name}")


def _consumed(spark: SparkSession, sink: versions.DeltaSink, runs: DataFrame) -> DataFrame:
    if not sink.processed():
        return spark.createDataFrame([], "run_id bigint, workspace_id string, doc_id string")
    return sink.read().join(runs, "_version").select("run_id", *_FILE)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries: the versions of the first half of the runs are loaded and consumed in one commit, then the others."""
    feed, runs = _feed(spark, sf_dir)
    log, sink = _log_and_sink(spark)
    half = (runs.agg(F.max("_version")).first()[0] or 0) // 2
    for part in (feed.where(F.col("_v") <= half), feed.where(F.col("_v") > half)):
        _load(log, part)
        versions.process_new(log, sink, _FILE, _DIFFERS, uuid.uuid4().hex, each=False)
    return _consumed(spark, sink, runs)


def p6_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one delta and one commit for each version."""
    feed, runs = _feed(spark, sf_dir)
    log, sink = _log_and_sink(spark)
    _load(log, feed)
    versions.process_new(log, sink, _FILE, _DIFFERS, uuid.uuid4().hex)
    return _consumed(spark, sink, runs)


QUERIES = {"p3_found": p3_found, "p5_found": p5_found, "p5_key_statistics": p5_key_statistics, "p6_found": p6_found, "p6_incremental": p6_incremental}

_PAIRS = r"""
parsed as (
  select row_number() over () as r, docids, string_split(substr(row_key, 4), '|') as k from posting_rows
  where starts_with(row_key, 'kw:') and len(string_split(substr(row_key, 4), '|')) = 4
    and regexp_full_match(string_split(substr(row_key, 4), '|')[3], '[0-9]+') and try_cast(string_split(substr(row_key, 4), '|')[3] as bigint) is not null
    and regexp_full_match(string_split(substr(row_key, 4), '|')[4], '[0-9]+') and try_cast(string_split(substr(row_key, 4), '|')[4] as bigint) is not null
), counts as (select k[1] as workspace, k[2] as keyword, count(*) as n_rows, sum(k[3]::bigint)::bigint as sum_doccount from parsed group by all),
posted as (select distinct r, k[1] as workspace, k[2] as keyword, unnest(string_split(docids, '|')) as doc_id from parsed where docids is not null)
"""

SQL = {
    "p3_found": r"""
with rows as (
  select snapshot_no, workspace_id, trim(regexp_replace(regexp_replace(replace(trim(path), '\', '/'), '/+', '/', 'g'), '^(\./)+', ''), '/') as path,
         size, modified_time, modified_time // 1000000000 as seconds from file_snapshots
), one as (
  select * from rows qualify row_number() over (partition by snapshot_no, workspace_id, path order by modified_time desc nulls last, size desc nulls last) = 1
), listed as (
  select workspace_id, snapshot_no, lag(snapshot_no) over (partition by workspace_id order by snapshot_no) as prev from (select distinct workspace_id, snapshot_no from rows)
), pairs as (select * from listed where prev is not null)
select n.snapshot_no, n.workspace_id, n.path, case when o.path is null then 'added' else 'changed' end as change_kind
from one n join pairs p using (workspace_id, snapshot_no) left join one o on o.workspace_id = n.workspace_id and o.snapshot_no = p.prev and o.path = n.path
where o.path is null or o.size <> n.size or o.seconds <> n.seconds
union all
select p.snapshot_no, o.workspace_id, o.path, 'removed' from one o join pairs p on p.workspace_id = o.workspace_id and p.prev = o.snapshot_no
left join one n on n.workspace_id = o.workspace_id and n.snapshot_no = p.snapshot_no and n.path = o.path where n.path is null
""",
    "p5_found": "select workspace, keyword from posting_rows where workspace is not null and keyword is not null group by all having count(*) >= 0.01 * (select count(*) from posting_rows)",
    "p5_key_statistics": f"""
with {_PAIRS}, ids as (select workspace, keyword, doc_id, count(*) as times from posted where doc_id <> '' group by all),
files as (select workspace_id as workspace, doc_id, count(*) as entries from source_files group by all)
select c.workspace, c.keyword, c.n_rows, c.sum_doccount, count(i.doc_id) as n_files, count(f.entries) as n_files_present,
  coalesce(sum(i.times), 0)::bigint as n_postings, coalesce(sum(i.times * f.entries), 0)::bigint as n_entries
from counts c left join ids i using (workspace, keyword) left join files f on f.workspace = i.workspace and f.doc_id = i.doc_id
group by all
""",
    "p6_found": """
with runs as (select run_id, started_time, row_number() over (order by started_time, run_id) as v from sync_runs where status = 'success'),
feed as (select *, (select min(v) from runs where started_time >= arrived_time) as v from doc_feed),
state as (
  select r.v, r.run_id, f.* exclude (v) from runs r join feed f on f.v <= r.v
  qualify row_number() over (partition by r.v, workspace_id, doc_id order by last_sync_time desc, hash desc nulls last, size desc nulls last, modified_time desc nulls last, arrived_time desc, feed_id desc) = 1
)
select n.run_id, n.workspace_id, n.doc_id from state n left join state o on o.v = n.v - 1 and o.workspace_id = n.workspace_id and o.doc_id = n.doc_id
where o.doc_id is null or case when nullif(o.hash, '') is null or nullif(n.hash, '') is null
  then o.modified_time is distinct from n.modified_time or o.size is distinct from n.size else o.hash <> n.hash end
""",
}

SQL["p6_incremental"] = SQL["p6_found"]
