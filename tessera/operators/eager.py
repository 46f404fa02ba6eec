"""Per-key results when a few keys hold most rows: eager aggregation through joins.

Both inputs of a join are aggregated by the join key (and the groups wanted) before they meet, so what is
shuffled and joined are compact states, one per key and group, however many rows a hot key has.  Joined states
combine algebraically: the joined rows of a pair of states are the product of their counts, a sum from one side
is its sum times the other side's count.  A last aggregation rolls the states up to the groups.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _state(df: DataFrame, keys: list[str], groups: list[str], sums: dict[str, Column], side: str) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias(f"_{side}n"), *(F.sum(c).alias(f"_{side}s{k}") for k, c in enumerate(sums.values()))]
    return df.groupBy(*keys, *groups).agg(*aggs)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    groups: list[str],
    left_sums: dict[str, Column] | None = None,
    right_sums: dict[str, Column] | None = None,
    how: str = "inner",
) -> DataFrame:
    """``left.join(right, on, how).groupBy(groups)`` with n (joined rows), the sums, and the states that met.

    ``groups`` are columns of ``left`` (they may include columns of ``on``).  Result: the groups, ``n``, one
    column per sum, ``left_keys`` (different values of ``on`` without nulls in the group) and ``matched_keys``
    (those with a partner).  ``how`` is inner or left; with left a key without a partner counts its own rows once and gives
    nothing to right sums.  Null keys have no partner.  Other columns, whatever their names, are ignored.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    ls, rs = left_sums or {}, right_sums or {}
    more = [g for g in groups if g not in on]
    a = _state(left, on, more, ls, "l")
    b = _state(right, on, [], rs, "r").withColumnsRenamed({c: f"_on{k}" for k, c in enumerate(on)})
    cond = [F.col(c) == F.col(f"_on{k}") for k, c in enumerate(on)]
    j = a.join(b, cond, how)
    other = F.coalesce("_rn", F.lit(1))
    return j.groupBy(*groups).agg(
        F.sum(F.col("_ln") * other).alias("n"),
        *(F.sum(F.col(f"_ls{k}") * other).alias(name) for k, name in enumerate(ls)),
        *(F.sum(F.col(f"_rs{k}") * F.col("_ln")).alias(name) for k, name in enumerate(rs)),
        F.count(F.when(reduce(and_, [F.col(c).isNotNull() for c in on]), 1)).alias("left_keys"),
        F.count("_rn").alias("matched_keys"),
    )


def parse_posting_key(rows: DataFrame, key: str = "row_key") -> DataFrame:
    """Adds ``workspace``, ``keyword``, ``doccount`` and ``tick`` as encoded in ``kw:workspace|keyword|doccount|tick``.

    All four are null where the key is null, has other than four parts, lacks ``kw:`` or a number is none.
    Columns of these names are replaced.
    """
    parts = F.split(F.substring(F.col(key), 4, 2**31 - 1), r"\|")
    number = lambda k: F.when(parts[k].rlike("^[0-9]+$"), parts[k].try_cast("bigint"))
    good = F.col(key).startswith("kw:") & (F.size(parts) == 4) & number(2).isNotNull() & number(3).isNotNull()
    pick = lambda x: F.when(good, x)
    return rows.withColumns({"workspace": pick(parts[0]), "keyword": pick(parts[1]), "doccount": pick(number(2)), "tick": pick(number(3))})


def posting_key_statistics(postings: DataFrame, files: DataFrame) -> DataFrame:
    """Per (workspace, keyword) of ``row_key``: ``n_rows``, ``sum_doccount``, ``n_files``, ``n_files_present``, ``n_postings``, ``n_entries``.

    One eager join gives them all.  Its left rows are the file ids of the posting rows, of which the first of a row
    carries the row itself and its doccount (a row without ids has one left row, whose file is null); its right rows
    are the files with the number of their index entries.  ``n_files`` counts the different ids in ``docids``,
    ``n_files_present`` those of them that ``files`` (workspace_id, doc_id) still has, ``n_postings`` the ids posted
    by all rows (a repeated id of one row once), ``n_entries`` the pairs of a posted id and an index entry of its
    file: the sum over files of the product of both counts.  Rows count as they lie; those whose key is malformed
    belong to no pair.  Null or empty ``docids`` add no file; repeated ids and rows count once as a file.
    """
    rows = parse_posting_key(postings.select("row_key", "docids")).where("workspace is not null and keyword is not null")
    ids = F.array_distinct(F.filter(F.split("docids", r"\|"), lambda x: x != ""))
    posted = rows.select("workspace", "keyword", "doccount", F.posexplode_outer(ids).alias("pos", "doc_id"))
    first = F.coalesce("pos", F.lit(0)) == 0
    left = posted.select("workspace", "keyword", "doc_id", F.when(first, 1).otherwise(0).alias("row"), F.when(first, F.col("doccount")).alias("doccount"), F.when(F.col("pos").isNotNull(), 1).otherwise(0).alias("id"))
    known = files.where("doc_id is not null").groupBy(F.col("workspace_id").alias("workspace"), "doc_id").agg(F.count(F.lit(1)).alias("entries"))
    sums = {"n_rows": F.col("row"), "sum_doccount": F.col("doccount"), "n_postings": F.col("id")}
    met = eager_join_aggregate(left, known, ["workspace", "doc_id"], ["workspace", "keyword"], sums, {"n_entries": F.col("entries")}, "left")
    return met.select(
        "workspace", "keyword", "n_rows", "sum_doccount", F.col("left_keys").alias("n_files"), F.col("matched_keys").alias("n_files_present"), "n_postings", F.coalesce("n_entries", F.lit(0)).alias("n_entries")
    )
