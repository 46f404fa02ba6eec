"""What changed between consecutive full snapshots of a table.

Keys are brought into the order of their hashes, and each group's order is cut into chunks where the hash's leading
bits change.  A chunk is thus defined by the content of its keys alone: an inserted row moves no boundary, a hot
group is cut into as many even chunks as it needs, and no row has to move to find its chunk.  Each listing is reduced
to one digest a chunk, by sums that are combined in the map tasks.  Digests of consecutive listings are compared,
matching chunks are discarded, and only the rows of unmatched chunks are read again, joined by key and classified.

The digests of a listing can be kept: for the next delivery only the new listing is digested, and of the old ones
only the rows of unmatched chunks are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.common import written

CHUNK = 4  # rows of one listing in a chunk, at most, on average; one change makes the rows of its chunk be read
_SUMS = ["_c", "_s1", "_s2", "_s3", "_s4"]


def _base(rows: DataFrame, snapshot: str, group: str, key: str, compared: list[str], latest: str) -> DataFrame:
    values = [F.col(c).cast("long").alias(f"_v{k}") for k, c in enumerate(compared)]
    base = rows.select(F.col(snapshot).cast("long").alias("_n"), F.col(group).cast("string").alias("_g"), F.col(key).cast("string").alias("_k"), F.col(latest).cast("long").alias("_t"), *values)
    return base.where("_n is not null and _g is not null and _k is not null")


def _listings(base: DataFrame, kept: DataFrame | None) -> DataFrame:
    """A row for each listing of a group: ``_n``, the listings before and after, ``_bits`` of its chunks, and whether it is new."""
    counted = base.groupBy("_g", "_n").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_known", F.lit(None).cast("int"))
    if kept is not None:
        old = kept.groupBy("_g", "_n").agg(F.sum("_c").alias("_rows"), F.max("_bits").alias("_known"))
        counted = counted.join(old, ["_g", "_n"], "left_anti").unionByName(old)
    group, order = Window.partitionBy("_g"), Window.partitionBy("_g").orderBy("_n")
    fit = F.greatest(F.lit(0), F.ceil(F.log2(F.max("_rows").over(group) / F.lit(CHUNK)))).cast("int")
    bits = F.coalesce(F.max("_known").over(group), fit)
    cols = {"_bits": bits, "_new": F.col("_known").isNull(), "_p": F.lag("_n").over(order), "_f": F.lead("_n").over(order)}
    return counted.withColumns(cols).withColumn("_f_new", F.lead("_new").over(order)).drop("_rows", "_known")


def _chunked(base: DataFrame, listings: DataFrame) -> DataFrame:
    at = F.expr("case when _bits = 0 then 0 else shiftrightunsigned(_o, 64 - _bits) end")
    return base.withColumn("_o", F.xxhash64(F.lit(5), "_k")).join(listings, ["_g", "_n"]).withColumn("_chunk", at)


def _digests(base: DataFrame, listings: DataFrame) -> DataFrame:
    low = 0xFFFFFFFF
    values = [c for c in base.columns if c.startswith("_v")]
    h = [F.col("_k"), *(F.coalesce(F.col(v).cast("string"), F.lit("-")) for v in values)]
    rows = _chunked(base, listings.where("_new")).withColumns({"_h1": F.xxhash64(*h), "_h2": F.xxhash64(F.lit(17), *reversed(h)), "_h3": F.xxhash64(F.lit(29), "_k")})
    return rows.groupBy("_g", "_n", "_bits", "_chunk").agg(
        F.count(F.lit(1)).alias("_c"),
        F.sum(F.col("_h1").bitwiseAND(low)).alias("_s1"), F.sum(F.shiftrightunsigned("_h1", 32)).alias("_s2"), F.sum(F.col("_h2").bitwiseAND(low)).alias("_s3"), F.sum(F.shiftrightunsigned("_h2", 32)).alias("_s4"),
        F.bit_or(F.expr("shiftleft(1L, cast(_h3 & 63 as int))")).alias("_m1"), F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(_h3, 32) & 63 as int))")).alias("_m2"),
    )


def chunk_digests(rows: DataFrame, snapshot: str, group: str, key: str, compared: list[str], latest: str, kept: DataFrame | None = None) -> DataFrame:
    """The digests of the listings in ``rows``, a table to keep for :func:`diff_snapshots`; with ``kept`` only of listings it lacks."""
    base = _base(rows, snapshot, group, key, compared, latest)
    return _digests(base, written(_listings(base, kept), "listings"))


def diff_snapshots(rows: DataFrame, snapshot: str, group: str, key: str, compared: list[str], latest: str, kept: DataFrame | None = None) -> DataFrame:
    """``snapshot``, ``group``, ``key``, ``change_kind`` (added, removed, changed) against the group's last earlier snapshot.

    ``snapshot`` is an integer, ``compared`` numeric columns (a null on either side is no difference), ``latest`` the
    column by which, of a key that stands more than once in a snapshot, the last row holds (null is least; ties:
    the greatest compared values).  Rows with a null snapshot, group or key belong to no listing and are left out.
    A group's first snapshot and one in which it has no rows give nothing; an empty table gives an empty one.

    ``kept`` are digests from :func:`chunk_digests` of earlier listings: then changes are given only where one of
    the two listings is not among them.  A listing must be whole when it is digested.

    A chunk counts as matched if the 128 bits of its hashes' sums agree and no key stands in it twice (two keys that
    share their bit in both masks count as one, which costs a reading, never a change).
    """
    base = _base(rows, snapshot, group, key, compared, latest)
    listings = written(_listings(base, kept), "listings")
    digests = _digests(base, listings)
    if kept is not None:
        digests = digests.unionByName(kept.select(digests.columns))
    twice = (F.bit_count("_m1") < F.col("_c")) & (F.bit_count("_m2") < F.col("_c"))
    around = digests.select("_g", "_n", "_chunk", *_SUMS, twice.cast("int").alias("_twice")).join(listings.select("_g", "_n", "_p", "_f", "_new", "_f_new"), ["_g", "_n"])
    now = F.when(F.col("_p").isNotNull(), F.struct(F.col("_n").alias("_at"), F.lit(1).alias("_side"), F.col("_new").alias("_do")))
    ahead = F.when(F.col("_f").isNotNull(), F.struct(F.col("_f").alias("_at"), F.lit(-1).alias("_side"), (F.col("_f_new") | F.col("_new")).alias("_do")))
    sides = F.explode(F.array_compact(F.array(now, ahead))).alias("_x")
    sums = [F.sum(F.col("_x._side") * F.col(c)).alias(c) for c in _SUMS]
    met = around.select("_g", "_chunk", "_twice", *_SUMS, sides).groupBy("_g", F.col("_x._at").alias("_at"), "_chunk").agg(*sums, F.max("_twice").alias("_twice"), F.max("_x._do").alias("_do"))
    differ = " or ".join(f"{c} <> 0" for c in [*_SUMS, "_twice"])
    unmatched = written(met.where(f"_do and ({differ})").select("_g", "_at", "_chunk"), "unmatched")

    names = [c for c in base.columns if c.startswith("_v")]
    again = _chunked(base, listings).select("_g", "_k", "_t", *names, "_chunk", sides)
    again = again.select("_g", "_k", "_t", *names, "_chunk", F.col("_x._at").alias("_at"), F.col("_x._side").alias("_side")).join(unmatched, ["_g", "_at", "_chunk"], "left_semi")
    last = F.struct(F.coalesce("_t", F.lit(-(2**63))), *names)
    both = again.groupBy("_g", "_at", "_chunk", "_k").agg(F.max(F.when(F.col("_side") == 1, last)).alias("_a"), F.max(F.when(F.col("_side") == -1, last)).alias("_b"))
    changed = F.lit(False)
    for name in names:
        changed = changed | F.coalesce(F.col(f"_a.{name}") != F.col(f"_b.{name}"), F.lit(False))
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(changed, "changed")
    out = both.select(F.col("_at").cast(rows.schema[snapshot].dataType).alias(snapshot), F.col("_g").alias(group), F.col("_k").alias(key), kind.alias("change_kind"))
    return out.where("change_kind is not null")


def plain_path(path) -> "F.Column":
    """A relative path in its plain spelling: forward slashes, no empty or ``.`` parts."""
    p = F.regexp_replace(F.trim(path), r"[\\/]+", "/")
    return F.regexp_replace(F.regexp_replace(p, r"(?<=^|/)(?:\./)+", ""), r"^/|/$", "")
