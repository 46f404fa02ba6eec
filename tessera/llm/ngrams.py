"""Frequency of every distinct term or run of terms (suffix-sorted n-gram counting).

Every position of a record's term list gives one suffix, truncated to ``sigma`` terms.  Suffixes are combined
in the map task, routed by their first term and a salt, sorted in reverse
lexicographic order, and one pass with a stack of ``sigma`` frames then yields the counts of every prefix: a
prefix is complete as soon as the sorted stream leaves it.

Record sets.  A record marks, for each of its suffixes, the shortest prefix length it shows for the first
time; only those lengths add to the record count.  A frame therefore holds the size of its record set as a
number, exactly, however many records share the term: nothing grows with the hottest term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
COMBINE_ROWS = 200_000


def _suffixes(terms: list[list[str]], weight: int, sigma: int) -> Iterator[tuple[tuple[str, ...], int, int]]:
    """(suffix, weight, length of the longest prefix the record has shown before) of one record's sequences."""
    seen: set[tuple[str, ...]] = set()
    for seq in terms:
        for i in range(len(seq)):
            suffix = tuple(seq[i : i + sigma])
            known = 0
            for k in range(1, len(suffix) + 1):
                if suffix[:k] in seen:
                    known = k
                else:
                    seen.add(suffix[:k])
            yield suffix, weight, known


def _emit(sigma: int):
    """Records to combined suffixes: first, rest, cf (summed weight), df (records for which each length is new)."""

    def combine(tables: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(tables)
        names = [f"d{k}" for k in range(1, sigma + 1)]
        g = t.group_by(["first", *(f"r{k}" for k in range(1, sigma))], use_threads=False).aggregate([(c, "sum") for c in ["cf", *names]])
        g = g.rename_columns([c.removesuffix("_sum") for c in g.column_names]).combine_chunks()
        rest = [g[f"r{k}"].combine_chunks() for k in range(1, sigma)]
        if rest:
            stacked = [x.to_pylist() for x in rest]
            rest_col = pa.array([[x for x in row if x is not None] for row in zip(*stacked)], pa.list_(pa.string()))
        else:
            rest_col = pa.array([[]] * len(g), pa.list_(pa.string()))
        counts = np.stack([g[c].to_numpy() for c in names], 1) if len(g) else np.zeros((0, sigma), np.int64)
        df = pa.ListArray.from_arrays(pa.array(np.arange(len(g) + 1, dtype=np.int32) * sigma), pa.array(counts.ravel().astype(np.int64)))
        return pa.record_batch([g["first"].combine_chunks(), rest_col, g["cf"].combine_chunks().cast(pa.int64()), df], ["first", "rest", "cf", "df"])

    def one(batch: pa.RecordBatch) -> pa.Table:
        """sigma 1: a term is new for the record where it occurs there first; all in arrow and numpy."""
        seqs, weight = batch.column(0), batch.column(1)
        inner = seqs.flatten()
        rec_of_seq = np.repeat(np.arange(len(seqs)), np.diff(seqs.offsets.to_numpy()))
        terms = inner.flatten()
        rec = np.repeat(rec_of_seq, np.diff(inner.offsets.to_numpy()))
        codes = terms.dictionary_encode()
        key = rec.astype(np.int64) * max(1, len(codes.dictionary)) + codes.indices.to_numpy()
        new = np.zeros(len(key), np.int64)
        new[np.unique(key, return_index=True)[1]] = 1
        w = weight.to_numpy(zero_copy_only=False)[rec]
        return pa.table({"first": terms, "cf": pa.array(w, pa.int64()), "d1": pa.array(new)})

    def many(batch: pa.RecordBatch) -> pa.Table:
        rows = [x for terms, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in _suffixes(terms, w, sigma)]
        cols: dict = {"first": pa.array([s[0] for s, _, _ in rows], pa.string())}
        for k in range(1, sigma):
            cols[f"r{k}"] = pa.array([s[k] if len(s) > k else None for s, _, _ in rows], pa.string())
        cols["cf"] = pa.array([w for _, w, _ in rows], pa.int64())
        for k in range(1, sigma + 1):
            cols[f"d{k}"] = pa.array([int(known < k <= len(s)) for s, _, known in rows], pa.int64())
        return pa.table(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            t = one(batch) if sigma == 1 else many(batch)
            if not t.num_rows:
                continue
            held.append(t)
            rows += t.num_rows
            if rows >= COMBINE_ROWS:
                yield combine(held)
                held, rows = [], 0
        if rows:
            yield combine(held)

    return run


def _stack(sigma: int):
    """Sorted suffixes to the counts of all their prefixes; the open frames carry over from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames: list[list] = []  # [term, cf, df], one per open prefix length

        def close(depth: int, out: list[tuple[list[str], int, int]]) -> None:
            while len(frames) > depth:
                term, cf, df = frames.pop()
                if frames:
                    frames[-1][1] += cf  # all occurrences of a prefix are those of its continuations and its own
                out.append(([f[0] for f in frames] + [term], cf, df))

        def batch_of(out):
            return pa.record_batch(
                [pa.array([x[0] for x in out], pa.list_(pa.string())), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())],
                ["ngram", "cf", "df"],
            )

        for batch in batches:
            out: list[tuple[list[str], int, int]] = []
            for first, rest, cf, df in zip(*(batch.column(k).to_pylist() for k in range(4))):
                suffix = [first, *rest]
                same = 0
                while same < len(frames) and same < len(suffix) and frames[same][0] == suffix[same]:
                    same += 1
                close(same, out)
                frames += [[term, 0, 0] for term in suffix[same:]]
                frames[-1][1] += cf
                for k, n in enumerate(df[: len(suffix)]):
                    frames[k][2] += n
            if out:
                yield batch_of(out)
        out = []
        close(0, out)
        if out:
            yield batch_of(out)

    return run


def ngram_frequencies(records: DataFrame, terms: str | Column, sigma: int = 1, weight: str | Column | None = None) -> DataFrame:
    """``ngram`` array<string>, ``cf`` (summed weight of all occurrences), ``df`` (records that hold it), for lengths 1 to sigma.

    One row is one record; ``terms`` is array<array<string>>, the record's term sequences (an n-gram does not
    cross from one to the next).  Null and empty terms and null sequences are left out before suffixes are
    formed; a record without terms adds nothing; a null weight counts as 0.  An empty table gives an empty one.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    w = F.lit(1) if weight is None else F.coalesce(col(weight), F.lit(0))
    seqs = F.transform(F.filter(col(terms), lambda s: s.isNotNull()), lambda s: F.filter(s, lambda x: x.isNotNull() & (x != "")))
    rows = records.select(seqs.alias("terms"), w.cast("long").alias("weight")).where("terms is not null")
    suffixes = rows.mapInArrow(_emit(sigma), "first string, rest array<string>, cf bigint, df array<bigint>")
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A hot first term is spread: by its second term or, where there is none, by the map task it comes from.
    salt = F.spark_partition_id() if sigma == 1 else F.xxhash64(F.get("rest", F.lit(0)))
    routed = suffixes.withColumn("salt", F.pmod(salt, F.lit(SALTS))).repartition(n, "first", "salt").drop("salt")
    ordered = routed.sortWithinPartitions(F.desc("first"), F.desc("rest"))
    counted = ordered.mapInArrow(_stack(sigma), "ngram array<string>, cf bigint, df bigint")
    return counted.groupBy("ngram").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def marked(counts: DataFrame, value: str, rare: float, common: float) -> DataFrame:
    """Adds ``mark``: rare where the value is at most ``rare``, common where it is above ``common``, else null (also for a null value)."""
    return counts.withColumn("mark", F.when(F.col(value) <= rare, "rare").when(F.col(value) > common, "common"))


def latest_records(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Of each key's rows those with its greatest time (null counts as the least), equal rows once."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("_top", F.max(time).over(w)).where(F.col(time).eqNullSafe(F.col("_top"))).drop("_top")
