"""The most frequent values among very many: three-phase threshold top-k.

Nodes are the input's own partitions.  Each sorts its values (Spark's external sort, which spills) and counts
runs, so a node's local counts need the memory of one batch, however many distinct values there are.

1. Every node sends its k leaders; the k-th largest partial sum is a lower bound on the k-th true count.
2. Every node sends the values whose local count reaches its share of the bound (bound / nodes).  No value
   with a smaller count everywhere can reach the bound; sums and what was not sent bound each count from above.
3. The exact counts of the values that may still reach the raised bound are fetched and ranked.

Only counts of candidates travel; values below every node's share never leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.common import written


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, item) to (node, item, n)."""
    last, count, node = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        items = batch.column(1)
        node = batch.column(0)[0].as_py()
        codes = items.dictionary_encode()
        idx = codes.indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, idx[1:] != idx[:-1]])
        sizes = np.diff(np.r_[starts, len(idx)]).astype(np.int64)
        names = codes.dictionary.take(pa.array(idx[starts])).to_pylist()
        if last is not None and names[0] == last:
            sizes[0] += count
        elif last is not None:
            names.insert(0, last)
            sizes = np.r_[count, sizes]
        last, count = names.pop(), int(sizes[-1])
        if names:
            yield pa.record_batch([pa.array([node] * len(names), pa.int32()), pa.array(names, pa.string()), pa.array(sizes[:-1])], ["node", "item", "n"])
    if last is not None:
        yield pa.record_batch([pa.array([node], pa.int32()), pa.array([last], pa.string()), pa.array([count], pa.int64())], ["node", "item", "n"])


def local_counts(rows: DataFrame, item: Column) -> DataFrame:
    """``node``, ``item``, ``n``: each input partition's counts of its non-null values, without a shuffle."""
    items = rows.select(F.spark_partition_id().alias("node"), item.cast("string").alias("item")).where("item is not null")
    return items.sortWithinPartitions("item").mapInArrow(_runs, "node int, item string, n bigint")


def frequent_items(rows: DataFrame, item: Column, k: int, min_share: float = 0.0, total: int | None = None) -> DataFrame:
    """``item``, ``n`` (exact), ``share`` of ``total`` (by default of all non-null values), ``low`` and ``high`` (its bounds before phase 3): the k most frequent.

    With ``min_share`` only values with at least that share are returned and the bound starts there.  Ties at
    the k-th place are broken by the value.  Fewer than k distinct values: all of them.  Nulls are no values;
    an empty table gives an empty result.
    """
    counts = written(local_counts(rows, item), "local-counts")
    values, nodes = counts.agg(F.sum("n"), F.count_distinct("node")).first()
    total, nodes = (values or 0) if total is None else total, max(1, nodes or 0)
    least = int(np.ceil(min_share * total))
    # Phase 1: local leaders; the k-th partial sum.  At most k rows come to the driver.
    best = Window.partitionBy("node").orderBy(F.desc("n"), "item")
    leaders = counts.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    sums = leaders.groupBy("item").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "item").limit(k).agg(F.count("*"), F.min("n")).first()
    bound = max(sums[1] if sums[0] == k else 1, least, 1)
    # Phase 2: all local counts of at least the bound's share.
    share = -(-bound // nodes)
    sent = counts.where(F.col("n") >= share).groupBy("item").agg(F.sum("n").alias("low"), F.count("*").alias("from"))
    sent = written(sent.withColumn("high", F.col("low") + (F.lit(nodes) - F.col("from")) * (share - 1)).drop("from"), "candidates")
    again = sent.orderBy(F.desc("low"), "item").limit(k).agg(F.count("*"), F.min("low")).first()
    bound = max(bound, again[1] if again[0] == k else 0)
    # Phase 3: exact counts of what can still reach the bound.
    left = sent.where(F.col("high") >= bound)
    exact = counts.join(left, "item").groupBy("item").agg(F.sum("n").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"))
    return (
        exact.where(F.col("n") >= least).orderBy(F.desc("n"), "item").limit(k)
        .select("item", "n", (F.col("n") / F.lit(max(total, 1))).alias("share"), "low", "high")
    )
