"""Filling containers of several permitted capacities: variable-capacity best-fit.

Sizes are whole numbers of at most the largest capacity, so everything that decides a packing is the histogram
of sizes: at most as many rows as the largest capacity has tokens, however many items there are.  Best-fit
decreasing runs on the histogram in the driver, a run of equal items and equal bins at a time, and yields
runs "items of this size with these ranks go to these bins".  Every item finds its own rank among the items of
its size (partition offsets plus a local row number) and from it its bin, in the executors.

Where no open bin fits, the bin of least cost is opened; several rules for that are tried on the histogram and
the cheapest packing is kept; finally every bin is downsized to the least capacity that holds its contents.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.common import plain, written


@dataclass
class Packing:
    """Runs of items: size, first rank, bins from, items to a bin.  Runs of bins: first bin, how many, capacity, used."""

    items: np.ndarray
    bins: np.ndarray
    cost: float


def pack_histogram(histogram: dict[int, int], capacities: list[int], cost: Callable[[int], float], opener: Callable[[int], int]) -> Packing:
    """Best-fit decreasing over counts of sizes; ``opener`` gives the capacity to open for a size."""
    open_bins: dict[int, list[tuple[int, int, int]]] = {}  # room left to (first bin, how many, capacity)
    rooms: list[int] = []  # sorted
    items: list[tuple[int, int, int, int]] = []
    next_bin = 0

    def put(room: int, run: tuple[int, int, int]) -> None:
        if run[1]:
            if room not in open_bins:
                bisect.insort(rooms, room)
                open_bins[room] = []
            open_bins[room].append(run)

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                first, many, cap = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                cap = room = opener(size)
                first, many = next_bin, -(-left // (cap // size))
                next_bin += many
            fit = room // size
            full = min(many, left // fit)
            if full:
                items.append((size, rank, first, fit))
                rank, left = rank + full * fit, left - full * fit
                put(room - fit * size, (first, full, cap))
            if full < many:
                if left:
                    items.append((size, rank, first + full, left))
                    put(room - left * size, (first + full, 1, cap))
                    rank, left, full = rank + left, 0, full + 1
                put(room, (first + full, many - full, cap))
    bins = []
    for room, runs in open_bins.items():
        for first, many, cap in runs:
            used = cap - room
            bins.append((first, many, capacities[bisect.bisect_left(capacities, used)], used))
    bins.sort()
    return Packing(np.array(items, np.int64).reshape(-1, 4), np.array(bins, np.int64).reshape(-1, 4), sum(m * cost(c) for _, m, c, _ in bins))


def best_packing(histogram: dict[int, int], capacities: list[int], cost: Callable[[int], float] = float) -> Packing:
    """The cheapest of the packings by these opening rules: least cost per token if filled with the size, each capacity where it fits (else the next), the smallest that fits."""
    caps = sorted(set(capacities))
    fits = lambda size: [c for c in caps if c >= size]
    rules: list[Callable[[int], int]] = [lambda s: min(fits(s), key=lambda c: (cost(c) / (c // s * s), -c)), lambda s: fits(s)[0]]
    rules += [lambda s, floor=c: max(floor, fits(s)[0]) for c in caps]
    return min((pack_histogram(histogram, caps, cost, r) for r in rules), key=lambda p: p.cost)


def _assign(p: Packing):
    order = np.lexsort((p.items[:, 1], p.items[:, 0]))
    items, bins = p.items[order], p.bins
    step = np.int64(1) << np.int64(42)
    starts = items[:, 0] * step + items[:, 1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            at = np.searchsorted(starts, b["n_tokens"].to_numpy() * step + b["rank"].to_numpy(), side="right") - 1
            run_ = items[at]
            number = run_[:, 2] + (b["rank"].to_numpy() - run_[:, 1]) // run_[:, 3]
            box = bins[np.searchsorted(bins[:, 0], number, side="right") - 1]
            yield plain(b[["id", "piece", "token_start"]].assign(n_tokens=np.where(b["empty"], 0, b["n_tokens"]), bin=number, capacity=box[:, 2]))

    return run


def pack(items: DataFrame, id_col: str, tokens_col: str, capacities: list[int], cost: Callable[[int], float] = float) -> DataFrame:
    """``id_col``, ``piece``, ``token_start``, ``n_tokens``, ``bin``, ``capacity``: each item, or piece of one, in its bin.

    Only an item larger than the largest capacity is split, into pieces of that capacity and a last, shorter one.
    A null or zero size takes one token's room, and its ``n_tokens`` is 0.  ``cost`` of a capacity is its tokens unless given.  Repeated ids
    are items of their own.  An empty table gives an empty one.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    most = max(capacities)
    size = F.greatest(F.coalesce(F.col(tokens_col), F.lit(0)).cast("long"), F.lit(1))
    empty = F.coalesce(F.col(tokens_col), F.lit(0)) <= 0
    split = items.select(F.col(id_col).alias("id"), size.alias("size"), empty.alias("empty"))
    split = split.select("id", "size", "empty", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / most).cast("int") - 1)).alias("piece"))
    start = F.col("piece").cast("long") * most
    pieces = split.select("id", "piece", "empty", start.alias("token_start"), F.least(F.lit(most).cast("long"), F.col("size") - start).alias("n_tokens"), F.spark_partition_id().alias("part"))
    pieces = written(pieces, "pieces")
    by_part = pieces.groupBy("n_tokens", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = written(by_part.withColumn("before", before), "offsets")
    histogram = {r[0]: r[1] for r in offsets.groupBy("n_tokens").agg(F.sum("n")).collect()}  # at most `most` rows
    packing = best_packing(histogram, capacities, cost)
    local = F.row_number().over(Window.partitionBy("part", "n_tokens").orderBy("id", "piece")) - 1
    ranked = pieces.withColumn("local", local).join(offsets.drop("n"), ["n_tokens", "part"]).withColumn("rank", F.col("before") + F.col("local"))
    kind = items.schema[id_col].dataType.simpleString()
    out = ranked.select("id", "piece", "empty", "token_start", "n_tokens", "rank").mapInPandas(_assign(packing), f"id {kind}, piece int, token_start bigint, n_tokens bigint, bin bigint, capacity bigint")
    return out.withColumnRenamed("id", id_col)
