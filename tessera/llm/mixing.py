"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

The corpus is reduced to a table of tokens by source, language and topic.  Its weights are raked until the
source shares are the targets and the language and topic shares keep those asked for (by default the corpus's
own), with no weight above its source's cap of repeats.  A document's weight is its expected number of copies:
the whole part is certain, the fraction is drawn.  Draws are calibrated: documents of a cell are ordered by
their random number over their probability (sequential Poisson sampling) and taken until the cell's tokens
are reached, so that all three marginals come out, also where single documents are very long; among the some EDGE documents around that point those that no longer fit are passed over, so the
shares come out to within about the smallest of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.common import plain, written

MAX_CELLS, EDGE = 200_000, 200


def rake(available: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray], caps: np.ndarray, tolerance: float = 1e-7, rounds: int = 20_000) -> np.ndarray:
    """Tokens wanted of each cell.  ``axes`` give each cell's code in a marginal, ``targets`` the marginals' tokens.

    Rounds go on until no cell changes by more than the tolerance (or, where targets contradict each other, for so many).
    The first marginal (sources) is met exactly where the caps allow it at all; the others as nearly as they then can be.
    """
    want, most = available.astype(float).copy(), available * caps
    for _ in range(rounds):
        last = want
        for axis, target in reversed(list(zip(axes, targets))):
            sums = np.bincount(axis, want, len(target))
            want = np.minimum(want * np.where(sums > 0, target / np.maximum(sums, 1e-300), 0)[axis], most)
        if np.all(np.abs(want - last) <= tolerance * np.maximum(want, 1)):
            break
    axis, target = axes[0], targets[0]
    for _ in range(rounds):  # what caps cut off goes to the source's other cells
        gap = target - np.bincount(axis, want, len(target))
        free = np.where(want < most, np.maximum(want, 1e-9 * available), 0)
        room = np.bincount(axis, free, len(target))
        if np.all((gap <= 1e-6 * np.maximum(target, 1)) | (room <= 0)):
            break
        want = np.minimum(want + free * np.where(room > 0, np.maximum(gap, 0) / np.maximum(room, 1e-300), 0)[axis], most)
    return want


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """A source's documents around its cells' edges: in each cell, in order of z, those that still fit; then in what the source lacks."""
    pdf = pdf.sort_values(["z", "id"]).reset_index(drop=True)
    tokens, extra, short = pdf["tokens"].to_numpy(), np.zeros(len(pdf), np.int32), 0.0
    for rows in pdf.groupby("cell", sort=True).indices.values():
        lack = float(pdf["lack"].iloc[rows[0]])
        for k in rows:
            if tokens[k] <= lack:
                extra[k], lack = 1, lack - tokens[k]
        short += lack
    for k in np.flatnonzero(extra == 0):
        if tokens[k] <= short:
            extra[k], short = 1, short - tokens[k]
    return plain(pdf.assign(extra=extra)[["source", "id", "language", "topic", "tokens", "whole", "extra"]])


def plain_name(c: Column) -> Column:
    """A label in its plain spelling: trimmed, lower case, ``_`` between words."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def plain_language(c: Column) -> Column:
    """The primary subtag of a language tag, ``und`` where there is none."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(F.trim(c), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1)), F.lit("")), F.lit("und"))


def mix(docs: DataFrame, targets: DataFrame, id_col: str, total_tokens: int | None = None, language_shares: dict | None = None, topic_shares: dict | None = None, seed: int = 1) -> DataFrame:
    """``id_col``, ``source``, ``language``, ``topic``, ``tokens``, ``repeats`` (at least 1): the drawn documents.

    ``docs`` has id, source, language, topic (plain spellings) and tokens; ``targets`` source, target_share,
    max_repeats.  Without ``total_tokens`` the mixture is the largest that meets all shares within the caps.
    Documents of other or null sources, and without tokens, are not drawn.  A target source without documents
    makes the shares unreachable: the others then keep their proportions.  Repeated ids are drawn each for itself.
    """
    rows = written(docs.where("tokens > 0").select(F.col(id_col).alias("id"), "source", F.coalesce("language", F.lit("und")).alias("language"), F.coalesce("topic", F.lit("")).alias("topic"), "tokens")
                   .join(targets.select("source").distinct(), "source", "left_semi"), "mix-documents")
    cells = rows.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("tokens")).orderBy("source", "language", "topic").limit(MAX_CELLS + 1).collect()
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} combinations of source, language and topic")
    goal = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.collect()}
    names = [sorted({c[k] for c in cells}) for k in range(3)]
    axes = [np.array([names[k].index(c[k]) for c in cells], np.int64) for k in range(3)]
    available = np.array([c["tokens"] for c in cells], float)
    share = np.array([goal[s][0] for s in names[0]], float)
    repeats = np.array([goal[s][1] for s in names[0]], float)
    share = share / share.sum() if len(share) else share
    have = np.bincount(axes[0], available, len(share)) if cells else np.zeros(0)
    most = float(np.min(have * repeats / np.where(share > 0, share, np.nan))) if cells and (share > 0).any() else 0.0
    total = min(float(total_tokens), most) if total_tokens else most

    def marginal(k: int, asked: dict | None) -> np.ndarray:
        own = np.bincount(axes[k], available, len(names[k]))
        got = np.array([asked.get(n, 0.0) for n in names[k]], float) if asked else own
        return total * got / max(got.sum(), 1e-300)

    want = rake(available, axes, [total * share, marginal(1, language_shares), marginal(2, topic_shares)], repeats[axes[0]]) if cells else available
    spark = docs.sparkSession
    weights = spark.createDataFrame(
        [(c["source"], c["language"], c["topic"], k, float(w / a), float(w), int(goal[c["source"]][1])) for k, (c, w, a) in enumerate(zip(cells, want, available))],
        "source string, language string, topic string, cell int, weight double, goal double, cap int",
    )
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("id").cast("string")), F.lit(2**52)) + 0.5) / F.lit(float(2**52))
    d = rows.join(weights, ["source", "language", "topic"]).withColumn("whole", F.least(F.floor("weight"), F.col("cap")).cast("int"))
    d = d.withColumn("part", F.when(F.col("whole") < F.col("cap"), F.col("weight") - F.col("whole")).otherwise(0.0))
    base = ["cell", "source", "id", "language", "topic", "tokens", "whole"]
    d = written(d.select(*base, F.when(F.col("part") > 1e-9, u / F.col("part")).alias("z")), "mix-draws")
    many = d.groupBy("cell").agg(F.count("z").alias("n"))
    d = d.join(many, "cell").withColumn("b", F.floor(F.col("z") * F.greatest(F.col("n") / EDGE, F.lit(1.0)))).drop("n")
    # What a cell still lacks after the certain copies; its documents in order of z until that is reached.
    certain = d.groupBy("cell").agg(F.sum(F.col("tokens") * F.col("whole")).alias("certain"))
    sums = d.where("b is not null").groupBy("cell", "b").agg(F.sum("tokens").alias("t"))
    run = Window.partitionBy("cell").orderBy("b")
    edge = sums.withColumn("upto", F.sum("t").over(run)).join(weights.select("cell", "goal"), "cell").join(certain, "cell")
    edge = edge.withColumn("after", F.col("goal") - F.col("certain") - F.col("upto")).where("after < 0").groupBy("cell").agg(F.min(F.struct("b", (F.col("after") + F.col("t")).alias("lack"))).alias("e"))
    drawn = d.join(edge.select("cell", F.col("e.b").alias("edge"), F.col("e.lack").alias("lack")), "cell", "left")
    near = F.col("b").between(F.col("edge"), F.col("edge") + 3)
    kind = docs.schema[id_col].dataType.simpleString()
    at_edge = drawn.where(near).select(*base, "z", "lack").groupBy("source").applyInPandas(_fill, f"source string, id {kind}, language string, topic string, tokens bigint, whole int, extra int")
    others = drawn.where(F.coalesce(~near, F.lit(True))).select("source", "id", "language", "topic", "tokens", "whole", F.coalesce((F.col("b") < F.col("edge")) | F.col("edge").isNull() & F.col("b").isNotNull(), F.lit(False)).cast("int").alias("extra"))
    out = at_edge.unionByName(others).withColumn("repeats", F.col("whole") + F.col("extra")).where("repeats > 0")
    return out.select(F.col("id").alias(id_col), "source", "language", "topic", "tokens", "repeats")


def marginal_shares(mixed: DataFrame, asked: dict[str, dict[str, float]]) -> DataFrame:
    """``marginal``, ``value``, ``target_share``, ``actual_share``, ``tokens`` of a mixture, for each marginal (a column) with targets.

    Targets are scaled to sum to 1; a value of the mixture without a target has the target 0, one that was not drawn the share 0.
    """
    spark, out = mixed.sparkSession, None
    for name, shares_ in asked.items():
        total = sum(shares_.values()) or 1.0
        want = spark.createDataFrame([(k, v / total) for k, v in shares_.items()], "value string, target_share double")
        got = mixed.groupBy(F.col(name).alias("value")).agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
        one = want.join(got, "value", "full").select(F.lit(name).alias("marginal"), "value", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
        out = one if out is None else out.unionByName(one)
    per = Window.partitionBy("marginal")
    return out.select("marginal", "value", "target_share", (F.col("tokens") / F.greatest(F.sum("tokens").over(per), F.lit(1))).alias("actual_share"), "tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source``, ``target_share``, ``actual_share``, ``tokens``, ``documents``, ``draws``, ``most_repeats`` of a mixture."""
    by = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("repeats").alias("draws"), F.max("repeats").alias("most_repeats"))
    by = written(by, "mix-shares")
    total = by.agg(F.sum("tokens")).first()[0] or 0
    return targets.select("source", "target_share").join(by, "source", "left").select(
        "source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.lit(float(max(total, 1)))).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("draws", F.lit(0)).alias("draws"), "most_repeats",
    )
