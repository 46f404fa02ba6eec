"""Packings, mixtures and token counts."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, tokens


def check(spark, sizes, caps, cost=float):
    df = spark.createDataFrame([(k, s, 0, "clash") for k, s in enumerate(sizes)], "doc long, t long, n_tokens int, part string").repartition(3)
    rows = packing.pack(df, "doc", "t", caps, cost).collect()
    used, cap, parts = defaultdict(int), {}, defaultdict(list)
    for r in rows:
        used[r["bin"]] += r["n_tokens"]
        assert cap.setdefault(r["bin"], r["capacity"]) == r["capacity"] and r["capacity"] in caps
        parts[r["doc"]].append((r["piece"], r["token_start"], r["n_tokens"]))
    assert all(used[b] <= cap[b] for b in used)
    assert all(min((c for c in caps if c >= used[b]), default=0) == cap[b] for b in used)  # downsized
    for k, s in enumerate(sizes):
        s, most = s or 0, max(caps)
        assert sorted(parts[k]) == [(p, p * most, min(most, s - p * most)) for p in range(max(1, -(-s // most)))]
    return sum(used.values()) / sum(cap.values()) if cap else 1.0


def test_pack(spark):
    r = random.Random(2)
    sizes = [r.choice([7, 7, 7, r.randint(1, 60), r.randint(1, 300)]) for _ in range(600)] + [None, 0, 256, 257, 5000]
    assert check(spark, sizes, [256]) > 0.98
    assert check(spark, sizes, [64, 256, 1024]) > 0.99
    assert check(spark, [5] * 40, [16]) == pytest.approx(200 / 224)
    assert check(spark, [], [16]) == 1.0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], "doc long, t long"), "doc", "t", [])


def test_costs_choose_bins(spark):
    # large bins cost more than in proportion, so small items go to small bins
    p = packing.best_packing({4: 10}, [4, 64], lambda c: c**2)
    assert set(p.bins[:, 2]) == {4} and p.bins[:, 1].sum() == 10
    p = packing.best_packing({4: 16}, [4, 64], lambda c: c + 10)
    assert set(p.bins[:, 2]) == {64} and p.bins[:, 1].sum() == 1


def test_best_fit_quality():
    r = random.Random(4)
    h = {s: r.randint(1, 400) for s in r.sample(range(1, 1000), 300)}
    p = packing.best_packing(h, [1000])
    total = sum(s * n for s, n in h.items())
    assert p.bins[:, 1].sum() <= total / 1000 * 1.02 + 1
    assert sum(int(x[3]) for x in p.items) >= len(h)


def test_rake_meets_sources_and_caps():
    r = np.random.default_rng(0)
    n, axes = 60, [np.arange(60) % 4, np.arange(60) % 5, np.arange(60) % 3]
    have, caps = r.integers(100, 1000, n).astype(float), np.array([1.0, 2, 3, 4])[np.arange(60) % 4]
    share = np.array([0.1, 0.2, 0.3, 0.4])
    total = min(np.bincount(axes[0], have * caps) / share) * 0.7
    own = np.bincount(axes[1], have)
    want = mixing.rake(have, axes, [total * share, total * own / own.sum(), total * np.ones(3) / 3], caps)
    assert np.allclose(np.bincount(axes[0], want), total * share, rtol=1e-5) and (want <= have * caps + 1e-6).all()
    assert np.allclose(np.bincount(axes[2], want), total / 3, rtol=0.05)


def test_mix(spark):
    r = random.Random(1)
    rows = [(k, r.choice(["big"] * 6 + ["mid", "mid", "small", "none", None]), r.choice(["en", "de", None]), "t", r.choice([0, r.randint(1, 400), 90])) for k in range(3000)] + [(9999, "big", "en", "t", None)]
    docs = spark.createDataFrame([(*x, 1, 2.0) for x in rows], "id long, source string, language string, topic string, tokens long, cap int, weight double")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, targets, "id").cache()
    assert all(abs(x["actual_share"] - x["target_share"]) < 0.002 for x in mixing.shares(mixed, targets).collect())
    caps = {"big": 1, "mid": 2, "small": 4}
    got = mixed.collect()
    assert all(1 <= x["repeats"] <= caps[x["source"]] for x in got) and len({x["id"] for x in got}) == len(got)
    again = mixing.mix(docs, targets, "id").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    less = mixing.mix(docs, targets, "id", total_tokens=20000)
    assert less.agg(F.sum(F.col("tokens") * F.col("repeats"))).first()[0] == pytest.approx(20000, rel=0.01)
    assert mixing.mix(docs.limit(0), targets, "id").collect() == []


def test_marginal_shares(spark):
    rows = [(1, "a", "en", 10, 2), (2, "a", "de", 20, 1), (3, "b", None, 60, 1)]
    mixed = spark.createDataFrame(rows, "id long, source string, language string, tokens long, repeats int")
    got = {(r["marginal"], r["value"]): (r["target_share"], r["actual_share"]) for r in mixing.marginal_shares(mixed, {"source": {"a": 1.0, "c": 3.0}, "language": {"en": 1.0}}).collect()}
    assert got == {("source", "a"): (0.25, 0.4), ("source", "b"): (0.0, 0.6), ("source", "c"): (0.75, 0.0), ("language", "en"): (1.0, 0.2), ("language", "de"): (0.0, 0.2), ("language", None): (0.0, 0.6)}


def test_names(spark):
    df = spark.createDataFrame([(" Repo-Mirror", "EN"), ("wiki", "en-XX"), (None, None), ("A b", "x?")], "s string, l string")
    got = df.select(mixing.plain_name(F.col("s")), mixing.plain_language(F.col("l"))).collect()
    assert [tuple(x) for x in got] == [("repo_mirror", "en"), ("wiki", "en"), (None, "und"), ("a_b", "und")]


@pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="needs the public vocabulary files")
def test_token_counts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.TOKENIZER)
    texts = ["hello world", "", None, "é\n\tx" * 50, "a" * 200_000, "<|endoftext|>"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "id long, text string").withColumn("tokens", F.lit("clash"))
    got = {r["id"]: r["tokens"] for r in tokens.with_token_counts(df, "text", ["id"]).collect()}
    t.encode_special_tokens = True
    assert got == {k: len(t.encode(x or "", add_special_tokens=False)) for k, x in enumerate(texts)}
