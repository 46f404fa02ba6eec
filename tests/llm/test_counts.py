"""n-gram counting and the most frequent items, against plain counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import frequent, ngrams


def grams(seq, sigma):
    return [tuple(seq[i : i + n]) for n in range(1, sigma + 1) for i in range(len(seq) - n + 1)]


@pytest.mark.parametrize("sigma", [1, 2, 3])
def test_ngrams(spark, sigma):
    r = random.Random(sigma)
    vocab = ["hot"] * 8 + [f"w{k}" for k in range(12)] + ["", None, "é", "hot hot"]
    rows = [([[r.choice(vocab) for _ in range(r.randint(0, 9))] for _ in range(r.randint(0, 3))] + [None] * (r.random() < 0.1), r.choice([1, 2, None])) for _ in range(200)]
    rows += [(None, 1), ([["long"] * 5000], 1)] + [rows[0]] * 3
    cf, df = Counter(), Counter()
    for seqs, w in rows:
        seen = set()
        for seq in seqs or []:
            got = grams([x for x in seq or [] if x], sigma)
            for g in got:
                cf[g] += w or 0
            seen |= set(got)
        df.update(seen)
    table = spark.createDataFrame(rows, "t array<array<string>>, w long").withColumns({"first": F.lit("clash"), "cf": F.lit(0), "terms": F.lit(1)})
    got = ngrams.ngram_frequencies(table, "t", sigma, "w").collect()
    assert len(got) == len(df)
    assert {tuple(x["ngram"]): (x["cf"], x["df"]) for x in got} == {g: (cf[g], df[g]) for g in df}
    assert ngrams.ngram_frequencies(table.limit(0), "t", sigma).collect() == []


def test_stack_over_batches():
    """The open frames carry over when a run of equal prefixes spans Arrow batches."""
    import pyarrow as pa

    rows = [("b", ["c"], 1, [1, 1]), ("b", ["c"], 2, [0, 1]), ("b", ["a"], 1, [1, 1]), ("b", [], 4, [1, 0]), ("a", [], 1, [1, 0])]
    batch = lambda part: pa.record_batch([pa.array([x[k] for x in part], t) for k, t in enumerate((pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64())))], ["first", "rest", "cf", "df"])
    want = {("b", "c"): (3, 2), ("b", "a"): (1, 1), ("b",): (8, 3), ("a",): (1, 1)}
    for size in (1, 2, 5):
        out = {}
        for b in ngrams._stack(2)(iter([batch(rows[k : k + size]) for k in range(0, len(rows), size)])):
            for g, c, d in zip(*(b.column(k).to_pylist() for k in range(3))):
                assert tuple(g) not in out
                out[tuple(g)] = (c, d)
        assert out == want


def test_latest_records(spark):
    rows = [("1", "a", 5, ["x"]), ("1", "a", 5, ["y"]), ("1", "a", 4, ["z"]), ("1", "b", None, ["n"]), ("2", "a", None, ["p"]), ("2", "a", 1, ["q"])]
    df = spark.createDataFrame(rows, "w string, d string, t long, words array<string>")
    assert sorted((r["w"], r["d"], r["words"][0]) for r in ngrams.latest_records(df, ["w", "d"], "t").collect()) == [("1", "a", "x"), ("1", "a", "y"), ("1", "b", "n"), ("2", "a", "q")]


@pytest.mark.parametrize("parts", [1, 7])
def test_frequent(spark, parts):
    r = random.Random(parts)
    items = ["hot"] * 400 + [f"m{k % 9}" for k in range(300)] + [f"rare{k}" for k in range(700)] + [None] * 50 + ["tie1"] * 20 + ["tie2"] * 20 + [""] * 5
    r.shuffle(items)
    count = Counter(x for x in items if x is not None)
    df = spark.createDataFrame([(x, 0, "clash") for x in items], "v string, n int, item string").repartition(parts)
    order = sorted(count, key=lambda x: (-count[x], x))
    for k in (1, 3, 11, 12, 50):
        got = frequent.frequent_items(df, F.col("v"), k).collect()
        assert {x["item"]: x["n"] for x in got} == {x: count[x] for x in order[:k]}
        assert all(x["low"] <= x["n"] <= x["high"] for x in got)
    assert {x["item"] for x in frequent.frequent_items(df, F.col("v"), 100, min_share=0.02).collect()} == {x for x in count if count[x] >= 0.02 * sum(count.values())}
    assert {x["item"] for x in frequent.frequent_items(df, F.col("v"), 5, min_share=0.1, total=4001).collect()} == set()
    assert frequent.frequent_items(df.where("v = 'hot'"), F.col("v"), 5).count() == 1
    assert frequent.frequent_items(df.limit(0), F.col("v"), 5).collect() == []


def test_frequent_skewed_over_nodes(spark):
    """A value that leads nowhere can still be the most frequent of all."""
    rows = [(n, x) for n in range(6) for x in ["spread"] * 9 + [f"local{n}"] * 10 + [f"x{n}{k}" for k in range(30)]]
    df = spark.createDataFrame(rows, "node int, v string").repartitionByRange(6, "node")
    got = frequent.frequent_items(df, F.col("v"), 1).collect()
    assert [(x["item"], x["n"]) for x in got] == [("spread", 54)]
