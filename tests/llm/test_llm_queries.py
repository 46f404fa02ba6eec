"""The registered queries of the training-data problems on the smallest tables: SQL where there is any, else their own rules."""

from pathlib import Path

import pytest

from tests import oracle
from tessera.llm import pii, queries

pytestmark = pytest.mark.skipif(not oracle.DATA.exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    oracle.same(spark, queries.QUERIES[name], queries.SQL[name])


def test_file_kinds(spark):
    rows = queries.p4_file_classes(spark, str(oracle.DATA)).collect()
    found = {r["doc_id"] for r in queries.p4_found(spark, str(oracle.DATA)).collect()}
    assert found == {r["doc_id"] for r in rows if r["kind"]} and 0 < len(found) < len(rows)
    assert len(rows) == spark.read.parquet(f"{oracle.DATA}/documents.parquet").where("file_id is not null").count()


def test_containers(spark):
    rows = queries.p7_fill_rates(spark, str(oracle.DATA)).collect()
    assert {r["plan"] for r in rows} >= {"context", "joint"} and len({sum(x["tokens"] for x in rows if x["plan"] == p) for p in {r["plan"] for r in rows}}) == 1
    assert all(0 < r["fill_rate"] <= 1 for r in rows)


def test_mixture(spark):
    rows = queries.p8_shares(spark, str(oracle.DATA)).collect()
    caps = {r["source"]: r["max_repeats"] for r in spark.read.parquet(f"{oracle.DATA}/mix_targets.parquet").collect()}
    assert len(rows) == len(caps) and all(r["most_repeats"] is None or r["most_repeats"] <= caps[r["source"]] for r in rows)


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="needs the test tables")
def test_fill_and_marginals(spark):
    """At sf0.1 containers are full to 0.9995 in each plan (0.998 where cost, not room, decides), and the shares of all three marginals are within 0.005."""
    sf = "/root/testdata/sf0.1"
    assert all(r["fill_rate"] >= 0.9995 for r in queries.p7_fill_rates(spark, sf).collect())
    rows = queries.p7_least_cost(spark, sf).collect()
    assert len(rows) > 1 and sum(r["tokens"] for r in rows) / sum(r["bins"] * r["capacity"] for r in rows) >= 0.998
    cost, tokens = (sum(r[k] for r in rows) for k in ("cost", "tokens"))
    assert cost < 0.6 * tokens * (1 + 16384 / 8192)  # against the one capacity that holds all items whole, filled to the brim
    rows = queries.p8_marginals(spark, sf).collect()
    assert {r["marginal"] for r in rows} == {"source", "language", "topic"} and all(abs(r["actual_share"] - r["target_share"]) < 0.005 for r in rows)


def test_personal_information(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{oracle.DATA}/documents.parquet").collect()}
    found = queries.p9_found(spark, str(oracle.DATA)).collect()
    assert len(found) == len(set(found)) > 0 and all(r["pii_text"] in docs[r["doc_id"]] and r["pii_type"] in pii.PLACEHOLDER for r in found)
    for r in queries.p9_redacted(spark, str(oracle.DATA)).collect():
        assert r["n_replaced"] > 0 or r["text"] == docs[r["doc_id"]]
