"""Snapshot diffs, eager aggregation, versioned tables, catalogue and streams, against plain models."""

import random
import uuid
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.engine import ContentRequest
from tessera.operators import eager, index, snapshots, versions
from tessera.plans.settings import Filters, Settings
from tessera.service import Service
from tessera.sources import corpus, sync
from tessera.sources.catalog import Catalog, CatalogError
from tessera.streaming.ingest import SCHEMA, BucketedIndex, file_changes, index_stream

SNAP = "n int, g string, k string, size long, t long, _g string, _n int, change_kind string"


def snapshot_model(rows):
    best = {}
    for n, g, k, size, t, *_ in rows:
        if None in (n, g, k):
            continue
        rank = (-(2**63) if t is None else t, -1 if size is None else size)
        if (n, g, k) not in best or rank > best[n, g, k][0]:
            best[n, g, k] = (rank, size, t)
    out = set()
    for g in {x[1] for x in best}:
        there = sorted({x[0] for x in best if x[1] == g})
        for a, b in zip(there, there[1:]):
            old = {x[2]: v for x, v in best.items() if x[:2] == (a, g)}
            new = {x[2]: v for x, v in best.items() if x[:2] == (b, g)}
            out |= {(b, g, k, "added") for k in new.keys() - old.keys()} | {(b, g, k, "removed") for k in old.keys() - new.keys()}
            for k in new.keys() & old.keys():
                if any(x is not None and y is not None and x != y for x, y in zip(old[k][1:], new[k][1:])):
                    out.add((b, g, k, "changed"))
    return out


def test_snapshot_diff(spark):
    r = random.Random(3)
    rows = []
    for n in (1, 2, 4, 5):
        for g, many in (("hot", 900), ("b", 40), ("c", 5)):
            if (n, g) in ((2, "b"), (5, "c")):
                continue
            for k in range(many):
                if r.random() < 0.95:
                    one = (n, g, f"k{k}", None if r.random() < 0.02 else k if r.random() < 0.97 else k + n, None if r.random() < 0.02 else 7 if r.random() < 0.97 else n)
                    rows += [one] * (3 if r.random() < 0.05 else 1)
                    if r.random() < 0.05:
                        rows.append((n, g, f"k{k}", 1000 + k, 9))
    rows += [(None, "b", "k1", 1, 1), (1, None, "k1", 1, 1), (1, "b", None, 1, 1), (1, "alone", "k", 1, 1)]
    df = spark.createDataFrame([(*x, "clash", 0, "clash") for x in rows], SNAP)
    got = [tuple(x) for x in snapshots.diff_snapshots(df, "n", "g", "k", ["size", "t"], "t").collect()]
    assert len(got) == len(set(got)) and set(got) == snapshot_model(rows)
    assert snapshots.diff_snapshots(df.limit(0), "n", "g", "k", ["size"], "t").collect() == []
    how = ("n", "g", "k", ["size", "t"], "t")
    kept = snapshots.chunk_digests(df.where("n <= 2"), *how)
    later = snapshots.chunk_digests(df.where("n <= 4"), *how, kept=kept)
    assert {r["_n"] for r in later.collect()} == {4}
    got = {tuple(x) for x in snapshots.diff_snapshots(df, *how, kept=kept.unionByName(later)).collect()}
    assert got == {x for x in snapshot_model(rows) if x[0] == 5}


def test_snapshot_repeats_with_equal_values(spark):
    """The same rows in another order of ``latest`` hold another state."""
    rows = [(1, "g", "k", 1, 5), (1, "g", "k", 2, 6), (2, "g", "k", 1, 6), (2, "g", "k", 2, 5)]
    df = spark.createDataFrame(rows, "n int, g string, k string, size long, t long")
    assert [tuple(x) for x in snapshots.diff_snapshots(df, "n", "g", "k", ["size"], "t").collect()] == [(2, "g", "k", "changed")]


def test_plain_path(spark):
    df = spark.createDataFrame([("./a//b\\c.go",), ("a/./b",), ("./././x",), (" a/b ",), ("a.b/.c",), (None,)], "p string")
    assert [r[0] for r in df.select(snapshots.plain_path(F.col("p"))).collect()] == ["a/b/c.go", "a/b", "x", "a/b", "a.b/.c", None]


def test_eager_join_aggregate(spark):
    r = random.Random(1)
    left = [(r.choice([1, 1, 1, 2, 3, None]), r.choice("xy"), r.choice([1, 5, None])) for _ in range(300)]
    right = [(r.choice([1, 1, 2, 9, None]), r.randint(0, 4)) for _ in range(60)]
    a = spark.createDataFrame(left, "k int, g string, v int").withColumn("_on0", F.lit("clash"))
    b = spark.createDataFrame(right, "k int, w int").withColumn("g", F.lit("clash"))
    for how in ("inner", "left"):
        got = {x["g"]: x for x in eager.eager_join_aggregate(a, b, ["k"], ["g"], {"sv": F.col("v")}, {"sw": F.col("w")}, how).collect()}
        want = {x["g"]: x for x in a.select("k", "g", "v").join(b.select("k", "w"), "k", how).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sv"), F.sum("w").alias("sw")).collect()}
        assert {g: (x["n"], x["sv"], x["sw"]) for g, x in got.items()} == {g: (x["n"], x["sv"], x["sw"]) for g, x in want.items()}
    assert eager.eager_join_aggregate(a.limit(0), b, ["k"], ["g"]).collect() == []
    with pytest.raises(ValueError):
        eager.eager_join_aggregate(a, b, ["k"], ["g"], how="full")


def test_posting_statistics(spark):
    keys = ["kw:1|a|2|10", "kw:1|a|2|10", "kw:1|a|x2|11", "kw:1|a", "ws:3|1", None, "kw:2|b|1|5", "kw:1|a|3|12", "kw:|c|1|1"]
    docs = ["f1|f2|f1", "f1|f2|f1", "f9", None, None, "f1", None, "f3", ""]
    p = spark.createDataFrame(list(zip(keys, docs)), "row_key string, docids string").withColumn("keyword", F.lit("stale"))
    f = spark.createDataFrame([("1", "f1"), ("1", "f1"), ("2", "f2"), (None, None)], "workspace_id string, doc_id string")
    got = {(r["workspace"], r["keyword"]): tuple(r)[2:] for r in eager.posting_key_statistics(p, f).collect()}
    assert got == {("1", "a"): (3, 7, 3, 1, 5, 4), ("2", "b"): (1, 1, 0, 0, 0, 0), ("", "c"): (1, 1, 0, 0, 0, 0)}
    big = spark.createDataFrame([("kw:1|a|1|9223372036854775807", None), ("kw:1|a|1|9223372036854775808", None)], "row_key string, docids string")
    assert [r["n_rows"] for r in eager.posting_key_statistics(big, f).collect()] == [1]
    assert "Join" in eager.posting_key_statistics(p, f).select("n_rows")._jdf.queryExecution().optimizedPlan().toString()


FEED = "ws string, doc string, sync long, hash string, size long, arrived int, _file string, _v int"
DIFFERS = versions.Differs("hash", ["size"])


def feed_rows(seed, n=400):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        hot = r.random() < 0.33
        doc = "hot" if hot else f"d{r.randint(0, 30)}"
        sync = r.randint(1, 60)
        h = f"{doc}{sync // 3}"
        out += [("1", doc, sync, r.choice([h, h, h, None, ""]), sync // 2, r.choice([0, 1, 2, 3, 4, None]), "clash", 0)] * r.choice([1, 1, 2])
    return out + [(None, "x", 1, "h", 1, 0, "clash", 0), ("1", None, 1, "h", 1, 0, "clash", 0)]


def feed_model(rows, last):
    prev, out = {}, set()
    for v in range(1, last + 1):
        state = {}
        for ws, doc, sync, h, size, arrived, *_ in rows:
            if ws is None or doc is None or arrived is None or arrived >= v:
                continue
            rank = (sync, h is not None, h or "", size)
            if (ws, doc) not in state or rank > state[ws, doc][0]:
                state[ws, doc] = (rank, h, size)
        for key, s in state.items():
            if key not in prev:
                out.add((v, *key, "new"))
            else:
                o = prev[key]
                if (o[1] != s[1]) if (o[1] and s[1]) else (o[2] != s[2]):
                    out.add((v, *key, "changed"))
        prev = state
    return out


def table_of(spark, rows, path):
    df = spark.createDataFrame(rows, FEED)
    t = versions.VersionedTable(spark, path)
    t.load_upserts(df, (F.col("arrived") + 1).cast("long"), ["ws", "doc"], ["sync"], ["hash", "size"])
    return t


@pytest.mark.parametrize("seed", [1, 2])
def test_version_deltas(spark, tmp_path, seed):
    rows = feed_rows(seed)
    t = table_of(spark, rows, f"file://{tmp_path}/t")
    assert t.versions() == [1, 2, 3, 4, 5]
    got = [tuple(r) for r in t.changes(0, 5, ["ws", "doc"], DIFFERS).collect()]
    assert len(got) == len(set(got)) and set(got) == feed_model(rows, 5)
    assert {tuple(r) for r in t.changes(2, 3, ["ws", "doc"], DIFFERS).collect()} == {x for x in feed_model(rows, 5) if x[0] == 3}
    with pytest.raises(FileExistsError):
        t._commit(versions.Manifest(3))


def load_into(spark, t, rows):
    t.load_upserts(spark.createDataFrame(rows, FEED), (F.col("arrived") + 1).cast("long"), ["ws", "doc"], ["sync"], ["hash", "size"])


@pytest.mark.parametrize("seed", [5, 6])
def test_later_loads_and_retries(spark, tmp_path, seed):
    rows = feed_rows(seed, 200)
    want = feed_model(rows, 5)
    t = versions.VersionedTable(spark, f"file://{tmp_path}/t")
    load_into(spark, t, [r for r in rows if r[5] is not None and r[5] < 2])
    assert t.versions() == [1, 2]
    commit, t._commit = t._commit, lambda m: commit(m) if m.version < 4 else exec("raise OSError('crash')")
    with pytest.raises(OSError):  # data and vectors are written, version 3 is committed, the others are not
        load_into(spark, t, [r for r in rows if r[5] is None or r[5] >= 2])
    del t._commit
    assert t.versions() == [1, 2, 3]
    load_into(spark, t, rows)  # again, with the rows of all versions
    load_into(spark, t, rows)
    assert t.versions() == [1, 2, 3, 4, 5]
    got = [tuple(r) for r in t.changes(0, 5, ["ws", "doc"], DIFFERS).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(r) for r in t.changes(3, 5, ["ws", "doc"], DIFFERS).collect()} == {x for x in want if x[0] > 3}
    best = {}
    for ws, doc, sync, h, size, arrived, *_ in rows:
        if ws is not None and doc is not None and arrived is not None:
            best[ws, doc] = max(best.get((ws, doc), ()), (sync, h is not None, h or "", size))
    assert sorted((r["ws"], r["doc"], r["sync"], r["hash"] or "") for r in t.live(5).collect()) == sorted((*k, b[0], b[2]) for k, b in best.items())


def test_removed_and_rewritten_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [("1", f"d{k}", 1, f"h{k}", 1, 0, "", 0) for k in range(4)] + [("1", "d0", 2, "h0+", 1, 1, "", 0), ("1", "d4", 2, "h4", 1, 1, "", 0)]
    t = table_of(spark, rows, f"file://{path}")
    cols = ["ws", "doc", "sync", "hash", "size"]
    live = {"d1": "h1", "d2": "h2+", "d3": "h3"}  # version 3 rewrites what is live of version 1: one record changed, d0 was deleted in version 2
    new = spark.createDataFrame([("1", d, 3, h, 1) for d, h in live.items()], "ws string, doc string, sync long, hash string, size long").coalesce(1)
    folder = t.manifest(1).added[0].rsplit("/_v=", 1)[0]
    new.write.parquet(f"file://{path}/{folder}/_v=3")
    added = [f"{folder}/_v=3/{n}" for n in t.store.names(f"{folder}/_v=3") if n.endswith(".parquet")]
    t._commit(versions.Manifest(3, added, t.manifest(1).added))
    t._commit(versions.Manifest(4, [], t.manifest(2).added))  # removes d0 and d4
    got = sorted((r["_version"], r["_change"], r["doc"], r["hash"]) for r in t.deltas(2, 4).select("_version", "_change", *cols).collect())
    assert got == [(3, -1, "d1", "h1"), (3, -1, "d2", "h2"), (3, -1, "d3", "h3"), (3, 1, "d1", "h1"), (3, 1, "d2", "h2+"), (3, 1, "d3", "h3"), (4, -1, "d0", "h0+"), (4, -1, "d4", "h4")]
    assert [tuple(r) for r in t.changes(2, 4, ["ws", "doc"], DIFFERS).collect()] == [(3, "1", "d2", "changed")]
    assert len(t.deltas(3, 4).collect()) == 2 and t.changes(3, 4, ["ws", "doc"], DIFFERS).collect() == []
    whole = [(r["_version"], r["_change"], r["doc"]) for r in t.deltas(0, 4).collect()]
    assert len(whole) == len(set(whole)) and sum(c for _, c, _ in whole) == 3 and (2, -1, "d0") in whole and (3, -1, "d0") not in whole


def test_empty_feed(spark, tmp_path):
    assert table_of(spark, [], f"file://{tmp_path}/t").versions() == []


def test_consumer_survives_failures(spark, tmp_path):
    rows = feed_rows(4, 120)
    t = table_of(spark, rows, f"file://{tmp_path}/t")
    sink = versions.DeltaSink(spark, f"file://{tmp_path}/out")
    assert sink.processed() == 0
    # a run that writes its data and dies before the commit
    t.changes(0, 1, ["ws", "doc"], DIFFERS).write.parquet(f"{tmp_path}/out/data/000000000001-dead")
    assert versions.process_new(t, sink, ["ws", "doc"], DIFFERS, "a") == [1, 2, 3, 4, 5]
    assert versions.process_new(t, sink, ["ws", "doc"], DIFFERS, "b") == [] and sink.processed() == 5
    assert not sink.append(t.changes(0, 1, ["ws", "doc"], DIFFERS), 1, "again")
    assert sorted(tuple(r) for r in sink.read().collect()) == sorted(feed_model(rows, 5))


def test_versions_of_runs(spark):
    t = lambda day, h: datetime(2025, 3, day, h)
    runs = versions.versions_of_runs(spark.createDataFrame([(7, t(4, 12)), (3, t(4, 8)), (5, t(4, 12)), (9, t(9, 1)), (1, None)], "run_id long, started timestamp"), "started")
    assert {r["run_id"]: r["_version"] for r in runs.collect()} == {3: 1, 5: 2, 7: 3, 9: 4}
    at = {t(1, 0): 1, t(4, 8): 1, t(4, 9): 2, t(4, 12): 2, t(4, 13): 4, t(6, 5): 4, t(9, 1): 4, t(9, 2): None, t(12, 1): None, None: None}
    rows = spark.createDataFrame([(x, "clash") for x in at], "arrived timestamp, run_id string")
    assert {r["arrived"]: r["_v"] for r in versions.with_version(rows, "arrived", runs, "started").collect()} == at
    none = versions.with_version(rows, "arrived", runs.limit(0), "started").collect()
    assert len(none) == len(at) and {r["_v"] for r in none} == {None}
    many = spark.range(3000).select((F.col("id") + 1).alias("run_id"), F.timestamp_seconds(F.col("id") * 3600).alias("started"))
    got = versions.with_version(spark.range(2999).select(F.timestamp_seconds(F.col("id") * 3600 + 1).alias("a"), "id"), "a", versions.versions_of_runs(many, "started"), "started")
    assert got.where("_v is null or _v <> id + 2").count() == 0


def test_one_of_two_writers_commits(spark, tmp_path):
    store = versions.Store(spark, f"file://{tmp_path}/s")
    with ThreadPoolExecutor(8) as pool:
        for k in range(5):
            assert sum(pool.map(lambda n: store.put_new(f"m/{k}.json", str(n)), range(8))) == 1
    (tmp_path / "s/m/x.tmp").write_text("x")
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):  # as other file systems do it
        store._name_new(store._p("m/x.tmp"), store._p("m/0.json"), link=False)
    store._name_new(store._p("m/x.tmp"), store._p("m/5.json"), link=False)
    (tmp_path / "s/m/5.json").unlink()
    for p in (tmp_path / "s/m").glob(".*crc"):
        p.unlink()
    assert store.names("m") == sorted(n for n in store.names("m") if n.endswith(".json")) and len(store.names("m")) == 5


def test_load_consume_load_remove_consume_with_crashes(spark, tmp_path):
    """Each commit dies once before it is made; neither a gap nor a repeat follows."""
    rows = feed_rows(8, 150)
    want = feed_model(rows, 5)
    t, sink = versions.VersionedTable(spark, f"file://{tmp_path}/t"), versions.DeltaSink(spark, f"file://{tmp_path}/out")

    def dying(store, act):
        put = store.put_new
        store.put_new = lambda *a: exec("raise OSError('crash')")
        with pytest.raises(OSError):
            act()
        store.put_new = put
        act()

    keys = ["ws", "doc"]
    consume = lambda: versions.process_new(t, sink, keys, DIFFERS, uuid.uuid4().hex, each=False)
    dying(t.store, lambda: load_into(spark, t, [r for r in rows if r[5] is not None and r[5] < 2]))
    dying(sink.store, consume)
    dying(t.store, lambda: load_into(spark, t, rows))
    dying(sink.store, consume)
    gone = t.manifest(1).added
    t._commit(versions.Manifest(6, [], gone))  # the files of version 1 are removed: nothing new or changed
    dying(sink.store, consume)
    assert sink.processed() == 6 and consume() == []
    got = [tuple(r) for r in sink.read().collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    assert c.list().count() == 0
    ids = [c.create(f"/w{k}")["id"] for k in range(11)]
    assert ids == [str(k) for k in range(1, 12)] and [r["id"] for r in c.list().collect()] == ids
    for bad in ("relative", "/w3"):
        with pytest.raises(CatalogError):
            c.create(bad)
    c.update("/w1/", Filters(["*.go"], False, []), False)
    assert c.filters("/w1", Settings()).include == ["*.go"] and c.filters("/w1", Settings()).customized == Settings().filters.customized
    assert c.synced("/w2", 7)["total_files"] == 7
    c.delete("/w10")
    assert c.create("/w12")["id"] == "12"
    with pytest.raises(CatalogError):
        c.get("/w10")


def test_stream_and_replayed_epochs(spark, tmp_path):
    target = BucketedIndex(spark, f"file://{tmp_path}/index", 4)
    schema = SCHEMA.replace(", words array<string>", "") + ", op string, seq bigint"
    row = lambda d, body, op, seq: (d, f"{d}.txt", len(body), "h", 1, body, op, seq)
    one = spark.createDataFrame([row("a", "hello world", None, 1), row("a", "hello again", "upsert", 2), row("b", "gone soon", "upsert", 1), row("c", "stays here", "upsert", 1)], schema)
    one.write.parquet(f"{tmp_path}/in")
    go = lambda: index_stream(file_changes(spark, f"{tmp_path}/in", schema), target, f"{tmp_path}/cp").awaitTermination()
    go()
    spark.createDataFrame([row("b", "", "delete", 2)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    go()
    assert {r["doc_id"]: r["words"] for r in target.documents().collect()} == {"a": ["again", "hello"], "c": ["here", "stays"]}
    assert {r["keyword"] for r in target.postings().collect()} == {"again", "hello", "here", "stays"}
    v = target.version()
    assert target.apply(one, 0) == v  # an epoch that was applied before
    assert target.apply(one.limit(0)) == v + 1


def test_sync_and_removal(spark, tmp_path):
    root = tmp_path / "w"
    bodies = {"a.go": "func alpha", "b.go": "func beta", "sub/_c.go": "func gamma"}
    for name, body in bodies.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    c, t, s = Catalog(spark, f"file://{tmp_path}/c"), BucketedIndex(spark, f"file://{tmp_path}/i", 2), Settings()
    assert c.ensure(str(root))["id"] == c.ensure(f"{root}/")["id"] == "1"
    held = lambda: {r["rel_path"]: r["content"] for r in t.documents().collect()}
    assert sync.sync_if_needed(c, t, str(root), s)["total_files"] == 3 and held() == bodies
    (root / "a.go").write_text("func changed")
    (root / "b.go").unlink()
    (root / "d.go").write_text("func delta")
    assert sync.sync_if_needed(c, t, str(root), s)["total_files"] == 3 and held() == bodies  # synced before
    assert sync.sync(c, t, str(root), s)["total_files"] == 3
    assert held() == {"a.go": "func changed", "sub/_c.go": "func gamma", "d.go": "func delta"}
    version = t.version()
    assert sync.sync(c, t, str(root), s)["total_files"] == 3 and t.version() == version  # nothing to do
    assert sync.remove_file(c, t, str(root), "d.go")["total_files"] == 2 and "d.go" not in held()
    assert sync.remove_file(c, t, str(root), "d.go")["total_files"] == 2
    sync.delete_workspace(c, t, str(root))
    assert held() == {} and t.postings().count() == 0 and c.list().count() == 0
    keys = spark.createDataFrame([("kw:1|a",), ("kw:1|b",), ("kw:2|a",), (None,)], "k string")
    assert {r[0] for r in corpus.prefix_delete(keys, "k", "kw:1|").collect()} == {"kw:2|a", None}


def test_service(spark, tmp_path):
    root = tmp_path / "w"
    root.mkdir()
    (root / "a.go").write_text("func alpha\nfunc scanner")
    (root / "b.go").write_text("func beta scanner")
    s, w = Service(spark, f"file://{tmp_path}/svc", buckets=2), str(root)
    assert s.health()["code"] == 0 and s.list_workspaces()["workspaces"] == [] and s.sync_all()["code"] == 0
    assert s.get_workspace(w) == {"code": 1, "message": "Not found"}
    made = s.create_workspace(w)
    assert (made["code"], made["message"], made["workspace"]["total_files"]) == (0, "Ok", 2)
    assert s.create_workspace(f"{w}/")["message"] == "Workspace already exists" and s.create_workspace("rel/ative")["code"] == 1
    ask = ContentRequest("scanner")
    refusals = {"": "Workspace is required", "x/y": "Workspace is not absolute", "/nowhere": "workspace not found"}
    for path, message in refusals.items():
        assert s.search_content(path, ask) == s.search_files(path, "a", 5) == s.sync_workspace(path) == {"code": 1, "message": message}
    assert s.search_content(w, ContentRequest(""))["message"] == s.search_files(w, "", 5)["message"] == "Query is required"
    hits = lambda r=ask: [x["file"] for x in s.search_content(w, r)["data"].get("results", [])]
    assert hits() == ["a.go", "b.go"] and hits(ContentRequest("scanner", path=w)) == ["a.go", "b.go"] and hits(ContentRequest("scanner", path="/other")) == []
    assert s.search_files(w, "b.go", 5)["data"]["results"] == ["b.go"]
    (root / "c.go").write_text("func gamma scanner")
    assert s.update_document(w, "c.go")["code"] == 0 and hits() == ["a.go", "b.go", "c.go"] and s.get_workspace(w)["workspace"]["total_files"] == 3
    (root / "c.go").write_text("func gamma")
    assert s.update_document(w, "c.go")["code"] == 0 and hits() == ["a.go", "b.go"] and s.get_workspace(w)["workspace"]["total_files"] == 3
    (root / "c.go").unlink()
    assert s.update_document(w, "c.go")["code"] == 0 and s.get_workspace(w)["workspace"]["indexed_files"] == 2
    assert s.delete_document(w, "b.go")["code"] == 0 and hits() == ["a.go"] and s.get_workspace(w)["workspace"]["total_files"] == 1
    assert [x["file"] for x in s.search_content(w, ask, refresh=True)["data"]["results"]] == ["a.go", "b.go"]
    assert s.update_workspace(w, Filters(["a.*"], False, []), False)["code"] == 0 and s.sync_all()["code"] == 0 and hits() == ["a.go"]
    assert [s.delete_workspace(x)["code"] for x in ("", "x", "/nowhere")] == [1, 2, 3]
    assert s.delete_workspace(w) == {"code": 0, "message": "Deleted"} and s.list_workspaces()["workspaces"] == []


def test_hot_keyword_is_cut(spark, monkeypatch):
    """One keyword with half of all postings: its lists come from many buckets, none larger than the rest allows."""
    rows = [("hot", k) for k in range(4000)] + [(f"k{k % 900}", k) for k in range(4000)] + [("hot", 1)] * 50
    posts = spark.createDataFrame(rows, "keyword string, doc_id int")
    got = index.chunks(posts, size=10).collect()
    assert all(r["doc_count"] == len(r["doc_ids"]) == len(set(r["doc_ids"])) <= 10 for r in got)
    found = {}
    for r in got:
        found.setdefault(r["keyword"], []).extend(r["doc_ids"])
    assert sorted(found["hot"]) == list(range(4000)) and len(found) == 901
    per = Counter(r["part"]["_b"] for r in got if r["keyword"] == "hot")
    assert len(per) >= 6 and max(per.values()) <= 100
    monkeypatch.setattr(index, "HOT_ROWS", 50)
    lists = posts.select("keyword", F.array("doc_id").alias("doc_ids"))
    again = index.compact(lists, size=10).collect()
    packed = {}
    for r in again:
        packed.setdefault(r["keyword"], []).extend(r["doc_ids"])
        assert len(r["doc_ids"]) <= 10 and r["rows_before"] == (4050 if r["keyword"] == "hot" else Counter(x for x, _ in rows)[r["keyword"]])
    assert sorted(packed["hot"]) == list(range(4000)) and len(again) < 1500
    due = index.needs_compaction(lists, size=10).first()
    assert due["rows"] == 8050 and due["due"] and not index.needs_compaction(lists.limit(0)).first()["due"]
    gone = spark.createDataFrame([("hot", k) for k in range(0, 4000, 2)] + [("k1", 1)], "keyword string, doc_id int")
    left = index.remove_from_chunks(spark.createDataFrame([(r["keyword"], r["doc_ids"]) for r in again], "keyword string, doc_ids array<int>"), gone).collect()
    assert sorted(x for r in left if r["keyword"] == "hot" for x in r["doc_ids"]) == list(range(1, 4000, 2)) and all(r["doc_ids"] for r in left)
