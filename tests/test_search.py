"""Content search against a sequential model, file search against worked scores, façade and corpus."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.engine import ContentRequest, Engine
from tessera.functions import fuzzy, text
from tessera.operators import content, extended, files, index
from tessera.plans.grammar import parse
from tessera.plans.query import compile_query
from tessera.plans.settings import Filters, Limit, Settings
from tessera.sources import corpus

DOCS = [
    (1, "src/a.go", "foo bar\nfoo  bar\r\nfoo bar x foo, é bar\né foo\r bar\nbar foo\nxfoo bar\ndog\n"),
    (2, "src/b.go", "my_func and foo-bar\nfunc here bar"),
    (3, "lib/c.py", "foo\u2028 bar\n" + "x" * 70000 + "\nfoo bar\n"),
    (4, "lib/d.py", ""),
    (5, "lib/e.py", None),
    (6, "docs/f.md", "foo bar foo bar foo bar\nbar\nfoo bar"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, rel_path string, content string").withColumn("extra", F.lit(1))
    return index.with_words(df).cache()


def model(q, case=False):
    plan, out = compile_query(q, case), []
    for doc, path, body in DOCS:
        if not body:
            continue
        words = {w.lower() for w in re.findall(text.WORD, body) if 3 <= len(w) <= 80}
        if not any(all(any(w.startswith(t.prefix) for w in words) for t in c.terms) for c in plan.clauses):
            continue
        lines = body.split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        for n, line in enumerate(lines, 1):
            if len(line.encode()) > content.MAX_LINE:
                break
            line = line[:-1] if line.endswith("\r") else line
            for c in plan.clauses:
                found = list(re.finditer(("" if case else "(?i)") + c.regex, line))
                if found:
                    at = lambda k: len(line[:k].encode())
                    out += [(doc, path, n, line, at(m.start(2)), at(m.end(2))) for m in found]
                    break
    return sorted(out)


@pytest.mark.parametrize("q, case", [("foo bar", False), ("foo", False), ("FOO", True), ("bar | foo", False), ("func", False), ("bar foo", False), ("ba? | fo*", False), ("here bar", False)])
def test_matches(docs, q, case):
    want = model(q, case)
    flat = ["doc_id", "rel_path", "line_number", "content", "start", "end"]
    plan = compile_query(q, case)
    assert sorted(map(tuple, content.matches(docs, plan).select(*flat).collect())) == want
    assert sorted(map(tuple, content.matches(docs.drop("words"), plan, index.postings(docs)).select(*flat).collect())) == want


def test_spans_are_bytes(docs):
    got = {(r["doc_id"], r["line_number"]): (r["start"], r["end"]) for r in content.matches(docs, compile_query("foo bar")).where("doc_id in (1, 3)").collect()}
    assert got == {(1, 1): (0, 7), (1, 2): (0, 8), (1, 3): (0, 21), (1, 4): (3, 11), (3, 1): (0, 10)}


def test_indexed_words_decide(docs):
    assert {r["doc_id"] for r in content.matches(docs, compile_query("func")).collect()} == {2}  # the word func itself is there
    only = docs.where("doc_id = 2").withColumn("content", F.lit("my_func")).withColumn("words", F.array(F.lit("my_func")))
    assert content.matches(only, compile_query("func")).count() == 0


def test_limits(docs):
    found = content.matches(docs, compile_query("foo"))
    rows = content.limited(found, Limit(4, 2)).orderBy("rel_path", "line_number", "start").collect()
    assert [(r["doc_id"], r["line_number"]) for r in rows] == [(6, 1), (6, 1), (3, 1), (1, 1)]
    assert all(r["truncated"] for r in rows) and [r["file_truncated"] for r in rows] == [True, True, False, False]
    assert [len(content.limited(found.where("doc_id = 6"), Limit(k, 500)).collect()) for k in (1, 2, 4)] == [3, 3, 4]  # a line is given whole


def test_context_and_nesting(docs):
    rows = content.matches(docs, compile_query("foo bar"), context=9).where("doc_id = 1 and line_number = 1").collect()
    assert rows[0]["before"] == [] and rows[0]["after"] == ["foo  bar", "foo bar x foo, é bar", "é foo\r bar", "bar foo", "xfoo bar"]
    e = Engine(docs, settings=Settings())
    got = e.content_response(ContentRequest("bar", include="*.md", before_after=1))
    assert got["data"]["results"][0]["file"] == "docs/f.md" and got["data"]["results"][0]["lines"][-1]["before"] == [{"line_number": 2, "content": "bar"}]
    assert e.content_response(ContentRequest("foo(")) == {"code": 0, "message": "Ok", "data": {}}
    assert e.content_response(ContentRequest("")) == {"code": 1, "message": "Query is required"}
    assert e.content_tool_text("bar", path="docs", limit=1)[:4] == ["Found 3 results in 1 files (truncated)", "", "=" * 20, "File: docs/f.md, 3 result"]
    assert e.content_tool_text("nothinghere") == ["Found 0 results in 0 files", "No results found."]
    assert "→    2@(14,17): func here bar".replace("14,17", "10,13") in e.content_console_text(ContentRequest("bar", path="src"))
    assert e.files_tool_text("fmd") == ["Found 1 files.", "docs/f.md"] and e.files_console_text("zzz", 5) == "No results found."


def test_filters(docs):
    paths = lambda **k: sorted({r["rel_path"] for r in docs.where(content.path_filter(F.col("rel_path"), **k)).collect()})
    assert paths(path="SRC") == ["src/a.go", "src/b.go"]
    assert paths(include="*.go,*.md") == ["docs/f.md", "src/a.go", "src/b.go"]
    assert paths(exclude="*.py,docs/*", workspace_include=["**/*"]) == ["src/a.go", "src/b.go"]
    assert paths(include="lib/") == []  # rules for folders match no file


@pytest.mark.parametrize(
    "pattern, path, score",
    [
        ("server", "src/server.go", 100), ("savedtabgroup", "src/saved_tab_group.cc", 100), ("savedtabgroup", "src/ui/saved/tabgroup.cc", 77), ("srchgo", "src/server/searcher/searcher.go", 100),
        ("wk", "core/workspace.go", 67), ("Wk", "core/workspace.go", None), ("sgo", "src/main.go", 52), ("de9", "src3/de/doc_190.txt", 41), ("zq", "a/b/c/jazz_long_directory/name/quick.txt", 3), ("", "any", 100),
    ],
)
def test_fuzzy(spark, pattern, path, score):
    df = spark.createDataFrame([(path,)], "rel_path string")
    got = df.where(fuzzy.subsequence(F.col("rel_path"), pattern)).select(fuzzy.fuzzy_score(F.col("rel_path"), pattern)).collect()
    assert [r[0] for r in got] == ([] if score is None else [score])
    assert files.fuzzy_files(df, pattern).count() == int(score is not None and score > 50)


def test_file_search_limits(spark):
    df = spark.createDataFrame([("b/test.py",), ("a/test.py",), ("test.py",), (None,)], "rel_path string")
    assert [r[0] for r in files.search_files(df, "t e s t", 2).collect()] == ["test.py", "a/test.py"]
    assert files.search_files(df, "test", 0).count() == 1
    assert files.existing(files.fuzzy_files(df, "test"), df.where("rel_path = 'test.py'")).count() == 1


def test_grammar_lines(docs):
    got = extended.matching_lines(docs, parse('"foo bar" AND NOT xfoo'))
    assert {(r["doc_id"], r["line_number"]) for r in got.collect()} == {(1, 1), (1, 3), (6, 1), (6, 3)}


def test_index_maintenance(spark, docs):
    posts = index.postings(docs)
    n = posts.count()
    gone = posts.where("keyword = 'foo'")
    assert index.remove_postings(posts, gone).count() == n - gone.count()
    assert index.delete_documents(docs, docs.where("doc_id = 1")).count() == len(DOCS) - 1
    new = docs.where("doc_id = 1").withColumn("words", F.array(F.lit("foo"), F.lit("new")))
    r = index.word_diff(docs, new.unionByName(new.withColumn("doc_id", F.lit(99).cast("long")))).orderBy("doc_id").collect()
    assert r[0]["added"] == ["new"] and "bar" in r[0]["removed"] and r[1]["added"] == ["foo", "new"] and r[1]["removed"] == []
    assert index.upsert(docs, new).count() == len(DOCS)


@pytest.mark.parametrize("rows, size, after", [([["a", "b"]], 10, 1), ([["a", "b"], ["c", "d"], ["e", "f"]], 10, 1), ([list("abcdefghij"), list("klmnopqrst")], 5, 2), ([["a", "b"], ["c", "d"], ["e", "f"], ["g", "h"], ["i", "a"]], 4, 3)])
def test_compaction(spark, rows, size, after):
    df = spark.createDataFrame([("1", "kw", r) for r in rows] + [("2", "kw", ["z"])], "workspace string, keyword string, doc_ids array<string>")
    out = index.compact(df, "workspace", size=size)
    mine = [r for r in out.collect() if r["workspace"] == "1"]
    assert len(mine) == after and sorted({x for r in mine for x in r["doc_ids"]}) == sorted({x for r in rows for x in r})
    assert [r["doc_ids"] for r in out.collect() if r["workspace"] == "2"] == [["z"]]
    assert index.compaction_stats(df, out).first()["rows_before"] == len(rows) + 1


def test_words_and_kinds(spark):
    df = spark.createDataFrame([("ab abc ABC x-y my_func a" + "b" * 80 + " " + "c" * 80,), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.words(F.col("t"))).collect()] == [["abc", "c" * 80, "my_func", "x-y"], [], None]
    b = spark.createDataFrame([(bytearray(b"a" * 94 + b"\x01" * 6),), (bytearray(b"a" * 96 + b"\x01" * 4),), (bytearray(b""),), (bytearray("é\n".encode()),)], "b binary")
    assert [r[0] for r in b.select(text.likely_text(F.col("b"), F.lit("application/octet-stream"))).collect()] == [False, True, False, True]
    assert b.select(text.likely_text(F.col("b"), F.lit("image/png"))).distinct().collect()[0][0] is False
    p = spark.createDataFrame([("a/b.EXE",), ("a/.ds_store",), ("a.b/c",), ("x.go",)], "p string")
    assert [r[0] for r in p.select(text.indexable(F.col("p"))).collect()] == [False, False, True, True]


def test_folder(spark, tmp_path):
    for name, body in {"a.go": b"package main\n", "b.log": b"x", "dist/c.go": b"package c\n", "img.png": b"\x89PNG", "bin.dat": bytes(range(12)), "sub/d.go": b"func d word\n", "sub/.gitignore": b"skip.go\n", "sub/skip.go": b"no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    all_ = corpus.read_folder(spark, str(tmp_path))
    kept = corpus.wanted_files(all_, Settings().filters)
    docs = corpus.parsed_files(kept, "/ws", Settings(max_file_size=12)).orderBy("rel_path").collect()
    assert [r["rel_path"] for r in docs] == ["a.go", "sub/d.go", "sub/skip.go"]
    assert docs[0]["words"] == [] and docs[0]["hash"] == "" and docs[1]["words"] == ["func", "word"]
    git = corpus.wanted_files(all_, Filters(["**/*.go"], True, []), str(tmp_path))
    assert sorted(r["rel_path"] for r in git.collect()) == ["a.go", "dist/c.go", "sub/d.go"]
    assert corpus.wanted_files(all_, Filters([], False, [])).count() == 0


def test_folder_has_every_name(spark, tmp_path):
    bodies = {"a/__init__.py": b"", "a/b.py": b"x = 1\n", "_sub/c.py": b"c", "_sub/_deep/__d.py": b"d", ".hid": b"h", ".github/w.yml": b"w", "a b%20/\u00e9 #1.txt": b"e"}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    (tmp_path / "link.py").symlink_to(tmp_path / "a/b.py")
    (tmp_path / "a/up").symlink_to(tmp_path)
    (tmp_path / "dangling").symlink_to(tmp_path / "none")
    got = corpus.read_folder(spark, str(tmp_path)).collect()
    assert sorted((r["rel_path"], bytes(r["bytes"])) for r in got) == sorted([*bodies.items(), ("link.py", b"x = 1\n")])
    at = (tmp_path / "a/b.py").stat()
    assert [(r["size"], r["modified_time"]) for r in got if r["rel_path"] == "a/b.py"] == [(6, at.st_mtime_ns // 1000)]
    with pytest.raises(FileNotFoundError):
        corpus.read_folder(spark, str(tmp_path / "none"))
