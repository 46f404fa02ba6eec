"""The path pattern language and hierarchical ignore files."""

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import globs


@pytest.mark.parametrize(
    "pattern, path, is_dir, expected",
    [
        ("*.bak", "notes.bak", False, True), ("*.bak", "deep/er/notes.BAK", False, True), ("*.bak", "notes.bak.md", False, False), ("v?.csv", "v9.csv", False, True), ("v?.csv", "v.csv", False, False), ("v?.csv", "v10.csv", False, False),
        ("out/", "pkg/out", True, True), ("out/", "pkg/out", False, False), ("out/", "outer", True, False), ("/Makefile", "Makefile", False, True), ("/Makefile", "tools/Makefile", False, False),
        ("**/gen.go", "gen.go", False, True), ("**/gen.go", "p/q/r/gen.go", False, True), ("p/**/gen.go", "p/gen.go", False, True), ("p/**/gen.go", "p/q/r/gen.go", False, True), ("**/gen.go", "p/regen.go", False, False),
        ("a/**", "a", True, True), ("a/**", "x/a/b/c", False, True), ("[a-c]x", "bx", False, True), ("[^a-c]x", "bx", False, False), ("[^a-c]x", "dx", False, True), ("[a", "[a", False, False),
        ("\\*x", "*x", False, True), ("A*.TXT", "abc.txt", False, True), ("src/*", "lib/src/a", False, True), ("src/*", "src/a/b", False, False), ("**", "any/thing", False, True), ("[--0]x", "/x", False, False),
    ],
)
def test_rules(pattern, path, is_dir, expected):
    assert globs.rule_matches(globs.parse_rule(pattern), path, is_dir) is expected


def test_last_rule_decides():
    rules = globs.parse_rules(["*.csv\n!keep/*.csv\n/keep/old.csv", "", "# note", "cache/", "!/cache/"])
    want = {("a.csv", False): True, ("x/b.csv", False): True, ("keep/new.csv", False): False, ("keep/old.csv", False): True, ("cache", True): False, ("lib/cache", True): True, ("lib/cache", False): False, ("a.tsv", False): False}
    assert {k: globs.listed(rules, *k) for k in want} == want


def test_ignore_tree():
    tree = globs.IgnoreTree({"": ["*.o", "/dist/", "!/dist/"], "lib": ["!core.o", "tmp*"], "lib/vendor": ["*.md"]})
    kept = ["main.c", "lib/core.o", "lib/sub/core.o", "lib/readme.md", "dist/a.js", "", "../main.o"]
    dropped = ["main.o", "other/core.o", "lib/x.o", "lib/tmp1", "lib/tmpdir/a.c", "lib/vendor/readme.md", "lib/vendor/deep/readme.md", "lib/.gitignore"]
    assert not any(tree.ignored(p, False) for p in kept)
    assert all(tree.ignored(p, False) for p in dropped)
    assert tree.ignored(".git", True) and tree.ignored("lib/tmpdir", True) and not tree.ignored("dist", True)


def test_repository_root_ends_the_search_for_negations():
    rules = {"": ["!keep.txt", "*.txt"], "repo": ["keep.txt"]}
    assert not globs.IgnoreTree(rules).ignored("repo/keep.txt", False)
    assert globs.IgnoreTree(rules, ["repo"]).ignored("repo/keep.txt", False)


def test_columns_agree_with_python(spark):
    rnd = random.Random(5)
    names = ["a", "b.go", "c.js", "Test", "test1.py", "x-y", "log"]
    paths = sorted({"/".join(rnd.choice(names) for _ in range(rnd.randint(1, 4))) for _ in range(120)})
    lists = [["*.go", "!b.go"], ["test?.py", "log/"], ["/a/**", "!**/c.js"], ["[a-c].*"], ["x-[x-z]"]]
    df = spark.createDataFrame([(p,) for p in paths] + [(None,)], "p string")
    for lines in lists:
        rules = globs.parse_rules(lines)
        got = {r[0]: r[1] for r in df.select("p", globs.listed_column(rules, F.col("p"), False)).collect()}
        assert {p: globs.listed(rules, p, False) for p in paths} == {p: v for p, v in got.items() if p is not None}
        parents = lambda p: ["/".join(p.split("/")[:k]) for k in range(1, p.count("/") + 1)]
        ex = {r[0]: r[1] for r in df.where("p is not null").select("p", globs.excluded_with_folders(rules, F.col("p"))).collect()}
        assert ex == {p: any(globs.listed(rules, a, True) for a in parents(p)) or globs.listed(rules, p, False) for p in paths}
    assert fnmatch.fnmatch("b.go", "*.go")
    out = globs.git_ignored(df, "p", {"": ["*.go"]}).collect()
    assert {r["p"]: r["ignored"] for r in out} == {**{p: globs.IgnoreTree({"": ["*.go"]}).ignored(p, False) for p in paths}, None: None}


def test_paths():
    assert globs.normal_path("c:\\work\\x\\..\\y") == "C:/work/y" and globs.normal_path("/a//b/") == "/a/b"
