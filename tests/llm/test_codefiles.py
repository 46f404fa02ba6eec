"""Clusters of source files against all pairs, and the kinds of small examples."""

import random
from pathlib import Path

import numpy as np
import pytest

from tessera.llm import codefiles, codetokens


def connected(n, links):
    u = codefiles._Union(n)
    for i, j in links:
        u.up[u.find(i)] = u.find(j)
    first = {}
    return [first.setdefault(u.find(k), k) for k in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_group_links_connect_what_all_pairs_connect(seed):
    r = random.Random(seed)
    sets = []
    for _ in range(8):
        base = [r.getrandbits(64) for _ in range(r.randint(8, 40))]
        for _ in range(r.randint(1, 14)):  # chains of small edits, which drift away from their leader
            base = [x for x in base if r.random() > 0.06] + [r.getrandbits(64) for _ in range(r.randint(0, 2))]
            sets.append(np.unique(np.array(base or [1], np.uint64)))
    jac = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    want = [(i, j) for i in range(len(sets)) for j in range(i) if jac(sets[i], sets[j]) >= codefiles.THRESHOLD]
    got = codefiles.group_links(sets)
    assert all(jac(sets[i], sets[j]) >= codefiles.THRESHOLD for i, j in got)
    assert connected(len(sets), got) == connected(len(sets), want)


def test_components(spark):
    edges = [(f"a{k}", f"a{k + 1}") for k in range(40)] + [("b1", "b0"), ("b1", "b2"), ("c", "d"), ("c", "d")]
    got = {r["node"]: r["class"] for r in codefiles.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {v for k, v in got.items() if k[0] == "a"} == {"a0"} and {got["b0"], got["b1"], got["b2"]} == {"b0"} and got["c"] == got["d"] == "c"
    assert codefiles.components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_blocks_lose_no_link(spark, monkeypatch):
    base = "int f() { return a + b; } void g(int x) { if (x > 3) { call(x, 1); } else { other(x); } }\n"
    extra = ["while (x) { x--; }", "for (;;) { go(); }", "char *s = 0;", "switch (x) { case 1: break; }", "y = x << 2;"]
    texts = [base * 3 + e for e in extra]
    sets = [codetokens.shingles(codetokens.mask(t).tokens) for t in texts]
    df = spark.createDataFrame([(f"s{k}", bytearray(s.tobytes()), len(s)) for k, s in enumerate(sets)], "shape string, shingles binary, n_shingles int")
    whole = {r["class"] for r in codefiles.components(codefiles.shape_links(df)).collect()}
    monkeypatch.setattr(codefiles, "BLOCK", 2)
    assert {r["class"] for r in codefiles.components(codefiles.shape_links(df)).collect()} == whole


def test_mask():
    m = codetokens.mask("// note\nconst x = require('./velvet'); /* c */ y = [1, 2.5, \"s\"] # end", frozenset(["velvet"]))
    assert m.tokens == ["const", "I", "=", "require", "(", "K", ")", ";", "I", "=", "[", "N", ",", "N", ",", "S", "]"]
    assert len(m.comments) == 3 and codetokens.mask("").tokens == [] and len(codetokens.shingles([])) == 0
    assert len(codetokens.shingles(["a", "b"])) == 1


GEN = "".join(f"export const call{a} = (b: {a}Request) => http.post<{a}Reply>('/x/{a}', b);\n" for a in ("Alpha", "Beta", "Gamma", "Delta", "Eps", "Zeta", "Eta", "Theta"))
HAND = "import {{ a }} from './{0}';\n\n/** Fetch one {0}. */\nexport function {0}(x: string): number {{\n  const y = x.split('q').filter(Boolean);\n  if (y.length > 3) {{\n    throw new Error(`bad`);\n  }}\n  return y.length;\n}}\n"
CASES = [
    ("g1", "1", "src/a.ts", "// Code generated by tool 1.0. DO NOT EDIT.\n" + GEN, "generated"),
    ("g2", "1", "src/b.ts", GEN.replace("Alpha", "Omega"), "generated"),  # unmarked, by its family
    ("g3", "2", "x/package-lock.yml", "".join(f"pk{k}:\n  version: 1.{k}\n  resolved: https://r.invalid/{k}.tgz\n  integrity: sha512-abc{k}\n" for k in range(4)), "generated"),
    ("h1", "1", "src/h.ts", HAND.format("rows"), None),
    ("h2", "1", "src/i.ts", HAND.format("cols") + "// writes the first line\nconst banner = 'Code generated by tool. DO NOT EDIT.'\n", None),
    ("h3", "2", "vendor/j.ts", "// Once generated by tool; this file is now maintained by hand.\n" + HAND.format("cells"), None),
    ("h4", "2", "src/q.py", "x = 1\nq = \"select " + ", ".join(f"column_{k}_name" for k in range(60)) + "\"\n", None),
    ("h5", "2", "README.md", "# Title\n\nThis text was written by hand and mentions velvet 1.2 and generated files.\n", None),
    ("v1", "2", "lib/velvet@1.2/a.ts", HAND.format("velvet"), "vendored"),
    ("v2", "3", "src/k.ts", "// Copied from velvet 3.1, see LICENSE\n" + HAND.format("velvet"), "vendored"),
    ("m1", "3", "web/a.js", "".join(f"function f{k}(a,b){{return a?b.x{k}:f{k}(b,{k})}}var q{k}=z[{k}]||{{}};" for k in range(20)), "minified"),
    ("d1", "3", "src/t.go", "package t\n\nvar raw = `" + "[" + ",".join(f'{{"a":{k},"b":{k}.5}}' for k in range(80)) + "]`\n", "data"),
    ("d2", "3", "src/u.js", "// t\n" + "\n".join(f"{k}.25,-{k}.5,{k}" for k in range(90)), "data"),
    ("n1", None, None, None, None), ("n2", "3", "e.c", "", None),
]


def test_kinds(spark):
    docs = spark.createDataFrame([(a, b, c, d, 1, "clash") for a, b, c, d, _ in CASES] + [("g1", "1", "src/a.ts", CASES[0][3], 1, "clash")], "key string, repo string, path string, text string, size int, shape string")
    packages = spark.createDataFrame([("Velvet", "1"), ("velvet", "2"), (None, "3")], "package_name string, shape string")
    got = codefiles.classify_files(docs, packages, "key", "text", "path", "repo").collect()
    assert {r["key"]: r["kind"] for r in got} == {c[0]: c[4] for c in CASES} and len(got) == len(CASES) + 1
    by = {r["key"]: r for r in got}
    assert by["g1"]["class_id"] == by["g2"]["class_id"] and by["g1"]["class_files"] == 3 and by["g1"]["family"] == 3
    assert codefiles.classify_files(docs.limit(0), packages, "key", "text", "path", "repo").collect() == []
    assert codefiles.classify_files(docs.where("key = 'h1'").withColumn("text", docs["text"]), packages.limit(0), "key", "text", "path", "repo").first()["kind"] is None


def test_kinds_without_marks(spark):
    """Classes alone, with all header, lock-file and package patterns switched off."""
    docs = spark.createDataFrame([x[:4] for x in CASES], "key string, repo string, path string, text string")
    got = codefiles.classify_files(docs, spark.createDataFrame([("velvet",)], "package_name string"), "key", "text", "path", "repo", marks=False).collect()
    kinds = {r["key"]: r["kind"] for r in got}
    assert {k for k, v in kinds.items() if v == "generated"} == {"g1", "g2", "g3"} and {k for k, v in kinds.items() if v == "data"} == {"d1", "d2"}
    assert {k for k, v in kinds.items() if v == "minified"} == {"m1"} and {r["evidence"] for r in got} == {"class", None}


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the test tables")
def test_classes_decide_on_the_test_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, packages = spark.read.parquet(f"{sf}/documents.parquet").where("file_id is not null"), spark.read.parquet(f"{sf}/known_packages.parquet")
    full, bare = ({r["doc_id"]: r for r in codefiles.classify_files(docs, packages, "doc_id", "text", "rel_path", "workspace_id", m).collect()} for m in (True, False))
    cases = {k for k, r in full.items() if r["kind"]}
    assert sum(full[k]["evidence"] == "class" for k in cases) >= 0.85 * len(cases)
    unnamed = {k for k in cases if full[k]["kind"] != "vendored"}
    assert sum(bare[k]["kind"] is not None for k in unnamed) >= 0.9 * len(unnamed)


def test_very_long_file(spark):
    docs = spark.createDataFrame([("x", "1", "a.py", "def f(a):\n    return a + 1\n" * 20000)], "key string, repo string, path string, text string")
    assert codefiles.classify_files(docs, spark.createDataFrame([], "package_name string"), "key", "text", "path", "repo").first()["kind"] is None


def kinds(spark, rows):
    docs = spark.createDataFrame(rows, "key string, repo string, path string, text string")
    got = codefiles.classify_files(docs, spark.createDataFrame([("velvet",)], "package_name string"), "key", "text", "path", "repo").collect()
    return {r["key"]: r["kind"] for r in got}


def test_class_over_repositories_is_vendored(spark):
    body = "package velvet\n\n" + "func f(a int) int { return g(a, 1) }\nvar k = map[string]int{}\ntype T struct { x int }\n"
    uses = "from velvet import cut\n\ndef f(a):\n    return cut(a) + [x for x in a if x > 3]\n"
    rows = [("a", "1", "x/a.go", body), ("b", "2", "y/b.go", body.replace("f(", "other(")), ("c", "3", "c.go", body.replace("velvet", "main"))]
    assert kinds(spark, [*rows, ("p", "1", "p.py", uses), ("q", "2", "q.py", uses)]) == {"a": "vendored", "b": "vendored", "c": None, "p": None, "q": None}
    assert set(kinds(spark, [rows[0], ("b", "1", *rows[1][2:])]).values()) == {None}  # one repository's own module


def test_family_in_its_repository_is_generated(spark):
    plain = [(f"u{k}", str(k + 2), "x.ts", GEN.replace("Alpha", f"Om{k}")) for k in range(8)]
    rows = [("m", "1", "a.ts", "// Code generated by tool 1.0. DO NOT EDIT.\n" + GEN), ("n", "1", "b.ts", GEN.replace("Beta", "Psi")), *plain]
    assert kinds(spark, rows) == {"m": "generated", "n": "generated"} | {r[0]: None for r in plain}


LICENCE = "".join(f"// Line {k} of the terms of use.\n" for k in range(30))
BLOCK = "/*\n" + "".join(f"   Line {k} of the terms.\n" for k in range(30)) + "{}\n*/\n"


@pytest.mark.parametrize("text, made, origin", [
    (LICENCE + "// Code generated by tool 1.0. DO NOT EDIT.\n" + GEN, True, False),
    (BLOCK.format("Code generated by tool 1.0. DO NOT EDIT.") + GEN, True, False),
    (LICENCE + "package t\n\n// Code generated by tool 1.0. DO NOT EDIT.\n" + GEN, True, False),
    (LICENCE + "// source: a/b.proto\n// checksum: 0123456789ab\n" + GEN, True, False),
    (LICENCE + "// Copied from velvet 3.1, see LICENSE\n" + HAND.format("rows"), False, True),
    (BLOCK.format("Vendored from velvet.") + HAND.format("rows"), False, True),
    (HAND.format("velvet") * 3 + "// Copied from velvet 3.1\n" + HAND.format("b"), False, True),
    (HAND.format("rows") * 3 + "// Copied from velvet 3.1\n" + HAND.format("b"), False, False),  # a part of a file
    (HAND.format("rows") * 3 + "// the code generated by the parser is read here\n" + HAND.format("b"), False, False),
    (LICENCE + "// Once generated by tool; code generated by hand since.\n" + HAND.format("b"), False, False),
    (HAND.format("rows") * 3 + "const banner = 'Code generated by tool. DO NOT EDIT.'\n" + HAND.format("b"), False, False),
])
def test_comments_at_any_line(text, made, origin):
    f = codefiles.file_features(text, "x.ts", frozenset(["velvet"]))[1]
    assert (f["made"], f["origin"]) == (made, origin)
