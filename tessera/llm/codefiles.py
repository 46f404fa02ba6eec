"""Generated, minified and vendored source files, and data saved as code.

Files are reduced to identifier-masked token shingles (:mod:`codetokens`).  Files with the same shingle set are
one shape.  Shapes are clustered by MinHash banding; candidates are verified (Jaccard of at least 0.8) inside
each bucket, and the connected shapes form a class; the files of a class in one repository are a family.

A class shows what its files are; what a file says about itself (headers, declared packages) confirms it:

* data: literals are most of the class's characters, and of the file's;
* minified: the class is squeezed (hardly any white space, many tokens a line), and so is the file;
* generated: the file repeats itself as only few hand-written files do, and it, or a fifth of its class or of its
  family of two or more, says that a program made it or is a lock file;
* vendored: the class lies in two or more repositories, and the file names the known package it comes from: by its
  origin comment, by lying in the folder of the package it declares, or by declaring the same package as half of
  its class in two or more repositories.

``evidence`` is ``class`` where it was so.  A file that stands alone, or whose shape shows nothing, is judged by what it
says itself, and ``evidence`` is ``file``.  All measures are shares, so that they mean the same at every size.

Inside a bucket no pairs are listed: a member is compared with the leaders of the groups found so far, and with
a group's other members only where the triangle inequality of the Jaccard distance leaves a link possible.
Buckets beyond BLOCK shapes are cut into blocks and every pair of blocks is one task, so no link is lost.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.common import plain, spread, written
from tessera.llm import codetokens as c

THRESHOLD, BANDS, ROWS, BLOCK = 0.8, 32, 8, 4000
HEAD_LINES = 12
MAX_PACKAGES = 100_000
LITERAL, SPACE, PER_LINE = 0.65, 0.08, 40  # data: share of literals; minified: share of white space, tokens a line
REPEATS, REPEATS_ALONE, SHARE = 0.5, 0.7, 0.2  # generated: share of repeated shingles, with and without a word of it; share of marked files
_MEANS = ("literal", "space", "per_line")

_COMMENT_LINE = re.compile(r"^\s*(?://|\#(?!include|define)|/\*|\*(?!/)|<!--|;|--|\"\"\")")
_SAYS_MADE = (
    r"@generated\b|<auto-?generated|\bauto-?generated (?:file|by)\b|\bcode generated by\b|\bgenerated (?:on|by|from) .*\b(?:do not (?:edit|modify)|edit the template)|\bgenerated on .* from\b"
    r"|\brendered by \S+ from \S+\.\w+|\b(?:produced|written|created|made) by\b.*\b(?:changes|edits)\b.*\b(?:lost|overwritten)\b|\bautomatisch (?:erzeugt|generiert)\b|\bgénéré automatiquement\b|\bgenerado automáticamente\b|\bgerado automaticamente\b"
)
_MADE = re.compile(f"(?i)(?:{_SAYS_MADE})")
# Below the head, where comments are about the code beside them, a comment has to begin with it.
_MADE_BELOW = re.compile(rf"(?i)^[\s/#*;<!\-\"]*(?:this (?:file|code|source|module)(?: (?:is|was|has been))? )?(?:{_SAYS_MADE})")
_NOT_MADE = re.compile(r"(?i)\bonce generated\b|\bmaintained by hand\b|\bno longer generated\b|\bwas generated\b")
_SCHEMA = re.compile(r"(?im)^\W*source: \S+\.(?:schema|proto|idl|thrift|avsc)\W*$\s+^\W*(?:schema )?checksum: [0-9a-f]{8,}")
_LOCK = re.compile(r"(?m)^\s*\"?(?:integrity|checksum|resolved)\"?:?\s")
_NAME = r"[@\w][\w@/.-]*"
_FROM = re.compile(rf"(?i)(?:\bcopied (?:verbatim )?from|\bpart of|\bimported from upstream|\bvendored from|\btaken from)\s+(?:the )?({_NAME})|\b([@\w][\w@/-]*)(?: v\d| - https?://)")
_OWN = re.compile(rf"(?m)^package ({_NAME})|^from ({_NAME}) import|require\(['\"]\./({_NAME})['\"]\)|from ['\"]\./({_NAME})['\"]|#include \"({_NAME})\.h\"|^(?:namespace|module) ({_NAME})")


def _named(found, packages: frozenset[str]) -> tuple[str, int] | None:
    """The first of the matches whose name is a known package, and the number of its group."""
    for m in found:
        name = m[m.lastindex]
        for x in (name, name.rstrip("./-"), name.split("/")[0]):
            if x.lower() in packages:
                return x, m.lastindex
    return None



def comment_lines(lines: list[str]) -> tuple[list[bool], int]:
    """Which lines are comments, and how many lines the head has: HEAD_LINES, or all of a longer leading comment."""
    flags, closes, head = [], None, None
    for k, x in enumerate(lines):
        bare = x.strip()
        inside = closes is not None
        if inside:
            if closes in bare:
                closes = None
        else:
            opens = {"/*": "*/", "<!--": "-->"} | ({'"""': '"""', "'''": "'''"} if head is None else {})  # strings of many lines only where no code came yet
            for o, c_ in opens.items():
                if bare.startswith(o):
                    closes, inside = (None if c_ in bare[len(o) :] else c_), True
        flags.append(inside or bool(_COMMENT_LINE.match(x) or re.match(r"^\s*\*.*\*\s*$", x)))
        if head is None and bare and not flags[-1] and not (k == 0 and bare.startswith(("<?", "#!"))):
            head = k
    return flags, max(HEAD_LINES, len(lines) if head is None else head)


def file_features(text: str, path: str, packages: frozenset[str]) -> tuple[c.Masked, dict]:
    """The masked tokens and what a file says about itself."""
    masked = c.mask(text, packages)
    lines = text.splitlines()
    flags, top = comment_lines(lines)
    said = [x for x, f in zip(lines, flags) if f]
    head = "\n".join(x for x, f in zip(lines[:top], flags) if f)
    near = [x for k, (x, f) in enumerate(zip(lines, flags)) if f and (k < top or k >= len(lines) - 2)]
    made = any(_MADE.search(x) for x in near if not _NOT_MADE.search(x)) or any(_MADE_BELOW.match(x) for x in said if not _NOT_MADE.search(x))
    own = _named(_OWN.finditer(text), packages)
    package = own[0] if own else None
    origin = _named(_FROM.finditer(head), packages)
    if not origin and package:  # a comment below the head may tell where a part came from: only that of the file's own package counts
        origin = _named(_FROM.finditer("\n".join(said)), frozenset([package.lower()]))
    spaces = sum(ch.isspace() for ch in text)
    runs = max(1, len(masked.tokens) - c.SHINGLE + 1)
    return masked, {
        "made": made or "hecksum" in text and bool(_SCHEMA.search("\n".join(said)) or _SCHEMA.search(text)),
        "locked": len(_LOCK.findall(text)) >= 4,
        "origin": bool(origin),
        "package": package,
        "declares": bool(package) and own[1] != 2,  # an import by the full name may be any user's
        "at_home": bool(package and re.search(rf"(?:^|[/@]){re.escape(package)}(?:[-@./]|$)", path or "")),
        "literal": masked.literal_chars / max(1, masked.solid_chars),
        "space": spaces / max(1, len(text)),
        "per_line": len(masked.tokens) / max(1, sum(1 for x in lines if x.strip())),
        "runs": runs,
    }


_DOC = (
    "id {0}, repo string, path string, shape string, shingles binary, n_shingles int, made boolean, locked boolean, origin boolean, package string, declares boolean, at_home boolean, "
    "literal double, space double, per_line double, runs int"
)


def _describe(packages: frozenset[str]):
    cols = ["made", "locked", "origin", "package", "declares", "at_home", "literal", "space", "per_line", "runs"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                rows = []
                for text, path in zip(part["text"], part["path"]):
                    masked, f = file_features(text, path, packages)
                    h = c.shingles(masked.tokens)
                    raw = h.tobytes()
                    rows.append([hashlib.md5(raw).hexdigest(), raw, len(h), *(f[k] for k in cols)])
                out = pd.DataFrame(rows, columns=["shape", "shingles", "n_shingles", *cols])
                for k in ("id", "repo", "path"):
                    out.insert(0, k, part[k].to_numpy())
                yield plain(out[["id", "repo", "path", "shape", "shingles", "n_shingles", *cols]])

    return run


def _bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rng = np.random.default_rng(20240607)
    a = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
    for batch in batches:
        if not len(batch):
            continue
        sig = np.stack([c.minhash(np.frombuffer(x, np.uint64), a, b) for x in batch["shingles"]]).reshape(len(batch), BANDS, ROWS)
        keys = [hashlib.blake2b(bytes([band]) + row[band].tobytes(), digest_size=12).hexdigest() for row in sig for band in range(BANDS)]
        yield plain(pd.DataFrame({"bucket": keys, "shape": np.repeat(batch["shape"].to_numpy(dtype=object), BANDS)}))


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def group_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (i, j) of Jaccard >= 0.8 that connect exactly what all such links would connect."""
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    members: dict[int, list[int]] = {}  # leader to its group
    where: dict[int, list[int]] = {}  # hash to the leaders that hold it
    joined, out = _Union(len(sets)), []

    def link(i: int, j: int) -> None:
        a, b = joined.find(i), joined.find(j)
        if a != b:
            joined.up[a] = b
            out.append((i, j))

    def close(i: int, j: int) -> bool:
        m, n = len(sets[i]), len(sets[j])
        if min(m, n) < THRESHOLD * max(m, n):
            return False
        same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return same >= THRESHOLD * (m + n - same)

    for i in order:
        shared: dict[int, int] = {}
        for h in sets[i].tolist():
            for leader in where.get(h, ()):
                shared[leader] = shared.get(leader, 0) + 1
        home, near = None, []
        for leader, same in shared.items():
            j = same / (len(sets[i]) + len(sets[leader]) - same)
            if j >= THRESHOLD:
                link(i, leader)
                if home is None:
                    home = leader
            elif j >= 2 * THRESHOLD - 1 - 1e-9:
                near.append(leader)
        for leader in near:
            for x in members[leader]:
                if joined.find(x) != joined.find(i) and close(i, x):
                    link(i, x)
        if home is None:
            members[i] = [i]
            for h in sets[i].tolist():
                where.setdefault(h, []).append(i)
        else:
            members[home].append(i)
    return out


def _bucket_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by task (a bucket or a pair of its blocks), each with a shape, to links; one task in memory at a time."""
    held: list[tuple[str, bytes]] = []
    task = None

    def links() -> pd.DataFrame:
        pairs = group_links([np.frombuffer(x, np.uint64) for _, x in held])
        return plain(pd.DataFrame({"a": [held[i][0] for i, _ in pairs], "b": [held[j][0] for _, j in pairs]}, columns=["a", "b"]))

    for batch in batches:
        for key, shape, raw in zip(batch["task"], batch["shape"], batch["shingles"]):
            if key != task:
                if held:
                    yield links()
                held, task = [], key
            held.append((shape, raw))
    if held:
        yield links()


def shape_links(shapes: DataFrame) -> DataFrame:
    """Links a, b between shapes (shape, shingles), from all buckets.

    Buckets with the same members (as most bands give for near-copies) are looked at once; members are compared
    by count and two independent 64-bit sums.
    """
    bands = written(shapes.where("n_shingles > 0").select("shape", "shingles").mapInPandas(_bands, "bucket string, shape string"), "bands")
    h = F.xxhash64("shape")
    sizes = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.xxhash64(F.lit(3), "shape").cast("decimal(20,0)")).alias("s")).where("n > 1")
    once = sizes.groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    met = bands.join(once.select("bucket", "blocks"), "bucket").withColumn("at", F.pmod(h, F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(F.concat_ws("/", "bucket", F.least("at", "other"), F.greatest("at", "other")).alias("task"), "shape")
    full = met.join(shapes.select("shape", "shingles"), "shape")
    n = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return full.repartition(n * 4, "task").sortWithinPartitions("task").mapInPandas(_bucket_links, "a string, b string").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``class`` (the least node of its component) for every node of the links; rounds of least label and jump."""
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("class")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("class").alias("n"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("class").alias("old"), F.least("class", "n").alias("class"))
        jump = step.select(F.col("node").alias("k"), F.col("class").alias("up"))
        new = written(step.join(jump, step["class"] == jump["k"], "left").select("node", "old", F.least("class", F.coalesce("up", "class")).alias("class")), "labels")
        if new.where("old <> class").isEmpty():
            return new.select("node", "class")
        labels = new.select("node", "class")


def classify_files(docs: DataFrame, packages: DataFrame, id_col: str, text_col: str, path_col: str, repo_col: str, marks: bool = True) -> DataFrame:
    """One row per file: id, ``class_id``, ``class_files``, ``class_repos``, ``family`` (files of its class in its repository), ``kind``, ``evidence``.

    ``kind`` is generated, minified, vendored, data, or null for a hand-written file; ``evidence`` is class or file.
    ``packages`` has package_name (at most MAX_PACKAGES different ones, as each task holds them).  A null text counts as
    empty; an empty file is its own class and no case; a null path or repository is one of its own kind.
    Repeated rows each give a row.  An empty table gives an empty one.

    Without ``marks`` nothing that files say about themselves is used: then generated files are told by repetition
    alone, and vendored ones, whose shapes hand-written files share, not at all.
    """
    names = [r[0].lower() for r in packages.where("package_name is not null").select("package_name").distinct().limit(MAX_PACKAGES + 1).collect()]
    if len(names) > MAX_PACKAGES:
        raise ValueError(f"more than {MAX_PACKAGES} packages")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(repo_col), F.lit("")).alias("repo"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    files = written(spread(rows).mapInPandas(_describe(frozenset(names)), _DOC.format(kind)), "files")
    shapes = written(files.groupBy("shape").agg(F.first("shingles").alias("shingles"), F.first("n_shingles").alias("n_shingles")), "shapes")
    classes = components(shape_links(shapes)).withColumnRenamed("node", "shape")
    says = F.col("made") | F.col("locked")
    local = files.groupBy("shape", "repo").agg(F.count(F.lit(1)).alias("n"), F.sum(says.cast("int")).alias("n_made"), *(F.sum(c_).alias(c_) for c_ in _MEANS))
    local = local.join(classes, "shape", "left").withColumn("class", F.coalesce("class", "shape"))
    family = local.groupBy("class", "repo").agg(*(F.sum(c_).alias(c_) for c_ in ("n", "n_made", *_MEANS)))
    whole = family.groupBy("class").agg(
        F.sum("n").alias("class_files"), F.count(F.lit(1)).alias("class_repos"), (F.sum("n_made") / F.sum("n")).alias("made_share"), *((F.sum(c_) / F.sum("n")).alias(f"class_{c_}") for c_ in _MEANS)
    )
    of_shape = local.select("shape", "class").distinct().join(whole, "class")
    in_repo = family.select("class", "repo", F.col("n").alias("family"), (F.col("n_made") / F.col("n")).alias("family_made"))
    f = files.drop("shingles").join(of_shape, "shape").join(in_repo, ["class", "repo"])
    declared = f.where("declares").groupBy("class", "package").agg(F.count(F.lit(1)).alias("n_declared"), F.countDistinct("repo").alias("declared_repos"))
    f = f.join(declared, ["class", "package"], "left")
    both = lambda name, test: test(F.col(name)) & test(F.col(f"class_{name}"))
    solid = both("literal", lambda x: x < LITERAL)
    data = both("literal", lambda x: x >= LITERAL)
    squeezed = both("space", lambda x: x < SPACE) & both("per_line", lambda x: x >= PER_LINE) & solid
    repeats = 1 - F.col("n_shingles") / F.col("runs")
    recurs = (F.col("made_share") >= SHARE) | (F.col("family") >= 2) & (F.col("family_made") >= SHARE)
    copied = F.col("declares") & (F.col("declared_repos") >= 2) & (F.col("n_declared") >= 0.5 * F.col("class_files"))
    vendored = F.col("origin") | (F.col("package").isNotNull() & F.col("at_home")) | copied
    if marks:
        by_class = [(vendored & (F.col("class_repos") >= 2), "vendored"), ((repeats >= REPEATS) & (says | recurs), "generated"), (data, "data"), (squeezed, "minified")]
        by_file = [(vendored, "vendored"), (says, "generated")]
    else:
        by_class = [(data, "data"), (squeezed, "minified"), ((repeats >= REPEATS_ALONE) & solid, "generated")]
        by_file = []
    labels = [(test, name, how) for tests, how in ((by_class, "class"), (by_file, "file")) for test, name in tests]
    order = [x for name in ("vendored", "generated", "data", "minified") for x in labels if x[1] == name] if marks else labels
    told = reduce(lambda so_far, x: so_far.when(x[0], F.struct(F.lit(x[1]).alias("kind"), F.lit(x[2]).alias("evidence"))), order[1:], F.when(order[0][0], F.struct(F.lit(order[0][1]).alias("kind"), F.lit(order[0][2]).alias("evidence"))))
    out = f.withColumn("_told", F.when(F.col("n_shingles") > 0, told).otherwise(F.when(F.col("literal") >= LITERAL, F.struct(F.lit("data").alias("kind"), F.lit("file").alias("evidence")))))
    return out.select(F.col("id").alias(id_col), F.col("class").alias("class_id"), "class_files", "class_repos", "family", F.col("_told.kind").alias("kind"), F.col("_told.evidence").alias("evidence"))
