"""Processing only new or changed records: diffs of immutable table versions.

A table is a folder of immutable Parquet files and one manifest per version.  A manifest names the data files
the version added, those it removed, and its deletion vector: the rows (file, position) of live files that are
no longer part of the table.  The record delta between two versions follows from the manifests alone: rows of
added files, rows of removed files and rows named by deletion vectors; nothing else is read.

A consumer writes each delta and the version it has processed in one commit.  A run that dies before its commit
leaves nothing behind that counts; the next run starts from the last committed version, so there is neither a
gap nor a repeat.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Store:
    """A folder on any file system Spark knows; small files are written whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        p = self._p(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._p(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _name_new(self, beside, to, link: bool | None = None) -> None:
        """Give the file the name, or fail if there is one of that name."""
        jvm, source, target = self._jvm, self._fs.makeQualified(beside).toUri(), self._fs.makeQualified(to).toUri()
        if target.getScheme() == "file" if link is None else link:  # a local rename replaces, a link does not
            try:
                jvm.java.nio.file.Files.createLink(jvm.java.io.File(target.getPath()).toPath(), jvm.java.io.File(source.getPath()).toPath())
                return
            except Py4JJavaError:
                if self._fs.exists(to):
                    raise  # else the file system has no links
        # FileContext's rename, unlike FileSystem's, does not replace
        none = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target, self.spark._jsc.hadoopConfiguration()).rename(beside, to, none)

    def put_new(self, name: str, text: str) -> bool:
        """Writes a file of its own beside and gives it the name; False if the name is taken, also by a writer at the same time."""
        if self._fs.exists(self._p(name)):
            return False
        beside = self._p(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(beside, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            self._name_new(beside, self._p(name))
            return True
        except Py4JJavaError:
            if self._fs.exists(self._p(name)):
                return False
            raise
        finally:
            if self._fs.exists(beside):
                self._fs.delete(beside, False)


@dataclass
class Manifest:
    version: int
    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    deletions: list[str] = field(default_factory=list)  # files of (file, pos)
    touched: list[str] = field(default_factory=list)  # data files that the deletions name


class VersionedTable:
    """Versions are positive integers in order of commit; version 0 is the empty table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.store.names("_manifests") if n.endswith(".json")]

    def manifest(self, version: int) -> Manifest:
        return Manifest(**json.loads(self.store.read(f"_manifests/{version:012}.json")))

    def _commit(self, m: Manifest) -> None:
        if not self.store.put_new(f"_manifests/{m.version:012}.json", json.dumps(m.__dict__)):
            raise FileExistsError(f"version {m.version} was committed by another writer")

    def _files(self, folder: str, part: str) -> list[str]:
        return [f"{folder}/{part}/{n}" for n in self.store.names(f"{folder}/{part}") if n.endswith(".parquet")]

    def _read(self, names: list[str]) -> DataFrame:
        """Files or folders as they are, without columns from their paths."""
        return self.spark.read.option("recursiveFileLookup", True).parquet(*[f"{self.store.path}/{n}" for n in names])

    def _located(self, names: list[str]) -> DataFrame:
        """Rows of data files with ``_file`` (load, version and name), ``_pos`` and ``_v``, the version that added them."""
        at = F.substring_index(F.col("_metadata.file_path"), "/", -3)
        return self._read(names).withColumns({"_file": at, "_pos": F.col("_metadata.row_index"), "_v": F.regexp_extract(at, "/_v=([0-9]+)/", 1).cast("long")})

    def live(self, upto: int) -> DataFrame | None:
        """The rows of a version, as ``_located`` gives them; None where there are none."""
        ms = [self.manifest(v) for v in self.versions() if v <= upto]
        removed = {f for m in ms for f in m.removed}
        files = [f for m in ms for f in m.added if f not in removed]
        return self._located(files).join(self._vectors(ms), ["_file", "_pos"], "left_anti") if files else None

    @staticmethod
    def _name(path: str) -> str:
        """A manifest's data file as ``_file`` names it."""
        return "/".join(path.split("/")[-3:])

    @staticmethod
    def _stored(df: DataFrame) -> list[str]:
        return [c for c in df.columns if c not in ("_v", "_d", "_file", "_pos", "_version")]

    def load_upserts(self, rows: DataFrame, version: Column, keys: list[str], order: list[str], state: list[str]) -> None:
        """Commit one version for each value of ``version``: its rows are upserts by key, the greatest ``order`` holds.

        They are upserts to what the last committed version holds.  Rows of versions up to that one are taken to be
        in the table and left out, so a load that died between its commits is simply run again with the same rows;
        what it had written without a commit lies in a folder of its own and counts for nothing.

        Rows with a null version or key are not part of the table.  A row that a greater one of the same or an
        earlier version beats is deleted in its own commit, one that a later version beats in that version's.
        Ties in ``order`` go to the greatest of ``state`` (nulls least), then to the last file.  Only the named
        columns are stored; others, whatever their names, are ignored.
        """
        if clash := {"_v", "_d", "_file", "_pos", "_version", "_change"} & {*keys, *order, *state}:
            raise ValueError(f"reserved column names: {sorted(clash)}")
        last = max(self.versions(), default=0)
        load = f"{last:012}-{uuid.uuid4().hex}"
        stored = rows.select(version.cast("long").alias("_v"), *keys, *order, *state)
        stored.where(f"_v > {last}" + "".join(f" and `{k}` is not null" for k in keys)).write.partitionBy("_v").parquet(f"{self.store.path}/data/{load}")
        at = [int(n[3:]) for n in self.store.names(f"data/{load}") if n.startswith("_v=")]
        if not at:
            return
        data = self._located([f"data/{load}"])
        rank = F.struct(*order, *state, "_file", "_pos")
        best = data.groupBy(*keys, "_v").agg(F.max(rank).alias("_r"))
        base = self.live(last)
        if base is not None:
            held = base.select(*keys, F.lit(last).cast("long").alias("_v"), rank.alias("_r"))
            best = best.unionByName(held.join(data.select(*keys).distinct(), keys, "left_semi"))
        order_w = Window.partitionBy(*keys).orderBy("_v")
        run = best.withColumn("_m", F.max("_r").over(order_w.rowsBetween(Window.unboundedPreceding, -1)))
        live = run.where(f"_v > {last}").where(F.col("_m").isNull() | (F.col("_r") > F.col("_m")))
        # the previous state, which this version deletes
        beaten = live.where("_m is not null").select(F.col("_v").alias("_d"), F.col("_m._file").alias("file"), F.col("_m._pos").alias("pos"))
        shown = live.select("_v", F.col("_r._file").alias("_file"), F.col("_r._pos").alias("_pos"))
        never = data.select("_v", "_file", "_pos").join(shown, ["_v", "_file", "_pos"], "left_anti").select(F.col("_v").alias("_d"), F.col("_file").alias("file"), F.col("_pos").alias("pos"))
        beaten.unionByName(never).repartition("_d").write.partitionBy("_d").parquet(f"{self.store.path}/deletions/{load}")
        touched: dict[int, list[str]] = {}
        if any(n.startswith("_d=") for n in self.store.names(f"deletions/{load}")):  # one row for each version and data file: no more than manifests hold anyway
            for r in self.spark.read.parquet(f"{self.store.path}/deletions/{load}").select("_d", "file").distinct().collect():
                touched.setdefault(int(r["_d"]), []).append(f"data/{r['file']}")
        if max(self.versions(), default=0) != last:
            raise FileExistsError(f"another writer committed after version {last}")
        for v in sorted(at):
            self._commit(Manifest(v, self._files(f"data/{load}", f"_v={v}"), [], self._files(f"deletions/{load}", f"_d={v}"), sorted(touched.get(v, []))))

    def _vectors(self, ms: list[Manifest]) -> DataFrame:
        """The manifests' deletion vectors: ``_d`` (version), ``_file``, ``_pos``."""
        marks = [f for m in ms for f in m.deletions]
        if not marks:
            return self.spark.createDataFrame([], "_d bigint, _file string, _pos bigint")
        version = F.regexp_extract(F.col("_metadata.file_path"), "/_d=([0-9]+)/[^/]*$", 1).cast("long")
        return self._read(marks).select(version.alias("_d"), F.col("file").alias("_file"), F.col("pos").alias("_pos"))

    def deltas(self, after: int, upto: int) -> DataFrame:
        """One row per version and record that came or went in (after, upto]: ``_version``, ``_change`` (1 came, -1 went), the columns.

        A record that a version rewrites from a removed file to an added one both comes and goes in it.
        """
        past = [self.manifest(v) for v in self.versions() if v <= upto]
        ms = [m for m in past if m.version > after]
        added = [f for m in ms for f in m.added]
        touched = sorted({f for m in ms for f in m.touched})
        removed = {f: m.version for m in ms for f in m.removed}
        if not added and not touched and not removed:
            raise ValueError(f"no versions after {after} up to {upto}")
        dv = self._vectors(ms)
        parts = []
        # Only the files that the deletion vectors name, and those that were added or removed, are opened.
        if added:
            new = self._located(added)
            parts.append(new.join(dv.withColumnRenamed("_d", "_v"), ["_v", "_file", "_pos"], "left_anti").select(F.col("_v").alias("_version"), F.lit(1).alias("_change"), *self._stored(new)))
        if touched:
            hit = self._located(touched).join(dv, ["_file", "_pos"])
            parts.append(hit.where("_v < _d").select(F.col("_d").alias("_version"), F.lit(-1).alias("_change"), *self._stored(hit)))
        if removed:
            # less the rows that a vector, of that version or of any earlier one, has deleted already
            gone = self._vectors([m for m in past if removed.keys() & set(m.touched)]).select("_file", "_pos")
            at = self.spark.createDataFrame([(self._name(f), v) for f, v in removed.items()], "_file string, _version bigint")
            old = self._located(sorted(removed)).join(gone, ["_file", "_pos"], "left_anti").join(at, "_file")
            parts.append(old.select("_version", F.lit(-1).alias("_change"), *self._stored(old)))
        return reduce(DataFrame.unionByName, parts)

    def changes(self, after: int, upto: int, keys: list[str], differs: "Differs") -> DataFrame:
        """``_version``, the keys and ``change_kind`` (new, changed) of each version in (after, upto]."""
        d = self.deltas(after, upto)
        cols = [c for c in d.columns if c not in ("_version", "_change", *keys)]
        side = lambda n: F.max(F.when(F.col("_change") == n, F.struct(F.lit(True).alias("_there"), *cols)))
        both = d.groupBy("_version", *keys).agg(side(1).alias("_new"), side(-1).alias("_old"))
        kind = F.when(F.col("_old").isNull(), "new").when(differs(F.col("_old"), F.col("_new")), "changed")
        return both.where("_new is not null").select("_version", *keys, kind.alias("change_kind")).where("change_kind is not null")


class Differs:
    """Do two states differ: in hash, or, where a hash is null or empty on either side, in another column."""

    def __init__(self, hash_col: str, others: list[str]):
        self.hash_col, self.others = hash_col, others

    def __call__(self, old: Column, new: Column) -> Column:
        a, b = F.nullif(old[self.hash_col], F.lit("")), F.nullif(new[self.hash_col], F.lit(""))
        other = F.lit(False)
        for c in self.others:
            other = other | ~old[c].eqNullSafe(new[c])
        return F.when(a.isNull() | b.isNull(), other).otherwise(a != b)


class DeltaSink:
    """A consumer's output: each commit holds a delta's files and the version processed, and counts only whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    def processed(self) -> int:
        done = [n for n in self.store.names("_commits") if n.endswith(".json")]
        return json.loads(self.store.read(f"_commits/{done[-1]}"))["processed_version"] if done else 0

    def append(self, delta: DataFrame, version: int, attempt: str) -> bool:
        """Writes the delta, then the commit that names it; False (and nothing) if the version was committed before."""
        if version <= self.processed():
            return False
        part = f"data/{version:012}-{attempt}"
        delta.write.mode("overwrite").parquet(f"{self.store.path}/{part}")
        return self.store.put_new(f"_commits/{version:012}.json", json.dumps({"processed_version": version, "part": part}))

    def read(self) -> DataFrame:
        parts = [json.loads(self.store.read(f"_commits/{n}"))["part"] for n in self.store.names("_commits") if n.endswith(".json")]
        return self.spark.read.parquet(*[f"{self.store.path}/{p}" for p in parts])


def process_new(table: VersionedTable, sink: DeltaSink, keys: list[str], differs: Differs, attempt: str, each: bool = True) -> list[int]:
    """Bring the sink up to the table's last version; the versions committed.

    One commit for each version, or, without ``each``, one for all that are new (its rows tell the versions apart).
    """
    done, there = [], table.versions()
    for v in there if each else there[-1:]:
        last = sink.processed()
        if v > last and sink.append(table.changes(last, v, keys, differs), v, attempt):
            done.append(v)
    return done


def versions_of_runs(runs: DataFrame, started: str) -> DataFrame:
    """The runs with ``_version``, their 1-based number in order of ``started`` (ties: of all columns); null starts are left out.

    One row a run, so that a single task orders them, however many records there are.
    """
    order = [started, *[c for c in runs.columns if c != started]]
    return runs.where(F.col(started).isNotNull()).withColumn("_version", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).cast("long"))


def with_version(rows: DataFrame, arrived: str, runs: DataFrame, started: str) -> DataFrame:
    """``rows`` with ``_v``: the version of the first run that started at or after the row's arrival; null after the last.

    An as-of join.  The runs become one row a day, with the day's runs and the first after it, so that a row meets
    only these; any number of runs will do.  ``runs`` are those of :func:`versions_of_runs`.
    """
    times = runs.where("_version is not null").select(F.col(started).alias("_s"), "_version")
    bounds = times.agg(F.to_date(F.min("_s")).alias("a"), F.to_date(F.max("_s")).alias("z")).first()
    if bounds["a"] is None:
        return rows.withColumn("_v", F.lit(None).cast("long"))
    days = rows.sparkSession.createDataFrame([(bounds["a"], bounds["z"])], "a date, z date").select(F.explode(F.sequence("a", "z")).alias("_day"))
    per = times.groupBy(F.to_date("_s").alias("_day")).agg(F.sort_array(F.collect_list(F.struct("_s", "_version"))).alias("_runs"))
    # the first run of a later day is what the days before it look forward to
    later = Window.partitionBy(F.lit(1)).orderBy("_day").rowsBetween(1, Window.unboundedFollowing)
    filled = days.join(per, "_day", "left").withColumn("_next", F.first(F.element_at("_runs", 1), ignorenulls=True).over(later))
    filled = filled.select("_day", F.array_compact(F.concat(F.coalesce("_runs", F.array().cast(per.schema["_runs"].dataType)), F.array("_next"))).alias("_runs"))
    met = rows.withColumn("_day", F.greatest(F.to_date(arrived), F.lit(bounds["a"]))).join(filled, "_day", "left")
    after = F.filter("_runs", lambda r: r["_s"] >= F.col(arrived))
    return met.withColumn("_v", F.get(after, F.lit(0))["_version"]).drop("_day", "_runs")
