"""Where documents come from: folders of files, tables, and key ranges of stored tables."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.common import plain
from tessera.functions import globs, text
from tessera.plans.settings import Filters, Settings


LARGEST = 2**31 - 1024  # what one value holds
READ_BYTES = 16 << 20  # bytes of files in one batch


def _spread_folders(root: bytes, enough: int) -> list[tuple[bytes, bool]]:
    """Folders below the root (relative) that tasks list: with all below them (True), or their own files alone."""
    own, pending = [], [b""]
    while pending and len(pending) < enough:
        at = pending.pop(0)
        own.append((at, False))
        try:
            with os.scandir(os.path.join(root, at)) as entries:
                pending += sorted(os.path.join(at, e.name) for e in entries if e.is_dir(follow_symlinks=False))
        except OSError:
            if not at:
                raise
    return own + [(at, True) for at in pending]


def list_folder(spark: SparkSession, root: str) -> DataFrame:
    """``rel_path``, ``size``, ``modified_time`` (microseconds) and ``path`` (the name's bytes) of every file below the folder.

    Whatever the names are: hidden files and those that begin with ``_`` count.  Links to files count, links to
    folders are not followed; folders that cannot be read are left out.  Tasks share the folders.
    """
    base = os.fsencode(os.path.abspath(root))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder, deep in zip(batch["folder"], batch["deep"]):
                for at, dirs, names in os.walk(os.path.join(base, folder)):
                    rows = []
                    for name in names:
                        path = os.path.join(at, name)
                        try:
                            info = os.stat(path)
                        except OSError:
                            continue
                        if stat.S_ISREG(info.st_mode):
                            path = os.path.relpath(path, base)
                            rows.append((path.decode("utf-8", "replace"), info.st_size, info.st_mtime_ns // 1000, path))
                    yield plain(pd.DataFrame(rows, columns=["rel_path", "size", "modified_time", "path"]))
                    if not deep:
                        break

    folders = _spread_folders(base, 4 * spark.sparkContext.defaultParallelism)
    shared = spark.createDataFrame(folders, "folder binary, deep boolean").repartition(min(len(folders), 4 * spark.sparkContext.defaultParallelism))
    return shared.mapInPandas(run, "rel_path string, size long, modified_time long, path binary")


def read_files(files: DataFrame, root: str) -> DataFrame:
    """``rel_path``, ``size``, ``modified_time``, ``bytes`` of files as ``list_folder`` gives them.

    Files that are gone by now or must not be read are left out; ``bytes`` is null beyond LARGEST.
    """
    base = os.fsencode(os.path.abspath(root))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["rel_path", "size", "modified_time", "bytes"]
        for batch in batches:
            rows, held = [], 0
            for rel_path, path in zip(batch["rel_path"], batch["path"]):
                try:
                    with open(os.path.join(base, path), "rb") as f:
                        info = os.fstat(f.fileno())
                        body = f.read() if info.st_size <= LARGEST else None
                except (FileNotFoundError, PermissionError):
                    continue
                rows.append((rel_path, info.st_size if body is None else len(body), info.st_mtime_ns // 1000, body))
                held += len(body or b"")
                if held >= READ_BYTES:
                    yield plain(pd.DataFrame(rows, columns=columns))
                    rows, held = [], 0
            yield plain(pd.DataFrame(rows, columns=columns))

    return files.select("rel_path", "path").mapInPandas(run, "rel_path string, size long, modified_time long, bytes binary")


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """``rel_path``, ``size``, ``modified_time`` (microseconds), ``bytes`` of every file below the folder, see ``list_folder``."""
    return read_files(list_folder(spark, root).repartition(4 * spark.sparkContext.defaultParallelism), root)


def ignore_files(root: str) -> tuple[dict[str, list[str]], list[str]]:
    """The ignore files below a folder by their folder, and the folders that are repository roots."""
    rules, repos = {}, []
    for folder, dirs, names in os.walk(root):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel
        if ".git" in dirs or ".git" in names:
            repos.append(rel)
        dirs[:] = [d for d in dirs if d != ".git"]
        if ".gitignore" in names:
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                rules[rel] = f.read().splitlines()
    return rules, repos


def wanted_files(files: DataFrame, filters: Filters, root: str | None = None) -> DataFrame:
    """The files a workspace indexes: no binary extension, not excluded (by ignore files or the list), included.

    An empty include list includes nothing.
    """
    path = F.col("rel_path")
    kept = files.where(text.indexable(path) & globs.listed_column(globs.parse_rules(filters.include), path, False))
    if filters.use_git_ignore:
        rules, repos = ignore_files(root) if root else ({}, [])
        return globs.git_ignored(kept, "rel_path", rules, repos).where("not ignored").drop("ignored")
    return kept.where(~globs.excluded_with_folders(globs.parse_rules(filters.customized), path))


# Types by extension, for files whose type no header tells.
_MIME = {".json": "application/json", ".xml": "application/xml", ".js": "application/javascript", ".html": "text/html", ".css": "text/css", ".txt": "text/plain", ".md": "text/markdown", ".csv": "text/csv"}


def guessed_mime(path: Column) -> Column:
    ext, out = text.extension(path), None
    for e, mime in _MIME.items():
        out = F.when(ext == e, mime) if out is None else out.when(ext == e, mime)
    return out.otherwise("application/octet-stream")


def parsed_files(files: DataFrame, workspace_path: str, settings: Settings) -> DataFrame:
    """Files as documents: id, path, size, hash, time, content and words; content that is no text is left out.

    A file above the size limit stays, with no content and no words.
    """
    small = F.col("size") <= settings.max_file_size
    content = F.when(small, F.decode("bytes", "UTF-8"))
    docs = files.where(~small | text.likely_text(F.col("bytes"), guessed_mime(F.col("rel_path"))))
    return docs.select(
        text.document_id(F.lit(workspace_path), F.col("rel_path")).alias("doc_id"), "rel_path", "size", F.when(small, text.content_hash(F.col("bytes"))).otherwise("").alias("hash"),
        "modified_time", content.alias("content"), F.when(small, text.words(content)).otherwise(F.array().cast("array<string>")).alias("words"),
    )


def point_get(table: DataFrame, column: str, key) -> DataFrame:
    return table.where(F.col(column) == F.lit(key))


def prefix_scan(table: DataFrame, column: str, prefix: str) -> DataFrame:
    return table.where(F.col(column).startswith(prefix))


def prefix_delete(table: DataFrame, column: str, prefix: str) -> DataFrame:
    """The table without the rows of ``prefix_scan``; null keys stay."""
    return table.where(~F.coalesce(F.col(column).startswith(prefix), F.lit(False)))


def range_scan(table: DataFrame, column: str, begin, end) -> DataFrame:
    """begin <= key < end."""
    return table.where((F.col(column) >= F.lit(begin)) & (F.col(column) < F.lit(end)))


def document_get(documents: DataFrame, ids: DataFrame) -> DataFrame:
    return documents.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def scan_paths(docs: DataFrame) -> DataFrame:
    """Id and path of every document; nothing else is read."""
    return docs.select("doc_id", "rel_path")


def document_json(docs: DataFrame, id_col: str) -> DataFrame:
    """The id and the other columns as one JSON value, ``json``; fields without a value are left out."""
    return docs.select(id_col, F.to_json(F.struct(*[c for c in docs.columns if c != id_col])).alias("json"))


def document_of_json(rows: DataFrame, id_col: str, schema: str) -> DataFrame:
    """The id and the fields of ``json``; a field that is missing, or a value that is no JSON, gives null."""
    return rows.select(id_col, F.from_json("json", schema).alias("_d")).select(id_col, "_d.*")
