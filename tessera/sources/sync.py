"""Workspaces and their folders: full sync, sync if needed, and removal, over the catalogue and a workspace's index."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.common import written
from tessera.functions import text
from tessera.plans.settings import Settings
from tessera.sources import corpus
from tessera.sources.catalog import Catalog
from tessera.streaming.ingest import BucketedIndex


def _changes(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"op": F.lit("upsert"), "seq": F.lit(1)})


def _deletes(ids: DataFrame) -> DataFrame:
    """Change rows that delete the documents of the ids."""
    kept = ids.select("doc_id").distinct()
    empty = {"rel_path": "string", "size": "bigint", "hash": "string", "modified_time": "bigint", "content": "string"}
    return kept.withColumns({c: F.lit(None).cast(t) for c, t in empty.items()} | {"op": F.lit("delete"), "seq": F.lit(1)})


def sync(catalog: Catalog, target: BucketedIndex, path: str, settings: Settings) -> dict:
    """Bring a workspace's index (its own) to what its folder holds; the catalogue row.

    Only files whose time or size is not that of the stored document are read; files that are gone, no longer
    wanted or no longer text are deleted; the row's total_files is the number of wanted files.
    """
    path = catalog.get(path)["path"]
    listed = corpus.wanted_files(corpus.list_folder(catalog.spark, path), catalog.filters(path, settings), path)
    listed = written(listed.withColumn("doc_id", text.document_id(F.lit(path), F.col("rel_path"))), "listing")
    stored = target.documents().select("doc_id", "modified_time", "size", "hash")
    same = listed.join(stored, ["doc_id", "modified_time", "size"], "left_semi").select("doc_id")
    parsed = corpus.parsed_files(corpus.read_files(listed.join(same, "doc_id", "left_anti"), path), path, settings)
    parsed = written(parsed.drop("words"), "parsed")
    gone = stored.join(same.unionByName(parsed.select("doc_id")), "doc_id", "left_anti")
    changes = _changes(parsed).unionByName(_deletes(gone))
    if not changes.isEmpty():
        target.apply(changes)
    return catalog.synced(path, listed.count())


def sync_if_needed(catalog: Catalog, target: BucketedIndex, path: str, settings: Settings) -> dict:
    """A full sync where there has been none."""
    row = catalog.get(path)
    return row if row["last_full_sync_time"] else sync(catalog, target, path, settings)


def add_file(catalog: Catalog, target: BucketedIndex, path: str, rel_path: str, settings: Settings) -> bool:
    """Read one file of a workspace and upsert its document; False where it is gone, not wanted or no text.  Counts nothing."""
    path = catalog.get(path)["path"]
    name = os.fsencode(rel_path)
    try:
        info = os.stat(os.path.join(os.fsencode(path), name))
    except OSError:
        return False
    one = catalog.spark.createDataFrame([(rel_path, info.st_size, info.st_mtime_ns // 1000, bytearray(name))], "rel_path string, size long, modified_time long, path binary")
    wanted = corpus.wanted_files(one, catalog.filters(path, settings), path)
    parsed = written(corpus.parsed_files(corpus.read_files(wanted, path), path, settings).drop("words"), "parsed")
    if parsed.isEmpty():
        return False
    target.apply(_changes(parsed))
    return True


def remove_file(catalog: Catalog, target: BucketedIndex, path: str, rel_path: str) -> dict:
    """Delete one file's document and count it off; a file that the index does not hold changes nothing."""
    row = catalog.get(path)
    held = target.documents().where(F.col("doc_id") == text.document_id(F.lit(row["path"]), F.lit(rel_path)))
    if held.isEmpty():
        return row
    target.apply(_deletes(held))
    return catalog.counted(row["path"], -1)


def delete_workspace(catalog: Catalog, target: BucketedIndex, path: str) -> dict:
    """Delete all documents of a workspace's index (and with them its postings), then its row."""
    row = catalog.get(path)
    held = target.documents()
    if not held.isEmpty():
        target.apply(_deletes(held))
    return catalog.delete(row["path"])
