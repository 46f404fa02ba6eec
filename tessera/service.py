"""Requests over workspaces: the catalogue, an index for each workspace, and the answers as dictionaries.

``Service`` is what a transport would call: each method takes a request's fields and gives ``code``, ``message`` and
data.  It validates as far as a request can be wrong; what the operators raise is answered, not thrown.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.engine import ContentRequest, Engine
from tessera.functions import text
from tessera.functions.globs import normal_path
from tessera.plans.settings import Filters, Settings
from tessera.sources import sync
from tessera.sources.catalog import Catalog, CatalogError, is_absolute
from tessera.streaming.ingest import BucketedIndex

# Messages of answers.
OK, DELETED, EXISTS, NOT_FOUND = "Ok", "Deleted", "Workspace already exists", "Not found"
NO_WORKSPACE, NOT_ABSOLUTE, NO_PATH, PATH_NOT_ABSOLUTE = "Workspace is required", "Workspace is not absolute", "Workspace path is required", "Workspace path must be absolute"
NOT_CREATED, NOT_DELETED = "Failed to create workspace: ", "Failed to delete workspace: "


def _answer(code: int = 0, message: str = OK, **data) -> dict:
    return {"code": code, "message": message} | data


class Service:
    """Workspaces below one folder: ``catalog`` and ``index-<id>``."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, buckets: int = 64):
        self.spark, self.root, self.settings, self.buckets = spark, root.rstrip("/"), settings or Settings(), buckets
        self.catalog = Catalog(spark, f"{self.root}/catalog")

    def index(self, path: str) -> BucketedIndex:
        """The index of a workspace (one of its own)."""
        return BucketedIndex(self.spark, f"{self.root}/index-{self.catalog.get(path)['id']}", self.buckets)

    def health(self) -> dict:
        """Alive, and the session's version."""
        return _answer(version=self.spark.version)

    # ------------------------------------------------------------ searches

    def _refused(self, workspace: str) -> dict | None:
        if not workspace:
            return _answer(1, NO_WORKSPACE)
        if not is_absolute(normal_path(workspace)):
            return _answer(1, NOT_ABSOLUTE)
        try:
            self.catalog.get(workspace)
        except CatalogError as e:
            return _answer(1, str(e))
        return None

    def engine(self, workspace: str, refresh: bool = False) -> Engine:
        """The search engine of a workspace; ``refresh`` brings its index up to its folder first."""
        if refresh:
            sync.sync(self.catalog, self.index(workspace), workspace, self.settings)
        return Engine(self.index(workspace).documents(), None, self.settings, self.catalog.filters(workspace, self.settings))

    def search_content(self, workspace: str, request: ContentRequest, refresh: bool = False) -> dict:
        """``data`` with the results by file.  A path inside the workspace may be given whole; it is taken relative to it."""
        if refused := self._refused(workspace):
            return refused
        if request.path and is_absolute(normal_path(request.path)):
            root, inside = normal_path(workspace), normal_path(request.path)
            if inside != root and not inside.startswith(root + "/"):
                return _answer(data={})
            request = replace(request, path=inside[len(root) :].strip("/"))
        return self.engine(workspace, refresh).content_response(request)

    def search_files(self, workspace: str, query: str, limit: int, refresh: bool = False) -> dict:
        return self._refused(workspace) or self.engine(workspace, refresh).files_response(query, min(limit, self.settings.limit.max_files_results))

    # ------------------------------------------------------------ workspaces

    def create_workspace(self, path: str, filters: Filters | None = None, use_global: bool = True) -> dict:
        """Makes and syncs a workspace; one that exists is answered with code 0 and left as it is."""
        try:
            return _answer(0, EXISTS, workspace=self.catalog.get(path))
        except CatalogError:
            pass
        try:
            self.catalog.create(path, filters, use_global)
            return _answer(workspace=sync.sync(self.catalog, self.index(path), path, self.settings))
        except Exception as e:  # noqa: BLE001 - a request is answered whatever goes wrong
            return _answer(1, f"{NOT_CREATED}{e}")

    def update_workspace(self, path: str, filters: Filters | None, use_global: bool) -> dict:
        """New filters; they hold from the next sync on."""
        return self._refused(path) or _answer(workspace=self.catalog.update(path, filters, use_global))

    def delete_workspace(self, path: str) -> dict:
        """The workspace's documents and postings go with it."""
        if not path:
            return _answer(1, NO_PATH)
        if not is_absolute(normal_path(path)):
            return _answer(2, PATH_NOT_ABSOLUTE)
        try:
            sync.delete_workspace(self.catalog, self.index(path), path)
        except Exception as e:  # noqa: BLE001
            return _answer(3, f"{NOT_DELETED}{e}")
        return _answer(0, DELETED)

    def list_workspaces(self) -> dict:
        return _answer(workspaces=[r.asDict(recursive=True) for r in self.catalog.list().collect()])

    def get_workspace(self, path: str) -> dict:
        try:
            row = self.catalog.get(path)
        except CatalogError:
            return _answer(1, NOT_FOUND)
        return _answer(workspace=row | {"indexed_files": self.index(path).documents().count()})

    def sync_workspace(self, path: str, if_needed: bool = False) -> dict:
        if refused := self._refused(path):
            return refused
        return _answer(workspace=(sync.sync_if_needed if if_needed else sync.sync)(self.catalog, self.index(path), path, self.settings))

    def sync_all(self) -> dict:
        """Each workspace in order; one that fails is reported and does not stop the others."""
        failed = {}
        for row in self.list_workspaces()["workspaces"]:
            try:
                sync.sync(self.catalog, self.index(row["path"]), row["path"], self.settings)
            except Exception as e:  # noqa: BLE001
                failed[row["path"]] = str(e)
        return _answer(1 if failed else 0, OK if not failed else "; ".join(f"{k}: {v}" for k, v in failed.items()))

    # ------------------------------------------------------------ documents

    def _document(self, workspace: str, rel_path: str):
        return self.index(workspace).documents().where(F.col("doc_id") == text.document_id(F.lit(self.catalog.get(workspace)["path"]), F.lit(rel_path)))

    def update_document(self, workspace: str, rel_path: str) -> dict:
        """One file read again: added (and counted), replaced, or, if it is gone or not wanted, removed."""
        if refused := self._refused(workspace):
            return refused
        before = not self._document(workspace, rel_path).isEmpty()
        there = sync.add_file(self.catalog, self.index(workspace), workspace, rel_path, self.settings)
        if not there:
            return self.delete_document(workspace, rel_path) if before else _answer()
        if not before:
            self.catalog.counted(workspace, 1)
        return _answer()

    def delete_document(self, workspace: str, rel_path: str) -> dict:
        if refused := self._refused(workspace):
            return refused
        sync.remove_file(self.catalog, self.index(workspace), workspace, rel_path)
        return _answer()
