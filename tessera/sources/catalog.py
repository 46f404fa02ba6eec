"""The catalogue of workspaces: a small table, one row each, rewritten as a whole with every change."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.globs import normal_path
from tessera.operators.versions import Store
from tessera.plans.settings import Filters, Settings, workspace_filters

SCHEMA = """id string, path string, use_global_filters boolean, filters struct<include: array<string>, exclude: struct<use_git_ignore: boolean, customized: array<string>>>,
total_files int, created_time timestamp, last_accessed_time timestamp, last_full_sync_time timestamp"""


class CatalogError(ValueError):
    pass


def is_absolute(path: str) -> bool:
    return path.startswith("/") or (len(path) > 2 and path[1:3] == ":/")


class Catalog:
    """Each change writes the next numbered state; of two writers with the same number one fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    def _state(self) -> tuple[int, dict[str, dict]]:
        names = [n for n in self.store.names("") if n.endswith(".json")]
        return (int(names[-1][:-5]), json.loads(self.store.read(names[-1]))) if names else (0, {"next_id": 1, "rows": {}})

    def _change(self, edit) -> dict:
        number, state = self._state()
        row = edit(state)
        if not self.store.put_new(f"{number + 1:012}.json", json.dumps(state)):
            raise CatalogError("the catalogue was changed by another writer")
        return row

    def list(self) -> DataFrame:
        """All workspaces in order of their number; rows that lack an id or a path are left out."""
        rows = [r for r in self._state()[1]["rows"].values() if r.get("id") and r.get("path")]
        return in_order(self.spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").select(F.from_json("value", SCHEMA).alias("r")).select("r.*"))

    def get(self, path: str) -> dict:
        path = normal_path(path)
        for r in self._state()[1]["rows"].values():
            if r["path"] == path:
                return r
        raise CatalogError("workspace not found")

    def create(self, path: str, filters: Filters | None = None, use_global: bool = True) -> dict:
        path = normal_path(path)
        if not is_absolute(path):
            raise CatalogError("workspace path must be absolute")

        def edit(state: dict) -> dict:
            if any(r["path"] == path for r in state["rows"].values()):
                raise CatalogError("workspace already exists")
            now = datetime.now(timezone.utc).isoformat()
            row = {"id": str(state["next_id"]), "path": path, "use_global_filters": use_global, "filters": _plain(filters), "total_files": 0, "created_time": now, "last_accessed_time": now, "last_full_sync_time": None}
            state["next_id"] += 1
            state["rows"][row["id"]] = row
            return row

        return self._change(edit)

    def update(self, path: str, filters: Filters | None, use_global: bool) -> dict:
        found = self.get(path)
        return self._set(found["id"], filters=_plain(filters), use_global_filters=use_global)

    def synced(self, path: str, total_files: int) -> dict:
        return self._set(self.get(path)["id"], total_files=total_files, last_full_sync_time=datetime.now(timezone.utc).isoformat())

    def counted(self, path: str, more: int) -> dict:
        """The row with so many files more (or fewer) than before."""
        id_ = self.get(path)["id"]

        def edit(state: dict) -> dict:
            row = state["rows"][id_]
            row["total_files"] = max(0, row["total_files"] + more)
            return row

        return self._change(edit)

    def ensure(self, path: str, filters: Filters | None = None, use_global: bool = True) -> dict:
        """The row of the path, made if there is none."""
        try:
            return self.get(path)
        except CatalogError:
            return self.create(path, filters, use_global)

    def delete(self, path: str) -> dict:
        """Takes the row away; ``sync.delete_workspace`` its documents as well."""
        found = self.get(path)
        return self._change(lambda state: state["rows"].pop(found["id"]))

    def _set(self, id_: str, **values) -> dict:
        def edit(state: dict) -> dict:
            state["rows"][id_].update(values)
            return state["rows"][id_]

        return self._change(edit)

    def filters(self, path: str, settings: Settings) -> Filters:
        row = self.get(path)
        f = row["filters"]
        own = None if f is None else Filters(f["include"], f["exclude"]["use_git_ignore"], f["exclude"]["customized"])
        return workspace_filters(own, row["use_global_filters"], settings.filters)


def _plain(f: Filters | None) -> dict | None:
    return None if f is None else {"include": list(f.include), "exclude": {"use_git_ignore": f.use_git_ignore, "customized": list(f.customized)}}


def resolved_filters(workspaces: DataFrame, settings: Settings) -> DataFrame:
    """Workspaces with their effective ``include``, ``use_git_ignore`` and ``customized``, as columns."""
    g = settings.filters
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    general = F.col("filters").isNull() | F.coalesce("use_global_filters", F.lit(False))
    own_git = F.coalesce("filters.exclude.use_git_ignore", F.lit(False))
    own_list, own_include = F.col("filters.exclude.customized"), F.col("filters.include")
    empty = lambda c: c.isNull() | (F.size(c) == 0)
    return workspaces.select(
        "id", "path", F.when(general | empty(own_include), lit(g.include)).otherwise(own_include).alias("include"),
        F.when(general, F.lit(g.use_git_ignore)).otherwise(own_git).alias("use_git_ignore"),
        F.when(general | (~own_git & empty(own_list)), lit(g.customized)).otherwise(own_list).alias("customized"),
    )


def in_order(workspaces: DataFrame) -> DataFrame:
    """Workspaces in order of their number."""
    return workspaces.orderBy(F.col("id").try_cast("int"), "id")


def counters(files: DataFrame, workspaces: DataFrame) -> DataFrame:
    """``workspace_id``, ``indexed`` (different files held) and the catalogue's ``total_files`` of each workspace that has files."""
    held = files.select("workspace_id", "doc_id").distinct().groupBy("workspace_id").agg(F.count(F.lit(1)).alias("indexed"))
    return held.join(workspaces.select(F.col("id").alias("workspace_id"), "total_files"), "workspace_id", "left")
