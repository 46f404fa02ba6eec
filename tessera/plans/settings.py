"""Settings of search and indexing, their defaults and their limits."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

# The patterns a workspace without filters of its own includes and excludes.
DEFAULT_INCLUDE = ["**/*"]
DEFAULT_EXCLUDE = ["node_modules/", "dist/", "build/", "vendor/", "out/", "obj/", "log/", "logs/", ".*", "*.log", "*.log.*"]


@dataclass(frozen=True)
class Limit:
    max_results: int = 0
    max_results_per_file: int = 0
    max_files_results: int = 0


@dataclass(frozen=True)
class Filters:
    include: list[str] = field(default_factory=list)
    use_git_ignore: bool = False
    customized: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Settings:
    max_file_size: int = 2 * 1024 * 1024
    index_workers: int = 4
    port: int = 13134
    max_wildcard_length: int = 24
    max_keyword_distance: int = 32
    limit: Limit = Limit(5000, 500, 1000)
    client_limit: Limit = Limit(500, 50, 100)
    default_workspace: str = ""
    filters: Filters = field(default_factory=lambda: Filters(list(DEFAULT_INCLUDE), False, list(DEFAULT_EXCLUDE)))


def _within(value: int, most: int, default: int) -> int:
    return value if 0 < value <= most else default


def checked(s: Settings, cpus: int | None = None) -> Settings:
    """The settings with every value that is out of its range at its default."""
    d, cpus = Settings(), cpus or os.cpu_count() or 1
    limit = Limit(
        _within(s.limit.max_results, d.limit.max_results, d.limit.max_results),
        _within(s.limit.max_results_per_file, d.limit.max_results_per_file, d.limit.max_results_per_file),
        _within(s.limit.max_files_results, d.limit.max_files_results, d.limit.max_files_results),
    )
    client = Limit(
        _within(s.client_limit.max_results, limit.max_results, d.client_limit.max_results),
        _within(s.client_limit.max_results_per_file, limit.max_results_per_file, d.client_limit.max_results_per_file),
        _within(s.client_limit.max_files_results, d.limit.max_files_results, d.limit.max_files_results),
    )
    return replace(
        s, limit=limit, client_limit=client, max_file_size=s.max_file_size if s.max_file_size > 0 else d.max_file_size, index_workers=_within(s.index_workers, cpus, cpus),
        port=_within(s.port, 65535, d.port), max_wildcard_length=_within(s.max_wildcard_length, 64, d.max_wildcard_length), max_keyword_distance=_within(s.max_keyword_distance, 128, d.max_keyword_distance),
    )


def from_mapping(m: dict) -> Settings:
    """Settings from the nested mapping of a configuration file; what is missing keeps its default."""
    g, c, v = m.get("global") or {}, m.get("client") or {}, m.get("server") or {}
    q, f, d = v.get("search") or {}, v.get("filters") or {}, Settings()
    lim = lambda x, dflt: Limit(**{**dflt.__dict__, **{k: int(n) for k, n in (x or {}).items() if k in dflt.__dict__}})
    ex = f.get("exclude") or {}
    filters = Filters(f.get("include") or list(DEFAULT_INCLUDE), bool(ex.get("use_git_ignore", False)), ex.get("customized") or list(DEFAULT_EXCLUDE)) if f else d.filters
    return checked(Settings(
        int(v.get("max_file_size", d.max_file_size)), int(v.get("index_workers", d.index_workers)), int(g.get("port", d.port)), int(q.get("max_wildcard_length", d.max_wildcard_length)),
        int(q.get("max_keyword_distance", d.max_keyword_distance)), lim(q.get("limit"), d.limit), lim(c.get("default_limit"), d.client_limit), str(c.get("default_workspace") or ""), filters,
    ))


def load(folder: str) -> Settings:
    """From the first of config.local.yaml and config.yaml in the folder; defaults where there is neither."""
    for name in ("config.local.yaml", "config.yaml"):
        path = os.path.join(folder, name)
        if os.path.exists(path):
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError("reading YAML needs the yaml package") from e
            with open(path, encoding="utf-8") as f:
                return from_mapping(yaml.safe_load(f) or {})
    return checked(Settings())


def negotiated(server: Limit, asked: Limit | None) -> Limit:
    """A request's limits count only where they are positive and below the server's."""
    pick = lambda have, want: want if 0 < want < have else have
    if asked is None:
        return server
    return Limit(pick(server.max_results, asked.max_results), pick(server.max_results_per_file, asked.max_results_per_file), server.max_files_results)


def workspace_filters(own: Filters | None, use_global: bool, general: Filters) -> Filters:
    """A workspace's filters: the general ones unless it has its own; an empty part falls back to the general part."""
    if own is None or use_global:
        return general
    customized = own.customized if own.use_git_ignore or own.customized else general.customized
    return Filters(own.include or general.include, own.use_git_ignore, customized)
