"""The path pattern language: ignore-style rules with ``*``, ``?``, classes and ``**``, compiled to regular expressions.

A path is matched with a ``/`` behind it; each segment of a pattern becomes an expression that ends in ``/`` and
``**`` any number of segments.  Rules without a leading ``/`` may match from any segment on.  Case never counts.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEVER = r"(?!)"
MAX_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    regex: str
    negated: bool
    dir_only: bool

    @property
    def java(self) -> str:
        return f"(?is){self.regex}"


def _segment(seg: str) -> str:
    """One segment to an expression; NEVER where the pattern is malformed."""
    out, k = [], 0
    while k < len(seg):
        ch = seg[k]
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "\\":
            k += 1
            if k >= len(seg):
                return NEVER
            out.append(_quote(seg[k]))
        elif ch == "[":
            k += 1
            negated = k < len(seg) and seg[k] == "^"
            k += negated
            items, first = [], True
            while True:
                if k >= len(seg):
                    return NEVER
                if seg[k] == "]" and not first:
                    break
                low, k = _class_char(seg, k)
                if low is None:
                    return NEVER
                high = low
                if k < len(seg) and seg[k] == "-":
                    high, k = _class_char(seg, k + 1)
                    if high is None:
                        return NEVER
                # a class never matches the separator
                ranges = [(low, min(high, ".")), (max(low, "0"), high)] if low <= "/" <= high else [(low, high)]
                items += [f"{_in_class(a)}-{_in_class(b)}" for a, b in ranges if a <= b]
                first = False
            body = "".join(items)
            out.append((f"[^/{body}]" if negated else f"[{body}]") if body else ("[^/]" if negated else NEVER))
        else:
            out.append(_quote(ch))
        k += 1
    return "".join(out)


def _class_char(seg: str, k: int) -> tuple[str | None, int]:
    if k >= len(seg) or seg[k] in "-]":
        return None, k
    if seg[k] == "\\":
        return (seg[k + 1], k + 2) if k + 1 < len(seg) else (None, k)
    return seg[k], k + 1


def _quote(ch: str) -> str:
    return "\\" + ch if ch in r".^$*+?()[]{}|\\-&~#" else ch


def _in_class(ch: str) -> str:
    return "\\" + ch if ch in r"[]\^-&~|" else ch


def parse_rule(line: str) -> Rule | None:
    """A rule; None for a blank line or a comment."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:].strip()
    root = line.startswith("/")
    line = line[root:]
    dir_only = line.endswith("/")
    if dir_only:
        line = line[:-1]
    if line == "**":
        body = ".*"
    else:
        body = "".join("(?:[^/]+/)*" if seg == "**" else _segment(seg) + "/" for seg in line.split("/"))
    return Rule(("^" if root else "^(?:.*/)?") + body + "$", negated, dir_only)


def parse_rules(lines: Iterable[str]) -> list[Rule]:
    return [r for line in lines for part in line.split("\n") if (r := parse_rule(part))]


@lru_cache(maxsize=4096)
def _compiled(regex: str) -> re.Pattern:
    return re.compile(regex, re.I | re.S)


def rule_matches(rule: Rule, path: str, is_dir: bool) -> bool:
    return (is_dir or not rule.dir_only) and bool(_compiled(rule.regex).match(path + "/"))


def listed(rules: list[Rule], path: str, is_dir: bool) -> bool:
    """Is the path in the list: the last rule that matches decides."""
    for rule in reversed(rules):
        if rule_matches(rule, path, is_dir):
            return not rule.negated
    return False


def listed_column(rules: list[Rule], path: Column, is_dir: bool) -> Column:
    """The same as a column, one expression inside code generation."""
    target = F.concat(path, F.lit("/"))
    out: Column | None = None
    for rule in reversed(rules):
        if rule.dir_only and not is_dir:
            continue
        hit = target.rlike(rule.java)
        out = F.when(hit, F.lit(not rule.negated)) if out is None else out.when(hit, F.lit(not rule.negated))
    return F.lit(False) if out is None else out.otherwise(F.lit(False))


def ancestors(path: Column) -> Column:
    """All folders above a relative path, from the top."""
    parts = F.split(path, "/")
    return F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def excluded_with_folders(rules: list[Rule], path: Column) -> Column:
    """Excluded itself, or inside an excluded folder (which is not descended into)."""
    return F.exists(ancestors(path), lambda a: listed_column(rules, a, True)) | listed_column(rules, path, False)


class IgnoreTree:
    """Ignore files of a folder tree: ``rules`` by folder ("" is the root), ``repos`` the folders that are repository roots."""

    def __init__(self, rules: dict[str, list[str]], repos: Iterable[str] = ()):
        self.rules = {d.strip("/"): parse_rules(lines) for d, lines in rules.items()}
        if sum(map(len, self.rules.values())) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        self.repos = {d.strip("/") for d in repos}
        self._folders: dict[str, bool] = {}

    @staticmethod
    def _relative(path: str, base: str) -> str:
        return posixpath.relpath(path, base) if base else path

    def ignored(self, path: str, is_dir: bool) -> bool:
        path = posixpath.normpath(path) if path else ""
        if path in ("", ".") or path.startswith(".."):
            return False
        if is_dir and path in self._folders:
            return self._folders[path]
        name = posixpath.basename(path).lower()
        if name == (".git" if is_dir else ".gitignore"):
            return True
        folder, levels = path if is_dir else posixpath.dirname(path), []
        while folder:
            levels.append(folder)
            folder = posixpath.dirname(folder)
        levels.append("")
        answer = self._decide(path, is_dir, levels)
        if is_dir:
            self._folders[path] = answer
        return answer

    def _decide(self, path: str, is_dir: bool, levels: list[str]) -> bool:
        for folder in levels:
            if any(r.negated and rule_matches(r, self._relative(path, folder), is_dir) for r in self.rules.get(folder, ())):
                return False
            if folder in self.repos:
                break
        parent = posixpath.dirname(path)
        if parent and self.ignored(parent, True):
            return True
        return any(listed(self.rules[folder], self._relative(path, folder), is_dir) for folder in levels if folder in self.rules)


def git_ignored(df: DataFrame, path_col: str, rules: dict[str, list[str]], repos: Iterable[str] = ()) -> DataFrame:
    """Adds ``ignored``.  The rules (at most MAX_RULES) travel with the function; folders are decided once per task."""
    repos = list(repos)
    IgnoreTree(rules, repos)  # checks the bound here, not in a task

    @F.pandas_udf("boolean")
    def decide(paths: pd.Series) -> pd.Series:
        tree = IgnoreTree(rules, repos)
        return paths.map(lambda p: None if p is None else tree.ignored(p, False))

    return df.withColumn("ignored", decide(F.col(path_col)))


def normal_path(path: str) -> str:
    """Cleaned, with forward slashes and an upper-case drive letter."""
    path = posixpath.normpath(path.replace("\\", "/")) if path else "."
    return path[0].upper() + path[1:] if len(path) > 1 and path[1] == ":" else path


Matcher = Callable[[str, bool], bool]
