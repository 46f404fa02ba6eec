"""Evaluation of the boolean grammar over lines: NOT excludes, a phrase is literal, ``*`` is a prefix."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.content import lines
from tessera.plans.grammar import Or, Term


def _term(t: Term, line: Column) -> Column:
    if t.quoted:
        hit = F.lower(line).contains(t.text.lower())
    else:
        word = re.sub(r"([^\w])", r"\\\1", t.text)
        hit = line.rlike(rf"(?i)(^|[^a-zA-Z0-9_]){word}" + ("" if t.wildcard else "([^a-zA-Z0-9_]|$)"))
    return ~hit if t.negated else hit


def line_condition(query: Or, line: Column) -> Column:
    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (_term(t, line) for t in part.terms)) for part in query.parts))


def matching_lines(documents: DataFrame, query: Or) -> DataFrame:
    """``doc_id``, ``rel_path``, ``line_number``, ``content`` of the lines for which the query holds."""
    rows = documents.select("doc_id", "rel_path", F.posexplode(lines(F.col("content"))).alias("_i", "content"))
    return rows.where(line_condition(query, F.col("content"))).select("doc_id", "rel_path", (F.col("_i") + 1).alias("line_number"), "content")
