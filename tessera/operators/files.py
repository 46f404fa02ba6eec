"""File search: fuzzy matches of a pattern over relative paths, ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import fuzzy

MIN_SCORE = 50


def fuzzy_files(documents: DataFrame, query: str) -> DataFrame:
    """``rel_path`` and ``score`` of every path that holds the query's characters in order and scores above 50.

    Blanks in the query do not count; a query of blanks matches everything with 100.
    """
    pattern = query.replace(" ", "")
    paths = documents.select("rel_path").where(fuzzy.subsequence(F.col("rel_path"), pattern))
    return paths.withColumn("score", fuzzy.fuzzy_score(F.col("rel_path"), pattern)).where(F.col("score") > MIN_SCORE)


def search_files(documents: DataFrame, query: str, limit: int) -> DataFrame:
    """The best paths in order of score, byte length and path; a limit of 0 or less gives one."""
    found = fuzzy_files(documents, query)
    return found.orderBy(F.desc("score"), F.octet_length("rel_path"), "rel_path").limit(max(1, limit))


def existing(found: DataFrame, listing: DataFrame) -> DataFrame:
    """Only paths that the current listing still has."""
    return found.join(listing.select("rel_path").distinct(), "rel_path", "left_semi")
