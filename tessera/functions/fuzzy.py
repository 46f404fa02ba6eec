"""The score of a fuzzy file search, 0 to 100, as one native expression.

The pattern's characters are found greedily from the left in the lower-case text; the score grows with the
share of the text, the consecutive hits, their density, a start near the beginning or behind a delimiter, and a
match of the file name.  Positions count bytes: the text's UTF-8 bytes are read as characters one by one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DELIMITERS = "_- ./\\"


def subsequence(path: Column, pattern: str) -> Column:
    """The pattern's characters occur in this order (case counts)."""
    return path.rlike("(?s)" + ".*".join(re.sub(r"([^\w\s])", r"\\\1", ch) for ch in pattern)) if pattern else F.lit(True)


def _bytes(text: Column) -> Column:
    return F.decode(F.encode(F.lower(text), "UTF-8"), "ISO-8859-1")


def _partial(pattern: str, text: Column) -> Column:
    """The part of the score that does not look at the file name; null if a character is not found."""
    low = pattern.lower()
    n = len(low.encode())
    chars = F.array(*[F.lit(ch) for ch in low])
    pos = F.aggregate(
        chars, F.array().cast("array<int>"),
        lambda acc, ch: F.array_append(acc, F.call_function("locate", ch, text, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + 1)),
    )

    def score(p: Column) -> Column:
        first, last = F.try_element_at(p, F.lit(1)), F.try_element_at(p, F.lit(-1))
        pairs = F.zip_with(F.slice(p, F.lit(1), F.lit(len(low) - 1)), F.slice(p, F.lit(2), F.lit(len(low) - 1)), lambda a, b: (b == a + 1).cast("int")) if len(low) > 1 else F.array(F.lit(0))
        run = F.aggregate(pairs, F.lit(0), lambda s, x: s + x)
        total = F.lit(float(n)) / F.length(text) * 25 + (run.cast("double") / (n - 1) * 25 if n > 1 else F.lit(0.0)) + F.lit(float(n)) / (last - first + 1) * 30
        before = F.call_function("substring", text, first - 1, F.lit(1))
        bonus = F.when(first <= 3, 25).when(before.isin(list(DELIMITERS)), 15).otherwise(0)
        return F.when(F.exists(p, lambda x: x == 0), F.lit(None).cast("int")).otherwise(total.cast("int") + bonus)

    return F.element_at(F.transform(F.array(pos), score), 1)


def fuzzy_score(path: Column, pattern: str) -> Column:
    """Score of the path; 100 if it contains the pattern (case aside), 50 if a character cannot be found."""
    if not pattern:
        return F.lit(100)
    name = F.substring_index(F.translate(path, "\\", "/"), "/", -1)
    is_path = path.contains("/") | path.contains("\\")
    own = F.coalesce(_partial(pattern, _bytes(name)), F.lit(50))
    own = F.when(F.lower(name).contains(pattern.lower()), 100).otherwise(F.least(F.lit(100), own))
    bonus = F.when(is_path & subsequence(name, pattern), F.floor(own * 4 / 5).cast("int")).otherwise(0)
    whole = _partial(pattern, _bytes(path))
    return F.when(F.lower(path).contains(pattern.lower()), 100).when(whole.isNull(), 50).otherwise(F.least(F.lit(100), whole + bonus)).cast("int")
