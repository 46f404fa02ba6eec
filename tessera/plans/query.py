"""The query language of content search, compiled to a plan of prefixes and regular expressions.

``|`` separates clauses, blanks separate terms (the word AND is passed over).  A term counts only if it begins
with at least two word characters.  A clause matches a line where its terms follow one another left to right,
each gap at most so many characters and then one that is no letter or digit; ``*`` and ``?`` are wildcards.
A document is a candidate for a clause if it has, for each term, an indexed word that begins with its prefix.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_PREFIX = re.compile(r"[a-zA-Z0-9_][a-zA-Z0-9_-]+")
_ESCAPED = "[]^$:"


class QueryError(ValueError):
    """The query has no usable term, or what it leaves of regular expression syntax is not valid."""


@dataclass(frozen=True)
class Term:
    pattern: str
    prefix: str


@dataclass(frozen=True)
class Clause:
    terms: tuple[Term, ...]
    regex: str  # as the query language defines it
    java: str  # the same for Spark, with flags

    def __str__(self) -> str:
        return " AND ".join(t.pattern for t in self.terms)


@dataclass(frozen=True)
class Plan:
    clauses: tuple[Clause, ...]
    case_sensitive: bool

    def __str__(self) -> str:
        return " | ".join(map(str, self.clauses))

    @property
    def prefixes(self) -> list[str]:
        return sorted({t.prefix for c in self.clauses for t in c.terms})


def term_regex(pattern: str, wildcard: int) -> str:
    s = pattern.replace(".", r"\.").replace("*", ".{0,%d}" % wildcard).replace("?", ".?")
    for ch in _ESCAPED:
        s = s.replace(ch, "\\" + ch)
    return s


_REPEAT = re.compile(r"\{(\d+)(?:,(\d*))?\}")
_ESCAPES = frozenset("dDwWsSbBAzafnrtv")


def java_regex(regex: str) -> str:
    """The expression for java.util.regex; raises QueryError where the linear-time dialect the language is defined in rejects it.

    No classes occur (brackets are always escaped).  A brace that opens no repetition is a plain character.
    """
    out: list[str] = []
    depth, atom, repeated, k = 0, False, False, 0
    while k < len(regex):
        ch = regex[k]
        if ch == "\\":
            if k + 1 >= len(regex):
                raise QueryError("trailing backslash")
            nxt = regex[k + 1]
            if nxt.isalnum() and nxt.isascii() and nxt not in _ESCAPES:
                raise QueryError(f"invalid escape \\{nxt}")
            out.append(r"\x0B" if nxt == "v" else r"\x07" if nxt == "a" else ch + nxt)
            atom, repeated, k = True, False, k + 2
            continue
        if ch == "(":
            depth += 1
            atom = repeated = False
        elif ch == ")":
            depth -= 1
            if depth < 0:
                raise QueryError("unexpected )")
            atom, repeated = True, False
        elif ch == "+" or (ch == "{" and _REPEAT.match(regex, k)) or (ch == "?" and atom):
            if not atom:
                raise QueryError("missing argument to repetition operator")
            if repeated and ch != "?":
                raise QueryError("invalid nested repetition operator")
            if ch == "{":
                m = _REPEAT.match(regex, k)
                low, high = int(m[1]), int(m[2]) if m[2] else None
                if low > 1000 or (high or 0) > 1000 or (high is not None and high < low):
                    raise QueryError("invalid repeat count")
                out.append(m[0])
                k, repeated = m.end(), True
                continue
            repeated = True
        elif ch in "{}":
            out.append("\\" + ch)
            atom, repeated, k = True, False, k + 1
            continue
        elif ch == "^":
            atom = repeated = False
        elif ch == "|":
            atom = repeated = False
        elif ch == "[":
            end = regex.index("]", k)
            out.append(regex[k : end + 1])
            atom, repeated, k = True, False, end + 1
            continue
        else:
            atom, repeated = True, False
        out.append(ch)
        k += 1
    if depth:
        raise QueryError("missing closing )")
    return "".join(out)


def compile_query(query: str, case_sensitive: bool = False, wildcard: int = 24, distance: int = 32) -> Plan:
    clauses = []
    for part in query.strip().split("|"):
        terms = []
        for word in part.strip().split(" "):
            word = word.strip()
            if not word or word == "AND":
                continue
            if m := _PREFIX.match(word):
                terms.append(Term(word, m[0].lower()))
        if not terms:
            continue
        body = (".{0,%d}[^a-zA-Z0-9]" % distance).join(term_regex(t.pattern, wildcard) for t in terms)
        regex = f"(^|[^a-zA-Z0-9])({body})"
        clauses.append(Clause(tuple(terms), regex, ("(?d)" if case_sensitive else "(?iud)") + java_regex(regex)))
    if not clauses:
        raise QueryError("query is empty")
    return Plan(tuple(clauses), case_sensitive)
