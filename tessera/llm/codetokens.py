"""Source text as masked tokens: what stays of a file when its names and literals are taken away."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np

SHINGLE = 5

# Reserved words of the usual languages; every other word is an identifier.
RESERVED = frozenset(
    """abstract and as assert async await bool boolean break byte case catch char class const constructor continue def default defer delete do double elif else
    enum except export extends false final finally float for from func function go if implements import in instanceof int interface is lambda let long map module
    new nil none not null number or package pass private protected public raise range require return self short signed sizeof static string struct super switch
    this throw throws true try type typeof undefined unsigned use var void volatile while with yield""".split()
)
_TOKEN = re.compile(
    r"""(?P<comment>(?<!:)//[^\n]*|/\*.*?\*/|<!--.*?-->|\#(?!include|define|ifdef|ifndef|endif|if|else|pragma|[0-9a-fA-F]{3,8}\b)[^\n]*)
    |(?P<string>\"\"\".*?\"\"\"|'''.*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)
    |(?P<number>\#[0-9a-fA-F]{3,8}\b|\d[\w.]*)
    |(?P<word>[^\W\d][\w$]*)
    |(?P<mark>\S)""",
    re.S | re.X,
)


@dataclass
class Masked:
    tokens: list[str]
    comments: list[str]
    literal_chars: int  # characters of numbers, short or unspaced strings, encoded comments, and of the marks between them in lists
    solid_chars: int  # characters that are no white space
    longest_literal: int


def mask(text: str, packages: frozenset[str] = frozenset()) -> Masked:
    """Identifiers become I, numbers N, strings S; names of known packages K, also as a string's last path part.

    Comments are taken out (and returned): they say nothing about a file's shape.
    """
    tokens: list[str] = []
    comments: list[str] = []
    literal = longest = solid = 0
    for m in _TOKEN.finditer(text):
        kind, s = m.lastgroup, m.group()
        n = len(s)
        dense = n > 40 and sum(ch.isspace() for ch in s) < 0.03 * n  # encoded bytes, not words
        if kind == "comment":
            comments.append(s)
            if dense and n > 200:
                solid, literal = solid + n, literal + n
            continue
        solid += n
        if kind == "word":
            low = s.lower()
            tokens.append("K" if low in packages else low if low in RESERVED else "I")
        elif kind == "number":
            literal += n
            longest = max(longest, n)
            tokens.append("N")
        elif kind == "string":
            if dense or n <= 40:
                literal += n
                longest = max(longest, n)
            inner = s.strip("\"'`")
            tokens.append("K" if inner.lstrip("./").removesuffix(".h").lower() in packages else "S")
        else:
            if s in ",;:-[]{}" and tokens and tokens[-1] in ("N", "S"):
                literal += n
            tokens.append(s)
    return Masked(tokens, comments, literal, solid, longest)


def shingles(tokens: list[str]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of five tokens (of the whole list if it is shorter)."""
    if not tokens:
        return np.empty(0, np.uint64)
    runs = {"\x1f".join(tokens[i : i + SHINGLE]) for i in range(max(1, len(tokens) - SHINGLE + 1))}
    return np.unique(np.frombuffer(b"".join(hashlib.blake2b(r.encode(), digest_size=8).digest() for r in runs), np.uint64))


def minhash(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One minimum for each (a, b) of the hashes under a*x + b modulo 2^64, upper 32 bits."""
    best = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(hashes), 512):
        best = np.minimum(best, ((hashes[at : at + 512, None] * a + b) >> np.uint64(32)).astype(np.uint32).min(0))
    return best
