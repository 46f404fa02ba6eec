"""Personal information in free text: find it and replace it by typed placeholders.

Texts are cut into overlapping windows, every window of every text is decoded by the character-level
BiLSTM-CRF of :mod:`pii_model`, and the windows' spans are reconciled over the whole text: a span counts
from the window in whose core its middle lies, and where two overlap the longer (then the earlier) wins.
An exact check follows, which moves a span's ends to those of the notation it lies in (whole words, whole
address, whole number).  A span in no known notation stays as it was tagged; it is dropped only where the text
shows that it is something else (a part of an identifier, a version, a date, a clone address).
"""

from __future__ import annotations

import io
import pkgutil
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.common import plain, spread
from tessera.llm import pii_model as m

WINDOW, MARGIN, BATCH = 320, 40, 256
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}

_HOST = r"[^\W_][\w-]*"
_EMAIL = [
    re.compile(rf"(?i)[^\W_][\w.+-]*{at}{_HOST}(?:{dot}{_HOST})+")
    for at, dot in ((" ?@ ?", r"\."), (r" ?[(\[{<]at[>}\])] ?", r"(?:\.| ?[(\[{<]dot[>}\])] ?| dot )"), (" at ", r"(?: dot | ?[(\[]dot[)\]] ?)"))
]
_PHONE = re.compile(r"(?:\+|\(|\d)(?:[\d().\-\u2010-\u2013/ \u00a0\u2007\u202f]){5,}\d(?:,? ?(?:ext\.?|extension|x) ?\d+)?", re.I)
_ID = re.compile(r"\b(?:(?i:QQ) ?\d\d ?\d\d ?\d\d ?(?i:[A-D])|\d{3}[- ]\d\d[- ]\d{4}|\d\d\.\d{3}\.\d{3}-?[A-Z]|[A-Z]{0,2}\d{6,10}[A-Z]?)\b")
_PARTICLES = frozenset("von van der den de la le du da das del di do dos el al bin ibn y e zu zur ter".split())
# Words that stand between capitalised words in sentences, not in names.
_NO_PARTICLES = frozenset("a an and are as at but by can for from had has he her his if in into is it its not of on or our she so than that the their then they this to was we were who with you und oder ist mit et est avec con per para".split())
_NO_ID = re.compile(r"v?\d+(?:\.\d+){1,2}|\d{1,3}(?:\.\d{1,3}){3}|\d{4}[-/.]\d\d?[-/.]\d\d?|\d\d?[-/.]\d\d?[-/.]\d{4}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|(?=[0-9]*[a-f])[0-9a-f]{7,}|0x[0-9a-f]+", re.I)
_TITLE = re.compile(r"(?:(?:dr|mr|mrs|ms|prof|herr|frau|mme|mlle|sra?|dra|hr|fr)\.? )+", re.I)

# Words that say of a number after them what it is, and words before which a street address has ended.
_OTHER_NUMBER = re.compile(
    r"(?i)\b(?:branch|rama|branche|zweig|ramo|build|range|ticket|part|tray|serial|order|version|milestone|release|commit|issue|port|batch|invoice|isbn|sku|model|revision|label|pair|row|line|article)(?: (?:no\.?|number|nr\.?|nº|range|id))?[ :#]*$"
)
_ENDED = re.compile(r",? (?:con|chez|bei|com|with|for|para|pour|für|presso|and|y|et|und|e) (?=[^\W\d_])")
_WAY = re.compile(r"(?<!\w)(?:calle|c/|avenida|avda?\.|plaza|paseo|carrera|camino|rua|travessa|largo|praça|alameda|estrada|via|viale|piazza|corso) ?", re.I)
_DAY = re.compile(r"(?:(?:mon|tues|wednes|thurs|fri|satur|sun)day|montag|dienstag|mittwoch|donnerstag|freitag|samstag|sonntag),? ", re.I)


def weights() -> dict[str, np.ndarray]:
    """The trained weights that lie beside this module."""
    raw = pkgutil.get_data(__package__, "pii_weights.npz")
    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def _cover(patterns: list[re.Pattern], text: str, a: int, b: int) -> tuple[int, int] | None:
    """The match of the patterns that shares most with [a, b)."""
    around = 60
    while True:
        low, high = max(0, a - around), min(len(text), b + around)
        best, found = 0, None
        for pattern in patterns:
            for x in pattern.finditer(text, low, high):
                shared = min(b, x.end()) - max(a, x.start())
                if shared > best:
                    best, found = shared, x.span()
        if not found or (found[0] > low or low == 0) and (found[1] < high or high == len(text)):
            return found
        around *= 2  # the match may go on beyond what was looked at


def _whole(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without marks at its ends, and with all of the words it cuts."""
    while a < b and not (text[a].isalnum() or text[a] in "+(" and any(c.isdigit() for c in text[a:b])):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    while a < b and a > 0 and text[a].isalnum() and text[a - 1].isalnum():
        a -= 1
    while a < b < len(text) and text[b].isalnum():
        b += 1
    return a, b


def _other_email(text: str, a: int, b: int) -> tuple[int, int] | None:
    """A tagged address in no known notation; None if no at sign joins two parts, or for clone addresses, user parts of URLs and package versions."""
    while a < b and text[a] in " \t\r\n<(,;:'":
        a += 1
    while b > a and text[b - 1] in " \t\r\n>),;:.'":
        b -= 1
    s = text[a:b]
    parts = re.split(r"@|[(\[{<]at[>}\])]| at ", s, maxsplit=1, flags=re.I)
    if len(parts) < 2 or not parts[0].strip() or not parts[1].strip() or "\n" in s:
        return None
    if s.lower().startswith("git@") or "//" in text[max(0, a - 6) : b] or re.match(r"[v^~]?\d+(?:\.\d+)*$", parts[1].strip()) or text[b : b + 1] in ("/", ":") and text[b + 1 : b + 2].isalnum():
        return None
    return a, b


def _other_id(text: str, a: int, b: int) -> tuple[int, int] | None:
    """A tagged number in no known notation; None for few digits, versions, dates, hashes, and parts of paths and identifiers."""
    a, b = _whole(text, a, b)
    s = text[a:b]
    if sum(c.isdigit() for c in s) < 5 or "\n" in s or any(c in s for c in "_@=<>") or _NO_ID.fullmatch(s):
        return None
    return None if text[max(0, a - 1) : a] in ("_", "@", "/") and a or text[b : b + 1] in ("_", "@") and b < len(text) else (a, b)


def exact(kind: str, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The span's ends in the notation it lies in, or as tagged in another; None where it cannot be of its type."""
    if kind == "email":
        got = _cover(_EMAIL, text, a, b)
        if not got:
            return _other_email(text, a, b)
        s = text[got[0] : got[1]].lower()
        return None if s.startswith("git@") or text[got[1] : got[1] + 1] in (":", "/") and "@" in s and text[got[0] - 6 : got[0]].endswith("//") else got
    if kind == "phone":
        got = _cover([_PHONE], text, a, b)
        if not got or sum(c.isdigit() for c in text[got[0] : got[1]]) < 7:
            got = _whole(text, a, b)
            s = text[got[0] : got[1]]
            if not 7 <= sum(c.isdigit() for c in s) <= 20 or "\n" in s or any(c in s for c in "_@=<>:;"):
                return None
        a, b = got
        if text[b : b + 1].isalnum() or (text[a:b].isdigit() and b - a > 15) or text[a : a + 1].isdigit() and text[a - 1 : a].isalnum() and a > 0:
            return None
        if text[a] == "(" and ")" not in text[a:b]:
            a += 1
        return None if text[a] not in "+(" and _OTHER_NUMBER.search(text, max(0, a - 40), a) else (a, b)
    if kind == "id_number":
        if _OTHER_NUMBER.search(text, max(0, a - 40), a):
            return None
        got = _cover([_ID], text, a, b)
        if got and not any(c.isdigit() for c in text[a : max(a, got[0])] + text[min(b, got[1]) : b]):
            return got
        other = _other_id(text, a, b)  # no known notation, or one that is only a part of the tagged number
        return other if other or not got else got
    while a < b and not text[a].isalnum():
        a += 1
    while b > a and not (text[b - 1].isalnum() or text[b - 1] in "º."):
        b -= 1
    if a >= b:
        return None
    while a > 0 and (text[a - 1].isalnum()) and text[a].isalnum():
        a -= 1
    while b < len(text) and text[b - 1].isalnum() and (text[b].isalnum() or text[b] == "'" and text[b + 1 : b + 2].isalnum()):
        b += 1
    if kind == "person_name":
        for lead in (_DAY, _TITLE):
            if m_ := lead.match(text, a, b):
                a = m_.end()
        while b > a and text[b - 1] in ". ":
            b -= 1
        s = text[a:b]
        words = re.findall(r"[^\W\d_]+", s)
        cased = [w for w in words if w[0].lower() != w[0].upper()]  # other scripts have no capitals
        upper = [w for w in words if w[0].isupper()]
        between = words[1:-1] if len(words) > 2 else []
        lower = [w for w in cased if w[0].islower() and not any(w is x for x in between if x in _PARTICLES or len(x) <= 5 and x not in _NO_PARTICLES) and (w not in _PARTICLES or w is words[0])]
        if (upper and lower) or any(not w[0].isupper() and not w.islower() for w in cased):
            return None
        if re.search(r"\b[lL]'[a-z]", s) or (comma := re.search(r", ?(\w+) ", s)) and comma[1] in _PARTICLES:  # a particle precedes the family name
            return None
        if len(words) < 2 and (cased or len(s) < 2) or len(words) > 1 and not re.search(r"\s", s) and cased:
            return None
        if re.search(r"\n\s*\n", s) or len(s.splitlines()) > 2 or ("\n" in s and cased and not upper) or any(c.isdigit() or c in "_@/<>;:" for c in s):
            return None
        return a, b
    if text[b : b + 1] == "." and re.search(r"(?i)\bst$", text[a:b]):
        b += 1
    elif text[b - 1] == "." and not re.search(r"(?i)\bst\.$", text[a:b]):
        b -= 1
    if way := _WAY.search(text, a, b):
        if way.start() > a and not any(c.isdigit() for c in text[a : way.start()]):
            a = way.start()
    for end in _ENDED.finditer(text, a, b):
        if any(c.isdigit() for c in text[a : end.start()]) and _WAY.match(text, a, b):
            b = end.start()
            break
    s = text[a:b]
    spaced = any(c.isspace() for c in s) and "_" not in s and "=" not in s
    return (a, b) if spaced and any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and "\n" not in s else None


def _windows(n: int) -> list[tuple[int, int, int, int]]:
    """(start, end, core start, core end) over a text of n characters."""
    out, start = [], 0
    while True:
        end = min(n, start + WINDOW)
        last = end == n
        if last and start:
            start = max(0, n - WINDOW)
        out.append((start, end, out[-1][3] if out else 0, n if last else end - MARGIN))
        if last:
            return out
        start = end - 2 * MARGIN


def find(texts: list[str | None], p: dict[str, np.ndarray]) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, type) of each text, in order, without overlaps."""
    todo = []
    for k, text in enumerate(texts):
        if text:
            ids = m.encode(text)
            todo += [(len(ids[a:b]), k, a, c, d, ids[a:b]) for a, b, c, d in _windows(len(ids))]
    todo.sort(key=lambda x: x[0])
    raw: dict[int, list[tuple[int, int, int]]] = {}
    for at in range(0, len(todo), BATCH):
        part = todo[at : at + BATCH]
        ids = np.zeros((len(part), part[-1][0]), np.uint8)
        for row, x in zip(ids, part):
            row[: x[0]] = x[5]
        tags = m.decode(p, ids)
        for row in np.flatnonzero(tags.any(1)):
            size, k, start, core_a, core_b, _ = part[row]
            for kind, a, b in m.spans(tags[row, :size]):
                if core_a <= start + (a + b) // 2 < core_b:
                    raw.setdefault(k, []).append((start + a, start + b, kind))
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for k, found in raw.items():
        got = {(*e, m.TYPES[kind]) for a, b, kind in found if (e := exact(m.TYPES[kind], texts[k], a, b))}
        taken: list[tuple[int, int, str]] = []
        for a, b, kind in sorted(got, key=lambda x: (x[0] - x[1], x)):
            if all(b <= c or d <= a for c, d, _ in taken):
                taken.append((a, b, kind))
        out[k] = sorted(taken)
    return out


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, kind in found:
        parts += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*parts, text[at:]])


def find_pii(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: the id, ``pii`` (array of type, text, start, end in code points) and ``redacted``.

    A null text gives null in both; an empty one an empty array and an empty text.  Repeated rows each count.
    Columns other than the two named are not carried; ids may be of any type and need not be unique.
    """
    p = {k: v.astype(np.float16) for k, v in weights().items()}
    spark_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, spark_type),
        T.StructField("pii", T.ArrayType(T.StructType([T.StructField("pii_type", T.StringType()), T.StructField("pii_text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("redacted", T.StringType()),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = {k: v.astype(np.float32) for k, v in p.items()}
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                texts = [t if isinstance(t, str) else None for t in part["_text"]]
                found = find(texts, model)
                pii = [None if t is None else [{"pii_type": k, "pii_text": t[a:b], "start": a, "end": b} for a, b, k in f] for t, f in zip(texts, found)]
                red = [None if t is None else redact(t, f) for t, f in zip(texts, found)]
                yield plain(pd.DataFrame({id_col: part["_id"].to_numpy(), "pii": pii, "redacted": red}))

    part = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return spread(part).mapInPandas(run, schema)
