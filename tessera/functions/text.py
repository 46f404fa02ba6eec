"""Words, identities and kinds of files, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[a-zA-Z0-9_][a-zA-Z0-9_-]+"
MIN_WORD, MAX_WORD = 3, 80

# Extensions of files that are never indexed.
BINARY_EXTENSIONS = [
    ".ds_store", ".exe", ".dll", ".lib", ".so", ".class", ".jar", ".pyc", ".pyo", ".bin", ".pdb", ".dmp", ".wasm",
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".tiff", ".webp",
    ".mp4", ".mkv", ".avi", ".mov", ".wmv", ".mp3", ".wav", ".flac", ".aac", ".ogg", ".opus",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".xz",
]


def words(text: Column) -> Column:
    """Distinct lower-case words of 3 to 80 characters, sorted; of null null."""
    found = F.regexp_extract_all(text, F.lit(WORD), 0)
    kept = F.filter(found, lambda w: F.length(w).between(MIN_WORD, MAX_WORD))
    return F.sort_array(F.array_distinct(F.transform(kept, F.lower)))


def words_of_file(text: Column, size: Column, max_size: int) -> Column:
    """As :func:`words`; a file above the limit has none."""
    return F.when(size > max_size, F.array().cast("array<string>")).otherwise(words(text))


def extension(path: Column) -> Column:
    """From the last dot of the last part on, lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def indexable(path: Column) -> Column:
    return ~extension(path).isin(BINARY_EXTENSIONS)


def printable_ratio(content: Column) -> Column:
    """Share of the bytes that are printable, white space or not ASCII; null for no bytes.  ``content`` is binary."""
    chars = F.decode(content, "ISO-8859-1")
    n = F.length(content)
    return F.when(n > 0, F.length(F.regexp_replace(chars, r"[^\x20-\x7E\n\r\t\x{80}-\x{FF}]", "")) / n)


def text_mime(mime: Column) -> Column:
    return mime.startswith("text/") | mime.endswith("+json") | mime.endswith("+xml") | mime.isin("application/json", "application/xml", "application/javascript")


def media_mime(mime: Column) -> Column:
    return mime.startswith("image/") | mime.startswith("video/") | mime.startswith("audio/")


def likely_text(content: Column, mime: Column) -> Column:
    """Text by its type, else no media type and more than 95 % printable bytes."""
    return F.when(text_mime(mime), True).when(media_mime(mime), False).otherwise(F.coalesce(printable_ratio(content) > 0.95, F.lit(False)))


def document_id(workspace_path: Column, rel_path: Column) -> Column:
    return F.md5(F.concat_ws("/", workspace_path, rel_path))


def content_hash(content: Column) -> Column:
    return F.md5(content)
