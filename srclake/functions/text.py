"""Column functions on text: lines as Python's splitlines sees them, words, names of files and repositories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line boundaries of Python's str.splitlines.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
#: A word of any script; letters stand alone too.
WORD = r"[\p{L}\p{N}_]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(text: Column | str) -> Column:
    """array<string>: '' has no line, and a final line end opens no further one; NULL stays NULL."""
    c = _col(text)
    parts = F.split(c, LINE_BREAK, -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.when(c == "", F.array().cast("array<string>")).when(c.isNotNull(), whole)


def line_count(text: Column | str) -> Column:
    return F.size(lines(text))


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(0))


def basename(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"[^/\\]*$", 0)


def repo_id_from_url(url: Column | str) -> Column:
    """Last part of a clone address, without .git."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(_col(url), r"/+$", ""), r"[^/:]*$", 0), r"\.git$", "")


def diff_line_class(line: Column | str) -> Column:
    c = _col(line)
    return F.when(c.startswith("+++") | c.startswith("---"), "file").when(c.startswith("@@"), "hunk").when(c.startswith("+"), "added").when(c.startswith("-"), "removed").otherwise("context")


def contains_any(text: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | text.contains(t)
    return found


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
