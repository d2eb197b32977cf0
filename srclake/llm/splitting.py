"""Problem 4: cutting texts over a size limit into pieces under it, at natural boundaries, with overlap.

Balanced targets: the least number of pieces that can hold the text is worked out, cuts are aimed at equal distances,
and each is moved to the strongest boundary near its target (before a definition, after a blank line, at a line, at
a blank, anywhere), the nearest of equals. If what is left then does not fit the number of pieces, one more is aimed at from
there on, so each part of a text is looked at once. Every piece but the first begins ``overlap`` characters before the cut, so consecutive pieces share exactly that many.

Texts within the limit are dropped in the scan by their length; each longer text is cut on its own, so there is no
shuffle and no group.

Defined results: null text and text within the limit give no rows; limits count code points; a null or missing limit means
no cutting; of several limits for an origin the smallest counts; a null start_line counts as 1; \\r\\n is never cut in two
(unless a limit leaves room for one character only);
repeated rows are each cut; an overlap that is null or negative is 0 and one of max_chars or more is max_chars - 1
(then pieces advance by a character).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srclake.llm.common import map_rows

_DEFINITION = re.compile(
    r"(?:@|(?:(?:pub(?:lic|\(\w+\))?|private|protected|internal|static|final|abstract|async|export|default|unsafe|const|virtual|inline|override|extern)\s+)*"
    r"(?:def|class|func|function|fn|impl|interface|struct|enum|trait|type|namespace|module|mod|void)\b|[A-Za-z_][\w:<>,\[\] *&]*\s[*&]?[A-Za-z_~][\w:]*\([^;]*\{\s*$|(?:///?|/\*\*|#)(?!include))"
)
#: How far from its target, as a share of the distance between targets, a cut is looked for first.
REACH = 0.3


def _strength(text: str, at: int) -> tuple[int, int]:
    """(strength, indentation of the line, as less is better) of a cut before text[at]."""
    before = text[at - 1]
    if before != "\n":
        return (1 if before.isspace() and not text[at].isspace() else 0), 0
    end = text.find("\n", at)
    line = text[at : len(text) if end < 0 else end]
    if not line.strip():
        return 2, 0
    indent = len(line) - len(line.lstrip())
    previous = text[max(0, text.rfind("\n", 0, at - 1) + 1) : at].strip()
    if not previous:
        return (4 if _DEFINITION.match(line, indent) else 3), -indent
    return 2, -indent


def _in_line_end(text: str, at: int) -> bool:
    return text[at - 1] == "\r" and text[at : at + 1] == "\n"


def _at_line(text: str, target: int, low: int, high: int) -> int:
    """The strongest cut between lines in [low, high], nearest to the target among equals; 0 if there is none."""
    best, found = (0, 0, 0), 0
    at = text.find("\n", max(0, low - 1), high)
    while 0 <= at < high:
        here = at + 1
        if low <= here < len(text):
            value = (*_strength(text, here), -abs(here - target))
            if not found or value > best:
                best, found = value, here
        at = text.find("\n", at + 1, high)
    return found


def _at_blank(text: str, target: int, low: int, high: int) -> int:
    """The last cut after a blank in [low, target], else the target; beside a line end it would cut in two."""
    for here in range(target, low - 1, -1):
        if text[here - 1].isspace() and not _in_line_end(text, here):
            return here
    if not _in_line_end(text, target):
        return target
    return target - 1 if target - 1 >= low else min(target + 1, high)


def cuts(text: str, limit: int, overlap: int) -> list[int]:
    """Inner cut positions; piece k is text[cut k - overlap : cut k+1].

    The minimum number of pieces for what is left gives the next target; where a cut that was moved leaves too much for that
    number, there is one piece more. A cut is looked for near its target first (REACH), then anywhere its piece may end.
    """
    size = len(text)
    if size <= limit:
        return []
    room = limit - overlap
    made, last = [], 0
    while size - last > (room if last else limit):
        step = (size - last) / -(-(size - last - (0 if last else overlap)) // room)
        most = min(size - 1, last + room if last else limit)
        target = min(max(last + round(step), last + 1), most)
        reach = int(step * REACH)
        last = (
            _at_line(text, target, max(last + 1, target - reach), min(target + reach, most))
            or _at_line(text, target, last + 1, most)
            or _at_blank(text, target, last + 1, most)
        )
        made.append(last)
    return made


def split(text: str, limit: int, overlap: int, first_line: int = 1) -> list[tuple[int, int, int, int, int, str]]:
    """(piece_no from 1, start, end, start_line, end_line, text) of the pieces; none if the text is within the limit."""
    if limit is None or limit < 1 or len(text) <= limit:
        return []
    overlap = min(max(overlap or 0, 0), limit - 1)
    edges = [0, *cuts(text, limit, overlap), len(text)]
    out, line, at = [], first_line, 0
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        start = max(0, a - overlap) if k else 0
        if start >= at:
            line += text.count("\n", at, start)
        else:
            line -= text.count("\n", start, at)
        at = start
        piece = text[start:b]
        out.append((k + 1, start, b, line, line + piece.count("\n", 0, len(piece) - 1), piece))
    return out


def pieces(rows: DataFrame, limits: DataFrame, origin: str, row_id: str, text: str, start_line: str | None = None, with_text: bool = True) -> DataFrame:
    """origin, row_id, piece_no, piece_count, start_offset, end_offset, start_line, end_line[, piece] of the rows over the limit."""
    given = limits.where((F.col("origin") == origin) & F.col("max_chars").isNotNull())
    limit = given.orderBy("max_chars", F.col("overlap_chars").desc_nulls_last()).select("max_chars", "overlap_chars").first()
    most, overlap = limit or (None, None)
    picked = rows.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(text).alias("text"), (F.coalesce(F.col(start_line), F.lit(1)) if start_line else F.lit(1)).alias("first"))
    long = picked.where(F.length("text") > most if limit else F.lit(False))

    def cut():
        def one(row_id, text, first):
            found = split(text, most, overlap, first)
            return [(origin, row_id, p[0], len(found), *(p[1:] if with_text else p[1:5])) for p in found]

        return one

    schema = "origin string, row_id bigint, piece_no int, piece_count int, start_offset int, end_offset int, start_line int, end_line int"
    return map_rows(long, cut, schema + (", piece string" if with_text else ""))


def pieces_all(files: DataFrame, chunks: DataFrame, limits: DataFrame, with_text: bool = True) -> DataFrame:
    return pieces(files, limits, "source_files", "file_id", "content", None, with_text).unionByName(
        pieces(chunks, limits, "chunks", "chunk_seq", "code", "start_line", with_text)
    )
