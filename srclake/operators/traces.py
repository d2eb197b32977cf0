"""TRC-*: stack traces to error type, message and frames, with expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from srclake.functions.text import lines

# What an error and a frame look like. "." must stop at \n alone, so it is written as [^\n].
ERROR = r"([A-Za-z_]\w*(?:Error|Exception|Fault|Failure|TypeError|ValueError|KeyError|AttributeError|NullPointerException|IndexOutOfBoundsException|RuntimeException|panic))(?::\s*([^\n]*))?"
PYTHON = r'File\s+"([^"]+)",\s+line\s+(\d+)(?:,\s+in\s+([A-Za-z_]\w*))?'
JAVASCRIPT = r"at\s+(?:([A-Za-z_]\w*)\s+\()?([^:\s]+):(\d+):(\d+)\)?"
JAVA = r"at\s+[\w\.]+\.([A-Za-z_]\w*)\(([^:]+):(\d+)\)"
GO_CALL = r"([\w/\\.-]+\.go):(\d+)\s+(?:\+0x[\da-f]+\s+)?(\w+)\("
GO_IN = r"in\s+([\w/\\.-]+\.go):(\d+)"
CPP = r"(\w+)\([^)]*\)\s+at\s+([\w/\\.-]+\.(?:cpp|cc|c|h|hpp)):(\d+)"
#: (pattern, groups of path, line and function (0: none), function where there is none, language), in order of the result.
FRAMES = [
    (PYTHON, 1, 2, 3, "<module>", "python"), (JAVASCRIPT, 2, 3, 1, "<anonymous>", "javascript"), (JAVA, 2, 3, 1, "", "java"),
    (GO_CALL, 1, 2, 3, "", "go"), (GO_IN, 1, 2, 0, "<unknown>", "go"), (CPP, 2, 3, 1, "", "cpp"),
]


def _text(report: Column | str) -> Column:
    return F.coalesce(F.col(report) if isinstance(report, str) else report, F.lit(""))


def error_type(report: Column | str) -> Column:
    """TRC-1: first error-like name, else UnknownError."""
    found = F.regexp_extract(_text(report), ERROR, 1)
    return F.when(found != "", found).otherwise("UnknownError")


def error_message(report: Column | str) -> Column:
    """TRC-1: what follows its colon, also on the next line; without an error the first line of the report."""
    c = _text(report)
    first = F.coalesce(F.get(lines(F.regexp_replace(c, r"^\s+|\s+$", "")), 0), F.lit(""))
    return F.when(F.regexp_extract(c, ERROR, 1) != "", F.trim(F.regexp_extract(c, ERROR, 2))).otherwise(first)


def frames(report: Column | str) -> Column:
    """TRC-2..7: array of (file_path, line_number, function, language), by language in fixed order."""
    c = _text(report)
    return F.concat(*[_frames_of(c, *row) for row in FRAMES])


def _frames_of(text: Column, pattern: str, path: int, line: int, function: int, default: str, language: str) -> Column:
    def every(group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def frame(z: Column) -> Column:
        name = F.when(z["f"] == "", default).otherwise(z["f"]) if function else F.lit(default)
        return F.struct(z["p"].alias("file_path"), z["l"].cast("int").alias("line_number"), name.alias("function"), F.lit(language).alias("language"))

    return F.transform(F.arrays_zip(every(path).alias("p"), every(line).alias("l"), every(function or path).alias("f")), frame)
