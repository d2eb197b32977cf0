"""CHK-*: files to function-, class- and symbol-level chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclake.functions.pythoncode import CHUNK_COLUMNS, python_chunks
from srclake.functions.text import lines

# What opens a symbol, tried in this order on each line.
FUNCTION_LINE = r"^\s*(?:public|private|protected|static|async|function|func|def|inline|const|let|var)?\s*([a-zA-Z_]\w*)\s*\([^\)]*\)\s*(?::|\{|=>)"
CLASS_LINE = r"^\s*(?:export\s+)?(?:public|private|protected|abstract|class|interface|struct|type)\s+([a-zA-Z_]\w*)"
NOISE = ["if", "for", "while", "switch", "return", "catch", "new", "import", "package"]
IMPORT_LINES = [r"^\s*import\s+.*", r"^\s*from\s+.*import.*", r"^\s*#include\s+.*", r"^\s*using\s+.*"]
#: The same with what those miss: a class after a modifier, Go results after the parameters, arrow constants.
FIXED_FUNCTION_LINE = r"^\s*(?:export\s+)?(?:(?:public|private|protected|static|async|final|function|func|def|fn|inline|const|let|var)\s+)*([a-zA-Z_]\w*)\s*(?:=\s*(?:async\s+)?)?\([^\)]*\)[\w\s.*\[\]<>,:&]*(?::|\{|=>)"
FIXED_CLASS_LINE = r"^\s*(?:export\s+)?(?:(?:public|private|protected|abstract|final|static|pub)\s+)*(?:class|interface|struct|type|enum|trait)\s+([a-zA-Z_]\w*)"


def file_block(files: DataFrame) -> DataFrame:
    """CHK-5: the whole file as one chunk, code as it is; an empty file ends at line 0."""
    return files.select(
        "*", F.concat("rel_path", F.lit("::whole_file")).alias("chunk_id"), F.lit("block").alias("kind"), F.col("rel_path").alias("name"),
        F.lit(1).alias("start_line"), F.size(lines("content")).alias("end_line"), F.col("content").alias("code"),
        F.lit(None).cast("string").alias("docstring"), F.array().cast("array<string>").alias("imports"),
    )


def import_lines(content: Column | str) -> Column:
    """CHK-8: trimmed import lines, in order."""
    match = lambda line: F.rlike(line, F.lit("|".join(f"(?:{p})" for p in IMPORT_LINES)))
    return F.transform(F.filter(lines(content), match), lambda line: F.trim(line))


def symbols(files: DataFrame, key: list[str], fixed: bool = False) -> DataFrame:
    """CHK-6, CHK-7: key, kind, name, start_line, end_line, code. A symbol ends before the next one; what comes before the first
    is dropped. A noise word as a function's name lets the line be tried as a class."""
    function, class_ = (FIXED_FUNCTION_LINE, FIXED_CLASS_LINE) if fixed else (FUNCTION_LINE, CLASS_LINE)

    def symbol(line: Column, at: Column) -> Column:
        f, c = F.regexp_extract(line, function, 1), F.regexp_extract(line, class_, 1)
        is_f, is_c = (f != "") & ~f.isin(NOISE), (c != "") & ~c.isin(NOISE)
        return F.struct((at + 1).alias("start_line"), F.when(is_f, "function").when(is_c, "class").alias("kind"), F.when(is_f, f).otherwise(c).alias("name"))

    # All within a file's own row: no line is copied around, and nothing is shuffled.
    found = files.select(*key, lines("content").alias("all")).withColumn("found", F.filter(F.transform("all", symbol), lambda s: s["kind"].isNotNull()))
    each = found.select(*key, "all", "found", F.posexplode("found").alias("k", "s"))
    following = F.get("found", F.col("k") + 1)["start_line"]
    end = F.greatest(F.coalesce(following - 1, F.size("all")), F.col("s.start_line"))
    code = F.array_join(F.slice("all", F.col("s.start_line"), end - F.col("s.start_line") + 1), "\n")
    return each.select(*key, "s.kind", "s.name", "s.start_line", end.alias("end_line"), code.alias("code"))


def chunk(files: DataFrame, chunker: str = "whole_file", fixed: bool = False) -> DataFrame:
    """CHK-1..10: repo_id, file_path, language and the chunk columns of every file.

    Python goes through the language's own parser; other files are whole-file blocks, or, with ``chunker="symbols"``,
    the symbols found by line. A file that gives none is one block.
    """
    is_python, parts = F.col("language").eqNullSafe("python"), ["repo_id", F.col("rel_path").alias("file_path"), "language"]
    other = files.where(~is_python)
    # One pass over all that is not cut by line, so a file is parsed once and the order of files is kept.
    whole = files.where(is_python) if chunker == "symbols" else files
    made = file_block(whole.withColumn("cs", python_chunks(F.when(is_python, F.col("content")), "rel_path")))
    found = F.when(F.size("cs") > 0, F.col("cs")).otherwise(F.array(F.struct(*CHUNK_COLUMNS)))
    out = made.select(*parts, F.explode(found).alias("c")).select("repo_id", "file_path", "language", "c.*")
    if chunker == "symbols":
        found = symbols(other, ["repo_id", "rel_path", "language"], fixed)
        imports = other.select("repo_id", "rel_path", import_lines("content").alias("imports"))
        out = out.unionByName(
            found.join(imports, ["repo_id", "rel_path"]).select(
                "repo_id", F.col("rel_path").alias("file_path"), "language", F.concat_ws("::", "rel_path", "name").alias("chunk_id"), "kind", "name",
                "start_line", "end_line", "code", F.lit(None).cast("string").alias("docstring"), "imports",
            )
        )
        blocks = other.join(found.select("repo_id", "rel_path").distinct(), ["repo_id", "rel_path"], "left_anti")
        out = out.unionByName(file_block(blocks).select(*parts, *CHUNK_COLUMNS))
    return out


def embedding_text() -> Column:
    """CHK-11: file, kind and name, then docstring and imports where there are any, then the code, line by line."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# File: "), "file_path"), F.concat(F.lit("# "), "kind", F.lit(": "), "name"),
        F.when(F.col("docstring") != "", F.concat(F.lit('"""'), "docstring", F.lit('"""'))),
        F.when(F.size("imports") > 0, F.concat(F.lit("# imports: "), F.array_join("imports", ", "))), F.col("code"),
    )
