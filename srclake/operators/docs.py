"""DOC-*: documentation put together from files and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PATHS, CLASSES, FUNCTIONS, CODE = 25, 10, 30, 400


def overview(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """DOC-1: repo_id, languages (sorted), files, chunks."""
    f = files.groupBy("repo_id").agg(F.array_join(F.sort_array(F.collect_set("language")), ", ").alias("languages"), F.count("*").alias("files"))
    return f.join(chunks.groupBy("repo_id").agg(F.count("*").alias("chunks")), "repo_id", "left").fillna(0, ["chunks"])


def _first(df: DataFrame, order: list, k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(*order))).where(F.col("place") <= k)


def paths(files: DataFrame) -> DataFrame:
    """DOC-2: repo_id, place, rel_path (the first 25), more (how many are not listed)."""
    total = files.groupBy("repo_id").agg(F.greatest(F.count("*") - PATHS, F.lit(0)).alias("more"))
    return _first(files.select("repo_id", "rel_path", "file_id"), ["rel_path", "file_id"], PATHS).drop("file_id").join(total, "repo_id")


def classes(chunks: DataFrame) -> DataFrame:
    """DOC-3: the first 10 classes in chunk order."""
    picked = chunks.where(F.lower(F.trim("kind")) == "class").select("repo_id", "chunk_seq", "name", "file_path", "docstring", "start_line", "end_line")
    return _first(picked, ["chunk_seq"], CLASSES)


def functions(chunks: DataFrame) -> DataFrame:
    """DOC-4: the first 30 functions and methods, code cut to 400 characters."""
    code = F.concat(F.substring("code", 1, CODE), F.when(F.length("code") > CODE, "\n...").otherwise(""))
    picked = chunks.where(F.lower(F.trim("kind")).isin("function", "method")).select("repo_id", "chunk_seq", "name", "file_path", "language", "docstring", "start_line", "end_line", code.alias("code"))
    return _first(picked, ["chunk_seq"], FUNCTIONS)


def _joined(df: DataFrame, text: Column) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("place", text.alias("t"))))
    return df.groupBy("repo_id").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "").alias("text"))


def markdown(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """SNK-9, DOC-6: repo_id, readme, api."""
    span = F.concat(F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    tree = _joined(paths(files), F.concat(F.lit("├── "), "rel_path", F.lit("\n"))).withColumnRenamed("text", "tree")
    more = paths(files).groupBy("repo_id").agg(F.first("more").alias("more"))
    kinds = _joined(classes(chunks), F.concat(F.lit("### Class `"), "name", F.lit("` (`"), "file_path", F.lit("`)\n"), F.when(F.col("docstring") != "", F.concat(F.lit("> "), "docstring", F.lit("\n\n"))).otherwise(""), F.lit("Lines: `"), span, F.lit("`\n\n"))).withColumnRenamed("text", "classes")
    calls = _joined(
        functions(chunks),
        F.concat(
            F.lit("### `"), "name", F.lit("`\n- **File**: `"), "file_path", F.lit("`\n- **Lines**: `"), F.col("start_line").cast("string"), F.lit(" - "), F.col("end_line").cast("string"), F.lit("`\n"),
            F.when(F.col("docstring") != "", F.concat(F.lit("- **Docstring**: "), "docstring", F.lit("\n"))).otherwise(""), F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), "code", F.lit("\n```\n\n"),
        ),
    ).withColumnRenamed("text", "calls")
    all_ = overview(files, chunks).join(tree, "repo_id", "left").join(more, "repo_id", "left").join(kinds, "repo_id", "left").join(calls, "repo_id", "left")
    readme = F.concat(
        F.lit("# "), "repo_id", F.lit("\n\n## Overview\n- **Primary languages**: "), "languages", F.lit("\n- **Source files**: "), F.col("files").cast("string"), F.lit("\n- **Code components**: "), F.col("chunks").cast("string"),
        F.lit("\n\n## Folder structure\n```\n"), F.coalesce("tree", F.lit("")), F.when(F.col("more") > 0, F.concat(F.lit("└── ... ("), F.col("more").cast("string"), F.lit(" more files)\n"))).otherwise(""),
        F.lit("```\n\n## Core modules\n"), F.coalesce("classes", F.lit("")),
    )
    return all_.select("repo_id", readme.alias("readme"), F.concat(F.lit("# API & Method Documentation\n\n"), F.coalesce("calls", F.lit(""))).alias("api"))


def html(markdown_: Column, title: str = "Documentation") -> Column:
    """DOC-5: a page with line breaks, and fences opened and closed in turn."""
    parts = F.split(F.replace(F.replace(F.replace(markdown_, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), "```", -1)
    body = F.array_join(F.transform(parts, lambda p, k: F.when(k % 2 == 1, F.concat(F.lit("<pre>"), p, F.lit("</pre>"))).otherwise(F.replace(p, F.lit("\n"), F.lit("<br>")))), "")
    return F.concat(F.lit(f'<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>{title}</title>\n</head>\n<body>\n'), body, F.lit("\n</body>\n</html>\n"))
