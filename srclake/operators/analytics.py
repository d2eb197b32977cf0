"""ANA-*: repository statistics and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srclake.functions.text import clamp, line_count
from srclake.operators.graph_query import simple

#: A file of more lines counts against the health score.
LARGE = 500


def file_sizes(files: DataFrame) -> DataFrame:
    """ANA-3: the files' keys with lines, chars and language."""
    return files.select("repo_id", "file_id", "rel_path", "language", F.coalesce(line_count("content"), F.lit(0)).alias("lines"), F.coalesce(F.length("content"), F.lit(0)).alias("chars"))


def largest(files: DataFrame, k: int = 5) -> DataFrame:
    """ANA-4: the k longest files of each repository, ties in input order."""
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("lines"), "file_id"))
    return file_sizes(files).withColumn("place", place).where(F.col("place") <= k)


def language_histogram(files: DataFrame) -> DataFrame:
    """ANA-2."""
    return files.groupBy("repo_id", F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("files"))


def health(cycles: Column, bugs: Column, files: Column, large: Column) -> Column:
    """ANA-5, one decimal."""
    lost = F.when(cycles > 0, F.least(F.lit(25.0), 5.0 * cycles)).otherwise(0.0)
    lost = lost + F.when(files > 0, F.least(F.lit(20.0), 15.0 * bugs / F.greatest(F.lit(1), files))).otherwise(0.0)
    return F.round(clamp(95.0 - lost - F.least(F.lit(15.0), 3.0 * large), 10.0, 100.0), 1)


def repository_report(files: DataFrame, chunks: DataFrame, edges: DataFrame, cycle_counts: DataFrame, bugs: DataFrame, chats: DataFrame) -> DataFrame:
    """ANA-1, ANA-6, ANA-7: one row per repository. ``cycle_counts`` has repo_id, cycles; bugs and chats are event tables."""
    kind = F.lower(F.trim("kind"))
    per_file = file_sizes(files).groupBy("repo_id").agg(F.count("*").alias("files"), F.count_if(F.col("lines") > LARGE).alias("large_files"))
    per_chunk = chunks.groupBy("repo_id").agg(F.count_if(kind == "class").alias("classes"), F.count_if(kind.isin("function", "method")).alias("functions"))
    per_edge = simple(edges).groupBy("repo_id").agg(F.count("*").alias("dependencies"))
    out = per_file
    for other in (per_chunk, per_edge, cycle_counts, bugs.groupBy("repo_id").agg(F.count("*").alias("bugs")), chats.groupBy("repo_id").agg(F.count("*").alias("chats"))):
        out = out.join(other, "repo_id", "left")
    out = out.fillna(0, ["classes", "functions", "dependencies", "cycles", "bugs", "chats"])
    return out.withColumn("health_score", health(F.col("cycles"), F.col("bugs"), F.col("files"), F.col("large_files")))
