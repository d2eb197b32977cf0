"""SNK-1..4, SRC-12..13, COL-*: tables on disk and what is looked up in them."""

from __future__ import annotations

import urllib.parse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def store_path(folder: str, collection: str) -> str:
    """SNK-2: a collection's folder; names are escaped, so that a name with a slash cannot leave it."""
    return f"{folder.rstrip('/')}/{urllib.parse.quote(collection, safe='')}"


def exists(spark: SparkSession, path: str) -> bool:
    """On whatever file system the path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def save(df: DataFrame, folder: str, collection: str, by: str | None = "repo_id") -> None:
    """SNK-1: overwrite a collection, one partition per value of ``by``."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by and by in df.columns else writer).parquet(store_path(folder, collection))


def load(spark: SparkSession, folder: str, collection: str) -> DataFrame | None:
    """SRC-12, SRC-13: a collection, or None where it is missing."""
    path = store_path(folder, collection)
    return spark.read.parquet(path) if exists(spark, path) else None


def insert(df: DataFrame, folder: str, collection: str) -> None:
    """SNK-3."""
    df.write.mode("append").parquet(store_path(folder, collection))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-4: rows of ``changes`` replace those of ``current`` with equal keys (null-safe); new keys are added.

    Several changes of one key count as the last by ``seq`` where there is such a column.
    """
    if "seq" in changes.columns:
        changes = latest_by(changes, keys, [F.col("seq").desc()])
    c, n = current.alias("c"), changes.alias("n")
    on = None
    for k in keys:
        same = F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}"))
        on = same if on is None else on & same
    kept = c.join(n, on, "left_anti")
    return kept.unionByName(changes, allowMissingColumns=True)


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def find(df: DataFrame, **equal) -> DataFrame:
    """COL-1: conjunction of null-safe equalities; no condition gives all rows."""
    for k, v in equal.items():
        df = df.where(F.col(k).eqNullSafe(F.lit(v))) if k in df.columns else df.where(F.lit(v is None))
    return df


def find_first(df: DataFrame, seq: str, **equal) -> DataFrame:
    """COL-2."""
    return find(df, **equal).orderBy(seq).limit(1)


def newest(df: DataFrame, by: list[str], time: str = "created_at", tie: str | None = None) -> DataFrame:
    """COL-3, PAT-15, BUG-9, RET-15: rows with their place in each group, newest first; a missing time counts as 0."""
    order = [F.coalesce(F.col(time), F.lit(0.0)).desc(), *([F.col(tie)] if tie else [])]
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def history(df: DataFrame, repo_id: str, time: str = "created_at") -> DataFrame:
    """COL-3, PAT-15: a repository's rows, newest first; a missing time counts as 0."""
    return find(df, repo_id=repo_id).orderBy(F.coalesce(F.col(time), F.lit(0.0)).desc())


def counts(df: DataFrame, key: str = "repo_id", name: str = "n") -> DataFrame:
    """ANA-6: rows by key."""
    return df.groupBy(key).agg(F.count("*").alias(name))
