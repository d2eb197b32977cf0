"""INC-*: re-indexing what changed, by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashes(files: DataFrame) -> DataFrame:
    """INC-1: repo_id, rel_path, hash (MD5 of the UTF-8 text; null text counts as empty)."""
    return files.select("repo_id", "rel_path", F.md5(F.coalesce("content", F.lit(""))).alias("hash"))


def changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """INC-2: repo_id, rel_path, old_hash, new_hash, change (added, modified, deleted, unchanged)."""
    p, c = previous.withColumnRenamed("hash", "old_hash"), current.withColumnRenamed("hash", "new_hash")
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified").otherwise("unchanged")
    return p.join(c, ["repo_id", "rel_path"], "full").withColumn("change", kind)


def apply(chunks: DataFrame, fresh: DataFrame, changes_: DataFrame, file: str = "file_path") -> DataFrame:
    """INC-3: chunks of modified and deleted files go, ``fresh`` chunks of added and modified ones come."""
    gone = changes_.where("change IN ('modified', 'deleted')").select("repo_id", F.col("rel_path").alias(file))
    come = changes_.where("change IN ('added', 'modified')").select("repo_id", F.col("rel_path").alias(file))
    return chunks.join(gone, ["repo_id", file], "left_anti").unionByName(fresh.join(come, ["repo_id", file], "left_semi"), allowMissingColumns=True)
