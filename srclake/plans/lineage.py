"""Cutting lineage so that a lost executor costs nothing, and the folder that all executors share."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a folder of this machine, which only a local session can share."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(os.environ.get("TMPDIR", "/tmp"), "srclake-checkpoints")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_path(path: str) -> str:
    """A path for Python's own files, of a folder on a disk; with another file system's address they would write elsewhere."""
    if path.startswith("file:"):
        return re.sub(r"^file:/+", "/", path)
    if re.match(r"\w[\w+.-]*:/", path):
        raise ValueError(f"{path} is not on a disk")
    return os.path.abspath(path)


def stable(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
