"""SRC-*: reading a tree of source files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srclake.functions.languages import CORE, detect

# Directories that are never read, by exact name.
IGNORED_DIRECTORIES = [".git", "__pycache__", "node_modules", "venv", ".venv", "dist", "build", ".idea", ".vscode", "target", "egg-info"]
#: Bytes of files that a task of Spark's source reads at least, and that one batch of a scan holds.
TASK_BYTES, BATCH_BYTES = 64 << 20, 8 << 20


class EmptyRepository(ValueError):
    """SRC-14: nothing to work on."""


def not_ignored(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """SRC-2: files without an ignored directory above them; the base name does not count."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return files.where(~F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED_DIRECTORIES))))


def _empty_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths of files without a byte, which Spark's file sources skip; a listing on the driver, as Spark's own is."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    found, files = [], path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    while files.hasNext():
        f = files.next()
        if f.getLen() == 0:
            found.append((f.getPath().toString(), bytearray()))
    return spark.createDataFrame(found, "path string, content binary")


def _text(content: Column, bad_bytes: str) -> Column:
    """UTF-8 text of bytes; what is not UTF-8 is dropped or replaced by U+FFFD. In files that are valid nothing is touched."""
    text = content.cast("string")
    mended = F.make_valid_utf8(text)
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(mended, F.lit("\ufffd"), F.lit("")) if bad_bytes == "drop" else mended)


def _spark_files(spark: SparkSession, root: str, empty_files: bool) -> DataFrame:
    """path, rel_path, content (bytes) by Spark's own source, for any file system. It gives a task four files or so, whatever
    they hold, so tasks are put together; names that begin with "_" or "." are hidden from it."""
    glob = "*.{" + ",".join(e[1:] for e in CORE) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    size = int(str(raw._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    raw = raw.coalesce(max(4 * spark.sparkContext.defaultParallelism, size // TASK_BYTES)).select("path", "content")
    if empty_files:
        raw = raw.unionByName(_empty_files(spark, root).where(detect("path") != "unknown"))
    path = F.regexp_replace(F.col("path"), r"^file:/+", "/")
    rel = F.substring(path, F.lit(len(re.sub(r"^file:/+", "/", root).rstrip("/")) + 2), F.length(path))
    return raw.select(path.alias("path"), rel.alias("rel_path"), "content")


def _folders(root: bytes, least: int) -> list[tuple[bytearray, bool]]:
    """Folders that hold the tree between them, at least so many if there are; whether those below each belong to it."""
    opened, level = [], [root]
    while level and len(level) < least:
        opened, below = opened + level, []
        for folder in level:
            try:
                with os.scandir(folder) as entries:
                    below += [e.path for e in entries if e.is_dir(follow_symlinks=False) and os.fsdecode(e.name) not in IGNORED_DIRECTORIES]
            except OSError:
                if folder == root:
                    raise
        level = below
    return [(bytearray(f), False) for f in opened] + [(bytearray(f), True) for f in level]


def _listed(folder: bytes, deep: bool) -> Iterator[bytes]:
    """Paths of the known files of a folder and, if ``deep``, of all below it."""
    known, todo = tuple(e.encode() for e in CORE), [folder]
    while todo:
        try:
            with os.scandir(todo.pop()) as entries:
                for e in entries:
                    if e.is_dir(follow_symlinks=False):
                        if deep and os.fsdecode(e.name) not in IGNORED_DIRECTORIES:
                            todo.append(e.path)
                    elif e.name.endswith(known) and e.is_file():
                        yield e.path
        except (FileNotFoundError, NotADirectoryError, PermissionError):
            continue


def _disk_files(spark: SparkSession, root: str) -> DataFrame:
    """path, rel_path, content (bytes) of a tree on a disk that all executors see: folders are shared out to be listed, then the
    paths that were found, by hash, to be read. Hidden and empty files count, links to folders are not followed."""
    import pyarrow as pa

    home = os.fsencode(root)
    start = len(home.rstrip(b"/")) + 1

    def find(batches):
        for b in batches:
            for folder, deep in zip(*(c.to_pylist() for c in b.columns)):
                found = list(_listed(folder, deep))
                for k in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(found[k : k + 10_000], pa.binary())], ["path"])

    def read(batches):
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], ["path", "rel_path", "content"])

        rows, size = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    with open(path, "rb") as f:
                        content = f.read()
                except (FileNotFoundError, PermissionError):  # as the listing found it, not as it is now
                    continue
                rows.append((path, path[start:], content))
                size += len(content)
                if size > BATCH_BYTES or len(rows) >= 2000:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    folders = _folders(home, 8 * spark.sparkContext.defaultParallelism)
    paths = spark.createDataFrame(folders, "folder binary, deep boolean").mapInArrow(find, "path binary")
    paths = paths.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    found = paths.mapInArrow(read, "path binary, rel_path binary, content binary")
    return found.select(_text(F.col("path"), "replace").alias("path"), _text(F.col("rel_path"), "replace").alias("rel_path"), "content")


def scan(spark: SparkSession, root: str, repo_id: str | None = None, empty_files: bool = True, bad_bytes: str = "drop") -> DataFrame:
    """SRC-1: repo_id, path, rel_path, language, content of the known files under root, on any file system.

    Extensions and ignored directories prune the listing before any content is read. Bytes that are not UTF-8 are dropped,
    or with ``bad_bytes="replace"`` become U+FFFD. Elsewhere than on a disk ``empty_files`` costs a second listing.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root if re.match(r"\w[\w+.-]*:/", root) else os.path.abspath(root))
    at = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at)
    if at.toUri().getScheme() == "file":
        raw = _disk_files(spark, at.toUri().getPath())
        raw = raw if empty_files else raw.where(F.length("content") > 0)
    else:
        raw = _spark_files(spark, at.toString(), empty_files)
    files = not_ignored(raw.select(F.lit(repo_id).alias("repo_id"), "path", "rel_path", detect("rel_path").alias("language"), "content")).where("language <> 'unknown'")
    return files.select("repo_id", "path", "rel_path", "language", _text(F.col("content"), bad_bytes).alias("content"))


def read_file(files: DataFrame, rel_path: str) -> DataFrame:
    """The row of one stored file."""
    return files.where(F.col("rel_path") == rel_path)


def read_path(spark: SparkSession, root: str, rel_path: str) -> DataFrame:
    """SRC-6: rel_path, content of one file as it lies on disk, bad bytes replaced."""
    raw = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{rel_path}")
    return raw.select(F.lit(rel_path).alias("rel_path"), _text(F.col("content"), "replace").alias("content"))


def latest(files: DataFrame) -> DataFrame:
    """Of files that were ingested again, the last row of each (repo_id, rel_path); ties go to the greatest file_id."""
    newest = files.groupBy("repo_id", "rel_path").agg(F.max_by("file_id", F.struct("ingested_at", "file_id")).alias("file_id"))
    return files.join(newest.select("file_id"), "file_id", "left_semi")


def require(files: DataFrame, what: str = "source files") -> DataFrame:
    if files.isEmpty():
        raise EmptyRepository(f"no {what} found")
    return files
