"""SRC-8..11: what git prints, as rows. Running git is left to the caller (``git_lines``); tests pass text."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def git_lines(repo: str, *args: str, timeout: int = 60) -> list[str]:
    """Driver-side: lines of a git command, none where git or the repository is missing."""
    try:
        done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, timeout=timeout)
    except (OSError, subprocess.TimeoutExpired):
        return []
    return done.stdout.splitlines() if done.returncode == 0 else []


def clone(url: str, target: str, depth: int = 50) -> bool:
    """SRC-8: driver-side clone of limited depth, or a pull where the target is a clone already."""
    there = os.path.isdir(os.path.join(target, ".git"))
    command = ["git", "-C", target, "pull", "--ff-only"] if there else ["git", "clone", "--depth", str(depth), url, target]
    try:
        return subprocess.run(command, capture_output=True, timeout=600).returncode == 0
    except (OSError, subprocess.TimeoutExpired):
        return False


def commits(log: DataFrame, line: str = "line") -> DataFrame:
    """SRC-9: hash, author, subject, when of "hash|author|subject|when" lines; lines of other than four parts are dropped."""
    parts = F.split(line, r"\|", -1)
    return log.where(F.size(parts) == 4).select(parts[0].alias("hash"), parts[1].alias("author"), parts[2].alias("subject"), parts[3].alias("when"))


def branches(listing: DataFrame, line: str = "line") -> DataFrame:
    """SRC-10: branch names without the star; 'main' if there is none."""
    names = listing.select(F.trim(F.regexp_replace(F.trim(line), r"^\*\s*", "")).alias("branch")).where("branch <> ''")
    return names.unionByName(listing.sparkSession.createDataFrame([("main",)], "branch string").where(F.lit(names.isEmpty())))


def changed_files(status: DataFrame, line: str = "line") -> DataFrame:
    """SRC-11: the second field of porcelain status lines."""
    parts = F.split(F.trim(line), r"\s+")
    return status.where(F.size(parts) >= 2).select(parts[1].alias("rel_path"))
