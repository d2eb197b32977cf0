"""REV-*: line rules and commit classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclake.functions.text import contains_any, line_count, lines

# Category, severity, message and pattern of the line rules, in order. A rule of "naming" looks at .py files only.
RULES = [
    ("security", "high", "Potential hardcoded credential or dangerous shell execution identified.", r"""\b(eval\(|exec\(|os\.system\(|subprocess\.Popen\(.*shell=True|password\s*=\s*["'][^"']+["'])\b"""),
    ("naming", "low", "Python function names should follow snake_case naming conventions.", r"def\s+[A-Z]\w*"),
    ("complexity", "medium", "Deeply nested conditional block (cyclomatic complexity warning).", r"^ {16}.*(?:if |for |while )"),
    ("performance", "medium", "Unbounded loop or blocking sleep detected.", r"\b(time\.sleep|while\s+True:)\b"),
]
#: The same without the word boundary that cannot follow a bracket, quote or colon.
FIXED = {"security": RULES[0][3].removesuffix(r"\b"), "performance": r"\btime\.sleep\b|\bwhile\s+True:"}
# What callers read, suggestions and messages of commits by what a diff contains.
SUGGESTIONS = [
    "Consider extracting nested logic into decoupled helper functions.",
    "Ensure input validation and parameter checks are enforced on public methods.",
    "Verify all external system calls handle timeout and connection error exceptions.",
]
COMMITS = [
    (["auth", "login"], "feat(auth): fix authentication and improve JWT validation"),
    (["fix", "bug", "error"], "fix: resolve bug and handle boundary null check exceptions"),
    (["test"], "test: expand unit test coverage across backend modules"),
]
CHORE = "Chore: routine code cleanup and maintenance updates."
REFACTOR = "refactor: optimize core module logic and update dependency structures"


def issues(files: DataFrame, id_: str = "file_id", path: str = "rel_path", text: str = "content", fixed: bool = False) -> DataFrame:
    """REV-1: id, line, rule_no, category, severity, message; a line can raise several. Lines are scanned in place: no join."""
    numbered = files.select(id_, F.col(path).alias("path"), F.posexplode(lines(text)).alias("at", "line"))
    hits = []
    for k, (category, severity, message, pattern) in enumerate(RULES):
        applies = F.col("line").rlike(FIXED.get(category, pattern) if fixed else pattern)
        if category == "naming":
            applies = applies & F.coalesce(F.col("path").endswith(".py"), F.lit(False))
        hits.append(F.when(applies, F.struct(F.lit(k).alias("rule_no"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))))
    found = numbered.select(id_, (F.col("at") + 1).alias("line"), F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h"))
    return found.select(id_, "line", "h.*")


def summary(files: DataFrame, id_: str = "file_id", path: str = "rel_path", text: str = "content", fixed: bool = False) -> DataFrame:
    """REV-2: id, total_lines, issues_found, rating; files without an issue are there too."""
    found = issues(files, id_, path, text, fixed).groupBy(id_).agg(F.count("*").alias("issues_found"))
    out = files.select(id_, F.coalesce(line_count(text), F.lit(0)).alias("total_lines")).join(found, id_, "left").fillna(0, ["issues_found"])
    n = F.col("issues_found")
    return out.withColumn("rating", F.when(n == 0, "A").when(n < 3, "B").otherwise("C"))


def commit_message(diff: Column | str) -> Column:
    """REV-3, without a model."""
    c = F.coalesce(F.col(diff) if isinstance(diff, str) else diff, F.lit(""))
    low, out = F.lower(c), F.lit(REFACTOR)
    for words, message in reversed(COMMITS):
        out = F.when(contains_any(low, words), message).otherwise(out)
    return F.when(F.regexp_replace(c, r"\s+", "") == "", CHORE).otherwise(out)
