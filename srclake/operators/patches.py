"""PAT-*: extracting, merging, checking and rating patches. Diffs and heuristic edits are in functions.pythoncode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclake.functions.pythoncode import python_syntax_error, unified_diff
from srclake.functions.text import clamp, contains_any, let, lines

# Fences, language tags, signs of code and default texts.
FENCE = r"(?s)```(?:\w+)?\s*\n(.*?)```"
TAGS = ["python", "javascript", "typescript", "java", "go", "cpp", "c++", "csharp", "c#", "ruby", "rust", "php", "bash", "shell", "json"]
CODE_SIGNS = ["def ", "class ", "function ", "import ", "const ", "var ", "public ", "return "]
NO_REPLY, NO_PROSE, PLAIN_CODE = "Empty LLM response.", "Fix generated by the model based on error context.", "AI generated patch based on error report pattern."
WEIGHTS = {"localization": 0.40, "syntax": 0.25, "git": 0.20, "changed": 0.10, "model": 0.05}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def extract_code(reply: Column | str) -> Column:
    """PAT-6: struct(code, explanation): the first fenced block and the prose around all of them; without a fence the
    whole reply as code if one of its first five lines looks like it, else as prose."""
    c = F.coalesce(F.col(reply) if isinstance(reply, str) else reply, F.lit(""))
    fenced, bare = c.rlike(FENCE), strip(c)
    prose = strip(F.regexp_replace(c, FENCE, ""))
    looks = F.exists(F.slice(lines(bare), 1, 5), lambda x: contains_any(x, CODE_SIGNS))
    pair = lambda a, b: F.struct(a.alias("code"), b.alias("explanation"))
    return (
        F.when(bare == "", pair(F.lit(""), F.lit(NO_REPLY)))
        .when(fenced, pair(strip(F.regexp_extract(c, FENCE, 1)), F.when(prose == "", NO_PROSE).otherwise(prose)))
        .when(looks, pair(bare, F.lit(PLAIN_CODE))).otherwise(pair(F.lit(""), bare))
    )


def strip_tag(code: Column | str, language: Column | None = None) -> Column:
    """PAT-7: without a first line that is only a language's name."""
    c = F.col(code) if isinstance(code, str) else code
    rows = lines(c)
    first = F.lower(strip(F.coalesce(F.get(rows, 0), F.lit(""))))
    tag = first.isin(TAGS)
    if language is not None:
        tag = tag | F.coalesce(first == F.lower(language), F.lit(False))
    return F.when(c == "", c).when(tag, strip(F.array_join(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), "\n"))).otherwise(strip(c))


def merge_snippet(full: Column, snippet: Column, patch: Column, start_line: Column) -> Column:
    """PAT-12: the first exact occurrence replaced; else as many lines from start_line on, if they are the snippet but for outer
    blanks; else NULL."""
    at = F.when(snippet == "", 1).otherwise(F.instr(full, snippet))
    exact = F.concat(F.substring(full, F.lit(1), at - 1), patch, F.substring(full, at + F.length(snippet), F.length(full)))
    own, first = lines(snippet), F.greatest(F.lit(1), start_line)

    def by_line(x: Column) -> Column:
        rows, size = x["rows"], F.size(x["own"])
        fits = (first - 1 + size <= F.size(rows)) & (strip(F.array_join(F.slice(rows, first, size), "\n")) == strip(F.array_join(x["own"], "\n")))
        rest = F.slice(rows, first + size, F.greatest(F.size(rows), F.lit(1)))
        joined = F.array_join(F.concat(F.slice(rows, F.lit(1), first - 1), F.array(patch), rest), "\n")
        return F.when(fits, F.when((F.size(rest) == 0) | full.rlike(r"[\n\r]\z"), F.concat(joined, F.lit("\n"))).otherwise(joined))

    return F.when(at > 0, exact).when(at == 0, let(F.struct(lines(full).alias("rows"), own.alias("own")), by_line))


def has_changes(old: Column, new: Column) -> Column:
    """PAT-11."""
    return strip(old) != strip(new)


def quality(localization: Column, syntax: Column, git: Column, changed: Column, model: Column) -> Column:
    """PAT-10, not yet rounded to three decimals."""
    total = localization * WEIGHTS["localization"]
    for flag, name in ((syntax, "syntax"), (git, "git"), (changed, "changed"), (model, "model")):
        total = total + F.when(flag, WEIGHTS[name]).otherwise(0.0)
    return clamp(total, 0.05, 0.99)


def validate(patches: DataFrame, git_check: Column | None = None) -> DataFrame:
    """PAT-8, PAT-9, PAT-11: adds syntax_error, syntax_valid (only Python is parsed), git_apply_valid and has_changes.

    ``git_check`` is an injected result of a dry run; without one it counts as skipped and valid.
    """
    error = F.when(F.col("language") == "python", python_syntax_error("suggested_patch"))
    checked = patches.withColumn("syntax_error", error).withColumn("syntax_valid", F.col("syntax_error").isNull())
    checked = checked.withColumn("git_apply_valid", git_check if git_check is not None else F.lit(True))
    return checked.withColumn("has_changes", has_changes(F.col("original_code"), F.col("suggested_patch")))


def prompt(report: Column, error_type: Column, target: Column, context: Column, snippet: Column) -> Column:
    """PAT-5: what a model is asked: the report and its type, the file, retrieved code, and the code to mend."""
    parts = [
        F.lit("Mend the code below so that the reported error no longer occurs. Reply with one fenced block of code and a short reason."),
        F.concat(F.lit("Error type: "), error_type), F.concat(F.lit("Report:\n"), report), F.concat(F.lit("File: "), target),
        F.when(context != "", F.concat(F.lit("Related code:\n\n"), context)), F.concat(F.lit("Code to mend:\n```\n"), snippet, F.lit("\n```")),
    ]
    return F.concat_ws("\n\n", *parts)


def set_status(patches: DataFrame, patch_id: str, status: str, edit: str | None = None) -> DataFrame:
    """PAT-13: the patch's row with its new status, and with a new diff where it was edited by hand."""
    row = patches.where(F.col("patch_id") == patch_id).withColumn("status", F.lit(status))
    if edit is not None:
        row = row.withColumn("suggested_patch", F.lit(edit)).withColumn("git_diff", unified_diff("original_code", "suggested_patch", "target_file"))
    return row


def failure(spark, repo_id: str, target: str | None, reason: str) -> DataFrame:
    """PAT-14: the record of a patch that could not be made; it is not stored."""
    import uuid

    return spark.createDataFrame(
        [(str(uuid.uuid4()), repo_id, target or "unknown", "", "", "", reason, 0.0, "failed")],
        "patch_id string, repo_id string, target_file string, original_code string, suggested_patch string, git_diff string, explanation string, confidence_score double, status string",
    )
