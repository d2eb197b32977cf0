"""Problem 2: source files that do not parse as their language.

Every text is lexed once, in Arrow batches, into token classes; from there on the work is on rows. Of each file
come its distinct adjacent pairs of classes, its brackets, in blocks of BLOCK tokens within which matching ones have
cancelled, and the place where its statements stop being productions of the grammar. Then

1. pairs are anti-joined against those that the language's grammar permits (a table derived from the grammar, of a
   few thousand rows, so it is broadcast);
2. statement productions are reduced depth by depth, from the innermost bracketed group outwards, by the same grammar
   (``automata``): a group counts as one symbol at the depth around it;
3. brackets that blocks left over are matched by windowed reductions: depth is a running sum, and on each depth
   an opener must be followed by its closer.

Only files with something left over are shuffled. Tokens never are: a file is some hundred short rows, and an
unlexable one is a single row.

Defined results: null content is no case; empty or blank content parses; a row of no known language (or a null
path) is left out; each repeated row is judged for itself; a byte-order mark, CRLF and a missing final newline are
fine; an empty table gives an empty result. C and C++ are judged without expanding macros: directives are left out, and a
macro must stand where a name, a call or a type may. Of Rust's macros those of the standard library that take
expressions are judged inside, others only by their brackets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srclake.llm.automata import reductions
from srclake.llm.common import language, map_rows
from srclake.llm.grammars import GRAMMARS, pairs
from srclake.llm.lexing import lex, unmatched

#: Tokens in a block whose brackets are matched before the shuffle.
BLOCK = 4096
#: Classes shown around the place where a statement breaks.
SHOWN = 3


def broken(lang: str, classes: str) -> list[str]:
    """The classes around the place where statements break the grammar; none if they do not."""
    whole = f"${classes}$"
    at = reductions(lang).broken(whole)
    return [] if at is None else [whole[max(0, at - SHOWN) : at + SHOWN]]


def adjacent(classes: str) -> set[str]:
    """Distinct pairs; a line end that only may end a statement stands between no pair."""
    found: set[str] = set()
    for part in f"${classes}$".split("\n"):
        found.update(map("".join, zip(part, part[1:])))
    return found


def pieces(file_id: int, lang: str, text: str) -> list[tuple]:
    """(file_id, language, error, pairs, where statements break, brackets by block) of one file."""
    classes, error = lex(lang, text)
    if error or not classes:
        return [(file_id, lang, error, [], [], [])] if error else []
    blocks = [unmatched(classes[i : i + BLOCK]) for i in range(0, len(classes), BLOCK)]
    return [(file_id, lang, "", list(adjacent(classes)), broken(lang, classes), blocks if any(blocks) else [])]


def judge(lang: str, text: str) -> str | None:
    """What is wrong with one text, or None: the same three steps without tables."""
    for _, _, error, near, statements, blocks in pieces(0, lang, text):
        if error or statements or unmatched("".join(blocks)) or set(near) - pairs(lang):
            return error or next(iter(statements), None) or unmatched("".join(blocks)) or min(set(near) - pairs(lang))
    return None


def findings(files: DataFrame) -> DataFrame:
    """file_id, reason (lexical, pair, statement, nesting), what: everything that is wrong with each file."""
    rows = files.select("file_id", "content", language("rel_path").alias("lang")).where("lang IS NOT NULL AND content IS NOT NULL AND content <> ''")

    def one():
        return lambda file_id, content, lang: pieces(file_id, lang, content)

    lexed = map_rows(rows, one, "file_id bigint, lang string, error string, pairs array<string>, statements array<string>, blocks array<string>")
    parts = F.concat(
        F.when(F.col("error") != "", F.array(F.struct(F.lit("lexical").alias("reason"), F.col("error").alias("what"), F.lit(0).alias("at")))).otherwise(F.array()),
        F.transform("pairs", lambda p: F.struct(F.lit("pair").alias("reason"), p.alias("what"), F.lit(0).alias("at"))),
        F.transform("statements", lambda s: F.struct(F.lit("statement").alias("reason"), s.alias("what"), F.lit(0).alias("at"))),
        F.transform("blocks", lambda b, i: F.struct(F.lit("nesting").alias("reason"), b.alias("what"), i.cast("int").alias("at"))),
    )
    tokens = lexed.select("file_id", "lang", F.explode(parts).alias("r")).select("file_id", "lang", "r.*")
    permitted = files.sparkSession.createDataFrame(
        [(lang, "pair", p) for lang in GRAMMARS for p in sorted(pairs(lang))], "lang string, reason string, what string"
    )
    left = tokens.join(F.broadcast(permitted), ["lang", "reason", "what"], "left_anti")
    # One pass: what is wrong by itself goes through, brackets go on to the windows.
    chars = left.select(
        "file_id", "reason", F.when(F.col("reason") != "nesting", F.col("what")).alias("what"), "at",
        F.posexplode_outer(F.when(F.col("reason") == "nesting", F.split("what", ""))).alias("k", "ch"),
    ).where("reason <> 'nesting' OR ch <> ''")
    opens = F.col("ch").isin("(", "[", "{")
    step = F.when(F.col("reason") != "nesting", 0).when(opens, 1).otherwise(-1)
    in_file = Window.partitionBy("file_id").orderBy("at", "k")
    depth = chars.withColumn("d", F.sum(step).over(in_file.rowsBetween(Window.unboundedPreceding, 0))).withColumn("d", F.when(opens, F.col("d")).otherwise(F.col("d") + 1))
    on_depth = Window.partitionBy("file_id", "reason", "d").orderBy("at", "k")
    mate = F.translate("ch", ")]}", "([{")
    matched = F.when(opens, F.translate(F.lead("ch").over(on_depth), ")]}", "([{") == F.col("ch")).otherwise(F.lag("ch").over(on_depth) == mate)
    judged = depth.withColumn("fits", F.coalesce(matched, F.lit(False)))
    return judged.where("reason <> 'nesting' OR NOT fits").select("file_id", "reason", F.coalesce("what", "ch").alias("what"))


def invalid(files: DataFrame) -> DataFrame:
    """file_id of the files that do not parse."""
    return findings(files).select("file_id").distinct()


def rates(files: DataFrame) -> DataFrame:
    """repo_id, language, files, invalid_files, rate."""
    known = files.select("file_id", "repo_id", language("rel_path").alias("language")).where("language IS NOT NULL")
    return (
        known.join(invalid(files).withColumn("bad", F.lit(1)), "file_id", "left")
        .groupBy("repo_id", "language")
        .agg(F.count("*").alias("files"), F.count("bad").alias("invalid_files"))
        .withColumn("rate", F.col("invalid_files") / F.col("files"))
    )
