"""Problem 1: which source files people wrote, and which are generated, minified, vendored or data blobs.

Belief propagation over each repository's directory tree. Every file and every directory is a variable with the
five LABELS. A file's own evidence is what it says and looks like: signs in its comments, its base name, its texture, each
as the likelihood of being seen under a label. Where it lies is no evidence of the file but of its directories: a
directory's is its name. A file is tied to its directory and a directory to its parent by compatibility tables,
so a place speaks to all files below it and siblings speak to each other through the directory. The graph is a tree: one
upward and one downward sweep of messages is exact.

How it runs: one Arrow pass reads each text once and keeps five numbers a file. Messages to a directory are sums,
so they are combined before the shuffle and a directory (or repository) with a third of all files is no hot
spot; when beliefs go back to the files, directories of more than HOT files are joined in parts. The sweeps work on
directories only, one level at a time; each level is cut off with a checkpoint.

Defined results: null or empty content has no content evidence (location and name still count), and null content never goes
out; rows whose path has none of the eight extensions, or a null path, are left out; a null repo_id is a repository of its own; repeated
rows each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclake.llm.common import language, map_rows, stable

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
N = len(LABELS)

#: Directory names under which third-party copies lie, anywhere in a path. "vendor" is a common word in code
#: about sellers, so it says so only as the first component.
VENDOR_DIRS = {
    "third_party", "third-party", "thirdparty", "3rdparty", "_vendor", "vendored", "extern", "external",
    "deps", "contrib", "node_modules", "bower_components", "site-packages", "pods",
}
VENDOR_ROOTS = {"vendor", "vendors"}
GENERATED_DIRS = {"generated", "gen", "autogen", "pb", "_generated", "__generated__", "generated-src", "generated_src"}

_COMMENT = r"^[ \t]{0,1}(?:#|//+!?|/\*+!?|\*|<!--|--|;)[^\n]*?"
#: A file-level comment by which a tool signs what it wrote.
GENERATED_BY = re.compile(
    _COMMENT
    + r"(?:auto[- ]?generated(?! method stub| stub)|@generated\b|<auto-generated|code generated by|generated code\b"
    r"|(?:created|generated|written|produced) automatically|automatically (?:created|generated|written|produced)"
    r"|machine[- ](?:written|generated)|this file (?:is|was) (?:auto-?)?generated|generated by .*(?:do not|don't) (?:edit|modify)"
    r"|automatisch (?:erzeugt|generiert|erstellt)|generado autom[aá]ticamente|g[eé]n[eé]r[eé] automatiquement"
    r"|source of truth is \S+\.(?:idl|proto|tmpl|schema|y|g4)\b)",
    re.I | re.M,
)
#: A file-level comment by which third-party code names its project.
VENDORED_FROM = re.compile(
    _COMMENT
    + r"(?:bundled copy|vendored (?:copy|from)|imported verbatim|copied verbatim|see licen[cs]e\.\w|\(c\) [^\n]*\bcontributors\b"
    r"|upstream: [^\n]*\b(?:tag|version|release|synced|commit)\b|send changes to (?:the )?upstream|local patches are not kept)",
    re.I | re.M,
)
GENERATED_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw)?\.\w+|\.gen\.\w+|\.g\.\w+|\.tab\.[ch]\w*|_bindings\.\w+|AutoValue\w*\.java|_generated\.\w+|\.generated\.\w+|\.designer\.\w+)$")
MINIFIED_NAME = re.compile(r"(?:[.-]min|\.bundle|\.chunk|\.packed)\.\w+$")

_DIGITS = re.compile(r"0x[0-9A-Fa-f]+|[0-9][0-9A-Fa-f]*")
_HEXLIKE = re.compile(r"[0-9A-F]*0[0-9A-F]*|[0-9A-F]{5,}")
_STRING = re.compile(r'"[^"\\\n]*"')
_DATA = re.compile(r'^[ \t]*"[0-9a-f]{8,}": ?\{[^{}\n]*\},?\r?$|"[A-Za-z0-9+/=]{40,}"|0x[0-9A-Fa-f]+,?|\\x[0-9A-Fa-f]{2}|-?\d+(?:\.\d+)?,|\{"id":[^{}\n]*\}', re.M)


def texture(text: str) -> tuple[float, float, float, int]:
    """(share of text lines that repeat up to numbers, share of data literals, share of blanks, longest line)."""
    size = len(text)
    if not size:
        return 0.0, 0.0, 1.0, 0
    flat = _HEXLIKE.sub("0", _DIGITS.sub("0", _STRING.sub('""', text)))
    lines = [x for x in map(str.strip, flat.split("\n")) if len(x) > 4]
    repeats = 1 - len(set(lines)) / len(lines) if len(lines) >= 8 else 0.0
    data = sum(map(len, _DATA.findall(text))) / size
    blanks = (text.count(" ") + text.count("\n") + text.count("\t") + text.count("\r")) / size
    return repeats, data, blanks, max(map(len, text.split("\n")))


#: P(seen | label), labels in order; counted on the files of sf0.1, with at least FLOOR for what was never seen.
FLOOR = 0.0005
SEEN = {
    "signed_generated": [FLOOR, 0.7, 0.01, 0.02, 0.02],
    "signed_vendored": [FLOOR, 0.02, 0.1, 0.7, 0.02],
    "generated_name": [FLOOR, 0.3, 0.01, 0.02, 0.01],
    "minified_name": [FLOOR, 0.005, 0.4, 0.02, 0.005],
}
TEXTURE = {
    "regular": [FLOOR, 0.85, 0.01, 0.02, 0.03],
    "fairly_regular": [0.004, 0.08, 0.01, 0.02, 0.02],
    "data": [FLOOR, 0.01, 0.01, 0.01, 0.85],
    "some_data": [0.003, 0.01, 0.01, 0.01, 0.06],
    "compact": [FLOOR, 0.01, 0.9, 0.02, 0.01],
    "plain": [0.9915, 0.04, 0.06, 0.92, 0.03],
}
#: An empty file says nothing for itself, and is seldom worth leaving out.
EMPTY = [0.0, -3.0, -3.0, -3.0, -3.0]


def texture_class(text: str) -> str:
    repeats, data, blanks, longest = texture(text)
    if data > 0.6 and len(text) >= 200:
        return "data"
    if data > 0.4:
        return "some_data"
    if repeats > 0.6:
        return "regular"
    if blanks < 0.09 and longest > 120:
        return "compact"
    return "fairly_regular" if repeats > 0.45 else "plain"


def file_evidence(rel_path: str | None, text: str | None, signs: bool = True) -> list[float]:
    """Log-likelihood of what is seen of the file itself under each label. ``signs``: also of what it says of itself."""
    name = (rel_path or "").replace("\\", "/").rsplit("/", 1)[-1]
    seen = {"generated_name": bool(GENERATED_NAME.search(name)), "minified_name": bool(MINIFIED_NAME.search(name))}
    e = list(EMPTY)
    if text:
        e = [math.log(x) for x in TEXTURE[texture_class(text)]]
        if signs:
            seen |= {"signed_generated": bool(GENERATED_BY.search(text)), "signed_vendored": bool(VENDORED_FROM.search(text))}
    for what, yes in seen.items():
        e = [x + math.log(p if yes else 1 - p) for x, p in zip(e, SEEN[what])]
    return e


def _log_table(rows: list[list[float]]) -> list[list[float]]:
    return [[math.log(x / sum(r)) for x in r] for r in rows]


#: P(label of a file | label of its directory), directory by row. One odd file in a directory is common.
FILE_GIVEN_DIR = _log_table([[84, 5, 3, 5, 3], [6, 88, 2, 2, 2], [8, 3, 84, 3, 2], [4, 2, 3, 89, 2], [8, 4, 3, 3, 82]])
#: P(label of a directory | label of its parent), parent by row.
DIR_GIVEN_DIR = _log_table([[9976, 8, 4, 8, 4], [6, 90, 1, 2, 1], [10, 2, 84, 2, 2], [1, 1, 1, 96, 1], [10, 3, 2, 2, 83]])
ROOT = [math.log(x) for x in (0.96, 0.01, 0.01, 0.01, 0.01)]


def lse(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def file_message(e: list[float]) -> list[float]:
    """The file's message to its directory."""
    return [lse([e[f] + FILE_GIVEN_DIR[d][f] for f in range(N)]) for d in range(N)]


def _lse(values: list[Column]) -> Column:
    top = F.greatest(*values)
    total = sum((F.exp(v - top) for v in values[1:]), F.exp(values[0] - top))
    return top + F.log(total)


def _vendor_place(path: Column) -> Column:
    """The directory itself has a name under which copies lie."""
    low = F.lower(path)
    return F.element_at(F.split(low, "/"), -1).isin(*VENDOR_DIRS) | low.isin(*VENDOR_ROOTS)


def _dir_evidence(path: Column) -> list[Column]:
    folders = F.split(F.lower(path), "/")
    vendored = F.exists(folders, lambda p: p.isin(*VENDOR_DIRS)) | folders[0].isin(*VENDOR_ROOTS)
    generated = F.exists(folders, lambda p: p.isin(*GENERATED_DIRS))
    zero = F.lit(0.0)
    return [zero, F.when(generated, 4.0).otherwise(zero), zero, F.when(vendored, 60.0).otherwise(zero), zero]


#: Files of one directory that are joined with its belief in one part.
HOT = 200_000


def file_labels(files: DataFrame, signs: bool = True, propagate: bool = True) -> DataFrame:
    """file_id, repo_id, rel_path, language, label, confidence (posterior of the label) for each row of the languages.

    ``files`` has file_id, repo_id, rel_path, content; other columns are ignored. Without ``propagate`` each file is judged by
    its own evidence, without ``signs`` also without what it says of itself; both are there to measure what they are worth.
    """
    rows = files.select("file_id", "repo_id", "rel_path", "content").where(language("rel_path").isNotNull())

    def evidence():
        def one(file_id, repo_id, rel_path, content):
            e = file_evidence(rel_path, content, signs)
            folder = rel_path.replace("\\", "/").strip("/")
            folder = folder.rsplit("/", 1)[0] if "/" in folder else ""
            return [(file_id, repo_id, rel_path, repo_id or "", folder, *e, *file_message(e))]

        return one

    e, m = [f"e{i}" for i in range(N)], [f"m{i}" for i in range(N)]
    numbers = ", ".join(f"{c} double" for c in e + m)
    seen = stable(map_rows(rows, evidence, f"file_id bigint, repo_id string, rel_path string, repo string, dir string, {numbers}"))

    if not propagate:
        return _labelled(seen, [F.col(e[f]) + ROOT[f] for f in range(N)])
    # Directories: sums of the files' messages, and every ancestor as a node of its own.
    key = ["repo", "dir"]
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    local = seen.groupBy(key).agg(*[F.sum(c).alias(c) for c in m], F.count("*").alias("files"))
    parts = F.split("dir", "/")
    above = local.select(
        "repo",
        F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("dir"),
    ).distinct()
    own = _dir_evidence(F.col("dir"))
    dirs = stable(
        above.join(local, key, "left").select(
            *key, depth.alias("depth"),
            *[(F.coalesce(F.col(c), F.lit(0.0)) + own[i] + F.lit(0.0)).alias(f"b{i}") for i, c in enumerate(m)],
            F.coalesce("files", F.lit(0)).alias("files"),
        )
    )
    b, u, t = [[f"{x}{i}" for i in range(N)] for x in "but"]
    deepest = dirs.agg(F.max("depth")).first()[0]
    if deepest is None:
        return seen.select("file_id", "repo_id", "rel_path", language("rel_path").alias("language"), F.lit("").alias("label"), F.lit(0.0).alias("confidence"))
    parent = F.when(F.col("depth") <= 1, "").otherwise(F.regexp_extract("dir", r"^(.*)/", 1)).alias("parent")
    levels: list[DataFrame] = []
    for k in range(deepest, -1, -1):  # upward: u = what a directory has told its parent, b = local and children's
        level = dirs.where(F.col("depth") == k)
        if levels:
            told = levels[-1].groupBy("repo", F.col("parent").alias("dir")).agg(*[F.sum(c).alias(c) for c in u])
            level = level.join(told, key, "left").select(*key, "depth", *[(F.col(x) + F.coalesce(F.col(y), F.lit(0.0))).alias(x) for x, y in zip(b, u)])
        # That someone keeps copies under such a name says nothing of the directory around it.
        placed = _vendor_place(F.col("dir"))
        told = [F.when(placed, F.lit(0.0)).otherwise(_lse([F.col(b[c]) + DIR_GIVEN_DIR[p][c] for c in range(N)])).alias(u[p]) for p in range(N)]
        levels.append(stable(level.select(*key, parent, "depth", *b, *told)))
    top = levels.pop().select(*key, *[(F.col(x) + ROOT[i]).alias(x) for i, x in enumerate(b)])
    beliefs = [top]
    while levels:  # downward: t = what the parent tells, without what this directory had told it
        down = beliefs[-1].select("repo", F.col("dir").alias("parent"), *[F.col(x).alias(y) for x, y in zip(b, t)])
        level = levels.pop().join(down, ["repo", "parent"])
        tells = [_lse([F.col(t[p]) - F.col(u[p]) + DIR_GIVEN_DIR[p][c] for p in range(N)]) for c in range(N)]
        beliefs.append(stable(level.select(*key, *[(F.col(b[c]) + tells[c]).alias(b[c]) for c in range(N)])))
    all_dirs = beliefs[0]
    for x in beliefs[1:]:
        all_dirs = all_dirs.unionByName(x)
    hot = dirs.where(F.col("files") > HOT).select(*key, F.ceil(F.col("files") / HOT).cast("int").alias("parts"))  # at most a row for each HOT files
    seen = seen.join(F.broadcast(hot), key, "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("file_id"), "parts").cast("int"))).drop("parts")
    all_dirs = all_dirs.join(F.broadcast(hot), key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    final = [F.col(e[f]) + _lse([F.col(b[d]) - F.col(m[d]) + FILE_GIVEN_DIR[d][f] for d in range(N)]) for f in range(N)]
    return _labelled(seen.join(all_dirs, [*key, "part"]), final)


def _labelled(rows: DataFrame, scores: list[Column]) -> DataFrame:
    scored = rows.select("file_id", "repo_id", "rel_path", *[x.alias(f"s{i}") for i, x in enumerate(scores)])
    s = [F.col(f"s{i}") for i in range(N)]
    best = F.greatest(*s)
    label = F.lit(LABELS[-1])
    for i in range(N - 2, -1, -1):
        label = F.when(s[i] == best, LABELS[i]).otherwise(label)
    return scored.select("file_id", "repo_id", "rel_path", language("rel_path").alias("language"), label.alias("label"), F.exp(best - _lse(s)).alias("confidence"))


def not_handwritten(files: DataFrame) -> DataFrame:
    """file_id of the rows that go out; a row without content is none."""
    return file_labels(files.where("content IS NOT NULL")).where(F.col("label") != LABELS[0]).select("file_id")
