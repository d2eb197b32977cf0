"""GRQ-*, RET-8..11, SNK-8: reachability, cycles, degrees, neighbourhoods of the dependency graph.

Iterative queries work semi-naively: each round joins only the newest rows, and is cut off with a checkpoint in the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srclake.operators.graph_build import IMPORTS
from srclake.plans.lineage import stable


def simple(edges: DataFrame) -> DataFrame:
    """Distinct (repo_id, src, dst)."""
    return edges.select("repo_id", "src", "dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """GRQ-5: repo_id, id, in_degree, out_degree over distinct edges, of every node that an edge touches."""
    e = simple(edges)
    ends = e.select("repo_id", F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select("repo_id", F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("repo_id", "id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def blast_radius(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """GRQ-1, GRQ-8: repo_id, start, id, distance: all that leads to a start, directly or not, without the start itself.

    ``starts`` has repo_id, start. A start of which no edge knows gives no rows.
    """
    e = stable(simple(edges).select("repo_id", F.col("dst").alias("at"), F.col("src").alias("id")))
    frontier = stable(starts.select("repo_id", "start", F.col("start").alias("id")).distinct())
    seen, out, distance = frontier, None, 0
    while not frontier.isEmpty():
        distance += 1
        step = frontier.select("repo_id", "start", F.col("id").alias("at")).join(e, ["repo_id", "at"]).select("repo_id", "start", "id").distinct()
        frontier = stable(step.join(seen, ["repo_id", "start", "id"], "left_anti"))
        part = frontier.withColumn("distance", F.lit(distance))
        out = part if out is None else out.unionByName(part)
        seen = seen.unionByName(frontier)
    return (out if out is not None else frontier.withColumn("distance", F.lit(0))).where("id <> start")


def cycles(edges: DataFrame, longest: int | None = None, relationships: list[str] | None = None) -> DataFrame:
    """GRQ-2: repo_id, cycle (from its least node on), length of all elementary cycles of two and more nodes.

    Paths grow from their least node until none is left, so each cycle is found once; ``longest`` ends that earlier. Nodes
    that cannot lie on a cycle (no way in or no way out) are pruned away first, round by round, which on most graphs
    leaves little to walk. Strongly tangled parts have exponentially many cycles, and all of them are listed.
    """
    kinds = relationships or IMPORTS
    e = stable(simple(edges.where(F.col("relationship").isin(kinds))).where("src <> dst"))
    while True:
        kept = e.join(e.select("repo_id", F.col("dst").alias("src")).distinct(), ["repo_id", "src"], "left_semi")
        kept = stable(kept.join(e.select("repo_id", F.col("src").alias("dst")).distinct(), ["repo_id", "dst"], "left_semi"))
        before, after = e.count(), kept.count()
        e = kept
        if after == before or after == 0:
            break
    step = e.select("repo_id", F.col("src").alias("at"), F.col("dst").alias("next"))
    paths = e.where("src < dst").select("repo_id", F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    out, length = None, 2
    while True:
        grown = paths.join(step, ["repo_id", "at"])
        closed = grown.where(F.col("next") == F.col("path")[0]).select("repo_id", F.col("path").alias("cycle"), F.lit(length).alias("length"))
        # Read once per round, so that a later union does not join all rounds again.
        closed = stable(closed)
        out = closed if out is None else out.unionByName(closed)
        if length == longest:
            break
        paths = stable(
            grown.where((F.col("next") > F.col("path")[0]) & ~F.array_contains("path", F.col("next"))).select("repo_id", F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("at"))
        )
        if paths.isEmpty():
            break
        length += 1
    return out


def unused_files(files: DataFrame, edges: DataFrame) -> DataFrame:
    """RET-9: repo_id, rel_path of the files that no edge leads to."""
    return files.select("repo_id", "rel_path").distinct().join(edges.select("repo_id", F.col("dst").alias("rel_path")).distinct(), ["repo_id", "rel_path"], "left_anti")


def unused_summary(files: DataFrame, edges: DataFrame, most: int = 15) -> DataFrame:
    """RET-10: repo_id, n, first (the first unused files by name)."""
    u = unused_files(files, edges)
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("rel_path"))
    first = u.withColumn("r", place).where(F.col("r") <= most).groupBy("repo_id").agg(F.sort_array(F.collect_list("rel_path")).alias("first"))
    return u.groupBy("repo_id").agg(F.count("*").alias("n")).join(first, "repo_id")


def neighbours(edges: DataFrame, targets: DataFrame, limit: int = 20, seq: str = "seq") -> DataFrame:
    """RET-8, GRQ-4: repo_id, file, src, dst, relationship, place: out-edges, then in-edges, without repeats, the first 20."""
    out = edges.join(targets.select("repo_id", F.col("file").alias("src")), ["repo_id", "src"], "left_semi").withColumn("file", F.col("src")).withColumn("way", F.lit(0))
    back = edges.join(targets.select("repo_id", F.col("file").alias("dst")), ["repo_id", "dst"], "left_semi").withColumn("file", F.col("dst")).withColumn("way", F.lit(1))
    once = out.unionByName(back).groupBy("repo_id", "file", "src", "dst", "relationship").agg(F.min(F.struct("way", seq)).alias("o"))
    place = F.row_number().over(Window.partitionBy("repo_id", "file").orderBy("o"))
    return once.withColumn("place", place).where(F.col("place") <= limit).drop("o")


def architecture(files: DataFrame, edges: DataFrame) -> DataFrame:
    """RET-11: repo_id, files, languages, externals, edges, summary."""
    kind = F.coalesce("language", F.lit("unknown"))
    per = files.groupBy("repo_id", kind.alias("language")).agg(F.count("*").alias("n")).groupBy("repo_id").agg(
        F.sum("n").alias("files"), F.count("*").alias("languages"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("language", "n"))), lambda x: F.concat(x["language"], F.lit(": "), x["n"].cast("string"))), ", ").alias("by_language")
    )
    e = simple(edges).groupBy("repo_id").agg(F.count("*").alias("edges"))
    far = edges.where(F.col("dst").startswith("ext:")).select("repo_id", "dst").distinct().groupBy("repo_id").agg(F.count("*").alias("externals"))
    joined = per.join(e, "repo_id", "left").join(far, "repo_id", "left").fillna(0, ["edges", "externals"])
    text = F.concat(
        F.lit("Repository contains "), F.col("files").cast("string"), F.lit(" source files across "), F.col("languages").cast("string"), F.lit(" language(s) ("), "by_language",
        F.lit("). External dependencies: "), F.col("externals").cast("string"), F.lit(". Total graph edges: "), F.col("edges").cast("string"), F.lit("."),
    )
    return joined.select("repo_id", "files", "languages", "externals", "edges", text.alias("summary"))


def export_nodes(nodes: DataFrame) -> DataFrame:
    """SNK-8: repo_id, json."""
    row = F.struct("id", F.coalesce("label", "id").alias("label"), F.coalesce("type", F.lit("node")).alias("type"), F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("external", F.lit(False)).alias("external"))
    return nodes.select("repo_id", F.to_json(F.struct(row.alias("data"))).alias("json"))


def export_edges(edges: DataFrame) -> DataFrame:
    """SNK-8: repo_id, json."""
    row = F.struct(F.concat("src", F.lit("->"), "dst").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), F.coalesce("relationship", F.lit("depends_on")).alias("relationship"), F.coalesce("internal", F.lit(True)).alias("internal"))
    return edges.select("repo_id", F.to_json(F.struct(row.alias("data"))).alias("json"))
