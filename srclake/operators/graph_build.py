"""GRF-*: a typed property graph of files, symbols, imports, inheritance and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srclake.functions.pythoncode import python_facts
from srclake.functions.text import basename, lines

# Called names and lines that mean an HTTP or a database call, and the two nodes they lead to.
HTTP_NAMES = ["get", "post", "put", "delete", "request", "fetch"]
DB_NAMES = ["execute", "find", "query", "insert", "update", "delete_one", "select"]
HTTP_LINE = r"(?i)\b(fetch|axios|http\.get|http\.post|requests\.get)\b"
DB_LINE = r"\b(SELECT|INSERT|UPDATE|DELETE|find_one|db\.)\b"
API_NODE, DB_NODE = "API:HTTP_Endpoint", "DB:Database_Query"
#: Kinds of edges between files.
IMPORTS = ["imports", "external_import"]


def facts(files: DataFrame) -> DataFrame:
    """repo_id, rel_path, fact, name, arg, seq of every Python file that parses (GRF-8: of others nothing)."""
    python = files.where(F.col("language") == "python").select("repo_id", "rel_path", F.explode(python_facts("content")).alias("f"))
    return python.select("repo_id", "rel_path", "f.*")


def import_edges(facts_: DataFrame, files: DataFrame, packages: bool = False) -> DataFrame:
    """GRF-1, GRF-3: repo_id, src, dst, relationship, internal, seq. A module is internal if its a/b.py is a file of the
    repository (with ``packages`` also a/b/__init__.py), else it leads to ext:<first part>."""
    known = files.select("repo_id", F.col("rel_path").alias("target")).distinct()
    asked = facts_.where("fact = 'import'").withColumn("target", F.concat(F.replace("name", F.lit("."), F.lit("/")), F.lit(".py")))
    found = asked.join(known.withColumn("internal", F.lit(True)), ["repo_id", "target"], "left")
    if packages:
        package = known.where(F.col("target").endswith("/__init__.py")).withColumnRenamed("target", "package")
        found = found.withColumn("package", F.replace("target", F.lit(".py"), F.lit("/__init__.py"))).join(package.withColumn("is_package", F.lit(True)), ["repo_id", "package"], "left")
        found = found.withColumn("target", F.when(F.col("internal").isNull() & F.col("is_package"), F.col("package")).otherwise(F.col("target"))).withColumn("internal", F.coalesce("internal", "is_package"))
    internal = F.coalesce("internal", F.lit(False))
    return found.select(
        "repo_id", F.col("rel_path").alias("src"), F.when(internal, F.col("target")).otherwise(F.concat(F.lit("ext:"), F.substring_index("name", ".", 1))).alias("dst"),
        F.when(internal, "imports").otherwise("external_import").alias("relationship"), internal.alias("internal"), "seq",
    )


def symbol_edges(facts_: DataFrame) -> DataFrame:
    """GRF-4..6."""
    own = F.concat("rel_path", F.lit("::"), "name")
    call = F.lower("name")
    target = F.when(call.isin(HTTP_NAMES), API_NODE).when(call.isin(DB_NAMES), DB_NODE)
    kinds = [
        ("class", F.col("rel_path"), own, F.lit("defines_class"), True), ("base", own, F.concat(F.lit("base:"), "arg"), F.lit("inherits"), False),
        ("function", F.col("rel_path"), own, F.lit("defines_function"), True),
        ("call", F.col("rel_path"), target, F.when(target == API_NODE, "api_call").otherwise("database_call"), False),
    ]
    row = F.coalesce(*[F.when(F.col("fact") == k, F.struct(s.alias("src"), d.alias("dst"), r.alias("relationship"), F.lit(i).alias("internal"))) for k, s, d, r, i in kinds])
    return facts_.select("repo_id", row.alias("e"), "seq").where("e.dst IS NOT NULL").select("repo_id", "e.*", "seq")


def line_edges(files: DataFrame) -> DataFrame:
    """GRF-7: one HTTP and one database edge at most for each file of another language."""
    other = files.where(~F.col("language").eqNullSafe("python")).select("repo_id", "rel_path", lines("content").alias("all"))
    hits = F.array(
        F.when(F.exists("all", lambda x: F.rlike(x, F.lit(HTTP_LINE))), F.struct(F.lit(API_NODE).alias("dst"), F.lit("api_call").alias("relationship"))),
        F.when(F.exists("all", lambda x: F.rlike(x, F.lit(DB_LINE))), F.struct(F.lit(DB_NODE).alias("dst"), F.lit("database_call").alias("relationship"))),
    )
    found = other.select("repo_id", F.col("rel_path").alias("src"), F.posexplode(hits).alias("seq", "h")).where("h IS NOT NULL")
    return found.select("repo_id", "src", "h.dst", "h.relationship", F.lit(False).alias("internal"), "seq")


def edges(files: DataFrame, packages: bool = False, found: DataFrame | None = None) -> DataFrame:
    """GRF-10: the multigraph, one row per (repo_id, src, dst, relationship). ``found``: the files' facts, where they are kept."""
    found = facts(files) if found is None else found
    every = import_edges(found, files, packages).unionByName(symbol_edges(found)).unionByName(line_edges(files))
    return every.groupBy("repo_id", "src", "dst", "relationship").agg(F.max("internal").alias("internal"), F.max("seq").cast("bigint").alias("seq"))


def collapsed(edges_: DataFrame, seq: str = "seq") -> DataFrame:
    """GRF-9: one edge per (repo_id, src, dst), the one written last."""
    return edges_.groupBy("repo_id", "src", "dst").agg(F.max_by("relationship", seq).alias("relationship"), F.max_by("internal", seq).alias("internal"))


def nodes(files: DataFrame, edges_: DataFrame) -> DataFrame:
    """GRF-2 and the nodes that edges lead to: repo_id, id, type, language, label, parent_file, external, one row per id."""
    own = files.select("repo_id", F.col("rel_path").alias("id"), F.lit("file").alias("type"), "language", basename("rel_path").alias("label"), F.lit(None).cast("string").alias("parent_file"), F.lit(False).alias("external"), F.lit(0).alias("o"))
    ends = edges_.select("repo_id", F.col("dst").alias("id"), F.when(F.col("relationship").isin("defines_class", "defines_function"), F.col("relationship")).alias("made"), F.when(F.col("relationship").startswith("defines_"), F.col("src")).alias("parent_file"))
    ends = ends.unionByName(edges_.select("repo_id", F.col("src").alias("id"), F.lit(None).cast("string").alias("made"), F.lit(None).cast("string").alias("parent_file")))
    kind = (
        F.when(F.col("made") == "defines_class", "class").when(F.col("made") == "defines_function", "function").when(F.col("id").startswith("ext:"), "external")
        .when(F.col("id").startswith("base:"), "class").when(F.col("id") == API_NODE, "api").when(F.col("id") == DB_NODE, "database").otherwise("symbol")
    )
    label = F.when(F.col("id") == API_NODE, "HTTP API").when(F.col("id") == DB_NODE, "Database Query").when(F.col("made").isNotNull(), F.substring_index("id", "::", -1)).otherwise(F.col("id"))
    far = F.col("id").startswith("ext:") | F.col("id").startswith("base:") | F.col("id").isin(API_NODE, DB_NODE)
    others = ends.select("repo_id", "id", kind.alias("type"), F.when(F.col("id").startswith("ext:"), "python").alias("language"), label.alias("label"), "parent_file", far.alias("external"), F.when(F.col("made").isNotNull(), 1).otherwise(2).alias("o"))
    every = own.unionByName(others)
    first = F.min_by(F.struct("type", "language", "label", "parent_file", "external"), F.struct("o", "type"))
    return every.groupBy("repo_id", "id").agg(first.alias("n")).select("repo_id", "id", "n.*")
