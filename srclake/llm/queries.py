"""The pN_ queries: each applies one problem's operator, with its production parameters, to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from srclake.llm import origin

    return origin.not_handwritten(table(spark, folder, "source_files"))


@query()
def p1_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Files per repository, language and label."""
    from srclake.llm import origin

    return origin.file_labels(table(spark, folder, "source_files")).groupBy("repo_id", "language", "label").agg(F.count("*").alias("files"))


@query()
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    from srclake.llm import syntax

    return syntax.invalid(table(spark, folder, "source_files"))


@query()
def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    from srclake.llm import syntax

    return syntax.rates(table(spark, folder, "source_files"))


@query()
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from srclake.llm import credentials

    return credentials.scan_all(table(spark, folder, "source_files"), table(spark, folder, "chunks")).select("origin", "row_id", "line_no")


@query()
def p3_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that hold credentials, with these masked in place."""
    from srclake.llm import credentials

    return credentials.scan_all(table(spark, folder, "source_files"), table(spark, folder, "chunks"), redact=True)


_P4 = """
SELECT 'source_files' AS origin, file_id AS row_id FROM source_files
WHERE length(content) > (SELECT min(max_chars) FROM split_limits WHERE origin = 'source_files')
UNION ALL
SELECT 'chunks' AS origin, chunk_seq AS row_id FROM chunks
WHERE length(code) > (SELECT min(max_chars) FROM split_limits WHERE origin = 'chunks')
"""


@query(_P4)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    from srclake.llm import splitting

    found = splitting.pieces_all(*(table(spark, folder, t) for t in ("source_files", "chunks", "split_limits")), with_text=False)
    return found.where("piece_no = 1").select("origin", "row_id")


@query()
def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    from srclake.llm import splitting

    return splitting.pieces_all(*(table(spark, folder, t) for t in ("source_files", "chunks", "split_limits")))


@query()
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with documentation of their own; what a method inherits is not its own."""
    from srclake.llm import docpairs

    return docpairs.documented(table(spark, folder, "chunks"), inherit=False).select("chunk_seq")


@query()
def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    from srclake.llm import docpairs

    return docpairs.pairs(table(spark, folder, "chunks"))

#: TESTDATA.md sets three-word sequences and 0.7 for this problem.
P6 = {"threshold": 0.7, "width": 3, "least_words": 40}


_P6 = """
WITH f AS (SELECT chunk_seq, regexp_extract_all(code, '[A-Za-z0-9_]+') AS a FROM chunks WHERE lower(trim(kind)) IN ('function', 'method') AND code IS NOT NULL),
s AS (SELECT DISTINCT chunk_seq, a[k] || ' ' || a[k + 1] || ' ' || a[k + 2] AS g FROM (SELECT chunk_seq, a, unnest(range(1, len(a) - 1)) AS k FROM f WHERE len(a) >= 40)),
n AS (SELECT chunk_seq, count(*) AS n FROM s GROUP BY chunk_seq),
j AS (SELECT x.chunk_seq AS a, y.chunk_seq AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.chunk_seq < y.chunk_seq GROUP BY ALL)
SELECT a AS chunk_seq_a, b AS chunk_seq_b FROM j JOIN n na ON na.chunk_seq = a JOIN n nb ON nb.chunk_seq = b WHERE 10 * c >= 7 * (na.n + nb.n - c)
"""


@query(_P6)
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    from srclake.llm import neardup

    return neardup.expand(*neardup.near_duplicates(table(spark, folder, "chunks"), **P6))


@query()
def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    from srclake.llm import neardup

    return neardup.groups(*neardup.near_duplicates(table(spark, folder, "chunks"), **P6))


_P7 = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS a FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+') AS a FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(a[k:k + 11], ' ') AS g FROM (SELECT doc_id, a, unnest(range(1, len(a) - 10)) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(a[k:k + 11], ' ') AS g FROM (SELECT item_id, a, unnest(range(1, len(a) - 10)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""


@query(_P7)
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    from srclake.llm import leakage

    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


@query()
def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    from srclake.llm import leakage

    return leakage.clean(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@query()
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_shares(spark, folder).where("short").select("source")


@query()
def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    from srclake.llm import mixing

    targets = table(spark, folder, "mix_targets")
    return mixing.shares(mixing.token_lengths(table(spark, folder, "documents"), targets), targets)


@query()
def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    from srclake.llm import mixing

    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


@query()
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    from srclake.llm import reading

    return reading.levels(table(spark, folder, "documents"), table(spark, folder, "reading_labels")).where("level = 4").select("doc_id")


@query()
def p9_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per source, language and level."""
    from srclake.llm import reading

    return reading.profile(table(spark, folder, "documents"), table(spark, folder, "reading_labels"))
