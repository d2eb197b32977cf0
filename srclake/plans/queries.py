"""Every operator as a query over the whole supplied tables, with the SQL that it is compared with.

IDs in the docstrings are those of the operator inventory. Where there is no SQL, the docstring says why; those are
tested against brute force or hand-written cases in tests/.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclake.functions import text as T
from srclake.functions.languages import CORE, EXTENDED, detect, detect_for_patch
from srclake.operators import analytics, bugs, chunking, docs, embedding, graph_build, graph_query, incremental, patches, retrieval, review, traces, vectors
from srclake.plans.lineage import local_path, scratch
from srclake.sources import history, repository, stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: "Searches take as queries every row whose id is divisible by" this.
EVERY = 50


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- SQL fragments -------------------------------------------------------------------------------------------------

LINES = r"CASE WHEN {c} = '' THEN [] ELSE (CASE WHEN regexp_matches({c}, '(\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}])\z') THEN regexp_split_to_array({c}, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')[:-2] ELSE regexp_split_to_array({c}, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]') END) END"


def sql_lines(c: str) -> str:
    return LINES.format(c=c)


def sql_language(path: str, table: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in table.items())
    return f"CASE regexp_extract({path}, '[^/\\\\.][^/\\\\]*?(\\.[^./\\\\]*)$', 1) {cases} ELSE 'unknown' END"


WORDS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"
EMBED_SQL = """concat_ws(chr(10), '# File: ' || file_path, '# ' || kind || ': ' || name, CASE WHEN docstring <> '' THEN '\"\"\"' || docstring || '\"\"\"' END,
  CASE WHEN len(imports) > 0 THEN '# imports: ' || array_to_string(imports, ', ') END, code)"""


def tfidf_sql() -> str:
    """CTEs: tok (repo_id, chunk_seq, term, tf), model (repo_id, term, df, idf), w (repo_id, chunk_seq, term, weight)."""
    return f"""
    texts AS (SELECT repo_id, chunk_seq, {EMBED_SQL} AS text FROM chunks),
    tok AS (SELECT repo_id, chunk_seq, term, count(*) AS tf FROM (SELECT repo_id, chunk_seq, unnest({WORDS.format(c="text")}) AS term FROM texts) GROUP BY ALL),
    n AS (SELECT repo_id, count(*) AS texts FROM texts GROUP BY repo_id),
    vocab AS (SELECT repo_id, term, count(*) AS df, sum(tf) AS cf FROM tok GROUP BY repo_id, term QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY sum(tf) DESC, term) <= {embedding.VOCABULARY}),
    model AS (SELECT repo_id, term, df, ln((1 + texts) / (1 + df)) + 1 AS idf FROM vocab JOIN n USING (repo_id)),
    raw AS (SELECT repo_id, chunk_seq, term, tf * idf AS x FROM tok JOIN model USING (repo_id, term)),
    w AS (SELECT repo_id, chunk_seq, term, x / sqrt(sum(x * x) OVER (PARTITION BY repo_id, chunk_seq)) AS weight FROM raw)"""


def search_sql(k: int, report: str = "error_report") -> str:
    """CTE hits (repo_id, report_id, chunk_seq, score, rank) after tfidf_sql."""
    return f"""
    q AS (SELECT repo_id, report_id, term, count(*) AS tf FROM (SELECT repo_id, report_id, unnest({WORDS.format(c=report)}) AS term FROM bug_reports WHERE report_id % {EVERY} = 0) GROUP BY ALL),
    qraw AS (SELECT repo_id, report_id, term, tf * idf AS x FROM q JOIN model USING (repo_id, term)),
    qw AS (SELECT repo_id, report_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY repo_id, report_id)) AS qweight FROM qraw),
    scored AS (SELECT repo_id, report_id, chunk_seq, sum(qweight * weight) AS score FROM qw JOIN w USING (repo_id, term) GROUP BY ALL),
    hits AS (SELECT *, row_number() OVER (PARTITION BY repo_id, report_id ORDER BY round(score, 9) DESC, chunk_seq) AS rank FROM scored QUALIFY rank <= {k})"""


# ---- shared plans --------------------------------------------------------------------------------------------------


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return t(spark, folder, "chunks").select("repo_id", "chunk_seq", chunking.embedding_text().alias("text"))


def model_of(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    model, counts = embedding.fit(texts(spark, folder), ["repo_id"], "chunk_seq")
    return model, embedding.transform(counts, model, ["repo_id"], "chunk_seq")


def asked(spark: SparkSession, folder: str) -> DataFrame:
    return t(spark, folder, "bug_reports").where(F.col("report_id") % EVERY == 0)


def report_hits(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return _hits(spark, folder, asked(spark, folder), k)


def _hits(spark: SparkSession, folder: str, reports: DataFrame, k: int) -> DataFrame:
    """Models are by repository, so only the repositories that are asked are fitted."""
    there = texts(spark, folder).join(F.broadcast(reports.select("repo_id").distinct()), "repo_id", "left_semi")
    model, counts = embedding.fit(there, ["repo_id"], "chunk_seq")
    lengths = embedding.norms(counts, model, ["repo_id"], "chunk_seq")
    return retrieval.text_search(counts, model, reports, ["repo_id"], "chunk_seq", "report_id", "error_report", k, lengths)


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return t(spark, folder, "graph_edges").withColumnRenamed("edge_seq", "seq")


# ---- vectors -------------------------------------------------------------------------------------------------------


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 0)
SELECT v.vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS score, row_number() OVER (ORDER BY round(list_cosine_similarity(v.e, q.e), 9) DESC, v.vec_id) AS rank
FROM v, q QUALIFY rank <= 5
""")
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """VEC-1, VEC-2, VEC-3: the five nearest vectors of vector 0."""
    v = t(spark, folder, "embeddings")
    found = vectors.search(v, v.where("vec_id = 0"), 5)
    return found.select("vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.e, q.e), 9) DESC, v.vec_id) AS rank
FROM v, v AS q WHERE q.vec_id % {EVERY} = 0 AND v.vec_id <> q.vec_id QUALIFY rank <= 5
""")
def vector_topk_batch(spark: SparkSession, folder: str) -> DataFrame:
    """VEC-4: the five nearest others of every fiftieth vector."""
    v = t(spark, folder, "embeddings")
    found = vectors.search(v, v.where(F.col("vec_id") % EVERY == 0), 5, skip_self=True)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, folder: str) -> DataFrame:
    """VEC-1."""
    return t(spark, folder, "embeddings").select("vec_id", F.round(vectors.norm("embedding"), 6).alias("norm"))


@query("SELECT count(*) AS vectors FROM embeddings")
def vector_count(spark: SparkSession, folder: str) -> DataFrame:
    """VEC-5."""
    return t(spark, folder, "embeddings").agg(F.count("*").alias("vectors"))


# ---- files and chunks ----------------------------------------------------------------------------------------------


@query(f"""
SELECT file_id, {sql_language("rel_path", CORE)} AS language, {sql_language("rel_path", EXTENDED)} AS extended_language,
  coalesce(len({sql_lines("content")}), 0)::INT AS lines, coalesce(length(content), 0)::INT AS chars, md5(coalesce(content, '')) AS hash
FROM source_files
""")
def source_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-1, SRC-3, SRC-4, ANA-3, INC-1."""
    return t(spark, folder, "source_files").select(
        "file_id", detect("rel_path").alias("language"), detect("rel_path", "extended").alias("extended_language"),
        F.coalesce(T.line_count("content"), F.lit(0)).alias("lines"), F.coalesce(F.length("content"), F.lit(0)).alias("chars"), F.md5(F.coalesce("content", F.lit(""))).alias("hash"),
    )


_IGNORED = "', '".join(repository.IGNORED_DIRECTORIES)


@query(f"""
SELECT file_id, rel_path FROM source_files WHERE NOT list_has_any(string_split(rel_path, '/')[:-2], ['{_IGNORED}']) AND {sql_language("rel_path", CORE)} <> 'unknown'
""")
def scanned_files(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-2, SRC-7: files of a known language outside ignored directories."""
    files = t(spark, folder, "source_files").where(detect("rel_path") != "unknown")
    return repository.not_ignored(files).select("file_id", "rel_path")


@query(f"""
SELECT file_id, CASE {" ".join(f"WHEN ends_with(rel_path, '{s}') THEN '{lang}'" for s, lang in {'.py': 'python', '.js': 'javascript', '.ts': 'typescript', '.java': 'java', '.go': 'go', '.cpp': 'cpp', '.cs': 'csharp', '.rb': 'ruby', '.rs': 'rust'}.items())} ELSE 'python' END AS language
FROM source_files
""")
def patch_language(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-5."""
    return t(spark, folder, "source_files").select("file_id", detect_for_patch("rel_path").alias("language"))


@query("""
SELECT repo_id, rel_path, file_id, md5(coalesce(content, '')) AS hash FROM source_files
QUALIFY row_number() OVER (PARTITION BY repo_id, rel_path ORDER BY ingested_at DESC, file_id DESC) = 1
""")
def latest_files(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-6, SNK-4: the last row of each file."""
    return repository.latest(t(spark, folder, "source_files")).select("repo_id", "rel_path", "file_id", F.md5(F.coalesce("content", F.lit(""))).alias("hash"))


@query(f"""
SELECT file_id, rel_path || '::whole_file' AS chunk_id, 'block' AS kind, rel_path AS name, 1 AS start_line, len({sql_lines("content")})::INT AS end_line, md5(content) AS code_hash
FROM source_files WHERE content IS NOT NULL
""")
def file_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """CHK-5."""
    found = chunking.file_block(t(spark, folder, "source_files").where("content IS NOT NULL"))
    return found.select("file_id", "chunk_id", "kind", "name", "start_line", "end_line", F.md5("code").alias("code_hash"))


def _symbols_sql(function: str, class_: str) -> str:
    noise = "', '".join(chunking.NOISE)
    return f"""
WITH l AS (SELECT file_id, {sql_lines("content")} AS a FROM source_files WHERE content IS NOT NULL),
n AS (SELECT file_id, a, unnest(range(1, len(a) + 1)) AS k FROM l),
m AS (SELECT file_id, a, k, regexp_extract(a[k], '{function}', 1) AS f, regexp_extract(a[k], '{class_}', 1) AS c FROM n),
s AS (SELECT file_id, a, k, CASE WHEN f <> '' AND f NOT IN ('{noise}') THEN 'function' WHEN c <> '' AND c NOT IN ('{noise}') THEN 'class' END AS kind,
  CASE WHEN f <> '' AND f NOT IN ('{noise}') THEN f ELSE c END AS name FROM m),
e AS (SELECT *, greatest(coalesce(lead(k) OVER (PARTITION BY file_id ORDER BY k) - 1, len(a)), k) AS stop FROM s WHERE kind IS NOT NULL)
SELECT file_id, kind, name, k::INT AS start_line, stop::INT AS end_line, md5(array_to_string(a[k:stop], chr(10))) AS code_hash FROM e
"""


@query(_symbols_sql(chunking.FUNCTION_LINE, chunking.CLASS_LINE))
def symbol_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """CHK-6, CHK-7, CHK-9, as the rules are."""
    found = chunking.symbols(t(spark, folder, "source_files").where("content IS NOT NULL"), ["file_id"])
    return found.select("file_id", "kind", "name", "start_line", "end_line", F.md5("code").alias("code_hash"))


@query(_symbols_sql(chunking.FIXED_FUNCTION_LINE, chunking.FIXED_CLASS_LINE))
def symbol_chunks_fixed(spark: SparkSession, folder: str) -> DataFrame:
    """CHK-6, CHK-7 with the rules that also see modifiers, Go results and arrow constants."""
    found = chunking.symbols(t(spark, folder, "source_files").where("content IS NOT NULL"), ["file_id"], fixed=True)
    return found.select("file_id", "kind", "name", "start_line", "end_line", F.md5("code").alias("code_hash"))


@query(f"""
WITH l AS (SELECT file_id, list_filter({sql_lines("content")}, lambda x: regexp_matches(x, '{"|".join(f"(?:{p})" for p in chunking.IMPORT_LINES)}')) AS a FROM source_files WHERE content IS NOT NULL)
SELECT file_id, array_to_string(list_transform(a, lambda x: trim(x)), chr(10)) AS imports, len(a)::INT AS n FROM l WHERE len(a) > 0
""")
def import_lines(spark: SparkSession, folder: str) -> DataFrame:
    """CHK-8."""
    found = t(spark, folder, "source_files").where("content IS NOT NULL").select("file_id", chunking.import_lines("content").alias("a"))
    return found.where("size(a) > 0").select("file_id", F.array_join("a", "\n").alias("imports"), F.size("a").alias("n"))


@query("""
SELECT DISTINCT repo_id, file_path, lower(trim(kind)) AS kind, name, start_line, end_line, md5(code) AS code_hash FROM chunks WHERE ends_with(file_path, '.py') AND lower(trim(kind)) <> 'block'
""")
def ast_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """CHK-1..4: functions, classes and methods of every Python file, once each; the supplied chunks hold the same."""
    files = t(spark, folder, "source_files").select("repo_id", "rel_path", detect("rel_path").alias("language"), "content").where("content IS NOT NULL")
    made = chunking.chunk(files).where("language = 'python' AND kind <> 'block'")
    return made.select("repo_id", "file_path", "kind", "name", "start_line", "end_line", F.md5("code").alias("code_hash")).distinct()


_NO_SYMBOL = "file_id NOT IN (SELECT file_id FROM e)"


@query(_symbols_sql(chunking.FUNCTION_LINE, chunking.CLASS_LINE).replace("SELECT file_id, kind, name, k::INT", f"""
, p AS (SELECT DISTINCT repo_id, file_path FROM chunks WHERE ends_with(file_path, '.py') AND lower(trim(kind)) <> 'block')
SELECT DISTINCT f.repo_id, rel_path AS file_path, 'block' AS kind, rel_path AS name, 1 AS start_line, len({sql_lines("content")})::INT AS end_line, md5(content) AS code_hash
FROM source_files f LEFT JOIN p ON p.repo_id = f.repo_id AND p.file_path = f.rel_path
WHERE content IS NOT NULL AND CASE WHEN {sql_language("rel_path", CORE)} = 'python' THEN p.repo_id IS NULL ELSE {_NO_SYMBOL} END
UNION ALL SELECT DISTINCT repo_id, rel_path, kind, name, k::INT""").replace("AS code_hash FROM e\n", f"AS code_hash FROM e JOIN source_files USING (file_id) WHERE {sql_language('rel_path', CORE)} <> 'python'\n"))
def chunk_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """CHK-5, CHK-9, CHK-10: by symbols, or whole where a file has none; Python files whole where they do not parse or define nothing."""
    files = t(spark, folder, "source_files").select("repo_id", "rel_path", detect("rel_path").alias("language"), "content", "file_id").where("content IS NOT NULL")
    # Every row of a file is a file of its own here, as a file may have been ingested again.
    made = chunking.chunk(files.withColumn("repo_id", F.concat_ws("\x00", "repo_id", "file_id")), "symbols")
    kept = made.where("language <> 'python' OR kind = 'block'").withColumn("repo_id", F.substring_index("repo_id", "\x00", 1))
    return kept.select("repo_id", "file_path", "kind", "name", "start_line", "end_line", F.md5("code").alias("code_hash")).distinct()


@query(f"SELECT chunk_seq, md5({EMBED_SQL}) AS text_hash FROM chunks")
def embedding_text(spark: SparkSession, folder: str) -> DataFrame:
    """CHK-11."""
    return t(spark, folder, "chunks").select("chunk_seq", F.md5(chunking.embedding_text()).alias("text_hash"))


# ---- text retrieval ------------------------------------------------------------------------------------------------


@query(f"WITH {tfidf_sql()} SELECT repo_id, term, df, round(idf, 6) AS idf FROM model")
def term_stats(spark: SparkSession, folder: str) -> DataFrame:
    """EMB-1: the fitted model of each repository."""
    model, _ = embedding.fit(texts(spark, folder), ["repo_id"], "chunk_seq")
    return model.select("repo_id", "term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {tfidf_sql()} SELECT chunk_seq, count(*) AS terms, round(sum(weight), 6) AS total, round(max(weight), 6) AS top FROM w GROUP BY chunk_seq")
def tfidf_weights(spark: SparkSession, folder: str) -> DataFrame:
    """EMB-3: weights, summed up for each chunk."""
    _, weights = model_of(spark, folder)
    return weights.groupBy("chunk_seq").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("top"))


@query(f"WITH {tfidf_sql()}, {search_sql(5)} SELECT report_id, chunk_seq, round(score, 6) AS score, rank FROM hits")
def tfidf_search(spark: SparkSession, folder: str) -> DataFrame:
    """VEC-6, RET-1: the five nearest chunks of every fiftieth report, in its repository."""
    return report_hits(spark, folder, 5).select("report_id", "chunk_seq", F.round("score", 6).alias("score"), "rank")


_PREFIXED = f"concat('{retrieval.REPORT_PREFIX.replace(chr(10), "' || chr(10) || '")}', error_report)"


@query(f"WITH {tfidf_sql()}, {search_sql(5, _PREFIXED)} SELECT report_id, chunk_seq, round(score, 6) AS score, rank FROM hits")
def report_search(spark: SparkSession, folder: str) -> DataFrame:
    """RET-3: every fiftieth report as a question, with the words that stand before it."""
    reports = asked(spark, folder).withColumn("error_report", retrieval.report_query("error_report"))
    return _hits(spark, folder, reports, 5).select("report_id", "chunk_seq", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {tfidf_sql()}, {search_sql(8)},
    r AS (SELECT report_id, top_candidate.file_path AS target FROM bug_reports),
    p AS (SELECT h.report_id, chunk_seq, row_number() OVER (PARTITION BY h.report_id ORDER BY coalesce(file_path = target, false) DESC, rank) AS place FROM hits h JOIN r USING (report_id) JOIN chunks USING (chunk_seq))
SELECT report_id, chunk_seq, place FROM p WHERE place <= 4""")
def same_file_first(spark: SparkSession, folder: str) -> DataFrame:
    """RET-16, with the file of each report's stored candidate as the target."""
    hits = report_hits(spark, folder, 8).join(t(spark, folder, "chunks").select("chunk_seq", "file_path"), "chunk_seq")
    target = t(spark, folder, "bug_reports").select("report_id", F.col("top_candidate.file_path").alias("target"))
    return retrieval.same_file_first(hits.join(target, "report_id"), ["report_id"], F.col("target"), 4).select("report_id", "chunk_seq", "place")


def _intent_sql(c: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'''contains(lower({c}), '{k}')''' for k in words)} THEN '{name}'" for name, words in retrieval.INTENTS.items())
    return f"CASE {cases} WHEN regexp_matches(lower({c}), 'explain\\s+\\w+') THEN 'function_explain' ELSE 'general' END"


@query(f"SELECT doc_id, {_intent_sql('text')} AS intent FROM documents WHERE text IS NOT NULL")
def intent_classify(spark: SparkSession, folder: str) -> DataFrame:
    """RET-4."""
    return t(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", retrieval.intent("text").alias("intent"))


def _boost_sql(intent: str) -> str:
    cases = " ".join(f"WHEN '{n}' THEN ['" + "', '".join(ts) + "']" for n, ts in retrieval.BOOSTS.items())
    quoted = retrieval.QUOTED.replace("'", "''")
    groups = ", ".join(f"regexp_extract_all(error_report, '{quoted}', {g})" for g in (1, 2, 3))
    return f"list_concat(CASE {intent} {cases} ELSE [] END, list_filter(list_transform(list_zip({groups}), lambda z: lower(coalesce(z[1], '') || coalesce(z[2], '') || coalesce(z[3], ''))), lambda x: x <> ''))"


_BOOSTED_SQL = f"""
    asked AS (SELECT report_id, {_intent_sql("error_report")} AS intent, {_boost_sql(_intent_sql("error_report"))} AS terms FROM bug_reports WHERE report_id % {EVERY} = 0),
    found AS (SELECT h.*, a.intent, len(list_filter(a.terms, lambda x: contains(lower(concat_ws(' ', c.file_path, c.name, c.code)), x))) AS n
      FROM hits h JOIN asked a USING (report_id) JOIN chunks c USING (chunk_seq)),
    boosted AS (SELECT *, CASE WHEN n > 0 THEN least(1.0, least(1.0, score) + 0.08 * n) ELSE score END AS b FROM found),
    kept AS (SELECT *, row_number() OVER (PARTITION BY repo_id, report_id ORDER BY round(b, 9) DESC, rank) AS place FROM boosted QUALIFY place <= 5)"""


def _boosted(spark: SparkSession, folder: str) -> DataFrame:
    reports = asked(spark, folder).select("report_id", retrieval.intent("error_report").alias("intent"), retrieval.boost_terms("error_report", retrieval.intent("error_report")).alias("terms"))
    hits = report_hits(spark, folder, 15).join(reports, "report_id").join(t(spark, folder, "chunks").drop("repo_id"), "chunk_seq")
    return retrieval.boosted(hits, ["repo_id", "report_id"], "terms", F.concat_ws(" ", "file_path", "name", "code"), 5)


@query(f"WITH {tfidf_sql()}, {search_sql(15)}, {_BOOSTED_SQL} SELECT report_id, chunk_seq, intent, round(b, 6) AS score, place FROM kept")
def boosted_search(spark: SparkSession, folder: str) -> DataFrame:
    """RET-5, RET-6."""
    return _boosted(spark, folder).select("report_id", "chunk_seq", "intent", F.round("boosted", 6).alias("score"), "place")


@query(f"""WITH {tfidf_sql()}, {search_sql(15)}, {_BOOSTED_SQL}
SELECT report_id, round(CASE WHEN count(b) = 0 THEN 0.2 ELSE greatest(0.35, least(0.98, avg(b) + 0.12 + max(CASE WHEN a.intent = 'general' THEN 0 ELSE 0.1 END))) END, 6) AS confidence
FROM asked a LEFT JOIN kept USING (report_id) GROUP BY report_id""")
def answer_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """RET-7, RET-12: also of reports without a result."""
    reports = asked(spark, folder).select("report_id", retrieval.intent("error_report").alias("asked_intent"))
    kept = reports.join(_boosted(spark, folder).select("report_id", "boosted"), "report_id", "left")
    return kept.groupBy("report_id").agg(F.round(retrieval.confidence(F.col("boosted"), F.col("asked_intent")), 6).alias("confidence"))


@query(f"""WITH {tfidf_sql()}, {search_sql(5)}
SELECT report_id, count(*) AS blocks, md5(string_agg('### ' || file_path || ' :: ' || name || ' (lines ' || start_line || '-' || end_line || ', relevance=' || printf('%.2f', score) || ')' || chr(10) || '```' || coalesce(language, 'None') || chr(10) || code || chr(10) || '```', chr(10) || chr(10) ORDER BY rank)) AS context_hash
FROM hits JOIN chunks USING (chunk_seq) GROUP BY report_id""")
def context_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """RET-2."""
    hits = report_hits(spark, folder, 5).join(t(spark, folder, "chunks").drop("repo_id"), "chunk_seq")
    shown = retrieval.contexts(hits, ["report_id"])
    n = F.size(F.regexp_extract_all("context", F.lit(r"(?m)^### .* :: .* \(lines \d+-\d+, relevance"), F.lit(0)))
    return shown.select("report_id", n.cast("bigint").alias("blocks"), F.md5("context").alias("context_hash"))


_HINT_SQL = f"CASE {_intent_sql('error_report')} {' '.join(f"WHEN '{n}' THEN '{h.replace(chr(39), chr(39) * 2)}'" for n, h in retrieval.HINTS.items())} ELSE '' END"


@query(f"""
WITH e AS (SELECT repo_id, src, dst, relationship, edge_seq FROM graph_edges),
r AS (SELECT report_id, repo_id, error_report, top_candidate.file_path AS file FROM bug_reports WHERE error_report IS NOT NULL),
d AS (SELECT report_id, list('  - ' || src || ' --[' || relationship || ']--> ' || dst ORDER BY edge_seq) AS ds FROM r JOIN e ON e.repo_id = r.repo_id AND e.src = r.file GROUP BY report_id)
SELECT report_id, md5('Code of the repository:' || chr(10) || chr(10) || substring(error_report || error_report, 1, 6000) || chr(10)
  || CASE WHEN ds IS NULL THEN '' ELSE chr(10) || 'What depends on what:' || chr(10) || array_to_string(ds[1:10], chr(10)) || chr(10) END
  || chr(10) || 'Question: ' || error_report || chr(10) || {_HINT_SQL} || chr(10) || 'Name the files and lines that your answer rests on:') AS prompt_hash
FROM r LEFT JOIN d USING (report_id)
""")
def prompts(spark: SparkSession, folder: str) -> DataFrame:
    """RET-13: of every report, with the report twice as its context and the edges from its stored candidate's file."""
    r = t(spark, folder, "bug_reports").where("error_report IS NOT NULL").select("report_id", "repo_id", "error_report", F.col("top_candidate.file_path").alias("src"))
    e = edges(spark, folder).join(r.select("repo_id", "src").distinct(), ["repo_id", "src"], "left_semi")
    d = F.sort_array(F.collect_list(F.struct("seq", "src", "dst", "relationship")))
    known = r.join(e.groupBy("repo_id", "src").agg(d.alias("deps")), ["repo_id", "src"], "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<struct<seq:bigint,src:string,dst:string,relationship:string>>")))
    text = retrieval.prompt(F.concat("error_report", "error_report"), F.col("deps"), F.col("error_report"), retrieval.intent("error_report"))
    return known.select("report_id", F.md5(text).alias("prompt_hash"))


# ---- traces and bugs -----------------------------------------------------------------------------------------------


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(f"""
SELECT report_id, CASE WHEN regexp_extract(r, '{_q(traces.ERROR)}', 1) <> '' THEN regexp_extract(r, '{_q(traces.ERROR)}', 1) ELSE 'UnknownError' END AS error_type,
  CASE WHEN regexp_extract(r, '{_q(traces.ERROR)}', 1) <> '' THEN trim(regexp_extract(r, '{_q(traces.ERROR)}', 2))
       ELSE coalesce(({sql_lines("regexp_replace(r, '^\\s+|\\s+$', '', 'g')")})[1], '') END AS error_message
FROM (SELECT report_id, coalesce(error_report, '') AS r FROM bug_reports)
""")
def trace_errors(spark: SparkSession, folder: str) -> DataFrame:
    """TRC-1."""
    return t(spark, folder, "bug_reports").select("report_id", traces.error_type("error_report").alias("error_type"), traces.error_message("error_report").alias("error_message"))


def _frames_sql() -> str:
    parts = []
    for k, (p, path, line, function, default, language) in enumerate(traces.FRAMES):
        every = lambda g, p=p: f"regexp_extract_all(r, '{_q(p)}', {g})"
        f = f"CASE WHEN coalesce(z[3], '') = '' THEN '{default}' ELSE z[3] END" if function else f"'{default}'"
        parts.append(f"list_transform(list_zip({every(path)}, {every(line)}, {every(function or path)}), lambda z: {{'p': z[1], 'l': z[2]::INT, 'f': {f}, 'g': '{language}'}})")
    return f"""f AS (SELECT repo_id, report_id, list_concat({", ".join(parts)}) AS frames FROM (SELECT repo_id, report_id, coalesce(error_report, '') AS r FROM bug_reports)),
    fx AS (SELECT repo_id, report_id, unnest(range(0, len(frames)))::INT AS pos, unnest(frames) AS fr FROM f)"""


@query(f"WITH {_frames_sql()} SELECT report_id, pos, fr.p AS file_path, fr.l AS line_number, fr.f AS function, fr.g AS language FROM fx")
def trace_frames(spark: SparkSession, folder: str) -> DataFrame:
    """TRC-2..7."""
    return t(spark, folder, "bug_reports").select("report_id", F.posexplode(traces.frames("error_report")).alias("pos", "f")).select("report_id", "pos", "f.*")


_MATCH_SQL = f"""{_frames_sql()},
    kx AS (SELECT repo_id, report_id, fr, pos, unnest([fr.p, regexp_extract(fr.p, '[^/\\\\]*$')]) AS key, unnest([0, 1]) AS k FROM fx),
    keys AS (SELECT repo_id, report_id, key, min(pos * 2 + k) AS key_pos, arg_max(fr, pos * 2 + k) AS fr FROM kx GROUP BY ALL),
    fl AS (SELECT DISTINCT repo_id, rel_path AS file_path FROM source_files),
    fm AS (SELECT report_id, file_path, arg_min(fr, key_pos) AS fr FROM fl JOIN keys USING (repo_id)
      WHERE ends_with(file_path, key) OR ends_with(key, file_path) OR regexp_extract(file_path, '[^/\\\\]*$') = regexp_extract(key, '[^/\\\\]*$') GROUP BY ALL)"""


def _frame_matches(spark: SparkSession, folder: str, reports: DataFrame | None = None) -> DataFrame:
    reports = (asked(spark, folder) if reports is None else reports).select("repo_id", "report_id", traces.frames("error_report").alias("frames"))
    keys = bugs.frame_keys(reports, "report_id")
    files = t(spark, folder, "source_files").select("repo_id", F.col("rel_path").alias("file_path")).distinct()
    return bugs.match_frames(reports.select("repo_id", "report_id").join(files, "repo_id").select("report_id", "file_path"), keys, "report_id")


@query(f"WITH {_MATCH_SQL} SELECT report_id, file_path, fr.p AS frame_path, fr.l AS line_number, fr.f AS function FROM fm")
def frame_match(spark: SparkSession, folder: str) -> DataFrame:
    """BUG-2, BUG-3: files that the reports' frames point at."""
    return _frame_matches(spark, folder, t(spark, folder, "bug_reports")).select("report_id", "file_path", F.col("frame.file_path").alias("frame_path"), F.col("frame.line_number").alias("line_number"), F.col("frame.function").alias("function"))


@query(f"""WITH {tfidf_sql()}, {search_sql(15)}, {_MATCH_SQL},
    deg AS (SELECT repo_id, dst AS file_path, count(DISTINCT src) AS in_degree FROM graph_edges GROUP BY ALL),
    c AS (SELECT h.repo_id, h.report_id, h.chunk_seq, h.rank, file_path, fr IS NOT NULL AS matched, coalesce(in_degree, 0) AS in_degree,
      greatest(0.1, least(0.99, CASE WHEN fr IS NOT NULL THEN least(1.0, score + 0.5) ELSE score END + least(0.15, 0.03 * coalesce(in_degree, 0)))) AS conf
      FROM hits h JOIN chunks c USING (chunk_seq) LEFT JOIN fm USING (report_id, file_path) LEFT JOIN deg ON deg.repo_id = h.repo_id AND deg.file_path = c.file_path),
    b AS (SELECT *, min(rank) OVER (PARTITION BY report_id, file_path) AS seen FROM c QUALIFY row_number() OVER (PARTITION BY report_id, file_path ORDER BY round(conf, 6) DESC, rank) = 1)
SELECT report_id, file_path, matched, in_degree, round(conf, 6) AS confidence, row_number() OVER (PARTITION BY report_id ORDER BY round(conf, 6) DESC, seen) AS place FROM b QUALIFY place <= 5""")
def bug_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """BUG-1, BUG-4, BUG-5, BUG-7; compared, and here ranked, at six decimals, because engines round halves differently."""
    hits = report_hits(spark, folder, 15).join(t(spark, folder, "chunks").select("chunk_seq", "file_path", "name", "start_line", "end_line"), "chunk_seq")
    e, files = edges(spark, folder), t(spark, folder, "source_files")
    context = bugs.graph_context(e, files)
    joined = hits.join(_frame_matches(spark, folder), ["report_id", "file_path"], "left").join(context, ["repo_id", "file_path"], "left")
    conf = F.round(bugs.score(F.col("score"), F.col("frame").isNotNull(), F.col("in_degree")), 6)
    from pyspark.sql import Window

    rated = joined.withColumn("confidence", conf).withColumn("seen", F.min("rank").over(Window.partitionBy("report_id", "file_path")))
    best = rated.withColumn("best", F.row_number().over(Window.partitionBy("report_id", "file_path").orderBy(F.desc("confidence"), "rank"))).where("best = 1")
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("report_id").orderBy(F.desc("confidence"), "seen"))).where("place <= 5")
    return placed.select("report_id", "file_path", F.col("frame").isNotNull().alias("matched"), F.coalesce("in_degree", F.lit(0)).cast("bigint").alias("in_degree"), "confidence", "place")


_ERROR_SQL = f"""CASE WHEN regexp_extract(r, '{_q(traces.ERROR)}', 1) <> '' THEN regexp_extract(r, '{_q(traces.ERROR)}', 1) ELSE 'UnknownError' END AS etype,
  CASE WHEN regexp_extract(r, '{_q(traces.ERROR)}', 1) <> '' THEN trim(regexp_extract(r, '{_q(traces.ERROR)}', 2)) ELSE coalesce(({sql_lines("regexp_replace(r, '^\\s+|\\s+$', '', 'g')")})[1], '') END AS emsg"""


@query(f"""WITH {tfidf_sql()}, {search_sql(15)}, {_MATCH_SQL},
    d AS (SELECT DISTINCT repo_id, src, dst FROM graph_edges), kn AS (SELECT DISTINCT repo_id, rel_path AS f0 FROM source_files),
    up AS (SELECT d.repo_id, dst AS file_path, list(src ORDER BY src)[1:5] AS callers FROM d JOIN kn ON kn.repo_id = d.repo_id AND f0 = src GROUP BY ALL),
    dn AS (SELECT d.repo_id, src AS file_path, list(dst ORDER BY dst)[1:5] AS callees FROM d JOIN kn ON kn.repo_id = d.repo_id AND f0 = dst GROUP BY ALL),
    deg AS (SELECT repo_id, dst AS file_path, count(*) AS in_degree FROM d GROUP BY ALL),
    rt AS (SELECT h.repo_id, h.report_id, h.rank, h.score, c.file_path, c.name, c.start_line, c.end_line, fr, callers, callees,
      round_even(greatest(0.1, least(0.99, CASE WHEN fr IS NOT NULL THEN least(1.0, score + 0.35 + 0.15) ELSE score END + least(0.15, 0.03 * coalesce(in_degree, 0)))), 3) AS confidence
      FROM hits h JOIN chunks c USING (chunk_seq) LEFT JOIN fm ON fm.report_id = h.report_id AND fm.file_path = c.file_path LEFT JOIN deg ON deg.repo_id = h.repo_id AND deg.file_path = c.file_path
      LEFT JOIN up ON up.repo_id = h.repo_id AND up.file_path = c.file_path LEFT JOIN dn ON dn.repo_id = h.repo_id AND dn.file_path = c.file_path),
    bt AS (SELECT *, min(rank) OVER (PARTITION BY report_id, file_path) AS seen FROM rt QUALIFY row_number() OVER (PARTITION BY report_id, file_path ORDER BY confidence DESC, rank) = 1),
    pl AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY confidence DESC, seen) AS place FROM bt QUALIFY place <= 5),
    rp AS (SELECT report_id, {_ERROR_SQL} FROM (SELECT report_id, coalesce(error_report, '') AS r FROM bug_reports WHERE report_id % {EVERY} = 0)),
    ex AS (SELECT rp.report_id, etype, place, file_path, name, start_line, confidence, callers, f.frames[1] AS f1, concat_ws(' ', CASE WHEN fr IS NOT NULL THEN 'Stack trace points to ' || fr.p || ':' || fr.l || ' in ''' || fr.f || '''.' END,
      'Semantic match (similarity=' || printf('%.2f', score) || ') for ' || etype, CASE WHEN emsg <> '' THEN 'message: ''' || substring(emsg, 1, 80) || '''' END, 'Code block ''' || name || ''' spans lines ' || start_line || '-' || end_line || '.',
      CASE WHEN len(callers) > 0 THEN 'Imported/called by: ' || array_to_string(callers[1:3], ', ') || '.' END, CASE WHEN len(callees) > 0 THEN 'Depends on: ' || array_to_string(callees[1:3], ', ') || '.' END) AS explanation
      FROM rp LEFT JOIN pl USING (report_id) LEFT JOIN f ON f.report_id = rp.report_id)
SELECT report_id, place, file_path, confidence, CASE WHEN file_path IS NOT NULL THEN explanation ELSE concat_ws(' ', CASE WHEN emsg <> '' THEN 'message: ''' || substring(emsg, 1, 80) || '''' END) END AS explanation,
  CASE WHEN file_path IS NULL THEN 'No strong code matches found for ' || etype || '. Try re-indexing the repository or providing a fuller stack trace.'
  WHEN place = 1 THEN concat_ws(' ', 'Most likely root cause: ' || file_path || ' in function ''' || name || ''' around line ' || start_line || ' (confidence ' || printf('%.0f', round_even(confidence * 100, 0)) || '%).',
    CASE WHEN f1 IS NOT NULL THEN 'The stack trace originates at ' || f1.p || ':' || f1.l || '.' END, CASE WHEN len(callers) > 0 THEN 'This file is referenced by ' || len(callers) || ' upstream module(s), suggesting a shared dependency or entry-point failure.' END, explanation) END AS root_cause FROM ex LEFT JOIN (SELECT report_id, emsg FROM rp) USING (report_id)""")
def bug_explanations(spark: SparkSession, folder: str) -> DataFrame:
    """BUG-6, BUG-8: the sentences on every candidate, and on the first the likely cause."""
    reports = asked(spark, folder).select("report_id", traces.error_type("error_report").alias("etype"), traces.error_message("error_report").alias("emsg"), traces.frames("error_report").alias("frames"))
    hits = report_hits(spark, folder, 15).join(t(spark, folder, "chunks").select("chunk_seq", "file_path", "name", "start_line", "end_line"), "chunk_seq")
    found = bugs.candidates(hits, _frame_matches(spark, folder), bugs.graph_context(edges(spark, folder), t(spark, folder, "source_files")), "report_id")
    told = reports.join(found, "report_id", "left").withColumn("explanation", bugs.explanation(F.col("etype"), F.col("emsg")))
    cause = F.when(F.coalesce("place", F.lit(1)) == 1, bugs.root_cause(F.col("etype"), F.col("frames")))
    return told.select("report_id", "place", "file_path", "confidence", "explanation", cause.alias("root_cause"))


# ---- graph ---------------------------------------------------------------------------------------------------------


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY repo_id, src, dst ORDER BY edge_seq DESC) AS back FROM graph_edges)
SELECT repo_id, src, dst, relationship, internal FROM l WHERE back = 1
""")
def graph_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-9, GRQ-6: one edge per pair of nodes, the last one written."""
    return graph_build.collapsed(edges(spark, folder))


@query("""
WITH e AS (SELECT DISTINCT repo_id, src, dst FROM graph_edges)
SELECT repo_id, id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT repo_id, src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT repo_id, dst, 1, 0 FROM e) GROUP BY ALL
""")
def graph_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """GRQ-5."""
    return graph_query.degrees(edges(spark, folder))


@query("SELECT repo_id, count(*) AS edges, count(DISTINCT src || chr(0) || dst) AS pairs FROM graph_edges GROUP BY repo_id")
def graph_counts(spark: SparkSession, folder: str) -> DataFrame:
    """GRQ-6."""
    return edges(spark, folder).groupBy("repo_id").agg(F.count("*").alias("edges"), F.countDistinct("src", "dst").alias("pairs"))


@query("SELECT DISTINCT f.repo_id, rel_path FROM source_files f ANTI JOIN graph_edges e ON e.repo_id = f.repo_id AND e.dst = f.rel_path")
def unused_files(spark: SparkSession, folder: str) -> DataFrame:
    """RET-9."""
    return graph_query.unused_files(t(spark, folder, "source_files"), edges(spark, folder))


@query("""
WITH u AS (SELECT DISTINCT f.repo_id, rel_path FROM source_files f ANTI JOIN graph_edges e ON e.repo_id = f.repo_id AND e.dst = f.rel_path),
a AS (SELECT repo_id, list(rel_path ORDER BY rel_path) AS fs FROM u GROUP BY repo_id)
SELECT repo_id, 'Found ' || len(fs) || ' file(s) with zero inbound import references: ' || array_to_string(fs[1:8], ', ') || CASE WHEN len(fs) > 8 THEN ' (and ' || (len(fs) - 8) || ' more)' ELSE '' END
  || '. These may be entry points, tests, or genuinely unused code.' AS answer, array_to_string(fs[1:15], ' ') AS listed FROM a
""")
def unused_answer(spark: SparkSession, folder: str) -> DataFrame:
    """RET-10; the list is cut to 15."""
    u = graph_query.unused_summary(t(spark, folder, "source_files"), edges(spark, folder))
    return u.select("repo_id", retrieval.unused_answer(F.col("first"), F.col("n")).alias("answer"), F.array_join("first", " ").alias("listed"))


@query(f"""
WITH x AS (SELECT DISTINCT repo_id, rel_path AS file FROM source_files WHERE file_id % {EVERY} = 0),
e AS (SELECT e.repo_id, file, src, dst, relationship, 0 AS way, edge_seq FROM graph_edges e JOIN x ON x.repo_id = e.repo_id AND src = file
  UNION ALL SELECT e.repo_id, file, src, dst, relationship, 1, edge_seq FROM graph_edges e JOIN x ON x.repo_id = e.repo_id AND dst = file),
o AS (SELECT repo_id, file, src, dst, relationship, min(way::BIGINT * 1000000000000 + edge_seq) AS k FROM e GROUP BY ALL)
SELECT repo_id, file, src, dst, relationship, row_number() OVER (PARTITION BY repo_id, file ORDER BY k) AS place FROM o QUALIFY place <= 20
""")
def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """RET-8, GRQ-4, for every fiftieth file."""
    targets = t(spark, folder, "source_files").where(F.col("file_id") % EVERY == 0).select("repo_id", F.col("rel_path").alias("file")).distinct()
    return graph_query.neighbours(edges(spark, folder), targets)


@query(f"""
WITH RECURSIVE s AS (SELECT DISTINCT repo_id, rel_path AS start FROM source_files WHERE file_id % {EVERY} = 0),
r AS (SELECT repo_id, start, start AS id FROM s UNION SELECT r.repo_id, r.start, e.src FROM r JOIN graph_edges e ON e.repo_id = r.repo_id AND e.dst = r.id)
SELECT repo_id, start, id FROM r WHERE id <> start
""")
def blast_radius(spark: SparkSession, folder: str) -> DataFrame:
    """GRQ-1, GRQ-8, for every fiftieth file."""
    starts = t(spark, folder, "source_files").where(F.col("file_id") % EVERY == 0).select("repo_id", F.col("rel_path").alias("start"))
    return graph_query.blast_radius(edges(spark, folder), starts).select("repo_id", "start", "id")


#: Of any length. Only edges that lead back to where they come from can lie on a cycle, so paths are short of nothing else.
_CYCLES_SQL = """
    ie AS (SELECT DISTINCT repo_id, src, dst FROM graph_edges WHERE relationship IN ('imports', 'external_import') AND src <> dst),
    reach AS (SELECT repo_id, src AS a, dst AS b FROM ie UNION SELECT r.repo_id, r.a, ie.dst FROM reach r JOIN ie ON ie.repo_id = r.repo_id AND ie.src = r.b),
    e AS (SELECT ie.* FROM ie JOIN reach r ON r.repo_id = ie.repo_id AND r.a = ie.dst AND r.b = ie.src),
    p AS (SELECT repo_id, [src, dst] AS path FROM e WHERE src < dst
      UNION ALL SELECT p.repo_id, list_append(path, e.dst) FROM p JOIN e ON e.repo_id = p.repo_id AND e.src = path[-1] WHERE e.dst > path[1] AND NOT list_contains(path, e.dst)),
    c AS (SELECT p.repo_id, path FROM p JOIN e ON e.repo_id = p.repo_id AND e.src = path[-1] AND e.dst = path[1])"""


@query(f"WITH RECURSIVE {_CYCLES_SQL} SELECT repo_id, array_to_string(path, ' > ') AS cycle, len(path)::INT AS length FROM c")
def cycles(spark: SparkSession, folder: str) -> DataFrame:
    """GRQ-2, of any length."""
    return graph_query.cycles(edges(spark, folder)).select("repo_id", F.array_join("cycle", " > ").alias("cycle"), "length")


@query(f"WITH RECURSIVE {_CYCLES_SQL} SELECT repo_id, count(*) AS cycles FROM c GROUP BY repo_id")
def cycle_count(spark: SparkSession, folder: str) -> DataFrame:
    """GRQ-3."""
    return graph_query.cycles(edges(spark, folder)).groupBy("repo_id").agg(F.count("*").alias("cycles"))


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY repo_id, src, dst ORDER BY edge_seq DESC) AS back FROM graph_edges)
SELECT repo_id, to_json({'data': {'id': src || '->' || dst, 'source': src, 'target': dst, 'relationship': coalesce(relationship, 'depends_on'), 'internal': coalesce(internal, true)}})::VARCHAR AS json FROM l WHERE back = 1
""")
def graph_export(spark: SparkSession, folder: str) -> DataFrame:
    """SNK-8, GRQ-7."""
    return graph_query.export_edges(graph_build.collapsed(edges(spark, folder)))


@query("""
WITH l AS (SELECT repo_id, coalesce(language, 'unknown') AS language, count(*) AS n FROM source_files GROUP BY ALL),
f AS (SELECT repo_id, sum(n)::BIGINT AS files, count(*) AS languages, string_agg(language || ': ' || n, ', ' ORDER BY language) AS s FROM l GROUP BY repo_id),
e AS (SELECT repo_id, count(*) AS edges FROM (SELECT DISTINCT repo_id, src, dst FROM graph_edges) GROUP BY repo_id),
x AS (SELECT repo_id, count(DISTINCT dst) AS externals FROM graph_edges WHERE starts_with(dst, 'ext:') GROUP BY repo_id)
SELECT repo_id, files, languages, coalesce(externals, 0) AS externals, coalesce(edges, 0) AS edges, 'Repository contains ' || files || ' source files across ' || languages || ' language(s) (' || s || '). External dependencies: '
  || coalesce(externals, 0) || '. Total graph edges: ' || coalesce(edges, 0) || '.' AS summary
FROM f LEFT JOIN e USING (repo_id) LEFT JOIN x USING (repo_id)
""")
def architecture_summary(spark: SparkSession, folder: str) -> DataFrame:
    """RET-11."""
    return graph_query.architecture(t(spark, folder, "source_files"), edges(spark, folder))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return t(spark, folder, "source_files").select("repo_id", "rel_path", detect("rel_path").alias("language"), "content")


_LINE_SQL = f"""
SELECT DISTINCT repo_id, rel_path AS src, dst, relationship FROM (SELECT repo_id, rel_path, unnest({sql_lines("content")}) AS line FROM source_files WHERE {sql_language("rel_path", CORE)} <> 'python' AND content IS NOT NULL),
  (VALUES ('{graph_build.API_NODE}', 'api_call', '{graph_build.HTTP_LINE}'), ('{graph_build.DB_NODE}', 'database_call', '{graph_build.DB_LINE}')) v(dst, relationship, pattern)
WHERE CASE relationship WHEN 'api_call' THEN regexp_matches(line, '{graph_build.HTTP_LINE}') ELSE regexp_matches(line, '{graph_build.DB_LINE}') END"""


@query(f"""
SELECT DISTINCT repo_id, src, dst, relationship FROM graph_edges WHERE regexp_matches(src, '\\.py(::|$)') AND relationship IN ('defines_class', 'defines_function', 'inherits', 'imports')
UNION ALL {_LINE_SQL}
""")
def built_edges(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-1, GRF-3..5, GRF-7, GRF-10: the graph built from the files themselves. What Python files define, inherit and import
    is held against the supplied edges, calls in other files against SQL; other edges are in built_calls."""
    built = graph_build.edges(_files(spark, folder))
    python = F.col("src").rlike(r"\.py(::|$)")
    kept = built.where(F.when(python, F.col("relationship").isin("defines_class", "defines_function", "inherits", "imports")).otherwise(True))
    return kept.select("repo_id", "src", "dst", "relationship")


@query()
def built_calls(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-6, GRF-8: calls and outside imports of Python files; needs Python's parser, and the supplied edges name other calls."""
    built = graph_build.edges(_files(spark, folder)).where(F.col("src").rlike(r"\.py$"))
    return built.where("relationship IN ('api_call', 'database_call', 'external_import')").select("repo_id", "src", "dst", "relationship", "internal")


@query("""
SELECT repo_id, rel_path AS id, 'file' AS type, false AS external FROM source_files GROUP BY repo_id, rel_path
UNION ALL SELECT repo_id, dst, CASE WHEN bool_or(relationship = 'defines_class') THEN 'class' ELSE 'function' END, false FROM graph_edges WHERE regexp_matches(src, '\\.py$') AND relationship IN ('defines_class', 'defines_function') GROUP BY repo_id, dst
UNION ALL SELECT repo_id, dst, 'class', true FROM graph_edges WHERE regexp_matches(src, '\\.py::') AND relationship = 'inherits' GROUP BY repo_id, dst
""")
def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-2: nodes of files, of what Python files define, and of bases outside."""
    files = _files(spark, folder)
    made = graph_build.nodes(files, graph_build.edges(files).where("relationship IN ('defines_class', 'defines_function', 'inherits')"))
    return made.select("repo_id", "id", "type", "external")


@query()
def built_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """GRF-2, GRF-9, of the same graph."""
    files = repository.latest(t(spark, folder, "source_files")).select("repo_id", "rel_path", detect("rel_path").alias("language"), "content")
    return graph_build.nodes(files, graph_build.edges(files))


# ---- analytics, review, documentation ------------------------------------------------------------------------------


@query("SELECT repo_id, coalesce(language, 'unknown') AS language, count(*) AS files FROM source_files GROUP BY ALL")
def language_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """ANA-2."""
    return analytics.language_histogram(t(spark, folder, "source_files"))


@query(f"""
WITH s AS (SELECT repo_id, file_id, rel_path, language, coalesce(len({sql_lines("content")}), 0)::INT AS lines, coalesce(length(content), 0)::INT AS chars FROM source_files)
SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY lines DESC, file_id) AS place FROM s QUALIFY place <= 5
""")
def largest_modules(spark: SparkSession, folder: str) -> DataFrame:
    """ANA-3, ANA-4."""
    return analytics.largest(t(spark, folder, "source_files"))


@query(f"""
WITH RECURSIVE {_CYCLES_SQL},
f AS (SELECT repo_id, count(*) AS files, count(*) FILTER (WHERE coalesce(len({sql_lines("content")}), 0) > 500) AS large_files FROM source_files GROUP BY repo_id),
k AS (SELECT repo_id, count(*) FILTER (WHERE lower(trim(kind)) = 'class') AS classes, count(*) FILTER (WHERE lower(trim(kind)) IN ('function', 'method')) AS functions FROM chunks GROUP BY repo_id),
d AS (SELECT repo_id, count(*) AS dependencies FROM (SELECT DISTINCT repo_id, src, dst FROM graph_edges) GROUP BY repo_id),
y AS (SELECT repo_id, count(*) AS cycles FROM c GROUP BY repo_id), b AS (SELECT repo_id, count(*) AS bugs FROM bug_reports GROUP BY repo_id), q AS (SELECT repo_id, count(*) AS chats FROM documents GROUP BY repo_id),
j AS (SELECT repo_id, files, large_files, coalesce(classes, 0) AS classes, coalesce(functions, 0) AS functions, coalesce(dependencies, 0) AS dependencies, coalesce(cycles, 0) AS cycles, coalesce(bugs, 0) AS bugs, coalesce(chats, 0) AS chats
  FROM f LEFT JOIN k USING (repo_id) LEFT JOIN d USING (repo_id) LEFT JOIN y USING (repo_id) LEFT JOIN b USING (repo_id) LEFT JOIN q USING (repo_id))
SELECT *, round(greatest(10, least(100, 95 - CASE WHEN cycles > 0 THEN least(25, 5 * cycles) ELSE 0 END - least(20, 15.0::DOUBLE * bugs / greatest(1, files)) - least(15, 3 * large_files)))::DOUBLE, 1) AS health_score FROM j
""")
def repo_health(spark: SparkSession, folder: str) -> DataFrame:
    """ANA-1, ANA-5, ANA-6, ANA-7; documents stand for the log of questions."""
    counted = graph_query.cycles(edges(spark, folder)).groupBy("repo_id").agg(F.count("*").alias("cycles"))
    return analytics.repository_report(t(spark, folder, "source_files"), t(spark, folder, "chunks"), edges(spark, folder), counted, t(spark, folder, "bug_reports"), t(spark, folder, "documents"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """ANA-6, COL-1."""
    return stores.counts(t(spark, folder, "events"), "event_type")


def _review_sql(fixed: bool) -> str:
    cases = []
    for k, (category, severity, message, pattern) in enumerate(review.RULES):
        p = _q(review.FIXED.get(category, pattern) if fixed else pattern)
        extra = " AND ends_with(rel_path, '.py')" if category == "naming" else ""
        cases.append(f"SELECT file_id, k AS line, {k} AS rule_no, '{category}' AS category, '{severity}' AS severity, '{message}' AS message FROM n WHERE regexp_matches(a[k], '{p}'){extra}")
    return f"l AS (SELECT file_id, rel_path, {sql_lines('content')} AS a FROM source_files), n AS (SELECT file_id, rel_path, a, unnest(range(1, len(a) + 1))::INT AS k FROM l), i AS ({' UNION ALL '.join(cases)})"


@query(f"WITH {_review_sql(False)} SELECT * FROM i")
def review_issues(spark: SparkSession, folder: str) -> DataFrame:
    """REV-1, with the rules as they are."""
    return review.issues(t(spark, folder, "source_files"))


@query(f"WITH {_review_sql(True)} SELECT * FROM i")
def review_issues_fixed(spark: SparkSession, folder: str) -> DataFrame:
    """REV-1, with the rules that also match at the end of a line."""
    return review.issues(t(spark, folder, "source_files"), fixed=True)


@query(f"""
WITH {_review_sql(False)}, s AS (SELECT file_id, count(*) AS m FROM i GROUP BY file_id)
SELECT file_id, coalesce(len(a), 0)::INT AS total_lines, coalesce(m, 0) AS issues_found, CASE WHEN coalesce(m, 0) = 0 THEN 'A' WHEN m < 3 THEN 'B' ELSE 'C' END AS rating FROM l LEFT JOIN s USING (file_id)
""")
def review_summary(spark: SparkSession, folder: str) -> DataFrame:
    """REV-2, REV-4."""
    return review.summary(t(spark, folder, "source_files"))


@query(f"""
SELECT doc_id, CASE WHEN regexp_replace(d, '\\s+', '', 'g') = '' THEN '{review.CHORE}' {" ".join("WHEN " + " OR ".join(f"contains(lower(d), '{w}')" for w in ws) + f" THEN '{m}'" for ws, m in review.COMMITS)} ELSE '{review.REFACTOR}' END AS message
FROM (SELECT doc_id, coalesce(text, '') AS d FROM documents)
""")
def commit_class(spark: SparkSession, folder: str) -> DataFrame:
    """REV-3, with each document as a diff."""
    return t(spark, folder, "documents").select("doc_id", review.commit_message("text").alias("message"))


@query("""
WITH f AS (SELECT repo_id, string_agg(DISTINCT language, ', ' ORDER BY language) AS languages, count(*) AS files FROM source_files GROUP BY repo_id), c AS (SELECT repo_id, count(*) AS chunks FROM chunks GROUP BY repo_id)
SELECT repo_id, coalesce(languages, '') AS languages, files, coalesce(chunks, 0) AS chunks FROM f LEFT JOIN c USING (repo_id)
""")
def doc_overview(spark: SparkSession, folder: str) -> DataFrame:
    """DOC-1."""
    return docs.overview(t(spark, folder, "source_files"), t(spark, folder, "chunks"))


@query("""
WITH p AS (SELECT repo_id, rel_path, row_number() OVER (PARTITION BY repo_id ORDER BY rel_path, file_id) AS place, count(*) OVER (PARTITION BY repo_id) AS n FROM source_files)
SELECT repo_id, rel_path, place, greatest(n - 25, 0) AS more FROM p WHERE place <= 25
""")
def doc_paths(spark: SparkSession, folder: str) -> DataFrame:
    """DOC-2."""
    return docs.paths(t(spark, folder, "source_files"))


@query("""
SELECT repo_id, chunk_seq, name, file_path, docstring, start_line, end_line, row_number() OVER (PARTITION BY repo_id ORDER BY chunk_seq) AS place FROM chunks WHERE lower(trim(kind)) = 'class' QUALIFY place <= 10
""")
def doc_classes(spark: SparkSession, folder: str) -> DataFrame:
    """DOC-3."""
    return docs.classes(t(spark, folder, "chunks"))


@query("""
SELECT repo_id, chunk_seq, name, file_path, language, docstring, start_line, end_line, substring(code, 1, 400) || CASE WHEN length(code) > 400 THEN chr(10) || '...' ELSE '' END AS code,
  row_number() OVER (PARTITION BY repo_id ORDER BY chunk_seq) AS place FROM chunks WHERE lower(trim(kind)) IN ('function', 'method') QUALIFY place <= 30
""")
def doc_api(spark: SparkSession, folder: str) -> DataFrame:
    """DOC-4."""
    return docs.functions(t(spark, folder, "chunks"))


_DOC_SQL = """
f AS (SELECT repo_id, string_agg(DISTINCT language, ', ' ORDER BY language) AS languages, count(*) AS files FROM source_files GROUP BY repo_id), c AS (SELECT repo_id, count(*) AS chunks FROM chunks GROUP BY repo_id),
p AS (SELECT repo_id, rel_path, row_number() OVER (PARTITION BY repo_id ORDER BY rel_path, file_id) AS place, count(*) OVER (PARTITION BY repo_id) AS n FROM source_files),
tr AS (SELECT repo_id, string_agg('├── ' || rel_path || chr(10), '' ORDER BY place) AS tree, greatest(max(n) - 25, 0) AS more FROM p WHERE place <= 25 GROUP BY repo_id),
kc AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY chunk_seq) AS place FROM chunks WHERE lower(trim(kind)) = 'class' QUALIFY place <= 10),
cl AS (SELECT repo_id, string_agg('### Class `' || name || '` (`' || file_path || '`)' || chr(10) || CASE WHEN docstring <> '' THEN '> ' || docstring || chr(10) || chr(10) ELSE '' END || 'Lines: `' || start_line || '-' || end_line || '`' || chr(10) || chr(10), '' ORDER BY place) AS classes FROM kc GROUP BY repo_id),
kf AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY chunk_seq) AS place FROM chunks WHERE lower(trim(kind)) IN ('function', 'method') QUALIFY place <= 30),
ca AS (SELECT repo_id, string_agg('### `' || name || '`' || chr(10) || '- **File**: `' || file_path || '`' || chr(10) || '- **Lines**: `' || start_line || ' - ' || end_line || '`' || chr(10)
  || CASE WHEN docstring <> '' THEN '- **Docstring**: ' || docstring || chr(10) ELSE '' END || '```' || coalesce(language, '') || chr(10) || substring(code, 1, 400) || CASE WHEN length(code) > 400 THEN chr(10) || '...' ELSE '' END || chr(10) || '```' || chr(10) || chr(10), '' ORDER BY place) AS calls FROM kf GROUP BY repo_id),
pg AS (SELECT repo_id, '# ' || repo_id || chr(10) || chr(10) || '## Overview' || chr(10) || '- **Primary languages**: ' || coalesce(languages, '') || chr(10) || '- **Source files**: ' || files || chr(10) || '- **Code components**: ' || coalesce(chunks, 0)
  || chr(10) || chr(10) || '## Folder structure' || chr(10) || '```' || chr(10) || coalesce(tree, '') || CASE WHEN more > 0 THEN '└── ... (' || more || ' more files)' || chr(10) ELSE '' END || '```' || chr(10) || chr(10) || '## Core modules' || chr(10) || coalesce(classes, '') AS readme,
  '# API & Method Documentation' || chr(10) || chr(10) || coalesce(calls, '') AS api FROM f LEFT JOIN c USING (repo_id) LEFT JOIN tr USING (repo_id) LEFT JOIN cl USING (repo_id) LEFT JOIN ca USING (repo_id)),
hx AS (SELECT repo_id, readme, api, string_split(replace(replace(replace(readme || chr(10) || chr(10) || api, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '```') AS parts FROM pg)"""


@query(f"""WITH {_DOC_SQL}
SELECT repo_id, md5(readme) AS readme_hash, md5(api) AS api_hash, md5('<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<title>Documentation</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10)
  || array_to_string(list_transform(parts, lambda p, k: CASE WHEN k % 2 = 0 THEN '<pre>' || p || '</pre>' ELSE replace(p, chr(10), '<br>') END), '') || chr(10) || '</body>' || chr(10) || '</html>' || chr(10)) AS html_hash FROM hx""")
def doc_pages(spark: SparkSession, folder: str) -> DataFrame:
    """SNK-9, DOC-5, DOC-6: whole pages, by their hashes."""
    made = docs.markdown(t(spark, folder, "source_files"), t(spark, folder, "chunks"))
    return made.select("repo_id", F.md5("readme").alias("readme_hash"), F.md5("api").alias("api_hash"), F.md5(docs.html(F.concat("readme", F.lit("\n\n"), "api"))).alias("html_hash"))


# ---- incremental indexing and stored collections -------------------------------------------------------------------


@query("SELECT file_id, repo_id, rel_path, md5(coalesce(content, '')) AS hash FROM source_files")
def hash_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """INC-1."""
    f = t(spark, folder, "source_files")
    return f.select("file_id", "repo_id", "rel_path", F.md5(F.coalesce("content", F.lit(""))).alias("hash"))


_SYNC_SQL = """
    m AS (SELECT make_timestamp((epoch_us(min(ingested_at)) + epoch_us(max(ingested_at))) // 2) AS half FROM source_files),
    r AS (SELECT repo_id, rel_path, md5(coalesce(content, '')) AS h, ingested_at < half AS early, row_number() OVER (PARTITION BY repo_id, rel_path, ingested_at < half ORDER BY ingested_at DESC, file_id DESC) AS back FROM source_files, m),
    o AS (SELECT repo_id, rel_path, h AS old_hash FROM r WHERE back = 1 AND early), w AS (SELECT repo_id, rel_path, h AS new_hash FROM r WHERE back = 1 AND NOT early),
    ch AS (SELECT repo_id, rel_path, old_hash, new_hash, CASE WHEN old_hash IS NULL THEN 'added' WHEN new_hash IS NULL THEN 'deleted' WHEN old_hash <> new_hash THEN 'modified' ELSE 'unchanged' END AS change
      FROM o FULL JOIN w USING (repo_id, rel_path))"""


def _sync(spark: SparkSession, folder: str) -> DataFrame:
    """What was ingested in the first half of the time against what was in the second."""
    f = t(spark, folder, "source_files")
    low, high = f.select(F.unix_micros("ingested_at").alias("u")).agg(F.min("u"), F.max("u")).first()
    early = F.unix_micros("ingested_at") < ((low or 0) + (high or 0)) // 2
    return incremental.changes(incremental.hashes(repository.latest(f.where(early))), incremental.hashes(repository.latest(f.where(~early))))


@query(f"WITH {_SYNC_SQL} SELECT * FROM ch")
def sync_diff(spark: SparkSession, folder: str) -> DataFrame:
    """INC-2."""
    return _sync(spark, folder)


@query(f"""WITH {_SYNC_SQL}
SELECT chunk_seq, 'old' AS origin FROM chunks c ANTI JOIN (SELECT * FROM ch WHERE change IN ('modified', 'deleted')) g ON g.repo_id = c.repo_id AND g.rel_path = c.file_path
UNION ALL SELECT chunk_seq, 'new' FROM chunks c SEMI JOIN (SELECT * FROM ch WHERE change IN ('added', 'modified')) g ON g.repo_id = c.repo_id AND g.rel_path = c.file_path""")
def sync_apply(spark: SparkSession, folder: str) -> DataFrame:
    """INC-3, INC-4, INC-5, with the chunks as both the old and the fresh ones."""
    c = t(spark, folder, "chunks").select("repo_id", "file_path", "chunk_seq")
    done = incremental.apply(c.withColumn("origin", F.lit("old")), c.withColumn("origin", F.lit("new")), _sync(spark, folder))
    return done.select("chunk_seq", "origin")


@query("""
SELECT repo_id, coalesce(num_files, 0) AS num_files, coalesce(num_chunks, 0) AS num_chunks, 'kept' AS state FROM repositories r ANTI JOIN (SELECT DISTINCT repo_id FROM source_files) s USING (repo_id)
UNION ALL SELECT repo_id, f.n::INT, coalesce(c.n, 0)::INT, 'counted' FROM (SELECT repo_id, count(*) AS n FROM source_files GROUP BY repo_id) f LEFT JOIN (SELECT repo_id, count(*) AS n FROM chunks GROUP BY repo_id) c USING (repo_id)
""")
def upsert_repositories(spark: SparkSession, folder: str) -> DataFrame:
    """SNK-3, SNK-4, COL-5: counts of what was scanned replace the stored ones."""
    stored = t(spark, folder, "repositories").select("repo_id", F.coalesce("num_files", F.lit(0)).alias("num_files"), F.coalesce("num_chunks", F.lit(0)).alias("num_chunks"), F.lit("kept").alias("state"))
    chunks = t(spark, folder, "chunks").groupBy("repo_id").agg(F.count("*").cast("int").alias("num_chunks"))
    counted = t(spark, folder, "source_files").groupBy("repo_id").agg(F.count("*").cast("int").alias("num_files")).join(chunks, "repo_id", "left").fillna(0, ["num_chunks"]).withColumn("state", F.lit("counted"))
    return stores.upsert(stored, counted, ["repo_id"])


@query("SELECT repo_id, report_id, created_at, row_number() OVER (PARTITION BY repo_id ORDER BY coalesce(created_at, 0) DESC, report_id) AS place FROM bug_reports")
def history_newest(spark: SparkSession, folder: str) -> DataFrame:
    """COL-3, PAT-15, BUG-9, RET-15: each repository's reports, newest first."""
    return stores.newest(t(spark, folder, "bug_reports"), ["repo_id"], "created_at", "report_id").select("repo_id", "report_id", "created_at", "place")


@query("SELECT report_id, repo_id FROM bug_reports WHERE error_type = 'KeyError' ORDER BY report_id LIMIT 1")
def collection_first(spark: SparkSession, folder: str) -> DataFrame:
    """COL-2: the first match in the order of insertion."""
    return stores.find_first(t(spark, folder, "bug_reports"), "report_id", error_type="KeyError").select("report_id", "repo_id")


@query("""
SELECT 'reports' AS collection, repo_id, count(*) AS n, sum(report_id)::BIGINT AS ids FROM (SELECT * FROM bug_reports UNION ALL SELECT * FROM bug_reports WHERE user_id IS NULL) GROUP BY repo_id
UNION ALL SELECT 'odd/name', repo_id, count(*), sum(file_id)::BIGINT FROM source_files GROUP BY repo_id
""")
def stored_collections(spark: SparkSession, folder: str) -> DataFrame:
    """SNK-1, SNK-2, SNK-3, SRC-12, SRC-13: saved by repository, rows inserted, a name with a slash, read again; a missing one is None."""
    store = scratch(spark, "store")
    reports, files = t(spark, folder, "bug_reports"), t(spark, folder, "source_files").select("repo_id", "file_id")
    stores.save(reports, store, "reports", None)
    stores.insert(reports.where("user_id IS NULL"), store, "reports")
    stores.save(files, store, "odd/name")
    if stores.load(spark, store, "missing") is not None:
        raise AssertionError("a missing collection was found")
    both = stores.load(spark, store, "reports").select(F.lit("reports").alias("collection"), "repo_id", F.col("report_id").alias("id"))
    both = both.unionByName(stores.load(spark, store, "odd/name").select(F.lit("odd/name").alias("collection"), "repo_id", F.col("file_id").alias("id")))
    return both.groupBy("collection", "repo_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("""
SELECT repo_id, rel_path, md5(coalesce(content, '')) AS hash FROM source_files
QUALIFY row_number() OVER (PARTITION BY repo_id, rel_path ORDER BY ingested_at DESC, md5(coalesce(content, ''))) = 1
""")
def streamed_files(spark: SparkSession, folder: str) -> DataFrame:
    """INC-2, INC-3, INC-5 as a stream: the rows of all files through the stored table; what is left is the last of each file."""
    from srclake.streaming import sync

    home = scratch(spark, "stream")
    rows = spark.readStream.schema(t(spark, folder, "source_files").schema).parquet(f"{folder}/source_files*.parquet")
    rows = rows.select("repo_id", "path", "rel_path", "language", "content", "ingested_at")
    sync.sync(rows, f"{home}/store", f"{home}/checkpoint").awaitTermination()
    return stores.load(spark, f"{home}/store", "files").select("repo_id", "rel_path", F.md5(F.coalesce("content", F.lit(""))).alias("hash"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streamed_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Events by window and type with a watermark, as a stream that ends with its input."""
    from srclake.streaming import sync

    home = scratch(spark, "activity")
    events = spark.readStream.schema(t(spark, folder, "events").schema).parquet(f"{folder}/events*.parquet")
    out = lambda df, batch: df.write.mode("overwrite").parquet(f"{home}/out")
    made = sync.activity(events.withColumn("ts", F.col("ts").cast("timestamp"))).writeStream.outputMode("complete").foreachBatch(out).option("checkpointLocation", f"{home}/checkpoint")
    made.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{home}/out").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT md5(rel_path) AS hash, repo_id AS author, rel_path AS subject, epoch_us(ingested_at)::VARCHAR AS "when" FROM source_files WHERE NOT contains(rel_path, '|')""")
def git_commits(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-9: lines of a log, put together from the files' rows, as rows again."""
    log = t(spark, folder, "source_files").select(F.concat_ws("|", F.md5("rel_path"), "repo_id", "rel_path", F.unix_micros("ingested_at").cast("string")).alias("line"))
    return history.commits(log)


@query("SELECT repo_id AS branch FROM repositories")
def git_branches(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-10: a listing of branches, the present one with a star."""
    return history.branches(t(spark, folder, "repositories").select(F.concat(F.when(F.col("backend").isNull(), "* ").otherwise("  "), "repo_id").alias("line")))


@query("SELECT rel_path FROM source_files WHERE NOT regexp_matches(rel_path, '\\s')")
def git_status(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-11: porcelain status lines."""
    files = t(spark, folder, "source_files").where(~F.col("rel_path").rlike(r"\s"))
    return history.changed_files(files.select(F.concat(F.when(F.col("language").isNull(), "?? ").otherwise(" M "), "rel_path").alias("line")))


_SCANNED = f"""
SELECT rel_path, {sql_language("rel_path", CORE)} AS language, md5(content) AS hash FROM source_files
WHERE content IS NOT NULL AND NOT list_has_any(string_split(rel_path, '/')[:-2], ['{_IGNORED}']) AND {sql_language("rel_path", CORE)} <> 'unknown' AND NOT contains(rel_path, chr(92))
QUALIFY row_number() OVER (PARTITION BY rel_path ORDER BY file_id) = 1
"""


def _tree(spark: SparkSession, folder: str) -> str:
    """The files written out as a tree in the shared folder: the first of each path, by the executors."""
    home = local_path(scratch(spark, "tree"))
    first = t(spark, folder, "source_files").where(F.col("content").isNotNull() & ~F.contains("rel_path", F.lit("\\")))
    first = first.groupBy("rel_path").agg(F.min_by("content", "file_id").alias("content"))

    def write(frames):
        import os

        for frame in frames:
            for path, text in zip(frame["rel_path"], frame["content"]):
                target = f"{home}/{path}"
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "w", encoding="utf-8", newline="") as f:
                    f.write(text)
            yield frame[["rel_path"]]

    first.mapInPandas(write, "rel_path string").count()
    return home


@query(_SCANNED)
def scanned_tree(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-1, SRC-2, SRC-3, SRC-7: the files written out as a tree, and scanned."""
    return repository.scan(spark, _tree(spark, folder)).select("rel_path", "language", F.md5("content").alias("hash"))


@query(f"""
WITH s AS ({_SCANNED}), n AS (SELECT count(*) AS n FROM s)
SELECT 'files' AS what, n::VARCHAR AS value FROM n UNION ALL SELECT 'stored files', n::VARCHAR FROM n UNION ALL SELECT 'owner', 'me'
UNION ALL SELECT 'unknown repository', 'true' UNION ALL SELECT 'intent', 'login' UNION ALL SELECT 'error type', 'KeyError' UNION ALL SELECT 'questions', '1'
UNION ALL SELECT 'reports', '1' UNION ALL SELECT 'model was asked', 'true' UNION ALL SELECT 'answer', 'done' UNION ALL SELECT 'snippets', '5' UNION ALL SELECT 'sync without change', '0' UNION ALL SELECT 'sync after a change', 'added' UNION ALL SELECT 'files after it', (n + 1)::VARCHAR FROM n
""")
def engine_session(spark: SparkSession, folder: str) -> DataFrame:
    """COL-4, COL-5, RET-12, RET-14, RET-15, BUG-9, INC-4, INC-5: the whole tree as one repository that is known by its path alone:
    ingested when it is first asked for, asked with a model, localized, and synchronized."""
    from srclake.plans.engine import Engine, UnknownRepository

    home, asked_ = _tree(spark, folder), []
    engine = Engine(spark, scratch(spark, "engine"), generate=lambda question: asked_.append(question) or "done")
    engine._put("repositories", {"repo_id": "all", "repo_path": home, "owner_id": "me"}, ["repo_id"])
    files = engine.tables("all")["files"].count()
    stored = engine.list_repos().first()
    told = engine.ask("all", "how does login check the `password`?", 5)
    report = engine.localize("all", "KeyError: 'name'")
    try:
        engine.tables("none")
        unknown = False
    except UnknownRepository:
        unknown = True
    still = len(engine.sync("all", home))

    def write(frames):
        for frame in frames:
            with open(f"{home}/added_by_sync.py", "w") as f:
                f.write("def added():\n    return 1\n")
            yield frame

    spark.range(1).mapInPandas(write, "id bigint").count()
    changed = engine.sync("all", home)
    rows = [
        ("files", files), ("stored files", stored["num_files"]), ("owner", stored["owner_id"]), ("unknown repository", str(unknown).lower()), ("intent", told["intent"]),
        ("error type", report["error_type"]), ("questions", engine.history("chat", "all").count()), ("reports", engine.history("bugs", "all").count()), ("model was asked", str(len(asked_) == 1 and "Question: how does login" in asked_[0]).lower()),
        ("answer", told["answer"]), ("snippets", len(told["code_snippets"])), ("sync without change", still), ("sync after a change", ",".join(r["change"] for r in changed)), ("files after it", engine.tables("all")["files"].count()),
    ]
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "what string, value string")


@query("""
SELECT 'no such file' AS what, false AS success UNION ALL SELECT 'outside', false UNION ALL SELECT 'empty diff', false UNION ALL SELECT 'dry run', true UNION ALL SELECT 'unchanged by it', true UNION ALL SELECT 'applied', true
UNION ALL SELECT 'replaced', true UNION ALL SELECT 'backup kept', true UNION ALL SELECT 'read with bad bytes', true UNION ALL SELECT 'empty repository', true UNION ALL SELECT 'cloned', true UNION ALL SELECT 'pulled', true
""")
def patched_files(spark: SparkSession, folder: str) -> DataFrame:
    """SNK-6, SNK-7, PAT-2, PAT-9, SRC-6, SRC-8, SRC-14: a file on the driver's disk, patched in each way; a repository cloned and pulled."""
    import os
    import subprocess
    import tempfile

    from srclake.functions.pythoncode import diff_of
    from srclake.sources import files as disk

    with tempfile.TemporaryDirectory() as home:
        path, out = os.path.join(home, "a.py"), {}
        with open(path, "w") as f:
            f.write("x = 1\n")
        out["no such file"] = disk.write_patched(home, "b.py", "")["success"]
        out["outside"] = disk.write_patched(home, "../a.py", "")["success"]
        out["empty diff"] = disk.apply_diff(home, " ")["valid"]
        diff = diff_of("x = 1\n", "x = 2\n", "a.py")
        out["dry run"] = disk.apply_diff(home, diff, check_only=True)["valid"]
        out["unchanged by it"] = open(path).read() == "x = 1\n"
        applied = disk.apply_diff(home, diff)
        out["applied"] = applied["valid"] and (applied["skipped"] or open(path).read() == "x = 2\n")
        done = disk.write_patched(home, "a.py", "x = 3\n")
        out["replaced"] = done["success"] and open(path).read() == "x = 3\n"
        out["backup kept"] = os.path.exists(done["backup"])
        with open(path, "wb") as f:
            f.write(b"a\xffb")
        out["read with bad bytes"] = repository.read_path(spark, "file:" + home, "a.py").first()["content"] == "a\ufffdb"
        try:
            repository.require(t(spark, folder, "source_files").where("false"))
            out["empty repository"] = False
        except repository.EmptyRepository:
            out["empty repository"] = True
        one, two = os.path.join(home, "one"), os.path.join(home, "two")
        git = ["git", "-C", one, "-c", "user.name=n", "-c", "user.email=n@example.test"]
        for command in (["git", "init", "-q", one], [*git, "commit", "-q", "--allow-empty", "-m", "first"]):
            subprocess.run(command, check=True, capture_output=True)
        out["cloned"] = history.clone("file://" + one, two)
        subprocess.run([*git, "commit", "-q", "--allow-empty", "-m", "second"], check=True, capture_output=True)
        out["pulled"] = history.clone("file://" + one, two) and len(history.git_lines(two, "log", "--format=%s")) == 2
    return spark.createDataFrame([(k, bool(v)) for k, v in out.items()], "what string, success boolean")


@query("SELECT doc_id, count(*) AS texts FROM documents WHERE trim(coalesce(text, '')) <> '' GROUP BY doc_id")
def remote_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """EMB-5, EMB-6, EMB-7: vectors of an injected model; each text's vector says that it was sent, blank ones have zeros."""
    client = lambda batch: [[1.0 if x.strip() else 0.0, float(len(x))] for x in batch]
    made = embedding.backend("remote", client, 2)(t(spark, folder, "documents"), "doc_id", "text")
    return made.where(F.col("embedding")[0] == 1.0).groupBy("doc_id").agg(F.count("*").alias("texts"))


@query("SELECT NULL::VARCHAR AS term, NULL::BIGINT AS df WHERE false")
def blank_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """EMB-4: a corpus of blank texts has an empty vocabulary, and so no weight and no hit."""
    blank = t(spark, folder, "documents").select("repo_id", "doc_id", F.lit("  ").alias("text"))
    model, counts = embedding.fit(blank, ["repo_id"], "doc_id")
    return model.join(embedding.transform(counts, model, ["repo_id"], "doc_id").select("term").distinct(), "term", "full").select("term", "df")


@query("SELECT report_id FROM bug_reports WHERE user_id IS NULL AND error_type IS NOT DISTINCT FROM 'KeyError'")
def collection_find(spark: SparkSession, folder: str) -> DataFrame:
    """COL-1, COL-2: null-safe equality."""
    return stores.find(t(spark, folder, "bug_reports"), user_id=None, error_type="KeyError").select("report_id")


# ---- patches -------------------------------------------------------------------------------------------------------


@query("""
SELECT report_id, round(greatest(0.05, least(0.99, 0.4 * s + CASE WHEN error_type IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN user_id IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN top_candidate.start_line > 1 THEN 0.1 ELSE 0 END)), 6) AS score
FROM (SELECT *, coalesce(top_candidate.score, 0) AS s FROM bug_reports)
""")
def patch_score(spark: SparkSession, folder: str) -> DataFrame:
    """PAT-10, with flags that stand for the checks."""
    b = t(spark, folder, "bug_reports")
    changed = F.coalesce(F.col("top_candidate.start_line") > 1, F.lit(False))
    score = patches.quality(F.coalesce("top_candidate.score", F.lit(0.0)), F.col("error_type").isNotNull(), F.col("user_id").isNotNull(), changed, F.lit(False))
    return b.select("report_id", F.round(score, 6).alias("score"))


_FENCE_SQL = patches.FENCE.replace("(?s)", "(?s)")


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS c, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS bare FROM documents),
e AS (SELECT doc_id, bare, regexp_matches(c, '{_FENCE_SQL}') AS fenced, regexp_replace(regexp_extract(c, '{_FENCE_SQL}', 1), '^\\s+|\\s+$', '', 'g') AS code, regexp_replace(regexp_replace(c, '{_FENCE_SQL}', '', 'g'), '^\\s+|\\s+$', '', 'g') AS prose FROM d),
k AS (SELECT *, len(list_filter(({sql_lines("bare")})[1:5], lambda x: {" OR ".join(f"contains(x, '{s}')" for s in patches.CODE_SIGNS)})) > 0 AS looks FROM e)
SELECT doc_id, md5(CASE WHEN bare = '' THEN '' WHEN fenced THEN code WHEN looks THEN bare ELSE '' END) AS code_hash,
  md5(CASE WHEN bare = '' THEN '{patches.NO_REPLY}' WHEN fenced THEN CASE WHEN prose = '' THEN '{patches.NO_PROSE}' ELSE prose END WHEN looks THEN '{patches.PLAIN_CODE}' ELSE bare END) AS prose_hash FROM k
""")
def code_block_extract(spark: SparkSession, folder: str) -> DataFrame:
    """PAT-6, with each document as a reply."""
    got = t(spark, folder, "documents").select("doc_id", patches.extract_code("text").alias("x"))
    return got.select("doc_id", F.md5("x.code").alias("code_hash"), F.md5("x.explanation").alias("prose_hash"))


def _tag_sql(c: str) -> str:
    bare = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    rows = sql_lines(c)
    return f"CASE WHEN {c} = '' THEN {c} WHEN lower({bare(f'coalesce(({rows})[1], {chr(39) * 2})')}) IN ('{"', '".join(patches.TAGS)}') THEN {bare(f'array_to_string(({rows})[2:], chr(10))')} ELSE {bare(c)} END"


@query(f"""
WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Python' || chr(10) || text WHEN 1 THEN 'json ' || chr(10) || text ELSE text END AS c FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5({_tag_sql("c")}) AS code_hash FROM d
""")
def tag_strip(spark: SparkSession, folder: str) -> DataFrame:
    """PAT-7: each document with a tag line before it, or without one."""
    d = t(spark, folder, "documents").where("text IS NOT NULL")
    tag = F.when(F.col("doc_id") % 3 == 0, "Python\n").when(F.col("doc_id") % 3 == 1, "json \n").otherwise("")
    return d.select("doc_id", F.md5(patches.strip_tag(F.concat(tag, "text"))).alias("code_hash"))


@query("""
SELECT chunk_seq, regexp_replace(coalesce(code, ''), '^\\s+|\\s+$', '', 'g') <> regexp_replace(coalesce(docstring, ''), '^\\s+|\\s+$', '', 'g') AS changed FROM chunks
""")
def patch_changes(spark: SparkSession, folder: str) -> DataFrame:
    """PAT-11, with code and docstring as old and new."""
    empty = F.lit("")
    return t(spark, folder, "chunks").select("chunk_seq", patches.has_changes(F.coalesce("code", empty), F.coalesce("docstring", empty)).alias("changed"))


@query("""
SELECT report_id, repo_id, 'approved' AS status, coalesce(error_report, '') = '' AS was_empty FROM bug_reports WHERE report_id = (SELECT max(report_id) FROM bug_reports)
""")
def patch_status(spark: SparkSession, folder: str) -> DataFrame:
    """PAT-13: one patch's new status, edited by hand; each report stands for a patch of its text."""
    b = t(spark, folder, "bug_reports")
    last = b.agg(F.max("report_id")).first()[0]
    made = b.select(F.col("report_id").cast("string").alias("patch_id"), "report_id", "repo_id", F.lit("a.py").alias("target_file"), F.coalesce("error_report", F.lit("")).alias("original_code"), F.lit("").alias("suggested_patch"), F.lit("").alias("git_diff"), F.lit("pending").alias("status"))
    row = patches.set_status(made, str(last), "approved", "x = 1\n")
    kept = row.where("suggested_patch = 'x = 1\n' AND git_diff LIKE 'diff --git a/a.py b/a.py%+x = 1%'")
    return kept.select("report_id", "repo_id", "status", (F.col("original_code") == "").alias("was_empty"))


@query("SELECT count(*) AS failures, 'failed' AS status, 0.0::DOUBLE AS score FROM (SELECT 1)")
def patch_failure(spark: SparkSession, folder: str) -> DataFrame:
    """PAT-14: the record of a patch that could not be made."""
    made = patches.failure(spark, t(spark, folder, "repositories").agg(F.min("repo_id")).first()[0], None, "no context").where("target_file = 'unknown'")
    return made.groupBy("status").agg(F.count("*").alias("failures"), F.max("confidence_score").alias("score"))


_BY_LINE = f"""
  s AS (SELECT *, {sql_lines("content")} AS rows, {sql_lines("code")} AS own FROM j),
  z AS (SELECT *, greatest(1, start_line) AS first, len(own) AS size FROM s),
  y AS (SELECT *, first - 1 + size <= len(rows) AND regexp_replace(array_to_string(rows[first:first + size - 1], chr(10)), '^\\s+|\\s+$', '', 'g') = regexp_replace(array_to_string(own, chr(10)), '^\\s+|\\s+$', '', 'g') AS fits FROM z)"""


@query(f"""
WITH l AS (SELECT repo_id, rel_path, content FROM source_files WHERE content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo_id, rel_path ORDER BY ingested_at DESC, file_id DESC) = 1),
  j AS (SELECT chunk_seq, start_line, content, CASE WHEN chunk_seq % 2 = 0 THEN code ELSE code || ' ' END AS code FROM chunks c JOIN l ON l.repo_id = c.repo_id AND l.rel_path = c.file_path WHERE lower(trim(kind)) IN ('function', 'method') AND code IS NOT NULL), {_BY_LINE}
SELECT chunk_seq, md5(CASE WHEN code = '' THEN '#PATCH#' || content WHEN contains(content, code) THEN content[:instr(content, code) - 1] || '#PATCH#' || content[instr(content, code) + length(code):]
  WHEN fits THEN array_to_string(list_concat(list_concat(rows[:first - 1], ['#PATCH#']), rows[first + size:]), chr(10)) || CASE WHEN first + size > len(rows) OR regexp_matches(content, '[\\n\\r]\\z') THEN chr(10) ELSE '' END END) AS merged_hash
FROM y
""")
def snippet_merge(spark: SparkSession, folder: str) -> DataFrame:
    """PAT-12: every function and method replaced in its file by a mark, every other with a blank too many, which only fits by line;
    NULL where it does not stand there."""
    files = repository.latest(t(spark, folder, "source_files").where("content IS NOT NULL")).select("repo_id", F.col("rel_path").alias("file_path"), "content")
    c = t(spark, folder, "chunks").where(F.lower(F.trim("kind")).isin("function", "method") & F.col("code").isNotNull())
    c = c.select("repo_id", "file_path", "chunk_seq", F.concat("code", F.when(F.col("chunk_seq") % 2 == 0, "").otherwise(" ")).alias("code"), "start_line")
    merged = patches.merge_snippet(F.col("content"), F.col("code"), F.lit("#PATCH#"), F.col("start_line"))
    return c.join(files, ["repo_id", "file_path"]).select("chunk_seq", F.md5(merged).alias("merged_hash"))


@query()
def heuristic_patches(spark: SparkSession, folder: str) -> DataFrame:
    """PAT-1..4, PAT-8, PAT-11: an edit, its diff and check for every function; line-by-line rewriting and difflib have no SQL."""
    from srclake.functions.pythoncode import heuristic_fix, unified_diff

    c = t(spark, folder, "chunks").where(F.lower(F.trim("kind")).isin("function", "method") & F.col("code").isNotNull())
    kinds = F.array(*map(F.lit, ["KeyError", "AttributeError", "IndexError", "TypeError", "UnknownError"]))
    made = c.select("chunk_seq", "file_path", detect_for_patch("file_path").alias("language"), F.col("code").alias("original_code"), F.get(kinds, F.pmod("chunk_seq", F.lit(5)).cast("int")).alias("error_type"))
    made = made.withColumn("suggested_patch", heuristic_fix("original_code", "error_type")).withColumn("git_diff", unified_diff("original_code", "suggested_patch", "file_path"))
    return patches.validate(made).select("chunk_seq", "error_type", F.md5("suggested_patch").alias("patch_hash"), F.md5("git_diff").alias("diff_hash"), "syntax_valid", "has_changes")


@query()
def syntax_check(spark: SparkSession, folder: str) -> DataFrame:
    """PAT-8: every Python file; needs Python's parser."""
    from srclake.functions.pythoncode import python_syntax_error

    files = t(spark, folder, "source_files").where((detect("rel_path") == "python") & F.col("content").isNotNull())
    return files.select("file_id", python_syntax_error("content").alias("error"))


@query("""
SELECT file_id FROM source_files f SEMI JOIN (SELECT repo_id, file_path FROM chunks WHERE lower(trim(kind)) <> 'block') c ON c.repo_id = f.repo_id AND c.file_path = f.rel_path
WHERE ends_with(rel_path, '.py') AND content IS NOT NULL
""")
def syntax_valid(spark: SparkSession, folder: str) -> DataFrame:
    """PAT-8: Python files that parse and define something at the margin; those the supplied chunks were cut from."""
    from srclake.functions.pythoncode import python_syntax_error

    files = t(spark, folder, "source_files").where((detect("rel_path") == "python") & F.col("content").isNotNull())
    return files.where(F.col("content").rlike(r"(?m)^(?:async def|def|class)\b")).withColumn("error", python_syntax_error("content")).where("error IS NULL").select("file_id")
