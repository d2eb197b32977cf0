"""EMB-*: exact sparse TF-IDF by repository, and the interface for supplied vectors.

Weights are ln((1 + N) / (1 + df)) + 1 times the raw count, L2-normalised per text; the vocabulary of a repository is
its VOCABULARY most frequent terms (ties by term). Everything is a long table (id, term, weight), so nothing is
dense and nothing but keys is shuffled. Reduction of dimensions (``reduce``) is an option; by default scores are plain cosines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srclake.functions.text import words
from srclake.plans.lineage import stable

VOCABULARY = 20_000
#: Texts sent to a remote model at once, and characters of each.
REMOTE_BATCH, REMOTE_CHARS = 16, 4000


def term_counts(texts: DataFrame, by: list[str], id_: str, text: str = "text") -> DataFrame:
    """by, id, term, tf."""
    return texts.select(*by, id_, F.explode(words(text)).alias("term")).groupBy(*by, id_, "term").agg(F.count("*").alias("tf"))


#: Parts in which terms of equal count are ranked before the last of them are.
PARTS = 64


def vocabulary(counts: DataFrame, by: list[str], size: int = VOCABULARY) -> DataFrame:
    """EMB-1: by, term, df, cf of the most frequent terms.

    How often each count occurs tells at which count the vocabulary ends, so only terms of that one count are ranked, and
    these in PARTS first: no task sorts a repository's terms.
    """
    stats = counts.groupBy(*by, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    if not by:
        return stats.orderBy(F.desc("cf"), "term").limit(size)
    steps = stats.groupBy(*by, "cf").agg(F.count("*").alias("equal"))
    above = F.sum("equal").over(Window.partitionBy(*by).orderBy(F.desc("cf")).rowsBetween(Window.unboundedPreceding, -1))
    room = steps.withColumn("room", size - F.coalesce(above, F.lit(0))).where("room > 0")
    kept = stats.join(room, [*by, "cf"])
    columns = [*by, "term", "df", "cf"]
    tied = kept.where("equal > room").withColumn("part", F.pmod(F.xxhash64("term"), F.lit(PARTS)))
    for group in ([*by, "part"], by):
        tied = tied.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("term"))).where("rank <= room")
    return kept.where("equal <= room").select(columns).unionByName(tied.select(columns))


def fit(texts: DataFrame, by: list[str], id_: str, text: str = "text", size: int = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(model: by, term, df, idf; counts: by, id, term, tf). N counts every text, also those without a word.

    Both are read several times by every search, so they are written once (checkpoints) instead of being worked out again.
    """
    counts = stable(term_counts(texts, by, id_, text))
    vocab = vocabulary(counts, by, size)
    if by:
        vocab = vocab.join(texts.groupBy(*by).agg(F.count("*").alias("texts")), by)
    else:
        vocab = vocab.withColumn("texts", F.lit(texts.count()))
    return stable(vocab.select(*by, "term", "df", (F.log((1 + F.col("texts")) / (1 + F.col("df"))) + 1).alias("idf"))), counts


def norms(counts: DataFrame, model: DataFrame, by: list[str], id_: str) -> DataFrame:
    """by, id, norm: length of each text's vector before it is made 1."""
    w = F.col("tf") * F.col("idf")
    return counts.join(model, [*by, "term"]).groupBy(*by, id_).agg(F.sqrt(F.sum(w * w)).alias("norm"))


def transform(counts: DataFrame, model: DataFrame, by: list[str], id_: str) -> DataFrame:
    """EMB-3: by, id, term, weight (unit length by id); terms outside the model are ignored, and a text without any has no row."""
    raw = counts.join(model, [*by, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    return raw.join(norms(counts, model, by, id_), [*by, id_]).select(*by, id_, "term", (F.col("w") / F.col("norm")).alias("weight"))


def backend(name: str, client: Callable[[list[str]], list[list[float]]] | None = None, dim: int = 768) -> Callable[[DataFrame, str, str], DataFrame]:
    """EMB-6: how texts become rows to search, by name: "tfidf" (term counts) or "remote" (vectors of an injected model)."""
    if name == "tfidf":
        return lambda texts, id_, text: term_counts(texts, [], id_, text)
    if name == "remote" and client is not None:
        return lambda texts, id_, text: embed_with(texts, id_, text, client, dim)
    raise ValueError(f"unknown backend {name}" if client else f"{name} needs a client")


def embed_with(texts: DataFrame, id_: str, text: str, client: Callable[[list[str]], list[list[float]]], dim: int) -> DataFrame:
    """EMB-5, EMB-8: vectors from an injected model, in batches; a batch that fails is tried text by text, and a text that fails
    becomes zeros."""

    def run(frames):
        for frame in frames:
            out = []
            values = [(t or "")[:REMOTE_CHARS] for t in frame[text]]
            for k in range(0, len(values), REMOTE_BATCH):
                part = values[k : k + REMOTE_BATCH]
                try:
                    out += client(part)
                except Exception:
                    for t in part:
                        try:
                            out += client([t])
                        except Exception:
                            out.append([0.0] * dim)
            yield frame[[id_]].assign(embedding=out)

    return texts.select(id_, text).mapInPandas(run, f"{id_} bigint, embedding array<float>")


def reduce(weights: DataFrame, id_: str, dim: int = 512) -> DataFrame:
    """EMB-2, an option: id, vector: weights of one collection projected on their leading min(dim, V - 1, N - 1) directions.

    The terms' second moments are summed on the executors; the driver holds V rows of ``dim`` numbers, V being at most
    VOCABULARY. Signs of directions are arbitrary, as always.
    """
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

    terms = weights.select("term").distinct().orderBy("term").withColumn("at", F.row_number().over(Window.orderBy("term")) - 1)
    v, n = terms.count(), weights.select(id_).distinct().count()
    if not n:
        return weights.select(id_).withColumn("vector", F.array().cast("array<double>")).limit(0)
    k = min(dim, max(1, v - 1), max(1, n - 1))
    sparse = weights.join(F.broadcast(terms), "term").groupBy(id_).agg(F.sort_array(F.collect_list(F.struct("at", "weight"))).alias("w"))
    rows = sparse.rdd.map(lambda r: IndexedRow(r[0], Vectors.sparse(v, [x["at"] for x in r["w"]], [x["weight"] for x in r["w"]])))
    matrix = IndexedRowMatrix(rows, numCols=v)
    projected = matrix.multiply(matrix.computeSVD(k, computeU=False).V)
    return projected.rows.map(lambda r: (r.index, r.vector.toArray().tolist())).toDF(f"{id_} bigint, vector array<double>")
