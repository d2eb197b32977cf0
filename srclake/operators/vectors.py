"""VEC-*: exact cosine search over dense vectors.

Queries are a stated set; they are taken in blocks of at most BLOCK numbers, which are broadcast as one matrix. Each
Arrow batch of vectors is multiplied with it and gives its own best k per query, and only those are shuffled for the
final k, so a search costs one scan a block and k rows per batch and query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers (queries times dimension) in one broadcast block.
BLOCK = 4_000_000
ZERO = 1e-8


def norm(vector: Column | str) -> Column:
    c = F.col(vector) if isinstance(vector, str) else vector
    squares = F.transform(c, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x))


def normalise(vector: Column | str) -> Column:
    """VEC-1: unit length; zeros stay zeros."""
    c = F.col(vector) if isinstance(vector, str) else vector
    length = F.when(norm(c) == 0, F.lit(ZERO)).otherwise(norm(c))
    return F.transform(c, lambda x: x.cast("double") / length)


def check_dimension(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """VEC-2: fails on a vector of another size."""
    return df.where(F.assert_true(F.size(vector) == dim, F.lit(f"a vector does not have {dim} numbers")).isNull())


def search(vectors: DataFrame, queries: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding", skip_self: bool = False) -> DataFrame:
    """VEC-3, VEC-4: query_id, id, score, rank of the k nearest of each query; ties go to the smaller id, null vectors are skipped.

    A vector of another size than the queries' fails (VEC-2)."""
    import numpy as np

    asked = queries.select(id_, vector).where(F.col(vector).isNotNull()).orderBy(id_).toLocalIterator()
    found: DataFrame | None = None
    ids: list[int] = []
    rows: list = []

    def matrix():
        m = np.asarray(rows, dtype=np.float64)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return np.array(ids, dtype=np.int64), m / np.where(length == 0, ZERO, length)

    def add():
        nonlocal found
        part = _search_block(vectors, matrix(), k, id_, vector, skip_self)
        found = part if found is None else found.unionByName(part)
        ids.clear()
        rows.clear()

    for r in asked:
        if rows and len(r[1]) != len(rows[0]):
            raise ValueError(f"a query does not have {len(rows[0])} numbers")
        ids.append(r[0])
        rows.append(r[1])
        if len(rows) * len(r[1]) >= BLOCK:
            add()
    if rows:
        add()
    if found is None:
        found = vectors.sparkSession.createDataFrame([], f"query_id bigint, {id_} bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), id_)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(vectors: DataFrame, block, k: int, id_: str, vector: str, skip_self: bool) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(block)  # at most BLOCK numbers
    vectors = check_dimension(vectors.where(F.col(vector).isNotNull()), block[1].shape[1], vector)

    def best(batches):
        import numpy as np
        import pyarrow as pa

        query_ids, q = shared.value
        for b in batches:
            values = b.column(1)
            own = b.column(0).to_numpy(zero_copy_only=False)
            m = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
            length = np.linalg.norm(m, axis=1, keepdims=True)
            scores = q @ (m / np.where(length == 0, ZERO, length)).T
            if skip_self:
                scores = np.where(query_ids[:, None] == own[None, :], -np.inf, scores)
            take = min(k, len(own))
            order = np.lexsort((np.broadcast_to(own, scores.shape), -np.round(scores, 9)), axis=1)[:, :take]
            out_q = np.repeat(query_ids, take)
            picked = np.take_along_axis(scores, order, axis=1).ravel()
            keep = np.isfinite(picked)
            yield pa.RecordBatch.from_arrays([pa.array(out_q[keep]), pa.array(own[order].ravel()[keep]), pa.array(picked[keep])], names=["query_id", id_, "score"])

    return vectors.select(id_, vector).mapInArrow(best, f"query_id bigint, {id_} bigint, score double")
