"""What the training-data operators share: languages, tokenizer files, checkpoints, Arrow mapping."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srclake.plans.lineage import stable  # noqa: F401 - used by the operators

#: Last extension of a path -> language. Fixed values of the data description.
LANGUAGE_OF_EXTENSION = {
    "py": "python", "js": "javascript", "ts": "typescript", "java": "java",
    "go": "go", "c": "c", "cpp": "cpp", "rs": "rust",
}

#: Folder of the public tokenizers' vocabulary files; every operator that needs one takes it as a parameter.
TOKENIZER_DIR = "/opt/tokenizers"


def language(rel_path: Column | str) -> Column:
    """Language by the last extension of the path; NULL for every other file (and for a null path)."""
    path = F.col(rel_path) if isinstance(rel_path, str) else rel_path
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF_EXTENSION.items() for x in pair])
    return table[F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))]


def key_text(c: Column | str) -> Column:
    """A key as it is compared in this data: without case and outer blanks."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def is_routine(kind: Column | str = "kind") -> Column:
    return key_text(kind).isin("function", "method")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@cache
def encoder(folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k.tiktoken"):
    """A tiktoken encoder of a public vocabulary, loaded once a worker."""
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # the vocabulary's own
    with open(f"{folder}/{name}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Rows of one key that are joined in one part.
HOT = 100_000


def hot_join(big: DataFrame, small: DataFrame, key: list[str], count: str, spread: str, hot: int | None = None) -> DataFrame:
    """Equi-join in which a key with more than ``hot`` rows of ``big`` (``small`` holds one row a key, with their number in
    ``count``) is cut into parts by a hash of ``spread``; ``small`` is repeated for those keys alone.

    The hot keys are broadcast: they are at most the rows of ``big`` divided by ``hot``.
    """
    most = HOT if hot is None else hot
    parts = small.where(F.col(count) > most).select(*key, F.ceil(F.col(count) / most).cast("int").alias("__parts"))
    left = big.join(F.broadcast(parts), key, "left").withColumn("__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), "__parts").cast("int"))).drop("__parts")
    right = small.join(F.broadcast(parts), key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [*key, "__part"]).drop("__part")


def map_rows(df: DataFrame, rows: Callable[[], Callable[..., list[tuple]]], schema: str) -> DataFrame:
    """Arrow-batched flat map. ``rows()`` runs once a task and gives a function of a row's values that gives
    output rows; batches are written out every few thousand rows or megabytes, so one large text never gathers
    many others with it."""
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)
    names = target.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        f = rows()
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow)], schema=arrow)

        for b in batches:
            for values in zip(*(c.to_pylist() for c in b.columns)):
                out.extend(f(*values))
                if len(out) >= 20000:
                    yield batch()
                    out.clear()
            if out:
                yield batch()
                out.clear()

    return df.mapInArrow(run, target)
