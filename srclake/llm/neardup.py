"""Problem 6: code that is the same up to small edits, by exact Jaccard similarity of word shingles.

A size-aware heavy-light join (overlap join by fixed-size subsets for small sets, inverted lists for large ones),
carried over from overlap to Jaccard similarity by prefixes:

- Texts with the same shingle set are one class; all further work is on classes, so copies cost nothing.
- Tokens (64-bit shingle hashes) get one global order, rare ones first, from a counting sketch of fixed size over all
  tokens. Any order gives exact results; this one keeps boilerplate out of prefixes.
- If J(A, B) >= t then A and B share at least c tokens among the first n - ceil(t n) + c of each. Those prefixes are
  posted, and tokens that one class alone has posted are dropped at once.
- c is 2. Light classes enumerate the pairs of what is left of their prefix and meet on equal pairs. Heavy classes meet
  each other, and the light ones near enough in size, on inverted lists of single tokens, and two common ones make a
  candidate. The size that parts light from heavy is the one with the least cost by a histogram of both over all classes.
- Candidates are verified on the whole sets.

Lists longer than LIST are cut into blocks and joined block by block, classes of more members than LIST likewise. Where rows
first meet the number of their signature, token or subset, keys of very many rows are cut into parts (``common.hot_join``),
so no key goes to one task; nothing is capped. What reaches the driver is the sketch (SKETCH counters) and the cost
histogram (some hundred rows), whatever the input.

Defined results: null code and texts of fewer than ``least_words`` words take no part; identical texts are pairs of
similarity 1; a pair comes once, smaller chunk_seq first; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclake.llm.common import hot_join, is_routine, map_rows, stable

#: Counters of the sketch that orders tokens.
SKETCH = 1 << 16
#: Postings of one key that are joined in one go.
LIST = 2000

#: Cost of a posted subset against that of a pair from a list.
SUBSET = 3.0

_WORD = re.compile(r"[A-Za-z0-9_]+")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingler(width: int, least_words: int):
    """A function of a text that gives its distinct shingle hashes, ascending, as signed 64-bit numbers, or None."""
    import numpy as np

    hashes = _Hashes()
    factors = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) | 1 for k in range(1, width + 1)], dtype=np.uint64)

    def shingles(text: str | None):
        words = _WORD.findall(text or "")
        if len(words) < max(least_words, width):
            return None
        h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        size = len(words) - width + 1
        mixed = np.zeros(size, dtype=np.uint64)
        for k in range(width):
            mixed = (mixed ^ (h[k : k + size] * factors[k])) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed.view(np.int64))

    return shingles


def _blocks(count: Column) -> Column:
    return F.ceil(count / F.lit(LIST)).cast("int")


def signatures(chunks: DataFrame, width: int, least_words: int) -> tuple[DataFrame, object]:
    """(membership: chunk_seq, cls, members), (sketch: how often tokens of each of SKETCH buckets occur).

    cls is the least chunk_seq with the same shingle set. One pass gives both: a row for each text, and each task's counters.
    """
    import numpy as np

    def scan(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        shingles = shingler(width, least_words)
        total = np.zeros(SKETCH, dtype=np.int64)
        names = ["seq", "sig", "bucket", "cnt"]
        types = [pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        for b in batches:
            seqs, sigs = [], []
            for seq, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = shingles(code)
                if tokens is not None:
                    np.add.at(total, _bucket(tokens), 1)
                    seqs.append(seq)
                    sigs.append(xxhash.xxh3_128_digest(tokens.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(seqs, types[0]), pa.array(sigs, types[1]), pa.nulls(len(seqs), types[2]), pa.nulls(len(seqs), types[3])], names=names)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), types[0]), pa.nulls(len(at), types[1]), pa.array(at.astype(np.int32)), pa.array(total[at])], names=names)

    seen = stable(_texts(chunks).mapInArrow(scan, "seq bigint, sig binary, bucket int, cnt bigint"))
    ids = seen.where("seq IS NOT NULL").groupBy("sig").agg(F.min("seq").alias("cls"), F.count("*").alias("members"))
    membership = stable(hot_join(seen.where("seq IS NOT NULL").select("seq", "sig"), ids, ["sig"], "members", "seq").select(F.col("seq").alias("chunk_seq"), "cls", "members"))
    counted = seen.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("cnt").alias("cnt")).toPandas()
    sketch = np.zeros(SKETCH, dtype=np.int64)
    sketch[counted["bucket"].to_numpy(dtype=np.int64)] = counted["cnt"].to_numpy()
    return membership, sketch


def _texts(chunks: DataFrame) -> DataFrame:
    return chunks.where(is_routine() & F.col("code").isNotNull()).select("chunk_seq", "code")


def prefixes(texts: DataFrame, sketch, threshold: Fraction, width: int, least_words: int) -> DataFrame:
    """cls, n, tokens: of each text, set size and the prefix in which similar sets share two tokens."""
    shared = texts.sparkSession.sparkContext.broadcast(sketch)  # SKETCH counters, whatever the input
    num, den = threshold.numerator, threshold.denominator

    def first():
        import numpy as np

        shingles = shingler(width, least_words)
        counts = shared.value

        def one(seq, code):
            tokens = shingles(code)
            if tokens is None:
                return []
            size = len(tokens)
            need = -(-num * size // den)  # ceil(t n)
            order = np.lexsort((tokens, counts[_bucket(tokens)]))[: size - need + 2]
            return [(seq, size, tokens[order])]

        return one

    return map_rows(texts, first, "cls bigint, n int, tokens array<bigint>")


def _bucket(tokens):
    import numpy as np

    return ((tokens.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 16)).astype(np.int64)


def _join_on(postings: DataFrame, key: list[str], keep: Column) -> DataFrame:
    """Pairs (a, b) of classes that share a key; lists longer than LIST are joined block by block."""
    size = postings.groupBy(key).agg(F.count("*").alias("k")).where("k > 1").withColumn("blocks", _blocks(F.col("k")))
    listed = hot_join(postings, size, key, "k", "cls").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = listed.select(*key, F.col("cls").alias("a"), F.col("n").alias("na"), F.col("heavy").alias("ha"), F.col("block").alias("i"), every.alias("j"))
    right = listed.select(*key, F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("heavy").alias("hb"), every.alias("i"), F.col("block").alias("j"))
    return left.join(right, [*key, "i", "j"]).where((F.col("a") < F.col("b")) & keep).select("a", "b")


def similar_classes(chunks: DataFrame, membership: DataFrame, sketch, threshold: float, width: int, least_words: int) -> DataFrame:
    """a, b (class ids, a < b), jaccard of every two classes with at least the threshold."""
    t = Fraction(str(threshold))
    if not Fraction(1, 2) < t <= 1:
        raise ValueError("the threshold must be over 0.5 and at most 1: sets of two or more then share two tokens")
    num, den = t.numerator, t.denominator
    one_each = membership.where("chunk_seq = cls").select("cls")
    prefixed = stable(prefixes(_texts(chunks), sketch, t, width, least_words).join(one_each, "cls", "left_semi"))
    posted = prefixed.select("cls", "n", F.explode("tokens").alias("token"))
    # Tokens that only one class has posted meet nobody. Counting by token keeps the rest with the length of its list.
    often = posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    met = stable(hot_join(posted, often, ["token"], "df", "cls"))
    # Cost by size: subsets that a class as a light one posts (sorted and shuffled SUBSET times as wide as a pair), against
    # pairs that it takes part in on lists as a heavy one.
    step = F.floor(F.log2("n") * 4).cast("int")
    per_class = met.groupBy("cls", "n").agg(F.count("*").alias("s"), F.sum("df").alias("lists")).withColumn("step", step)
    costs = per_class.groupBy("step").agg(F.sum(SUBSET * F.col("s") * (F.col("s") - 1) / 2).alias("light"), F.sum(F.col("lists") / 2).alias("heavy")).orderBy("step").collect()
    boundary = heavy_from(costs)
    met = met.withColumn("heavy", F.col("n") >= boundary)
    na, nb = F.col("na").cast("bigint"), F.col("nb").cast("bigint")
    fits = (na * den >= nb * num) & (nb * den >= na * num)
    # Light with light: equal 2-subsets of what is left of the prefixes.
    both = F.collect_set("token")
    light = met.where(~F.col("heavy")).groupBy("cls", "n").agg(F.sort_array(both).alias("ts")).where("size(ts) > 1")
    firsts = light.select("cls", "n", "ts", F.posexplode("ts").alias("p", "t1"))
    subsets = firsts.select("cls", "n", F.lit(False).alias("heavy"), "t1", F.explode(F.slice("ts", F.col("p") + 2, F.size("ts"))).alias("t2"))
    subsets = subsets.where("t2 IS NOT NULL")
    found = _join_on(subsets, ["t1", "t2"], fits)
    # Heavy with heavy, and with light ones that are near enough in size: lists of single tokens, counting common ones.
    singles = met.where(F.col("n").cast("bigint") * den >= F.lit(int(boundary) * num)).select("cls", "n", "heavy", "token")
    scanned = _join_on(singles, ["token"], fits & (F.col("ha") | F.col("hb"))).groupBy("a", "b").agg(F.count("*").alias("common"))
    found = found.unionByName(scanned.where("common > 1").select("a", "b"))
    candidates = stable(found.distinct())
    needed = candidates.select(F.col("a").alias("cls")).unionByName(candidates.select(F.col("b").alias("cls"))).distinct()
    again = _texts(chunks).join(needed.withColumnRenamed("cls", "chunk_seq"), "chunk_seq", "left_semi")

    def sets():
        shingles = shingler(width, least_words)
        return lambda seq, code: [(seq, shingles(code))]

    whole = stable(map_rows(again, sets, "cls bigint, tokens array<bigint>"))
    left = whole.select(F.col("cls").alias("a"), F.col("tokens").alias("ta"))
    right = whole.select(F.col("cls").alias("b"), F.col("tokens").alias("tb"))
    sized = candidates.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("ta", "tb")))
    either = F.size("ta") + F.size("tb") - F.col("both")
    return sized.where(F.col("both").cast("bigint") * den >= either.cast("bigint") * num).select("a", "b", (F.col("both") / either).alias("jaccard"))


def heavy_from(costs: list) -> int:
    """The least set size that counts as heavy: where the sum of light costs below and heavy costs above is least."""
    steps = [(r["step"], float(r["light"] or 0), float(r["heavy"] or 0)) for r in costs]
    best, at = float("inf"), 1 << 30
    for k in range(len(steps) + 1):
        cost = sum(x[1] for x in steps[:k]) + sum(x[2] for x in steps[k:])
        if cost < best:
            best, at = cost, (int(2 ** (steps[k][0] / 4)) if k < len(steps) else 1 << 30)
    return at


def near_duplicates(chunks: DataFrame, threshold: float = 0.8, width: int = 5, least_words: int = 40) -> tuple[DataFrame, DataFrame]:
    """(membership: chunk_seq, cls, members), (links between classes: a, b, jaccard)."""
    membership, sketch = signatures(chunks, width, least_words)
    return membership, similar_classes(chunks, membership, sketch, threshold, width, least_words)


def expand(membership: DataFrame, links: DataFrame) -> DataFrame:
    """chunk_seq_a, chunk_seq_b of every pair: within classes and across linked ones, in blocks of at most LIST members."""
    blocks = membership.withColumn("blocks", _blocks(F.col("members"))).withColumn("block", F.pmod(F.xxhash64("chunk_seq"), F.col("blocks")).cast("int"))
    many = blocks.where("members > 1")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = many.select("cls", F.col("chunk_seq").alias("x"), F.col("block").alias("i"), every.alias("j"))
    right = many.select("cls", F.col("chunk_seq").alias("y"), every.alias("i"), F.col("block").alias("j"))
    inside = left.join(right, ["cls", "i", "j"]).where("x < y").select("x", "y")
    sizes = membership.where("chunk_seq = cls").select("cls", _blocks(F.col("members")).alias("blocks"))
    a, b = (sizes.select(F.col("cls").alias(c), F.col("blocks").alias(f"k{c}")) for c in "ab")
    spread = links.select("a", "b").join(a, "a").join(b, "b")
    spread = spread.select("a", "b", "kb", F.explode(F.sequence(F.lit(0), F.col("ka") - 1)).alias("i")).select("a", "b", "i", F.explode(F.sequence(F.lit(0), F.col("kb") - 1)).alias("j"))
    xs = blocks.select(F.col("cls").alias("a"), F.col("block").alias("i"), F.col("chunk_seq").alias("x"))
    ys = blocks.select(F.col("cls").alias("b"), F.col("block").alias("j"), F.col("chunk_seq").alias("y"))
    across = spread.join(xs, ["a", "i"]).join(ys, ["b", "j"]).select("x", "y")
    return inside.unionByName(across).select(F.least("x", "y").alias("chunk_seq_a"), F.greatest("x", "y").alias("chunk_seq_b"))


def groups(membership: DataFrame, links: DataFrame) -> DataFrame:
    """chunk_seq, class_id, class_size, links: one row per text, with its class and the number of other classes linked to it."""
    ends = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls")))
    count = ends.groupBy("cls").agg(F.count("*").alias("links"))
    return membership.join(count, "cls", "left").select("chunk_seq", F.col("cls").alias("class_id"), F.col("members").alias("class_size"), F.coalesce("links", F.lit(0)).alias("links"))
