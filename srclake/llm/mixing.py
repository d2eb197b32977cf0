"""Problem 8: mixing sources to target shares of all tokens, repeating documents at most a given number of times.

The size of the mix is the number of tokens of all documents whose source has a target. A source takes as many whole
passes over its documents as fit its budget; what remains is a subset sum over the documents' token lengths:

1. documents are counted by source and exact token length (combined before the shuffle);
2. each source's histogram is fitted on its own. Most of the remainder is a sample: of every length its share of the
   documents, fractions settled by seeded draws, one in each stratum of the lengths in order, so that short and long documents
   stay as they are mixed in the source. What is still open is met exactly by a bounded-knapsack table over the documents that are left;
   while the table misses, more is left open to it, up to the whole remainder (as far as TABLE sums and CELLS steps allow, in
   units of the lengths' gcd);
3. of each (source, length) the wanted number of documents is taken in the order of a seeded hash. Groups of more than
   GROUP documents are first counted by hash bucket, so that only the bucket of the cut is ranked.

A histogram has at most as many rows as there are different lengths, whatever the number of documents.

Defined results: sources are compared without case and outer blanks and spelled as in the targets; null or empty text has 0 tokens
and is never chosen; documents of other or null sources take no part; a source without documents, or whose documents used
max_repeats times fall short of its budget, is short and takes all it has; a null share is 0, a null max_repeats 1.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srclake.llm.common import TOKENIZER_DIR, encoder, key_text, map_rows, stable

#: Mean lengths that are left open to the table at first, and draws that are tried before more is left open.
OPEN, DRAWS = 2, 8
#: Sums and steps (sums times lengths) up to which a table over a whole budget is run.
TABLE, CELLS = 1 << 21, 1 << 28
#: Documents of one source and length that are ranked together.
GROUP = 20_000


def token_lengths(documents: DataFrame, targets: DataFrame, folder: str = TOKENIZER_DIR, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, key (source as compared), tokens: the documents of the targets' sources."""
    # One row a source: far under the size that may be broadcast, and checked by AQE's own threshold otherwise.
    keys = targets.select(key_text("source").alias("key")).where("key IS NOT NULL").distinct()
    rows = documents.select("doc_id", key_text("source").alias("key"), F.coalesce("text", F.lit("")).alias("text")).join(keys, "key", "left_semi")

    def count():
        encode = encoder(folder, vocabulary).encode_ordinary

        def one(key, doc_id, text):
            return [(doc_id, key, len(encode(text)))]

        return one

    return map_rows(rows.select("key", "doc_id", "text"), count, "doc_id bigint, key string, tokens int")


def reach(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """Bounded knapsack: how many of each length, so that their sum is the greatest one not over the budget."""
    import numpy as np

    if budget <= 0 or not lengths:
        return {}
    first = np.full(budget + 1, -1, dtype=np.int32)  # the item by which a sum was first reached
    reached = np.zeros(budget + 1, dtype=bool)
    reached[0] = True
    items: list[tuple[int, int]] = []  # (length, how many): counts are cut into powers of two, so that any count is a sum of items
    for size, most in zip(lengths, counts):
        most, many = min(most, budget // size), 1
        while most > 0 and not reached[budget]:
            many = min(many, most)
            most -= many
            shift = size * many
            new = reached[: budget + 1 - shift] & ~reached[shift:]
            first[shift:][new] = len(items)
            reached[shift:] |= new
            items.append((size, many))
            many *= 2
    at = int(np.flatnonzero(reached)[-1])
    chosen: dict[int, int] = {}
    while at:
        size, many = items[int(first[at])]
        chosen[size] = chosen.get(size, 0) + many
        at -= size * many
    return chosen


def fit(histogram: list[tuple[int, int]], budget: int, max_repeats: int, seed: int = 17) -> tuple[int, dict[int, int]]:
    """(whole passes, documents of each length to take once more) for a budget of tokens."""
    import numpy as np

    histogram = sorted((size, n) for size, n in histogram if size > 0 and n > 0)
    total = sum(size * n for size, n in histogram)
    if not total or budget <= 0:
        return 0, {}
    if max_repeats * total <= budget:
        return max_repeats, {}
    passes = budget // total
    rest = budget - passes * total
    if not rest:
        return passes, {}
    rng = np.random.default_rng([seed, rest, total])
    unit = gcd(*(size for size, _ in histogram))
    sizes = np.array([size for size, _ in histogram], dtype=np.int64)
    counts = np.array([n for _, n in histogram], dtype=np.int64)
    left_open = OPEN * -(-total // int(counts.sum()))
    best: dict[int, int] = {}
    nearest, tried = -1, 0
    while True:
        drawn = _draw(sizes, counts, max(0, rest - left_open) / total, rest, rng)
        gap = (rest - int((drawn * sizes).sum())) // unit
        # Lengths near the mean come first, so that what closes the gap is made of few and usual ones.
        order = np.argsort(np.abs(np.log(sizes * (counts.sum() / total))) + 0.5 * rng.random(len(sizes)))
        fits = [k for k in order.tolist() if drawn[k] < counts[k] and sizes[k] <= gap * unit]
        if nearest >= 0 and (gap > TABLE or gap * len(fits) > CELLS):
            break
        filled = reach([int(sizes[k]) // unit for k in fits], [int(counts[k] - drawn[k]) for k in fits], gap)
        met = rest - gap * unit + sum(size * unit * k for size, k in filled.items())
        if met > nearest:
            best = {int(s): int(k) for s, k in zip(sizes, drawn) if k}
            for size, k in filled.items():
                best[size * unit] = best.get(size * unit, 0) + k
            nearest = sum(size * k for size, k in best.items())
        tried += 1
        if nearest > rest - unit or left_open >= rest and tried >= DRAWS:
            break
        if tried % DRAWS == 0:
            left_open *= 4
    return passes, best


def _draw(sizes, counts, share: float, most: int, rng):
    """Of each length about ``share`` of the documents, at most ``most`` tokens in all; lengths are in order."""
    import numpy as np

    wanted = counts * share
    taken = np.floor(wanted).astype(np.int64)
    cumulated = np.cumsum(wanted - taken)
    strata = int(np.ceil(cumulated[-1]))
    points = np.arange(strata) + rng.random(strata)
    points = points[points < cumulated[-1]]  # the last stratum, of the longest, counts by how much of it there is
    if len(points):
        hits = np.minimum(np.searchsorted(cumulated, points, side="right"), len(sizes) - 1)
        taken = np.minimum(taken + np.bincount(hits, minlength=len(sizes)), counts)
    over = int((taken * sizes).sum()) - most
    for k in rng.permutation(len(sizes)).tolist() if over > 0 else []:
        less = min(int(taken[k]), -(-over // int(sizes[k])))
        taken[k] -= less
        over -= less * int(sizes[k])
        if over <= 0:
            break
    return taken


def plan(lengths: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """key, source, target_share, max_repeats, size, n, passes, extra, budget, available: one row for each source and length."""
    histogram = stable(lengths.groupBy("key", F.col("tokens").alias("size")).agg(F.count("*").alias("n")))
    total = histogram.agg(F.coalesce(F.sum(F.col("size").cast("bigint") * F.col("n")), F.lit(0))).first()[0]
    wanted = targets.select("source", key_text("source").alias("key"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).where("key IS NOT NULL")
    wanted = wanted.withColumn("total", F.lit(total).cast("bigint")).withColumn("budget", F.col("target_share") * F.lit(float(total)))
    rows = wanted.join(histogram, "key", "left")

    def choose(frame):
        import pandas as pd

        first = frame.iloc[0]
        have = frame.dropna(subset=["n"])
        sizes, counts = have["size"].astype("int64").tolist(), have["n"].astype("int64").tolist()
        passes, extra = fit(list(zip(sizes, counts)), int(round(first["budget"])), int(first["max_repeats"]), seed)
        available = sum(s * n for s, n in zip(sizes, counts))
        if not sizes:
            sizes, counts = [0], [0]
        return pd.DataFrame(
            {"key": first["key"], "source": first["source"], "target_share": first["target_share"], "max_repeats": int(first["max_repeats"]), "total": int(first["total"]), "budget": first["budget"],
             "available": available, "size": sizes, "n": counts, "passes": passes, "extra": [extra.get(s, 0) for s in sizes]}
        )

    schema = "key string, source string, target_share double, max_repeats int, total bigint, budget double, available bigint, size int, n bigint, passes int, extra bigint"
    return rows.groupBy("source").applyInPandas(choose, schema)


def shares(lengths: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """source, target_share, max_repeats, available_tokens, budget_tokens, mix_tokens, actual_share (of the whole mix), short."""
    size = F.col("size").cast("bigint")
    got = F.sum(size * (F.col("n") * F.col("passes") + F.col("extra")))
    by = plan(lengths, targets, seed).groupBy("source", "target_share", "max_repeats", "available", "budget").agg(got.alias("mix_tokens"), F.min("passes").alias("passes"))
    whole = Window.partitionBy()  # a row a source
    mixed = F.sum("mix_tokens").over(whole)
    return by.select(
        "source", "target_share", "max_repeats", F.col("available").alias("available_tokens"), F.round("budget").cast("bigint").alias("budget_tokens"), "mix_tokens",
        F.when(mixed > 0, F.col("mix_tokens") / mixed).otherwise(F.lit(0.0)).alias("actual_share"),
        # The plan has taken all, as often as it may, and does not reach the budget.
        ((F.col("mix_tokens") < F.col("budget")) & ((F.col("available") == 0) | (F.col("passes") >= F.col("max_repeats")))).alias("short"),
    )


def mix(documents: DataFrame, targets: DataFrame, seed: int = 17, folder: str = TOKENIZER_DIR) -> DataFrame:
    """doc_id, source, tokens, repeats of the chosen documents."""
    lengths = stable(token_lengths(documents, targets, folder))
    wanted = plan(lengths, targets, seed).where("passes > 0 OR extra > 0").select("key", "source", F.col("size").alias("tokens"), "n", "passes", "extra")
    wanted = stable(wanted.withColumn("parts", F.ceil(F.col("n") / GROUP).cast("int")))
    placed = lengths.where("tokens > 0").join(wanted, ["key", "tokens"]).withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    # Hash ranges in order: whole ranges before the cut are taken, the range of the cut is ranked.
    unit = F.col("h").cast("double") / F.lit(2.0**64) + 0.5
    placed = placed.withColumn("part", F.least(F.floor(unit * F.col("parts")).cast("int"), F.col("parts") - 1))
    group = ["key", "tokens"]
    counted = placed.where("parts > 1").groupBy(*group, "part").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranged = placed.join(counted.withColumn("before", before), [*group, "part"], "left").fillna({"before": 0})
    whole = (F.col("before") + F.coalesce("k", F.lit(0)) <= F.col("extra")) & (F.col("parts") > 1)
    none = F.col("before") >= F.col("extra")
    sure = ranged.where(whole | none).withColumn("once", F.when(whole & ~none, 1).otherwise(0))
    rank = F.row_number().over(Window.partitionBy(*group, "part").orderBy("h", "doc_id"))
    cut = ranged.where(~whole & ~none).withColumn("once", (F.col("before") + rank <= F.col("extra")).cast("int"))
    both = sure.unionByName(cut)
    return both.withColumn("repeats", F.col("passes") + F.col("once")).where("repeats > 0").select("doc_id", "source", "tokens", "repeats")
