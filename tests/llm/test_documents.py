import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from srclake.llm import leakage, mixing, reading
from srclake.llm import queries as q
from tests.conftest import SMALL, rows

DOCS = "doc_id bigint, text string, source string, lang string, item_id bigint, words int, key string, level int"
ITEM = "Write down the viaduct that results if broad tariff values above 58 are reduced and then sealed. Name one more step."


def docs(spark, *values):
    return spark.createDataFrame([(i, x, s, None, 7, 7, "k", 9) for i, x, s in values], DOCS)


def items(spark, *texts):
    return spark.createDataFrame([(k, "s", x) for k, x in enumerate(texts, 1)], "item_id bigint, suite string, item_text string")


def brute(pairs_, texts, n=12):
    word = lambda x: re.findall(r"[^\W_]+", (x or "").lower())
    grams = lambda w: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    return sorted((d, i) for (d, x), (i, y) in product(pairs_, texts) if grams(word(x)) & grams(word(y)))


def test_leaks(spark):
    part = " ".join(ITEM.split()[3:15])
    texts = [
        ("a", None), ("b", ""), ("c", "x " + ITEM + " y"), ("d", ITEM.upper().replace(" ", " *_\n> ")), ("e", part), ("f", " ".join(ITEM.split()[3:14])), ("g", "İ" + part + "é"), ("h", (part + " zz ") * 3), ("i", "word " * 50_000 + ITEM),
        ("j", part.replace(" ", "")), ("k", ITEM),
    ]
    d = docs(spark, *[(k, x, None) for k, (_, x) in enumerate(texts)])
    it = items(spark, ITEM, "too short to leak", None, "Another thing. " + part)
    got = rows(leakage.leaks(d, it).select("doc_id", "item_id"))
    assert got == brute([(k, x) for k, (_, x) in enumerate(texts)], [(1, ITEM), (2, "too short"), (4, "Another thing. " + part)])
    found = {(r["doc_id"], r["item_id"]): r for r in leakage.leaks(d, it).collect()}
    assert found[2, 1]["share"] == 1 and found[7, 4]["words"] == 12 and len(found[7, 4]["spans"]) == 3
    for (k, _), r in found.items():
        for s in r["spans"]:
            assert re.findall(r"[^\W_]+", texts[k][1].lower()[s["start"] : s["end"]])[:1] or k == 6
    assert leakage.leaks(d.limit(0), it).count() == 0 and leakage.leaks(d, it.limit(0)).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    d, it = docs(spark, (1, ITEM, None), (2, ITEM[::-1], None)), items(spark, *[f"{k} {ITEM}" for k in range(6)])
    whole = rows(leakage.leaks(d, it).select("doc_id", "item_id"))
    monkeypatch.setattr(leakage, "BLOCK", 200)
    assert rows(leakage.leaks(d, it).select("doc_id", "item_id")) == whole and len(whole) == 6


def test_clean(spark):
    d = docs(spark, (1, "keep " * 60 + ITEM + " tail", None), (2, ITEM, None), (3, "nothing", None), (4, None, None))
    got = {r["doc_id"]: (r["text"], r["dropped"]) for r in leakage.clean(d, items(spark, ITEM)).collect()}
    assert got == {1: ("keep " * 60 + ". tail", False), 2: (None, True), 3: ("nothing", False), 4: (None, False)}


def test_fit_of_long_documents():
    """A sum of long documents that the greedy start misses."""
    assert mixing.fit([(40_000, 1), (36_000, 1), (34_000, 1)], 70_000, 1) == (0, {36_000: 1, 34_000: 1})
    assert mixing.fit([(30_011, 2), (26_003, 3), (25_007, 1)], 25_007 + 2 * 26_003, 2) == (0, {26_003: 2, 25_007: 1})


@pytest.mark.parametrize("histogram, budget, most, want", [
    ([(5, 2), (3, 1)], 26, 2, (2, {})), ([(5, 2), (3, 1)], 13, 1, (1, {})), ([(5, 2), (3, 1)], 8, 1, (0, 8)), ([(5, 2), (3, 1)], 18, 2, (1, 5)), ([], 5, 1, (0, 0)), ([(0, 9)], 5, 1, (0, 0)), ([(7, 3)], 6, 1, (0, 0)), ([(7, 3)], 0, 1, (0, 0)),
    ([(1000, 10**6), (7, 10), (3, 5)], 123_456_789, 1, (0, 123_456_000 + 700 - 7 * 90 + 15 if False else None)),
])
def test_fit(histogram, budget, most, want):
    passes, extra = mixing.fit(histogram, budget, most)
    counts = dict(histogram)
    assert all(k <= counts[s] for s, k in extra.items()) and passes <= most and (passes < most or not extra)
    total = sum(s * k for s, k in extra.items())
    if want[1] is not None:
        assert passes == want[0] and (total == want[1] if isinstance(want[1], int) else extra == want[1])
    assert passes * sum(s * n for s, n in histogram) + total <= budget


@pytest.mark.parametrize("histogram", [[(50 + k, 1) for k in range(1000)], [(20 + k * k % 977, 1 + k % 7) for k in range(300)]])
@pytest.mark.parametrize("share", [0.1, 1 / 3, 0.5, 0.9, 1.4])
def test_the_rest_is_a_sample(histogram, share):
    """The budget is met exactly, the mean length is the source's, and seeds differ."""
    merged: dict[int, int] = {}
    for size, n in histogram:
        merged[size] = merged.get(size, 0) + n
    total, n = sum(s * k for s, k in merged.items()), sum(merged.values())
    budget, chosen = int(total * share), []
    for seed in (1, 2):
        passes, extra = mixing.fit(list(merged.items()), budget, 3, seed)
        assert passes == int(share) and passes * total + sum(s * k for s, k in extra.items()) == budget
        assert all(k <= merged[s] for s, k in extra.items())
        assert sum(s * k for s, k in extra.items()) / sum(extra.values()) == pytest.approx(total / n, rel=0.05)
        chosen.append(extra)
    assert chosen[0] != chosen[1]


def test_reach_is_best():
    import itertools

    for lengths, counts, budget in [([5, 3], [2, 4], 11), ([7, 4, 9], [3, 2, 1], 26), ([6, 10], [5, 5], 31), ([8], [3], 7)]:
        got = mixing.reach(lengths, counts, budget)
        best = max(x for x in (sum(a * b for a, b in zip(lengths, k)) for k in itertools.product(*[range(c + 1) for c in counts])) if x <= budget)
        assert sum(s * k for s, k in got.items()) == best and all(got.get(s, 0) <= c for s, c in zip(lengths, counts))


def test_shares(spark):
    targets = spark.createDataFrame([("Issue", 0.5, 1), ("qa", 0.1, 2), ("none", 0.2, 3), ("null", None, None)], "source string, target_share double, max_repeats int")
    d = docs(spark, *[(k, "some words here " * 30, " ISSUE ") for k in range(20)], *[(100 + k, "some words here " * (k + 1), "Qa") for k in range(30)], (500, None, "qa"), (501, "x", None), (502, "x", "other"), (503, "", "qa"))
    got = {r["source"]: r for r in mixing.shares(mixing.token_lengths(d, targets), targets).collect()}
    assert set(got) == {"Issue", "qa", "none", "null"} and got["none"]["short"] and got["none"]["mix_tokens"] == 0 and not got["null"]["short"]
    assert got["qa"]["mix_tokens"] <= got["qa"]["budget_tokens"] and got["qa"]["budget_tokens"] - got["qa"]["mix_tokens"] <= 3
    assert sum(r["actual_share"] for r in got.values()) == pytest.approx(1)
    for group in (20_000, 3):
        mixing.GROUP = group
        chosen = mixing.mix(d, targets)
        per = {r["source"]: r["t"] for r in chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("t")).collect()}
        assert per == {s: r["mix_tokens"] for s, r in got.items() if r["mix_tokens"]}
        assert chosen.where("repeats > 2").count() == 0 and chosen.select("doc_id").distinct().count() == chosen.count()
    mixing.GROUP = 20_000
    assert mixing.mix(d.limit(0), targets).count() == 0 and mixing.shares(mixing.token_lengths(d.limit(0), targets), targets).where("mix_tokens > 0").count() == 0


EASY = "The cat is on the mat. We see the dog run. My box is red. "
HARD = "Epistemological ramifications notwithstanding, practitioners systematically problematize the asymptotic commutativity inherent in heterogeneous formulations. "


def test_levels(spark):
    d = docs(spark, (1, EASY * 5, "a"), (2, HARD * 5, "a"), (3, "tiny", "a"), (4, None, "a"), (5, "", None), (6, EASY * 5 + "\n```\n" + HARD * 30 + "\n```\n> " + HARD * 9, "B "), (7, "def f(x):\n    return x\n" * 9, "b"), (2, HARD * 5, "a"))
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 4), (2, 2, 3), (2, 3, 4), (99, 1, 2), (None, 1, 2), (1, 5, 7), (1, 6, None)], "doc_id bigint, rater_id int, level int")
    for given in (labels, None):
        got = rows(reading.levels(d, given).select("doc_id", "level"), "doc_id")
        assert [x for x in got if x[0] in (3, 4, 5, 7)] == [(3, None), (4, None), (5, None), (7, None)]
        by = dict(got)
        assert by[1] == by[6] < by[2] and len(got) == 8
    assert dict(rows(reading.levels(d, labels).select("doc_id", "level")))[2] == 4
    assert reading.levels(d.limit(0), labels).count() == 0 and reading.levels(d, labels.limit(0)).count() == 8
    assert reading.profile(d, labels).agg(F.sum("documents")).first()[0] == 8


def test_prose():
    text = "See the log of `x.y` and app/main.py, then call run(x) at https://a.example/b?c=d now.\n> quoted words\n  File \"a.py\", line 3\nValueError: no\n    indented code\n- an item"
    assert reading.prose_words(text) == ["see", "the", "log", "of", "and", "then", "call", "x", "at", "now", "an", "item"]


def test_held_out_accuracy(spark):
    """Of labels that the model has not seen, nearly all are met or missed by the one level that raters differ by."""
    folder = SMALL.replace("sf0.001", "sf0.01")
    d, labels = q.table(spark, folder, "documents"), q.table(spark, folder, "reading_labels")
    got = reading.levels(d, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1").groupBy("doc_id").agg(F.avg("level").alias("want")), "doc_id").where("level IS NOT NULL")
    total, near, equal = got.agg(F.count("*"), F.count_if(F.abs(F.col("level") - F.col("want")) <= 1), F.count_if(F.abs(F.col("level") - F.col("want")) <= 0.5)).first()
    assert total > 30 and near / total > 0.93 and equal / total > 0.8
