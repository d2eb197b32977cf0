"""Problem 9: reading level of each document, by smoothed unigram language models per level.

Running text is what is left of a document without fenced and indented code, traces, quoted lines, links, data lines
and inline code. Of a bounded sample of labelled documents, words are counted per level on the executors; the model is the
VOCABULARY most frequent words' smoothed log-probabilities per level. It is broadcast (at most VOCABULARY rows of five
numbers), and each document is scored in place: the level with the highest posterior.

Without labels, ``formula_labels`` seeds them from word and sentence length.

Bounds: SAMPLE labelled documents (the least by a hash of the id, so the same at every run) and VOCABULARY words are the
parameters of the classifier; every document is scored on its whole text.

Defined results: null text, and text with fewer than MIN_WORDS words of prose, has a NULL level; a document with several labels
counts under their rounded mean, ties to the easier level; labels outside 1..4 are ignored; words outside the model say
nothing; with no label at all, formula labels are used; repeated rows are each scored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srclake.llm.common import key_text, map_rows, stable

LEVELS = 4
#: Labelled documents that the model is trained on, at most.
SAMPLE = 6000
#: Words of the model, at most.
VOCABULARY = 50_000
MIN_WORDS = 20
#: Added to each count.
SMOOTHING = 0.1

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.S | re.M)
_LINE = re.compile(
    r"^(?:[ \t]*(?:>|\$ |%|File \"|at [\w.$<>]+\(|Traceback\b|Caused by|//|/?\*{1,2}[/ ]?$|\{|\[|<[a-z/!]|\d{4}-\d\d-\d\d|[|]|#!|goroutine |panic:|thread '|stack backtrace|\d+: 0x)|(?:    |\t)|[ \t]*[\w.]*(?:Error|Exception)\b).*$",
    re.M,
)
#: A word of running text: no part of a path, a call, a dotted name, an address or a quoted name.
_WORD = re.compile(r"(?<![\w./\\=`@])[^\W\d_]+(?![\w/\\={@`(]|\.\w|://)")


def prose_words(text: str) -> list[str]:
    """Lower-case words of the running text."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("", text)
    return _WORD.findall(_LINE.sub("", text).lower())


def formula_level(text: str) -> int | None:
    """A level from mean word and sentence length, for collections without labels."""
    words = prose_words(text)
    if len(words) < MIN_WORDS:
        return None
    sentences = max(1, len(re.findall(r"[.!?;:]+(?:\s|$)|\n\s*[-*+]", text)))
    grade = 4.7 * sum(map(len, words)) / len(words) + 0.5 * len(words) / sentences - 21.4
    return 1 if grade < 2 else 2 if grade < 9 else 3 if grade < 20 else 4


def _labelled(documents: DataFrame, labels: DataFrame | None, sample: int) -> DataFrame:
    """doc_id, level of at most ``sample`` documents."""
    order = F.xxhash64("doc_id")
    if labels is not None:
        one = labels.where(f"doc_id IS NOT NULL AND level BETWEEN 1 AND {LEVELS}").groupBy("doc_id").agg(F.ceil(F.avg("level") - 0.5).cast("int").alias("level"))
        picked = one.orderBy(order, "doc_id").limit(sample)
        if not picked.isEmpty():
            return picked
    ids = documents.select("doc_id", "text").where("text IS NOT NULL").orderBy(order, "doc_id").limit(sample)

    def seed():
        def one(doc_id, text):
            level = formula_level(text)
            return [(doc_id, level)] if level else []

        return one

    return map_rows(ids, seed, "doc_id bigint, level int")


def train(documents: DataFrame, labels: DataFrame | None, sample: int = SAMPLE, vocabulary: int = VOCABULARY):
    """(word -> row, log-probability of each row and level, log-prior of each level)."""
    import numpy as np

    # At most ``sample`` rows of two numbers, so they may be broadcast; the texts then need no shuffle.
    picked = stable(_labelled(documents, labels, sample)).dropDuplicates(["doc_id"])
    texts = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(picked), "doc_id")

    def count():
        from collections import Counter

        def one(doc_id, text, level):
            words = prose_words(text)
            return [("", level, 1), *((w, level, n) for w, n in Counter(words).items())] if len(words) >= MIN_WORDS else []

        return one

    counts = map_rows(texts, count, "word string, level int, n bigint").groupBy("word").agg(*[F.sum(F.when(F.col("level") == k, F.col("n")).otherwise(0)).alias(f"l{k}") for k in range(1, LEVELS + 1)])
    total = sum((F.col(f"l{k}") for k in range(2, LEVELS + 1)), F.col("l1"))
    kept = counts.orderBy(F.col("word") != "", total.desc(), "word").limit(vocabulary + 1).collect()
    docs = np.array([[r[f"l{k}"] for k in range(1, LEVELS + 1)] for r in kept if r["word"] == ""] or [[0] * LEVELS], dtype=float)[0]
    rows = [r for r in kept if r["word"] != ""]
    table = np.array([[r[f"l{k}"] for k in range(1, LEVELS + 1)] for r in rows] or np.zeros((0, LEVELS)), dtype=float).reshape(-1, LEVELS) + SMOOTHING
    log = np.log(table) - np.log(table.sum(axis=0, keepdims=True)) if len(table) else table
    prior = np.log((docs + 1) / (docs + 1).sum())
    return {r["word"]: k for k, r in enumerate(rows)}, log, prior


class _Rows(dict):
    """Word -> row of the model; the last row, of zeros, for a word that the model does not know."""

    def __missing__(self, word: str) -> int:
        return -1


def levels(documents: DataFrame, labels: DataFrame | None, sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> DataFrame:
    """doc_id, words (of prose), level (NULL for tiny texts), confidence (posterior of the level)."""
    return _score(documents.select("doc_id", "text", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang")), train(documents, labels, sample, vocabulary)).drop("source", "lang")


def _score(rows: DataFrame, trained) -> DataFrame:
    import numpy as np

    of, log, prior = trained
    model = rows.sparkSession.sparkContext.broadcast((of, np.vstack([log, np.zeros((1, LEVELS))]), prior))  # VOCABULARY rows at most

    def score():
        import numpy as np

        of, log, prior = model.value
        of = _Rows(of)

        def one(doc_id, text, source, lang):
            words = prose_words(text) if text else []
            if len(words) < MIN_WORDS:
                return [(doc_id, source, lang, len(words), None, None)]
            at = np.fromiter(map(of.__getitem__, words), dtype=np.int64, count=len(words))
            s = log[at].sum(axis=0) + prior
            best = int(s.argmax())
            return [(doc_id, source, lang, len(words), best + 1, float(1 / np.exp(s - s[best]).sum()))]

        return one

    return map_rows(rows, score, "doc_id bigint, source string, lang string, words int, level int, confidence double")


def profile(documents: DataFrame, labels: DataFrame | None) -> DataFrame:
    """source, lang, level, documents: how demanding the collection is (source and lang without case and outer blanks)."""
    rows = documents.select("doc_id", "text", key_text("source").alias("source"), key_text("lang").alias("lang"))
    return _score(rows, train(documents, labels)).groupBy("source", "lang", "level").agg(F.count("*").alias("documents"))
