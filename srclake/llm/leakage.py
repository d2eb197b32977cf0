"""Problem 7: passages of evaluation items inside training documents.

A hash set of the items' normalised word n-grams is broadcast; each document's windows of as many words are looked up in it
and every hit is verified word by word, then joined to maximal runs. Words are runs of letters or digits; case,
punctuation, symbols and white space do not matter. Documents are read once, in place, without any shuffle.

The set's size is checked: items are taken in blocks of at most BLOCK characters, and more than one block means one
more pass over the documents each, so the broadcast is bounded however many items there are.

Defined results: null or short texts and items of fewer than n words match nothing; an item that occurs twice in a document
gives one row with all its spans; repeated documents each get their rows; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srclake.llm.common import map_rows, stable

#: Characters of item text whose n-grams are broadcast at once.
BLOCK = 16_000_000

_WORD = re.compile(r"[^\W_]+")


class _Known(dict):
    def __missing__(self, word: str) -> int:
        return -1


class Index:
    """The items' words as numbers, and their n-grams by hash."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        import numpy as np

        self.n, self.known = n, _Known()
        self.items: list[tuple[int, list[int]]] = []
        hashes, owners, places = [], [], []
        for item_id, text in items:
            words = [self.known.setdefault(w, len(self.known)) for w in _WORD.findall((text or "").lower())]
            if len(words) >= n:
                h = self.hashes(np.array(words, dtype=np.int64))
                hashes.append(h)
                owners.append(np.full(len(h), len(self.items), dtype=np.int32))
                places.append(np.arange(len(h), dtype=np.int32))
                self.items.append((item_id, words))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(flat, kind="stable")
        self.sorted = flat[order]
        self.owner, self.place = (np.concatenate(x)[order] if x else np.zeros(0, dtype=np.int32) for x in (owners, places))

    def hashes(self, ids):
        import numpy as np

        total = np.zeros(max(0, len(ids) - self.n + 1), dtype=np.uint64)
        for k in range(self.n):
            total = (total ^ ids[k : k + len(total)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        return total

    def runs(self, text: str) -> dict[int, list[tuple[int, int, int]]]:
        """item -> maximal matching runs (first word in the text, first word in the item, words), verified."""
        import numpy as np

        words = _WORD.findall(text.lower())
        if len(words) < self.n or not len(self.sorted):
            return {}
        ids = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        windows = np.flatnonzero(known[self.n :] - known[: -self.n] == self.n)
        if not len(windows):
            return {}
        spans = self.hashes(ids)[windows]
        left = np.searchsorted(self.sorted, spans)
        right = np.searchsorted(self.sorted, spans, side="right")
        found: dict[tuple[int, int], list[int]] = {}
        for at, lo, hi in zip(windows.tolist(), left.tolist(), right.tolist()):
            for k in range(lo, hi):
                item, place = int(self.owner[k]), int(self.place[k])
                if self.items[item][1][place : place + self.n] == ids[at : at + self.n].tolist():
                    found.setdefault((item, at - place), []).append(at)
        out: dict[int, list[tuple[int, int, int]]] = {}
        for (item, shift), starts in found.items():
            begin = last = starts[0]
            for at in [*starts[1:], None]:
                if at is None or at != last + 1:
                    out.setdefault(item, []).append((begin, begin - shift, last - begin + self.n))
                    begin = at
                last = at
        return out


def _parts(items: DataFrame) -> int:
    """Blocks of about BLOCK characters that the items are taken in."""
    size = items.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()[0]
    return max(1, -(-int(size) // BLOCK))


def _index(items: DataFrame, block: int, parts: int, n: int) -> Index:
    texts = items.select("item_id", "item_text").where("item_id IS NOT NULL AND item_text IS NOT NULL")
    return Index([(r[0], r[1]) for r in texts.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == block).orderBy("item_id", "item_text").collect()], n)


def leaks(documents: DataFrame, items: DataFrame, n: int = 12) -> DataFrame:
    """doc_id, item_id, words (matching, of the item), item_words, share, spans (start, end offsets in the text)."""
    rows = documents.select("doc_id", "text").where("text IS NOT NULL")
    out: DataFrame | None = None
    parts = _parts(items)
    for block in range(parts):
        shared = documents.sparkSession.sparkContext.broadcast(_index(items, block, parts, n))

        def scan(shared=shared):
            index = shared.value

            def one(doc_id, text):
                found = index.runs(text)
                if not found:
                    return []
                ends = _offsets(text)
                by_id: dict[int, tuple[int, set, list]] = {}
                for item, runs in found.items():
                    item_id, words = index.items[item]
                    _, hit, spans = by_id.setdefault(item_id, (len(words), set(), []))
                    for a, b, length in runs:
                        hit.update(range(b, b + length))
                        spans.append({"start": ends[a][0], "end": ends[a + length - 1][1]})
                return [(doc_id, i, len(hit), size, len(hit) / size, spans) for i, (size, hit, spans) in by_id.items()]

            return one

        part = map_rows(rows, scan, "doc_id bigint, item_id bigint, words int, item_words int, share double, spans array<struct<start:int,end:int>>")
        if parts > 1:  # one block at a time, on the driver as on the executors
            part = stable(part)
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _offsets(text: str) -> list[tuple[int, int]]:
    """Offsets of the words; lower-casing may lengthen a text, so they are found in the text itself."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in _WORD.finditer(low)]
    back, spans = [k for k, c in enumerate(text) for _ in c.lower()], []
    for m in _WORD.finditer(low):
        spans.append((back[m.start()], back[m.end() - 1] + 1))
    return spans


def clean(documents: DataFrame, items: DataFrame, n: int = 12, drop_share: float = 0.5) -> DataFrame:
    """doc_id, text, removed_spans, dropped: every document, without the leaked spans; a document of whose characters
    drop_share or more are leaked is dropped whole (text NULL)."""
    spans = (
        leaks(documents, items, n).select("doc_id", F.explode("spans").alias("s")).groupBy("doc_id").agg(F.sort_array(F.collect_set("s")).alias("spans"))
    )
    joined = documents.select("doc_id", "text").join(spans, "doc_id", "left")

    def cut():
        def one(doc_id, text, spans):
            if not spans or not text:
                return [(doc_id, text, 0, False)]
            kept, at, gone = [], 0, 0
            for s in sorted((s["start"], s["end"]) for s in spans):
                if s[1] <= at:
                    continue
                kept.append(text[at : max(at, s[0])])
                gone += s[1] - max(at, s[0])
                at = s[1]
            if gone >= drop_share * len(text):
                return [(doc_id, None, len(spans), True)]
            return [(doc_id, "".join(kept) + text[at:], len(spans), False)]

        return one

    return map_rows(joined, cut, "doc_id bigint, text string, removed_spans int, dropped boolean")
