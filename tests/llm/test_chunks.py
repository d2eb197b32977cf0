import math
import random
import re
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from srclake.llm import docpairs, neardup, splitting
from srclake.llm import queries as q
from tests.compare import same
from tests.conftest import SMALL, rows

CODE = "def load(path):\n    with open(path) as f:\n        return f.read()\n\n\n"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\r\té}", max_size=400), st.integers(1, 60), st.integers(-2, 70))
def test_split_covers(text, limit, overlap):
    got = splitting.split(text, limit, overlap)
    if len(text) <= limit:
        assert got == []
        return
    o = min(max(overlap, 0), limit - 1)
    assert got[0][1] == 0 and got[-1][2] == len(text)
    for no, a, b, first, last, piece in got:
        assert 0 < len(piece) <= limit and piece == text[a:b] and first == text.count("\n", 0, a) + 1 and last == first + piece[:-1].count("\n")
    for x, y in zip(got, got[1:]):
        assert y[0] == x[0] + 1 and x[2] - y[1] == min(o, x[2]) and y[2] > x[2]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc ", "\r\n", "\r\n\r\n", "def f():\r\n", "x" * 30]), max_size=60).map("".join), st.integers(2, 40), st.integers(0, 30))
def test_split_keeps_line_ends(text, limit, overlap):
    if overlap < limit - 1:
        assert not any(text[b - 1] == "\r" and text[b] == "\n" for b in splitting.cuts(text, limit, overlap))


def test_split_is_linear():
    import time

    began = time.perf_counter()
    for text, limit, overlap in [("ab c" * 50_000, 4000, 3990), ("word\n" * 200_000, 6000, 300), ("x" * 2_000_000, 3000, 100)]:
        edges = [0, *splitting.cuts(text, limit, overlap), len(text)]
        assert edges[1] <= limit and all(0 < b - a <= limit - overlap for a, b in zip(edges[1:], edges[2:]))
    assert time.perf_counter() - began < 15


def test_split_looks_further_for_a_line():
    """No line end near the target: the only one that a piece can reach is taken."""
    text = "a" * 1000 + "\n" + "b" * 5000
    assert splitting.cuts(text, 3100, 0)[0] == 1001


def test_split_boundaries():
    text = CODE * 40
    got = splitting.split(text, 600, 50)
    assert all(text[p[2] :].startswith("def load") for p in got[:-1])
    assert len(got) <= math.ceil((len(text) - 50) / 550) + 2
    assert splitting.split("a" * 10, None, 3) == [] and len(splitting.split("x" * 3_000_000, 6000, 300)) == math.ceil((3_000_000 - 300) / 5700)


def test_pieces(spark):
    files = spark.createDataFrame([(1, CODE * 90, "z"), (2, None, "z"), (3, "", "z"), (4, "é" * 6000, "z"), (5, "é" * 6001, "z"), (5, "é" * 6001, "z")], "file_id bigint, content string, piece string")
    chunks = spark.createDataFrame([(1, CODE * 30, None), (2, CODE * 30, 11), (3, None, 2)], "chunk_seq bigint, code string, start_line int")
    limits = spark.createDataFrame([("source_files", 6000, 300), ("source_files", 9000, 1), ("chunks", 800, None), ("other", 1, 1)], "origin string, max_chars int, overlap_chars int")
    got = splitting.pieces_all(files, chunks, limits)
    assert rows(got.where("piece_no = 1").select("origin", "row_id")) == [("chunks", 1), ("chunks", 2), ("source_files", 1), ("source_files", 5), ("source_files", 5)]
    assert got.where("length(piece) > 6000 OR origin = 'chunks' AND length(piece) > 800").count() == 0
    starts = {r["row_id"]: r["s"] for r in got.where("origin = 'chunks'").groupBy("row_id").agg(F.min("start_line").alias("s")).collect()}
    assert starts == {1: 1, 2: 11}
    assert splitting.pieces_all(files, chunks, limits.limit(0)).count() == 0 and splitting.pieces_all(files.limit(0), chunks.limit(0), limits).count() == 0


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_as_sql(spark, name):
    same(spark, SMALL, q.QUERIES[name], q.ORACLES[name])


TELLS = [("Looks a user up by name.", "find_user"), ("TODO: tidy up. Seconds to wait before giving up.", "f"), ("True when the mast is vacant.", "is_vacant"), (":param a: the number of rows to keep", "f"), ("@return the sum of all prices", "f"), ("Prüft, ob der Wert passt, und verwirft ältere Einträge.", "f"), ("Return the first match of the list.", "f"), ("FIXME later. Not safe for two threads at once.", "f")]
EMPTY = [("", "f"), ("  \n", "f"), ("TODO", "f"), ("FIXME: add docs", "f"), ("Find user.", "find_user"), ("The find user function.", "findUser"), ("find_user(name, age)", "find_user"), (":param a:\n:return:", "f"), ("@param a\n@return", "f"), ("-----", "f"), ("Copyright (c) 2021 the X team. All rights reserved.", "f"), ("eslint-disable-next-line max-len", "f"), ("x = load(y)\nreturn x", "f"), ("{@inheritDoc}", "f"), ("@since 7.6", "f"), ("n/a", "f"), ("Description of find_user.", "find_user"), ("Auto-generated method stub.", "f"), ("{{ summary }}", "f"), ("See above.", "f"), ("clippy: allow", "f"), (None, None)]


@pytest.mark.parametrize("doc, name", TELLS)
def test_tells(doc, name):
    assert docpairs.description(doc, name)


@pytest.mark.parametrize("doc, name", EMPTY)
def test_tells_nothing(doc, name):
    assert docpairs.description(doc, name) == ""


@pytest.mark.parametrize("code, want", [
    ("def f(x: dict[str, int] = {}) -> None:\n    # no\n    '''Says it.'''\n    pass", "Says it."), ("# Says it.\n@deco\ndef f(): pass", "Says it."), ("/**\n * Says it.\n */\n@Override\npublic int f() {", "Says it."),
    ("/// Says it.\n#[inline]\nfn f() {}", "Says it."), ("// Old.\n\n// Says it.\nfunc f() {", "Says it."), ("func f() {\n  // inside\n}", ""), ("// Far away.\n\nfunc f() {}", ""), (None, ""),
])
def test_documentation(code, want):
    assert docpairs.documentation(code)[0].strip() == want


@pytest.mark.parametrize("code, want", [("class A(B, m.C, metaclass=M):\n x", ["B", "C"]), ("public class A<T> extends B<T> implements C, D {", ["B", "C", "D"]), ("class A : public n::B, private C {", ["B", "C"]), ("class A:\n  pass", []), ("class A(object):", []), (None, []),
    ("class A(Generic[T, U[V]], Base):", ["Generic", "Base"]), ("class A<T extends Map<K, List<V>>> extends B<T> {", ["B"]), ("type A struct {\n\tBase\n\t*pkg.Other // x\n\tName string\n}", ["Base", "Other"]), ("impl<T: Clone> fmt::Display for A<T> {", ["Display"]), ("trait A: B + C {", ["B", "C"])])
def test_bases(code, want):
    assert docpairs.bases(code) == want


def test_inheritance(spark):
    run, empty = "def run(self):\n    '''Runs all jobs until none is left.'''", "def run(self): pass"
    values = [
        (1, "r", "a.py", "class", "Top", "class Top:", None), (2, "r", "a.py", "Class ", "Mid", "class Mid(Top):", None), (3, "r", "b.py", "class", "Low", "class Low(Gone, Mid):", None),
        (4, "r", "a.py", "method", "Top.run", run, None), (5, "r", "a.py", "method", "Mid.run", empty, None), (6, "r", "b.py", "METHOD", "Low.run", empty, "{@inheritDoc}"), (7, "q", "b.py", "method", "Low.run", empty, None),
        (8, "r", "c.py", "class", "A", "class A(B):", None), (9, "r", "c.py", "class", "B", "class B(A):", None), (10, "r", "c.py", "method", "A.x", empty, None), (11, None, None, "function", None, None, None), (12, "r", "c.py", None, "z", run, None),
        (13, "r", "d.py", "class", "Top", "class Top:", None), (14, "r", "d.py", "method", "Top.run", empty, ""), (4, "r", "a.py", "method", "Top.run", run, None),
    ]
    df = spark.createDataFrame([(*v, "x", "y") for v in values], "chunk_seq bigint, repo_id string, file_path string, kind string, name string, code string, docstring string, description string, owner string")
    assert rows(docpairs.documented(df).select("chunk_seq", "doc_source")) == [(4, "code"), (4, "code"), (5, "inherited"), (6, "inherited")]
    assert docpairs.documented(df.limit(0)).count() == 0
    assert docpairs.pairs(df).count() == 4
    assert docpairs.pairs(df).where("chunk_seq = 6").first()["description"].startswith("Runs all jobs")


def test_inheritance_from_the_own_file(spark):
    """Equal class names in a repository stay apart; a base is first that of the same file."""
    doc = "def run(self):\n    '''%s until none is left.'''"
    empty = "def run(self): pass"
    values = [
        (1, "a.py", "class", "Base", "class Base:"), (2, "a.py", "method", "Base.run", doc % "Sends letters"), (3, "b.py", "class", "Base", "class Base:"), (4, "b.py", "method", "Base.run", doc % "Starts engines"),
        (5, "b.py", "class", "C", "class C(Base):"), (6, "b.py", "method", "C.run", empty), (7, "c.py", "class", "Root", "class Root:"), (8, "c.py", "method", "Root.run", doc % "Opens gates"),
        (9, "c.py", "class", "Base", "class Base(Root):"), (10, "c.py", "class", "D", "class D(Base):"), (11, "c.py", "method", "D.run", empty), (12, "d.py", "class", "E", "class E(Base):"), (13, "d.py", "method", "E.run", empty),
        (14, "e.py", "method", "C.run", empty), (15, "f.py", "class", "Base", "class Base(m.Base):"), (16, "f.py", "method", "Base.run", empty),
    ]
    df = spark.createDataFrame([(k, "r", p, kind, name, code, None) for k, p, kind, name, code in values], "chunk_seq bigint, repo_id string, file_path string, kind string, name string, code string, docstring string")
    got = {r["chunk_seq"]: r["description"].split()[0] for r in docpairs.documented(df).where("doc_source = 'inherited'").collect()}
    assert got == {6: "Starts", 11: "Opens", 13: "Sends", 14: "Starts", 16: "Sends"}


def brute(texts, threshold, width, least):
    sets = {}
    for k, x in texts:
        w = re.findall(r"[A-Za-z0-9_]+", x or "")
        if len(w) >= max(least, width):
            sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return sorted((a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) * 1000 >= round(threshold * 1000) * len(sets[a] | sets[b]))


def near_texts():
    rnd = random.Random(5)
    base = [[rnd.choice("abcdefghij") + str(rnd.randint(0, 40)) for _ in range(rnd.randint(30, 160))] for _ in range(25)]
    out = []
    for words in base:
        for _ in range(rnd.randint(1, 5)):
            w = list(words)
            for _ in range(rnd.randint(0, len(w) // 12)):
                w[rnd.randrange(len(w))] = "edit" + str(rnd.randint(0, 5))
            out.append(" ".join(w))
    return [*out, "same " * 60, "same " * 61, out[0], out[0], None, "", "too few words"]


@pytest.mark.parametrize("threshold, width, least, lists, heavy", [(0.7, 3, 40, 2000, None), (0.7, 3, 40, 2, None), (0.8, 5, 20, 2000, 1), (0.6, 2, 10, 3, 60), (0.9, 3, 10, 2000, 1 << 30), (1.0, 3, 10, 2000, None)])
def test_near_duplicates(spark, monkeypatch, threshold, width, least, lists, heavy):
    monkeypatch.setattr(neardup, "LIST", lists)
    monkeypatch.setattr("srclake.llm.common.HOT", lists)
    if heavy:
        monkeypatch.setattr(neardup, "heavy_from", lambda costs: heavy)
    texts = list(enumerate(near_texts(), 1))
    df = spark.createDataFrame([(k, "Method " if k % 2 else "function", x, 1, 2) for k, x in texts] + [(900, "class", near_texts()[0], 1, 2), (901, None, near_texts()[0], 1, 2)], "chunk_seq bigint, kind string, code string, n int, cls int")
    membership, links = neardup.near_duplicates(df, threshold, width, least)
    got = rows(neardup.expand(membership, links))
    assert got == brute(texts, threshold, width, least) and got
    grouped = neardup.groups(membership, links)
    assert grouped.count() == membership.count() == grouped.select("chunk_seq").distinct().count()


def test_near_duplicates_empty(spark):
    df = spark.createDataFrame([], "chunk_seq bigint, kind string, code string")
    assert neardup.expand(*neardup.near_duplicates(df)).count() == 0
    with pytest.raises(ValueError, match="over 0.5"):
        neardup.near_duplicates(df, 0.5)


def test_both_sides_by_cost(spark, monkeypatch):
    """Small sets whose tokens are on long lists, large ones whose tokens are on short lists: the costs themselves part them."""
    seen, real = [], neardup.heavy_from
    monkeypatch.setattr(neardup, "heavy_from", lambda costs: seen.append((real(costs), [r["step"] for r in costs])) or seen[-1][0])
    rnd = random.Random(8)
    short = [" ".join(f"s{(k * 3 + j) % 40}" for j in range(11)) + f" u{k}" for k in range(200)]
    long = [" ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 9)) for _ in range(400)) for _ in range(20)]
    texts = list(enumerate([*short, *long, *[x.replace("a1", "b2", 2) for x in long]], 1))
    df = spark.createDataFrame([(k, "function", x) for k, x in texts], "chunk_seq bigint, kind string, code string")
    membership, links = neardup.near_duplicates(df, 0.7, 3, 8)
    assert rows(neardup.expand(membership, links)) == brute(texts, 0.7, 3, 8)
    boundary, steps = seen[0]
    assert 2 ** (min(steps) / 4) < boundary <= 2 ** (max(steps) / 4)


def test_boundary_by_cost():
    row = lambda step, light, heavy: {"step": step, "light": light, "heavy": heavy}
    assert neardup.heavy_from([row(8, 1, 5), row(12, 9, 2), row(16, 99, 1)]) == 8
    assert neardup.heavy_from([]) == 1 << 30 and neardup.heavy_from([row(8, 9, 1)]) == 4
