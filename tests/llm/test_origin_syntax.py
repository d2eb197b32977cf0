import ast

import pytest
from pyspark.sql import functions as F

from srclake.llm import origin, syntax
from srclake.llm.automata import Reductions
from srclake.llm.grammars import GRAMMARS, derive, expand, pairs, parse
from srclake.llm.lexing import lex, unmatched
from tests.conftest import rows

FILES = "file_id bigint, repo_id string, rel_path string, language string, content string, label string, depth int, e0 double"
HAND = "def total(rows):\n    result = 0\n    for row in rows:\n        result += row.price\n    return result\n"
TABLE = "\n".join(f"OPCODE_{k:04d} = {k * 7}" for k in range(60)) + "\n"
BLOB = "DATA = [\n" + "\n".join(", ".join(str(k * 37 % 9973) for k in range(a, a + 20)) + "," for a in range(0, 900, 20)) + "\n]\n"
MINI = "".join(f"var a{k}=function(b){{return b.c&&b.d({k})||null}};" for k in range(40))


def table(spark, *files):
    return spark.createDataFrame([(k, *f, "x", 3, 0.5) for k, f in enumerate(files)], FILES)


def test_labels(spark):
    df = table(
        spark,
        ("r", "app/a.py", "python", HAND), ("r", "app/b.py", None, "# AUTO-GENERATED FILE - changes will be lost\n" + HAND), ("r", "lib/t.py", " Python", TABLE), ("r", "lib/d.py", "python", BLOB),
        ("r", "web/x.js", "javascript", MINI), ("r", "third_party/zip/z.py", "python", HAND), ("r", "app/c.py", "python", '# Handles vendored data\n' + HAND.replace("0", '"DO NOT EDIT. Code generated by x"')),
        ("r", "src/generated/q_pb2.py", "python", "x = 1\n"), ("r", "conf/a.ini", None, "a=1"), (None, "u.go", "go", None), ("r", None, None, HAND), ("r", "app/e.py", "python", ""),
        ("r", "services/vendor/list.py", "python", HAND), ("r", "app/a.py", "python", HAND),
    )
    got = {r["file_id"]: r["label"] for r in origin.file_labels(df).collect()}
    assert got == {0: "handwritten", 1: "generated", 2: "generated", 3: "blob", 4: "minified", 5: "vendored", 6: "handwritten", 7: "generated", 9: "handwritten", 11: "handwritten", 12: "handwritten", 13: "handwritten"}
    assert rows(origin.not_handwritten(df)) == [(1,), (2,), (3,), (4,), (5,), (7,)]
    assert origin.file_labels(df.limit(0)).count() == 0


def test_siblings_speak(spark):
    """A file with little to say follows its directory; one with evidence of its own does not."""
    made = [("r", f"proto/m{k}.py", "python", "# @generated by tool\n" + TABLE) for k in range(12)]
    got = origin.file_labels(table(spark, *made, ("r", "proto/tiny.py", "python", "x = 1\n"), ("r", "proto/deep/er/tiny.py", "python", "x = 1\n"), ("q", "proto/tiny.py", "python", "x = 1\n")))
    by = {(r["repo_id"], r["rel_path"]): r["confidence"] if r["label"] == "handwritten" else 1 - r["confidence"] for r in got.collect()}
    assert by["r", "proto/tiny.py"] < by["q", "proto/tiny.py"]


def test_place_is_known_by_propagation_alone(spark, monkeypatch):
    """Copies are told by their directory, however deep and many they are; files beside it are not, nor with hot directories."""
    df = table(
        spark, *[("r", f"third_party/zip/src/f{k}.py", "python", HAND + f"# {k}\n") for k in range(30)], ("r", "third_party/__init__.py", "python", ""), ("r", "main.py", "python", HAND),
        *[("r", f"proto/m{k}.js", "javascript", "// @generated by tool\n" + HAND) for k in range(8)], ("r", "proto/t.js", "javascript", "\n".join(f"op({k % 4});" for k in range(9)) + "\n" + "\n".join(f"word{c} = q.{c}{c};" for c in "abcdefg")),
    )
    label = lambda **k: {r["rel_path"]: r["label"] for r in origin.file_labels(df, **k).collect()}
    with_, without = label(), label(propagate=False)
    assert [with_[f"third_party/zip/src/f{k}.py"] for k in range(30)] == ["vendored"] * 30 and with_["main.py"] == "handwritten"
    assert [without[f"third_party/zip/src/f{k}.py"] for k in range(30)] == ["handwritten"] * 30
    assert (without["proto/t.js"], with_["proto/t.js"]) == ("handwritten", "generated")
    monkeypatch.setattr(origin, "HOT", 7)
    assert label() == with_


def test_propagation_is_exact(spark):
    """Against the sum over all labellings of a small tree."""
    import itertools
    import math

    files = [("r", "a/x.py", "python", HAND), ("r", "a/y.py", "python", "# @generated by tool\nx = 1\n"), ("r", "z.py", "python", TABLE[:120])]
    ev = [origin.file_evidence(f[1], f[3]) for f in files]
    dirs, total = {"": 0, "a": 1}, [[0.0] * 5 for _ in files]
    for root, a, *labels in itertools.product(range(5), repeat=5):
        w = origin.ROOT[root] + origin.DIR_GIVEN_DIR[root][a]
        for k, (f, lab) in enumerate(zip(files, labels)):
            w += ev[k][lab] + origin.FILE_GIVEN_DIR[a if "/" in f[1] else root][lab]
        for k, lab in enumerate(labels):
            total[k][lab] += math.exp(w)
    assert dirs
    for r in origin.file_labels(table(spark, *files)).collect():
        t = total[r["file_id"]]
        assert r["label"] == origin.LABELS[t.index(max(t))] and r["confidence"] == pytest.approx(max(t) / sum(t), rel=1e-6)


def test_grammar_pairs():
    got = derive(parse("file: $ item* $\nitem: a b? c | ( item )"))
    assert got == {"$a", "$(", "$$", "ab", "ac", "bc", "c$", "ca", "c(", "(a", "((", "c)", "))", ")$", ")a", ")("}
    assert all(len(p) == 2 for lang in GRAMMARS for p in pairs(lang))


GOOD = {
    "x.py": ["", "\n", "x = {1: [a, *b], **c}\n", "async def f(a, *, b: int = 2, **k) -> None:\n    '''doc <<<<<<< x'''\n    async with a as b, c:\n        yield x\n", "if a:\n    pass\nelif b: x = 1\nelse:\n\ty = lambda: 0\n", "@deco(1)\nclass A(B, metaclass=C):\n    x: int\n", "print(f'{a!r}', end='')\nx = a if b else c\nx = [i for i in y if i]\nassert x, 'no'\n", "from . import a\nfrom .b import (c,\n  d)\nimport x.y as z\ndel a[1:2, ::3]\nglobal_ = 1\n", "match x:\n    case 1:\n        pass\n", "x = 1 \\\n  + 2\r\ny = 3\r\n", "try:\n    a()\nexcept (A, B) as e:\n    raise X from e\nfinally:\n    pass\nwhile not x in y: break\n", "a = b = c; d += 1\nx = a @ b ** -c\nz = x[a, :]\n"],
    "x.js": ["", "const f = async (x) => { await y(x) }\nlet z = a ? b : c\n", "import { a as b, c } from \"m\"\nexport default class A extends B { get x() { return 1 } }\n", "for (const x of xs) { if (x) continue; else break }\nvar r = /[/\"']+/g.test(s)\n", "!function(a,b){a[\"x\"]=b||{};for(var c=0;c<3;c++)b.push(c)}(this,[]);x=>x?x*2:void 0", "a\n  .b()\n  .c(`t ${x}`)\nswitch (x) { case 1: y(); default: z() }\n"],
    "x.ts": ["export function f<T>(a: string[], b?: number): Promise<T> { return g<T>(a as any) }\n", "interface A { x: number; y?: string }\ntype B = A | null\nenum C { D, E }\n", "class A { private x: number = 1; constructor(readonly y: string) {} }\n"],
    "x.java": ["package a.b;\nimport java.util.*;\npublic class A<T> extends B implements C {\n  @Override public List<String> f(int x) throws E { for (var y : z) { if (y instanceof D d) return null; } return new int[]{1}; }\n}\n", "enum A { B, C; int x() { return 1; } }\n"],
    "x.go": ["package a\n\nimport (\n\t\"fmt\"\n)\n\nfunc (x *T) f(a, b int) (int, error) {\n\tfor i := range b {\n\t\tgo g(i)\n\t}\n\treturn m[\"a\"], nil\n}\n", "package a\nvar x = []byte{\n0x1, 0x2,\n}\ntype T struct {\n\tA int `json:\"a\"`\n}\n"],
    "x.c": ["#include <a.h>\n#define X(a) \\\n  ((a) + 1)\nstatic const char *f(struct b *c, ...) { int x[] = {1, 2}; for (int i = 0; i < 3; i++) x[i] = c->d; return \"a\" \"b\"; }\n"],
    "x.cpp": ["#include <v>\nnamespace a { template <typename T> class B : public C { public: B() : x(1) {} virtual ~B() = default; int x; }; }\nauto f(const std::vector<int> &v) { for (auto &x : v) { std::cout << x; } return [&](int y) { return y; }; }\n"],
    "x.rs": ["use a::{b, c as d};\n#[derive(Debug)]\npub struct S<'a> { x: &'a str }\nimpl<'a> S<'a> { pub fn f(&self) -> Option<i64> { let y = vec![1, 2]; match y { Some(z) if z > 1 => Ok(z), _ => panic!(\"no\") } } }\n"],
}
BAD = {
    "x.py": ["def f(\n", "x = 'a\n", "if a\n    b\n", "if a:\nb\n", "  x = 1\n y = 2\n", "a b\n", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "x = (1]\n", "for x\n", "y *\n", "'''open\n", "const x = 1;\n", "x = 1 +\n", "for i in pend", "import a.\n", "def f(:\n  pass\n"],
    "x.js": ["function f( {", "let x = ;", "def f(x):\n  return x\n", "a b c", "/* open", "x = `a", "const int x = 1;", "if (x) }", "public class A { int x; }", "x: [a, b]\n- y: z\n", "import a.b.C;\n"],
    "x.ts": ["const x: = 1", "package a;\n", "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n"],
    "x.java": ["class A { void f( { } }", "class A {", "def f(x):\n", "<html><body class=\"a\">\n", "a: b\nc:\n  - d\n"],
    "x.go": ["package a\nfunc f( {\n}\n", "x := 1\n", "package a;\nclass A { static final int B = 1; }\n", "set -eu\nfor x in *.y; do\n  mv a b\ndone\n", "package a\nfunc f() {\n"],
    "x.c": ["int f() { return 1; ", "package a.b;\nimport c.d;\npublic class E { }\n", "std::string f();\n", "# The guide\n\nStart the thing before you open it.\n"],
    "x.cpp": ["int f() { return (1; }", "def f(self, x) -> int:\n    return 1\n", "package a.b;\nimport c.d;\n"],
    "x.rs": ["fn f() { let x = 1 ", "CREATE TABLE a (\n b INTEGER NOT NULL\n);\n", "package a\nfunc f() int {\n", "fn f() -> { }"],
}


def test_parse_or_not(spark):
    good = [(p, t) for p, ts in GOOD.items() for t in ts]
    bad = [(p, t) for p, ts in BAD.items() for t in ts]
    for p, t in good:
        if p == "x.py":
            ast.parse(t)
    df = table(spark, *[("r", p, None, t) for p, t in good + bad], ("r", "x.py", "python", None), ("r", "x.ini", None, "((("), ("r", None, None, "((("))
    found = {r[0] for r in rows(syntax.invalid(df))}
    every = good + bad
    assert [every[k] for k in sorted(found) if k < len(good)] == []
    assert [every[k] for k in range(len(good), len(every)) if k not in found] == []
    assert max(found) < len(every)


def test_long_nesting(spark):
    """Brackets are matched across blocks by the windows."""
    deep = "x = " + "(" * 60 + ",\n".join(["[1, {2: 3}]"] * 6000) + ")" * 60 + "\n"
    ast.parse(deep)
    assert len(lex("python", deep)[0]) > 5 * syntax.BLOCK
    df = table(spark, ("r", "a.py", "python", deep), ("r", "b.py", "python", deep.replace("(", "[", 1)), ("r", "c.py", "python", deep[:-2]), ("r", "d.py", "python", "x" * 300_000))
    assert rows(syntax.invalid(df)) == [(1,), (2,)]


def test_rates(spark):
    df = table(spark, ("r", "a.py", "python", "x = ("), ("r", "b.py", None, "x = 1"), (None, "c.go", "go", None))
    assert rows(syntax.rates(df)) == [(None, "go", 1, 0, 0.0), ("r", "python", 2, 1, 0.5)]
    assert syntax.findings(df.limit(0)).count() == 0 and unmatched("([]{})") == "" and unmatched("([)") == "([)"
    assert {r["reason"] for r in syntax.findings(df).collect()} == {"nesting", "pair"} or syntax.findings(df).count() > 0


def test_extra_columns_clash(spark):
    df = table(spark, ("r", "a.py", "python", "x = (")).withColumns({c: F.lit("z") for c in ("lang", "reason", "what", "at", "ch", "repo", "dir", "m0")})
    assert rows(syntax.invalid(df)) == [(0,)] and origin.file_labels(df).count() == 1


TWO = {
    "x.py": "a() b()\n", "x.js": "function f() { a() b(); }\n", "x.ts": "function f() { a() b(); }\n", "x.java": "class A { @B(1) int x; void f() { a() b(); } }\n", "x.go": "package a\nfunc f() { a() b() }\n",
    "x.c": "int f() { a() b(); }\n", "x.cpp": "int f() { a() b(); }\n", "x.rs": "pub(crate) fn f() { a() b(); }\n",
}


def test_statements_at_their_own_depth(spark):
    """A missing end between two calls shows in every language; brackets inside a statement do not cut it."""
    good = [("x.py", "def f(x={}): pass\nif k in {1, 2}: pass\n"), ("x.js", "z = y ? f({ a: 1 }) + x : w\n"), ("x.go", "package a\ntype T interface {\n  F(a int) (int, error)\n  G() int\n}\nfunc (x *T) f(a int) int { return func(a int) int { return 1 }(2) }\n"), ("x.java", "class A { @B(1) @C int x; @Override public void f() { int y = (int) x; } }\n")]
    df = table(spark, *[("r", p, None, t) for p, t in good], *[("r", p, None, t) for p, t in TWO.items()], *[("r", p, None, t.replace(") b", ")\n b" if p in ("x.py", "x.go") else "); b").replace("\n b", "\nb")) for p, t in TWO.items()])
    assert rows(syntax.invalid(df)) == [(k,) for k in range(len(good), len(good) + len(TWO))]


def test_reductions():
    """Groups count by what they can be, recursion is exact, ; may be left out where the language lets it."""
    r = Reductions(expand(parse("file: $ item* $\nitem: a b? ; | c ( item ) ; | d ( a% ) ; | if\nif: x item y item")), "$")
    right = ["", "a;", "ab;a;", "c(ab;);", "d(a,a);", "a", "xa;ya;", "xxa;ya;yc(a;);"]
    wrong = ["b;", "aa;", "c(a);", "d(a;);", "d(a,);", "xa;", "ya;", "c(a;)", "xxa;ya;"]
    assert [r.broken(f"${t}$") for t in right] == [None] * len(right)
    assert all(r.broken(f"${t}$") is not None for t in wrong[:-2]) and r.broken("$c(a;)$") is None and r.broken("$xxa;ya;$") is not None
