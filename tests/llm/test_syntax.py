"""Ordinary code of all eight languages, right and wrong; Python against its own parser."""

import ast
import random
import re
import warnings

import pyarrow.parquet as pq
import pytest

from srclake.llm import syntax

WRONG = {
    "python": [
        "else:\n    pass\n", "try:\n    pass\n", "try:\n    pass\nelse:\n    pass\n", "a = 1 if b\n", "import\n", "from x import\n", "from x import (\n)\n", "1 = x\n", "f() = 3\n", "a + 1 = 2\n", "x += y += 1\n",
        "{1:2, 3}\n", "{1, 2: 3}\n", "for x:\n    pass\n", "for x in:\n    pass\n", "f(a=1, 2)\n", "f(**k, *a)\n", "def f(*):\n    pass\n", "def f(a=1, b):\n    pass\n", "def f(a, a b):\n    pass\n", "while:\n    pass\n",
        "if x\n    pass\n", "class A(:\n    pass\n", "x = \n", "x = y z\n", "return return\n", "print 'a'\n", "a b\n", "a..b\n", "[1 2]\n", "(a, b c)\n", "lambda x y: 1\n", "del\n", "assert\n", "with:\n    pass\n", "x ++\n", "not\n", "a = not\n",
        "elif x:\n    pass\n", "finally:\n    pass\n", "except X:\n    pass\n", "None = 1\n", "(a for b)\n", "[x for x]\n", "f(x for x in y, 1)\n", "a if b else\n", "raise from x\n", "global\n", "@\ndef f(): pass\n", "async x = 1\n", "x = 5y\n", "'''a\n",
    ],
    "java": [
        "class A { int f() { return 1 } }", "class A { void f() { try { } } }", "class A { void f() { else { } } }", "class A { void f() { switch { } } }", "class A { void f() { a() b(); } }", "class A { void f() { int = 3; } }",
        "class A { void f( { } }", "class { }", "class A { void f() { for (int i = 0, i < 3) { } } }", "class A { int x = ; }", "class A { void f() { if x { } } }", "class A { void f() { x y z; } }", "import ;", "class A { void f() { a + b; } }",
        "class A { void f() { catch (E e) { } } }", "class A { void f(int) { } }", "class A { f; }", "class A { void f() { int[] a = {1 2}; } }",
    ],
    "c": [
        "int f() { return 1 }", "int f() { else { } }", "int f() { switch { } }", "int f( { }", "int f() { a b c; }", "int x = ;", "int f() { if x { } }", "int f() { for (i = 0; i < 3) { } }", "int f() { a() b(); }", "struct { int x }; int y",
        "int f() { case 1 }", "void f(int &x) { }", "int f() { do { } }", "int f() { x = 1 y = 2; }",
    ],
    "cpp": [
        "int f() { return 1 }", "void f() { try { } }", "void f() { else { } }", "void f() { switch { } }", "class A { void f() { a() b(); } };", "int x = ;", "void f() { for (int i = 0; i < 3) { } }", "template<typename T void f();", "class A { int x }",
        "namespace { int", "void f() { catch (...) { } }", "using ;",
    ],
    "javascript": [
        "if (x { }", "else { }", "switch { }", "try { }", "var = 3;", "let x = ;", "for (;;", "a b c", "f(a b)", "[1 2]", "({a: 1 b: 2})", "class A { x y z }", "1 = x;", "f() = 3;", "import from 'x';", "export ;", "catch (e) { }",
        "return ) ;", "x = {a:};", "const f = (a, b => a;", "while { }", "a ? b;", "new ;",
    ],
    "typescript": ["let x: = 3;", "interface { }", "type X string;", "enum { A }", "function f(a: ) { }", "let x: number string;", "class A { x: }", "const f = (a: number) : => a;", "try { }", "interface A { x: number y: string }", "let x = <number;"],
    "go": [
        "package p\nimport fmt\n", "package p\nfunc f() { else { } }\n", "package p\nfunc f() { x := }\n", "package p\nfunc f( { }\n", "package p\nfunc f() { if { } }\n", "package p\nfunc f() { a b }\n", "package p\nvar x int = \n", "package p\ntype T struct { x, }\n",
        "func f() { }\n", "package p\nfunc f() { for i := range { } }\n", "package p\nfunc f() { return 1 2 }\n", "package p\nfunc f() {\n\tx := []int{\n\t\t1,\n\t\t2\n\t}\n}\n", "package p\nx := 1\n",
    ],
    "rust": [
        "fn f() { a() b(); }", "fn f() { let = 3; }", "fn f( { }", "fn f() { if { } }", "fn f() { else { } }", "fn f() { match { } }", "fn f() { let x = ; }", "struct A { x }", "enum { A }", "impl { }", "fn f() -> { }", "use ;", "fn f() { for x { } }",
        "fn f() { x y }", "fn f() { return return; let }", "fn f(x) { }",
    ],
}
RIGHT = {
    "python": [
        "type X = int\n", "type L[T] = list[T]\n", "match x:\n    case [1, *r] if r: pass\n    case {'a': 1, **k}: pass\n    case A(x=1) | B(): pass\n    case _: pass\n", "match = 1\ncase = match\ntype = case\n", "def f(a, /, b=1, *, c, **k) -> int: ...\n", "def f[T: int](x: T): return x\n",
        "with (open(a) as b, open(c) as d):\n    pass\n", "print(*a, sep='')\n", "x = yield\n", "async def f():\n    async for x in y: await z\n    return [i async for i in j]\n", "a = b = c\n", "a, *b = c\n", "x: int = 3\n", "if (n := f()): pass\n", "f'{a[\"b\"]}'\n", "f\"{a[\"b\"]}\"\n",
        "try:\n    a\nexcept* E as e:\n    b\nelse:\n    c\nfinally:\n    d\n", "lambda *a, k=1, **b: (a, b)\n", "@a.b(c)\nclass A(B, metaclass=C): x = 1; y = 2\n", "x = a if b else c\n", "del a, b[0]\n", "d = {**a, 'b': 1}\n", "print(a, end='');\n", "a[1:2, ::3, ...]\n", "x = not a in b\n", "assert a, b\n", "from . import (a, b as c,)\n",
        "f(a for a in b)\n", "x = 1if y else 2\n", "return\n", "global a, b\n", "nums = 1_000, 0xff, 1e-5, 1j, .5, 5.\n", "def f(x={}): pass\n", "if k in {1, 2}: pass\n",
    ],
    "java": [
        "class A { void f(int... a) { } }", "record P(int x, int y) { P { } }", "sealed interface S permits A, B { }", "public sealed class S permits A { } final class A extends S { }", "non-sealed class B extends S { }", "class A<T extends Comparable<T>> { List<Map<String, T>> x = new ArrayList<>(); }",
        "class A { int f(Object o) { return switch (o) { case Integer i when i > 0 -> i; case P(int x, int y) -> x; default -> { yield 0; } }; } }", "class A { void f() { Runnable r = () -> { }; Function<A, B> g = A::new; h(x -> x + 1, (a, b) -> a); } }", "@interface X { int v() default 1; }",
        "enum E { A(1) { void f() { } }, B; E() { } E(int x) { } }", "class A { void f() { try (var a = b(); c) { } catch (X | Y e) { } finally { } } }", "class A { void f() { for (int i = 0, j = 1; i < j; i++, j--) ; for (String s : x) { } label: while (true) break label; } }", "class A { int[] a = {1, 2,}; int b[][] = new int[3][]; }",
        "class A { void f() { if (o instanceof String s && s.length() > 1) { } var x = (int) y; Object z = (Runnable & A) () -> { }; } }", "package a.b; import static c.d.*; import e.F; class A { }", "class A { String s = \"\"\"\n  a \"b\" c\n  \"\"\"; }", "class A { @Override public <T> T f(@N final T t) throws E { return this.<T>g(t); } }",
        "class A { synchronized void f() { synchronized (this) { assert a : b; } } static { } { } }", "class A { void f() { new A() { void g() { } }.g(); int.class.f(); String[].class.f(); int[]::new.x(); } }".replace(" int[]::new.x();", " g(int[]::new);"),
    ],
    "c": [
        "int f(int a[static n]) { return a[0]; }", "#include <a.h>\nstatic const char *const names[] = { \"a\", [2] = \"b\" };", "typedef struct node { struct node *next; int v : 3; } node_t;", "int (*fp)(int, char *) = 0;", "void f(void) { for (int i = 0; i < 3; ++i) { } do x++; while (x < 3); }",
        "int f(void) { switch (x) { case 1: case 2: return 1; default: break; } goto end; end: return 0; }", "enum e { A = 1, B, };", "size_t n = sizeof(struct a) + sizeof x;", "int x = (int)y + (a ? b : c);", "struct p q = { .x = 1, .y = { 2, 3 } };", "printf_t f(const char *fmt, ...);", "void f(void) { struct s v = (struct s){ 1, 2 }; g(&v, *p->q); }",
        "static inline unsigned long long g(uint8_t *restrict p) { return *p++; }", "char *s = \"a\" \"b\";", "int a, *b, c[3] = {0};", "void f(int, char *[]);", "int main(int argc, char **argv) { if (a) if (b) x(); else y(); return 0; }",
    ],
    "cpp": [
        "template<typename... T> void f(T&&... t) { g(std::forward<T>(t)...); }", "template <class T, int N = 3> struct A : public B<T>, private C { A() : B<T>(1), x{2} { } ~A() = default; T x; };", "auto f = [&, x = 1](auto a) mutable -> int { return a + x; };", "namespace a::b { using namespace std; using X = std::vector<int>; }",
        "int main() { for (auto& [k, v] : m) { } std::map<std::string, std::vector<int>> x; auto y = x.begin()->second; }", "class A final : public B { public: explicit A(int a); virtual void f() const noexcept override = 0; operator bool() const; A& operator=(const A&) = delete; friend class C; private: int x_ = 0; };",
        "template <typename T> concept C = requires(T t) { t.f(); { t.g() } -> std::same_as<int>; };", "void f() { try { throw std::runtime_error(\"x\"); } catch (const E& e) { } catch (...) { throw; } }", "enum class E : uint8_t { A, B = 2 };", "std::unique_ptr<A> p = std::make_unique<A>(1, \"b\"); int* q = new int[3]; ",
        "constexpr auto x = static_cast<int>(1.5) << 2;", "if_t f(std::function<void(int)> g);", "void f() { if (auto it = m.find(k); it != m.end()) { delete it->second; } if constexpr (N > 1) { } }", "extern \"C\" { int f(void); }", "A::A(int x) : x_(x) {}\nvoid A::f() const { }", "std::ostream& operator<<(std::ostream& o, const A& a) { return o << a.x; }",
        "[[nodiscard]] int f();", "using F = void (*)(int);", "template <> struct H<int> { };", "static_assert(sizeof(int) == 4, \"x\");", "auto g() -> decltype(f());", "int x = R\"(a \" b)\"s.size();", "void f() { co_await g(); co_return; }",
    ],
    "javascript": [
        "const s = `a ${`b ${c} d`} e`;", "class A { #x = 1; static #y; get z() { return this.#x; } static { } async *g() { } has(o) { return #x in o; } }", "import x from 'y' with { type: 'json' };", "import * as a from 'b'; import c, { d as e, default as f } from 'g'; export * from 'h'; export { a as default };",
        "const { a, b: { c = 1 }, ...d } = e; [a, , b = 2, ...c] = d;", "const f = async (a, { b }) => { await a?.b?.[c]?.(d); };", "for (const x of y) { } for (const k in o) ; for await (const z of w) { }", "label: for (;;) { continue label }", "var a = b\nvar c = d\nfoo()\n", "x = a ? b : c ? d : e", "let re = /a[/]b/g.test(s)", "if (a) b(); else if (c) d(); else { e() }",
        "switch (a) { case 1: b(); break\n default: c() }", "export default class extends A { }", "export default function () { }", "const o = { a, b() { }, get c() { return 1 }, ['d']: 1, async *e() { }, ...f, 'g': 2, if: 3 };", "a ??= b; a **= 2; c = a ** b;", "do x++; while (x < 3)", "try { } catch { } finally { }", "new Foo; new (a.b)(c); new a.B(1).c();", "tag`x${1}`", "function* g() { yield* a; const b = yield; }", "return",
        "const f = a => b => ({ a, b })", "(function () { })()", "x = function y() { }", "var get = 1, set = 2, of = 3, async = 4; async = get", "import('x').then(m => m.y)",
    ],
    "typescript": [
        "function f(x: unknown): x is string { return true; }", "function g(x: any): asserts x is T { }", "type A<T> = T extends (infer U)[] ? U : never;", "function h<const T>(x: T) { }", "interface A<T> extends B, C<T> { readonly x?: number; [k: string]: any; f(a: string): void; new (x: number): A; (y: T): T }", "type M = { readonly [K in keyof T]?: T[K] };",
        "enum E { A = 1, B = 'x' } const enum F { C }", "abstract class A<T> extends B<T> implements C, D { private readonly x: number = 1; constructor(public a: string, private b?: number) { super(); } abstract f(): void; static g?: string; declare h: number; }", "let x = y as unknown as Z; let z = a!.b!; const c = <T>d; const e = { } as const; const s = { } satisfies T;",
        "declare module 'x' { export function f(): void; }", "namespace A.B { export const x = 1; }", "export type { A } from './a'; import type { B } from './b'; import { type C, D } from './c';", "type F = (a: number, ...b: string[]) => Promise<void>; type G = new () => A; type T = [a: string, b?: number, ...c: any[]]; type L = `a${string}`;",
        "const f = <T,>(x: T): T => x; const g = async <T>(x: Promise<T>): Promise<Map<string, T[]>> => { };", "function f(this: Window, a?: number): void; function f(): void { }", "let v: typeof x.y; let w: import('a').B<C>; let u: A['b'][]; let t: unique symbol;", "@Component({ a: 1 }) class A { @Input() x: string; @Output() y = new E<void>(); }", "type U =\n  | 'a'\n  | 'b'\n", "for (const [k, v] of Object.entries<number>(o)) { }",
        "export default interface A { x: number }", "let f: (x: number) => x is 1;".replace("x is 1", "boolean"), "const x = y satisfies Z;", "type X = A | B & C;", "try { } catch (e: unknown) { }", "let a = b < c, d = e > f;",
    ],
    "go": [
        "package p\n\nimport (\n\t\"a\"\n\tb \"c\"\n\t_ \"d\"\n)\n\nfunc (s *S) F(a, b int, c ...string) (x int, err error) {\n\tdefer s.mu.Unlock()\n\tif x, ok := m[k]; !ok {\n\t\treturn 0, nil\n\t} else if y {\n\t}\n\treturn\n}\n",
        "package p\ntype N[T any, K comparable] struct { a, b T; C; *D; e map[K][]T `json:\"e\"` }\nfunc Map[T, U any](x []T, f func(T) U) []U { return nil }\n", "package p\nfunc f() {\n\tfor i := range 10 {\n\t}\n\tfor k, v := range m {\n\t}\n\tfor {\n\t}\n\tfor x < 3 {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n}\n",
        "package p\nfunc f() {\n\tswitch x := y.(type) {\n\tcase int, *T:\n\t\ta()\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\tcase d <- 1:\n\tdefault:\n\t}\n}\n", "package p\nvar (\n\ta = []int{1, 2, 3}\n\tb = map[string]T{\"x\": {1, 2}, \"y\": {}}\n\tc = &T{A: 1}\n)\nconst (\n\tX = iota\n\tY\n)\n",
        "package p\ntype I interface {\n\tF(int) error\n\tio.Reader\n\t~int | ~string\n}\ntype A = B\ntype F func(int) (string, error)\n", "package p\nfunc f() { go func() { c <- 1 }(); x.y[1:2].z(a...); var e error; L: for { break L } }\n", "package p\nfunc f() { x := struct{ A int }{1}; y := make(chan<- int); z := interface{}(x).(T) }\n", "package p\nfunc f() { a, b = b, a; c++; d &^= 1; *p = 3; p.q[r] += 2 }\n",
    ],
    "rust": [
        "fn f() -> impl Iterator<Item = u8> + '_ { x.iter() }", "macro_rules! m { ($x:expr) => { $x + 1 }; }", "impl<T: Clone + 'static, const N: usize> A<T> for B<T, N> where T: Into<String> { type X = T; const Y: u8 = 1; fn f(&mut self, (a, b): (u8, u8)) -> Result<(), Box<dyn Error>> { Ok(()) } }",
        "fn f() { let Some(x) = y else { return; }; if let Some(a) = b && c { } while let Some(z) = it.next() { } let v = match q { A { x, .. } if x > 1 => 1, B(_) | C => { 2 } 1..=5 => 3, _ => unreachable!(), }; }", "#[derive(Debug, Clone)] pub struct A<'a> { pub(crate) x: &'a str, y: Vec<Option<u8>> }\nstruct U; struct T(pub u8, u8);",
        "enum E { A, B(u8), C { x: u8 }, D = 3 }", "async fn f() { g().await?; let c = async move { 1 }; let d = |x: u8, &y| -> u8 { x + y }; let e = move || 3; h(|a| a * 2, ..); }", "use std::{collections::{self, HashMap}, io::*}; pub use a::b as c;", "trait A: B + Send { fn f(&self); fn g() -> Self where Self: Sized { x } }", "fn f() { println!(\"{} {x}\", a, x = 1); vec![0; 3]; matches!(a, B | C); let x = &mut y[1..]; *z += 1; 'a: loop { break 'a; } }",
        "unsafe extern \"C\" fn f(x: *const u8) -> ! { loop { } }", "static X: [u8; 3] = [1, 2, 3]; const fn f() { } mod a { } pub mod b;", "fn f() { let x = if a { 1 } else if b { 2 } else { 3 }; let y = A::<u8>::new().b::<C>(d); let z = S { a, b: 1, ..Default::default() }; return; }", "fn f<F>(g: F) where F: for<'a> Fn(&'a str) -> bool { }", "/* a /* b */ c */ fn f() { x as u8 as char; -1 < 2; a && !b || c; }",
    ],
}


@pytest.mark.parametrize("lang,text", [(k, t) for k, ts in WRONG.items() for t in ts])
def test_wrong(lang, text):
    assert syntax.judge(lang, text) is not None


@pytest.mark.parametrize("lang,text", [(k, t) for k, ts in RIGHT.items() for t in ts])
def test_right(lang, text):
    assert syntax.judge(lang, text) is None


@pytest.mark.parametrize("lang", sorted(RIGHT))
def test_forgetting_changes_nothing(lang, monkeypatch):
    monkeypatch.setattr("srclake.llm.automata.POINTS", 300)
    assert [t for t in RIGHT[lang] if syntax.judge(lang, t)] == [] and [t for t in WRONG[lang] if not syntax.judge(lang, t)] == []


def _parses(text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError):
        return False


def test_agrees_with_pythons_parser_on_mutations():
    """Every Python file of sf0.01, whole and with one token dropped, doubled elsewhere or swapped."""
    table = pq.read_table("/root/testdata/sf0.01/source_files.parquet", columns=["rel_path", "content"]).to_pylist()
    texts = [r["content"] for r in table if (r["rel_path"] or "").lower().endswith(".py") and r["content"]]
    token, rnd, seen = re.compile(r"\w+|\s+|[^\w\s]"), random.Random(3), {True: [0, 0], False: [0, 0]}
    for text in texts:
        mutated = [text]
        for kind in "dsi":
            parts = token.findall(text)
            places = [k for k, x in enumerate(parts) if not x.isspace()]
            if len(places) > 1:
                a, b = rnd.sample(places, 2)
                if kind == "d":
                    parts[a] = ""
                elif kind == "s":
                    parts[a], parts[b] = parts[b], parts[a]
                else:
                    parts[a] = f"{parts[b]} {parts[a]}"
                mutated.append("".join(parts))
        for m in mutated:
            right = _parses(m)
            seen[right][0] += 1
            seen[right][1] += (syntax.judge("python", m) is None) == right
    for right, (n, agreed) in seen.items():
        assert n >= 200 and agreed >= 0.98 * n, (right, n, agreed)
