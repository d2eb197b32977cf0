"""From source text to one character per token: the classes that ``grammars`` speaks of.

Comments go, literals become one token, and a line end that ends a statement becomes ';'. ``lex`` works with a
few passes of compiled expressions over the whole text, not token by token.
"""

from __future__ import annotations

import re

_BLOCK, _LINE = r"/\*.*?\*/", r"//[^\n]*"
_DQ, _SQ = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'"
_TICK = r"`(?:[^`\\]|\\.)*`"
_REGEX = r"(?:(?<=[=(,:;!&|?{}\[+\n])|(?<=[=(,:;!&|?{}\[+] )|(?<=return ))/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"


def _re(*parts: str) -> re.Pattern:
    return re.compile("|".join(parts), re.S)


#: What is cut out first: comments (start with / or #) and literals.
_CUT = {
    "javascript": _re(_LINE, _BLOCK, _DQ, _SQ, _TICK, _REGEX),
    "typescript": _re(_LINE, _BLOCK, _DQ, _SQ, _TICK, _REGEX),
    "java": _re(_LINE, _BLOCK, r'"""(?:[^\\]|\\.)*?"""', _DQ, r"'(?:[^'\\\n]|\\[^\n])[^'\n]{0,8}?'"),
    "go": _re(_LINE, _BLOCK, _DQ, r"`[^`]*`", r"'(?:[^'\\\n]|\\[^\n])[^'\n]{0,9}?'"),
    "c": _re(_LINE, _BLOCK, _DQ, r"'(?:[^'\\\n]|\\[^\n])[^'\n]{0,9}?'"),
    "cpp": _re(_LINE, _BLOCK, r'R"([^()\\ ]{0,16})\(.*?\)\1"', _DQ, r"(?<![0-9A-Fa-f])'(?:[^'\\\n]|\\[^\n])[^'\n]{0,9}?'"),
    "rust": _re(_LINE, _BLOCK, r'b?r(#*)".*?"\1', r'b?"(?:[^"\\]|\\.)*"', r"b?'(?:\\[^\n][^'\n]{0,9}|[^'\\\n])'"),
    "python": _re(
        r"#[^\n]*", r"(?:\b[rRbBfFuUtT]{1,2})?(?:'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'(?!'')(?:[^'\\\n]|\\(?:.|\n))*'|\"(?!\"\")(?:[^\"\\\n]|\\(?:.|\n))*\")",
    ),
}
_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(?:include|define|undef|if|ifdef|ifndef|elif|else|endif|pragma|error|warning|line)\b(?:[^\n\\]|\\.)*", re.M | re.S)
_HASHBANG = re.compile(r"#![^\n\[]*")
_CONFLICT = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?:[ \r\n]|\Z)", re.M)
_LEFT = re.compile(r"[\"`\\]|/\*|\*/")

def _operators(*signs: str) -> str:
    return "|".join(map(re.escape, sorted(" ".join(signs).split(), key=len, reverse=True)))


_NUMBER = r"0[xXbBoO][\w.]*(?:(?<=[pP])[+-]\w+)?|(?:\d[\w]*\.?\w*|\.\d\w*)(?:(?<=\d[eE])[+-]\w+)?"
_SIGNS = {
    "javascript": _operators(">>>= <<= >>= **= &&= ||= ??= === !== ... ++ -- ** && || ?? == != <= >= => += -= *= /= %= &= |= ^= << ?."),
    "go": _operators("... <<= >>= &^= ++ -- && || == != <= >= := += -= *= /= %= &= |= ^= << >> &^ <-"),
    "java": _operators(">>>= <<= >>= ... ++ -- && || == != <= >= -> += -= *= /= %= &= |= ^= << ::"),
    "c": _operators("... <<= >>= ++ -- && || == != <= >= -> += -= *= /= %= &= |= ^= << >>"),
    "cpp": _operators("... <<= >>= ++ -- && || == != <= >= -> += -= *= /= %= &= |= ^= << ::"),
    "rust": _operators("... ..= <<= >>= && || == != <= >= -> => += -= *= /= %= &= |= ^= << :: .."),
    "python": _operators("... **= //= <<= >>= -> := += -= *= /= %= &= |= ^= @= ** // == != <= >= << >>"),
}
_SIGNS["typescript"] = _SIGNS["javascript"]
#: In Rust 1..2 is a range, not 1. and .2; a tuple's field may follow a dot.
_RUST_NUMBER = r"0[xbo]\w+|\d[\d_]*(?:\.\d[\d_]*(?:[eE][+-]?\d+)?|\.(?![.\w]))?\w*"
_PYTHON_NUMBER = r"0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?"


def _tokens(language: str) -> re.Pattern:
    js = language in ("javascript", "typescript")
    number = {"rust": _RUST_NUMBER, "python": _PYTHON_NUMBER}.get(language, _NUMBER)
    word = r"[$#]?[\w$]+" if js else r"\w+"
    return re.compile("|".join([number, word, r"\x01", *[r"\n"] * (js or language == "go"), _SIGNS[language], r"\S"]))


_TOKENS = {k: _tokens(k) for k in _SIGNS}


def _kinds(text: str) -> dict[str, str]:
    table = {"\x01": "s", "\n": "\n"} | {c: c for c in "()[]{};,.:?<>@"}
    for line in text.strip().splitlines():
        kind, *words = line.split()
        table |= dict.fromkeys(words, kind)
    return table


_JS = """
g += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??=
= =
o / % ^ == != === !== <= >= << && || ?? **
z |
& &
u + -
S *
v ~
! !
q ++ --
e ...
d ?.
a =>
I if
E else
F for
W while
D do
Y switch
X catch
A try
Q finally
H with
C case
L default
R return
t throw
B break continue
b debugger
M export
K class
x extends
U import
N new
V var let const
P function
T typeof
O void delete
w await
y yield
Z in instanceof
n true false null this super
f from
r of
h static get set accessor
j async
k as assert
2 enum
"""
#: Token classes of each language. The languages' keywords and operators.
KINDS = {
    "javascript": _kinds(_JS),
    "typescript": _kinds(_JS + "m abstract declare public private protected readonly override\n1 interface\n3 namespace module\n4 type\n5 keyof unique infer\n6 is\n7 asserts\n8 satisfies\n9 implements"),
    "go": _kinds("= =\nw :=\ng += -= *= /= %= &= |= ^= <<= >>= &^=\no / % | == != <= >= < > << >> && || &^\nu + - & ^\nS *\nv !\n~ ~\na <-\nq ++ --\ne ...\nI if\nE else\nD go defer\nW switch\nJ select\nF for\nC case\nL default\nR return\nB break continue goto fallthrough\nU import\nk package\nV var const\ny type\nP func\nT struct\nN interface\nM map\nH chan\nZ range\nn nil true false"),
    "java": _kinds("= =\ng += -= *= /= %= &= |= ^= <<= >>= >>>=\no / % ^ == != <= >= << && ||\nz |\n& &\nu + -\nS *\nv ! ~\nq ++ --\na ->\ne ...\ny ::\nI if\nE else\nD do\nA try\nQ finally\nW while\nY switch\nX catch\nH synchronized\nF for\nC case\nL default\nR return\nt throw\nb assert\nB break continue\nM public private protected static final abstract native transient volatile strictfp\nK class\n1 interface\n2 enum\nr record\nx extends\n9 implements\n7 throws\np permits\nm sealed\nk package\nU import\nN new\nZ instanceof\nf yield\nw when\nT int long double float boolean char byte short\nO void\nn true false null this\n5 super"),
    "c": _kinds("= =\ng += -= *= /= %= &= |= ^= <<= >>=\no / % | ^ == != <= >= < > << >> && ||\n& &\nu + -\nS *\nv ! ~\nq ++ --\n. ->\ne ...\nI if\nE else\nD do\nW while\nY switch\nF for\nC case\nL default\nR return\nB break continue\nb goto\nM const static extern volatile register inline restrict auto _Noreturn _Atomic _Thread_local __inline __inline__ __restrict __extension__ constexpr thread_local\ny typedef\nK struct union\n2 enum\nT int long double float char short void signed unsigned bool _Bool _Complex\nw sizeof _Alignof alignof\nA _Static_assert static_assert\n@ __attribute__\n6 asm __asm__\nn true false"),
    "cpp": _kinds("= =\ng += -= *= /= %= &= |= ^= <<= >>=\no / % | ^ == != <= >= << || and or\n& &\n8 &&\nu + -\nS *\nv ! not\n~ ~\nq ++ --\na ->\ne ...\ny ::\nI if\nE else\nD do\n1 try\nW while\nY switch\nX catch\nF for\nC case\nL default\nR return co_return\nt throw\n5 co_await co_yield\nB break continue\nb goto\nM const static extern volatile register inline typedef constexpr consteval constinit virtual explicit friend mutable thread_local\nQ public private protected\nf override final\n9 noexcept\nK class struct union\n2 enum\nV typename\n3 namespace\nT int long double float char short void signed unsigned bool auto wchar_t char8_t char16_t char32_t\nw sizeof alignof typeid alignas\nd decltype\nN new\nx delete\nP template\nU using\nA operator\n7 static_assert\nc concept\nr requires\n@ __attribute__\n6 asm\nn nullptr true false this"),
    "rust": _kinds("= =\ng += -= *= /= %= &= |= ^= <<= >>=\no / % ^ == != <= >= <<\nO ||\n8 &&\nz |\n& &\nu + -\nS *\n! !\n~ ~\ne .. ..= ...\nG =>\na ->\ny ::\n# #\nI if\nE else\nF for\nW while\nD loop\nQ match\nL let\nH where\nR return\nB break continue\nM pub\nm mut\nr ref\nK struct\n1 enum\n2 trait\n3 impl\n4 mod\n5 type\n6 extern\nX self Self super crate\nU use\nV const\nv static\nP fn\nq async\nw await\nA as\nZ in\nd dyn\n9 unsafe\nc move\nk union auto\nn true false"),
    "python": _kinds("= =\nw :=\ng += -= *= /= %= &= |= ^= <<= >>= **= //= @=\no // % & ^ << >>\nz |\n/ /\nu + -\nS *\nQ **\n~ ~\nO and or\nv not\nC == != <= >=\nZ in\nJ is\na ->\ne ...\nN ;\nI if\nE elif\nL else\nW while\nT try\nX except\nY finally\nF for\nH with\nP def\nK class\nR return\nr raise\nB pass break continue\nD del\nA as\nf from\nU import\nG global nonlocal\nl lambda\ny yield\nx await\nj async\nq assert\nc None True False\nm match\nk case\nt type"),
}

_WORDS_AFTER_DOT = re.compile(r"(?<=[.d])[IEFWDYXAQHCLRtBbMKxUNVPTOwyZn2]")
#: Line ends that may end a statement: after what can end one, before what can begin one.
_JS_END = re.compile(r"(?<![,.:?=gozu&S<>a({\[;e\n])\n+(?![\n.,:?)\]}ozg=a])")
_GO_END = re.compile(r"(?<=[ins)\]}qRB])\n+")
#: Rust's macros whose arguments are expressions; what others take is theirs to say.
_PLAIN_MACROS = {"println", "print", "eprintln", "eprint", "format", "write", "writeln", "panic", "assert", "assert_eq", "assert_ne", "debug_assert", "debug_assert_eq", "debug_assert_ne", "vec", "todo", "unimplemented", "unreachable", "dbg"}


class _Classes(dict):
    """Token -> class; what it has not met it works out and keeps, up to a size."""

    def __init__(self, fixed: dict[str, str]):
        super().__init__(fixed)
        self.fixed = fixed

    def __missing__(self, w: str) -> str:
        if len(self) > 300_000:
            self.clear()
            self.update(self.fixed)
        kind = "n" if w[0].isdecimal() or w[0] == "." and len(w) > 1 else "i" if w[0].isidentifier() or w[0] in "$#" and len(w) > 1 else "\0"
        self[w] = kind
        return kind


_TABLES: dict[str, _Classes] = {}


def _table(language: str) -> _Classes:
    if language not in _TABLES:
        _TABLES[language] = _Classes(KINDS[language])
    return _TABLES[language]


def lex(language: str, text: str) -> tuple[str, str]:
    """(token classes, "" or why the text has no tokens of this language)."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")
    if language == "python":
        return _lex_python(text)
    newlines = language in ("javascript", "typescript", "go")
    if language in ("c", "cpp"):
        text = text.replace("\\\n", " ")
    if text.startswith("#!") and (language != "rust" or not text.startswith("#![")):
        text = _HASHBANG.sub("", text, count=1)

    def cut(m: re.Match) -> str:
        found = m[0]
        if found[:2] in ("//", "/*"):
            return "\n" if newlines and "\n" in found else " "
        return "\x01"

    if newlines and language != "go" and "${" in text:
        text = _templates(text)
        if text is None:
            return "", "open literal or comment"
    if language == "rust" and "/*" in text:
        text = _nested_comments(text)
    text = _CUT[language].sub(cut, text)
    if language in ("c", "cpp"):
        text = _DIRECTIVE.sub(" ", text)
    if language == "rust":
        text = re.sub(r"'([A-Za-z_]\w*)\b(?!')", "\x02", text)
    if _CONFLICT.search(text):
        return "", "conflict marker"
    if _LEFT.search(text) or "'" in text and language != "cpp":
        return "", "open literal or comment"
    if language == "java" and "non-sealed" in text:
        text = re.sub(r"\bnon-sealed\b", "sealed", text)
    if language == "cpp":
        text = re.sub(r"(?<=[0-9A-Fa-f])'(?=[0-9A-Fa-f])", "", text)
    words = _TOKENS[language].findall(text)
    if not words:
        return "", ""
    found = "".join(map(_table(language).__getitem__, words))
    if language == "rust":
        found = "".join("t" if w == "\x02" else k for w, k in zip(words, found)) if "\x02" in text else found
        if "#" in found or "!" in found:
            found = _opaque(words, found)
    if "\0" in found:
        return "", "character that begins no token"
    if language == "go":
        found = _GO_END.sub(";", found + "\n").replace("\n", "")
    elif newlines:
        found = _WORDS_AFTER_DOT.sub("i", found)
        found = _JS_END.sub("\x03", found.strip("\n")).replace("\n", "").replace("\x03", "\n")
    return found, ""


def _opaque(words: list[str], classes: str) -> str:
    """Rust: what stands in attributes, and in macros that may take any tokens, is one class but for its brackets."""
    out = list(classes)
    k, n = 0, len(out)
    while k < n:
        if out[k] == "#":
            at = k + 2 if k + 1 < n and out[k + 1] == "!" else k + 1
        elif out[k] == "!" and k and out[k - 1] in "iX" and words[k - 1] not in _PLAIN_MACROS:
            at = k + 1 if k + 1 < n and out[k + 1] in "([{" else k + 2
        else:
            k += 1
            continue
        k += 1
        if at < n and out[at] in "([{":
            depth, k = 1, at + 1
            while k < n and depth:
                if out[k] in "([{":
                    depth += 1
                elif out[k] in ")]}":
                    depth -= 1
                else:
                    out[k] = "J"
                k += 1
    return "".join(out)


_NESTED = re.compile(r"//[^\n]*|/\*|\*/|b?r(#*)\".*?\"\1|b?\"(?:[^\"\\]|\\.)*\"|'(?:\\[^\n][^'\n]{0,9}|[^'\\\n])'", re.S)


def _nested_comments(text: str) -> str:
    """Rust's block comments lie within one another."""
    parts, at, depth = [], 0, 0
    pos = 0
    while True:
        m = _NESTED.search(text, pos) if not depth else re.compile(r"/\*|\*/").search(text, pos)
        if not m:
            break
        pos = m.end()
        if m[0] == "/*":
            if not depth:
                parts.append(text[at : m.start()])
                at = m.start()
            depth += 1
        elif m[0] == "*/" and depth:
            depth -= 1
            if not depth:
                at = pos
                parts.append(" ")
    return "".join(parts) + text[at:]


_TEMPLATE_PART = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_TEMPLATE_CODE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|" + _REGEX + r"|[`{}]", re.S)


def _templates(text: str) -> str | None:
    """Template literals become plain ones of their length's worth of nothing, whatever templates their expressions hold; None if
    one does not end. What stands in ${} is not looked into."""
    parts: list[str] = []
    stack: list[str] = []
    at = pos = 0
    while True:
        if stack and stack[-1] == "`":
            pos = _TEMPLATE_PART.match(text, pos).end()
            if pos >= len(text):
                return None
            if text[pos] == "`":
                stack.pop()
                pos += 1
                if not stack:
                    parts.append("``")
                    at = pos
            else:
                stack.append("${")
                pos += 2
            continue
        m = _TEMPLATE_CODE.search(text, pos)
        if not m:
            break
        pos = m.end()
        if m[0] == "`":
            if not stack:
                parts.append(text[at : m.start()])
            stack.append("`")
        elif m[0] == "{" and stack:
            stack.append("{")
        elif m[0] == "}" and stack:
            stack.pop()
    return None if stack else "".join(parts) + text[at:]


#: A formatted string in whose braces its own quote stands again.
_INNER_QUOTE = re.compile(r"\b[rR]?[fFtT][rR]?(?:\"[^\"\n]*\{[^\"}\n]*\"|'[^'\n]*\{[^'}\n]*')")
_STRING_START = re.compile(r"#[^\n]*|(?P<f>\b(?:[rR]?[fFtT][rR]?))?(?P<q>\"\"\"|'''|\"|')|[{}]")


def _formatted(text: str) -> str:
    """Formatted strings become plain ones, whatever strings their expressions hold."""
    parts: list[str] = []
    stack: list[str] = []  # quotes of formatted strings and { of their expressions
    at = pos = 0
    while True:
        if stack and stack[-1] != "{":
            quote = stack[-1]
            m = re.compile(rf"\\.|\{{\{{|\{{|{quote}" + ("|\n" if len(quote) == 1 else ""), re.S).search(text, pos)
            if not m or m[0] == "\n":
                return text  # does not end: left as it is
            pos = m.end()
            if m[0] == quote:
                stack.pop()
                if not stack:
                    parts.append('""')
                    at = pos
            elif m[0] == "{":
                stack.append("{")
            continue
        m = _STRING_START.search(text, pos)
        if not m:
            break
        pos = m.end()
        if m["f"]:
            if not stack:
                parts.append(text[at : m.start()])
            stack.append(m["q"])
        elif m["q"]:
            q = m["q"]
            e = re.compile(rf"(?:\\.|(?!{q}).)*{q}", re.S).match(text, pos)
            if not e:
                return text
            pos = e.end()
        elif stack and m[0] == "}":
            stack.pop()
        elif stack and m[0] == "{":
            stack.append("{")
    return text if stack else "".join(parts) + text[at:]


_DENTS = re.compile(r"[ \t\f]*")


def _lex_python(text: str) -> tuple[str, str]:
    def cut(m: re.Match) -> str:
        return "" if m[0][0] == "#" else "\x01"

    if _INNER_QUOTE.search(text):
        text = _formatted(text)
    text = _CUT["python"].sub(cut, text)
    if _CONFLICT.search(text):
        return "", "conflict marker"
    text = text.replace("\\\n", " ")
    if '"' in text or "'" in text or "\\" in text:
        return "", "open literal or comment"
    findall, of = _TOKENS["python"].findall, _table("python").__getitem__
    out: list[str] = []
    indents, depth, opened = [0], 0, False
    for line in text.split("\n"):
        if not line or line.isspace():
            continue
        found = "".join(map(of, findall(line)))
        if "\0" in found:
            return "", "character that begins no token"
        if not depth:
            lead = _DENTS.match(line)[0]
            width = len(lead.expandtabs(8))
            if width > indents[-1]:
                if not opened:
                    return "", "unexpected indent"
                indents.append(width)
                out.append("b{")
            else:
                if opened:
                    return "", "no indented block"
                while width < indents[-1]:
                    indents.pop()
                    out.append("}")
                if width != indents[-1]:
                    return "", "dedent to no outer level"
            opened = False
        out.append(found)
        depth += found.count("(") + found.count("[") + found.count("{") - found.count(")") - found.count("]") - found.count("}")
        if depth < 0:
            return "", "closed what was not open"
        if not depth:
            if found[-1] == ":":
                opened = True
            else:
                out.append(";")
    if opened:
        return "", "no indented block"
    if depth:
        return "".join(out), ""
    out.append("}" * (len(indents) - 1))
    return "".join(out), ""


_PAIR = re.compile(r"\(\)|\[\]|\{\}")
_NO_BRACKET = re.compile(r"[^()\[\]{}]+")


def unmatched(classes: str) -> str:
    """Brackets left after those that match have cancelled: closers, then openers, unless kinds clash."""
    rest = _NO_BRACKET.sub("", classes)
    while True:
        less = _PAIR.sub("", rest)
        if less == rest:
            return rest
        rest = less
