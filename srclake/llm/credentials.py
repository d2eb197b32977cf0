"""Problem 3: credentials in source code and configuration, found by place and masked in place.

Three steps on each text, in one Arrow pass without any shuffle:

1. every quoted literal is rated by its characters per subword of a public tokenizer: words of any language and
   identifiers have four and more, random strings two. What is under the bounds below is nominated as unnatural;
2. rules of context say what a string is: the value given to a secret's name, a login header, the password in an
   address, a signature in a link, a prefixed token, an argument after the user's name of a call that signs in, a
   private key block. Values without quotes (configuration files, comments, headers, links) are cut out by these rules and
   rated then;
3. what is nominated and stands in such a context is a credential, unless it is a placeholder, a lookup or a UUID. Natural
   words are credentials only where the context leaves no doubt: in an address, or as the whole value of a password's name.

Masking keeps every offset: each character of the credential becomes 'x', line ends stay, nothing else changes.

Defined results: null or empty text has no row; lines are counted from 1 and end at \\n; one row per text and line,
the line on which the credential begins; a repeated row is reported under its own id; a text of any length is read whole.
"""

from __future__ import annotations

import re
from bisect import bisect
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srclake.llm.common import TOKENIZER_DIR, encoder, map_rows

#: Characters per subword under which a literal is unnatural. Between words (4 and more) and random text (2 and less).
UNNATURAL = 3.4
#: The same for a value of a secret's name that mixes letters and digits, as pass phrases of words and a number do.
UNNATURAL_MIXED = 4.6
#: The same for letters of one case alone: short words may be two subwords.
UNNATURAL_WORD = 2.4
MASK = "x"

_LITERAL = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"
#: What follows a secret's name: [type] = "literal" ["+ literal"], also "name": "literal", and "name", "literal" of a call.
_ASSIGNED = re.compile(
    r"[\w.-]*(?:\[\])?(?:(?P<quote>[\"'])\]?)?[ \t]*"
    r"(?::[ \t]*(?:Option<)?&?(?:'\w+ )?[A-Za-z][\w.\[\]<>]*[ \t]*)?(?P<by>:=|=>|==?|:|,)[ \t]*(?P<value>(?:[bru]|String::from\()?(?:" + _LITERAL + r")(?:[ \t]*[+.]{1,2}[ \t]*(?:" + _LITERAL + r"))*)",
)
#: A value to the end of the line or the next blank, in configuration files and in comments.
_SETTING = re.compile(r"[\w.-]*[ \t]*(?P<by>[:=])[ \t]*(?P<value>[^\s\"'`{<$][^\n]*)")
_COMMENTED = re.compile(r"[\w.-]*(?:[ \t]*(?P<by>[:=])[ \t]*|[ \t]+(?:(?:is|was|are|were)[ \t]+)?)[\"'`(]?(?P<value>[^\s\"'`{<$()][^\s\"'`]*)")
_LOGIN = re.compile(r"[^\n:]*:[ \t]*[^\s/:]+[ \t]*[/:][ \t]*(?P<value>[^\s/\"'`,;]+)")
_USER_OPTION = re.compile(r"[\"']?[^\s:\"']+:(?P<value>[^\s\"']+)")
_COMMENT = re.compile(r"[ \t]*(?:#|//|/?\*|;|--|<!--|\"\"\"|''')|.*?[ \t;{}](?:#|//|/\*)[ \t]")
_KEYS = ("api", "private", "signing", "session", "encryption", "access", "auth", "service", "account", "storage", "master", "shared", "ssh", "hmac", "jwt", "deploy", "license", "secret")
_PASS = ("admin", "user", "root", "db", "smtp", "ldap", "mysql", "pg", "redis", "login")
_ADDRESS = re.compile(r"://[^\s:/@\"'`<>]*:(?P<value>[^\s/@\"'`<>]+)@[\w\[]")
_URL_END = re.compile(r"[^\s\"'`<>]*")
_SIGNED = re.compile(r"[?&;](?:sig|signature|x-amz-signature|x-goog-signature|token|access_token|auth|key|api_?key|secret)=(?P<value>[A-Za-z0-9%+/_=.~-]{12,})", re.I)
_HEADER = re.compile(r"\b(?:authorization|proxy-authorization|x-auth-token|x-api-key|cookie)\b[\"']?\]?[ \t]*(?:[:=,]|=>)[ \t]*[\"'`]?(?:(?:bearer|basic|token|apikey|digest)[ \t]+)?(?P<value>[A-Za-z0-9+/=._~-]{8,})", re.I)
_BEARER = re.compile(r"\b(?:Bearer|Basic)[ \t]+(?P<value>[A-Za-z0-9+/=._~-]{12,})")
#: The well-known prefixes of issued tokens.
_PREFIXED = re.compile(
    r"(?<![A-Za-z0-9_/+-])(?P<value>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abprs]-[\w-]{10,}"
    r"|AIza[\w-]{30,}|npm_[A-Za-z0-9]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|SG\.[\w-]{16,}\.[\w-]{16,}|pypi-[\w-]{16,}|hf_[A-Za-z0-9]{20,}"
    r"|dop_v1_[a-f0-9]{32,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}|AGE-SECRET-KEY-[A-Z0-9]{30,}|sq0csp-[\w-]{20,}|shpat_[a-f0-9]{20,})(?![A-Za-z0-9_/+])"
)
_KEY_HEADER = r"(?:Proc-Type|DEK-Info|Version|Comment):[^\n]*"
_KEY_BETWEEN = rf"\\[nr]|[\s\"'`+,*#/\\.;()|>-]|{_KEY_HEADER}"
#: Lines of 16 and more characters and, up to the END mark, whatever is left of the key.
_KEY_BLOCK = re.compile(
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
    rf"(?P<value>(?:(?:{_KEY_BETWEEN})*[A-Za-z0-9+/=]{{16,}})+(?:(?:(?!-----END)(?:{_KEY_BETWEEN}|[A-Za-z0-9+/=]))*+(?=-----END))?)"
)
_KEY_TEXT = re.compile(r"(?:(?<=\\[nr])|(?<![\\A-Za-z0-9+/=]))[A-Za-z0-9+/=]+")
_KEY_HEADERS = re.compile(_KEY_HEADER)


def _key_parts(text: str) -> list[tuple[int, int]]:
    """Spans of a key's text, headers and what holds the lines together left out."""
    headers = [m.span() for m in _KEY_HEADERS.finditer(text)]
    runs = [m.span() for m in _KEY_TEXT.finditer(text)]
    return [(a, b) for a, b in runs if b - a >= 16 or any(map(str.isalnum, text[a:b])) and not any(x <= a < y for x, y in headers)]


#: Words that may begin a credential's context, by the rules that are then tried. Found in one pass over a lowered text.
_WORDS = {
    "name": ["password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "credential", "bearer", "key", "pass", "pw", "auth", "kennwort", "passwort", "contrase", "motdepasse", "mot_de_passe", "senha", "wachtwoord"],
    "header": ["authorization", "x-auth-token", "x-api-key", "cookie"],
    "scheme": ["bearer ", "basic "],
    "login": ["login", " -u ", "--user "],
    "url": ["://"],
    "prefix": ["akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "aiza", "npm_", "sk_", "rk_", "sg.", "pypi-", "hf_", "dop_v1_", "eyj", "age-secret", "sq0csp", "shpat_"],
}


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in _WORDS.items():
        for w in words:
            kinds, size = a.get(w, ((), len(w)))
            a.add_word(w, (kinds + (kind,), size))
    a.make_automaton()
    return a


_PLACEHOLDER = re.compile(
    r"^(?:x+|\*+|\.+|-+|_+|#+|0+|1234567?8?9?0?|\?+)$|change_?me|replace_?(?:me|this)|^your|your[_-]|<[^>]*>|\$\{|\$\(|\{\{|\}\}|^%\(|^\$[A-Za-z_]|^%[A-Za-z_]+%$|^env[:.(]|example|placeholder"
    r"|dummy|sample[_-]|to_?do|fixme|^none$|^null$|^true$|^false$|^nil$|redacted|hidden|masked|insert[_-]|^todo|^n/?a$|not[_-]?set|^undefined$|^(?:password|passwd|secret|token|bearer|basic|test|admin|root|user)\d{0,1}$",
    re.I,
)
_UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)
_NO_SECRET_NAME = re.compile(r"(?:_|\.|-|^)(?:name|field|type|size|count|limit|length|total|index|position|status|state|label|url|uri|path|file|hash|digest|checksum|sha\d*|md5|algorithm|id|header|kind|format|expiry|ttl|version)s?$|(?:Name|Field|Type|Size|Count|Limit|Length|Total|Index|Position|Status|State|Label|Url|Path|File|Hash|Digest|Checksum|Header|Kind|Format|Expiry|Ttl|Version)$", re.I)
_CALL = re.compile(r"^[A-Za-z_][\w.:]*\(|^[A-Za-z_]\w*(?:\.[A-Za-z_]+)+$|^[A-Za-z_]\w*\[")
CONFIGURATION = ("ini", "env", "yaml", "yml", "json", "properties", "toml", "cfg", "conf", "txt")


#: Names whose whole value is a password, also where it is a natural word.
_PASSWORD_NAME = re.compile(r"(?:password|passwd|passphrase|passcode|pwd|passwort|kennwort|contrase(?:n|ñ)a|mot_?de_?passe|senha|wachtwoord)\d*$", re.I)
_AUTH_NAME = re.compile(r"auth(?:_?(?:value|code|data|string))?$", re.I)
#: A text about passwords, or one that is filled in.
_SPEAKS = re.compile(r"pass|pwd|secret|token|key|enter|must|wrong|invalid|required|prompt|contrase|kennwort|%[sd]|[{}<>$]|\.\w+\.|://", re.I)
_STRING = re.compile(_LITERAL)
#: Calls that sign in; what comes after the user's name is the password.
_SIGN_IN = re.compile(r"log_?(?:in|on)|sign_?(?:in|on)|session|connect|\bauth(?:enticate|orize)?\b|credential|bind|dial", re.I)
_NO_PASSWORD = re.compile(r"[\s/\\<>]|^[\w.-]+@[\w-]+(?:\.[\w-]+)+$|^v?\d+(?:[.:_-]\d+)*$|^[\w-]+(?:\.[\w-]+)*\.(?:com|net|org|io|test|example|local|internal)(?::\d+)?$", re.I)


def characters_per_subword(value: str, folder: str = TOKENIZER_DIR) -> float:
    return len(value) / max(1, len(encoder(folder).encode_ordinary(value)))


def _bound(value: str) -> float:
    """Under how many characters per subword a value is unnatural."""
    if value.isalpha() and (value.islower() or value.istitle()):
        return UNNATURAL_WORD
    return UNNATURAL_MIXED if any(map(str.isdigit, value)) and any(map(str.isalpha, value)) else UNNATURAL


def _unnatural(value: str, folder: str) -> bool:
    return characters_per_subword(value, folder) < UNNATURAL


def nominate(text: str, folder: str = TOKENIZER_DIR) -> list[tuple[int, int]]:
    """Spans of the quoted literals of six and more characters that are unnatural, in order."""
    found, known = [], {}
    for m in _STRING.finditer(text):
        a, b = m.start() + 1, m.end() - 1
        if b - a < 6:
            continue
        value = text[a:b]
        if value not in known:
            known[value] = characters_per_subword(value, folder) < _bound(value)
        if known[value]:
            found.append((a, b))
    return found


def _secret_value(value: str, folder: str) -> bool:
    """An unnatural value given to a secret's name."""
    if len(value) < 6 or " " in value.strip() or value.isdigit() or _PLACEHOLDER.search(value) or _UUID.match(value):
        return False
    if "://" in value:
        return False  # an address is judged by its own rule
    return characters_per_subword(value, folder) < _bound(value)


def _plain_password(name: str, value: str) -> bool:
    """A natural word or number, or a phrase, as the whole value of a password's name."""
    if not _PASSWORD_NAME.search(name) or len(value) < 6 or _PLACEHOLDER.search(value) or _SPEAKS.search(value):
        return False
    phrase = " " in value
    return value == value.strip() and value.isprintable() and (not phrase or "phrase" in name.lower() or any(map(str.isdigit, value)))


def _signs_in(text: str, a: int, b: int) -> bool:
    """The literal is the last argument but not the first of a call that signs in, or of a pair given to "auth"."""
    value = text[a:b]
    if not any(map(str.isalpha, value)) or not any(c.isdigit() or c in "!#$%&*+=?^~" for c in value) or _NO_PASSWORD.search(value) or _PLACEHOLDER.search(value) or _UUID.match(value):
        return False
    k = b + 1
    while k < len(text) and text[k].isspace():
        k += 1
    if text[k : k + 1] != ")":
        return False
    k, commas = a - 2, 0
    while k >= 0 and (text[k].isalnum() or text[k] in "_.,\"'- \t\n\r@:/*&"):
        commas += text[k] == ","
        k -= 1
    if not commas or k < 0 or text[k] != "(":
        return False
    end = k
    while k > 0 and (text[k - 1].isalnum() or text[k - 1] in "_= \t"):
        k -= 1
    return bool(_SIGN_IN.search(text, k, end))


def _spans_of_literals(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [(start + m.start() + 1, start + m.end() - 1) for m in re.finditer(_LITERAL, text[start:end])]


def find(text: str | None, configuration: bool, folder: str = TOKENIZER_DIR) -> list[tuple[int, int, str]]:
    """(start, end, rule) of what must be masked, by offset, not overlapping; only the first span of a credential has
    a rule without '+'."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    keys: list[tuple[int, int]] = []
    if "PRIVATE KEY" in text:
        for m in _KEY_BLOCK.finditer(text):
            parts = [(m.start("value") + a, m.start("value") + b) for a, b in _key_parts(m["value"])]
            if parts and not _PLACEHOLDER.search(m["value"]):
                keys.append((m.start(), m.end()))
                found.append((m.start(), m.start(), "private_key"))
                found += [(a, b, "private_key+") for a, b in parts]
    taken: list[tuple[int, int]] = sorted(keys)  # spans that do not overlap

    def add(a: int, b: int, rule: str) -> None:
        k = bisect(taken, (a, b))
        if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or taken[k][0] >= b):
            taken.insert(k, (a, b))
            found.append((a, b, rule))

    for a, b in nominate(text, folder):
        if _signs_in(text, a, b):
            add(a, b, "sign_in")

    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_LOWER)
    for last, (kinds, size) in _automaton().iter(low):
        start, end = last + 1 - size, last + 1
        for kind in kinds:
            _TRY[kind](text, low, start, end, configuration, folder, add)
    found.sort()
    return found


_LOWER = {c: c + 32 for c in range(65, 91)}


def _try_prefix(text, low, start, end, configuration, folder, add):
    m = _PREFIXED.match(text, start)
    if m and _unnatural(m["value"], folder):
        add(*m.span("value"), "prefix")


def _try_url(text, low, start, end, configuration, folder, add):
    m = _ADDRESS.match(text, start)
    if m and not _PLACEHOLDER.search(m["value"]) and not m["value"].startswith(("$", "{", "%")):
        add(*m.span("value"), "address")
    stop = _URL_END.match(text, end).end()
    if "=" in text[end:stop]:
        for m in _SIGNED.finditer(text, end, stop):
            if not _PLACEHOLDER.search(m["value"]) and _unnatural(m["value"], folder):
                add(*m.span("value"), "signed_link")


def _try_header(text, low, start, end, configuration, folder, add):
    m = _HEADER.match(text, start)
    if m and not _PLACEHOLDER.search(m["value"]) and not m["value"].isalpha() and _unnatural(m["value"], folder):
        add(*m.span("value"), "header")


def _try_scheme(text, low, start, end, configuration, folder, add):
    m = _BEARER.match(text, start)
    if m and not _PLACEHOLDER.search(m["value"]) and _unnatural(m["value"], folder):
        add(*m.span("value"), "header")


def _try_login(text, low, start, end, configuration, folder, add):
    """user / password after the word login, or the user:password option of a command."""
    m = (_USER_OPTION if low[start] in " -" else _LOGIN).match(text, end)
    if m:
        value = m["value"].rstrip(".,;)")
        if _secret_value(value, folder):
            add(m.start("value"), m.start("value") + len(value), "login")


def _try_name(text, low, start, end, configuration, folder, add):
    word = low[start:end]
    before = start
    while before and low[before - 1] in "_.-":
        before -= 1
    if word == "key" and not low.endswith(_KEYS, 0, before):
        return
    alone = False
    if word in ("pass", "pw") and not low.endswith(_PASS, 0, before):
        alone = not low[start - 1 : start].isalnum() and not low[end : end + 1].isalnum()
        if not alone:
            return
    m = _ASSIGNED.match(text, end) if not alone else None
    if m:
        if m["by"] == "==" or m["by"] == "," and not m["quote"]:
            return
        literals = _spans_of_literals(text, *m.span("value"))
        whole = "".join(text[a:b] for a, b in literals)
        name = _name(text, start, m)
        if word == "auth" and not _AUTH_NAME.search(name):
            return
        if _secret_value(whole, folder) and _named(name, whole) or m["by"] != "," and _plain_password(name, whole):
            for k, (a, b) in enumerate(literals):
                add(a, b, "+" * bool(k) or "assignment")
        return
    if word == "auth":
        return
    if not configuration and text[end : end + 1] not in (" ", ":", "="):
        return
    begin = text.rfind("\n", 0, start) + 1
    if configuration and not alone:
        m = _SETTING.match(text, end)
        if m and text[begin:start].strip("-#;/ \t").replace("export ", "").replace(".", "").replace("_", "").replace("-", "").isalnum() | (not text[begin:start].strip("-#;/ \t")):
            value = m["value"].rstrip(" \t\r,")
            if not _CALL.search(value) and _secret_value(value, folder) and _named(_name(text, start, m), value):
                add(m.start("value"), m.start("value") + len(value), "assignment")
                return
    if _COMMENT.match(text, begin, start + 1):
        m = _COMMENTED.match(text, end)
        if m:
            value = m["value"].rstrip(".,;)")
            strict = not m["by"] and (value.isalnum() and not any(map(str.isdigit, value)) or len(value) < 8)
            if not strict and not _CALL.search(value) and _secret_value(value, folder) and any(not c.isalpha() for c in value):
                add(m.start("value"), m.start("value") + len(value), "comment")


def _name(text: str, start: int, m: re.Match) -> str:
    """The whole name in which the secret's word stands."""
    k = start
    while k and (text[k - 1].isalnum() or text[k - 1] in "_.$-"):
        k -= 1
    before = text[k:start]
    after = re.match(r"[\w.-]*", text[start : m.start("by")])[0]
    return before + after


_TRY = {"name": _try_name, "header": _try_header, "scheme": _try_scheme, "login": _try_login, "url": _try_url, "prefix": _try_prefix}


def _named(name: str, value: str) -> bool:
    """Names of sizes, types and the like hold no secret, unless the value is long and random."""
    return not _NO_SECRET_NAME.search(name) or len(value) >= 16


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Same length, same lines; only what lies in the spans becomes MASK."""
    parts, at = [], 0
    for a, b, _ in spans:
        if b <= at:
            continue
        a = max(a, at)
        parts += [text[at:a], MASK * (b - a)]
        at = b
    return "".join(parts) + text[at:]


def scan(rows: DataFrame, origin: str, row_id: str, path: str, text: str, folder: str = TOKENIZER_DIR, redact: bool = False) -> DataFrame:
    """origin, row_id, line_no, rule, start_offset, end_offset; with ``redact``: origin, row_id, credentials, redacted (rows
    with at least one credential)."""
    picked = rows.select(F.col(row_id).cast("bigint").alias("row_id"), F.lower(F.regexp_extract(F.coalesce(F.col(path), F.lit("")), r"\.([^./\\]+)$", 1)).isin(*CONFIGURATION).alias("conf"), F.col(text).alias("text"))
    picked = picked.where("text IS NOT NULL AND text <> ''")

    def places():
        def one(row_id, conf, text):
            seen, out, at, line = set(), [], 0, 1
            for a, b, rule in find(text, conf, folder):
                if "+" in rule:
                    continue
                line += text.count("\n", at, a)
                at = a
                if line not in seen:
                    seen.add(line)
                    out.append((origin, row_id, line, rule, a, b))
            return out

        return one

    def masked():
        def one(row_id, conf, text):
            spans = find(text, conf, folder)
            return [(origin, row_id, sum("+" not in r for *_, r in spans), mask(text, spans))] if spans else []

        return one

    if redact:
        return map_rows(picked, masked, "origin string, row_id bigint, credentials int, redacted string")
    return map_rows(picked, places, "origin string, row_id bigint, line_no int, rule string, start_offset int, end_offset int")


def scan_all(files: DataFrame, chunks: DataFrame, folder: str = TOKENIZER_DIR, redact: bool = False) -> DataFrame:
    a = scan(files, "source_files", "file_id", "rel_path", "content", folder, redact)
    return a.unionByName(scan(chunks, "chunks", "chunk_seq", "file_path", "code", folder, redact))
