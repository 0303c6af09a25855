"""Credentials in source lines: find each secret value and replace it by a placeholder of its own shape.

A keyword automaton decides which patterns a line is searched by: what every match of a pattern must hold is found
in one pass, and patterns without a keyword in the line are left out, which changes no result (``_spans`` with
``every`` says so).  Values in issuers' formats are matched anywhere and their structure is checked; other values count
by their place: an assignment to a secret's name, a URL's or connection string's password, an authorization scheme, a login call, a command-line flag, a comment that
hands over a login.  Every candidate value must look like a value: lookups, prompts, placeholders, masked
values, names and digests with a prefix don't.  A value split into adjoining literals is put together first.
"""

from __future__ import annotations

import base64
import bisect
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Token formats of issuers.
ISSUERS = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{36}"), ("github_pat", r"github_pat_[A-Za-z0-9_]{60,90}"), ("gitlab", r"glpat-[A-Za-z0-9_-]{20}"),
    ("slack", r"xox[abeoprs]-(?:\d{8,14}-){1,3}[A-Za-z0-9]{16,48}"), ("aws", r"(?:AKIA|ASIA)[A-Z0-9]{16}"), ("google", r"AIza[A-Za-z0-9_-]{35}"),
    ("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]{20,64}"), ("npm", r"npm_[A-Za-z0-9]{36}"), ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{16,}"),
    ("sendgrid", r"SG\.[A-Za-z0-9_-]{20,24}\.[A-Za-z0-9_-]{39,50}"), ("pypi", r"pypi-[A-Za-z0-9_-]{50,}"), ("hub", r"hf_[A-Za-z0-9]{34}"),
)

# Endings of names (lower case, separators left out) whose values are secrets, and words that say otherwise.
NAME_ENDS = (
    "password", "passwd", "pwd", "passphrase", "passcode", "senha", "contrasena", "contraseña", "clave", "secret", "token", "bearer", "credential", "credentials",
    "apikey", "accesskey", "deploykey", "signingkey", "encryptionkey", "hmackey", "authkey", "accountkey", "privatekey", "secretkey", "masterkey", "sharedkey", "storagekey",
    "chaveapi", "llaveapi", "apichave", "apillave", "userpass", "dbpass", "smtppass", "adminpw", "chavesecreta", "llavesecreta",
)
NAME_LAST_WORDS = ("pass", "pw", "pwd", "psw")
NAME_NEGATIVE = frozenset("hint label placeholder header headers env public csrf xsrf dummy".split())

# What every match of a pattern holds, in lower case.  Names are looked for in the line's letters alone, so
# that separators and digits within them don't matter.
NEEDS = {
    "pem": ("-----begin",), "userinfo": ("://", "@tcp(", "@unix("), "scheme": ("bearer", "basic", "token"), "sql": ("password", "identified"), "curl": ("-u",), "noted": ("value",),
    "issuer": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "akia", "asia", "aiza", "k_live_", "k_test_", "npm_", "eyj", "sg.", "pypi-", "hf_"),
    "prefixed": ("_", "-"), "flag": ("sshpass", "docker", "mysql", "pass", "token", "api", "secret"), "handover": ("svc_", "_bot", "admin", "root", "user"), "comment": ("//", "#", "/*", "--", ";", "%"),
    "fallback": ("or", "||", "??"), "user": ("svc_", "_bot", "admin", "root", "postgres", "_user", "_svc", '"sa"', "'sa'", "`sa`"),
    "call": ("pass", "token", "secret", "api", "credential", "auth", "login", "log_in", "signin", "pdo", "connect"),
}

_EDGE, _END = r"(?<![A-Za-z0-9_-])", r"(?![A-Za-z0-9_-])"
_ISSUER = re.compile(_EDGE + "(?:" + "|".join(f"(?P<{n}>{p})" for n, p in ISSUERS) + ")" + _END)
#: Tokens of other issuers: a short prefix, a separator and a long random body.
_PREFIXED_TOKEN = re.compile(_EDGE + r"[A-Za-z]{2,8}[_-](?P<body>[A-Za-z0-9]{6,}(?:[._-][A-Za-z0-9]{6,})*)" + _END)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
_PEM_BODY = re.compile(r"(?:\\[nr]|\s|[\"'+.])*[A-Za-z0-9+/=]{16,}")
_JOIN = re.compile(r"([\"'`])\s*(?:\+|\.{1,2}|&)\s*([\"'`])")

_Q = r"(?:\"(?P<d>(?:[^\"\\]|\\.)*)\"|'(?P<s>(?:[^'\\]|\\.)*)'|`(?P<b>[^`]*)`)"
_BARE = r"(?P<w>[^\s\"'`,;(){}\[\]<>|]+)(?![^\s\"'`,;){}\]<>|])"
_NAMED = re.compile(
    r"(?<![\w$-])(?P<name>[A-Za-zÀ-ÿ_$][\wÀ-ÿ$-]*)(?:[\"'`\]]{0,2})"
    r"(?:\s*:\s*(?:str|string|String|\w*String))?"
    r"(?:\s*(?::=|=>|=|:)\s*|\s+(?=[\"'])|[\"']\s*,\s*(?:(?:use)?[Vv]alue\s*[:=]\s*)?|\s*,\s*useValue\s*:\s*|\"\s+value=|[\"']?>)"
    rf"(?:{_Q}|{_BARE})"
)
_USERINFO = re.compile(r"(?<![a-zA-Z0-9+.-])[a-zA-Z][a-zA-Z0-9+.-]{0,30}://[^\s:/@\"'`]*:(?P<v>[^\s@\"'`/]+)@|[\"'\s]\w+:(?P<v2>[^\s@\"'`/]+)@(?:tcp|unix)\(")
_SCHEME = re.compile(r"(?i)\b(?P<scheme>bearer|basic|token)\s+(?P<v>[A-Za-z0-9._~+/=-]{8,})")
_CALLS = re.compile(r"(?i)(?:set_?(?:password|passwd|pass|token|secret|api_?key|credentials?)|(?:basic|digest)_?auth\w*|login|log_in|signin|authenticate|passwordauthentication|getconnection|credentials?|pdo|connect)\s*\(")
_SQL = re.compile(rf"(?i)\b(?:password|identified\s+by)\s+{_Q}")
_FLAG = re.compile(rf"(?i)(?:\bsshpass\s+-p\s*|\bdocker\s+login\b.*?\s-p\s+|\bmysql\b.*?\s-p|--?(?:password|passwd|pass|token|api-?key|secret)(?:\s+|=))(?:{_Q}|{_BARE})")
_CURL_USER = re.compile(rf"(?:\s-u|--user)\s*[\"']?[\w.@-]+:(?P<v>[^\s\"'`]+)")
_NOTED = re.compile(rf"\bvalue\s*[:=]\s*{_Q}\s*,?\s*(?:#|//)[^\n]*\b(?:token|secret|password|api[_ ]?key|credential|senha|clave)\b", re.I)
_HANDOVER = re.compile(r"(?i)\b(?:svc_\w+|\w+_bot|admin|root|user\w*)\s*/\s*(?P<v>[^\s\"'`/]{6,})")
_COMMENT = re.compile(r"(?m)(?:^|\s)(?://|#|/\*|--|<!--|;|%)\s*.*?[:=]\s*(?P<v>[A-Za-z0-9+/=_.~-]{12,})\s*(?:\*/|-->)?\s*$")
_FALLBACK = re.compile(rf"(?:\bor\b|\|\||\?\?)\s*{_Q}")
_QUOTED = re.compile(_Q)
_USER = re.compile(r"(?i)^(?:svc_\w+|\w+_bot|admin|root|sa|postgres|[a-z]+_(?:user|svc))$")

_PLACEHOLDER = re.compile(
    r"(?i)^(?:<.*>|\$\{.*|\$\(.*|\{\{.*|%\w+%|\$\w+|\{\w*\}?|\[.*\]|x+|\*+|\.+|-+|_+|•+|#+|0+|none|null|nil|undefined|true|false|required|optional|password|passwd|secret|token|key|string|text|hidden|redacted|masked|changed?|n/a)$"
    r"|change[-_ ]?(?:me|it|this)|replace[-_ ]?(?:me|with|this)|your[-_ ]|[-_ ]your[-_ ]|\bexample\b|placeholder|dummy|redacted|\btodo\b|insert[-_ ]|set[-_]in[-_]|goes[-_ ]here|\.\.\.|…|\*{3,}|x{8,}|X{8,}|\$\{|\{\{"
)
_NAMELIKE = re.compile(r"^(?:[A-Za-z]+(?:[._:][A-Za-z]+)+|[A-Z]+[0-9]*(?:_[A-Z]+[0-9]*)+|X-[\w-]+|[a-z]+(?:-[a-z]+){0,2})$")
_PREFIXED = re.compile(r"^(?:sha\d{1,3}[-:=]|h1:|W/|pub:|md5[-:]|ssh-|https?:|/[a-z_.-]+/|\.{1,2}/|data:)")
_HEX = re.compile(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12})$")


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def classes(value: str) -> int:
    return sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))


@lru_cache(65_536)
def secret_name(name: str) -> bool:
    words = [w.lower() for w in re.findall(r"[A-ZÀ-Þ]+(?![a-zß-ÿ])|[A-ZÀ-Þ]?[a-zß-ÿ]+|\d+", name)]
    if not words or NAME_NEGATIVE.intersection(words):
        return False
    return "".join(w for w in words if not w.isdigit()).endswith(NAME_ENDS) or words[-1] in NAME_LAST_WORDS


def namelike(value: str) -> bool:
    """A word or an identifier, not a value.  Letters alone count as words unless their case jumps about."""
    if value.isalpha():
        turns = sum(a.isupper() != b.isupper() for a, b in zip(value, value[1:], strict=False))
        return len(value) < 12 or turns < 0.25 * len(value)
    return bool(_NAMELIKE.match(value))


#: Shorter values are words or placeholders too often (a parameter of what counts as a value).
LEAST = 6


def plausible(value: str) -> bool:
    """Whether a literal can be a secret written out at all."""
    return len(value) >= LEAST and not re.search(r"\s", value) and len(set(value)) > 3 and not _PLACEHOLDER.search(value) and not _PREFIXED.match(value)


def literal_secret(value: str) -> bool:
    """A quoted value under a secret's name."""
    return plausible(value) and not namelike(value)


def bare_secret(value: str) -> bool:
    """An unquoted value under a secret's name: words, calls and paths of names are code, not values."""
    if not literal_secret(value):
        return False
    if re.match(r"^[a-z]+(?:-[a-z]+){3,}$", value):
        return True
    if value[0] in "$@&*" or re.match(r"^\d[\d.]*\w?$", value):
        return False
    if re.match(r"^[A-Za-z_]\w*(?:(?:\.|->|::)[A-Za-z_]\w*)*$", value) and re.search(r"[._>:]", value):
        return classes(value) == 4
    return classes(value) >= 2 and bool(re.search(r"\d", value)) or classes(value) >= 3 and bool(re.search(r"[!%+#^~*@&/=]", value))


def random_value(value: str) -> bool:
    """Looks drawn at random even without a name: long, mixed, not a digest or an id."""
    return len(value) >= 12 and plausible(value) and not namelike(value) and not _HEX.match(value) and re.search(r"[a-z]", value) is not None and re.search(r"[A-Z]", value) is not None and entropy(value) > 3.2


def password_value(value: str) -> bool:
    """Looks like a password a person or a generator made."""
    return plausible(value) and not namelike(value) and not _HEX.match(value) and (classes(value) >= 3 or (classes(value) == 2 and len(value) >= 10 and not value.isalpha() and value.isalnum()) or bool(re.match(r"^[a-z]+(?:-[a-z]+){3,}$", value)))


def issuer_valid(kind: str, value: str) -> bool:
    """Structure of an issuer's value; a run of one letter is a placeholder."""
    body = re.sub(r"^[A-Za-z]+[-_]", "", value)
    if len(set(body)) < 6 or re.search(r"(?i)example|x{8,}", value):
        return False
    if kind == "jwt":
        head = value.split(".")[0]
        try:
            return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        except ValueError:
            return False
    return True


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum_holds(kind: str, value: str) -> bool | None:
    """Whether an issuer's published checksum holds; None for issuers without one.

    Tokens of the two code forges' kinds end with the CRC-32 of their random part in six digits to the base 62.  It is
    reported, not required: a mistyped or shortened secret is still to be redacted.
    """
    if kind not in ("github", "npm"):
        return None
    body = value.split("_", 1)[1]
    number, digits = zlib.crc32(body[:-6].encode()), ""
    while number:
        number, k = divmod(number, 62)
        digits = _BASE62[k] + digits
    return body[-6:] == digits.rjust(6, "0")


def token_like(m: re.Match) -> bool:
    """A prefixed token: 20 characters or more that look drawn at random, digits and capitals among them, under a prefix that names nothing public."""
    body = m.group("body")
    flat = re.sub(r"[._-]", "", body)
    drawn = len(flat) >= 20 and re.search(r"\d", flat) is not None and re.search(r"[A-Z]", flat) is not None and entropy(flat) > 3.4
    return drawn and plausible(body) and not _HEX.match(body) and not re.match(r"(?i)(?:pk|pub\w*|sha\d*|md|id|uid|uuid|rev|ref|build|etag|hash)[_-]", m.group())


def _group(m: re.Match) -> tuple[int, int] | None:
    for g in ("d", "s", "b"):
        if m.group(g) is not None:
            return m.span(g)
    return None


@lru_cache(1)
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    groups: dict[str, list[str]] = {}
    for group, words in NEEDS.items():
        for w in words:
            groups.setdefault(w, []).append(group)
    places, names = ahocorasick.Automaton(), ahocorasick.Automaton()
    for w, gs in groups.items():
        places.add_word(w, tuple(gs))
    for w in (*NAME_ENDS, *NAME_LAST_WORDS):
        names.add_word(w, True)
    places.make_automaton()
    names.make_automaton()
    return places, names


# Letters that case-blind patterns take for Latin ones.
_FOLDED = str.maketrans({"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"})
_NO_LETTERS = re.compile(r"[^A-Za-zÀ-ÿ]+")


def needed(line: str) -> set[str]:
    """The patterns whose keywords a line holds."""
    places, names = _automata()
    low = line.lower() if line.isascii() else line.translate(_FOLDED).lower()
    out: set[str] = set()
    for _, groups in places.iter(low):
        out.update(groups)
    if next(names.iter(_NO_LETTERS.sub("", line).lower()), None):
        out.add("named")
    return out


def _spans(line: str, every: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, kind) of secret values in a line whose split literals are joined; with ``every`` all patterns are tried."""
    found: dict[int, tuple[int, str]] = {}
    starts: list[int] = []
    want = {*NEEDS, "named"} if every else needed(line)

    def matches(group: str, pattern: re.Pattern) -> Iterator[re.Match]:
        return pattern.finditer(line) if group in want else iter(())

    def add(a: int, b: int, kind: str) -> None:
        n = bisect.bisect_left(starts, a)
        if a < b and (n == 0 or found[starts[n - 1]][0] <= a) and (n == len(starts) or b <= starts[n]):
            found[a] = (b, kind)
            starts.insert(n, a)

    for m in matches("pem", _PEM):
        body = _PEM_BODY.match(line, m.end())
        if body or not line[m.end() :].strip():
            end = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----").search(line, m.end())
            add(m.start(), end.end() if end else (body.end() if body else m.end()), "private_key")
    for m in matches("issuer", _ISSUER):
        if issuer_valid(m.lastgroup, m.group()):
            add(m.start(), m.end(), m.lastgroup)
    for m in matches("prefixed", _PREFIXED_TOKEN):
        if token_like(m):
            add(m.start(), m.end(), "token")
    for m in matches("userinfo", _USERINFO):
        g = "v" if m.group("v") is not None else "v2"
        if plausible(m.group(g)) and not re.match(r"^[a-z]+$", m.group(g)):
            add(*m.span(g), "url_password")
    for m in matches("scheme", _SCHEME):
        v = m.group("v")
        if plausible(v) and not namelike(v) and (len(v) >= 16 or classes(v) >= 3) and (re.search(r"\d", v) or m.group("scheme").lower() == "basic" or v.isalpha()):
            add(*m.span("v"), "authorization")
    at = 0
    while "named" in want and (m := _NAMED.search(line, at)):
        at = m.end("name")
        if not secret_name(m.group("name")):
            continue
        span = _group(m)
        if span:
            if literal_secret(line[slice(*span)]):
                add(*span, "named")
        elif bare_secret(m.group("w").rstrip(".:")) and line[m.end("w") : m.end("w") + 1] not in ("(", "[", "{"):
            add(m.start("w"), m.start("w") + len(m.group("w").rstrip(".:")), "named")
    for m in matches("sql", _SQL):
        span = _group(m)
        if literal_secret(line[slice(*span)]):
            add(*span, "sql")
    for m in matches("flag", _FLAG):
        span = _group(m) or m.span("w")
        if password_value(line[slice(*span)]) or random_value(line[slice(*span)]):
            add(*span, "flag")
    for m in matches("curl", _CURL_USER):
        if password_value(m.group("v")):
            add(*m.span("v"), "flag")
    for m in matches("handover", _HANDOVER):
        if password_value(m.group("v")):
            add(*m.span("v"), "comment")
    for m in matches("comment", _COMMENT):
        before = line[m.start() : m.start("v")]
        if re.match(r"^[\w-]+(?:/[\w-]+)+\.\w+$", m.group("v")):
            continue
        handed = re.search(r"(?i)\b(?:key|token|secret|credential)s?\b|\b(?:remove|delete|rotate|revoke)\b|\U0001f511", before)
        if random_value(m.group("v")) and len(m.group("v")) >= 16 or handed and _HEX.match(m.group("v")) or password_value(m.group("v")) and re.search(r"(?i)pass|pw|login|senha|contrase|clave", before):
            add(*m.span("v"), "comment")
    for m in matches("noted", _NOTED):
        span = _group(m)
        if literal_secret(line[slice(*span)]):
            add(*span, "noted")
    for m in matches("fallback", _FALLBACK):
        span = _group(m)
        v = line[slice(*span)]
        if len(v) >= 16 and (random_value(v) or (_HEX.match(v) and plausible(v))):
            add(*span, "fallback")
    quoted = [(m, _group(m)) for m in _QUOTED.finditer(line)] if want & {"user", "call"} else []
    for n, (m, span) in enumerate(quoted):
        if "user" in want and _USER.match(line[slice(*span)]):
            # what follows a user name in the same argument list is its password or key
            for (p, _), (q, nxt) in zip(quoted[n:], quoted[n + 1 :], strict=False):
                if not re.fullmatch(r"\s*,\s*", line[p.end() : q.start()]):
                    break
                v = line[slice(*nxt)]
                if literal_secret(v) and (password_value(v) or random_value(v) or _HEX.match(v)):
                    add(*nxt, "call")
    for m in matches("call", _CALLS):
        args = [(q, s) for q, s in quoted if q.start() >= m.end()][:3]
        if args and re.fullmatch(r"\s*(?:[$\w.]+\s*,\s*){0,2}", line[m.end() : args[0][0].start()]):
            first = line[slice(*args[0][1])]
            setter = m.group().lower().startswith("set")
            if password_value(first) or (setter and literal_secret(first)):
                add(*args[0][1], "call")
            elif len(args) > 1 and re.fullmatch(r"\s*,\s*", line[args[0][0].end() : args[1][0].start()]) and password_value(line[slice(*args[1][1])]):
                add(*args[1][1], "call")
    return sorted((a, b, k) for a, (b, k) in found.items())


def find_secrets(line: str) -> list[tuple[list[tuple[int, int]], str]]:
    """Secret values of a line, each as its pieces' (start, end) in the line, and its kind."""
    cuts, at, text = [], 0, []
    for m in _JOIN.finditer(line):
        if m.group(1) == m.group(2):
            cuts.append((m.start(), m.end()))
            text.append(line[at : m.start()])
            at = m.end()
    if not cuts:
        return [([(a, b)], k) for a, b, k in _spans(line)]
    joined = "".join([*text, line[at:]])
    out = []
    for a, b, k in _spans(joined):
        parts, shift, left = [], 0, a
        for x, y in cuts:
            if x - shift <= left:
                shift += y - x
                continue
            if x - shift >= b:
                break
            parts.append((left + shift, x))
            left = x - shift
            shift += y - x
        parts.append((left + shift, b + shift))
        out.append((parts, k))
    return out


def placeholder(value: str) -> str:
    """Same length, same alphabet: letters keep their case, digits stay digits, signs stay."""
    return re.sub(r"[0-9]", "0", re.sub(r"[a-z]", "x", re.sub(r"[A-Z]", "X", value)))


def redact(line: str, found: list[tuple[list[tuple[int, int]], str]]) -> str:
    out, at = [], 0
    for a, b, kind in sorted((a, b, kind) for pieces, kind in found for a, b in pieces):
        body = line[a:b]
        out += [line[at:a], re.sub(r"[A-Za-z0-9+/=]{16,}", lambda m: placeholder(m.group()), body) if kind == "private_key" else placeholder(body)]
        at = b
    return "".join([*out, line[at:]])


def secret_value(name: str | None, value: str) -> bool:
    """Whether a stored value is a secret written out, given the name it was assigned to."""
    if (m := _ISSUER.fullmatch(value)) and issuer_valid(m.lastgroup, value):
        return True
    if (m := _PREFIXED_TOKEN.fullmatch(value)) and token_like(m):
        return True
    return name is not None and secret_name(name) and literal_secret(value)


#: Distinct lines whose findings a worker keeps, and the longest line it keeps.
KEPT_LINES, KEPT_CHARS = 50_000, 1_000


def _find_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = lru_cache(KEPT_LINES)(find_secrets)
    for b in batches:
        rows = []
        for field, row_id, name, text in zip(*[b.column(n).to_pylist() for n in range(4)], strict=True):
            if field.endswith("secret_value"):
                if not secret_value(name, text):
                    inner = find_secrets(text) if "://" in text or "-----BEGIN" in text else []
                else:
                    inner = [([(0, len(text))], "value")]
            else:
                inner = kept(text) if len(text) <= KEPT_CHARS else find_secrets(text)
            if inner:
                clean = redact(text, inner)
                rows += [(field, row_id, pieces[0][0] + 1, kind, clean, checksum_holds(kind, "".join(text[a:b] for a, b in pieces))) for pieces, kind in inner]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_()), strict=True)], names=["field_name", "row_id", "start_pos", "kind", "redacted", "checksum_holds"])


def credentials(fields: list[tuple[str, DataFrame]]) -> DataFrame:
    """field_name, row_id, start_pos, kind, redacted, checksum_holds: one row per credential.

    ``fields``: pairs of a field's name and a frame row_id, name (of the variable, or null), text.  ``start_pos``
    counts code points from 1 at the value's first piece; ``redacted`` is the whole text with all its secret
    values replaced, so lengths and everything around them stay.  Null and empty texts have none; very long lines
    are searched whole; repeated rows give a row each (by their row_id); empty tables give no rows.
    """
    one = [f.select(F.lit(n).alias("field_name"), F.col("row_id").cast("long"), F.col("name").cast("string").alias("name"), "text").where("text is not null and text <> ''") for n, f in fields]
    return reduce(DataFrame.unionByName, one).mapInArrow(_find_batches, "field_name string, row_id long, start_pos int, kind string, redacted string, checksum_holds boolean")
