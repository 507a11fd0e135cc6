"""Problem 2: credentials that stand literally in source and configuration text.

Token formats, key armour and connection strings are one deterministic automaton (``automaton``), which starts where an
Aho-Corasick automaton over the lower-cased text meets one of their anchors; the same anchors' automaton finds
authorization headers and credential words, whose values are judged by the grammar of assignments, calls and comments.
Overlapping windows of a text are scanned and absolute spans are deduplicated, so the windows' size does not change the
result: a grammar reads the text from its anchor to its own end.  Spans are spliced out and replaced by a placeholder.

Defined results: a null content has no credential; a credential that is given in pieces or over several lines
counts at its first line; spans that overlap are one; repeated rows count once; lines end at a line feed only;
other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton

WINDOW = 1 << 16
OVERLAP = 1 << 13
PLACEHOLDER = "<redacted>"

#: Published formats of tokens: (anchor, grammar from the anchor on).
_B64 = r"[A-Za-z0-9_\-]"
TOKENS = [
    ("akia", r"AKIA[0-9A-Z]{16}\b"),
    ("asia", r"ASIA[0-9A-Z]{16}\b"),
    ("aroa", r"AROA[0-9A-Z]{16}\b"),
    ("aiza", r"AIza[0-9A-Za-z_\-]{30,40}(?![0-9A-Za-z_\-])"),
    *[(p, p + r"[A-Za-z0-9]{30,255}\b") for p in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")],
    ("github_pat_", r"github_pat_\w{30,}"),
    ("glpat-", r"glpat-[\w\-]{20,}"),
    ("xox", r"xox[abeoprs]-[A-Za-z0-9\-]{10,}"),
    ("sg.", r"SG\.[\w\-]{16,}\.[\w\-]{16,}"),
    *[(p, p + r"[A-Za-z0-9]{16,}") for p in ("sk_live_", "sk_test_", "rk_live_", "rk_test_", "pk_live_")],
    ("whsec_", r"whsec_[A-Za-z0-9+/=]{16,}"),
    ("sk-", r"sk-(?:[a-z]+-)*[A-Za-z0-9_\-]{20,}"),
    ("npm_", r"npm_[A-Za-z0-9]{30,}"),
    ("pypi-", r"pypi-[\w\-]{30,}"),
    ("dop_v1_", r"dop_v1_[0-9a-f]{40,}"),
    ("hf_", r"hf_[A-Za-z0-9]{30,}"),
    ("ya29.", r"ya29\.[\w\-]{20,}"),
    ("eyj", r"eyJ[\w\-]{10,}\.eyJ[\w\-]{6,}\.[\w\-]{10,}"),
]
_SCHEME = "://"
_ARMOUR = "-----begin"
_HEADERS = ("authorization", "bearer", "basic")
#: Words that name a credential; camel and snake case are matched by the grammar of the name.
_WORDS = (
    "passw", "passwd", "password", "passphrase", "passcode", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "accesskey", "access-key",
    "private_key", "privatekey", "private-key", "signing_key", "signingkey", "signing-key", "session_key", "sessionkey", "session-key", "encryption_key", "encryptionkey",
    "credential", "auth_key", "authkey", "authkey", "service_pass", "servicepass", "_pass", "pat", "master_key", "masterkey", "license_key", "secretkey", "secret_key", "login", " pw ", "old key", "pw:", "pw=", "shared_key", "sharedkey", "client_key", "account_key", "accountkey", "storage_key", "ssh_key", "tls_key", "webhook_key", "hmac_key", "jwt_key", "deploy_key",
)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    kinds: dict[str, set] = {}
    for i, (anchor, _) in enumerate(TOKENS):
        kinds.setdefault(anchor, set()).add(("token", i))
    kinds.setdefault(_SCHEME, set()).add(("url", 0))
    kinds.setdefault(_ARMOUR, set()).add(("armour", 0))
    for h in _HEADERS:
        kinds.setdefault(h, set()).add(("header", 0))
    for w in _WORDS:
        kinds.setdefault(w, set()).add(("word", 0))
    for anchor, what in kinds.items():
        a.add_word(anchor, (len(anchor), tuple(sorted(what))))
    a.make_automaton()
    return a


_AUTOMATON: ahocorasick.Automaton | None = None
#: Key armour and logins in connection strings; with the token formats they make the one automaton of grammars.
_ARMOUR_BEGIN = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
_LOGIN = r"://[^\s/@:\"'`<>{}$]*:[^\s/@\"'`<>]+@[\w.\-\[\]]+"
GRAMMARS = Automaton([*(r for _, r in TOKENS), _ARMOUR_BEGIN, _LOGIN])
ARMOUR, LOGIN = len(TOKENS), len(TOKENS) + 1

_PLACE = re.compile(
    r"""^(?:|[xX]{3,}|\*+|\.+|-+|_+|0+|1234\w*|<[^>]*>|\$\{[^}]*\}.*|\$\{\{.*|\{\{.*|\$\(.*\)|\$\w+|%\w+%|%\([^)]*\)s|\{\w*\}|\[[^\]]*\]|@\w+@|__\w+__
        |(?:your|my|the|some|an?|insert|enter|put|add|set|replace|change|fill)\s.*|your[_\-].*|my[_\-](?:secret|password|token|key|api).*
        |(?:change|replace|fill|set|update)[_\-\s]?(?:me|this|it|in).*|.*(?:example|placeholder|dummy|sample|redacted|changeme|not[_\-]?set|to[_\-]?be[_\-]).*|.*(?:[-_. ]here)|(?:todo|tbd|fixme|none|null|nil|undefined|empty|unset|disabled|enabled|true|false|default|secret|password|passwd|token|key|test|string|str|n/a|na|xxx.*|unknown|optional|required|hidden|masked|vault|env|secret:.*|env:.*|vault:.*|arn:.*|file:.*|ref:.*|ssm:.*))$""",
    re.I | re.X,
)
_UPPER_NAME = re.compile(r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$")
#: Letters in words written as words are: lower case, capitalised or upper case.
_WORDY = re.compile(r"^(?:[a-z]+|[A-Z][a-z]+|[A-Z]{1,12})(?:[-_. ](?:[a-z]+|[A-Z][a-z]+|[A-Z]{1,12}))*[.:!?]?\s*$")
_CAMEL = re.compile(r"^[a-z]{2,}(?:[A-Z][a-z]{2,})+$|^(?:[A-Z][a-z]{2,}){1,4}$")
#: A name's last words say what it holds: these hold no credential though its first words name one.
_NOT_NAME = re.compile(
    r"(?:polic(?:y|ies)|limits?|counts?|length|len|size|type|kind|name|names|field|fields|label|prompt|hint|help|text_?id|url|uri|path|file|files|dir|ttl|expir\w*|expires?_?in|age|timeout|min|max|regex|pattern|format|header|prefix|suffix|index|idx|span|spans|bucket|hash|hashes|digest|checksum|fingerprint|id|ids|public|enabled|required|rotation|rotated_at|version|strength|rule|rules|algo|algorithm|budget|quota|used|usage|window|price|rate|env|ref|reference|placeholder|title|description|message|error|status|mode|scope|scopes|audience|issuer|store|provider|manager|service|endpoint|kinds|class|model|encoding|stream|parser|list|map|set|cache|queue|vault)$",
    re.I,
)
_KEYISH = re.compile(
    r"(?:pass(?:w(?:or)?d|phrase|code)?|pwd|pw|secrets?|tokens?|credentials?|creds?|pat|(?:api|access|private|signing|session|encryption|auth|master|license|secret|shared|client|account|storage|ssh|tls|webhook|hmac|jwt|deploy|service|app|db|admin|root|user|bot)[_\-]?keys?|apikeys?|service[_\-]?pass|login)$",
    re.I,
)
_NAME = re.compile(r"[A-Za-z_][\w\-]*")


def _split(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def _names_credential(name: str) -> tuple[bool, bool]:
    """(names a credential, holds it encoded)."""
    parts = _split(name)
    encoded = False
    while parts and parts[-1] in ("b64", "base64", "encoded", "enc", "64", "b") or len(parts) > 1 and parts[-1].isdigit():
        encoded = encoded or parts[-1] in ("b64", "base64", "encoded", "64", "b")
        parts = parts[:-1]
    if not parts:
        return False, False
    snake = "_".join(parts)
    if _NOT_NAME.search(parts[-1]) and not _KEYISH.search(snake):
        return False, encoded
    if "public" in parts:
        return False, encoded
    return bool(_KEYISH.search(snake)) and not (parts[-1] == "pat" and len(parts) > 2), encoded


def is_placeholder(v: str) -> bool:
    s = v.strip()
    return bool(_PLACE.match(s)) or len(set(s)) < 3 or bool(re.search(r"EXAMPLE", s)) or bool(re.fullmatch(r"(.)\1{5,}\W*", s))


def _literal_value(v: str, strict: bool = False) -> bool:
    """A value that could be a credential: not a placeholder, reference or sentence."""
    s = v.strip()
    if len(s) < 6 or is_placeholder(s) or "${" in s or "{{" in s:
        return False
    if " " in s:
        return False
    if re.fullmatch(r"[\d.,:\-+]+", s) and (len(s) < 8 or strict):
        return False
    if _UPPER_NAME.match(s) or _WORDY.match(s) or _CAMEL.match(s):  # words only, as min-twelve or API_TOKEN
        return False
    if re.fullmatch(r"[A-Za-z_][\w.]*\([^)]*\)?", s) or re.match(r"^(?:\.{0,2}/[a-z0-9_.\-/]*$|https?://|[A-Za-z]:\\)", s):
        return False
    if re.fullmatch(r"[a-z]+(?:[-_.][a-z]+)*[-_.]?\d{0,3}", s):  # plain words with a number: a name
        return False
    return True


_STR = r"(?:[rRbBuUfF]{0,2})(\"\"\"|'''|\"|'|`)"
_QUOTED = re.compile(r"(?:[rRbBuUfF]{0,2}|[rb]#*)(\"|'|`)((?:\\.|(?!\1)[^\\\n])*)\1")
_ASSIGN = re.compile(r"(?:\"|'|`)?\s*\]?\s*(?::\s*(?:&'?\w*\s*)?(?:[A-Za-z_][\w<>\[\]\s|.]*?)?\s*(?::?=(?!=))|:=|=>|=(?![=>])|:)\s*")
_JOIN = re.compile(r"\s*(?:\+|\.\.?|,|\\|)\s*(?:\\\s*)?\s*")


def _pieces(text: str, at: int, wrapped: bool) -> tuple[str, list[tuple[int, int]]] | None:
    """A literal from ``at`` on, with the pieces that are joined to it: value and spans of the contents."""
    m = _QUOTED.match(text, at)
    if not m:
        return None
    value, spans, quote_end = m.group(2), [(m.start(2), m.end(2))], m.end()
    while True:
        j = re.compile(r"\s*\+\s*|\s*\\\n\s*" + (r"|\s*,\s*|\s+" if wrapped else "")).match(text, quote_end)
        if not j:
            break
        n = _QUOTED.match(text, j.end())
        if not n:
            break
        value += n.group(2)
        spans.append((n.start(2), n.end(2)))
        quote_end = n.end()
    return value, spans


def _decoded(v: str) -> str | None:
    try:
        raw = base64.b64decode(v + "=" * (-len(v) % 4), validate=True)
        s = raw.decode("utf-8")
        return s if s.isprintable() and len(s) >= 4 else None
    except (binascii.Error, ValueError):
        return None


_LINE_COMMENT = re.compile(r"(?://|#|--|/\*|\*)\s*")
_FALLBACK = re.compile(
    r"(?:process\.env(?:\.\w+|\[[^\]]*\])\s*(?:\|\||\?\?)\s*|(?:os\.)?(?:environ(?:\.get|\.setdefault)|getenv)\(\s*(?:\"[^\"]*\"|'[^']*')\s*,\s*|(?:std::)?env::var\([^)]*\)\.(?:unwrap_or_else\(\|_?\w*\|\s*|unwrap_or\(\s*))"
)
_REFERENCE = re.compile(r"(?:process\.env|os\.environ|os\.getenv|getenv|environ|std::env|env::|load_?\w*\(|get_?\w*\(|read_?\w*\(|fetch\w*\(|vault\b|secrets?\.|config\.|settings\.|self\.|this\.|req\.|ctx\.|prompt\w*\(|input\(|getpass|None\b|null\b|nil\b|true\b|false\b|undefined\b|new\s)", re.I)
_CALL_NAME = re.compile(r"(?:connect|login|open_?session|client|auth\w*|session|signin|sign_in|set_?\w*)\s*\(", re.I)


class _Text:
    """Spans of one text: (start, end, kind); ``begin`` is where the credential begins."""

    def __init__(self, text: str):
        self.text, self.spans = text, {}

    def add(self, spans: list[tuple[int, int]], kind: str) -> None:
        first = spans[0][0]
        for s, e in spans:
            if e > s:
                self.spans[(s, e)] = (first, kind)


def _word(t: _Text, start: int, end: int) -> None:
    text = t.text
    # the whole name around the anchor
    a = start
    while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_-"):
        a -= 1
    b = end
    while b < len(text) and (text[b].isalnum() or text[b] in "_-"):
        b += 1
    name = text[a:b].strip("-")
    line_start = text.rfind("\n", 0, a) + 1
    line_end = text.find("\n", b)
    line_end = len(text) if line_end < 0 else line_end
    line = text[line_start:line_end]
    ok, encoded = _names_credential(name)
    if ok:
        after = _value_after(t, a, b, line_start, encoded)
        if after:
            return
        _call_argument(t, a, b, line_end, line_start, encoded)
    _comment(t, line, line_start)


def _value_after(t: _Text, a: int, b: int, line_start: int, encoded: bool) -> bool:
    text = t.text
    m = _ASSIGN.match(text, b)
    at = None
    if m and "\n" not in text[m.start() : m.end()].rstrip():
        at = m.end()
    else:
        # KEY inside a call that gives a default: setdefault("KEY", value), get("KEY", value), set("KEY", value)
        call = re.compile(r"(?:\"|')\s*,\s*").match(text, b)
        if call and re.search(r"(?:setdefault|putenv|set|put|insert|export|define|getenv|get)\(\s*(?:\"|')$", text[line_start:a]):
            at = call.end()
    if at is None:
        return False
    wrapped = False
    w = re.compile(r"(?:\(\s*|concat!\(\s*|\[\s*|String::from\(\s*|str\(\s*)").match(text, at)
    if w:
        at, wrapped = w.end(), True
    f = _FALLBACK.match(text, at)
    if f:
        at = f.end()
    got = _pieces(text, at, wrapped)
    if got is None:
        if f or w:
            return False
        nl = re.compile(r"\s*\n\s*").match(text, at)
        if nl and (got := _pieces(text, nl.end(), False)) is None:
            return False
        if got is None:
            return _bare(t, a, b, at, line_start, encoded)
    value, spans = got
    if "-----BEGIN" in value:
        return False  # the armour's own grammar
    if "://" in value:
        return False
    plain = _decoded(value) if encoded else value
    if plain is None:
        plain = value if encoded and re.fullmatch(r"[A-Za-z0-9+/=_\-]{8,}", value) else ""
    if _literal_value(plain):
        t.add(spans, "assigned")
        return True
    return False


def _bare(t: _Text, a: int, b: int, at: int, line_start: int, encoded: bool) -> bool:
    """An unquoted value of a configuration line: KEY=value, key: value, export KEY=value."""
    text = t.text
    head = text[line_start:a]
    if not re.fullmatch(r"\s*(?:(?:#|//|;|--)\s*)?(?:-\s+)?(?:export\s+|set\s+|ENV\s+|ARG\s+|setx\s+)?", head):
        return False
    m = re.compile(r"[^\s\"'`;,#]+(?:#\S*)?").match(text, at)
    if not m:
        return False
    value = m.group()
    end = text.find("\n", m.end())
    rest = text[m.end() : end if end >= 0 else len(text)].strip()
    if rest and not rest.startswith(("#", "//", ";", "}")):
        return False
    if _REFERENCE.match(value) or value.endswith((";", ",", "(", ")", "{", "[")) or "://" in value or re.search(r"[()\[\]{}<>]", value):
        return False
    if re.fullmatch(r"[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)+|[a-z_]+", value):
        return False
    plain = (_decoded(value) or value) if encoded else value
    if _literal_value(plain):
        t.add([(m.start(), m.end())], "setting")
        return True
    return False


def _call_argument(t: _Text, a: int, b: int, line_end: int, line_start: int, encoded: bool) -> None:
    """A comment at the line's end names the literal that stands before it."""
    text = t.text
    before = text[line_start:a]
    c = max(before.rfind("//"), before.rfind("# "), before.rfind("/*"))
    if c < 0 or not re.fullmatch(r"(?://|#|/\*)\s*", before[c:]) or text[b:line_end].strip(" */\r"):
        return
    strings = list(_QUOTED.finditer(text, line_start, line_start + c))
    if not strings:
        return
    run = [strings[-1]]  # pieces that are joined: only marks of joining stand between them
    for m in reversed(strings[:-1]):
        if not re.fullmatch(r"\s*[+,]?\s*", text[m.end() : run[0].start()]) or not re.search(r"concat\w*!?\s*\(\s*$|\+\s*$|[(=]\s*$|,\s*$", text[line_start : m.start()]):
            break
        run.insert(0, m)
    joined = re.search(r"concat|\+", text[line_start : line_start + c])
    run = run if joined else run[-1:]
    value = "".join(m.group(2) for m in run)
    if _literal_value(value, True) and "://" not in value:
        t.add([m.span(2) for m in run], "named by comment")


_COMMENTED = [
    re.compile(r"\b(?:old|new|current|temp(?:orary)?|test|prod|staging|backup|admin|root|db)?\s*(?:api\s+)?(?:key|token|secret|pw|pass(?:word)?|pwd|credentials?)\b(?:\s*,?\s*(?:rotate|for|is|was|on|of|to|in|until|from)\b[\w\s.\-]*?)?\s*[:=]\s*(?P<v>[^\s'\"`,;]{6,})\s*(?:\*/)?\s*$", re.I),
    re.compile(r"\b(?:login|log in|user|credentials?|account)\s*:?\s+[\w.@\-]+\s*(?:/|with|:)\s+(?P<v>[^\s'\"`,;]{6,})\s*(?:\*/)?\s*$", re.I),
]


def _comment(t: _Text, line: str, line_start: int) -> None:
    m = re.match(r"\s*(?://+!?|#+|--|/\*+|\*|;|<!--)\s*", line)
    if not m:
        return
    for rx in _COMMENTED:
        if c := rx.search(line, m.end()):
            v = c.group("v")
            if "://" in v or v.startswith(("ssh-", "sha", "AAAA")) or _REFERENCE.match(v):
                continue
            if _literal_value(v, True):
                t.add([(line_start + c.start("v"), line_start + c.end("v"))], "comment")
                return


_SCHEME_WORD = re.compile(r"\b(?:bearer|basic|token)(?=\s)", re.I)
_AUTH = re.compile(r"\b(?:(?P<scheme>bearer|basic|token)\s+)(?P<v>[A-Za-z0-9+/=._~\-]{8,})", re.I)


def _url(t: _Text, at: int) -> None:
    end = GRAMMARS.match(t.text, at).get(LOGIN)
    if end is None:
        return
    # neither the user's name nor the password holds a colon or an at sign before these
    begin = t.text.index(":", at + 3) + 1
    stop = t.text.index("@", begin)
    word = t.text[begin:stop]
    if not is_placeholder(word) and not re.match(r"[{$<%]", word):
        t.add([(begin, stop)], "url")


def _armour(t: _Text, at: int) -> None:
    head = GRAMMARS.match(t.text, at).get(ARMOUR)
    if head is None:
        return
    last = f"-----END {t.text[at + 11 : head - 5]}-----"
    close = t.text.find(last, head)
    end = close + len(last) if close >= 0 else None
    if end is None:  # cut off: the key's own lines
        k = re.compile(r"(?:\\n|\\r|[\sA-Za-z0-9+/=:,\-.\"'+\\])*").match(t.text, head)
        end = k.end()
        while end > head and t.text[end - 1].isspace():
            end -= 1
    body = t.text[head : close if close >= 0 else end]
    material = re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", body)
    if len(material) < 24 and close >= 0 or re.search(r"<[^>]*>|\.\.\.|\$\{|\{\{|\bx{6,}", body, re.I) and len(material) < 64:
        return
    t.add([(at, end)], "private key")


def _header(t: _Text, at: int) -> None:
    """Authorization schemes: at the word itself or just before it."""
    text = t.text
    line_start = text.rfind("\n", 0, at) + 1
    over = at
    line_end = text.find("\n", at)
    for begin in _SCHEME_WORD.finditer(text, at, len(text) if line_end < 0 else line_end + 1):
        m = _AUTH.match(text, begin.start()) if begin.start() >= over else None
        if not m:
            continue
        over = m.end()
        if m.start() != at and not re.search(r"authorization", text[line_start : m.start()], re.I):
            break
        v = m.group("v")
        if is_placeholder(v) or v.startswith(("$", "{", "<")):
            continue
        scheme = m.group("scheme").lower()
        if scheme == "basic":
            d = _decoded(v)
            if d and ":" in d and not is_placeholder(d.partition(":")[2]):
                t.add([m.span("v")], "header")
        elif re.search(r"authorization", text[line_start : m.start()], re.I) or scheme == "bearer" and len(v) >= 20 and re.search(r"\d", v):
            if _literal_value(v, True) and not re.fullmatch(r"[a-z]+", v):
                t.add([m.span("v")], "header")
        return


def scan(text: str, window: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(start, end, begin, kind) of every span; pieces of one credential share ``begin``."""
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = _automaton()
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: compare ASCII only
        low = text.translate({c: c + 32 for c in range(65, 91)})
    t = _Text(text)
    seen: set[tuple[int, str, int]] = set()
    step = max(1, window - overlap)
    for base in range(0, max(1, len(low)), step):
        for last, (size, kinds) in _AUTOMATON.iter(low[base : base + window]):
            at = base + last - size + 1
            for kind, i in kinds:
                if (at, kind, i) in seen:
                    continue
                seen.add((at, kind, i))
                if kind == "token":
                    if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
                        continue
                    if at and text[at - 1] in "\"'`" and (joined := _pieces(text, at - 1, True)) and len(joined[1]) > 1:
                        if i in GRAMMARS.match(joined[0], 0) and not is_placeholder(joined[0]):
                            t.add(joined[1], "token")
                        continue
                    end = GRAMMARS.match(text, at).get(i, at)
                    if end > at and not is_placeholder(text[at:end]) and not re.search(r"(?i)example|x{8,}|0{12,}", text[at:end]):
                        t.add([(at, end)], "token")
                elif kind == "url":
                    _url(t, at)
                elif kind == "armour":
                    _armour(t, at)
                elif kind == "header":
                    _header(t, at)
                else:
                    _word(t, at, at + size)
        if base + window >= len(low):
            break
    return _merge(t)


def _merge(t: _Text) -> list[tuple[int, int, int, str]]:
    out: list[list] = []
    for (s, e), (begin, kind) in sorted(t.spans.items()):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
            out[-1][2] = min(out[-1][2], begin)
        else:
            out.append([s, e, begin, kind])
    return [tuple(x) for x in out]


def redact(text: str, spans: list[tuple[int, int, int, str]], placeholder: str = PLACEHOLDER) -> str:
    """The text with each span replaced; the line feeds inside a span stay, so line numbers hold."""
    parts, at = [], 0
    for s, e, begin, _ in spans:
        inner = text[s:e]
        parts += [text[at:s], placeholder if s == begin or not parts else "", "\n" * inner.count("\n")]
        at = e
    return "".join(parts) + text[at:]


def find(chunks: DataFrame) -> DataFrame:
    """(chunk_id, content_hash, line_nos, kinds, redacted): every chunk with a credential."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for cid, digest, text in zip(b.chunk_id, b.content_hash, b.content):
                spans = scan(text)
                if spans:
                    begins = {}
                    for _, _, begin, kind in spans:
                        begins.setdefault(text.count("\n", 0, begin) + 1, kind)
                    rows.append((cid, digest, list(begins), list(begins.values()), redact(text, spans)))
            yield pd.DataFrame(rows, columns=["chunk_id", "content_hash", "line_nos", "kinds", "redacted"])

    base = chunks.filter("chunk_id is not null and content is not null").select("chunk_id", F.coalesce(F.lower("content_hash"), F.sha2("content", 256)).alias("content_hash"), "content")
    return base.mapInPandas(run, "chunk_id string, content_hash string, line_nos array<int>, kinds array<string>, redacted string")


def found_lines(chunks: DataFrame) -> DataFrame:
    return find(chunks).select("chunk_id", F.explode("line_nos").alias("line_no")).distinct()


def tainted_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(embedding_id, chunk_id, content_hash): vectors made from content with a credential."""
    digests = find(chunks).select("content_hash").distinct()
    return embeddings.select("embedding_id", "chunk_id", F.lower("content_hash").alias("content_hash")).join(digests, "content_hash", "left_semi").distinct()
