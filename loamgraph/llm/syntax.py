"""Problem 7: source files that do not parse.

A file is cut into pieces at line feeds; the pieces of a file of several become rows.  A piece is a *state map*: for
every state in which the lexer may enter it the state at its end and a summary of its brackets.  Maps are reduced
associatively across partitions (``pieces``), which decides unfinished texts and unbalanced brackets and gives the state
at which every piece begins; then its tokens are made, and the balanced token sequence is checked statement by statement
with a local grammar per language: which tokens may follow each other, what each keyword needs, how statements end.
Python and JSON have maps too; their statements go to the standard library's grammars and, where these give up on depth,
to a stack of our own.

Defined results: a null content or path, another extension, an empty text and a text of comments only are valid
(an empty JSON text is not); a leading byte-order mark is skipped except in JSON; line ends of any kind are equal;
repeated rows count once; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

PIECE = 1 << 16
EXTENSIONS = {"py": "python", "rs": "rust", "ts": "ts", "mts": "ts", "js": "js", "mjs": "js", "jsx": "js", "sol": "solidity", "json": "json"}

OPEN = {"(": ")", "[": "]", "{": "}", "${": "}"}


@dataclass
class Tokens:
    kind: list[str] = field(default_factory=list)  # id kw num str regex op open close life
    text: list[str] = field(default_factory=list)
    line: list[int] = field(default_factory=list)

    def add(self, kind: str, text: str, line: int) -> None:
        self.kind.append(kind)
        self.text.append(text)
        self.line.append(line)

    def extend(self, other: Tokens, lines: int) -> None:
        self.kind += other.kind
        self.text += other.text
        self.line += [x + lines for x in other.line]


_NUM = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)(?:\.(?![.A-Za-z_])[\d_]*)?(?:[eE][+-]?\d[\d_]*)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)"
_WORD = r"[^\W\d][\w$]*|\$[\w$]*"
_JS_OP = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[-+*/%=<>!&|^~?:.,;@#]"
_RS_OP = r"<<=|>>=|\.\.\.|\.\.=|\.\.|->|=>|::|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%=<>!&|^~?:.,;@#$]"
_SOL_OP = r">>>=|<<=|>>=|=>|->|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|:=|[-+*/%=<>!&|^~?:.,;]"

_LEX = {
    "js": re.compile(rf"(?P<ws>\s+)|(?P<lc>//[^\n\r]*|\A#![^\n]*)|(?P<bc>/\*)|(?P<num>{_NUM}n?)|(?P<id>#?(?:{_WORD}))|(?P<str>\"(?:\\(?:\r\n|[\s\S])|[^\"\\\n\r])*\"|'(?:\\(?:\r\n|[\s\S])|[^'\\\n\r])*')|(?P<tm>`)|(?P<br>[(){{}}\[\]])|(?P<op>{_JS_OP})"),
    "rust": re.compile(
        rf"(?P<ws>\s+)|(?P<lc>//[^\n\r]*)|(?P<bc>/\*)|(?P<raw>(?:b|c)?r(?P<h>#*)\")|(?P<ch>b?'(?:\\(?:x[0-9a-fA-F]{{2}}|u\{{[0-9a-fA-F_]{{1,8}}\}}|[nrt\\0'\"])|[^'\\\n\r\t])')|(?P<life>'(?:{_WORD})(?!'))|(?P<st>[bc]?\")|(?P<num>{_NUM}(?:[iuf](?:8|16|32|64|128|size)|_?[iuf]\d+)?)|(?P<id>r#(?:{_WORD})|{_WORD})|(?P<br>[(){{}}\[\]])|(?P<op>{_RS_OP})"
    ),
    "solidity": re.compile(rf"(?P<ws>\s+)|(?P<lc>//[^\n\r]*)|(?P<bc>/\*)|(?P<num>{_NUM})|(?P<str>(?:hex|unicode)?(?:\"(?:\\[\s\S]|[^\"\\\n\r])*\"|'(?:\\[\s\S]|[^'\\\n\r])*'))|(?P<id>{_WORD})|(?P<br>[(){{}}\[\]])|(?P<op>{_SOL_OP})"),
}
_LEX["ts"] = _LEX["js"]
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n\r]|\[(?:\\[^\n\r]|[^\]\\\n\r])*\]|[^/\\\[\n\r])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*")
_RUST_STR = re.compile(r"(?:\\[\s\S]|[^\"\\])*\"")
_NEST = re.compile(r"/\*|\*/")

KEYWORDS = {
    "js": set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield let await enum null true false".split()),
    "rust": set("as break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await".split()),
    "solidity": set(
        "abstract address anonymous as assembly bool break bytes calldata case catch constant constructor continue contract delete do else emit enum event external fallback false fixed for from function if immutable import indexed interface internal is let library mapping memory modifier new override payable pragma private public pure receive return returns storage string struct switch this throw true try type unchecked using var view virtual while".split()
    ),
}
KEYWORDS["ts"] = KEYWORDS["js"]
#: After these a slash begins a regular expression.
_BEFORE_REGEX = set("return typeof case do else in instanceof new void delete throw yield await of".split())


@dataclass
class Piece:
    """Result of lexing a piece from one entry state."""

    tokens: Tokens
    state: str  # code, block, template, string, raw:<n>; or bad
    depth: int  # nesting of block comments at the end
    stack: list[str]  # open brackets of templates' expressions and braces, from the piece's own start
    lines: int


def lex(text: str, lang: str, state: str = "code", depth: int = 0, stack: list[str] | None = None, known: bool = False, at: int = 0, line: int = 1, closers: list | None = None) -> Piece:
    """known: the stack is complete.  closers: gets the closing brackets that nothing in the text opened, with the places
    after them; the state is "bad" if brackets do not match."""
    rx, words, out = _LEX[lang], KEYWORDS[lang], Tokens()
    stack = list(stack or [])
    end = len(text)
    script = lang in ("js", "ts")
    while at < end:
        if state == "block":
            m = (_NEST if lang == "rust" else re.compile(r"\*/")).search(text, at)
            if not m:
                line += text.count("\n", at)
                at = end
                break
            line += text.count("\n", at, m.end())
            at = m.end()
            if m.group() == "/*":
                depth += 1
            else:
                depth -= 1
                if depth <= 0:
                    state, depth = "code", 0
            continue
        if state == "template":
            m = _TEMPLATE.match(text, at)
            line += text.count("\n", at, m.end())
            at = m.end()
            if at >= end:
                break
            if text[at] == "`":
                out.add("str", "`", line)
                state = "code"
                at += 1
            elif text[at] == "$":
                out.add("open", "${", line)
                stack.append("${")
                state = "code"
                at += 2
            else:  # a lone backslash at the end
                at = end
            continue
        if state == "string":
            m = _RUST_STR.match(text, at)
            line += text.count("\n", at, m.end() if m else end)
            if not m:
                at = end
                break
            out.add("str", '"', line)
            state, at = "code", m.end()
            continue
        if state.startswith("raw:"):
            stop = '"' + "#" * int(state[4:])
            i = text.find(stop, at)
            line += text.count("\n", at, i if i >= 0 else end)
            if i < 0:
                at = end
                break
            out.add("str", '"', line)
            state, at = "code", i + len(stop)
            continue
        if script and text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*") and _regex_may_start(out):
            if m := _REGEX.match(text, at):
                out.add("regex", "/", line)
                at = m.end()
                continue
        m = rx.match(text, at)
        if not m:
            out.add("bad", text[at], line)
            at += 1
            continue
        kind, s = m.lastgroup, m.group()
        if kind == "h":
            kind = "raw"
        at = m.end()
        if kind == "ws":
            line += s.count("\n")
        elif kind == "lc":
            pass
        elif kind == "bc":
            state, depth = "block", 1
        elif kind == "tm":
            state = "template"
        elif kind == "st":
            state = "string"
        elif kind == "raw":
            state = f"raw:{len(m.group('h') or '')}"
        elif kind == "br":
            if s in OPEN:
                out.add("open", s, line)
                if script or closers is not None:
                    stack.append(s)
            elif closers is not None and not stack:
                closers.append([s, at if script and s == "}" else ""])
                out.add("close", s, line)
            elif closers is not None and OPEN[stack[-1]] != s:
                return Piece(out, "bad", 0, [], line - 1)
            elif closers is not None and stack[-1] != "${":
                stack.pop()
                out.add("close", s, line)
            else:
                if script and s == "}":
                    while stack and stack[-1] in "([":
                        stack.pop()
                    if stack:
                        if stack.pop() == "${":
                            out.add("close", "}$", line)
                            state = "template"
                            continue
                elif script and stack and OPEN.get(stack[-1]) == s:
                    stack.pop()
                out.add("close", s, line)
        elif kind == "id":
            out.add("kw" if s in words else "id", s, line)
        elif kind in ("str", "ch"):
            out.add("str", s if len(s) < 200 else s[0], line)
            line += s.count("\n")
        elif kind == "life":
            out.add("life", s, line)
        else:
            out.add(kind, s, line)
    return Piece(out, state, depth, stack, line - 1)


def _regex_may_start(t: Tokens) -> bool:
    if not t.kind:
        return True
    k, s = t.kind[-1], t.text[-1]
    if k == "kw":
        return s in _BEFORE_REGEX
    if k == "id":
        return s == "of"
    if k in ("num", "str", "regex"):
        return False
    if k == "close":
        return s == "}"
    return s not in ("++", "--")


def cut_lines(text: str, size: int = PIECE) -> list[str]:
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at + size - 1) + 1
        end = len(text) if end <= 0 else end
        out.append(text[at:end])
        at = end
    return out


def brackets(t: Tokens) -> tuple[list[int], str | None]:
    """For every bracket the index of its partner; the first bracket that has none."""
    partner, stack = [-1] * len(t.kind), []
    for i, (k, s) in enumerate(zip(t.kind, t.text)):
        if k == "open":
            stack.append(i)
        elif k == "close":
            want = "}" if s == "}$" else s
            if not stack or OPEN[t.text[stack[-1]]] != want or (s == "}$") != (t.text[stack[-1]] == "${"):
                return partner, f"unmatched {want}"
            j = stack.pop()
            partner[i], partner[j] = j, i
    return partner, f"{t.text[stack[-1]]} is never closed" if stack else None


# -- local grammars ------------------------------------------------------------------------------------------
_VALUE = {"id", "num", "str", "regex"}
_JS_PREFIX_KW = set("typeof void delete new await yield return throw case else do in of instanceof default extends export const let var function class import async static get set if while for switch".split())
_JS_VALUE_KW = {"this", "super", "null", "true", "false"}
_JS_AFTER_VALUE = {"in", "instanceof", "of", "as", "satisfies", "from", "is", "extends", "implements", "while", "else", "catch", "finally"}
_TS_WORDS = set("type interface declare abstract namespace module readonly public private protected override static get set async keyof unique infer asserts is as satisfies implements enum of from accessor out".split())
_JS_WORDS = set("static get set async of from as".split())
_BINARY = set("* / % ** == === != !== < <= >= && || ?? = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= << & | ^ => . ?.".split())
_ONLY_BINARY = _BINARY - {"/", "<", "*", ".", "&", "|"} | {"?", ">"}


def check_js(t: Tokens, partner: list[int], ts: bool) -> str | None:
    kind, text, line = t.kind, t.text, t.line
    n = len(kind)
    ctx: list[list] = []  # [bracket, role, ternaries, member start]
    words = _TS_WORDS if ts else _JS_WORDS

    def is_value_end(i: int) -> bool:
        return kind[i] in _VALUE or kind[i] == "close" and text[i] in ")]" or kind[i] == "kw" and text[i] in _JS_VALUE_KW

    def is_member(i: int) -> bool:
        return i > 0 and text[i - 1] in (".", "?.") and kind[i - 1] == "op" or kind[i] in ("id", "kw") and text[i].startswith("#")

    def is_key(i: int) -> bool:
        return i + 1 < n and text[i + 1] in (":", "(", "?", ",", "}", "=") and bool(ctx) and ctx[-1][1] in ("object", "class", "type") and (i == 0 or text[i - 1] in ("{", ",", ";", "}", "get", "set", "async", "static", "*"))

    statement = 0  # index of the present statement's first token
    for i in range(n):
        k, s = kind[i], text[i]
        p = i - 1
        if k == "bad":
            return f"stray {s}"
        if k == "open":
            if s == "{":
                ctx.append([s, _brace_role(t, partner, i, ctx, ts), 0])
            elif s == "${":
                ctx.append([s, "expr", 0])
            else:
                ctx.append([s, "paren" if s == "(" else "index", 0])
            if s in "{(" and p >= 0 and kind[p] == "num" and line[p] == line[i]:
                return "value before bracket"
            continue
        if k == "close":
            if p >= 0 and kind[p] == "op" and text[p] in _BINARY - {"*"} | {"+", "-", "?", ":"} and not (text[p] in ("?", ">", "|", "&") and ts):
                if not (text[p] in ("?", "!") and ts):
                    return f"{text[p]} before {s}"
            if p >= 0 and kind[p] == "op" and text[p] == "*" and s != "}":
                return "* before closing bracket"
            ctx.pop()
            continue
        member = is_member(i)
        role = ctx[-1][1] if ctx else "block"
        # two values side by side
        if p >= 0 and (k in _VALUE or k == "kw" and not member) and is_value_end(p) and not (text[p] in words and kind[p] == "id") and not _key_word(t, p, role):
            same = line[p] == line[i]
            after = k == "kw" and s in _JS_AFTER_VALUE or k == "id" and s in (_JS_AFTER_VALUE if ts else {"of", "from", "as"})
            paren_head = text[p] == ")" and _is_head(t, partner, p)
            tagged = kind[i] == "str" and s == "`" or kind[i] == "str" and text[i].startswith("`")
            if not after and not paren_head and not tagged:
                if same or role in ("paren", "index", "expr", "object") and not (role == "object" and False):
                    if not (ts and role in ("type", "class") and not same) and not (k == "kw" and s in ("in",)):
                        return f"{text[p]} {s}"
        if p >= 0 and kind[p] == "op" and text[p] in (".", "?.") and k not in ("id", "kw") and not (text[p] == "?." and s in ("(", "[", "`")):
            return f"{text[p]} {s}"
        if k == "op":
            if s == ";" and role in ("paren", "index", "expr") and not (role == "paren" and _for_head(t, partner, ctx, i)):
                return "; in brackets"
            if s in _ONLY_BINARY and s not in ("<", ">", "?", "=>", "&", "|") and (p < 0 or kind[p] == "open" or text[p] in (",", ";") and kind[p] == "op" or kind[p] == "op" and text[p] in _BINARY - {">"}):
                if not (ts and s == "=" and p >= 0 and text[p] in (">", "]")):
                    return f"{text[p] if p >= 0 else ''} {s}"
            if s in (",",) and p >= 0 and (kind[p] == "open" and text[p] != "[" or kind[p] == "op" and text[p] in _BINARY | {"+", "-"} and not (ts and text[p] in (">", "?"))):
                return f"{text[p]} ,"
            if s == ";" and p >= 0 and kind[p] == "op" and text[p] in _BINARY - {"*"} | {"+", "-"} and not (ts and text[p] == ">"):
                return f"{text[p]} ;"
            if s == "?" and ctx:
                nxt = text[i + 1] if i + 1 < n else ""
                if nxt in (")", ",", ":", "]", "}", ";") or nxt == "(" and role in ("class", "type") and ts:
                    if not ts:
                        return "optional mark"
                else:
                    ctx[-1][2] += 1
            elif s == "?" and not ctx:
                nxt = text[i + 1] if i + 1 < n else ""
                if nxt == ":" and not ts:
                    return "optional mark"
            if s == ":" and not ts:
                if ctx and ctx[-1][2] > 0:
                    ctx[-1][2] -= 1
                elif role in ("paren", "index", "expr"):
                    return "type annotation"
                elif role == "block" and not _case_or_label(t, i, statement) and not _top_ternary(t, i, statement):
                    return "type annotation"
                elif role == "class":
                    return "type annotation"
            if s == "=>" and p >= 0 and kind[p] not in ("id", "close", "kw") and not (ts and text[p] == ">"):
                return "=> without parameters"
        if k == "kw" and not member and not is_key(i):
            why = _js_keyword(t, partner, i, ts, role)
            if why:
                return why
        if k == "id" and s in ("interface", "type", "namespace", "declare") and not ts and i + 1 < n and kind[i + 1] == "id" and line[i] == line[i + 1]:
            return "type declaration"
        if p < 0 or text[p] in (";", "{", "}"):
            statement = i
    return None


def _key_word(t: Tokens, p: int, role: str) -> bool:
    return False


def _is_head(t: Tokens, partner: list[int], p: int) -> bool:
    """The bracket at p closes the head of if, while, for, with or catch, or a decorator's arguments."""
    j = partner[p]
    if j <= 0:
        return False
    w = t.text[j - 1]
    if t.kind[j - 1] == "kw" and w in ("if", "while", "for", "with", "switch", "catch") or w == "await" and j > 1 and t.text[j - 2] == "for":
        return not (j > 1 and t.text[j - 2] == ".")
    return t.kind[j - 1] == "id" and j > 1 and t.text[j - 2] == "@"


def _for_head(t: Tokens, partner: list[int], ctx: list, i: int) -> bool:
    depth = 0
    for j in range(i - 1, -1, -1):
        if t.kind[j] == "close":
            depth += 1
        elif t.kind[j] == "open":
            if depth == 0:
                return j > 0 and t.text[j - 1] == "for"
            depth -= 1
    return False


def _case_or_label(t: Tokens, i: int, statement: int) -> bool:
    """case x: / default: / label:"""
    if i >= 1 and t.kind[i - 1] == "id" and (i == 1 or t.text[i - 2] in (";", "{", "}", ":", "else", ")")):
        return True
    depth = 0
    for j in range(i - 1, -1, -1):
        if t.kind[j] == "close":
            depth += 1
        elif t.kind[j] == "open":
            if depth == 0:
                return i - j == 2 and t.kind[i - 1] == "id"
            depth -= 1
        elif depth == 0:
            if t.kind[j] == "kw" and t.text[j] in ("case", "default"):
                return True
            if t.text[j] in (";",) or t.kind[j] == "op" and t.text[j] == ":":
                return i - j == 2 and t.kind[i - 1] == "id"
            if t.line[j] != t.line[i] and i - 1 == j + 1:
                return t.kind[i - 1] == "id"
    return i == 1 and t.kind[0] == "id"


def _top_ternary(t: Tokens, i: int, statement: int) -> bool:
    depth = 0
    for j in range(i - 1, -1, -1):
        if t.kind[j] == "close":
            depth += 1
        elif t.kind[j] == "open":
            if depth == 0:
                return False
            depth -= 1
        elif depth == 0 and t.text[j] == "?" and t.kind[j] == "op":
            return True
        elif depth == 0 and t.text[j] == ";":
            return False
    return False


def _brace_role(t: Tokens, partner: list[int], i: int, ctx: list, ts: bool) -> str:
    """block, object, class or type."""
    if i == 0:
        return "block"
    k, s = t.kind[i - 1], t.text[i - 1]
    if k == "op" and s == "=>":
        return "block"
    if k == "close" and s == ")" or k == "kw" and s in ("else", "try", "finally", "do") or k == "op" and s == ";" or k == "close" and s == "}" or k == "open" and s == "{":
        return "block"
    # look back over a declaration's head
    for j in range(i - 1, -1, -1):
        if t.kind[j] == "kw" and t.text[j] == "class" and not (j and t.text[j - 1] == "."):
            return "class"
        if t.kind[j] == "id" and t.text[j] in ("interface", "namespace", "module") and ts and j + 1 < len(t.kind) and t.kind[j + 1] in ("id", "str"):
            return "type" if t.text[j] == "interface" else "block"
        if t.kind[j] == "kw" and t.text[j] == "enum":
            return "object"
        if t.text[j] in (";", "{", "}", "=>") or t.kind[j] == "op" and t.text[j] == "=":
            break
    if k == "kw" and s in ("import", "export"):
        return "object"
    if k == "op" and s == ":" and ts:
        return "object" if ctx and ctx[-1][1] == "object" else "type"
    if ts and k == "op" and s in ("|", "&", "<"):
        return "type"
    if k == "op" and s == "=" and ts:
        for j in range(i - 2, -1, -1):
            if t.kind[j] == "id" and t.text[j] == "type" and t.kind[j + 1] == "id":
                return "type"
            if t.text[j] in (";", "{", "}"):
                break
    if k == "op" and s == ":" and not ts and (not ctx or ctx[-1][1] == "block") and not (ctx and ctx[-1][2]):
        return "block"  # case x: {
    if k == "op" or k == "open" or k == "kw" and s in ("return", "throw", "default", "in", "of", "typeof", "await", "yield", "case", "new", "const", "let", "var"):
        return "object"
    if ts and k in ("id", "close"):
        return "block"
    return "block"


def _js_keyword(t: Tokens, partner: list[int], i: int, ts: bool, role: str) -> str | None:
    n, s = len(t.kind), t.text[i]
    nk, nx = (t.kind[i + 1], t.text[i + 1]) if i + 1 < n else ("", "")
    if s in ("if", "while", "switch", "with") and nx != "(":
        return f"{s} without ("
    if s in ("if", "while", "for") and nx == "(":
        close = partner[i + 1]
        if close == i + 2:
            return f"{s} without condition"
        if close >= 0 and s != "while" and (close + 1 >= n or t.kind[close + 1] == "close"):
            return f"{s} without body"
    if s == "switch" and nx == "(" and partner[i + 1] >= 0 and (partner[i + 1] + 1 >= n or t.text[partner[i + 1] + 1] != "{"):
        return "switch without {"
    if s == "for" and nx not in ("(", "await"):
        return "for without ("
    if s == "for" and nx == "(" and partner[i + 1] >= 0:
        semis = depth = 0
        between = False
        for j in range(i + 2, partner[i + 1]):
            depth += (t.kind[j] == "open") - (t.kind[j] == "close")
            if depth == 0:
                semis += t.text[j] == ";" and t.kind[j] == "op"
                between = between or t.text[j] in ("of", "in")
        if semis not in (0, 2) or semis == 0 and not between:
            return "for head"
    if s == "catch" and nx not in ("(", "{"):
        return "catch"
    if s in ("try", "finally") and nx != "{":
        return f"{s} without {{"
    if s == "try" and nx == "{" and partner[i + 1] >= 0:
        j = partner[i + 1] + 1
        if j >= n or t.text[j] not in ("catch", "finally"):
            return "try alone"
    if s in ("catch", "finally") and (i == 0 or t.text[i - 1] != "}"):
        return f"{s} without try"
    if s == "else" and (i == 0 or t.text[i - 1] not in ("}", ";") and t.line[i - 1] == t.line[i]):
        return "else without if"
    if s == "else" and (not nx or t.kind[i + 1] == "close"):
        return "else without body"
    if s == "function":
        j = i + 1
        if j < n and t.text[j] == "*":
            j += 1
        if j < n and t.kind[j] in ("id", "kw"):
            j += 1
        if ts and j < n and t.text[j] == "<":
            d = 0
            while j < n:
                d += (t.text[j] == "<") - (t.text[j] == ">")
                j += 1
                if d == 0:
                    break
        if j >= n or t.text[j] != "(":
            return "function without parameters"
        c = partner[j]
        if c >= 0 and (c + 1 >= n or t.text[c + 1] != "{" and not (ts and t.text[c + 1] in (":", ";", "}") or ts and t.line[c + 1] != t.line[c])):
            return "function without body"
    if s == "class" and nk not in ("id",) and nx not in ("{", "extends"):
        return "class without name"
    if s == "class" and nk == "id":
        for j in range(i + 2, min(n, i + 60)):
            if t.text[j] == "{":
                break
            if t.text[j] in (";", ")", "}"):
                return "class without body"
    if s == "const" and ts and i and t.text[i - 1] == "as":
        return None
    if s in ("const", "var") or s == "let" and nk == "id" and t.line[i] == t.line[i + 1]:
        if nk != "id" and nx not in ("{", "[", "enum", "yield", "await", "let"):
            return f"{s} without name"
        if s == "const" and nk == "id" and i + 2 < n and not (ts or role == "paren"):
            if t.text[i + 2] not in ("=", "of", "in"):
                return "const without value"
        elif nk == "id" and i + 2 < n and t.text[i + 2] not in ("=", ",", ";", "of", "in", ":", "!", "}", ")") and t.line[i + 2] == t.line[i + 1]:
            return f"{s} {nx} {t.text[i + 2]}"
    if s == "import" and nk != "str" and nk != "id" and nx not in ("{", "*", "(", "."):
        return "import"
    if s == "import" and nx == "{" and partner[i + 1] >= 0 and (partner[i + 1] + 1 >= n or t.text[partner[i + 1] + 1] != "from"):
        return "import without from"
    if s == "import" and nx == "{" and partner[i + 1] >= 0 and (partner[i + 1] + 2 >= n or t.kind[partner[i + 1] + 2] != "str"):
        return "import without module"
    if s == "new" and nk not in ("id", "kw") and nx not in ("(", "[", ".", "{") or s == "new" and nk == "kw" and nx not in ("this", "class", "function", "super", "import", "new", "await"):
        return "new"
    if s == "void" and ts:
        return None
    if s in ("throw", "typeof", "void", "delete", "case", "extends", "instanceof") and (nk == "close" or nx in (";", ",", "=")):
        return s
    if s == "export" and nk == "op" and nx not in ("*", "=", "@") or s == "export" and nk in ("num", "close"):
        return "export"
    if s == "case" and role != "block":
        return "case outside switch"
    if s in ("return",) and role in ("paren", "index", "expr"):
        return "return in brackets"
    return None


_RS_AFTER = {"as", "in", "else", "where", "for", "if", "mut", "await", "dyn"}
_RS_VALUE_KW = {"self", "Self", "super", "crate", "true", "false", "await"}
_RS_NEED = set("+ - / % = == != <= >= && += -= *= /= %= &= |= ^= <<= >>= -> =>".split())
_RS_NOT_FIRST = set("/ % == != <= >= += -= *= /= %= ^ ^= = => ->".split())
#: Macros whose arguments are expressions.
_RS_EXPR_MACROS = set("println eprintln print eprint format panic assert assert_eq assert_ne debug_assert debug_assert_eq vec write writeln unreachable todo concat dbg".split())


def check_rust(t: Tokens, partner: list[int]) -> str | None:
    kind, text = t.kind, t.text
    n = len(kind)
    free_until = -1  # inside a macro's own syntax
    ctx: list[tuple[str, int]] = []
    for i in range(n):
        k, s, p = kind[i], text[i], i - 1
        if k == "bad":
            return f"stray {s}"
        if k == "open":
            if p >= 0 and text[p] == "!" and i >= 2 and kind[i - 2] in ("id",) and text[i - 2] not in _RS_EXPR_MACROS and i > free_until:
                free_until = partner[i]
            if p >= 0 and text[p] == "#" or p >= 1 and text[p] == "!" and text[p - 1] == "#":
                free_until = max(free_until, partner[i])
            if p >= 2 and kind[p] == "id" and text[p - 1] == "!" and text[p - 2] == "macro_rules":
                free_until = max(free_until, partner[i])
            ctx.append((s, i))
            if i <= free_until:
                continue
            if s == "{" and p >= 0 and kind[p] in ("num", "str") and not _rust_head(t, partner, i):
                return "value before {"
            if p >= 0 and s == "(" and kind[p] in ("num",):
                return "number before ("
            continue
        if k == "close":
            where = ctx.pop() if ctx else ("", -1)
            if i <= free_until:
                continue
            if p >= 0 and kind[p] == "op" and text[p] in _RS_NEED:
                return f"{text[p]} before {s}"
            if s == ")" and p >= 0 and text[p] in (";", ".", "::") or s == "}" and p >= 0 and text[p] in (".", "::", ":"):
                return f"{text[p]} before {s}"
            if s == "}" and where[1] >= 0:
                why = _rust_block_end(t, partner, where[1], i)
                if why:
                    return why
            continue
        if i <= free_until:
            continue
        role = ctx[-1][0] if ctx else "{"
        value = k in ("id", "num", "str") or k == "kw"
        if p >= 0 and value:
            before = kind[p] in ("id", "num", "str") or kind[p] == "close" and text[p] in ")]" or kind[p] == "kw" and text[p] in _RS_VALUE_KW
            attribute = text[p] == "]" and partner[p] > 0 and (text[partner[p] - 1] == "#" or text[partner[p] - 1] == "!" and text[partner[p] - 2] == "#")
            if before and not attribute and not (k == "kw" and s in _RS_AFTER) and not (kind[p] == "id" and text[p] in ("union", "auto", "macro_rules", "default", "raw", "safe")):
                if not (text[p] == "crate" and p and text[p - 1] == "extern") and not (text[p] == ")" and partner[p] > 0 and text[partner[p] - 1] == "pub"):
                    return f"{text[p]} {s}"
        if k == "op":
            if s in _RS_NOT_FIRST and (p < 0 or kind[p] == "open" or kind[p] == "op" and text[p] in (",", ";", "=", "==", "+=", "-=", "=>", "->") or kind[p] == "op" and text[p] in "+-/%" and s not in ("->", "=>")):
                return f"{text[p] if p >= 0 else ''} {s}"
            if s == ";" and role == "(":
                return "; in brackets"
            if s == ";" and p >= 0 and kind[p] == "op" and text[p] in _RS_NEED:
                return f"{text[p]} ;"
            if s == "," and p >= 0 and (kind[p] == "open" or kind[p] == "op" and text[p] in _RS_NEED | {","}):
                return f"{text[p]} ,"
            if s == "++" or s == "--":
                return s
        if k == "kw":
            why = _rust_keyword(t, partner, i, role)
            if why:
                return why
        if k == "id" and role == "{" and (p < 0 or text[p] in ";{}") and i + 1 < n and kind[i + 1] in ("id",) and s not in ("union", "auto", "macro_rules", "default"):
            return f"{s} {text[i + 1]}"
    # items only at the top: no stray expression
    depth = 0
    start = True
    i = 0
    while i < n:
        if kind[i] == "open":
            if start and text[i] != "{":
                return "expression outside a function"
            if start:
                return "block outside a function"
            i = partner[i]
            start = text[i] == "}" or (text[i] == "]" and text[partner[i] - 1] in ("#", "!"))
            if text[i] == "}" and i + 1 < n and text[i + 1] in (";", ","):
                start = False
        elif start and kind[i] in ("num", "str", "life", "close"):
            return "expression outside a function"
        elif start and kind[i] == "op" and text[i] not in ("#", ";"):
            return f"{text[i]} outside a function"
        elif start and kind[i] == "kw" and text[i] in ("let", "if", "while", "for", "match", "return", "loop", "else", "break", "continue", "self", "true", "false"):
            return f"{text[i]} outside a function"
        elif start and kind[i] == "id" and not (text[i] in ("union", "auto", "macro_rules", "default") or i + 1 < n and text[i + 1] in ("!", "::")):
            return f"{text[i]} outside a function"
        elif text[i] == ";":
            start = True
        elif text[i] == "#":
            start = False if not start else start
            if i + 1 < n and text[i + 1] in ("[", "!"):
                i = partner[i + 1] if text[i + 1] == "[" else partner[i + 2] if i + 2 < n and text[i + 2] == "[" else i
        else:
            start = False
        i += 1
    if not start and n and text[n - 1] not in ("}", ";"):
        return "unfinished item"
    return None


def _rust_head(t: Tokens, partner: list[int], i: int) -> bool:
    """The brace at i follows the condition of if, while, for or match, an arm, or a type."""
    depth = 0
    for j in range(i - 1, -1, -1):
        if t.kind[j] == "close":
            depth += 1
        elif t.kind[j] == "open":
            if depth == 0:
                return False
            depth -= 1
        elif depth == 0:
            if t.kind[j] == "kw" and t.text[j] in ("if", "while", "for", "match", "in", "extern"):
                return True
            if t.text[j] in (";", "{", "}"):
                return False
    return False


def _rust_block_end(t: Tokens, partner: list[int], a: int, b: int) -> str | None:
    """A let or an item statement inside the block must end with a semicolon."""
    last = None
    i = a + 1
    while i < b:
        if t.kind[i] == "open":
            i = partner[i]
            if t.text[i] == "}" and last in ("let",):
                pass
            elif t.text[i] == "}":
                last = None
        elif t.text[i] == ";":
            last = None
        elif t.kind[i] == "kw" and t.text[i] in ("let", "use", "const", "static", "type") and last is None and (i == a + 1 or t.text[i - 1] in (";", "{", "}", "pub", ")", "]")):
            last = t.text[i]
        elif last == "let" and t.kind[i] == "kw" and t.text[i] in ("while", "for", "return", "fn") and t.kind[i - 1] not in ("op", "open", "kw", "life"):
            return "let without ;"
        i += 1
    return f"{last} without ;" if last else None


def _rust_keyword(t: Tokens, partner: list[int], i: int, role: str) -> str | None:
    n, s = len(t.kind), t.text[i]
    nk, nx = (t.kind[i + 1], t.text[i + 1]) if i + 1 < n else ("", "")
    if s == "fn":
        if nk == "id":
            j = i + 2
            if j < n and t.text[j] == "<":
                d = 0
                while j < n:
                    d += (t.text[j] in ("<",)) - (t.text[j] == ">")
                    j += 1
                    if d <= 0:
                        break
            if j >= n or t.text[j] != "(":
                return "fn without parameters"
            c = partner[j]
            if c >= 0 and (c + 1 >= n or t.text[c + 1] not in ("->", "{", ";", "where")):
                return "fn without body"
            if c >= 0:
                d = 0
                for q in range(j + 1, c):
                    d += (t.kind[q] == "open" or t.text[q] == "<") - (t.kind[q] == "close" or t.text[q] == ">")
                # every parameter has a type, except self
                start, has = j + 1, False
                d = 0
                for q in range(j + 1, c + 1):
                    if q == c or d == 0 and t.text[q] == ",":
                        part = t.text[start:q]
                        if part and not has and "self" not in part and "..." not in part and "#" not in part:
                            return "parameter without type"
                        start, has = q + 1, False
                    elif t.kind[q] == "open" or t.text[q] == "<":
                        d += 1
                    elif t.kind[q] == "close" or t.text[q] == ">":
                        d -= 1
                    elif d == 0 and t.text[q] == ":":
                        has = True
            if c >= 0 and c + 1 < n and t.text[c + 1] == "->":
                q, d = c + 2, 0
                if q < n and t.text[q] in ("{", ";"):
                    return "-> without type"
                while q < n and not (d == 0 and t.text[q] in ("{", ";")):
                    d += (t.text[q] in ("(", "[")) - (t.text[q] in (")", "]"))
                    if t.text[q] == "}":
                        return "fn without body"
                    q += 1
                if q >= n:
                    return "fn without body"
        elif nx != "(" and nx != "<":
            return "fn without name"
    if s in ("struct", "enum", "trait", "mod") and nk != "id":
        return f"{s} without name"
    if s in ("struct", "enum", "trait") and nk == "id" and (i + 2 >= n or t.text[i + 2] not in ("{", "(", ";", "<", "where", ":")):
        return f"{s} without body"
    if s == "let" and (nk in ("op", "close") and nx not in ("&", "(", "[", "..", "-", "|", "::") or not nx):
        return "let without pattern"
    if s == "let" and nk in ("id", "kw"):
        j = i + 1
        while j < n and t.text[j] in ("mut", "ref"):
            j += 1
        if j + 1 < n and t.kind[j] == "id" and t.text[j + 1] not in ("=", ":", ";", "(", "{", "::", "|", "@", "!", ","):
            return f"let {t.text[j]} {t.text[j + 1]}"
    if s in ("if", "while", "match") and (nx in (")", "]", "}", ";", ",", "{") and not (s == "match" and False)):
        return f"{s} without condition"
    if s in ("if", "while", "match", "for", "loop", "else", "unsafe") and role == "{" or s in ("if", "while", "match"):
        if s == "else":
            if nx not in ("{", "if"):
                return "else without {"
            return None
        if s == "loop":
            return None if nx == "{" else "loop without {"
        if s in ("if", "while", "match", "for"):
            if s == "for" and (nx == "<" or i and t.kind[i - 1] in ("id", "close") or i and t.text[i - 1] == ">"):
                return None
            if s == "if" and i and t.kind[i - 1] not in ("op", "open", "close", "kw") or s == "if" and i and t.text[i - 1] in (")", "]"):
                return None  # a guard
            d = 0
            seen_in = False
            for j in range(i + 1, n):
                if t.kind[j] == "open":
                    if t.text[j] == "{" and d == 0:
                        return None if s != "for" or seen_in else "for without in"
                    d += 1
                elif t.kind[j] == "close":
                    d -= 1
                    if d < 0:
                        return None if s == "if" else f"{s} without body"
                elif d == 0:
                    seen_in = seen_in or t.text[j] == "in"
                    if t.text[j] == "=>" and s == "if":
                        return None
                    if t.text[j] == ";":
                        return f"{s} without body"
            return f"{s} without body"
    if s == "use" and nk not in ("id", "kw") and nx not in ("::", "{", "*", "<"):
        return "use"
    if s == "in" and (nk == "close" or nx in (";", ",")):
        return "in without value"
    if s == "as" and nk not in ("id", "kw") and nx not in ("*", "&", "(", "[", "<", "_", "::", "!"):
        return "as without type"
    return None


_SOL_TYPES = {"address", "bool", "string", "bytes", "mapping", "var", "fixed", "function"}
_SOL_AFTER_VALUE = set("memory storage calldata public private internal external view pure payable virtual override returns constant immutable indexed is as from anonymous if else while for catch return emit".split()) - {"if", "while", "for", "return", "emit"}
_SOL_UNITS = {"wei", "gwei", "ether", "seconds", "minutes", "hours", "days", "weeks"}
_SOL_NEED = set("+ - * / % ** = == != <= >= < > && || += -= *= /= %= &= |= ^= <<= >>= & | ^ << => ? :".split())


def check_solidity(t: Tokens, partner: list[int]) -> str | None:
    kind, text = t.kind, t.text
    n = len(kind)
    ctx: list[str] = []
    free_until = -1
    i = -1
    while i + 1 < n:
        i += 1
        k, s, p = kind[i], text[i], i - 1
        if k == "bad":
            return f"stray {s}"
        if k == "kw" and s == "pragma":
            while i < n and text[i] != ";":
                if text[i] in "{}":
                    return "pragma without ;"
                i += 1
            if i >= n:
                return "pragma without ;"
            continue
        if k == "open":
            ctx.append("(" if s != "{" else _sol_role(t, partner, i))
            if s == "{" and ctx[-1] == "assembly":
                free_until = max(free_until, partner[i])
            if i > free_until and p >= 0 and s in "({" and kind[p] in ("num", "str") and not (s == "{" and text[p] in _SOL_UNITS):
                return "value before bracket"
            continue
        if k == "close":
            role = ctx.pop()
            if i <= free_until:
                continue
            if p >= 0 and kind[p] == "op" and text[p] in _SOL_NEED | {"."}:
                return f"{text[p]} before {s}"
            if role == "block" and p >= 0 and text[p] not in ("{", "}", ";"):
                return "statement without ;"
            if s == ")" and p >= 0 and text[p] == "," and partner[i] > 0 and False:
                return ", before )"
            continue
        if i <= free_until:
            continue
        if p >= 0 and kind[p] == "op" and text[p] == "." and k not in ("id", "kw"):
            return f". {s}"
        role = ctx[-1] if ctx else "top"
        value = k in ("id", "num", "str") or k == "kw"
        if p >= 0 and value and (kind[p] in ("id", "num", "str") or kind[p] == "close" and text[p] in ")]" or kind[p] == "kw" and text[p] in ("this", "true", "false")):
            ok = (
                k == "kw" and s in _SOL_AFTER_VALUE
                or kind[p] == "num" and s in _SOL_UNITS
                or kind[p] == "id" and k == "id" and _sol_declares(t, p)
                or text[p] == "]" and k == "id" and _sol_declares(t, partner[p] - 1)
                or text[p] == ")" and (_sol_head(t, partner, p) or _sol_in_header(t, partner, i))
                or kind[p] == "id" and _sol_in_header(t, partner, i)
                or kind[p] == "str" and k == "str"
                or text[p] in ("from", "error", "unchecked") and kind[p] in ("id", "kw")
                or kind[p] == "str" and s in ("as",)
                or s == "for" and _sol_using(t, p)
            )
            if not ok:
                return f"{text[p]} {s}"
        if k == "op":
            if s in _SOL_NEED - {"-", "*", ":"} and (p < 0 or kind[p] == "open" and not (s in ("=>",)) or kind[p] == "op" and text[p] in _SOL_NEED | {",", ";"} and text[p] not in (">",)):
                return f"{text[p] if p >= 0 else ''} {s}"
            if s == ";" and role == "(" and not _for_head(t, partner, [], i):
                return "; in brackets"
            if s == ";" and p >= 0 and kind[p] == "op" and text[p] in _SOL_NEED:
                return f"{text[p]} ;"
            if s == "," and p >= 0 and kind[p] == "op" and text[p] in _SOL_NEED:
                return f"{text[p]} ,"
        if k == "kw":
            nx = text[i + 1] if i + 1 < n else ""
            nk = kind[i + 1] if i + 1 < n else ""
            if s == "function" and role != "(":
                if nk not in ("id",) and nx not in ("fallback", "receive", "(") or nk == "id" and (i + 2 >= n or text[i + 2] != "("):
                    return "function without parameters"
                if nk == "id":
                    c = partner[i + 2]
                    j, d = c + 1, 0
                    while 0 <= j < n and not (d == 0 and text[j] in ("{", ";")):
                        if kind[j] == "open":
                            d += 1
                        elif kind[j] == "close":
                            d -= 1
                            if d < 0:
                                return "function without body"
                        elif d == 0 and kind[j] == "op" and text[j] not in (".", ","):
                            return "function head"
                        elif d == 0 and kind[j] == "kw" and text[j] in ("function", "if", "for", "while", "return", "uint256"):
                            return "function without body"
                        j += 1
                    if j >= n:
                        return "function without body"
            if s in ("contract", "library", "interface", "struct", "enum", "event", "modifier") and nk != "id" and nx not in ("from",):
                return f"{s} without name"
            if s in ("contract", "library", "interface", "struct", "enum") and nk == "id" and (i + 2 >= n or text[i + 2] not in ("{", "is")):
                return f"{s} without body"
            if s in ("if", "while", "for") and nx != "(":
                return f"{s} without ("
            if s in ("if", "for") and nx == "(" and partner[i + 1] >= 0 and (partner[i + 1] + 1 >= n or kind[partner[i + 1] + 1] == "close"):
                return f"{s} without body"
            if s == "else" and (p < 0 or text[p] not in ("}", ";")):
                return "else without if"
            if s == "emit" and nk != "id":
                return "emit without event"
            if s == "returns" and nx != "(":
                return "returns without ("
            if s in ("let", "switch", "case"):
                return f"{s} outside assembly"
            if role == "top" and s in ("if", "while", "for", "return", "emit", "else"):
                return f"{s} outside a function"
    if n and text[n - 1] not in ("}", ";"):
        return "unfinished"
    return None


def _sol_using(t: Tokens, p: int) -> bool:
    while p >= 0 and t.text[p] not in (";", "{"):
        if t.text[p] == "using":
            return True
        p -= 1
    return False


def _sol_role(t: Tokens, partner: list[int], i: int) -> str:
    """block (statements), list (enum members, named arguments, imports), body (contract, struct) or assembly."""
    if i == 0:
        return "block"
    k, s = t.kind[i - 1], t.text[i - 1]
    if k == "open" and s == "(" or s in (",", "import") or k == "op" and s == "=":
        return "list"
    if s == "assembly" or k == "str" and i > 1 and t.text[i - 2] == "assembly":
        return "assembly"
    head = i
    for j in range(i - 1, -1, -1):
        if t.text[j] in (";", "{", "}"):
            break
        head = j
        if t.text[j] == "enum":
            return "list"
        if t.text[j] in ("contract", "library", "interface", "struct"):
            return "block"
    if k == "id" and not any(t.text[j] in ("contract", "library", "interface", "struct", "function", "modifier") for j in range(head, i)):
        return "list" if t.kind[i + 1 : i + 2] == ["id"] and t.text[i + 2 : i + 3] == [":"] else "block"
    return "block"


def _sol_declares(t: Tokens, p: int) -> bool:
    """The identifier at p is a type at the start of a declaration."""
    while p > 0 and t.text[p - 1] == "." and p >= 2:
        p -= 2
    if p < 0 or t.kind[p] not in ("id", "kw"):
        return False
    if p == 0:
        return True
    b, bk = t.text[p - 1], t.kind[p - 1]
    return b in ("{", "}", ";", "(", ",") or bk == "kw" and b in ("memory", "storage", "calldata", "public", "private", "internal", "external", "constant", "immutable", "indexed", "using", "returns", "override")


def _sol_head(t: Tokens, partner: list[int], p: int) -> bool:
    j = partner[p]
    return j > 0 and t.text[j - 1] in ("if", "while", "for", "catch", "mapping", "returns", "override") or j > 1 and t.text[j - 2] in ("catch",)


def _sol_in_header(t: Tokens, partner: list[int], i: int) -> bool:
    """Between a function's (constructor's, modifier's) parameters and its body; or a contract's head."""
    d = 0
    for j in range(i - 1, -1, -1):
        if t.kind[j] == "close":
            if t.text[j] == "}" and d == 0:
                return False
            d += 1
        elif t.kind[j] == "open":
            if d == 0:
                return False
            d -= 1
        elif d == 0:
            if t.text[j] in ("function", "constructor", "modifier", "fallback", "receive", "contract", "interface", "library") and t.kind[j] == "kw":
                return t.text[j] in ("contract", "interface", "library") or i - j > 2
            if t.text[j] in (";", "="):
                return False
    return False


_JSON_TOKEN = re.compile(r"[ \t\n\r]*(?:(?P<s>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")|(?P<v>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)|(?P<p>[\[\]{},:]))")


def check_json(text: str) -> str | None:
    """Strict JSON by a stack of its own, so at any depth."""
    at, stack, want = 0, [], "value"  # value, first (value or ]), key, first key (or }), colon, next (, or end)
    while m := _JSON_TOKEN.match(text, at):
        at = m.end()
        s = m.group("p")
        if want == "end":
            return "json: more after the value"
        if m.group("s") and want in ("key", "key1"):
            want = "colon"
        elif not s:
            if want not in ("value", "first"):
                return f"json: {m.group().strip()[:20]}"
            want = "next" if stack else "end"
        elif s in "[{":
            if want not in ("value", "first"):
                return f"json: {s}"
            stack.append(s)
            want = "first" if s == "[" else "key1"
        elif s in "]}":
            if not stack or OPEN[stack.pop()] != s or want not in ("next", "first" if s == "]" else "key1"):
                return f"json: {s}"
            want = "next" if stack else "end"
        elif s == ",":
            if want != "next":
                return "json: ,"
            want = "value" if stack[-1] == "[" else "key"
        elif want != "colon":
            return "json: :"
        else:
            want = "value"
    return None if want == "end" and not text[at:].strip(" \t\n\r") else "json: unfinished"


def check_python(text: str) -> str | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError) as e:
        return f"python: {str(e)[:60]}"
    except (RecursionError, MemoryError):
        return check_deep(text)
    return None


def check_deep(text: str) -> str | None:
    """Python nested deeper than the parser goes: the innermost brackets are parsed by themselves and leave a name."""
    from .pieces import _PY, _PY_END

    out: list[list[str]] = [[]]
    opened: list[str] = []
    at = 0
    while m := _PY.search(text, at):
        out[-1].append(text[at : m.start()])
        at = m.end()
        s = m.group()
        if q := m.group("tri"):
            e = _PY_END["s3d" if q == '"""' else "s3s"].match(text, at)
            if not e:
                return "python: unfinished string"
            out[-1].append(s + e.group())
            at = e.end()
        elif not m.group("br"):
            out[-1].append(s)
        elif s in OPEN:
            opened.append(s)
            out.append([])
        elif not opened or OPEN[opened[-1]] != s:
            return f"python: unmatched {s}"
        else:
            inner, o = "".join(out.pop()), opened.pop()
            part = f"{o}{inner}{s}"
            for tried in (part, f"_{part}", f"def _{part}: 0", f"class _{part}: 0", f"match _:\n case {part}: 0\n"):
                try:
                    ast.parse(tried)
                    break
                except SyntaxError:
                    continue
                except (RecursionError, MemoryError):
                    break
            else:
                return "python: brackets"
            out[-1].append(f"{o}_{s}" if inner.strip() else part)
    if opened:
        return f"python: {opened[-1]} is never closed"
    out[-1].append(text[at:])
    try:
        ast.parse("".join(out[-1]))
    except SyntaxError as e:
        return f"python: {str(e)[:60]}"
    except (RecursionError, MemoryError):  # a chain without brackets that is longer than the parser can go
        return None
    return None


def check_text(text: str, lang: str) -> str | None:
    """None if the text is valid, else what is wrong."""
    if lang == "json":
        try:
            json.loads(text, parse_constant=_refuse, parse_int=str, parse_float=str)
        except RecursionError:
            return check_json(text)
        except ValueError as e:
            return f"json: {str(e)[:60]}"
        return None
    text = text.removeprefix("﻿")
    if lang == "python":
        return check_python(text)
    p = lex(text, lang, known=True)
    if p.state != "code":
        return f"unfinished {p.state}"
    if conflict(p, text):
        return "merge conflict"
    return check_tokens(p.tokens, lang)


def check_tokens(t: Tokens, lang: str) -> str | None:
    if not t.kind:
        return None
    partner, why = brackets(t)
    if why:
        return why
    if lang == "rust":
        return check_rust(t, partner)
    if lang == "solidity":
        return check_solidity(t, partner)
    return check_js(t, partner, lang == "ts")


def conflict(p: Piece, text: str) -> bool:
    """A mark of a merge conflict that stands in code."""
    return bool(re.search(r"^(?:<{7}|>{7}|\|{7})(?: |$)|^={7}\r?$", text, re.M)) and _marker_in_code(p, text)


def _marker_in_code(p: Piece, text: str) -> bool:
    at = {i for i, x in enumerate(text.split("\n"), 1) if re.match(r"(?:<{7}|>{7}|\|{7})(?: |\r?$)|={7}\r?$", x)}
    return any(x in at and k == "op" for x, k in zip(p.tokens.line, p.tokens.kind))


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON value")


def checked(files: DataFrame, size: int = PIECE) -> DataFrame:
    """(file_id, repo_id, language, error): every file of a known language, error null where it is valid.  A file of one
    piece is checked where it is read; the pieces of a longer one become rows (``pieces.long_files``)."""
    rows = files.filter("file_id is not null and path is not null").select("file_id", F.coalesce("repo_id", F.lit("")).alias("repo_id"), F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).alias("ext"), F.coalesce("content", F.lit("")).alias("content"), F.col("content").isNull().alias("missing"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for file, repo, ext, text, missing in zip(b.file_id, b.repo_id, b.ext, b.content, b.missing):
                lang = EXTENSIONS[ext]
                if len(text) <= size:
                    out.append((file, repo, lang, None if missing else check_text(text, lang), -1, None))
                else:
                    out += [(file, repo, lang, None, i, x) for i, x in enumerate(cut_lines(text if lang == "json" else text.removeprefix("﻿"), size))]
            yield pd.DataFrame(out, columns=["file_id", "repo_id", "language", "error", "no", "text"])

    from .pieces import long_files

    read = stored(rows.filter(F.col("ext").isin(*EXTENSIONS)).mapInPandas(run, "file_id string, repo_id string, language string, error string, no long, text string"), "source-pieces")
    short = read.filter("no < 0").select("file_id", "repo_id", "language", "error")
    pieces = read.filter("no >= 0").select("file_id", "repo_id", "language", "no", "text")
    if pieces.limit(1).count():
        short = short.unionByName(long_files(pieces.dropDuplicates(["file_id", "no"])))
    return short.dropDuplicates(["file_id"])


def rates(files: DataFrame) -> DataFrame:
    """(repo_id, language, files, invalid, rate)."""
    bad = F.sum(F.col("error").isNotNull().cast("long"))
    return checked(files).groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("files"), bad.alias("invalid"), F.round(bad / F.count(F.lit(1)), 6).alias("rate"))
