"""Problem 5: functions and methods paired with their own documentation.

Island grammars: per language only documentation, attributes, signatures and balanced bodies are parsed; anything
else is water and is skipped token by token.  Nodes and chunks meet in one shuffle join on node_id; a function that
was cut into several chunks is put together by its part numbers first.

Defined results: a null node_id, content or name gives no pair; an unknown language gives none; repeated chunks
count once (the smallest chunk_id of each part); repeated nodes give one row; a documentation that is cut off by the
end of the text reaches to that end; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BY_EXT = {"py": "python", "pyi": "python", "rs": "rust", "ts": "js", "mts": "js", "cts": "js", "tsx": "js", "js": "js", "mjs": "js", "cjs": "js", "jsx": "js", "sol": "solidity"}
BY_NAME = {"python": "python", "rust": "rust", "typescript": "js", "javascript": "js", "solidity": "solidity"}

_MOD = {
    "rust": r"(?:pub(?:\s*\([^)]*\))?\s+|default\s+|const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*",
    "js": r"(?:export\s+|default\s+|declare\s+|public\s+|private\s+|protected\s+|static\s+|abstract\s+|override\s+|readonly\s+|async\s+|get\s+|set\s+|\*\s*)*",
    "solidity": "",
}
_ID = r"[A-Za-z_$][\w$]*"
_SIG = {
    "rust": re.compile(_MOD["rust"] + rf"fn\s+(?:r#)?({_ID})"),
    "js": re.compile(
        _MOD["js"]
        + rf"(?:function\s*\*?\s*({_ID})?|(?:const|let|var)\s+({_ID})\s*(?::[^=]*?)?=\s*(?:async\s*)?(?:function\b|\(|{_ID}\s*=>|<)|(?!(?:if|for|while|switch|catch|return|with)\b)(#?{_ID})\s*(?:<[^>()]*>)?\s*\((?=[^;]*\{{))"
    ),
    "solidity": re.compile(rf"(?:function\s+({_ID})|modifier\s+({_ID})|(constructor|fallback|receive)\s*\()"),
}
_LITERAL = {
    "rust": re.compile(r'b?r(#*)".*?"\1|b?"(?:\\.|[^"\\])*"|b?\'(?:\\.[^\']*|[^\'\\])\'', re.S),
    "js": re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?<=[=(,:;!&|?{}\[+])\s?/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*", re.S),
    "solidity": re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"),
}
_SPACE = re.compile(r"\s+")
_BLOCK = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_LINE = re.compile(r"//[^\n]*")
_WORD = re.compile(rf"{_ID}|\d[\w.]*")
_DOC_ATTR = re.compile(r'#!?\[\s*doc\s*=\s*(?:r(#*)"(.*?)"\1|"((?:\\.|[^"\\])*)")\s*\]', re.S)


def _attribute(text: str, at: int) -> int:
    """End of a bracketed attribute that opens at ``at``."""
    depth = 0
    for i in range(text.index("[", at), len(text)):
        depth += (text[i] == "[") - (text[i] == "]")
        if not depth:
            return i + 1
    return len(text)


def brace_islands(text: str, lang: str, name: str | None) -> str | None:
    """The raw documentation directly above the function ``name`` (the first function where none has the name)."""
    at, end, first = 0, len(text), None
    pending: list[str] = []
    statement = True
    while at < end:
        if m := _SPACE.match(text, at):
            if pending and m.group().count("\n") > 1:
                pending = []
            at = m.end()
            continue
        if text.startswith("/*", at):
            m = _BLOCK.match(text, at)
            raw = m.group()
            doc = raw.startswith("/**") and raw != "/**/" and not raw.startswith("/***")
            # a run of /** blocks: in Rust all count, elsewhere the last
            pending = (pending if lang == "rust" else []) + [raw] if doc else pending if lang == "rust" else []
            at = m.end()
            continue
        if text.startswith("//", at):
            m = _LINE.match(text, at)
            raw = m.group()
            if raw.startswith("///") and not raw.startswith("////"):
                pending = ([] if pending and not pending[-1].startswith("///") and lang != "rust" else pending) + [raw]
            elif lang != "rust":
                pending = []
            at = m.end()
            continue
        if lang == "rust" and (text.startswith("#[", at) or text.startswith("#![", at)):
            stop = _attribute(text, at)
            if m := _DOC_ATTR.match(text, at):
                inner = m.group(2) if m.group(2) is not None else m.group(3).replace('\\"', '"').replace("\\n", "\n")
                pending.append("///" + inner.replace("\n", "\n///"))
            at = stop
            continue
        if lang == "js" and text[at] == "@" and (m := re.compile(r"@[\w.$]+(?:\([^()]*\))?").match(text, at)):
            at = m.end()
            continue
        if statement and (m := _SIG[lang].match(text, at)):
            found = next((g for g in m.groups() if g), None)
            raw = "\n".join(pending)
            if name is None or found == name:
                return raw or None
            first = raw if first is None else first
            at, pending, statement = m.end(), [], False
            continue
        pending = []
        if m := _LITERAL[lang].match(text, at):
            at = m.end()
            statement = False
        elif m := _WORD.match(text, at):
            at = m.end()
            statement = False
        else:
            statement = text[at] in "{};"
            at += 1
    return first or None


_PY_DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)", re.M)
_PY_STR = re.compile(r"([rRuU]?)(\"\"\"|'''|\"|')")


def python_island(text: str, name: str | None) -> str | None:
    """The docstring of the function ``name`` (the first function where none has the name)."""
    defs = list(_PY_DEF.finditer(text))
    if not defs:
        return None
    m = next((d for d in defs if d.group(1) == name), defs[0])
    at, depth, end = m.end(), 0, len(text)
    while at < end:  # the signature, up to its colon
        c = text[at]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "#":
            at = text.find("\n", at) % (end + 1)
            continue
        elif c in "\"'":
            q = text[at : at + 3] if text[at : at + 3] in ('"""', "'''") else c
            stop = text.find(q, at + len(q))
            at = end if stop < 0 else stop + len(q)
            continue
        elif c == ":" and depth == 0:
            at += 1
            break
        at += 1
    while at < end and (w := re.compile(r"\s+|#[^\n]*").match(text, at)):
        at = w.end()
    m = _PY_STR.match(text, at)
    if not m:
        return None
    raw, quote = "r" in m.group(1).lower(), m.group(2)
    start = at = m.end()
    while at < end and not text.startswith(quote, at):
        if len(quote) == 1 and text[at] == "\n":
            return None
        at += 1 + (text[at] == "\\")
    body = text[start : min(at, end)]
    return body if raw else body.replace("\\\n", "").replace('\\"', '"').replace("\\'", "'")


def plain(raw: str, lang: str) -> list[str]:
    """The documentation's lines without comment marks, relative indentation kept."""
    if lang != "python":
        raw = re.sub(r"\s*\*+/\s*$", "", raw)
        raw = re.sub(r"\*+/\s*\n\s*/\*\*", "\n", raw)
        lines = [re.sub(r"^\s*(?:///|/\*\*+|\*(?!\*)|\*\*+(?=\s*$))?", "", x, count=1) if not re.match(r"\s*\*{3,}", x) else x for x in raw.split("\n")]
    else:
        lines = raw.split("\n")
        rest = [len(x) - len(x.lstrip()) for x in lines[1:] if x.strip()]
        cut = min(rest, default=0)
        lines = [lines[0].lstrip(), *(x[cut:] for x in lines[1:])]
    return [x.expandtabs(4).rstrip() for x in lines]


_SECTION = r"(?:(?:other|keyword|type)\s+)?(?:args?|arguments?|params?|parameters?|returns?|return values?|yields?|raises?|throws?|exceptions?|errors?|panics|attributes|keyword args)"
_SECTION_HEAD = re.compile(rf"^\s*(?:#+\s*)?(?:\*\*)?{_SECTION}(?:\*\*)?\s*:?\s*(?:\*\*)?\s*$", re.I)
_ANY_HEAD = re.compile(r"^\s*#{1,6}\s+\S")
_GOOGLE_HEAD = re.compile(r"^\s*[A-Z][A-Za-z ]{2,24}:\s*$")
_RULE = re.compile(r"^\s*[-=~^*_#.+\s]*$")
_TAG = re.compile(r"^\s*(?:[@\\](\w+)\b|:(\w+)(?:\s[^:\n]*)?:)\s*(.*)$")
_PLACEHOLDER = re.compile(
    r"^\W*(?:(?:todo|fixme|xxx|tbd|tba|hack|wip|placeholder)\b.*|(?:add|write|insert|put)\s+(?:a\s+|the\s+|some\s+|your\s+)?(?:docs?|docstring|documentation|description|comment|text|summary)\b(?:\s+(?:for|of)\s+\w+)*(?:\s+\w+){0,3}"
    r"|(?:docs?|documentation|description|docstring|text|summary)\s+(?:goes|go|comes|to\s+(?:come|follow|be)|will|is\s+missing|missing|pending|needed)\b.*|(?:to\s+be\s+(?:documented|written|described|done|added|filled)|needs?\s+(?:docs?|documentation|a\s+description))\b.*"
    r"|(?:document|describe)\s+(?:this|me|it)\b.*|lorem\s+ipsum.*|(?:no|missing)\s+(?:description|documentation|docs?)\b.{0,30}|see\s+above\W*|n/?a\W*|\.\.\.|(?:internal|helper|getter|setter|utility function)\W*)$",
    re.I,
)
_DIRECTIVE = re.compile(
    r"^\W*(?:eslint-(?:disable|enable|env)\S*|prettier-ignore\S*|noqa\b|no ?cover\b|pragma:|pylint:|flake8[:-]|type:\s*ignore|mypy:|pyright:|ruff:|isort:|fmt:|yapf:|black:|istanbul\s+ignore|c8\s+ignore|v8\s+ignore|@?ts-(?:ignore|expect-error|nocheck)|tslint:|jshint\b|jslint\b|standard-|biome-ignore|deno-lint|webpack\w*:|@__PURE__|#__PURE__|nosec\b|nosonar\b|rustfmt::|rustfmt-|clippy::|cfg_attr|allow\(|solhint-|slither-|forge-|spell-?checker:|cspell:|codespell|sourcery|type-check|lint:|vim?:|region\b|endregion\b|coverage:).*$",
    re.I,
)
_ARTICLES = {"a", "an", "the"}
_TOKEN = re.compile(r"[^\W_]+")


def description(lines: list[str]) -> str:
    """What is left without tag lines, headings, and sections for parameters, returns and errors."""
    kept: list[str] = []
    section: int | None = None  # indentation of the section's heading; -1: up to the next heading
    tag: int | None = None
    for i, line in enumerate(lines):
        text = line.strip()
        indent = len(line) - len(line.lstrip())
        nxt = lines[i + 1].strip() if i + 1 < len(lines) else ""
        if _SECTION_HEAD.match(line):
            under = bool(nxt) and len(nxt) >= 3 and set(nxt) <= {"-", "="}
            section, tag = -1 if under or text.startswith("#") else indent, None
            continue
        if _ANY_HEAD.match(line) or _GOOGLE_HEAD.match(line) and section is not None and indent <= max(section, 0) or bool(text) and len(nxt) >= 3 and set(nxt) <= {"-", "="} and len(text.split()) <= 3:
            section = tag = None
            continue
        if section is not None:
            if section == -1 or not text or indent > section:
                continue
            section = None
        if m := _TAG.match(line):
            tag = indent
            if (m.group(1) or "").lower() == "notice":
                tag = None
                kept.append(m.group(3))
            continue
        if tag is not None:
            if text and indent > tag:
                continue
            tag = None
        kept.append(text)
    return "\n".join(kept)


def is_trivial(lines: list[str], name: str | None) -> bool:
    left = [x for x in description(lines).split("\n") if not _DIRECTIVE.match(x) and not _RULE.match(x)]
    if not left:
        return True
    if _PLACEHOLDER.match(left[0]) and _placeholder_only(left):
        return True
    left = [x for x in left if not _PLACEHOLDER.match(x)]
    text = "\n".join(left)
    words = [w for w in text.split() if _TOKEN.search(w)]
    # scripts without spaces: each letter is counted as a word
    count = len(words) + sum(1 for c in text if "぀" <= c <= "ヿ" or "一" <= c <= "鿿") // 2
    if count < 4:
        return True
    parts = {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name or "")}
    said = {w.lower() for w in _TOKEN.findall(text)}
    return bool(parts) and said <= parts | _ARTICLES


def _placeholder_only(left: list[str]) -> bool:
    return all(_PLACEHOLDER.match(x) or not _TOKEN.search(x) for x in left)


def extract(text: str, lang: str | None, name: str | None) -> str | None:
    """Cleaned documentation of a function that has some that says something, else None."""
    raw = python_island(text, name) if lang == "python" else brace_islands(text, lang, name) if lang in _SIG else None
    if raw is None:
        return None
    lines = plain(raw, lang)
    return None if is_trivial(lines, name) else "\n".join(lines).strip()


def pairs(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(node_id, name, language, documentation, code): one row per documented function or method."""
    part = F.coalesce(F.get_json_object("metadata", "$.part").cast("int"), F.lit(1))
    wanted = (
        nodes.filter(F.col("kind").isin("function", "method") & F.col("node_id").isNotNull() & F.col("name").isNotNull())
        .groupBy("node_id")
        .agg(F.min(F.struct("name", F.coalesce("file_path", F.lit("")).alias("path"), F.coalesce(F.get_json_object("metadata", "$.language"), F.lit("")).alias("lang"))).alias("n"))
    )
    text = (
        chunks.filter("node_id is not null and content is not null")
        .select("node_id", part.alias("part"), F.struct("chunk_id", "content").alias("c"))
        # this spreads by node_id, as all that follows needs, so texts are sent once
        .join(wanted.select("node_id"), "node_id", "left_semi")
        .groupBy("node_id", "part")
        .agg(F.min("c").alias("c"))
        # a function's own parts: as many as its metadata counts
        .groupBy("node_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "c.content"))), lambda x: x["content"]), "\n").alias("code"))
    )
    rows = wanted.join(text, "node_id").select("node_id", F.col("n.name").alias("name"), F.col("n.path").alias("path"), F.col("n.lang").alias("lang"), "code")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            langs = [BY_EXT.get(p.rpartition(".")[2].lower()) or BY_NAME.get(n.lower()) for p, n in zip(b.path, b.lang)]
            docs = [extract(c, lang, n) for c, lang, n in zip(b.code, langs, b.name)]
            out = pd.DataFrame({"node_id": b.node_id, "name": b.name, "language": langs, "documentation": docs, "code": b.code})
            yield out[out.documentation.notna()]

    return rows.mapInPandas(run, "node_id string, name string, language string, documentation string, code string")
