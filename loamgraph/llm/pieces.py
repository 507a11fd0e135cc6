"""Pieces of long source files as maps of the lexer's state, combined across partitions.

A piece is a set of *nodes*: what lexing the piece from a state, or from a place in it, gives: the state at its end, the
brackets it leaves open, and the closing brackets that belong to what was opened before.  A closing bracket that may
end a template's expression or a comment that was opened before the piece leads to a node of its own, which is where
lexing goes on if it does.  Such maps combine associatively (``combine``): pieces are reduced in groups of ``FAN`` by
rounds, the states at which every piece begins come back down the same way, and only then are tokens made, of every
piece by itself.  No task holds more of a file than one piece, but for the tokens that a local grammar reads.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import syntax as X

FAN = 256
_TRIPLE = {"s3d": '"""', "s3s": "'''"}
_PY = re.compile(r"#[^\n\r]*|(?:[rRbBuUfFtT]{0,2})(?P<tri>\"\"\"|''')|\"(?:\\[\s\S]|[^\"\\\n\r])*\"?|'(?:\\[\s\S]|[^'\\\n\r])*'?|(?P<br>[(){}\[\]])")
_PY_END = {k: re.compile(r"(?:\\[\s\S]|(?!" + v + r")[^\\])*" + v) for k, v in _TRIPLE.items()}
_JSON = re.compile(r"\"(?:\\.|[^\"\\\n\r])*\"|(?P<br>[(){}\[\]])")


def _plain(text: str, rx: re.Pattern, state: str, at: int) -> list:
    """Brackets of Python or JSON."""
    openers, closers = [], []
    while at < len(text):
        if state != "code":
            m = _PY_END[state].match(text, at)
            if not m:
                return [state, openers, closers, 0]
            state, at = "code", m.end()
        m = rx.search(text, at)
        if not m:
            break
        at = m.end()
        if s := m.groupdict().get("tri"):
            state = "s3d" if s == '"""' else "s3s"
        elif s := m.group("br"):
            if s in X.OPEN:
                openers.append(s)
            elif not openers:
                closers.append([s, ""])
            elif X.OPEN[openers.pop()] != s:
                return [state, [], [], 1]
    return [state, openers, closers, 0]


def _node(text: str, lang: str, state: str, at: int) -> list:
    """[state at the end, brackets left open, [closing bracket, where to go on if it ends more than a bracket], bad]."""
    if lang == "python":
        return _plain(text, _PY, state, at)
    if lang == "json":
        return _plain(text, _JSON, state, at)
    if state == "block":
        openers, closers = [], []
        for m in X._NEST.finditer(text, at):
            if m.group() == "/*":
                if lang == "rust":
                    openers.append("/*")
            elif openers:
                openers.pop()
            else:
                closers.append(["*/", f"code@{m.end()}"])
                if lang != "rust":
                    break
        return ["block", openers, closers, 0]
    closers: list = []
    p = X.lex(text, lang, state, 0, [], False, at, closers=closers)
    marks = ["/*0", *["/*"] * (p.depth - 1)] if p.state == "block" else []
    return [p.state, p.stack + marks, closers, int(p.state == "bad")]


def piece_map(text: str, lang: str, no: int) -> dict:
    """All nodes that any state at the piece's start can lead to."""
    entries = {"js": ["code", "block", "template"], "ts": ["code", "block", "template"], "solidity": ["code", "block"], "json": ["code"], "python": ["code", "s3d", "s3s"]}.get(lang)
    if entries is None:
        most = max((len(m.group(1)) for m in re.finditer(r"\"(#*)", text)), default=0)
        entries = ["code", "block", "string", *[f"raw:{k}" for k in range(most + 1)]]
    nodes: dict = {}
    todo = [f"{e}@0" for e in entries]
    while todo:
        at = todo.pop()
        if f"{no}:{at}" in nodes:
            continue
        state, _, off = at.rpartition("@")
        made = _node(text, lang, state, int(off))
        for c in made[2]:
            if lang in ("js", "ts") and c[0] == "}":
                # the same node for all that lead to the same mark of the template
                c[1] = f"template@{X._TEMPLATE.match(text, c[1]).end()}"
            if c[1]:
                todo.append(str(c[1]))
                c[1] = f"{no}:{c[1]}"
        nodes[f"{no}:{at}"] = made
    return {"first": no, "nodes": nodes}


def run(m: dict, state: str, stack: list[str], node: str | None = None) -> list:
    """[state, stack, closing brackets left over, bad] after the map's pieces; ``stack`` is what was open before."""
    node = node or f"{m['first']}:{state}@0"
    if node not in m["nodes"]:
        if state.startswith("raw:"):  # no such end in the piece
            return [state, stack, [], 0]
        return [state, stack, [], 1]
    stack = list(stack)
    while True:
        end, openers, closers, bad = m["nodes"][node]
        if bad:
            return [end, [], [], 1]
        for j, (c, to) in enumerate(closers):
            if not stack:
                return [end, list(openers), closers[j:], 0]
            top = stack.pop()
            if c == "*/":
                if top == "/*0":
                    node = to
                    break
            elif c == "}" and top == "${":
                node = to
                break
            elif X.OPEN.get(top) != c:
                return [end, [], [], 1]
        else:
            return [end, stack + list(openers), [], 0]


def combine(a: dict, b: dict) -> dict:
    """The map of a's pieces followed by b's."""
    nodes: dict = {}
    need: list[str] = []
    for k, (end, openers, closers, bad) in a["nodes"].items():
        if bad:
            nodes[k] = [end, [], [], 1]
            continue
        end, stack, left, bad = run(b, end, openers)
        nodes[k] = [end, stack, [*closers, *left], bad]
        need += [c[1] for c in left if c[1]]
    while need:
        k = need.pop()
        if k not in nodes:
            nodes[k] = b["nodes"][k]
            need += [c[1] for c in nodes[k][2] if c[1]]
    return {"first": a["first"], "nodes": nodes}


def _fold(maps: list[dict]) -> dict:
    while len(maps) > 1:
        maps = [combine(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def long_files(pieces: DataFrame) -> DataFrame:
    """(file_id, repo_id, language, error) of files given in pieces (file_id, repo_id, language, no, text)."""
    key = ["file_id", "repo_id", "language"]

    def mapped(batches):
        for b in batches:
            yield pd.DataFrame({**{c: b[c] for c in key}, "no": b.no, "map": [json.dumps(piece_map(t, lang, n)) for t, lang, n in zip(b.text, b.language, b.no)]})

    def up(name: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("no")
        return pd.DataFrame([(*name, json.dumps(_fold([json.loads(m) for m in b["map"]])))], columns=[*key, "no", "map"])

    def down(name: tuple, begin: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not len(begin):
            return pd.DataFrame(out, columns=[*key, "no", "state"])
        state, stack = json.loads(begin.iloc[0, -1])
        for no, m in sorted(zip(b.no, b["map"])):
            out.append((*name[:3], no, json.dumps([state, stack])))
            state, stack, _, bad = run(json.loads(m), state, stack)
            if bad:
                break
        return pd.DataFrame(out, columns=[*key, "no", "state"])

    schema, state_schema = "file_id string, repo_id string, language string, no long, map string", "file_id string, repo_id string, language string, no long, state string"
    levels = [stored(pieces.mapInPandas(mapped, schema), "piece-maps")]
    group = F.floor(F.col("no") / FAN).alias("no_up")
    most = levels[0].agg(F.max("no")).first()[0]
    while most:
        levels.append(stored(levels[-1].groupBy(*key, group).applyInPandas(up, schema), "piece-maps"))
        most //= FAN

    def verdict(m: str) -> str | None:
        state, stack, left, bad = run(json.loads(m), "code", [])
        if bad or left or any(x[0] != "/" for x in stack):
            return "unmatched brackets"
        return f"unfinished {state}" if state != "code" else None

    def decided(batches):
        for b in batches:
            yield pd.DataFrame({**{c: b[c] for c in key}, "error": [verdict(m) for m in b["map"]]})

    whole = stored(levels[-1].mapInPandas(decided, "file_id string, repo_id string, language string, error string"), "piece-verdicts")
    # the standard grammar has the last word on Python, whose strings may hold expressions
    open_ = whole.filter("error is null or language = 'python'").select("file_id")
    state = levels[-1].select(*key, "no", F.lit('["code", []]').alias("state"))
    for lower in reversed(levels[:-1]):
        above = state.select(*[F.col(c).alias(f"u_{c}") for c in key], F.col("no").alias("u_no"), "state")
        state = stored(above.groupBy("u_file_id", "u_repo_id", "u_language", "u_no").cogroup(lower.groupBy(*key, group)).applyInPandas(down, state_schema), "piece-states")

    def tokens(batches):
        for b in batches:
            out = []
            for lang, text, begin in zip(b.language, b.text, b.state):
                if lang in ("python", "json"):
                    out.append((text, [], [], [], 0, False))
                    continue
                now, stack = json.loads(begin)
                depth = sum(x[0] == "/" for x in stack)
                p = X.lex(text, lang, now, depth, [x for x in stack if x[0] != "/"], True)
                out.append(("", p.tokens.kind, p.tokens.text, p.tokens.line, p.lines, X.conflict(p, text)))
            yield pd.concat([b[[*key, "no"]].reset_index(drop=True), pd.DataFrame(out, columns=["text", "kinds", "texts", "at", "lines", "conflict"])], axis=1)

    def grammar(name: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b, lang = b.sort_values("no"), name[2]
        if lang in ("python", "json"):
            why = X.check_text("".join(b.text), lang)
        else:
            t, lines = X.Tokens(), 0
            for kinds, texts, at, n in zip(b.kinds, b.texts, b["at"], b.lines):
                t.extend(X.Tokens(list(kinds), list(texts), list(at)), lines)
                lines += n
            why = "merge conflict" if b.conflict.any() else X.check_tokens(t, lang)
        return pd.DataFrame([(*name, why)], columns=[*key, "error"])

    lexed = pieces.join(open_, "file_id", "left_semi").join(state, [*key, "no"]).mapInPandas(
        tokens, "file_id string, repo_id string, language string, no long, text string, kinds array<string>, texts array<string>, at array<int>, lines int, conflict boolean"
    )
    rest = lexed.groupBy(*key).applyInPandas(grammar, "file_id string, repo_id string, language string, error string")
    return rest.unionByName(whole.filter("error is not null and language <> 'python'"))
