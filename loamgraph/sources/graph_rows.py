"""Graph rows of source trees: nodes, edges and chunks of every file in one pass over its text.

A node is named by its stable id within the repository and its id is derived from that, so rows made in different
tasks fit together: no id has to be handed out, and duplicates of a node are simply rows of one key.  What needs other
files, a call to a symbol defined elsewhere, is resolved by equi-joins afterwards.

Defined results: a file that does not parse has its file node only; null texts and paths that are not indexed have no
rows; of several nodes of one stable id the first by path and place counts; an edge from a node to itself is dropped.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
import tomllib
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from . import extract as X

# Manifests that are read, and the sections of their dependencies.
MANIFESTS = ("Cargo.toml", "package.json", "cdk.json", "tsconfig.json", "jsconfig.json")
CARGO_SECTIONS = ("dependencies", "dev-dependencies", "build-dependencies")
NPM_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
GUIDANCE = "Documentation can add context but source code should be prioritized when they disagree."
# Kinds of nodes that a call can come from or go to.
CODE_KINDS = {"function", "struct", "trait", "enum", "type_alias", "module", "test", "concept"}
PART_BYTES = 2000

_ROW = ["repo_id", "path", "seq", "record", "kind", "stable_id", "name", "line_start", "line_end", "metadata", "source", "target", "cost", "confidence", "content"]
_SCHEMA = "repo_id string, path string, seq int, record string, kind string, stable_id string, name string, line_start int, line_end int, metadata string, source string, target string, cost double, confidence double, content string"


def plain_json(x: object) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def language_of(path: str) -> str | None:
    name = path.rpartition("/")[2]
    ext = name.rpartition(".")[2] if "." in name else ""
    if ext in ("ts", "tsx", "mts", "cts"):
        return "typescript"
    if ext in ("js", "jsx", "mjs", "cjs"):
        return "javascript"
    return {"md": "markdown", "mdx": "markdown", "sol": "solidity", "pdf": "pdf", "py": "python", "pyi": "python"}.get(ext.lower()) or ("rust" if ext == "rs" else None)


def _first_line(text: str, needle: str) -> int | None:
    return next((i for i, x in enumerate(text.splitlines(), 1) if needle in x), None)


class _File:
    """Rows of one file, in order."""

    def __init__(self, repo: str, path: str, text: str, workspace: set[str]):
        self.repo, self.path, self.text, self.workspace = repo, path, text, workspace
        self.rows: list[tuple] = []
        self.symbols: list[tuple[str, str, int, int]] = []  # name, stable id, lines
        self.names: dict[str, str] = {}
        self.lines = text.splitlines()
        self.me = f"file:{path}"

    def _add(self, record: str, kind: str, sid: str | None = None, name: str | None = None, lines: tuple = (None, None), meta: dict | None = None, source: str | None = None, target: str | None = None, weight: str | None = None, content: str | None = None) -> None:
        cost, confidence = V.EDGE_WEIGHTS[weight] if weight else (None, None)
        self.rows.append((self.repo, self.path, len(self.rows), record, kind, sid, name, *lines, plain_json(meta if meta is not None else {}), source, target, cost, confidence, content))

    def node(self, kind: str, sid: str, name: str, lines: tuple, meta: dict) -> None:
        self._add("node", kind, sid, name, lines, meta)

    def edge(self, kind: str, source: str, target: str, weight: str, meta: dict | None = None) -> None:
        self._add("edge", kind, source=source, target=target, weight=weight, meta=meta)

    def chunk(self, kind: str, sid: str, content: str, lines: tuple, meta: dict) -> None:
        for part, more in split_content(kind, content, meta):
            self._add("chunk", kind, sid, lines=lines, meta=more, content=part)

    def file_node(self, language: str, weight: str, meta: dict | None = None) -> None:
        self.node("file", self.me, self.path, (1, len(self.lines)), {"path": self.path, "language": language})
        self.edge("contains", "repo", self.me, weight, meta)

    def code(self, first: int, last: int) -> str:
        return "\n".join(self.lines[first - 1 : last])

    def symbol(self, kind: str, name: str, sid: str, first: int, last: int, meta: dict, chunk_meta: dict, edge: tuple[str, str, dict], head: str) -> None:
        self.node(kind, sid, name, (first, last), meta)
        self.edge(edge[0], self.me, sid, edge[1], edge[2])
        self.chunk(kind, sid, f"{head}Lines: {first}-{last}\n\n{self.code(first, last)}", (first, last), chunk_meta)
        self.names.setdefault(name, sid)
        if kind in CODE_KINDS:
            self.symbols.append((name, sid, first, last))

    def imported(self, module: str, language: str, weight: str, line: int) -> None:
        bare = not module.startswith((".", "/", "~/", "@/"))
        if language in ("javascript", "typescript") and bare:
            parts = module.split("/")
            package = "/".join(parts[:2]) if module.startswith("@") else parts[0]
            if not {package, module} & self.workspace:
                return
        sid = f"import:bare:{module}" if bare else f"{self.path}:import:{hashlib.sha256(module.encode()).hexdigest()}"
        self.node("dependency", sid, module, (None, None) if bare else (line, line), {"module": module, "language": language, "scope": "bare" if bare else "relative"})
        self.edge("imports", self.me, sid, weight, {"file": self.path, "module": module, "line": line})

    def calls(self, found: list[tuple[str, int]]) -> None:
        """Call sites inside a symbol of this file: resolved here if the callee is here too, else left to a join."""
        by_name: dict[str, str] = {}
        for name, sid, _, _ in self.symbols:
            by_name.setdefault(name, sid)
        for callee, line in found:
            inside = [(last - first, i) for i, (_, _, first, last) in enumerate(self.symbols) if first <= line <= last]
            if inside:
                caller = self.symbols[min(inside)[1]][1]
                self._add("call", "ast_call_site", name=callee, source=caller, target=by_name.get(callee))


def split_content(kind: str, content: str, meta: dict, size: int = PART_BYTES) -> list[tuple[str, dict]]:
    """The chunk, or its parts if it is longer than ``size`` bytes: whole lines, longer lines cut between characters; every
    part begins with what it is a part of."""
    if len(content.encode()) <= size:
        return [(content, meta)]
    parts: list[str] = []
    now = ""
    for line in content.splitlines():
        width = len(line.encode())
        if now and len(now.encode()) + width + 1 > size:
            parts.append(now.rstrip())
            now = ""
        if width <= size:
            now += line + "\n"
            continue
        piece, used = "", 0
        for c in line:
            n = len(c.encode())
            if piece and used + n > size:
                parts.append(piece)
                piece, used = "", 0
            piece, used = piece + c, used + n
        if piece:
            parts.append(piece)
    if now.strip():
        parts.append(now.rstrip())
    parent = hashlib.sha256(content.encode()).hexdigest()
    head = f"Chunk type: {kind}\nFile: {meta.get('file', 'unknown')}\nSymbol: {meta.get('symbol', 'unknown')}"
    return [(f"{head}\nChunk part: {i}/{len(parts)}\n\n{p}", meta | {"split_part": i, "split_total": len(parts), "parent_content_hash": parent}) for i, p in enumerate(parts, 1)]


# -- manifests and documents ---------------------------------------------------------------------------------
def _cargo(f: _File) -> None:
    f.file_node("rust", "contains_code")
    try:
        data = tomllib.loads(f.text)
    except (tomllib.TOMLDecodeError, RecursionError):
        return
    for section in CARGO_SECTIONS:
        for name in sorted(data[section]) if isinstance(data.get(section), dict) else ():
            sid, at = f"{f.path}:cargo:dependency:{name}", _first_line(f.text, name)
            f.edge("depends_on", f.me, sid, "depends_on")
            f.chunk("dependency", sid, f"File: {f.path}\nDependency: {name}\nSection: {section}\n", (at, at), {"dependency": name, "section": section})
            f.node("dependency", sid, name, (at, at), {"section": section})


def _package(f: _File) -> None:
    f.file_node("json", "contains_code")
    try:
        data = json.loads(f.text)
    except (ValueError, RecursionError):
        return
    data = data if isinstance(data, dict) else {}
    text = lambda v: v if isinstance(v, str) else ""
    names, lines = [], []
    for section in NPM_SECTIONS:
        for name, version in sorted(data[section].items()) if isinstance(data.get(section), dict) else ():
            sid, at = f"{f.path}:npm:dependency:{name}", _first_line(f.text, name)
            f.node("dependency", sid, name, (at, at), {"ecosystem": "npm", "section": section, "version": version})
            f.edge("depends_on", f.me, sid, "depends_on")
            names.append(name)
            lines.append(f"- {name}@{text(version)} ({section})")
    if names:
        f.chunk("dependency", f.me, f"File: {f.path}\nEcosystem: npm\nDependencies ({len(names)}):\n" + "\n".join(lines) + "\n", (None, None), {"ecosystem": "npm", "dependency": names})
    names, lines = [], []
    for name, command in sorted(data["scripts"].items()) if isinstance(data.get("scripts"), dict) else ():
        sid, at = f"{f.path}:npm:script:{name}", _first_line(f.text, name)
        f.node("script", sid, f"npm script {name}", (at, at), {"ecosystem": "npm", "script": name, "command": command})
        f.edge("defines", f.me, sid, "defines_script")
        names.append(name)
        lines.append(f"- {name}: {text(command)}")
    if names:
        f.chunk("script", f.me, f"File: {f.path}\nNPM scripts ({len(names)}):\n" + "\n".join(lines) + "\n", (None, None), {"ecosystem": "npm", "script": names})


def _cdk_json(f: _File) -> None:
    f.file_node("json", "contains_code")
    try:
        data = json.loads(f.text)
    except (ValueError, RecursionError):
        data = {}
    app = data.get("app") if isinstance(data, dict) else None
    app = app if isinstance(app, str) else ""
    sid, lines = f"{f.path}:aws-cdk:app", (_first_line(f.text, "app") or 1, len(f.lines))
    f.node("deployment_resource", sid, "AWS CDK app", lines, {"technology": "aws_cdk", "config": f.path, "app": app})
    f.edge("configures", f.me, sid, "configures_app", {"technology": "aws_cdk"})
    f.chunk("aws_cdk_app", sid, f"Technology: AWS CDK\nFile: {f.path}\nCDK app command: {app}\n\n{f.text}", lines, {"technology": "aws_cdk", "kind": "cdk_app", "file": f.path, "app": app})


def _json_config(f: _File) -> None:
    f.file_node("json", "contains_code")
    f.chunk("config", f.me, f"File: {f.path}\nJavaScript/TypeScript configuration:\n\n{f.text}", (1, len(f.lines)), {"config": f.path})


def _markdown(f: _File) -> None:
    f.file_node("markdown", "contains_doc", {"source_priority": "supplemental"})
    f.chunk("documentation", f.me, f"Documentation file: {f.path}\n\n{f.text}", (1, len(f.lines)), {"kind": "documentation", "file": f.path, "source_priority": "supplemental", "guidance": GUIDANCE})


def _pdf(f: _File) -> None:
    """``text`` is what a reader of the format gave; without any there is no chunk."""
    f.file_node("pdf", "contains_pdf", {"source_priority": "supplemental", "extractor": "pdf_text"})
    if f.text.strip():
        f.chunk("pdf_documentation", f.me, f"PDF document: {f.path}\n\n{f.text}", (1, max(1, len(f.lines))), {"kind": "documentation", "file": f.path, "source_priority": "supplemental", "format": "pdf", "guidance": GUIDANCE.replace("Documentation", "PDF text")})


# -- languages -----------------------------------------------------------------------------------------------
def _test_name(name: str) -> bool:
    low = name.lower()
    return low.startswith(("test", "spec")) or low.endswith(("test", "spec"))


def _symbol(f: _File, kind: str, name: str, first: int, last: int, language: str, label: str | None = None, extra: dict | None = None, chunk_extra: dict | None = None, edge_meta: dict | None = None) -> None:
    f.symbol(
        kind, name, f"{f.path}:{kind}:{name}", first, last, {"language": language, "file": f.path, **(extra or {})}, {"symbol": name, "kind": kind, "file": f.path, **(chunk_extra or {})},
        ("contains", "contains_code", edge_meta or {}), f"Language: {'Rust' if language == 'rust' else language}\nFile: {f.path}\nSymbol: {name}\nKind: {label or kind}\n",
    )


def _python(f: _File) -> None:
    f.file_node("python", "contains_code")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(f.text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    low = f.path.lower()
    tests = low.endswith("_test.py") or "/test_" in low or low.startswith("test_") or "/tests/" in low

    def walk(body: list[ast.stmt]) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                word = "class" if isinstance(n, ast.ClassDef) else "function"
                kind = "test" if tests or _test_name(n.name) else "struct" if word == "class" else "function"
                _symbol(f, kind, n.name, n.lineno, n.end_lineno, "python", word, {"python_kind": word}, {"python_kind": word}, {"language": "python", "kind": word})
                walk(n.body)
            elif isinstance(n, ast.Import):
                for a in n.names:
                    f.imported(a.name, "python", "imports_module", n.lineno)
            elif isinstance(n, ast.ImportFrom) and (module := "." * n.level + (n.module or "")):
                f.imported(module, "python", "imports_module", n.lineno)

    walk(tree.body)
    calls = [n for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute))]
    f.calls([(c.func.id if isinstance(c.func, ast.Name) else c.func.attr, c.lineno) for c in sorted(calls, key=lambda c: (c.lineno, c.col_offset))])


_RUST_ITEM = re.compile(r"\b(?:(fn|struct|enum|trait|mod)\s+(?:r#)?(\w+)|(impl)\b|(use)\s+([^;]+);)")
_HEAD = re.compile(r"[{;]")


def _depths(plain: str) -> list[int]:
    """Depth of braces before every character."""
    out, d = [], 0
    for c in plain:
        if c == "}":
            d -= 1
        out.append(d)
        if c == "{":
            d += 1
    return out


def _use_text(tree: str) -> str:
    """The use tree with groups as plain lists."""
    tree = re.sub(r"\s+", " ", tree.replace("\n", " ")).strip()
    tree = re.sub(r"\s*::\s*", "::", tree)
    return re.sub(r"\s*,\s*", ", ", re.sub(r",?\s*\}", "", re.sub(r"\{\s*", "", tree))).strip()


def _item_line(lines: list[str], word: str, name: str) -> int:
    rx = re.compile(rf"(?<!\w){re.escape(word)}[ \t\r\f]+{re.escape(name)}(?!\w)")
    return next((i for i, x in enumerate(lines, 1) if rx.search(x)), None) or next((i for i, x in enumerate(lines, 1) if name in x), None) or 1


def _block_last(lines: list[str], first: int) -> int:
    """Braces count wherever they stand; an item without any ends at a line that ends in a semicolon."""
    depth, seen = 0, False
    for i in range(first - 1, len(lines)):
        seen = seen or "{" in lines[i]
        depth += lines[i].count("{") - lines[i].count("}")
        if seen and depth <= 0 or not seen and lines[i].rstrip().endswith(";"):
            return i + 1
    return first


def _rust(f: _File) -> None:
    f.file_node("rust", "contains_code")
    plain = X._blanked(f.text, "rust")
    depth = _depths(plain)
    kinds = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "mod": "module"}
    at = 0
    while m := _RUST_ITEM.search(plain, at):
        at = m.end()
        if depth[m.start()] != 0:
            continue
        if m.group(1):
            word, name = m.group(1), m.group(2)
            before = plain[: m.start()]
            attributes = re.search(r"(?:#\[[^\]]*\]\s*|pub(?:\([^)]*\))?\s+|async\s+|const\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s*)?)*$", before).group()
            kind = "test" if word == "fn" and re.search(r"#\[\s*test\s*\]", attributes) else kinds[word]
        elif m.group(3):
            head = plain[m.end() : _HEAD.search(plain + ";", m.end()).start()].strip()
            head = re.sub(r"^<(?:[^<>]|<[^<>]*>)*>\s*", "", head).split(" where ")[0]
            trait, _, target = head.rpartition(" for ")
            last = lambda x: re.sub(r"<.*", "", x.strip(), flags=re.S).rpartition("::")[2].strip("!& ") or "unknown"
            name, word, kind = (f"{last(trait)} for {last(target)}" if trait else last(target)), "impl", "impl"
        else:
            text = "use " + _use_text(f.text[m.start(5) : m.end(5)])
            sid, line = f"{f.path}:use:{hashlib.sha256(text.encode()).hexdigest()}", _first_line(f.text, text)
            f.node("concept", sid, text, (line, line), {"import": text})
            f.edge("imports", f.me, sid, "imports_rust")
            continue
        first = _item_line(f.lines, word, name)
        _symbol(f, kind, name, first, _block_last(f.lines, first), "rust")
    for row in [r for r in f.rows if r[3] == "chunk" and r[4] in CODE_KINDS]:
        words = {w for w in re.findall(r"(\w+)\(", row[-1])}
        for end in sorted({w[i:] for w in words for i in range(len(w)) if not w[i].isdigit()}):
            f._add("call", "name_call_heuristic", name=end, source=row[5])


_JS_CODE = re.compile(
    r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;]*?)?=\s*(?=(?:async\b\s*)?(?:function\b|\((?:[^()]|\([^()]*\))*\)\s*(?::[^=;{]*)?=>|[A-Za-z_$][\w$]*\s*=>|<))"
    r"|\bclass\s+([A-Za-z_$][\w$]*)(?:\s*<[^{]*?>)?(?:\s+extends\s+([\w$.]+))?|\binterface\s+([A-Za-z_$][\w$]*)|\benum\s+([A-Za-z_$][\w$]*)|\btype\s+([A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*="
)
_JS_METHOD = re.compile(r"(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+|\*\s*)*(#?[A-Za-z_$][\w$]*)\s*(?:<[^()]*>)?\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\s*(?::[^{};]*)?\{")
_JS_IMPORT = re.compile(r"""(?m)^[ \t]*import\b(?:[^;'"()]*?\bfrom\b)?\s*['"]([^'"\n]+)['"]""")
_JS_CALL = re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*)\s*(?:<[\w$,\s\[\]|]*>)?\(")
_JS_NO_CALL = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "with", "constructor", "super", "import", "new", "of", "in", "async"}
_CDK_NEW = re.compile(r"\bnew\s+([A-Za-z_$][\w$.]*)\s*\(\s*this\s*,")


def _close(plain: str, at: int) -> int:
    """The brace that closes the first one from ``at`` on; or a semicolon before any."""
    return X.block_end(plain, at)


def _js(f: _File, language: str) -> None:
    f.file_node(language, "contains_code")
    plain = X._blanked(f.text, "js")
    line = lambda i: f.text.count("\n", 0, i) + 1
    tests = any(x in f.path for x in (".test.", ".spec.", "__tests__/", "__test__/"))
    cdk = any(x in f.text for x in ("aws-cdk-lib", "@aws-cdk/", "constructs", "extends Stack", "cdk."))
    found: list[tuple[int, str, str, int]] = []
    stacks, heads = [], set()
    for m in _JS_CODE.finditer(plain):
        kind = ("function", "function", "struct", None, "trait", "enum", "type_alias")[m.lastindex - 1 if m.lastindex != 4 else 2]
        name = m.group(3) if m.lastindex == 4 else m.group(m.lastindex)
        if m.lastindex in (1, 2):
            heads.add(m.start(m.lastindex))
        start = m.start(2) if m.lastindex == 2 else m.start()
        if m.lastindex == 2:
            end = _arrow_end(plain, m.end())
        elif m.lastindex == 7:
            end = _statement_end(plain, m.end())
        else:
            end = _close(plain, m.end())
        found.append((start, kind, name, end))
        if kind == "struct":
            if cdk and (m.group(4) or "").rpartition(".")[2] == "Stack":
                stacks.append((name, start, end))
            body = plain.find("{", m.end())
            depth = 0
            i = body
            while 0 <= i < end:
                c = plain[i]
                if c == "{":
                    depth += 1
                elif c == "}":
                    depth -= 1
                elif depth == 1 and plain[i - 1] in " \t\n{};" and (k := _JS_METHOD.match(plain, i)) and k.group(1) not in ("if", "for", "while", "switch", "catch", "function"):
                    stop = _close(plain, k.end() - 1)
                    found.append((i, "function", k.group(1), stop))
                    heads.add(k.start(1))
                    i = stop
                i += 1
    for start, kind, name, end in sorted(found):
        _symbol(f, "test" if tests or _test_name(name) else kind, name, line(start), line(end), language)
    for m in _JS_IMPORT.finditer(f.text):
        if plain[m.start() : m.start() + len(m.group()) - len(m.group().lstrip()) + 6].strip():
            f.imported(m.group(1).strip(), language, "imports_module", line(m.start() + len(m.group()) - len(m.group().lstrip())))
    for name, start, end in stacks:
        a, b, sid = line(start), line(end), f"{f.path}:aws-cdk:stack:{name}"
        f.node("deployment_resource", sid, name, (a, b), {"technology": "aws_cdk", "resource_kind": "stack", "file": f.path})
        f.edge("defines", f.me, sid, "defines", {"technology": "aws_cdk"})
        f.chunk("aws_cdk_stack", sid, f"Technology: AWS CDK\nFile: {f.path}\nStack: {name}\nLines: {a}-{b}\n\n{f.code(a, b)}", (a, b), {"technology": "aws_cdk", "kind": "stack", "symbol": name, "file": f.path})
    for m in _CDK_NEW.finditer(plain) if cdk else ():
        q = re.compile(r"\s*(['\"])([^'\"\n]*)\1").match(f.text, m.end())
        if not q or not m.group(1).rpartition(".")[2][:1].isupper():
            continue
        what, logical = m.group(1), q.group(2)
        a, b = line(m.start()), line(_paren_end(plain, m.end()))
        service, sid = construct_service(what), f"{f.path}:aws-cdk:resource:{what}:{logical}"
        meta = {"technology": "aws_cdk", "construct_type": what, "logical_id": logical, "service": service, "file": f.path}
        f.node("deployment_resource", sid, f"{what} {logical}", (a, b), {**meta, "resource_kind": "construct"})
        f.edge("configures", f.me, sid, "configures", {"technology": "aws_cdk", "service": service})
        f.chunk("aws_cdk_resource", sid, f"Technology: AWS CDK\nFile: {f.path}\nResource: {what}\nLogical ID: {logical}\nService: {service}\nLines: {a}-{b}\n\n{f.code(a, b)}", (a, b), {**meta, "kind": "resource"})
    f.calls([(m.group(1), line(m.start())) for m in _JS_CALL.finditer(plain) if m.start(1) not in heads and m.group(1) not in _JS_NO_CALL and not re.search(r"\b(?:function\*?|new)\s+(?:[\w$]+\.)*$", plain[plain.rfind("\n", 0, m.start()) + 1 : m.start()])])


def _paren_end(plain: str, at: int) -> int:
    depth = 1
    while at < len(plain) and depth:
        depth += plain[at] in "([{"
        depth -= plain[at] in ")]}"
        at += 1
    return at - 1


def _statement_end(plain: str, at: int) -> int:
    depth = 0
    for i in range(at, len(plain)):
        c = plain[i]
        depth += c in "([{"
        depth -= c in ")]}"
        if depth < 0 or depth == 0 and (c == ";" or c == "\n" and re.match(r"\s*\n?\s*(?:export|const|let|var|function|class|interface|type|import|enum)\b", plain[i:])):
            return i
    return len(plain.rstrip()) - 1


def _arrow_end(plain: str, at: int) -> int:
    """End of a function or arrow expression that begins at ``at``."""
    arrow = re.compile(r"=>\s*").search(plain, at)
    brace = plain.find("{", at)
    if re.match(r"(?:async\s+)?function\b", plain[at:]) or arrow is None:
        return _close(plain, at)
    if brace == arrow.end():
        return _close(plain, brace)
    return _statement_end(plain, arrow.end())


def construct_service(what: str) -> str:
    low = what.lower()
    return next((service for service, words in V.CONSTRUCT_SERVICES if any(w in low for w in words)), "aws")


_SOL_TOP = re.compile(r"\b(?:abstract\s+)?(contract|interface|library)\s+(\w+)(?:\s+is\s+([^{]+))?\s*\{|\bfunction\s+(\w+)")
_SOL_PART = re.compile(r"\b(?:(function|modifier|event)\s+(\w+)|(constructor|fallback|receive)\s*\()")
_SOL_IMPORT = re.compile(r"""\bimport\b[^;'"]*['"]([^'"\n]+)['"]""")
_SOL_NO_CALL = {"if", "for", "while", "catch", "return", "returns", "function", "modifier", "event", "constructor", "mapping", "emit", "require", "assembly", "unchecked", "revert", "error", "override"} - {"require"}


def _solidity(f: _File) -> None:
    f.file_node("solidity", "contains_code")
    plain = X._blanked(f.text, "solidity")
    if plain.count("{") != plain.count("}"):
        return
    line = lambda i: f.text.count("\n", 0, i) + 1
    depth = _depths(plain)

    def member(word: str, name: str, start: int) -> None:
        end = _close(plain, start)
        kind = "concept" if word in ("modifier", "event") else "function"
        sid = f"{f.path}:solidity:{word}:{name}"
        _part(kind, word, name, sid, start, end, ("contains", "contains_member"))

    def _part(kind: str, word: str, name: str, sid: str, start: int, end: int, edge: tuple[str, str]) -> None:
        first, last = line(start), line(end)
        f.symbol(
            kind, name, sid, first, last, {"language": "solidity", "file": f.path, "solidity_kind": word}, {"symbol": name, "kind": kind, "solidity_kind": word, "file": f.path},
            (*edge, {"language": "solidity", "kind": word}), f"Language: solidity\nFile: {f.path}\nSymbol: {name}\nSolidity kind: {word}\n",
        )

    events = [(m.start(), m, "import") for m in _SOL_IMPORT.finditer(f.text) if plain[m.start()] == "i"] + [(m.start(), m, "top") for m in _SOL_TOP.finditer(plain) if depth[m.start()] == 0]
    for _, m, what in sorted(events, key=lambda e: e[0]):
        if what == "import":
            f.imported(m.group(1), "solidity", "imports_solidity", line(m.start()))
        elif m.group(4):
            member("function", m.group(4), m.start())
        else:
            word, name, bases = m.group(1), m.group(2), m.group(3)
            end = _close(plain, m.end() - 1)
            _part({"interface": "trait", "library": "module"}.get(word, "struct"), word, name, f"{f.path}:solidity:{word}:{name}", m.start(), end, ("defines", "defines"))
            for base in re.findall(r"([\w.]+)\s*(?:\((?:[^()]|\([^()]*\))*\))?", bases or ""):
                sid = f"solidity:inheritance:{base}"
                f.node("concept", sid, base, (None, None), {"language": "solidity", "relationship": "inheritance"})
                f.edge("implements", f"{f.path}:solidity:{word}:{name}", sid, "implements", {"language": "solidity", "base": base})
            for p in _SOL_PART.finditer(plain, m.end(), end):
                if depth[p.start()] == 1:
                    member("fallback" if p.group(3) == "receive" else p.group(3) or p.group(1), p.group(3) or p.group(2), p.start())
    heads = {p.start(2) for p in _SOL_PART.finditer(plain) if p.group(2)}
    inside = [(m.group(1), m.start()) for m in X._CALL.finditer(plain.replace(".", " ")) if depth[m.start()] > 1 and m.start(1) not in heads and m.group(1) not in _SOL_NO_CALL]
    f.calls([(n, line(i)) for n, i in inside])


def file_rows(repo: str, path: str, text: str, workspace: set[str]) -> list[tuple]:
    """All rows of one file, by the first rule that fits its path."""
    f = _File(repo, path, text, workspace)
    language = language_of(path)
    for ending, read in (("Cargo.toml", _cargo), ("package.json", _package), ("cdk.json", _cdk_json), ("tsconfig.json", _json_config), ("jsconfig.json", _json_config)):
        if path.endswith(ending):
            read(f)
            return f.rows
    if language in ("javascript", "typescript"):
        _js(f, language)
    elif language:
        {"markdown": _markdown, "solidity": _solidity, "pdf": _pdf, "python": _python, "rust": _rust}[language](f)
    return f.rows


# -- Spark ---------------------------------------------------------------------------------------------------
def indexed(files: DataFrame, skip_dirs: list[str] | None = None, paths: DataFrame | None = None) -> DataFrame:
    """The files that become knowledge: not below a skipped directory, and of the given paths if there are any."""
    rows = files.filter(F.col("path").isNotNull() & F.col("content").isNotNull() & T.is_indexable(F.col("path")))
    if skip_dirs:
        parts = F.split("path", "/")
        rows = rows.filter(~F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, skip_dirs))))
    return rows if paths is None else rows.join(paths.select("path").distinct(), "path", "left_semi")


def raw_rows(files: DataFrame, workspace: DataFrame | None = None) -> DataFrame:
    """All rows of all files.  ``workspace``: (repo_id, name) of the repositories' own packages."""
    if workspace is None:
        workspace = X.workspace_packages(files)
    own = workspace.groupBy("repo_id").agg(F.array_sort(F.collect_set("name")).alias("own"))  # as many as the tree's manifests
    rows = files.select("repo_id", "path", "content").join(own, "repo_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [r for repo, path, text, mine in zip(b.repo_id, b.path, b.content, b.own) for r in file_rows(repo, path, text, set(mine) if mine is not None else set())]
            yield pd.DataFrame(out, columns=_ROW).astype({"line_start": "Int32", "line_end": "Int32"})

    return rows.mapInPandas(run, _SCHEMA)


def node_id(repo: Column, stable: Column) -> Column:
    return T.uuid5(F.concat_ws(":", repo, F.lit("node"), stable))


def graph(files: DataFrame, repositories: DataFrame, workspace: DataFrame | None = None) -> dict[str, DataFrame]:
    """nodes, edges and chunks of the files of repositories (repo_id, name, root_path); the rows are written once."""
    from ..session import stored

    rows = stored(raw_rows(files, workspace), "graph-rows")
    repo = repositories.select(
        "repo_id", F.lit("").alias("path"), F.lit(-1).alias("seq"), F.lit("repository").alias("kind"), F.lit("repo").alias("stable_id"), "name",
        F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.to_json(F.struct(F.col("root_path").alias("root"))).alias("metadata"),
    )
    columns = ["kind", "name", "path", "line_start", "line_end", "metadata"]
    every = rows.filter("record = 'node'").select("repo_id", "path", "seq", "kind", "stable_id", "name", "line_start", "line_end", "metadata").unionByName(repo)
    first = every.groupBy("repo_id", "stable_id").agg(F.min_by(F.struct(*columns), F.struct("path", "seq")).alias("n"))
    shared = F.col("stable_id").startswith("import:bare:") | F.col("stable_id").startswith("solidity:inheritance:") | (F.col("stable_id") == "repo")
    nodes = first.select(
        node_id(F.col("repo_id"), F.col("stable_id")).alias("node_id"), "repo_id", "n.kind", "stable_id", "n.name",
        F.when(~shared, F.col("n.path")).alias("file_path"), "n.line_start", "n.line_end", "n.metadata",
    )
    ends = rows.filter("record = 'edge'").select("repo_id", "source", "target", "kind", "cost", "confidence", "metadata")
    edges = ends.unionByName(call_edges(rows)).filter("source <> target")
    edges = edges.select("repo_id", node_id(F.col("repo_id"), F.col("source")).alias("source"), node_id(F.col("repo_id"), F.col("target")).alias("target"), "kind", "cost", "confidence", "metadata")
    chunks = rows.filter("record = 'chunk'").select(
        T.uuid5(F.concat_ws(":", "repo_id", F.lit("chunk"), "path", F.col("seq").cast("string"), F.sha2("content", 256))).alias("chunk_id"),
        "repo_id", F.col("path").alias("file_path"), node_id(F.col("repo_id"), F.col("stable_id")).alias("node_id"), F.col("kind").alias("chunk_type"), "content",
        F.sha2("content", 256).alias("content_hash"), "line_start", "line_end", "metadata",
    )
    return {"nodes": nodes, "edges": edges, "chunks": chunks}


def call_edges(rows: DataFrame) -> DataFrame:
    """One edge per caller and target: the callee in the caller's file, else the repository's first symbol of the name.
    Rust calls are names before a parenthesis in a symbol's chunk and only find Rust symbols."""
    symbol = rows.filter((F.col("record") == "node") & F.col("line_start").isNotNull() & F.get_json_object("metadata", "$.file").isNotNull())
    code = symbol.filter(F.col("kind").isin(*CODE_KINDS))
    place = F.struct("path", "seq")
    # impl blocks are found from other files, but never call nor are called inside a file
    everywhere = symbol.filter(F.col("kind").isin(*CODE_KINDS, "impl")).groupBy("repo_id", "name").agg(F.min_by("stable_id", place).alias("wide"))
    rust = code.filter(F.get_json_object("metadata", "$.language") == "rust").groupBy("repo_id", "name").agg(F.min_by("stable_id", place).alias("wide"))
    here = code.groupBy("repo_id", "path", "name").agg(F.min_by("stable_id", "seq").alias("near"))
    calls = rows.filter("record = 'call'").select("repo_id", "path", "seq", F.col("kind").alias("detector"), "name", "source", "target")
    exact = calls.filter("detector = 'ast_call_site'").join(everywhere, ["repo_id", "name"], "left").withColumn("target", F.coalesce("target", "wide"))
    guessed = calls.filter("detector <> 'ast_call_site'").join(rust, ["repo_id", "name"]).join(here, ["repo_id", "path", "name"], "left").withColumn("target", F.coalesce("near", "wide"))
    both = exact.drop("wide").unionByName(guessed.drop("wide", "near")).filter("target is not null and source <> target")
    cost, confidence = V.EDGE_WEIGHTS["calls"]
    one = both.groupBy("repo_id", "source", "target").agg(F.min_by(F.struct("detector", "name"), F.struct("path", "seq")).alias("c"))
    meta = F.to_json(F.struct(F.col("c.name").alias("callee"), F.col("c.detector").alias("detector")))
    return one.select("repo_id", "source", "target", F.lit("calls").alias("kind"), F.lit(cost).alias("cost"), F.lit(confidence).alias("confidence"), meta.alias("metadata"))
