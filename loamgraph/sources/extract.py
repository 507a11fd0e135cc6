"""Symbols, imports and calls from source text; one pass over each file, in Arrow batches.

Python goes to the standard library's grammar; the other languages to scanners that know strings, comments and
brackets only.  A file that does not parse yields no symbols and never fails the job.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_BYTES = 2000
_BLANK = {
    "rust": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|b?r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"|b?'(?:\\.[^']*|[^'\\\n])'", re.S),
    "js": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S),
    "solidity": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S),
}
_ITEMS = {
    "rust": [(k, re.compile(rf"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:async[ \t]+|const[ \t]+|unsafe[ \t]+)*{w}[ \t]+(\w+)")) for k, w in (("function", "fn"), ("struct", "struct"), ("enum", "enum"), ("trait", "trait"), ("module", "mod"))],
    "js": [
        ("function", re.compile(r"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*([A-Za-z_$][\w$]*)")),
        ("function", re.compile(r"(?m)^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+([A-Za-z_$][\w$]*)[ \t]*(?::[^=\n]*)?=[ \t]*(?:async[ \t]*)?(?:function\b|\([^)]*\)[^=\n]*=>|[A-Za-z_$][\w$]*[ \t]*=>)")),
        ("struct", re.compile(r"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?class[ \t]+([A-Za-z_$][\w$]*)")),
        ("trait", re.compile(r"(?m)^[ \t]*(?:export[ \t]+)?interface[ \t]+([A-Za-z_$][\w$]*)")),
        ("enum", re.compile(r"(?m)^[ \t]*(?:export[ \t]+)?(?:const[ \t]+)?enum[ \t]+([A-Za-z_$][\w$]*)")),
        ("type", re.compile(r"(?m)^[ \t]*(?:export[ \t]+)?type[ \t]+([A-Za-z_$][\w$]*)[ \t]*(?:<[^=\n]*>)?[ \t]*=")),
    ],
    "solidity": [(k, re.compile(rf"(?m)^[ \t]*(?:abstract[ \t]+)?{w}[ \t]+(\w+)")) for k, w in (("struct", "contract"), ("trait", "interface"), ("module", "library"), ("function", "function"), ("concept", "event"), ("concept", "modifier"))],
}
_IMPORTS = {
    "rust": re.compile(r"(?m)^[ \t]*(?:pub[ \t]+)?use[ \t]+([^;]+);"),
    "js": re.compile(r"""(?m)^[ \t]*import\b[^;'"\n]*['"]([^'"\n]+)['"]"""),
    "solidity": re.compile(r"""(?m)^[ \t]*import\b[^;'"\n]*['"]([^'"\n]+)['"]"""),
}
_ENDS = re.compile(r"[{};]")
_CALL = re.compile(r"(?<![\w.])([A-Za-z_]\w*)\s*\(")
LANGUAGES = {"py": "python", "pyi": "python", "rs": "rust", "ts": "js", "mts": "js", "tsx": "js", "js": "js", "mjs": "js", "jsx": "js", "sol": "solidity"}


def _blanked(text: str, lang: str) -> str:
    """The text with literals and comments as blanks, line feeds kept."""
    return _BLANK[lang].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def block_end(text: str, at: int) -> int:
    """End of the item that begins at ``at``: its closing brace, or a semicolon that comes before any brace."""
    depth = 0
    for m in _ENDS.finditer(text, at):
        c = m.group()
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return m.start()
        elif depth == 0:
            return m.start()
    return len(text) - 1


def python_records(text: str) -> list[tuple]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[tuple] = []

    def visit(node: ast.AST, inside: bool) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                start = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                out.append(("symbol", "function", n.name, start, n.end_lineno))
                for c in ast.walk(n):
                    if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute)):
                        out.append(("call", "calls", c.func.id if isinstance(c.func, ast.Name) else c.func.attr, c.lineno, c.lineno))
                closures(n)
            elif isinstance(n, ast.ClassDef):
                out.append(("symbol", "struct", n.name, n.lineno, n.end_lineno))
                visit(n, True)
            elif isinstance(n, ast.Import):
                out.extend(("import", "imports", a.name, n.lineno, n.lineno) for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                out.append(("import", "imports", "." * n.level + (n.module or ""), n.lineno, n.lineno))

    def closures(f: ast.AST) -> None:
        """Functions defined inside a function; their calls are counted with it."""
        for n in ast.iter_child_nodes(f):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                start = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                out.append(("symbol", "function", n.name, start, n.end_lineno))
            closures(n)

    visit(tree, False)
    return out


def scanned_records(text: str, lang: str) -> list[tuple]:
    plain = _blanked(text, lang)
    line = lambda i: text.count("\n", 0, i) + 1
    out = []
    for kind, rx in _ITEMS[lang]:
        for m in rx.finditer(plain):
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            out.append(("symbol", kind, m.group(1), line(start), line(block_end(plain, m.end()))))
    for m in _IMPORTS[lang].finditer(text):
        if plain[m.start() : m.start(1)].strip():
            out.append(("import", "imports", re.sub(r"\s+", " ", m.group(1)), line(m.start(1)), line(m.start(1))))
    names = {r[2] for r in out if r[0] == "symbol"}
    for m in _CALL.finditer(plain):
        before = plain[max(0, m.start() - 12) : m.start()]
        if m.group(1) not in ("if", "for", "while", "switch", "match", "return", "catch", "function", "fn") and not re.search(r"(?:fn|function|event|modifier)\s+$", before):
            out.append(("call", "calls", m.group(1), line(m.start()), line(m.start())))
    return out if names or out else []


def records(files: DataFrame) -> DataFrame:
    """(repo_id, path, record, kind, name, line_start, line_end) of every file in a known language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for repo, path, text in zip(b.repo_id, b.path, b.content):
                lang = LANGUAGES[path.rpartition(".")[2].lower()]
                found = python_records(text) if lang == "python" else scanned_records(text, lang)
                rows += [(repo, path, *r) for r in found]
            yield pd.DataFrame(rows, columns=["repo_id", "path", "record", "kind", "name", "line_start", "line_end"])

    known = files.filter(F.col("path").rlike(r"(?i)\.(" + "|".join(LANGUAGES) + ")$") & F.col("content").isNotNull()).select("repo_id", "path", "content")
    return known.mapInPandas(run, "repo_id string, path string, record string, kind string, name string, line_start int, line_end int")


def parts_of(text: str, size: int = PART_BYTES) -> list[str]:
    """Whole lines up to ``size`` bytes a part; a longer line is cut between characters."""
    out: list[str] = []
    now, used = [], 0
    for line in text.split("\n"):
        pieces, piece, n = [], "", 0
        for c in line:
            k = len(c.encode())
            if n + k > size:
                pieces.append(piece)
                piece, n = "", 0
            piece, n = piece + c, n + k
        for p in [*pieces, piece]:
            k = len(p.encode()) + 1
            if now and used + k > size:
                out.append("\n".join(now).rstrip())
                now, used = [], 0
            now.append(p)
            used += k
    out.append("\n".join(now).rstrip())
    return out


def split_chunks(chunks: DataFrame, size: int = PART_BYTES) -> DataFrame:
    """(chunk_id, part, parts, content, content_hash, parent_hash): chunks above ``size`` bytes in parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for cid, text in zip(b.chunk_id, b.content):
                parts = parts_of(text, size) if len(text.encode()) > size else [text]
                parent = hashlib.sha256(text.encode()).hexdigest()
                for i, p in enumerate(parts, 1):
                    body = f"Chunk part: {i}/{len(parts)}\n{p}" if len(parts) > 1 else p
                    rows.append((cid, i, len(parts), body, hashlib.sha256(body.encode()).hexdigest(), parent))
            yield pd.DataFrame(rows, columns=["chunk_id", "part", "parts", "content", "content_hash", "parent_hash"])

    return chunks.filter("content is not null").select("chunk_id", "content").mapInPandas(run, "chunk_id string, part int, parts int, content string, content_hash string, parent_hash string")


def manifest_dependencies(path: str, text: str) -> list[tuple]:
    """(ecosystem, section, name, version); a manifest that does not parse has none."""
    name = path.rpartition("/")[2]
    try:
        if name == "package.json":
            data = json.loads(text)
            sections = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
            return [("npm", s, n, str(v)) for s in sections for n, v in (data.get(s) or {}).items()]
        if name == "Cargo.toml":
            data = tomllib.loads(text)
            sections = ("dependencies", "dev-dependencies", "build-dependencies")
            return [("cargo", s, n, v if isinstance(v, str) else str(v.get("version", ""))) for s in sections for n, v in (data.get(s) or {}).items()]
    except (ValueError, AttributeError, RecursionError):
        pass
    return []


def dependencies(files: DataFrame) -> DataFrame:
    """(repo_id, manifest, ecosystem, section, name, version) of all manifests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r, p, *x) for r, p, t in zip(b.repo_id, b.path, b.content) for x in manifest_dependencies(p, t)]
            yield pd.DataFrame(rows, columns=["repo_id", "manifest", "ecosystem", "section", "name", "version"])

    known = files.filter(F.col("path").rlike(r"(^|/)(package\.json|Cargo\.toml)$") & F.col("content").isNotNull()).select("repo_id", "path", "content")
    return known.mapInPandas(run, "repo_id string, manifest string, ecosystem string, section string, name string, version string")


def workspace_packages(files: DataFrame) -> DataFrame:
    """Names that the tree's own package manifests declare."""
    name = F.get_json_object("content", "$.name")
    return files.filter(F.col("path").rlike(r"(^|/)package\.json$")).select("repo_id", name.alias("name")).filter("name is not null").distinct()


def manifest_name(path: str, text: str) -> str | None:
    """The name that a package manifest publishes, of three characters at least."""
    try:
        data = json.loads(text) if path.endswith("package.json") else tomllib.loads(text).get("package")
        name = data.get("name") if isinstance(data, dict) else None
    except (ValueError, RecursionError):
        return None
    name = name.strip() if isinstance(name, str) else ""
    return name if len(name) >= 3 else None


def manifest_names(files: DataFrame) -> DataFrame:
    """(repo_id, path, name) of package.json and Cargo.toml."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names = [manifest_name(p, t) for p, t in zip(b.path, b.content)]
            out = pd.DataFrame({"repo_id": b.repo_id, "path": b.path, "name": names})
            yield out[out.name.notna()]

    known = files.filter(F.col("path").rlike(r"(^|/)(package\.json|Cargo\.toml)$") & F.col("content").isNotNull()).select("repo_id", "path", "content")
    return known.mapInPandas(run, "repo_id string, path string, name string")
