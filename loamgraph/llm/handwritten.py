"""Problem 6: files that are not hand-written source of their repository.

Merkle hashes are computed bottom-up over the directory trees of all repositories: a file's hash is that of its
text, a directory's combines the names and hashes of its children by sums, so that every level is a partial
aggregation and no directory's children are ever gathered.  Leaves found among the known library files are
third-party copies wherever they lie.  A subtree that unrelated repositories share is vendored, with all its files, if
there is a second ground for it: a library leaf, or another project's notice, directly in its root.  Shared content
alone is no case, as short hand-written files recur too (``shared_subtrees`` reports them).  Headers, names, directories
and layout mark generated, minified and data files.

Defined results: a null path or content has no sign of its own; empty texts are only cases by their path; repeated
rows count once; a repository without configuration skips nothing; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

THIRD_PARTY_DIRS = {"vendor", "vendors", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "external", "externals", "contrib", "node_modules", "bower_components", "jspm_packages", "site-packages"}
GENERATED_DIRS = {"generated", "__generated__", "_generated", "gen", "autogen", "auto_generated", "generated-sources", "generated_src", "src-gen"}
GENERATED_NAME = re.compile(r"(?:\.(?:pb|g|gen|generated|autogen|auto|designer)\.\w+|_pb2(?:_grpc)?\.pyi?|_(?:grpc_)?pb\.(?:d\.)?\w+|[._-](?:generated|autogenerated|autogen|gen)\.\w+|\.pb\.(?:go|cc|h)|^zz_generated.*)$", re.I)
MINIFIED_NAME = re.compile(r"[.-]min\.(?:js|mjs|cjs|css)$", re.I)
SCRIPT = {"js", "mjs", "cjs", "jsx", "css", "ts", "mts"}

_SUBJECT = r"(?:(?:this|the)\s+(?:\w+\s+)?(?:file|code|source|module|document|class)\s+(?:is|was|has been)\s+|(?:code|file|source|class(?:es)?)\s+)?"
GENERATED_HEADER = re.compile(
    rf"^\W*(?:(?:warning|note|notice|attention|caution)\W+)?(?:@generated\b|<auto-?generated\b|auto-?generated\b(?!\s+(?:files|code|sources|by hand))"
    rf"|{_SUBJECT}(?:auto(?:matically)?[-\s]?|machine[-\s]?)?(?:generated|created|produced|compiled|transpiled|built)\s+(?:automatically\s+)?(?:by|from|with|using|via)\s+\S"
    rf"|{_SUBJECT}(?:automatically|auto|machine)[-\s]?(?:generated|created|produced)\b"
    r"|automatisch\s+(?:erzeugt|generiert|erstellt)\b|(?:diese\s+datei\s+wurde\s+)(?:automatisch\s+)?(?:erzeugt|generiert)\b|maschinell\s+erzeugt\b"
    r"|(?:(?:ce\s+)?(?:fichier|code)\s+)?(?:généré|genere|créé|produit)e?\s+(?:automatiquement|par)\b|automatiquement\s+généré"
    r"|(?:(?:este\s+)?(?:archivo|código|codigo|fichero|arquivo|ficheiro)\s+)?(?:fue\s+|foi\s+)?(?:generado|gerado|creado|criado)\s+(?:automáticamente|automaticamente|por)\b|auto-?(?:generado|gerado)\b"
    r"|generato\s+automaticamente\b|自動生成|自动生成)",
    re.I,
)
DO_NOT_EDIT = re.compile(r"^\W*(?:code\s+)?generated\b.*\bdo not (?:edit|modify)\b|^\W*do not (?:edit|modify)\W.*\b(?:generated|overwritten|regenerat)", re.I)
SOURCE_MAP = re.compile(r"^\s*//[#@]\s*sourceMappingURL=", re.M)
_NAME = r"[A-Za-z][\w.-]*"
NOTICES = [
    re.compile(rf"\(c\)\s*(?:\d{{4}}[\s,-]*(?:\d{{4}})?\s*)?(?:the\s+)?({_NAME})\s+(?:contributors|authors|project|team|developers|foundation)\b", re.I),
    re.compile(rf"copyright\b.{{0,30}}?\bthe\s+({_NAME})\s+(?:contributors|authors|project|team|developers)\b", re.I),
    re.compile(rf"\b(?:released|distributed|maintained|published|provided)\s+by\s+(?:the\s+)?({_NAME})\s+(?:project|team|authors|contributors|developers)\b", re.I),
    re.compile(rf"^\s*/?[*!/#\s]*({_NAME})\s+(?:-\s*)?(?:version\s+|v)?\d+\.\d+(?:\.\d+)?\b(?=[\s\S]{{0,120}}?(?:released|distributed|licen[cs]ed)\s+under)", re.I),
]
_COMMENT_LINE = re.compile(r"^\s*(?://|#(?!\[|!\[)|/\*|\*|--|;;|<!--|'''|\"\"\"|%)")


_DOCSTRING = re.compile(r"[rRuU]?(\"\"\"|''')")
_BRACKETS = re.compile(r"[\[\](){}]")


def header(text: str) -> list[str]:
    """The comment lines before the first line of code: all of them, docstrings too; inner attributes and "use strict"
    may stand between."""
    out: list[str] = []
    close, depth = "", 0
    for line in text.lstrip("\ufeff").splitlines():
        s = line.strip()
        if not s:
            continue
        if close:
            out.append(s)
            close = "" if close in s else close
        elif depth or s.startswith("#!["):
            depth += sum(1 if c in "[({" else -1 for c in _BRACKETS.findall(re.sub(r'"(?:\\.|[^"\\])*"', "", s)))
            depth = max(depth, 0)
        elif m := _DOCSTRING.match(s):
            out.append(s[m.start(1) :])
            close = "" if m.group(1) in s[m.end() :] else m.group(1)
        elif _COMMENT_LINE.match(line):
            out.append(s)
            for mark, end in (("/*", "*/"), ("<!--", "-->")):
                if s.startswith(mark) and end not in s[len(mark) :]:
                    close = end
        elif not re.fullmatch(r"[\"']use strict[\"'];?", s):
            break
    return out


def is_generated(text: str) -> bool:
    for line in header(text):
        words = re.sub(r"^[\s/*#!;<>%'\"-]*(?=[<@\w])", "", line) if not line.lstrip("/*# ").startswith("<auto") else line.lstrip("/*# ")
        if GENERATED_HEADER.match(words) or DO_NOT_EDIT.match(words):
            return True
    return False


def foreign_notice(text: str, own: str | None) -> bool:
    """A notice of another project at the head of the file."""
    head = header(text)
    if not head:
        return False
    joined = "\n".join(head)
    for rx in NOTICES:
        for m in rx.finditer(joined):
            if not own or m.group(1).lower() != own.lower():
                return True
    return False


_STRING = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`")


def _packed(line: str) -> bool:
    """A line of script that holds several statements with next to no space between them."""
    body = _STRING.sub("''", line)
    if len(body) < 0.5 * len(line):  # mostly strings: data, not script
        return False
    spaces = body.count(" ") / len(body)
    marks = sum(body.count(c) for c in "{}();=,")
    return spaces < 0.12 and marks > 0.12 * len(body) and body.count(";") + body.count("{") + body.count(",") >= PACKED


#: Ends of statements, blocks and list items on one line that make it packed.
PACKED = 6


def is_minified(text: str, ext: str) -> bool:
    """Most of the script stands in packed lines."""
    if ext not in SCRIPT:
        return False
    code = [x for x in text.splitlines() if x.strip() and not _COMMENT_LINE.match(x)]
    return sum(len(x) for x in code if _packed(x)) >= 0.6 * sum(map(len, code)) > 0


_BLOB = re.compile(r"[A-Za-z0-9+/=_\-\\]{24,}")
_NUMBER = re.compile(r"[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[uUlLfi0-9]*\s*,?")


def is_data(text: str) -> bool:
    """Essentially one block of numbers or encoded bytes."""
    body = re.sub(r"/\*.*?\*/", " ", text, flags=re.S)
    body = "\n".join(x for x in body.splitlines() if not _COMMENT_LINE.match(x))
    solid = len(re.sub(r"\s+", "", body))
    if not solid:
        return False
    blob = 0
    for m in re.finditer(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`]*)`", body):
        s = m.group(1) or m.group(2) or m.group(3) or ""
        if _BLOB.fullmatch(re.sub(r"\s+", "", s)) and " " not in s.strip():
            blob += len(s) + 2
    numbers = 0
    for m in re.finditer(r"[\[({]((?:\s*" + _NUMBER.pattern + r"){24,})\s*[\])}]?", body):
        numbers += len(re.sub(r"\s+", "", m.group(1)))
    if re.search(r"BEGIN [A-Z ]*KEY|BEGIN CERTIFICATE", body):
        return False
    return blob + numbers >= 0.75 * solid


def signs(path: str | None, text: str | None, own: str | None) -> list[str]:
    out = []
    *dirs, name = (path or "").split("/")
    low = {x.lower() for x in dirs}
    text = text or ""
    ext = name.rpartition(".")[2].lower()
    if low & GENERATED_DIRS or GENERATED_NAME.search(name) or is_generated(text):
        out.append("generated")
    if MINIFIED_NAME.search(name) or is_minified(text, ext) or ext in SCRIPT and SOURCE_MAP.search(text):
        out.append("minified")
    if low & THIRD_PARTY_DIRS or foreign_notice(text, own):
        out.append("third_party")
    if ext not in ("json", "toml", "yml", "yaml", "env", "lock") and is_data(text):
        out.append("data")
    return out


def _text_hash() -> Column:
    return F.sha2(F.coalesce("content", F.lit("")), 256)


def machine_files(files: DataFrame, config: DataFrame, libraries: DataFrame, repositories: DataFrame, least_repositories: int = 2) -> DataFrame:
    """(file_id, repo_id, path, signs): every file with a sign that it is not hand-written here."""
    base = files.filter("file_id is not null").select("file_id", "repo_id", "path", "content")
    skip = config.groupBy("repo_id").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("skip_dirs", F.array().cast("array<string>"))))).alias("skip"))
    own = repositories.groupBy("repo_id").agg(F.min("name").alias("own"))
    dirs = F.split("path", "/")
    dirs = F.slice(dirs, F.lit(1), F.greatest(F.size(dirs) - 1, F.lit(0)))
    rows = (
        base.withColumn("leaf", _text_hash())
        .join(skip, "repo_id", "left")
        .join(own, "repo_id", "left")
        .select("file_id", "repo_id", "path", "content", "own", "leaf", F.coalesce(F.arrays_overlap("skip", dirs), F.lit(False)).alias("skipped"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [["skipped_dir"] * bool(skipped) + signs(path, text, own) for path, text, own, skipped in zip(b.path, b.content, b.own, b.skipped)]
            notice = [foreign_notice(text or "", own) for text, own in zip(b.content, b.own)]
            yield pd.DataFrame({"file_id": b.file_id, "repo_id": b.repo_id, "path": b.path, "leaf": b.leaf, "notice": notice, "signs": found})

    # what the texts are needed for, read once: from here on a file is its hash and its signs
    seen = stored(rows.mapInPandas(run, "file_id string, repo_id string, path string, leaf string, notice boolean, signs array<string>"), "file-signs")
    known = libraries.filter("content_hash is not null").select(F.lower("content_hash").alias("leaf")).distinct().withColumn("known", F.lit(True))
    seen = seen.join(known, "leaf", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    tree = _tree(seen.select("repo_id", "path", F.col("leaf").alias("hash")))
    shared = tree.filter("path <> '' and not is_file").groupBy("hash").agg(F.countDistinct("repo_id").alias("n")).filter(F.col("n") >= least_repositories).select("hash")
    places = tree.filter("path <> '' and not is_file").join(shared, "hash").select("repo_id", F.col("path").alias("root"), "hash")
    parent = F.regexp_replace("path", r"/?[^/]*$", "")
    ground = seen.filter("known or notice").select("repo_id", parent.alias("root")).join(places, ["repo_id", "root"]).select("hash").distinct()
    vendored = places.join(ground, "hash").select("repo_id", "root").distinct().withColumn("vendored", F.lit(True))
    # every directory above a file
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.concat_ws("/", F.slice(F.split("path", "/"), F.lit(1), i)))
    under = seen.filter("repo_id is not null and path like '%/%'").select("file_id", "repo_id", F.explode(above).alias("root")).join(vendored, ["repo_id", "root"]).select("file_id").distinct().withColumn("vendored", F.lit(True))
    sign = lambda c, name: F.when(F.col(c), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    return (
        seen.join(under, "file_id", "left")
        .select("file_id", "repo_id", "path", F.concat("signs", sign("known", "library"), sign("vendored", "vendored_subtree")).alias("signs"))
        .filter(F.size("signs") > 0)
        .dropDuplicates(["file_id"])
    )


def merkle_tree(files: DataFrame) -> DataFrame:
    """(repo_id, path, depth, files, hash): every file and directory with the hash of its subtree; '' is the root."""
    return _tree(files.select("repo_id", "path", _text_hash().alias("hash"))).drop("is_file")


def _tree(hashed: DataFrame) -> DataFrame:
    """The tree over (repo_id, path, hash) of files."""
    leaves = (
        hashed.filter("repo_id is not null and path is not null")
        .groupBy("repo_id", "path")
        .agg(F.max("hash").alias("hash"))
        .withColumn("depth", F.size(F.split("path", "/")))
        .withColumn("files", F.lit(1).cast("long"))
    )
    columns = ["repo_id", "path", "depth", "files", "hash", "is_file"]
    level_all = stored(leaves.withColumn("is_file", F.lit(True)).select(columns), "tree")
    deepest = level_all.agg(F.max("depth")).first()[0] or 0
    levels = [level_all]
    for depth in range(deepest, 0, -1):
        name = F.element_at(F.split("path", "/"), -1)
        parts = [F.conv(F.substring(F.sha2(F.concat_ws("\0", name, F.col("hash")), 256), 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(4)]
        parent = F.regexp_replace("path", r"/?[^/]*$", "")
        # the directories made last, and the files that lie beside them
        here = levels[0].filter(F.col("depth") == depth)
        if len(levels) > 1:
            here = here.unionByName(levels[-1])
        up = (
            here.select("repo_id", parent.alias("path"), "files", *[p.alias(f"s{i}") for i, p in enumerate(parts)])
            .groupBy("repo_id", "path")
            .agg(F.sum("files").alias("files"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(4)], F.count(F.lit(1)).alias("n"))
            .select("repo_id", "path", F.lit(depth - 1).alias("depth"), "files", F.sha2(F.concat_ws("|", "n", "s0", "s1", "s2", "s3"), 256).alias("hash"), F.lit(False).alias("is_file"))
        )
        levels.append(stored(up, "tree"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def shared_subtrees(files: DataFrame, least_repositories: int = 2) -> DataFrame:
    """(hash, repositories, places, files): directories with equal content in several repositories."""
    return (
        merkle_tree(files)
        .filter("files > 0")
        .groupBy("hash")
        .agg(F.countDistinct("repo_id").alias("repositories"), F.count(F.lit(1)).alias("places"), F.max("files").alias("files"))
        .filter(F.col("repositories") >= least_repositories)
    )
