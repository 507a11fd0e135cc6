"""Lexical column functions; all are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(*items: str) -> Column:
    return F.array(*[F.lit(x) for x in items])


def ascii_lower(c: Column) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(c, _UPPER, _LOWER)


def search_tokens(c: Column, longer_than: int = 1) -> Column:
    """Runs of ASCII letters and digits in lower case, in order, repeats kept."""
    return F.filter(F.split(ascii_lower(c), "[^a-z0-9]+"), lambda t: F.length(t) > longer_than)


def _sorted_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def literal_terms(c: Column) -> Column:
    kept = F.filter(search_tokens(c, 2), lambda t: ~t.isin(*V.LITERAL_STOP))
    compact = F.regexp_replace(ascii_lower(c), "[^a-z0-9]", "")
    extra = F.when(F.length(compact) > 4, F.array(compact)).otherwise(F.array().cast("array<string>"))
    return _sorted_set(F.concat(kept, extra))


def router_tokens(c: Column) -> Column:
    return _sorted_set(F.filter(search_tokens(c, 2), lambda t: ~t.isin(*V.LITERAL_STOP, *V.ROUTE_STOP)))


def lexical_tokens(c: Column) -> Column:
    return _sorted_set(F.filter(search_tokens(c, 2), lambda t: ~t.isin(*V.LEXICAL_STOP)))


def label_matches(label: Column, tokens: Column) -> Column:
    """A token equals a segment of the label or, from six letters on, begins one."""
    segments = search_tokens(label, 0)
    return F.exists(tokens, lambda t: F.exists(segments, lambda s: (s == t) | ((F.length(t) >= 6) & s.startswith(t))))


def lexical_count(tokens: Column, *texts: Column) -> Column:
    """Over all tokens, in how many of the texts each occurs."""
    one = lambda t: reduce(lambda a, b: a + b, [x.contains(t).cast("int") for x in texts])
    return F.aggregate(F.transform(tokens, one), F.lit(0), lambda a, x: a + x)


def occurrences(text: Column, token: Column) -> Column:
    """Occurrences that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, token, F.lit("")))) / F.length(token)).cast("int")


def score_text(tokens: Column, text: Column) -> Column:
    low = ascii_lower(text)
    return F.aggregate(F.transform(tokens, lambda t: occurrences(low, t)), F.lit(0), lambda a, x: a + x)


def contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def slug(c: Column, default: str = "item") -> Column:
    s = F.regexp_replace(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, 80), "-+$", "")
    return F.when(s == "", default).otherwise(s)


def truncated(c: Column, n: int) -> Column:
    """First n characters; what is cut is said."""
    more = F.length(c) - n
    return F.when(more > 0, F.concat(F.substring(c, 1, n), F.lit("… [+"), more.cast("string"), F.lit(" chars in the indexed chunk]"))).otherwise(c)


def short_symbol(c: Column) -> Column:
    parts = F.split(c, "/")
    return F.when(F.size(parts) > 2, F.concat(F.lit("…/"), F.array_join(F.slice(parts, F.size(parts) - 1, 2), "/"))).otherwise(c)


def change_kind(c: Column) -> Column:
    hit = F.exists(search_tokens(c, 0), lambda t: reduce(lambda a, b: a | b, [t.startswith(w) for w in V.BUG_WORDS]))
    return F.when(hit, "bug").otherwise("feature")


def like_escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def line_range(start: Column, end: Column) -> Column:
    return (
        F.when(start.isNull(), "n/a")
        .when(end.isNull() | (start == end), start.cast("string"))
        .otherwise(F.concat(start.cast("string"), F.lit("-"), end.cast("string")))
    )


def dir_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def uuid5(name: Column, namespace: str = V.ID_NAMESPACE) -> Column:
    """Name-based id (version 5) as lower-case text."""
    raw = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(words("8", "9", "a", "b"), (F.conv(F.substring(raw, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat(
        F.substring(raw, 1, 8), F.lit("-"), F.substring(raw, 9, 4), F.lit("-5"), F.substring(raw, 14, 3), F.lit("-"), variant, F.substring(raw, 18, 3), F.lit("-"), F.substring(raw, 21, 12)
    )


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    script = path.contains(".test.") | path.contains(".spec.") | path.contains("__tests__/") | path.contains("__test__/")
    python = low.endswith("_test.py") | low.contains("/test_") | low.startswith("test_") | low.contains("/tests/")
    return script | python


def is_test_symbol(name: Column) -> Column:
    low = ascii_lower(name)
    return low.startswith("test") | low.endswith("test") | low.startswith("spec") | low.endswith("spec")


def construct_service(c: Column) -> Column:
    low = ascii_lower(c)
    out = None
    for service, marks in V.CONSTRUCT_SERVICES:
        out = (F if out is None else out).when(contains_any(low, marks), service)
    return out.otherwise("aws")


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return (
        F.when(ext == "rs", "rust").when(ext.isin("ts", "tsx", "mts", "cts"), "typescript").when(ext.isin("js", "jsx", "mjs", "cjs"), "javascript")
        .when(ext.isin("py", "pyi"), "python").when(ext == "sol", "solidity").when(ext.isin("md", "mdx"), "markdown").when(ext == "pdf", "pdf").otherwise("unknown")
    )


def is_indexable(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    exact = name.isin("package.json", "Cargo.toml", "cdk.json", "tsconfig.json", "jsconfig.json")
    return exact | path.rlike(r"\.(rs|ts|tsx|mts|cts|js|jsx|mjs|cjs)$") | path.rlike(r"(?i)\.(md|mdx|sol|pdf|py|pyi)$")


def import_package(spec: Column) -> Column:
    """Package part of a module specifier."""
    return F.regexp_extract(spec, "^(@[^/]+/[^/]+|[^/@][^/]*)", 1)


def is_bare(spec: Column) -> Column:
    return ~spec.rlike(r"^(\.|/|~/|@/)")


def task_tokens(c: Column) -> Column:
    """Tokens of a task, longer than two characters and without stop words, each once."""
    return F.array_distinct(F.filter(search_tokens(c, 2), lambda t: ~t.isin(*V.TASK_STOP)))


def rust_uses(content: Column, name: Column) -> Column:
    """A Rust text uses the crate; a dash in its name is an underscore in code."""
    n = F.translate(name, "-", "_")
    return content.contains(F.concat(F.lit("use "), n, F.lit("::"))) | content.contains(F.concat(F.lit("use "), n, F.lit(";"))) | content.contains(F.concat(F.lit("extern crate "), n))


def looks_like_constructs(content: Column) -> Column:
    # Marks of a file with infrastructure constructs.
    return contains_any(content, ["aws-cdk-lib", "@aws-cdk/", "constructs", "extends Stack", "cdk."])
