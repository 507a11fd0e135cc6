"""Problem 10: text decoded with a wrong character encoding.

Every run of non-ASCII characters is a cipher unit.  Its readings are the unit itself and what an unknown swap of
code pages could have made it from.  Over all documents, counted in one pass with partial aggregation, the units'
contexts (the characters left and right) and the bigrams of letters are gathered; then, per source and unit,
expectation-maximization learns how often the unit stands for each of its readings, with the bigram model as the
language.  A unit whose learned reading is not itself is garbled where its context agrees; the learned mapping is
applied with ``translate``.  The mapping of one unit needs that unit's counts only, so sources and units run in
parallel and a source that holds a third of all rows is only larger counts.

Exact check: a reading counts only if encoding it with one code page and decoding it with another gives the garbled
text back.  Text with the replacement character is garbled but cannot be restored.  Text in backticks (inline or
fenced) is a sample and is left alone.

Defined results: null and empty texts have no case; repeated rows count once; a null source is a source of its own;
very long texts are processed whole; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

PAGES = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1251", "cp1250", "iso8859-15", "koi8-r", "cp866")
#: Pages by what they were made for; a text is written with a page of its script and read with any other page.
WESTERN = ("cp1252", "mac_roman", "cp850")
CENTRAL = ("cp1250", "iso8859-2", "cp852")
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
#: Single-byte swaps: written with the first, read with the second.
SWAPS = (
    *((a, b) for a in WESTERN for b in ("mac_roman", "cp850", "cp437", "cp1252", "cp1251") if a != b),
    *((a, b) for a in CENTRAL for b in (*CENTRAL, "cp1252") if a != b),
    *((a, b) for a in CYRILLIC for b in (*CYRILLIC, "cp1252", "latin-1", "mac_roman", "cp437", "cp850") if a != b),
)
REPLACED = "�"
RUN = re.compile(r"[^\x00-\x7f]+")
CODE = re.compile(r"```.*?(?:```|\Z)|``[^\n]*?``|`[^`\n]*`", re.S)
EM_ROUNDS = 25
#: Log-likelihood that a page-for-page reading must gain in its place.
LEAST_GAIN = 3.0
#: The language model has the letters of Latin and Cyrillic and the marks of such texts, which bounds its size (about 550
#: x 680 pairs).  What has other letters is judged by its form as UTF-8 only.
_MARKS = set("‘’‚“”„–—…•‹›€«»¿¡§°·´¨ºª©®™\xa0½¼¾²³¹×÷±")


def _in_model(c: str) -> bool:
    return c < "\x80" or c in _MARKS or "À" <= c <= "ɏ" and c.isalpha() or "Ѐ" <= c <= "ӿ" and c.isalpha()


def _latin(c: str) -> bool:
    return c.isalpha() and (c.isascii() or "À" <= c <= "ɏ")


def _encode(text: str, page: str) -> bytes | None:
    out = bytearray()
    for c in text:
        try:
            out += c.encode(page)
        except UnicodeEncodeError:
            if page in ("cp1252", "cp1251", "cp1250") and "\x80" <= c <= "\x9f":
                out.append(ord(c))  # bytes that the page leaves undefined come through as control characters
            else:
                return None
    return bytes(out)


@functools.lru_cache(maxsize=1 << 16)
def readings(unit: str) -> tuple[tuple[str, str], ...]:
    """(reading, how) of what the unit could have been: UTF-8 read as a code page, once or repeatedly; page for page."""
    out: dict[str, str] = {}
    now = {unit: ""}
    while now:  # every round makes the text shorter
        nxt: dict[str, str] = {}
        for text, how in now.items():
            for page in PAGES:
                raw = _encode(text, page)
                if raw is None or not any(b >= 0x80 for b in raw):
                    continue
                try:
                    plain = raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if plain != text and len(plain) < len(text):
                    nxt.setdefault(plain, f"{how}utf-8 as {page};")
        for k, v in nxt.items():
            out.setdefault(k, v)
        now = nxt
    for wrote, read in SWAPS:
        raw = _encode(unit, read)
        if raw is None:
            continue
        try:
            plain = raw.decode(wrote)
        except UnicodeDecodeError:
            continue
        if plain == unit or not all(_in_model(c) and not unicodedata.category(c).startswith("C") for c in plain):
            continue
        # another script is only read into what has known letters and marks only, and only as letters of it
        if wrote in CYRILLIC and not (all(_in_model(c) for c in unit) and all("Ѐ" <= c <= "ӿ" for c in plain)):
            continue
        out.setdefault(plain, f"{wrote} as {read};")
    out.pop(unit, None)
    return tuple(out.items())


def _is_utf8(how: str) -> bool:
    return how.startswith("utf-8 as")


def visible(text: str) -> str:
    """The text with code blanked out at equal length."""
    return CODE.sub(lambda m: " " * len(m.group()), text)


def units(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(place, unit, left, right): every run outside code, in parts where only a part can be read otherwise."""
    plain = visible(text)
    for m in RUN.finditer(plain):
        left = plain[m.start() - 1] if m.start() else "\n"
        right = plain[m.end()] if m.end() < len(plain) else "\n"
        run = m.group()
        yield m.start(), run, left, right
        if len(run) > 1 and not any(_is_utf8(h) for _, h in readings(run)):
            yield from _parts(m.start(), run, left, right)


def _longest(text: str) -> int:
    """Characters of the longest beginning that is UTF-8 read as a code page."""
    best = 1
    for page in PAGES:
        end = next((i for i, c in enumerate(text) if _encode(c, page) is None), len(text))
        raw = _encode(text[:end], page) or b""
        try:
            good = raw.decode("utf-8")
        except UnicodeDecodeError as e:
            good = raw[: e.start].decode("utf-8")
            end = e.start
        if len(good) < end:
            best = max(best, end)
    return best


def _parts(at: int, run: str, left: str, right: str) -> Iterator[tuple[int, str, str, str]]:
    """Parts of a run that is not wholly readable: the longest readable piece from each place, else the character."""
    i = 0
    while i < len(run):
        size = _longest(run[i:])
        yield at + i, run[i : i + size], run[i - 1] if i else left, run[i + size] if i + size < len(run) else right
        i += size


def _counts(source: str, text: str) -> tuple[Counter, Counter]:
    """Bigrams of the model's letters, and units with contexts."""
    pairs: Counter = Counter()
    low = visible(text)
    for m in re.finditer(r"[^\x00-\x7f]", low):
        i = m.start()
        if i:
            pairs[low[i - 1], m.group()] += 1
        if i + 1 < len(low) and low[i + 1] < "\x80":
            pairs[m.group(), low[i + 1]] += 1
    seen = Counter((u, le, r) for _, u, le, r in units(text) if readings(u))
    return pairs, seen


def scanned(documents: DataFrame) -> DataFrame:
    """(kind, doc_id, source, a, b, c, n), in one pass over all texts: L letters, B bigrams, and U for every document its
    units that have another reading, with their contexts (and the mark of lost characters)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total: Counter = Counter()
            rows = []
            for doc, source, text in zip(b.doc_id, b.source, b.text):
                if text.isascii():
                    for c, n in Counter(text).items():
                        total["L", c, ""] += n
                    continue
                for c, n in Counter(visible(text)).items():
                    if _in_model(c):
                        total["L", c, ""] += n
                pairs, seen = _counts(source, text)
                for (x, y), n in pairs.items():
                    if _in_model(x) and _in_model(y):
                        total["B", x, y] += n
                if REPLACED in visible(text):
                    rows.append(("U", doc, source, REPLACED, "", "", 1))
                rows += [("U", doc, source, u, le, r, n) for (u, le, r), n in seen.items()]
            yield pd.DataFrame([*rows, *((k, None, "", x, y, "", n) for (k, x, y), n in total.items())], columns=["kind", "doc_id", "source", "a", "b", "c", "n"]).astype({"doc_id": "Int64"})

    rows = documents.filter("text is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    return rows.mapInPandas(run, "kind string, doc_id long, source string, a string, b string, c string, n long")


class Language:
    """Smoothed letter bigrams; upper and lower case differ, as a wrong page often turns one into the other."""

    def __init__(self, letters: dict[str, int], pairs: dict[tuple[str, str], int]):
        self.letters, self.pairs = letters, pairs
        self.total = max(1, sum(letters.values()))

    def log(self, a: str, b: str) -> float:
        base = (self.letters.get(b, 0) + 0.05) / self.total
        return math.log((self.pairs.get((a, b), 0) + 20 * base) / (self.letters.get(a, 0) + 20))

    def score(self, left: str, reading: str, right: str) -> float:
        text = left + reading + right
        return sum(self.log(x, y) for x, y in zip(text, text[1:]) if not (x < "\x80" and y < "\x80"))


def learn(unit: str, contexts: list[tuple[str, str, int]], lm: Language) -> list[tuple[str, str, float]]:
    """EM for one unit of one source: (reading, how, weight); the unit itself has no how."""
    options = [(unit, ""), *readings(unit)]
    scores = [[lm.score(le, x, r) for x, _ in options] for le, r, _ in contexts]
    # a sequence that happens to be valid UTF-8 in another page is strong evidence by its form alone
    weight = [1.0] + [float(4 ** (len(unit) - len(x))) if _is_utf8(h) else 1.0 for x, h in options[1:]]
    theta = [w / sum(weight) for w in weight]
    prior = list(theta)
    for _ in range(EM_ROUNDS):
        got = [p * 0.5 for p in prior]
        for row, (_, _, n) in zip(scores, contexts):
            top = max(row)
            part = [t * math.exp(s - top) for t, s in zip(theta, row)]
            z = sum(part) or 1.0
            for i, p in enumerate(part):
                got[i] += n * p / z
        z = sum(got)
        new = [g / z for g in got]
        if max(abs(x - y) for x, y in zip(new, theta)) < 1e-6:
            theta = new
            break
        theta = new
    return [(x, h, t) for (x, h), t in zip(options, theta)]


def mapping(seen: DataFrame) -> DataFrame:
    """(source, unit, left, right, reading, how, gain): every context in which a unit is read as something else."""
    lm = seen.filter("kind in ('L', 'B')").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()  # bounded by the model's alphabet
    letters = {r.a: r.n for r in lm if r.kind == "L"}
    pairs = {(r.a, r.b): r.n for r in lm if r.kind == "B"}

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        model = Language(letters, pairs)
        source, unit = key
        contexts = list(zip(b.b, b.c, b.n))
        options = learn(unit, contexts, model)
        rows = []
        for le, r, _ in contexts:
            # a page-for-page swap is only believed where the reading is far likelier in its place
            values = [math.log(max(t, 1e-9)) + model.score(le, x, r) for x, _, t in options]
            best = max(range(len(options)), key=values.__getitem__)
            # a lone symbol between spaces, or a word of another script, is no evidence; a lone symbol is read so where
            # the document is garbled in the same way
            lone = not (_is_utf8(options[best][1]) or _latin(le) or _latin(r) or len(options[best][0]) > 2 and options[best][1].split(" ")[0] in CYRILLIC)
            if best and (_is_utf8(options[best][1]) or values[best] - values[0] >= LEAST_GAIN):
                rows.append((source, unit, le, r, options[best][0], options[best][1], values[best] - values[0], lone))
        return pd.DataFrame(rows, columns=["source", "unit", "left", "right", "reading", "how", "gain", "lone"])

    counts = seen.filter((F.col("kind") == "U") & (F.col("a") != REPLACED)).groupBy("source", "a", "b", "c").agg(F.sum("n").alias("n"))
    # by number: put together by size, one task would learn everything
    parts = int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counts.repartition(parts, "source", "a").groupBy("source", "a").applyInPandas(run, "source string, unit string, left string, right string, reading string, how string, gain double, lone boolean")


#: Log-likelihood that a document's page-for-page units must gain together.
SWAP_GAIN = 6.0
UTF8_GAIN = 0.0


def evidence(documents: DataFrame) -> DataFrame:
    """(doc_id, readings): garbled documents with the readings to apply, null where nothing can be restored."""
    seen = stored(scanned(documents), "encoding-units")
    learned = stored(mapping(seen), "encoding-map")
    at = seen.filter("kind = 'U' and doc_id is not null").select("doc_id", "source", F.col("a").alias("unit"), F.col("b").alias("left"), F.col("c").alias("right"), "n").dropDuplicates(["doc_id", "unit", "left", "right"])
    key = ["source", "unit", "left", "right"]
    known = at.join(learned, key, "left").filter((F.col("unit") == REPLACED) | F.col("reading").isNotNull())
    utf8 = F.col("how").startswith("utf-8 as")
    per_doc = known.groupBy("doc_id").agg(
        F.max((F.col("unit") == REPLACED).cast("int")).alias("lost"),
        F.max(F.when(utf8, F.col("gain"))).alias("utf8"),
        F.sum(F.when(~utf8 & ~F.col("lone"), F.col("gain") * (1 + F.log2("n")))).alias("swap"),
        # one row per distinct unit and context of the document
        F.collect_list(F.when(F.col("reading").isNotNull(), F.struct("unit", "left", "right", "reading", "how", "gain", "lone"))).alias("readings"),
    )
    return per_doc.filter((F.col("lost") == 1) | (F.col("utf8") > UTF8_GAIN) | (F.col("swap") > SWAP_GAIN))


@functools.lru_cache(maxsize=256)
def page_cipher(how: str) -> dict[int, str]:
    """The whole mapping of characters of a page-for-page swap."""
    wrote, read = how.rstrip(";").split(" as ")
    out = {}
    for byte in range(0x80, 0x100):
        try:
            wrong, right = bytes([byte]).decode(read), bytes([byte]).decode(wrote)
        except UnicodeDecodeError:
            continue
        if wrong != right:
            out[ord(wrong)] = right
    return out


def translated(text: str, cipher: dict[int, str]) -> str:
    """The text outside code, translated."""
    out, at = [], 0
    for m in CODE.finditer(text):
        out += [text[at : m.start()].translate(cipher), m.group()]
        at = m.end()
    return "".join(out) + text[at:].translate(cipher)


def restore(text: str, table: dict[tuple[str, str, str], str]) -> str:
    """Apply the learned readings outside code: single characters that the document always reads alike with translate(),
    the rest place by place."""
    spans, ways = [], {}
    for place, unit, le, r in units(text):
        reading = table.get((unit, le, r))
        if len(unit) == 1:
            ways.setdefault(unit, set()).add(reading)
        if reading is not None:
            spans.append((place, unit, reading))
    cipher = str.maketrans({u: next(iter(w)) for u, w in ways.items() if len(w) == 1 and None not in w})
    keep = [m.span() for m in CODE.finditer(text)] if cipher else []

    def plain(a: int, b: int) -> str:
        out = []
        for x, y in keep:
            if y > a and x < b:
                out += [text[a : max(a, x)].translate(cipher), text[max(a, x) : min(b, y)]]
                a = min(b, y)
        return "".join(out) + text[a:b].translate(cipher)

    out, at = [], 0
    for place, unit, reading in spans:
        if place >= at and not (len(unit) == 1 and ord(unit) in cipher):
            out += [plain(at, place), reading]
            at = place + len(unit)
    return "".join(out) + plain(at, len(text))


def garbled(documents: DataFrame) -> DataFrame:
    """(doc_id, how, restored): every garbled document; restored is null where characters are lost for good."""
    found = evidence(documents).select("doc_id", "lost", "readings", "utf8", "swap")
    rows = documents.filter("text is not null and doc_id is not null").select("doc_id", "text").dropDuplicates(["doc_id"]).join(found, "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fixed, how = [], []
            for text, lost, use in zip(b.text, b.lost, b.readings):
                sure = {x["how"] for x in use if not x["lone"]}
                use = [x for x in use if not x["lone"] or x["how"] in sure]
                ok = {(x["unit"], x["left"], x["right"]): x["reading"] for x in use}
                how.append(sorted({x["how"] for x in use} | ({"lost"} if lost else set())))
                votes = Counter(x["how"] for x in use if not x["lone"])
                most = max(votes, key=lambda h: (votes[h], h), default="")
                if most.split(" ")[0] in CYRILLIC:  # in such a text every letter is of the page, words of one letter too
                    fixed.append(None if lost else translated(text, page_cipher(most)))
                    how[-1] = sorted({most} | ({"lost"} if lost else set()))
                else:
                    fixed.append(None if lost else restore(text, ok))
            yield pd.DataFrame({"doc_id": b.doc_id, "how": how, "restored": fixed})

    return rows.select("doc_id", "text", "lost", "readings").mapInPandas(run, "doc_id long, how array<string>, restored string")
