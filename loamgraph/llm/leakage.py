"""Problem 8: evaluation texts leaking into documents.

Prefix-filtered set join.  Both sides become words, words become five-word shingles.  Each window of ``run`` (12)
consecutive item words is a set of eight shingles that must all occur in the document, so one prefix token is
enough: the window's rarest shingle, by its count over all documents.  Documents join on prefix tokens only; a
candidate's position fixes the alignment (positional bound: the whole window must lie inside the text), and the
window's words are compared exactly.  The join is on hashes; a collision cannot survive the comparison.

Defined results: null and empty texts have no windows; texts shorter than the run are never cases; items with the
same text all count; repeated rows count once; ids that are null are kept out; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

SHINGLE = 5
RUN = 12

#: Tags that stand inside words; any other tag parts words.
INLINE_TAGS = r"(?i)</?(?:em|strong|b|i|u|s|span|mark|code|del|ins|sub|sup|a|font|small)(?:\s[^<>]*)?/?>"


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case, without tags, entities, emphasis and line marks."""
    t = F.regexp_replace(text, INLINE_TAGS, "")
    t = F.regexp_replace(t, r"<[/!?]?[A-Za-z][^<>]*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});", " ")
    t = F.regexp_replace(t, r"(?m)^[ \t]*(?:(?:[>#*+\-|•]+|[0-9]{1,3}[.)])[ \t]+)+", " ")
    t = F.regexp_replace(t, "[*~­​‌‍⁠﻿]", "")
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")


def _shingles(words_of: Column) -> Column:
    """[(position from 0, hash)], empty for fewer words than a shingle has."""
    # bound as a lambda's variable: inside transform() the expression itself would be computed for each position
    return F.flatten(F.transform(F.array(words_of), _shingles_of))


def _shingles_of(w: Column) -> Column:
    one = lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(w, i + 1, SHINGLE)).alias("h"))
    return F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), one)).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>"))


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, item_id): the document holds at least ``run`` consecutive words of the item's text."""
    per_window = run - SHINGLE + 1
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    item = items.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    # equal texts are one query
    texts = item.groupBy("text").agg(F.min("item_id").alias("text_id")).select("text_id", "text", words(F.col("text")).alias("words"))
    texts = stored(texts, "eval-texts")
    parts = texts.select("text_id", F.explode(_shingles(F.col("words"))).alias("s")).select("text_id", F.col("s.pos").alias("ipos"), F.col("s.h").alias("h"))

    # shingles of documents that occur in any item: the items' side is small, whatever the corpus's size
    hits = docs.select("doc_id", F.explode(_shingles(words(F.col("text")))).alias("s")).select("doc_id", F.col("s.pos").alias("dpos"), F.col("s.h").alias("h"))
    hits = stored(hits.join(parts.select("h").distinct(), "h", "left_semi"), "eval-hits")

    rarity = hits.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    # every window's rarest shingle; one that no document has ends its windows
    ranked = parts.join(rarity, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    starts = ranked.select("text_id", "ipos", "h", "n", F.explode(F.sequence(F.greatest(F.lit(0), F.col("ipos") - (per_window - 1)), F.col("ipos"))).alias("start"))
    prefix = (
        starts.groupBy("text_id", "start")
        .agg(F.min(F.struct("n", "h", "ipos")).alias("m"), F.count(F.lit(1)).alias("k"))
        .filter((F.col("k") == per_window) & (F.col("m.n") > 0))
        .select("text_id", "start", F.col("m.h").alias("h"), F.col("m.ipos").alias("ipos"))
    )
    found = hits.join(prefix, "h").select("doc_id", "text_id", "start", (F.col("dpos") - F.col("ipos") + F.col("start")).alias("at")).filter("at >= 0").distinct()
    # exact comparison; only documents with a candidate are tokenised again
    found = found.groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("start", "at")).alias("tries"))
    candidates = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", words(F.col("text")).alias("dw"))
    # tries are bounded by the item's words times the places of a prefix token in one document
    same = F.exists("tries", lambda t: (t["at"] + run <= F.size("dw")) & (F.slice("dw", t["at"] + 1, run) == F.slice("words", t["start"] + 1, run)))
    proven = found.join(candidates, "doc_id").join(texts.select("text_id", "words"), "text_id").filter(same).select("doc_id", "text_id").distinct()
    classes = item.join(texts.select("text_id", "text"), "text").select("text_id", "item_id")
    return proven.join(classes, "text_id").select("doc_id", "item_id").distinct()


def leak_report(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """Every item with the number of documents that it leaked into."""
    n = leaks(documents, items, run).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return items.select("item_id").distinct().join(n, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))
