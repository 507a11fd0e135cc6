"""Architecture layers of paths and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import ascii_lower, words


def of_path(path: Column, kind: Column) -> Column:
    low = ascii_lower(path)
    segments = F.split(low, r"[/\\]")
    has = lambda names: F.arrays_overlap(segments, words(*names))
    named = dict(V.PATH_LAYERS)
    return (
        F.when((path == "") & (kind == "deployment_resource"), "foundation")
        .when(path == "", "unknown")
        .when(has(named["core"]), "core")
        .when(has(named["interface"]) | low.contains("/pages/api/"), "interface")
        .when(has(named["entry"]), "entry")
        .when(low.endswith(".sol") | low.endswith(".tf") | (kind == "deployment_resource") | has(named["foundation"]), "foundation")
        .otherwise("unknown")
    )


def of_word(word: Column) -> Column:
    out = None
    for layer, names in V.WORD_LAYERS.items():
        out = (F if out is None else out).when(word.isin(*names), layer)
    return out


def rank(layer: Column) -> Column:
    out = None
    for name, r in V.LAYER_RANK.items():
        out = (F if out is None else out).when(layer == name, r)
    return out
