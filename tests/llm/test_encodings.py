"""Page-for-page swaps beyond western pages and short runs, and how readings are applied."""

import random

import pytest

from loamgraph.llm import mojibake as M

WORDS = "система хранит каждый узел графа отдельно поэтому запрос сначала читает таблицу ключей затем проверяет подпись и возвращает только новые строки если журнал пуст обработка начинается заново после сбоя работник повторяет задачу без потерь".split()
SCHEMA = "doc_id long, text string, source string, n_chars int"


def russian(rng, n=40):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


@pytest.mark.parametrize("wrote,read", [("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp1252")])
def test_cyrillic_pages(spark, wrote, read):
    rng = random.Random(4)
    good = [russian(rng) for _ in range(60)]
    bad = [t.encode(wrote).decode(read, errors="replace") for t in good[:8]]
    keep = [i for i, t in enumerate(bad) if M.REPLACED not in t]
    rows = [(i, t, "wiki", 1) for i, t in enumerate(good)] + [(100 + i, bad[i], "mail", 1) for i in keep]
    got = {r.doc_id: r for r in M.garbled(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {100 + i for i in keep} and keep
    assert sum(got[100 + i].restored == good[i] for i in keep) >= 0.75 * len(keep)


def test_runs_of_any_length_have_readings():
    for n in (1, 4, 5, 40):
        plain = ("äöüßé" * 8)[:n]
        assert plain in dict(M.readings(plain.encode("cp1252").decode("mac_roman")))
    long_ = "é" * 30
    assert long_ in dict(M.readings(long_.encode().decode("cp1252")))
    many = "é"
    for _ in range(6):
        many = many.encode().decode("latin-1")
    assert "é" in dict(M.readings(many))


def test_parts_longer_than_twelve():
    run = "日" + "–".encode().decode("cp1252") * 9 + "日"
    parts = [u for _, u, _, _ in M._parts(0, run, " ", " ")]
    assert "".join(parts) == run and len(max(parts, key=len)) == 27


def test_single_characters_are_translated_outside_code():
    text = "pr\x8fa `\x8f` b\x8f, c\x8fx"
    table = {("\x8f", le, r): "ü" for _, _, le, r in M.units(text)}
    assert M.restore(text, table) == "prüa `\x8f` bü, cüx"
    some = {k: v for k, v in table.items() if k[1] == "r"}
    assert M.restore(text, some) == "prüa `\x8f` b\x8f, c\x8fx"


def test_empty_null_and_code_only(spark):
    rows = [(1, None, "a", 1), (2, "", "a", 1), (3, "plain", None, 1), (4, "`Ã©`", "a", 1), (None, "Ã©", "a", 1)]
    assert M.garbled(spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert M.garbled(spark.createDataFrame([], SCHEMA)).count() == 0
