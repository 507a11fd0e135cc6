"""Credentials and signs that are longer, or stand further down, than a screen."""

import base64
import random

from loamgraph.llm import handwritten, secrets


def test_header_value_of_any_length():
    rng = random.Random(7)
    opaque = "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789", k=9000))
    basic = base64.b64encode(("svc:" + opaque[:900]).encode()).decode()
    for scheme, v in (("Bearer", opaque[:800]), ("Bearer", opaque), ("Basic", basic)):
        text = f"curl -H 'Authorization: {scheme} {v}' https://host/\n"
        assert secrets.redact(text, secrets.scan(text)) == text.replace(v, secrets.PLACEHOLDER)


def test_signs_below_a_long_head():
    licence = "".join(f"// Line {i} of a licence text that goes on for a while, and then for a while more.\n" for i in range(90))
    code = "fn f() -> u8 {\n    1\n}\n"
    assert handwritten.signs("a/b.rs", licence + code, "own") == []
    assert handwritten.signs("a/b.rs", licence + "// Code generated by protoc. DO NOT EDIT.\n" + code, "own") == ["generated"]
    assert handwritten.signs("a/b.rs", licence + "// Copyright (c) 2020 The Quux Authors\n" + code, "own") == ["third_party"]
    assert handwritten.signs("a/b.rs", "#![allow(\n    dead_code,\n)]\n// @generated by bindgen\n" + code, "own") == ["generated"]
    assert handwritten.signs("a/b.rs", code + "// @generated by bindgen\n", "own") == []
    assert handwritten.signs("a/b.py", '"""\nModule of tables.\n\nThis file was automatically generated by mk.\n"""\nx = 1\n', "own") == ["generated"]
    assert handwritten.signs("a/b.py", '"""Tables."""\nx = """\n# @generated by mk\n"""\n', "own") == []
    assert handwritten.signs("a/b.js", "let a = 1;\n//# sourceMappingURL=data:application/json;base64," + "QUJD" * 300 + "\n", "own") == ["minified"]
