import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from trellisq.llm import lookalike as L


def form(*texts):
    return L.consistent_forms(pa.array(texts, pa.string())).to_pylist()


def test_what_does_not_change_the_look():
    same = ["Größe naïve ガ й", "Größe naïve ガ й", "Gr­öße naïve ガ　й", "﻿Größe naïve​ ガ й‍", "Ｇröße naïve ガ й", "Größe naïve ガ й️", "Grӧßе naïve ガ й"]
    assert len(set(form(*same))) == 1
    assert len(set(form("a-b", "a‐b", "a‑b", "ａ－ｂ"))) == 1
    assert len(set(form("МЕМО pass", "ΜΕΜΟ pаѕѕ", "MEMO pass"))) == 1
    assert form("µm")[0] == form("μm")[0]


def test_what_does():
    for a, b in (("m2", "m²"), ("LOG", "log"), ("cafe", "café"), ("6½", "6 1/2"), ("か", "が"), ("a b", "a  b"), ("a-b", "a–b"), ("l0", "lO"), ("a\tb", "a b"), ("ａ１", "a2"), ("a", "ä")):
        assert len(set(form(a, b))) == 2, (a, b)


def test_rows_stay_apart():
    assert form("a", "̈", None, "", "o", "̈x", "a\0b", "\0") == ["a", "̈", None, "", "o", "̈x", "ab", ""]


plain = st.text(st.characters(min_codepoint=0x20, max_codepoint=0x1FFF, categories=["L", "M", "Nd", "P"]), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(plain, max_size=6))
def test_composition_is_canonical(texts):
    t = L.Tables.get()
    kept = ["".join(c for c in x if t.first[ord(c)] == ord(c) and all(t.second[ord(d)] == ord(d) for d in unicodedata.normalize("NFD", c))) for x in texts]
    assert form(*kept) == [unicodedata.normalize("NFC", x) for x in kept]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=20), max_size=5))
def test_forms_are_stable(texts):
    texts = [x for x in texts if not any(0xD800 <= ord(c) < 0xE000 for c in x)]
    once = form(*texts)
    assert form(*once) == once


def test_slices(monkeypatch):
    texts = [f"é{i}" * (i % 7) for i in range(200)]
    want = form(*texts)
    monkeypatch.setattr(L, "SLICE", 50)
    assert form(*texts) == want == [unicodedata.normalize("NFC", x) for x in texts]


def test_pairs(spark):
    rows = [(1, "Pass 1"), (2, "Pаss 1"), (3, "Pass 1"), (4, "pass 1"), (5, None), (6, ""), (7, " "), (8, " "), (9, "Pass 1"), (10, "​"), (None, "Pаss 1")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, form string, look string")
    got = {(r.doc_id_a, r.doc_id_b) for r in L.lookalike_pairs(df).collect()}
    assert got == {(1, 2), (2, 3), (1, 9), (2, 9), (3, 9)}
    assert L.lookalike_pairs(df.where("false")).count() == 0
    many = spark.range(20000).selectExpr("id as doc_id", "'the same text' as text").union(spark.sql("select 99999L, 'the same text'"))
    assert L.lookalike_pairs(many).count() == 20000


def test_classes_and_many_copies(spark):
    """A look with two spellings and many copies: a class row for each document, and pairs between spellings only."""
    rows = [(i, "caf\u00e9") for i in range(300)] + [(1000, "cafe\u0301"), (1001, "cafe\u0301"), (2000, "other"), (2001, None), (2002, "  "), (2003, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in L.lookalike_classes(df).collect()}
    assert len(got) == 303 and got[5] == (0, 0, 2, 302) and got[1001] == (0, 1000, 2, 302) and got[2000] == (2000, 2000, 1, 1)
    pairs = {(r.doc_id_a, r.doc_id_b) for r in L.lookalike_pairs(df).collect()}
    assert pairs == {(i, j) for i in range(300) for j in (1000, 1001)}
    assert L.lookalike_classes(df.where("false")).count() == 0
