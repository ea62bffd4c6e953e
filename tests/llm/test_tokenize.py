import os
import random

import pytest

from trellisq.llm.tokenize import VOCABULARY, PrefixEncoder, encode_corpus

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def samples():
    rng = random.Random(8)
    out = ["", " ", "\n\n  x", "<|endoftext|>", "a<|endoftext|> b", "don't we'll I'M", "=" * 3000, " " * 2001, "ab" * 2500, "naïve façade 壁の厚さ 🏗️✅", "\u0000\u0001", "é" * 500]
    for _ in range(8000):
        kind = rng.random()
        if kind < 0.4:
            out.append("".join(rng.choices("abcdeinorstlhuxABZ", k=rng.randint(1, 30))))
        elif kind < 0.7:
            out.append("".join(rng.choices("aAeE=-_ \n.,1", k=rng.randint(1, 60))))
        else:
            out.append("".join(chr(rng.choice([rng.randrange(32, 0x2000), rng.randrange(0x3000, 0xD7FF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randint(1, 15))))
    return out


def test_ids_are_those_of_the_merges(reference):
    e, texts = PrefixEncoder(VOCABULARY), samples()
    for t, want in zip(texts, reference(texts)):
        assert e.encode(t) == want


def test_round_trip():
    e = PrefixEncoder(VOCABULARY)
    for t in samples()[:500]:
        assert "".join(e.text[i] for i in e.encode(t)).encode("latin-1").decode() == t


def test_corpus(spark, reference):
    texts = [None, "", "wall W-7 is 5 m²", "wall W-7 is 5 m²", "x" * 100_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode_corpus(df).collect()}
    assert got == {i: x for i, x in enumerate(reference([t or "" for t in texts]))}
    assert encode_corpus(df.where("false")).count() == 0
