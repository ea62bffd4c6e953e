import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trellisq.llm import chunk as C


def check(text, limit=C.LIMIT, overlap=C.OVERLAP, slack=C.SLACK):
    cuts = C.pieces(text, limit, overlap, slack)
    if len(text) <= limit:
        assert cuts == []
        return cuts
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and len(cuts) > 1
    assert all(0 < b - a <= limit for a, b in cuts)
    for (_, b), (a2, b2) in zip(cuts, cuts[1:]):
        assert overlap - slack <= b - a2 <= overlap and b2 > b
    return cuts


bits = st.sampled_from(["wall ", "door. ", "beam, ", "\n", "x" * 40, "壁の厚さ。", "é", "? ", "- ", "12.5 "])


@settings(max_examples=300, deadline=None)
@given(st.lists(bits, max_size=200))
def test_any_text(parts):
    check(C.squeeze("".join(parts)), 200, 30, 10)


def test_boundaries():
    text = C.squeeze(" ".join(f"Sentence number {i} is about walls." for i in range(200)))
    cuts = check(text)
    assert all(text[b - 2 : b] == ". " for _, b in cuts[:-1]) and all(text[a - 1] == " " for a, _ in cuts[1:])
    words = C.squeeze("word " * 1000)
    assert all(words[b - 1] == " " for _, b in check(words)[:-1])
    none = "x" * 5000
    assert check(none)[0] == (0, 1500)
    early = "A sentence is here " * 20 + ". " + "x" * 4000
    assert check(early)[0][1] == 382


def test_topic_valley():
    """The cut falls where the vocabulary changes, not at the last joint."""
    rng = random.Random(1)
    a, b = "gravel asphalt kerb paving drainage culvert".split(), "violin cello quartet sonata tempo chorus".split()
    say = lambda v: " ".join(rng.choices(v, k=8)).capitalize() + ". "
    first = "".join(say(a) for _ in range(18))
    text = C.squeeze(first + "".join(say(b) for _ in range(30)))
    assert 750 <= len(first) <= 1400 and C.pieces(text)[0][1] == len(first)


def test_cohesion_against_plain_count():
    rng = random.Random(2)
    parts = [C._terms(" ".join(rng.choices("alpha beta gamma delta epsilon zeta".split(), k=rng.randint(0, 7)))) for _ in range(40)]
    got = C.cohesion(parts, 3)
    for j, s in enumerate(got):
        left = sum(parts[max(0, j - 2) : j + 1], C.Counter())
        right = sum(parts[j + 1 : j + 4], C.Counter())
        dot = sum(left[t] * right[t] for t in left)
        norm = (sum(v * v for v in left.values()) * sum(v * v for v in right.values())) ** 0.5
        assert s == pytest.approx(dot / norm if norm else 0.0)


def test_marks_stay_with_their_sign():
    text = "é" * 2000
    assert all(unicodedata.category(text[b]) != "Mn" for _, b in C.pieces(text)[:-1])


def test_split_texts(spark):
    long = "Wall one. " * 300
    rows = [(1, long), (2, " \t\n" * 3000 + "x"), (3, None), (4, ""), (5, "y" * 1500), (6, "y" * 1501), (7, long), (None, long), (8, "  " + "z" * 1500 + "\n\n")]
    df = spark.createDataFrame([(i, t, True, 7) for i, t in rows], "id long, document_text string, text_truncated boolean, piece_no int")
    out = C.split_texts(df).orderBy("id", "piece_no").collect()
    assert {r.id for r in out} == {1, 6, 7}
    for i in (1, 6, 7):
        own = [r for r in out if r.id == i]
        text = C.squeeze(dict(rows)[i])
        assert [r.piece_no for r in own] == list(range(len(own))) and own[0].n_pieces == len(own) and own[0].overlap == 0
        assert text == "".join(r.piece[r.overlap :] for r in own)
        assert all(own[k].piece[: own[k].overlap] == own[k - 1].piece[-own[k].overlap :] for k in range(1, len(own)))
    assert C.split_texts(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        C.pieces(long, 100, 60, 10)


def test_pieces_start_at_no_mark():
    text = "".join("e" + "\u0301" * 6 for _ in range(1500))
    text = text[:9000]
    cuts = C.pieces(text)
    assert len(cuts) > 3 and all(unicodedata.category(text[a])[0] != "M" for a, _ in cuts)
    assert all(100 <= z - a <= 150 for (_, z), (a, _) in zip(cuts, cuts[1:]))


def test_stems():
    assert C.stem("walls") == C.stem("wall") and C.stem("heizungen") == C.stem("heizung") and C.stem("des") == "des"
