import random

import pyarrow as pa

from trellisq.llm import leaks as K

WORDS = "soffit lintel gantry balustrade culvert étage größe 壁の面 стена зазор plinthe 42 R7 dormer truss girder mullion rafter purlin".split()


def make(seed, n_items=12, n_docs=150):
    rng = random.Random(seed)
    items = [(100 + i, " ".join(rng.choices(WORDS, k=rng.randint(36, 50)))) for i in range(n_items)]
    items += [(200, items[0][1]), (201, None), (202, "too short to matter"), (203, "")]
    docs = []
    for i in range(n_docs):
        words = rng.choices(WORDS, k=rng.randint(5, 60))
        if i % 2:
            p = rng.choice(items[:n_items])[1].split()
            k = rng.choice([3, 11, 12, 13, 30])
            at = rng.randrange(len(p) - k + 1)
            words[len(words) // 2 : len(words) // 2] = p[at : at + k]
        text = "".join(w + rng.choice([" ", "  ", ", ", "; ", "\n", " — "]) for w in words)
        if i % 3 == 0:
            text = text.upper()
        if i % 5 == 0:
            text = text.replace("a", "а").replace("o", "ο").replace("i", "​i")
        docs.append((i, text))
    return docs + [(9000, None), (9001, ""), (9002, "x")], items


def brute(docs, items):
    words = lambda t: K.word_forms(pa.array([t]))[0].split()
    grams = {}
    for i, p in items:
        w = words(p) if p else []
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t) if t else []
        for k in range(len(w) - 11):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + 12]), ())}
    return out


def test_against_brute_force(spark):
    docs, items = make(3)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame([(i, p, "x") for i, p in items], "item_id long, passage string, text string")
    got = [(r.doc_id, r.item_id) for r in K.leaked_items(d, e).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items) and len(got) > 40
    assert K.leaked_items(d, e.where("false")).count() == 0 and K.leaked_items(d.where("false"), e).count() == 0


def test_blocks_of_items(spark):
    docs, items = make(5)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame(items, "item_id long, passage string")
    assert len(list(K._blocks(e, 600))) > 3
    assert {(r.doc_id, r.item_id) for r in K.leaked_items(d, e, block_bytes=600).collect()} == brute(docs, items)


def test_forms():
    f = K.word_forms(pa.array(["  The—WALL is 5,5­m² ", None, "", "...", "ΜΕΜΟ straße STRASSE", "ПАСС"]))
    assert f[0] == K.word_forms(pa.array(["the wall; is 5 5m²"]))[0]
    assert f[1] == f[2] == f[3] == b"  "
    a = f[4].split()
    assert a[0] == K.word_forms(pa.array(["memo"]))[0].split()[0] and a[1] == a[2]
    assert f[5] == K.word_forms(pa.array(["пасс"]))[0]


def test_runs_must_be_of_whole_words():
    p = " ".join(f"w{i}" for i in range(12))
    machine = K.WuManber(K.passage_patterns([(1, p)]))
    find = lambda t: machine.search(K.word_forms(pa.array([t]))[0])
    assert find(p) == find("x " + p + " y") == find(p.replace(" ", "-")) == {1}
    assert not find(p + "5") and not find("x" + p) and not find(p.replace("w5", "w5 x")) and not find("w0 w1")
    assert find(("filler " * 50000) + p) == {1}
