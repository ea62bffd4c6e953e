import numpy as np
import pytest

from trellisq.llm import nearest as N

DIM = 64


def corpus(seed=0, n=900):
    rng = np.random.default_rng(seed)
    topics = rng.normal(size=(6, DIM))
    x = topics[rng.integers(0, 6, n)] + rng.normal(size=(n, DIM)) * 1.1
    for i in range(0, n, 10):  # near copies at several distances
        x[i + 1] = x[i] + rng.normal(size=DIM) * rng.choice([0.05, 0.3, 0.45, 0.6, 0.7])
    x[21] = x[20]
    return x.astype(np.float32)


def frame(spark, x, group=None):
    rows = [(i, 1 if group is None else int(group[i]), "m", [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(10001, 1, "m", None), (10002, 1, "m", [0.0] * DIM), (10003, 1, "m", [1.0] * 7), (10004, None, "m", rows[0][3]), (10005, 1, None, rows[0][3]), (None, 1, "m", rows[0][3]), (10006, 1, "m", [float("nan")] * DIM), (10007, 1, "m", [float("inf")] * DIM), (10008, 2, "m", rows[0][3]), (10009, 1, "other", rows[0][3]), (10010, 1, "m", [None] * DIM)]
    return spark.createDataFrame(rows + bad, "id long, source_model_id int, embedding_model string, embedding array<float>").selectExpr("*", "'x' as cell", "'y' as block")


def similarities(x):
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return y @ y.T


def pairs_of(x, t):
    s = similarities(x)
    return {(int(i), int(j)) for i, j in np.argwhere(s >= t) if i < j}


def test_rotation_keeps_distances():
    x = np.random.default_rng(1).normal(size=(50, 256)).astype(np.float32)
    y = N.Rotation.get(256)(x)
    assert np.allclose(x @ x.T, y @ y.T, atol=1e-3)
    with pytest.raises(ValueError):
        N.Rotation(100)


@pytest.mark.parametrize("list_rows", [10_000, 150])
def test_pairs_against_brute_force(spark, list_rows):
    x = corpus()
    got = {(r.id_a, r.id_b) for r in N.similar_pairs(frame(spark, x), 0.92, DIM, list_rows=list_rows).collect()}
    want = pairs_of(x, 0.92)
    assert len(want) > 40 and got <= want and len(got & want) >= 0.99 * len(want)
    if list_rows > len(x):
        assert got == want


def test_split_lists(spark, monkeypatch):
    monkeypatch.setattr(N, "MAX_BASE", 70)
    monkeypatch.setattr(N, "MAX_QUERIES", 90)
    x = corpus(2, 400)
    assert {(r.id_a, r.id_b) for r in N.similar_pairs(frame(spark, x), 0.92, DIM).collect()} == pairs_of(x, 0.92)
    test_top_k(spark, 10_000)


@pytest.mark.parametrize("list_rows", [10_000, 150])
def test_top_k(spark, list_rows):
    x = corpus(3, 800)
    got = {}
    for r in N.most_similar(frame(spark, x), 10, "id % 10 = 0", DIM, list_rows=list_rows).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.neighbour_id, r.similarity)
    s = similarities(x)
    np.fill_diagonal(s, -9)
    asked = range(0, 800, 10)
    assert {q for q in got if q < 10000} == set(asked)
    hits = [len({n for n, _ in got[q].values()} & set(np.argsort(-s[q], kind="stable")[:10].tolist())) for q in asked]
    assert np.mean(hits) >= 9.5
    for q in asked:
        assert sorted(got[q]) == list(range(1, 11)) and all(abs(v - s[q, n]) < 5e-3 for n, v in got[q].values())
    assert got[20][1][0] == 21


def test_many_lists_in_levels(spark):
    """80 lists and more, made in two levels: few rows are lost, none is in two homes, and equal rows end in one list."""
    x = corpus(6, 2400)
    x[100:400] = x[100]
    df = frame(spark, x)
    s = N.Scratch(spark, "t")
    heads = s.cut(N.indexed_heads(df, DIM, N.F.lit(True)))
    places = N.in_lists(heads, DIM, s, N.PROBES, list_rows=20, fan=8)
    home = places.where("nth = 0 and source_model_id = 1 and embedding_model = 'm'")
    sizes = {r.cell: r["count"] for r in home.groupBy("cell").count().collect()}
    assert sum(sizes.values()) == 2400 and len(sizes) >= 80 and sorted(sizes.values())[-2] <= 150
    assert home.where("id between 100 and 399").select("cell").distinct().count() == 1
    assert places.groupBy("id", "source_model_id", "embedding_model", "cell").count().where("count > 1").count() == 0
    want = pairs_of(x, 0.92)
    got = {(r.id_a, r.id_b) for r in N._exact(df, _pairs_in(places), 0.92, DIM).collect()}
    assert len(got & want) >= 0.95 * len(want) and got <= want


def _pairs_in(places):
    a = places.selectExpr("id as a", "source_model_id", "embedding_model", "cell")
    b = places.where("nth = 0").selectExpr("id as b", "source_model_id", "embedding_model", "cell")
    return a.join(b, ["source_model_id", "embedding_model", "cell"]).where("a <> b").selectExpr("least(a, b) as id_a", "greatest(a, b) as id_b").distinct()


def test_recall_on_real_vectors(spark):
    """Lists of 20 rows: some 50 of them in the largest group of sf0.1, so that probing may lose rows."""
    import os

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.1/rag_documents.parquet"
    if not os.path.isfile(path):
        pytest.skip("no test data")
    t = pq.read_table(path, columns=["id", "source_model_id", "embedding_model", "embedding"]).to_pandas()
    t = t[(t.source_model_id == 17) & t.embedding.map(lambda v: v is not None and len(v) == 1024 and any(v))]
    model = t.embedding_model.mode()[0]
    t = t[t.embedding_model == model]
    x = np.stack(t.embedding.to_numpy())
    ids = t.id.to_numpy()
    s = similarities(x)
    df = spark.read.parquet(path).where(f"source_model_id = 17 and embedding_model = '{model}'")
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in np.argwhere(np.triu(s, 1) >= 0.92)}
    got = {(r.id_a, r.id_b) for r in N.similar_pairs(df, list_rows=20).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)
    np.fill_diagonal(s, -9)
    place = {v: i for i, v in enumerate(ids)}
    near: dict = {}
    for r in N.most_similar(df, 10, "id % 20 = 0", list_rows=20).collect():
        near.setdefault(r.query_id, set()).add(r.neighbour_id)
    hits = [len(n & set(ids[np.argsort(-s[place[q]], kind="stable")[:10]])) / 10 for q, n in near.items()]
    assert len(hits) > 20 and np.mean(hits) >= 0.95, np.mean(hits)


def test_empty_and_alone(spark):
    df = frame(spark, corpus(4, 30)[:1])
    assert N.similar_pairs(df, 0.92, DIM).count() == 0
    assert N.similar_pairs(df.where("false"), 0.92, DIM).count() == 0
    assert N.most_similar(df.where("false"), dim=DIM).count() == 0


def test_adaptive_scan_gives_up_early():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(5000, 128)).astype(np.float32)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    q = base[7] + rng.normal(size=128).astype(np.float32) * 0.01
    at, dist = N.adaptive_scan(q, base, 5)
    exact = ((base - q) ** 2).sum(1)
    assert at[0] == 7 and set(at) == set(np.argsort(exact)[:5]) and np.allclose(dist, exact[at], atol=1e-4)
    assert N.passes(np.array([0.5]), 64, 128, 0.1)[0] == False  # noqa: E712
