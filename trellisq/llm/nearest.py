"""Most similar vectors for every vector by adaptive dimension scan (problem 7).

Vectors of unit length are turned by a fixed random rotation (signs and Hadamard transforms), so that the
distance over the first d of D dimensions, scaled by D/d, estimates the whole. They are kept in column blocks.
A candidate is given up after a block as soon as a hypothesis test says that its whole distance exceeds the
bound: partial > bound * d/D * (1 + EPS/sqrt(d))^2.

Each group (source_model_id, embedding_model) has lists of about ``LIST_ROWS`` rows around centroids, at every
size: cells are split into up to ``FAN`` lists, and again where these are still large. Centroids are fitted by
tasks on ``SAMPLE_PER_LIST`` sampled rows a list; every row is indexed in its nearest list, and only the nearest
few lists are probed for it. A list with very many rows or queries is split on both sides, so no task holds an
unbounded one and no row is dropped. Nothing but counts comes to the driver and nothing is broadcast by hint.

Defined results: null vectors, vectors of another length, with nulls or non-finite numbers, or all zero, and
rows without id, source_model_id or embedding_model belong to no pair; equal vectors are neighbours of each
other; ties are broken by the smaller id; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellisq.runtime import Scratch

DIM = 1024
FIRST = 128
BLOCKS = (64, 128, 256, 512, 1024)
EPS = 3.5
LIST_ROWS = 1024
SAMPLE_PER_LIST = 16
#: Lists that a cell is split into at once, and rows that a task assigns at once.
FAN = 256
CHUNK = 65_536
#: Where the tests over the heads stand.
HEAD_BLOCKS = (32, 64, 128)
PROBES = 4
TOPK_PROBES = 8
MAX_BASE, MAX_QUERIES = 4096, 16384
GROUP = ("source_model_id", "embedding_model")


def _hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


class Rotation:
    """A fixed random rotation of a dimension that is a power of two."""

    _held: dict[int, Rotation] = {}

    @classmethod
    def get(cls, dim: int) -> Rotation:
        return cls._held.setdefault(dim, cls(dim)) if dim not in cls._held else cls._held[dim]

    def __init__(self, dim: int):
        if dim < 4 or dim & (dim - 1):
            raise ValueError("the dimension must be a power of two")
        a = 1 << (dim.bit_length() - 1) // 2
        self.left, self.right = _hadamard(a), _hadamard(dim // a)
        rng = np.random.default_rng(20240229)
        self.signs = rng.choice(np.array([-1, 1], np.float32), (2, dim))
        self.scale = np.float32(1 / np.sqrt(dim))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for s in self.signs:
            x = (x * s).reshape(-1, len(self.left), len(self.right))
            x = (self.left @ x @ self.right).reshape(len(x), -1) * self.scale
        return x


def unit_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of the usable vectors in an Arrow list column."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(at)).flatten().cast(pa.float32())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    ok = np.isfinite(norm) & (norm > 0)
    return at[ok], (x[ok] / norm[ok, None]).astype(np.float32)


def passes(partial: np.ndarray, d: int, dim: int, bound: float | np.ndarray, blur: float = 0.0) -> np.ndarray:
    """Whether a squared distance over d of dim dimensions leaves it open that the whole is within bound.

    blur is how far rounding may have moved the two ends together.
    """
    reach = np.sqrt(bound * (d / dim)) * (1 + EPS / np.sqrt(d) if d < dim else 1.0)
    return partial <= (reach + blur) ** 2


def _pack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127
    return np.round(x / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1] * rows.itemsize), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _matrix(column: pa.ChunkedArray | pa.Array, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _usable(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.select(F.col("id").cast("long").alias("id"), *(F.col(c).cast("string").alias(c) for c in GROUP), "embedding").where(
        f"id is not null and {GROUP[0]} is not null and {GROUP[1]} is not null and size(embedding) = {int(dim)}"
    )


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        label = np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)
        order = np.argsort(label, kind="stable")
        n = np.bincount(label, minlength=k)
        full = np.flatnonzero(n)
        c[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full]) / n[full, None]
    return c


def _heads(t: pa.Table | pa.RecordBatch, first: int) -> np.ndarray:
    return _matrix(t.column("block"), np.int8, first).astype(np.float32) * t.column("scale").to_numpy(zero_copy_only=False)[:, None]


def indexed_heads(vectors: DataFrame, dim: int, ask: Column) -> DataFrame:
    """id, group, ask, block and scale: the first rotated dimensions of each usable vector, packed."""
    first = min(FIRST, dim)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                at, x = unit_vectors(part.column("embedding"), dim)
                if not len(at):
                    continue
                keys = part.select(["id", *GROUP, "ask"]).take(pa.array(at))
                q, scale = _pack(Rotation.get(dim)(x)[:, :first])
                yield pa.RecordBatch.from_arrays([*keys.columns, _binary(q), pa.array(scale)], names=["id", *GROUP, "ask", "block", "scale"])

    rows = _usable(vectors, dim).withColumn("ask", F.coalesce(ask, F.lit(False)))
    return rows.mapInArrow(index, "id long, source_model_id string, embedding_model string, ask boolean, block binary, scale float")


def in_lists(heads: DataFrame, dim: int, s: Scratch, probes: int, list_rows: int = LIST_ROWS, fan: int = FAN) -> DataFrame:
    """The heads with the lists (cell) of each row: its home (nth 0) and, if it asks, the next nearest ones.

    A cell of more than ``list_rows`` rows is split into up to ``fan`` lists around centroids that are fitted by one
    task on 16 sampled rows a list, and lists that are still large are split again, so a list holds about as many
    rows at every size. Rows meet the centroids of their cell in chunks; neither comes to the driver. A home is
    replaced by its ``probes`` nearest lists, a further place by its two nearest. Lists of rows that are too alike
    to be split stay large; ``_spread`` divides them among tasks.
    """
    first = min(FIRST, dim)
    key = [*GROUP, "cell"]
    cols = [f"{n} {t}" for n, t in heads.dtypes]
    schema = ", ".join([*cols, "nth int", "cell string"])
    placed = heads.withColumn("nth", F.lit(0)).withColumn("cell", F.lit(""))

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x = _heads(t, first)
        k = max(1, min(t.column("lists")[0].as_py(), len(x) // 4))
        c = _kmeans(x, k) if k > 1 else x[:1]
        return pa.table({**{n: t.column(n).slice(0, 1) for n in key}, "centres": pa.array([np.ascontiguousarray(c, np.float32).tobytes()], pa.binary())})

    def assign(rows: pa.Table, centres: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in cols]
        if not rows.num_rows or not centres.num_rows:
            return rows.select([*names, "nth", "cell"])
        c = np.frombuffer(centres.column("centres")[0].as_py(), np.float32).reshape(-1, first)
        half = (c * c).sum(1)
        at, to, nth = [], [], []
        ask, was = rows.column("ask").to_numpy(zero_copy_only=False), rows.column("nth").to_numpy()
        for start in range(0, rows.num_rows, 8192):
            part = rows.slice(start, 8192)
            d = half - 2 * (_heads(part, first) @ c.T)
            p = min(probes, len(c))
            near = np.argpartition(d, p - 1, axis=1)[:, :p] if p < len(c) else np.tile(np.arange(len(c)), (len(d), 1))
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
            a, w = ask[start : start + 8192], was[start : start + 8192]
            take = np.where(w == 0, np.where(a, p, 1), min(2, p))
            i, j = np.nonzero(np.arange(p)[None, :] < take[:, None])
            at.append(start + i)
            to.append(near[i, j])
            nth.append(np.where(w[i] == 0, j, w[i] + probes * (j + 1)))
        at, to, nth = (np.concatenate(z) for z in (at, to, nth))
        out = rows.select(names).take(pa.array(at))
        old = rows.column("cell")[0].as_py()
        return out.append_column("nth", pa.array(nth.astype(np.int32))).append_column("cell", pa.array([f"{old}/{c}" for c in to], pa.string()))

    before = None
    for level in range(8):
        limit = list_rows if level == 0 else 4 * list_rows
        sizes = placed.where("nth = 0").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
        if before is not None:  # a list that its parent's split has not made smaller is not split again
            parent = before.select(*GROUP, F.col("cell").alias("parent"), F.col("n").alias("whole"))
            sizes = sizes.withColumn("parent", F.regexp_replace("cell", "/[^/]*$", "")).join(parent, [*GROUP, "parent"]).where("n <= 0.9 * whole").select(*key, "n")
        sizes = sizes.withColumn("lists", F.least(F.lit(fan), F.ceil(F.col("n") / list_rows)).cast("long")).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
        sizes, large_cells = s.cut_counted(sizes)
        if not large_cells:
            break
        before = sizes
        rate = F.least(F.lit(1.0), F.col("lists") * SAMPLE_PER_LIST / F.col("n"))
        sample = placed.where("nth = 0").join(sizes, key).where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < rate * (1 << 30)).select("id", *key, "lists", "block", "scale")
        centres = sample.groupBy(*key).applyInArrow(fit, "source_model_id string, embedding_model string, cell string, centres binary")
        large = placed.join(sizes.select(*key, "chunks"), key).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(3)), F.col("chunks")).cast("int"))
        spread = centres.join(sizes.select(*key, "chunks"), key).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        done = large.groupBy(*key, "chunk").cogroup(spread.groupBy(*key, "chunk")).applyInArrow(assign, schema)
        placed = s.cut(placed.join(sizes, key, "left_anti").select([c.split()[0] for c in schema.split(", ")]).unionByName(done))
    return placed


def _open_pairs(a: np.ndarray, b: np.ndarray, dim: int, bound: float, blur: float) -> tuple[np.ndarray, np.ndarray]:
    """(positions in a, positions in b) of the pairs that no test over the column blocks of the heads gives up."""
    first = a.shape[1]
    steps = [d for d in HEAD_BLOCKS if d < first] + [first]
    low = steps[0]
    part = (a[:, :low] ** 2).sum(1)[:, None] + (b[:, :low] ** 2).sum(1) - 2 * (a[:, :low] @ b[:, :low].T)
    i, j = np.nonzero(passes(part, low, dim, bound, blur))
    left = part[i, j]
    for high in steps[1:]:
        kept: tuple[list, list, list] = ([], [], [])
        for at in range(0, len(i), 1 << 18):
            x, y = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
            gap = a[x, low:high] - b[y, low:high]
            d = left[at : at + (1 << 18)] + np.einsum("ij,ij->i", gap, gap)
            ok = passes(d, high, dim, bound, blur)
            for k, z in zip(kept, (x[ok], y[ok], d[ok])):
                k.append(z)
        i, j, left = (np.concatenate(k) if k else np.zeros(0, np.int64) for k in kept)
        low = high
    return i, j


def similar_pairs(vectors: DataFrame, threshold: float = 0.92, dim: int = DIM, probes: int = PROBES, list_rows: int = LIST_ROWS) -> DataFrame:
    """(id_a, id_b, similarity) of the pairs within a group whose cosine similarity reaches the threshold.

    Within the lists candidates are given up block by block over the first dimensions; the vectors of the pairs that
    are left are fetched and tested over the further blocks, and what passes the last one is decided exactly.
    """
    s = Scratch(vectors.sparkSession, "pairs")
    first = min(FIRST, dim)
    bound = 2 - 2 * threshold
    placed = in_lists(s.cut(indexed_heads(vectors, dim, F.lit(True))), dim, s, probes, list_rows)
    spread = _spread(placed.drop("ask"), s)

    def scan(key: tuple, t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        x = _heads(t, first)
        blur = float(t.column("scale").to_numpy().max()) * np.sqrt(first) + 1e-4
        home = np.flatnonzero(t.column("as_base").to_numpy(zero_copy_only=False))
        asks = np.flatnonzero(t.column("as_query").to_numpy(zero_copy_only=False))
        base = x[home]
        a, z = [], []
        for start in range(0, len(asks), 1024):
            at = asks[start : start + 1024]
            i, j = _open_pairs(x[at], base, dim, bound, blur)
            a.append(ids[at[i]])
            z.append(ids[home[j]])
        a, z = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (a, z))
        keep = a != z
        pair = np.unique(np.stack([np.minimum(a, z)[keep], np.maximum(a, z)[keep]], 1), axis=0)
        return pa.table({"id_a": pa.array(pair[:, 0], pa.int64()), "id_b": pa.array(pair[:, 1], pa.int64())})

    open_pairs = s.cut(spread.groupBy(*GROUP, "cell", "base_part", "query_part").applyInArrow(scan, "id_a long, id_b long").distinct())
    return s.finish(_exact(vectors, open_pairs, threshold, dim))


def _spread(placed: DataFrame, s: Scratch) -> DataFrame:
    """Rows of the lists with the parts they belong to: large lists are split among base rows and queries."""
    rest = [c for c in placed.columns if c not in ("id", *GROUP, "cell", "nth")]
    counts = placed.groupBy(*GROUP, "cell").agg(F.sum(F.when(F.col("nth") == 0, 1).otherwise(0)).alias("bases"), F.count(F.lit(1)).alias("asks"))
    parts = s.cut(
        counts.select(*GROUP, "cell", F.ceil(F.col("bases") / MAX_BASE).cast("int").alias("b_parts"), F.ceil(F.col("asks") / MAX_QUERIES).cast("int").alias("q_parts")).where("b_parts > 0")
    )
    joined = placed.join(parts, [*GROUP, "cell"])
    h = F.xxhash64("id")
    b, q = F.pmod(h, F.col("b_parts")).cast("int"), F.pmod(F.shiftright(h, 20), F.col("q_parts")).cast("int")
    grid = F.when(
        F.col("nth") == 0,
        F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.col("q_parts") - 1), lambda k: F.struct(b.alias("b"), k.alias("q"))), F.transform(F.sequence(F.lit(0), F.col("b_parts") - 1), lambda k: F.struct(k.alias("b"), q.alias("q"))))),
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("b_parts") - 1), lambda k: F.struct(k.alias("b"), q.alias("q"))))
    rows = joined.withColumn("own_b", b).withColumn("own_q", q).withColumn("g", F.explode(grid))
    return rows.select(
        "id", *GROUP, "cell", F.col("g.b").alias("base_part"), F.col("g.q").alias("query_part"),
        ((F.col("nth") == 0) & (F.col("g.b") == F.col("own_b"))).alias("as_base"), (F.col("g.q") == F.col("own_q")).alias("as_query"), *rest,
    )


def _exact(vectors: DataFrame, pairs: DataFrame, threshold: float, dim: int) -> DataFrame:
    """The pairs whose exact cosine similarity reaches the threshold.

    Whole vectors move compressed and lossless; Spark broadcasts the open pairs only while they are few.
    """

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                raw = part.column("embedding")
                values = raw.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).reshape(-1, dim)
                packed = [codec.compress(v.tobytes(), asbytes=True) for v in values]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(packed, pa.binary())], names=["id", "packed"])

    whole = _usable(vectors, dim).select("id", "embedding")
    wanted = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    packed = whole.join(wanted, "id", "left_semi").mapInArrow(compact, "id long, packed binary")
    left = packed.select(F.col("id").alias("id_a"), F.col("packed").alias("pa"))
    right = packed.select(F.col("id").alias("id_b"), F.col("packed").alias("pb"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                x, y = (
                    np.frombuffer(b"".join(codec.decompress(v, dim * 4, asbytes=True) for v in part.column(c).to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)
                    for c in ("pa", "pb")
                )
                at = _passing(x, y, 2 - 2 * threshold)
                x, y = x[at], y[at]
                dot = np.einsum("ij,ij->i", x, y)
                sim = dot / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
                ok, sim = at[sim >= threshold], sim[sim >= threshold]
                yield pa.RecordBatch.from_arrays([part.column("id_a").take(pa.array(ok)), part.column("id_b").take(pa.array(ok)), pa.array(sim)], names=["id_a", "id_b", "similarity"])

    return pairs.join(left, "id_a").join(right, "id_b").select("id_a", "id_b", "pa", "pb").mapInArrow(decide, "id_a long, id_b long, similarity double")


def _passing(x: np.ndarray, y: np.ndarray, bound: float) -> np.ndarray:
    """Positions of the pairs that pass the tests over all column blocks after the heads."""
    dim = x.shape[1]
    at = np.arange(len(x))
    if dim <= FIRST:
        return at
    unit = lambda v: Rotation.get(dim)((v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32))
    gap = (unit(x) - unit(y)) ** 2
    partial, low = np.zeros(len(x)), 0
    for high in (b for b in BLOCKS if FIRST <= b <= dim):
        partial = partial + gap[at, low:high].sum(1)
        ok = passes(partial, high, dim, bound, 1e-3)
        at, partial, low = at[ok], partial[ok], high
    return at


def adaptive_scan(query: np.ndarray, base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, squared distances) of about the k nearest rows; both sides rotated, in column blocks.

    The rows are taken in runs of growing length; the k-th distance so far bounds the next run.
    """
    dim = len(query)
    best_at, best = np.zeros(0, np.int64), np.zeros(0)
    start, size = 0, max(4 * k, 64)
    while start < len(base):
        rows = np.arange(start, min(start + size, len(base)))
        bound = best[k - 1] if len(best) >= k else np.inf
        partial = np.zeros(len(rows))
        low = 0
        for high in (b for b in BLOCKS if b <= dim) if dim in BLOCKS else (dim,):
            gap = base[rows, low:high] - query[low:high]
            partial = partial + np.einsum("ij,ij->i", gap, gap)
            if bound < np.inf:
                keep = passes(partial, high, dim, bound)
                rows, partial = rows[keep], partial[keep]
            low = high
            if not len(rows):
                break
        if len(rows):
            at, dist = np.r_[best_at, rows], np.r_[best, partial]
            order = np.argsort(dist, kind="stable")[:k]
            best_at, best = at[order], dist[order]
        start += size
        size *= 2
    return best_at, best


def most_similar(vectors: DataFrame, k: int = 10, is_query: str = "id % 100 = 0", dim: int = DIM, probes: int = TOPK_PROBES, list_rows: int = LIST_ROWS) -> DataFrame:
    """(query_id, rank, neighbour_id, similarity): the k most similar rows of the same group for each query row.

    The lists are made from the heads; the whole rotated vectors, in steps of 1/127 of their largest number, are
    joined to their places once. A similarity is exact to about 0.001.
    """
    from pyspark.sql import Window

    s = Scratch(vectors.sparkSession, "nearest")
    vectors = vectors.withColumn("id", F.col("id").cast("long"))
    heads = indexed_heads(vectors, dim, F.expr(is_query))
    places = in_lists(s.cut(heads), dim, s, probes, list_rows).select("id", *GROUP, "ask", "nth", "cell")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                at, x = unit_vectors(part.column("embedding"), dim)
                if len(at):
                    q, scale = _pack(Rotation.get(dim)(x))
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at)), _binary(q), pa.array(scale)], names=["id", "block", "scale"])

    blocks = _usable(vectors, dim).mapInArrow(whole, "id long, block binary, scale float")
    spread = _spread(s.cut(places), s).withColumn("as_query", F.col("as_query") & F.col("ask")).where("as_base or as_query").join(blocks, "id")

    def scan(key: tuple, t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        x = _matrix(t.column("block"), np.int8, dim).astype(np.float32) * t.column("scale").to_numpy()[:, None]
        home = np.flatnonzero(t.column("as_base").to_numpy(zero_copy_only=False))
        home = home[np.argsort(ids[home])]
        out: tuple[list, list, list] = ([], [], [])
        base = x[home]
        for i in np.flatnonzero(t.column("as_query").to_numpy(zero_copy_only=False)):
            at, dist = adaptive_scan(x[i], base, k + 1)
            keep = ids[home[at]] != ids[i]
            out[0].append(np.full(int(keep.sum()), ids[i]))
            out[1].append(ids[home[at]][keep])
            out[2].append(1 - dist[keep] / 2)
        q, n, d = (np.concatenate(o) if o else np.zeros(0) for o in out)
        return pa.table({"query_id": pa.array(q.astype(np.int64)), "neighbour_id": pa.array(n.astype(np.int64)), "similarity": pa.array(d.astype(np.float64))})

    got = spread.groupBy(*GROUP, "cell", "base_part", "query_part").applyInArrow(scan, "query_id long, neighbour_id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")
    return s.finish(got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "similarity"))
