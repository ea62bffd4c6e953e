"""A random forest of histogram trees with calibrated confidence, in numpy.

It is fitted on the driver on a bounded sample and applied to Arrow batches by the executors, so that no query plan
holds a model. Bounds: the sample that is passed in; trees, depth and bins as given.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Histogram cells that are held at once while a level of a tree is grown.
CELLS = 4_000_000


@dataclass
class Tree:
    feature: np.ndarray  # -1: a leaf
    cut: np.ndarray  # bins up to this one go left
    left: np.ndarray  # the right child is the next node
    share: np.ndarray  # class shares of each node


@dataclass
class Forest:
    edges: list[np.ndarray]
    trees: list[Tree]
    depth: int
    #: Confidence to probability, by isotonic regression.
    scores: np.ndarray | None = None
    levels: np.ndarray | None = None

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1).astype(np.int16)

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Mean class shares over the trees."""
        b = self.binned(x)
        at = np.arange(len(b))
        total = 0.0
        for t in self.trees:
            node = np.zeros(len(b), np.int64)
            for _ in range(self.depth):
                f = t.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = b[at, np.maximum(f, 0)] > t.cut[node]
                node = np.where(inner, t.left[node] + right, node)
            total = total + t.share[node]
        return total / len(self.trees)

    def calibrate(self, score: np.ndarray, right: np.ndarray) -> None:
        """Isotonic regression of being right on the score, by pooling adjacent violators.

        Each pool has one doubtful row more than was seen, so that few rows never make certainty.
        """
        values, where = np.unique(score, return_inverse=True)
        n = np.bincount(where).astype(float)
        hits = np.bincount(where, right.astype(float))
        pools: list[list[float]] = []  # hits, weight, number of values
        for h, w in zip(hits, n):
            pools.append([h, w, 1])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                h2, w2, k2 = pools.pop()
                pools[-1] = [pools[-1][0] + h2, pools[-1][1] + w2, pools[-1][2] + k2]
        self.scores = values
        self.levels = np.concatenate([np.full(int(k), h / (w + 1)) for h, w, k in pools])

    def probability(self, score: np.ndarray) -> np.ndarray:
        if self.scores is None or not len(self.scores):
            return np.zeros(len(score))
        return np.interp(score, self.scores, self.levels)


def fit(x: np.ndarray, y: np.ndarray, classes: int, trees: int = 30, depth: int = 9, min_leaf: int = 5, bins: int = 32, seed: int = 7) -> Forest:
    """A forest on rows x of classes y; equal inputs give equal forests."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    forest = Forest(edges, [], depth)
    b = forest.binned(x)
    rng = np.random.default_rng(seed)
    tried = max(1, int(np.ceil(np.sqrt(x.shape[1]))))
    for _ in range(trees):
        forest.trees.append(_grow(b, y, classes, rng.poisson(1.0, len(y)).astype(float), depth, min_leaf, bins, tried, rng))
    return forest


def _grow(b: np.ndarray, y: np.ndarray, k: int, weight: np.ndarray, depth: int, min_leaf: int, bins: int, tried: int, rng: np.random.Generator) -> Tree:
    features = b.shape[1]
    feature, cut, left, share = [np.array([-1])], [np.array([0])], [np.array([0])], []
    rows = np.flatnonzero(weight)
    node = np.zeros(len(rows), np.int64)  # place within the level
    first, width = 0, 1  # the level's first node and their number
    share.append(np.bincount(y[rows], weight[rows], k)[None, :])
    for _ in range(depth):
        best_f, best_c = np.full(width, -1), np.zeros(width, np.int64)
        offered = np.sort(rng.choice(features, tried, replace=False))  # the level's choice of features
        nf = len(offered)
        step = max(1, CELLS // (nf * bins * k))
        order = np.argsort(node, kind="stable")
        bounds = np.searchsorted(node[order], np.arange(0, width + step, step))
        for j, low in enumerate(range(0, width, step)):
            part = order[bounds[j] : bounds[j + 1]]
            m = min(step, width - low)
            r = rows[part]
            cell = (((node[part] - low)[:, None] * nf + np.arange(nf)) * bins + b[np.ix_(r, offered)]) * k + y[r][:, None]
            h = np.bincount(cell.ravel(), np.repeat(weight[r], nf), m * nf * bins * k).reshape(m, nf, bins, k)
            lefts = np.cumsum(h, 2)[:, :, :-1]
            whole = h.sum(2)[:, :, None]
            rights = whole - lefts
            nl, nr = lefts.sum(3), rights.sum(3)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (lefts**2).sum(3) / nl + (rights**2).sum(3) / nr - (whole**2).sum(3) / whole.sum(3)
            gain[(nl < min_leaf) | (nr < min_leaf) | ~np.isfinite(gain)] = 0
            flat = gain.reshape(m, -1)
            top = flat.argmax(1)
            ok = flat[np.arange(m), top] > 1e-9
            best_f[low : low + m] = np.where(ok, offered[top // (bins - 1)], -1)
            best_c[low : low + m] = top % (bins - 1)
        split = best_f >= 0
        if not split.any():
            break
        place = np.cumsum(split) - 1
        feature[-1], cut[-1] = best_f, best_c
        left[-1] = np.where(split, first + width + 2 * place, 0)
        keep = split[node]
        rows, node = rows[keep], node[keep]
        node = 2 * place[node] + (b[rows, best_f[node]] > best_c[node])
        first, width = first + width, 2 * int(split.sum())
        feature.append(np.full(width, -1))
        cut.append(np.zeros(width, np.int64))
        left.append(np.zeros(width, np.int64))
        share.append(np.bincount(node * k + y[rows], weight[rows], width * k).reshape(width, k))
    s = np.concatenate(share)
    return Tree(np.concatenate(feature), np.concatenate(cut), np.concatenate(left), (s / np.maximum(s.sum(1, keepdims=True), 1e-12)).astype(np.float32))
