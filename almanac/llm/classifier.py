"""Quality classifier: histogram gradient-boosted trees over document statistics, in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import bounded_batches, crc32_bucket, drop, materialize


@dataclass(frozen=True)
class Boost:
    """sample: labelled rows, at most, that the driver learns from, but `fewest` of each label. bins: of each statistic.
    trees, depth, rate: of boosting. least: rows in a leaf. ridge: added to a leaf's curvature."""

    sample: int = 20_000
    fewest: int = 500
    bins: int = 64
    trees: int = 80
    depth: int = 4
    rate: float = 0.15
    least: int = 10
    ridge: float = 1.0


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
N_STATS = 26


def _repeats(codes: np.ndarray, n: int) -> float:
    """Share of n-word windows that are not the first of their kind."""
    if len(codes) < n:
        return 0.0
    h = codes[: len(codes) - n + 1].astype(np.uint64)
    for k in range(1, n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - n + 1 + k].astype(np.uint64)
    return 1.0 - len(np.unique(h)) / len(h)


def statistics(text: str | None) -> np.ndarray:
    """N_STATS numbers of a whole text; zeros if it is null or has no word."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    words = data.split()
    if not words:
        return np.zeros(N_STATS, dtype=np.float32)
    n, size = len(words), len(data)
    count = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    black = max(1, int(count[~SPACE].sum()))
    lens = np.fromiter(map(len, words), dtype=np.int64, count=n)
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    freq = np.sort(np.bincount(codes))[::-1]
    lines = [x for x in data.split(b"\n") if x.strip()]
    line_lens = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    first = np.fromiter((w[0] for w in words), dtype=np.uint8, count=n)
    last = np.fromiter((w[-1] for w in words), dtype=np.uint8, count=n)
    letters = count[65:91].sum() + count[97:123].sum() + count[128:].sum()
    share = count[count > 0] / size
    ends = np.isin(last, [33, 46, 63])
    out = [
        np.log1p(n), lens.mean(), lens.std(), np.log1p(lens.max()),
        letters / black, count[65:91].sum() / black, count[48:58].sum() / black, count[128:].sum() / black,
        sum(int(count[ord(c)]) for c in "#*$%&|<>@~^_=+\\{}[]") / black, count[124] / n, count[33] / n,
        sum(int(count[ord(c)]) for c in ".,;:?!") / n, ends.mean(), n / (1 + ends.sum()),
        ((first >= 65) & (first <= 90)).mean(), (lens <= 3).mean(), (lens >= 14).mean(),
        len(seen) / n, freq[0] / n, freq[:10].sum() / n,
        _repeats(codes, 2), _repeats(codes, 4), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(line_lens.mean()) if len(lines) else 0.0,
        len(zlib.compress(data, 1)) / size, -(share * np.log2(share)).sum(),
    ]
    return np.array(out, dtype=np.float32)


def document_statistics(text: Column) -> Column:
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return run(text)


class Trees:
    """Boosted trees for the logistic loss. All trees are full to the same depth and lie in flat
    arrays (tree, node); the children of node i are 2i + 1 and 2i + 2, and a node that was not split
    sends every row to the left."""

    def __init__(self, p: Boost):
        self.p, self.start = p, 0.0
        nodes = (1 << p.depth) - 1
        self.feature = np.zeros((p.trees, nodes), dtype=np.int64)
        self.threshold = np.full((p.trees, nodes), np.inf, dtype=np.float32)
        self.leaf = np.zeros((p.trees, 1 << p.depth))
        self.used = 0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = self.p
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        if len(np.unique(y)) < 2:
            return self
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, p.bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)  # bin b: at most edge b
        flat = binned + np.arange(x.shape[1]) * p.bins
        total = np.full(len(y), self.start)
        for t in range(p.trees):
            prob = 1 / (1 + np.exp(-total))
            g, h = y - prob, prob * (1 - prob)
            node = np.zeros(len(y), dtype=np.int64)
            for level in range(p.depth):
                width, base = 1 << level, (1 << level) - 1
                sums = self._histograms(flat, node, width, g, h)
                go_right = np.zeros(len(y), dtype=bool)
                for k in range(width):
                    best = self._split(*[s[k] for s in sums], edges)
                    if best:
                        f, b = best
                        self.feature[t, base + k], self.threshold[t, base + k] = f, edges[f][b]
                        go_right |= (node == k) & (binned[:, f] > b)
                node = 2 * node + go_right
            num, den = np.bincount(node, g, 1 << p.depth), np.bincount(node, h, 1 << p.depth)
            self.leaf[t] = p.rate * num / (den + p.ridge)
            total += self.leaf[t][node]
            self.used = t + 1
        return self

    def _histograms(self, flat: np.ndarray, node: np.ndarray, width: int, g: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
        """Sums of g, h and rows: (node, statistic, bin)."""
        n_f, size = flat.shape[1], flat.shape[1] * self.p.bins
        at = (flat + node[:, None] * size).ravel()
        return [np.bincount(at, np.repeat(w, n_f) if w is not None else None, width * size).reshape(width, n_f, self.p.bins) for w in (g, h, None)]

    def _split(self, g: np.ndarray, h: np.ndarray, n: np.ndarray, edges: list[np.ndarray]) -> tuple[int, int] | None:
        p = self.p
        gl, hl, nl = (s.cumsum(axis=1)[:, :-1] for s in (g, h, n))
        gt, ht, nt = g.sum(axis=1)[:, None], h.sum(axis=1)[:, None], n.sum(axis=1)[:, None]
        gain = gl**2 / (hl + p.ridge) + (gt - gl) ** 2 / (ht - hl + p.ridge) - gt**2 / (ht + p.ridge)
        known = np.arange(gl.shape[1])[None, :] < np.array([len(e) for e in edges])[:, None]
        gain[(nl < p.least) | (nt - nl < p.least) | ~known] = -1
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        return (int(f), int(b)) if gain[f, b] > 1e-6 else None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for t in range(self.used):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.p.depth):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.threshold[t, at])
            total += self.leaf[t][at - ((1 << self.p.depth) - 1)]
        return 1 / (1 + np.exp(-total))


def held_out() -> Column:
    return crc32_bucket("doc_id", 3) == 1


def fit(stats: DataFrame, labels: DataFrame, p: Boost = Boost()) -> Trees:
    """stats: (doc_id, x). labels: (doc_id, quality). Learns from labelled rows that are not held out.

    The driver gets p.sample of them at most, each label by its share, but p.fewest of it at least where it
    has as many; of each label those with the least hashes of id and statistics. So rows that share
    an id, or have none, are told apart, and rows equal in both count once.
    """
    known = stats.where(~held_out()).join(labels.where("quality IN (0, 1)").select("doc_id", "quality").distinct(), "doc_id")
    known = materialize(known.select("x", "quality", F.xxhash64("doc_id", "x", F.lit("quality")).alias("h")).dropDuplicates(["h", "quality"]), "labelled")
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    quota = {q: max(p.fewest, round(p.sample * n / sum(counts.values()))) for q, n in counts.items()}
    parts = [known.where(F.col("quality") == q).orderBy("h").limit(n).toPandas() for q, n in sorted(quota.items())]
    drop(known)
    got = pd.concat(parts).sort_values(["h", "quality"]) if parts else None
    return Trees(p).fit(np.stack(got.x.to_list()) if parts else np.zeros((0, N_STATS), np.float32), got.quality.to_numpy(dtype=float) if parts else np.zeros(0))


def classify(docs: DataFrame, labels: DataFrame, p: Boost = Boost()) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Statistics are computed once for all whole texts and written to the shared folder; the model and
    the scores read them there. Null and empty texts have zero statistics and get the score of these.
    Documents with several labels count once for each. Without labels every score is 0.5. Rows
    that repeat get equal scores. An empty table gives an empty result. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    stats = materialize(docs.select(F.col("doc_id"), document_statistics(F.col("text")).alias("x")), "statistics")
    trees = fit(stats, labels, p)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(trees.score(np.stack(x.to_list())) if len(x) else np.zeros(0))

    scored = stats.select("doc_id", held_out().alias("held_out"), run("x").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
