"""Language identification: a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import bounded_batches, crc32_bucket

UNKNOWN = "und"
#: Documents of a label in the sample, where it has as many, however many labels share it; labels at most.
FEWEST, MOST_LABELS = 20, 10_000


@dataclass(frozen=True)
class Net:
    """width: units of each direction. window: bytes that the network reads at a time; a text is
    cut into windows from its begin to its end. sample: documents in the training sample, about, which
    all labels share. quota: documents of one label, at most. per_doc: windows taken
    from each, evenly over its whole text. batch, steps, rate: of Adam. seed: of weights and batches."""

    width: int = 12
    window: int = 64
    sample: int = 96_000
    quota: int = 1500
    per_doc: int = 4
    batch: int = 256
    steps: int = 320
    rate: float = 0.01
    seed: int = 5
    lot: int = 4096


class Model:
    """Two gated recurrent passes, one from each end, and a softmax at each position.

    At a byte x: a = E[:, x], u = U h; update z and reset r are a + u cut to 0..1; candidate
    n = tanh(a_n + r u_n); next state h' = n + z (h - n). Arrays have a row for each unit and a column
    for each window.
    """

    def __init__(self, labels: list[str], p: Net):
        self.labels, self.p = labels, p
        rng, h = np.random.default_rng(p.seed), p.width
        self.w = {}
        for d in "fb":
            self.w[f"E{d}"] = rng.normal(0, 0.3, (3 * h, 256)).astype(np.float32)
            self.w[f"E{d}"][: 2 * h] = 0.5 + rng.normal(0, 0.1, (2 * h, 256))
            self.w[f"U{d}"] = rng.normal(0, 0.5 / np.sqrt(h), (3 * h, h)).astype(np.float32)
            self.w[f"V{d}"] = rng.normal(0, 0.3, (len(labels), h)).astype(np.float32)
        self.w["c"] = np.zeros((len(labels), 1), dtype=np.float32)

    def _pass(self, x: np.ndarray, d: str, kept: list | None) -> Iterator[tuple[int, np.ndarray]]:
        """(position, state after it) along one direction; kept gets what backward needs."""
        h, e, u_ = self.p.width, self.w[f"E{d}"], self.w[f"U{d}"]
        state = np.zeros((h, x.shape[1]), dtype=np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = np.take(e, x[t], axis=1, mode="clip")
            u = u_ @ state
            zr = a[: 2 * h] + u[: 2 * h]
            np.clip(zr, 0, 1, out=zr)
            n = zr[h:] * u[2 * h :]
            n += a[2 * h :]
            np.tanh(n, out=n)
            nxt = state - n
            nxt *= zr[:h]
            nxt += n
            if kept is not None:
                kept.append((t, state, zr, u[2 * h :], n))
            state = nxt
            yield t, state

    def probabilities(self, x: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """x: bytes, a row for each position. Label probabilities (position, label, window)."""
        out = np.empty((len(x), len(self.labels), x.shape[1]), dtype=np.float32)
        out[:] = self.w["c"]
        for d in "fb":
            states = [None] * len(x)
            for t, s in self._pass(x, d, None if kept is None else kept.setdefault(d, [])):
                out[t] += self.w[f"V{d}"] @ s
                if kept is not None:
                    states[t] = s
            if kept is not None:
                kept[f"s{d}"] = states
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out

    def gradients(self, x: np.ndarray, weight: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients by backpropagation through time. weight: of each position; y: label of each window."""
        h, kept = self.p.width, {}
        prob = self.probabilities(x, kept)
        total = weight.sum()
        cols = np.arange(x.shape[1])
        loss = float(-(weight * np.log(prob[:, y, cols] + 1e-12)).sum() / total)
        prob[:, y, cols] -= 1
        prob *= (weight / total)[:, None, :]
        g = {"c": prob.sum(axis=(0, 2))[:, None]}
        for d in "fb":
            v, u_ = self.w[f"V{d}"], self.w[f"U{d}"]
            g[f"V{d}"], g[f"U{d}"] = np.zeros_like(v), np.zeros_like(u_)
            da_all = np.empty((len(x), 3 * h, x.shape[1]), dtype=np.float32)
            dh = np.zeros((h, x.shape[1]), dtype=np.float32)
            for t, before, zr, s, n in reversed(kept[d]):
                g[f"V{d}"] += prob[t] @ kept[f"s{d}"][t].T
                dh = dh + v.T @ prob[t]
                z, r = zr[:h], zr[h:]
                dan = dh * (1 - z) * (1 - n * n)
                da = da_all[t]
                da[:h] = dh * (before - n) * ((z > 0) & (z < 1))
                da[h : 2 * h] = dan * s * ((r > 0) & (r < 1))
                da[2 * h :] = dan
                du = np.concatenate([da[: 2 * h], dan * r])
                g[f"U{d}"] += du @ before.T
                dh = dh * z + u_.T @ du
            flat = x.ravel()
            g[f"E{d}"] = np.stack([np.bincount(flat, weights=da_all[:, k].ravel(), minlength=256) for k in range(3 * h)])
        return loss, g

    def train(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> Model:
        """x: windows as rows of bytes. Adam over random batches."""
        p, rng = self.p, np.random.default_rng(self.p.seed)
        m = {k: np.zeros(w.shape) for k, w in self.w.items()}
        s = {k: np.zeros(w.shape) for k, w in self.w.items()}
        for step in range(1, p.steps + 1):
            pick = rng.integers(0, len(x), min(p.batch, 4 * len(x)))
            weight = (np.arange(p.window)[:, None] < lengths[pick]).astype(np.float32)
            _, g = self.gradients(np.ascontiguousarray(x[pick].T).astype(np.intp), weight, y[pick])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            rate = p.rate * min(1.0, 2 - 2 * step / (p.steps + 1))
            for k, w in self.w.items():
                v = g[k] / max(1.0, norm)
                m[k] += 0.1 * (v - m[k])
                s[k] += 0.01 * (v * v - s[k])
                w -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Mean label probabilities over all bytes of each text; zeros for texts without bytes."""
        t = self.p.window
        data = [x.encode("utf-8", "surrogatepass") if x else b"" for x in texts]
        n = np.array([len(b) for b in data], dtype=np.int64)
        wins = -(-n // t)
        buf = np.frombuffer(b"".join(b.ljust(int(k) * t, b"\0") for b, k in zip(data, wins)), dtype=np.uint8).reshape(-1, t)
        first = np.cumsum(wins) - wins
        owner = np.repeat(np.arange(len(n)), wins)
        length = np.minimum(n[owner] - (np.arange(len(buf)) - first[owner]) * t, t)
        out = np.zeros((len(n), len(self.labels)))
        for at in range(0, len(buf), self.p.lot):
            some = slice(at, at + self.p.lot)
            prob = self.probabilities(np.ascontiguousarray(buf[some].T).astype(np.intp))
            short = np.flatnonzero(length[some] < t)
            for k in short:
                prob[length[some][k] :, :, k] = 0
            pooled = prob.sum(axis=0)
            for k in range(len(self.labels)):
                out[:, k] += np.bincount(owner[some], weights=pooled[k], minlength=len(n))
        return out / np.maximum(n, 1)[:, None]


def _windows(p: Net):
    @F.pandas_udf("array<binary>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            b = t.encode("utf-8", "surrogatepass")
            starts = np.unique(np.linspace(0, max(0, len(b) - p.window), p.per_doc).astype(int))
            out.append([b[s : s + p.window] for s in starts])
        return pd.Series(out)

    return run(F.col("text"))


def fit(docs: DataFrame, p: Net = Net()) -> Model | None:
    """docs: (doc_id, text, lang), the rows to learn from. None if no row has a label and a letter.

    Every label is learned: the more there are, the fewer documents each gets, but FEWEST at least, or all that
    it has. Of each label those with the least hashes of id and whole text are taken, whatever the size of
    docs; so rows that share an id, or have none, are told apart, and rows equal in both count once. A
    column with more than MOST_LABELS values is none of languages and is refused.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.rlike(F.coalesce("text", F.lit("")), F.lit(r"\p{L}")))
    counts = rows.groupBy("lang").count().limit(MOST_LABELS + 1).collect()
    if not counts:
        return None
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    quota = max(FEWEST, min(p.quota, p.sample // len(counts)))
    hashed = rows.withColumn("h", F.xxhash64("doc_id", F.xxhash64("text"), F.lit("langid")))
    least = Window.partitionBy("lang").orderBy("h")
    few = hashed.select("lang", "h").distinct().withColumn("at", F.row_number().over(least)).where(F.col("at") <= quota)
    edges = few.groupBy(F.col("lang").alias("l")).agg(F.max("h").alias("edge"))
    some = hashed.join(F.broadcast(edges), F.col("lang") == F.col("l")).where("h <= edge").select("lang", "h", "text").dropDuplicates(["lang", "h"])
    got = some.select("lang", "h", F.posexplode(_windows(p)).alias("at", "w")).orderBy("h", "lang", "at").select("lang", "w").toPandas()
    labels = sorted(r["lang"] for r in counts)
    x = np.frombuffer(b"".join(bytes(w).ljust(p.window, b"\0") for w in got.w), dtype=np.uint8).reshape(-1, p.window)
    return Model(labels, p).train(x, np.array([len(w) for w in got.w]), np.array([labels.index(v) for v in got.lang]))


def identify(docs: DataFrame, model: Model | None, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score.

    score is the mean probability of lang_pred over all bytes of the whole text. Null and empty
    texts and texts without a letter are `und` with score 0; so is every text if model is None.
    Ties go to the label first by code point. Rows that repeat get equal results. An empty table
    gives an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, letters = batch.column("text").to_pylist(), batch.column("letters").to_pylist()
            pred, score, at, size = [], [], 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= 1 << 20 or i == len(texts) - 1:
                    prob = model.predict(texts[at : i + 1]) if model else np.zeros((i + 1 - at, 1))
                    best = prob.argmax(axis=1)
                    for k, yes in enumerate(letters[at : i + 1]):
                        known = yes and model is not None
                        pred.append(model.labels[best[k]] if known else UNKNOWN)
                        score.append(min(1.0, float(prob[k, best[k]])) if known else 0.0)
                    at, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    text = F.col(text_col)
    rows = docs.select(F.col(key_col).cast("long").alias("doc_id"), text.alias("text"), F.rlike(F.coalesce(text, F.lit("")), F.lit(r"\p{L}")).alias("letters"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    return crc32_bucket("doc_id", 4) == 2


def language_id(docs: DataFrame, p: Net = Net()) -> DataFrame:
    """Learns from the rows that are not held out and labels every row: doc_id, held_out, lang_pred, score."""
    bounded_batches(docs.sparkSession)
    learn = docs.select("doc_id", "text", "lang").where(~held_out())
    return identify(docs, fit(learn, p)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
