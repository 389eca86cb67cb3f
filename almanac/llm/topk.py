"""Exact top-k inner products by multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import drop, materialize


@dataclass(frozen=True)
class Search:
    """segments: at each resolution, coarse to fine. block, queries: rows of a block of candidates and of
    queries, about; a task compares one block of each. pivots: cells of like vectors, at most.
    sample: rows, at most, that the driver reads to choose pivots. first: candidates with the highest
    bounds that are scored at each resolution to raise the mark. step: queries that are held
    against a block at a time."""

    segments: tuple[int, ...] = (4, 16, 32)
    block: int = 8192
    queries: int = 8192
    pivots: int = 256
    sample: int = 4096
    first: int = 16
    step: int = 256


#: Scores are whole numbers; this and a share of the bound cover the rounding of bounds.
SLACK, SLACK_SHARE = 0.5, 1e-9
#: Of a block's pairs, the share from which on listed products are taken from a matrix product.
DENSE = 0.1
#: Pairs whose products are taken one by one at a time.
LOT = 65536


def segment_statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """For each row the means and deviations of its segments, times the root of the segment's length.

    By Cauchy and Schwarz, applied to what differs from the means, the inner product of two rows is
    at most that of their statistics: |x - y|^2 is at least the sum over segments of length *
    ((difference of means)^2 + (difference of deviations)^2), and both squares of lengths are exact.
    """
    parts = np.array_split(v, min(segments, max(1, v.shape[1])), axis=1)
    mean = [p.sum(axis=1) / np.sqrt(max(1, p.shape[1])) for p in parts]
    dev = [np.sqrt(max(1, p.shape[1])) * p.std(axis=1) if p.shape[1] else p.sum(axis=1) for p in parts]
    return np.stack([*mean, *dev], axis=1)


def listed_products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of a with rows j of b, pair by pair."""
    if len(i) > DENSE * len(a) * len(b):
        return (a @ b.T)[i, j]
    parts = [np.einsum("pd,pd->p", a[i[s : s + LOT]], b[j[s : s + LOT]]) for s in range(0, len(i), LOT)]
    return np.concatenate([np.zeros(0, dtype=a.dtype), *parts])


def _slack(bound: np.ndarray) -> np.ndarray:
    return SLACK + SLACK_SHARE * np.abs(bound)


def _raised(mark: np.ndarray, x: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, bound: np.ndarray, k: int, first: int) -> np.ndarray:
    """The k-th best exact score among each query's `first` highest bounds, if it is above its mark."""
    order = np.lexsort((-bound, i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    i, j = i[rank < max(k, first)], j[rank < max(k, first)]
    score = listed_products(x, c, i, j)
    order = np.lexsort((-score, i))
    i, score = i[order], score[order]
    kth = np.arange(len(i)) - np.searchsorted(i, i) == k - 1
    out = mark.copy()
    out[i[kth]] = np.maximum(out[i[kth]], score[kth])
    return out


def block_top(q_rows: np.ndarray, q: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, mark: np.ndarray | None = None, p: Search = Search()) -> tuple[pd.DataFrame, np.ndarray]:
    """(the k best candidates of a block for each query, ties to the smaller id; how many pairs
    reached each resolution, and last the exact scores). q and c are whole numbers.

    mark: scores that k other rows are known to reach, for each query. A pair stays while its bound
    reaches its query's mark; each resolution bounds what the one before left and raises the marks.
    """
    mark = np.full(len(q), -np.inf) if mark is None else mark.astype(float)
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2.0**53
    qx, cx = (q.astype(float), c.astype(float)) if exact else (q.astype(np.int64), c.astype(np.int64))
    cq, cc = ([segment_statistics(v.astype(float), s) for s in p.segments] for v in (q, c))
    out, seen = [], np.zeros(len(p.segments) + 1, dtype=np.int64)
    low, high = (cc[0].min(axis=0), cc[0].max(axis=0)) if len(c) else (0.0, 0.0)
    box = np.maximum(cq[0] * low, cq[0] * high).sum(axis=1)  # no candidate of the block goes beyond it
    ask = np.flatnonzero(box + _slack(box) >= mark)
    for at in range(0, len(ask), p.step):
        some = ask[at : at + p.step]
        x, m = qx[some], mark[some]
        i, j = np.nonzero(q_rows[some][:, None] != c_rows[None, :])
        for level, (a, b) in enumerate(zip(cq, cc)):
            seen[level] += len(i)
            bound = listed_products(a[some], b, i, j)
            stay = bound + _slack(bound) >= m[i]
            i, j, bound = i[stay], j[stay], bound[stay]
            m = _raised(m, x, cx, i, j, bound, k, p.first)
            stay = bound + _slack(bound) >= m[i]
            i, j = i[stay], j[stay]
        seen[-1] += len(i)
        score = listed_products(x, cx, i, j)
        order = np.lexsort((c_ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        top = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append(pd.DataFrame({"query": q_rows[some[i[top]]], "vec_id": c_ids[j[top]], "score": score[top].astype(np.int64)}))
    empty = pd.DataFrame({"query": [], "vec_id": [], "score": []}, dtype=np.int64)
    return pd.concat(out) if out else empty, seen


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def choose_pivots(stats: np.ndarray, n: int) -> np.ndarray:
    """n rows, at most, that lie far from each other: each is the farthest from those before it."""
    if not len(stats):
        return np.zeros((1, stats.shape[1]))
    picked, far = [0], ((stats - stats[0]) ** 2).sum(axis=1)
    while len(picked) < n and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((stats - stats[picked[-1]]) ** 2).sum(axis=1))
    return stats[picked]


def _cells(rows: DataFrame, pivots: np.ndarray, width: int, p: Search) -> DataFrame:
    """rows with cell, the nearest pivot, and s, the statistics at the coarsest resolution."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = segment_statistics(_matrix(pdf.v, width).astype(float), p.segments[0])
            near = ((pivots**2).sum(axis=1)[None, :] - 2 * s @ pivots.T).argmin(axis=1) if len(s) else np.zeros(0)
            yield pdf.assign(cell=near.astype(np.int32), s=list(s))

    return rows.mapInPandas(run, "row long, id long, v array<long>, cell int, s array<double>")


class _Blocks:
    """Cells cut to blocks of about `size` rows by a hash of key; blocks are numbered cell after cell."""

    def __init__(self, cell: Column, key: Column, sizes: dict[int, int], size: int):
        counts = [max(1, -(-sizes.get(i, 0) // size)) for i in range(max(sizes, default=0) + 1)]
        base = np.append(0, np.cumsum(counts))
        at = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), cell + 1)
        self.first, self.in_cell, self.total = at(base[:-1]), at(counts), int(base[-1])
        self.spot = F.pmod(F.xxhash64(key), self.in_cell)
        self.number = (self.first + self.spot).cast("int")


def _box(rows: DataFrame, by: str, dims: int, *more: Column) -> DataFrame:
    ends = [f(F.get("s", F.lit(i))) for f in (F.min, F.max) for i in range(dims)]
    return rows.groupBy(by).agg(F.array(*ends[:dims]).alias("low"), F.array(*ends[dims:]).alias("high"), *more)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", p: Search = Search()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k rows
    with the highest inner product, by components floor(scale * x); ties to the smaller id.

    Rows are dealt to cells around pivots by their coarsest statistics, and cells to blocks by a hash, so
    that no block grows with a hot vector. First each block of queries meets one block of its
    own cell, which gives marks. Then it meets those other blocks whose box of statistics can reach
    the least of its marks; whole blocks that can't are not even shuffled to it. Within two
    blocks the bounds go coarse to fine, and what survives them all is scored exactly.

    Vectors that are null or hold a null or non-finite component, and rows without an id, take no
    part. Shorter vectors count as ending in zeros. Every row stands for itself: a query's
    candidates are all rows but its own, others with its id or its vector among them, and rows
    that repeat a query's id are queries too. Components and scores must fit in a long. Fewer than k
    candidates give fewer rows; an empty table none. Other columns are not read.
    """
    x = F.col("v")
    fine = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL").where(fine)
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "id", F.transform("v", lambda e: F.floor(e * scale)).alias("v")), "vectors")
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(1, width)
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(p.sample).select("v").toPandas()
    pivots = choose_pivots(segment_statistics(_matrix(sample.v, width).astype(float), p.segments[0]), max(1, min(p.pivots, n // p.block)))
    celled = materialize(_cells(rows, pivots, width, p), "cells")
    drop(rows)
    is_query = F.col("id") % every == 0
    sizes = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).collect()
    cell, key = F.col("cell"), F.col("row")
    c, q = _Blocks(cell, key, {r.cell: r.n for r in sizes}, p.block), _Blocks(cell, key, {r.cell: r.q for r in sizes}, p.queries)
    cands = celled.select("row", "id", "v", "s", c.number.alias("c"))
    queries = celled.where(is_query).select("row", "id", "v", "s", q.number.alias("q"), (c.first + F.pmod(q.spot, c.in_cell)).cast("int").alias("c"))

    def meet(cand: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        out, _ = block_top(query.q_row.to_numpy(), _matrix(query.q_v, width), cand.row.to_numpy(), cand.id.to_numpy(), _matrix(cand.v, width), k, query.q_mark.to_numpy(), p)
        return out

    def compare(cands: DataFrame, queries: DataFrame) -> DataFrame:
        sides = cands.select("q", "c", "row", "id", "v"), queries.select(*[F.col(x).alias(f"q_{x}") for x in ("q", "c", "row", "v", "mark")])
        return sides[0].groupBy("q", "c").cogroup(sides[1].groupBy("q_q", "q_c")).applyInPandas(meet, "query long, vec_id long, score long")

    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    started = queries.select("q", "c").distinct()
    found = materialize(compare(cands.join(started, "c"), queries.withColumn("mark", F.lit(float("-inf")))), "first-blocks")
    if c.total > 1:
        marks = ranked(found).where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").cast("double").alias("mark"))
        marked = queries.withColumnRenamed("c", "c0").join(marks, "row", "left").withColumn("mark", F.coalesce("mark", F.lit(float("-inf"))))
        marked = materialize(marked, "marked")
        dims = 2 * min(p.segments[0], width)
        asks = _box(marked, "q", dims, F.min("mark").alias("mark"), F.min("c0").alias("c0")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c.total - 1)))).where("c <> c0")
        boxes = _box(cands, "c", dims).select("c", F.col("low").alias("l"), F.col("high").alias("h"))
        ends = F.arrays_zip("low", "high", "l", "h")
        top = F.aggregate(ends, F.lit(0.0), lambda t, e: t + F.greatest(e["low"] * e["l"], e["low"] * e["h"], e["high"] * e["l"], e["high"] * e["h"]))
        pairs = materialize(asks.join(boxes, "c").where(top + SLACK + F.abs(top) * SLACK_SHARE >= F.col("mark")).select("q", "c"), "block-pairs")
        more = compare(cands.join(pairs, "c"), marked.drop("c0").join(pairs, "q"))
        found = found.unionByName(more)
    ids = celled.where(is_query).select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return ranked(found).join(ids, "query").select("query_id", F.col("rank"), "vec_id", "score")
