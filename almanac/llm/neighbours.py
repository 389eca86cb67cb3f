"""Approximate nearest neighbours by cosine: one small-world graph for each shard, results of shards merged."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import drop, materialize
from almanac.llm.hnsw import Graph, Links


@dataclass(frozen=True)
class Shards:
    """shards: as many graphs are aimed at, each of `least` to `most` different vectors, about; so shards grow with the
    table as long as a task can hold them. queries: so many times a shard's size is a block of
    queries, about, for which a graph is sent to a task. spare: more nodes than asked for whose exact
    scores are taken. links: of the graphs."""

    shards: int = 64
    least: int = 8192
    most: int = 262_144
    queries: int = 4
    spare: int = 10
    links: Links = Links()

    def size(self, n: int) -> int:
        """Vectors of a shard, about, of n."""
        return min(self.most, max(self.least, n // self.shards))

    def count(self, n: int) -> int:
        return max(1, -(-n // self.size(n)))


INDEX = "shard int, members int, sizes array<int>, links binary, vectors binary, exact binary, ids binary, rows binary"


def usable(vector: Column) -> Column:
    """Vectors with finite components only, not all of them zero."""
    finite = F.forall(vector, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    return finite & F.exists(vector, lambda e: e != 0)


def _padded(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two that keeps their squares in range; no component is rounded by that."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _unit(v: np.ndarray) -> np.ndarray:
    v = _scaled(v)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


#: Pairs that are scored exactly at a time.
LOT = 1 << 16


def _build(width: int, p: Links):
    """A shard's different vectors, with ids and rows of their members, to one record of flat arrays. Each node has as many
    places for members; a row of -1 is a free one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first_id", "first_row"], kind="stable")
        v = _padded(pdf.v, width)
        graph, order = Graph.build(_unit(v), p)
        most = int(pdf.ids.map(len).max())
        ids, rows = np.zeros((len(pdf), most), dtype=np.int64), np.full((len(pdf), most), -1, dtype=np.int64)
        for i, (a, b) in enumerate(zip(pdf.ids, pdf["rows"])):
            ids[i, : len(a)], rows[i, : len(b)] = a, b
        links = b"".join(layer.tobytes() for layer in graph.layers)
        arrays = [np.ascontiguousarray(a).tobytes() for a in (graph.vectors, v[order], ids[order], rows[order])]
        return pd.DataFrame([[pdf.shard.iloc[0], most, [len(a) for a in graph.layers], links, *arrays]], columns=[x.split()[0] for x in INDEX.split(", ")])

    return run


def _load(r, width: int, p: Links) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    flat, layers, at = np.frombuffer(r.links, dtype=np.int32), [], 0
    for k, size in enumerate(r.sizes):
        w = 2 * p.links + 1 if k == 0 else p.links
        layers.append(flat[at : at + size * w].reshape(size, w))
        at += size * w
    graph = Graph(np.frombuffer(r.vectors, dtype=np.float32).reshape(-1, width), layers, p)
    return graph, np.frombuffer(r.exact).reshape(-1, width), *(np.frombuffer(x, dtype=np.int64).reshape(-1, r.members) for x in (r.ids, r.rows))


def _search(width: int, k: int, p: Shards):
    """A shard's record and a block of queries to the block's k nearest of the shard, scored exactly."""

    def run(shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": np.zeros(0, np.int64), "query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "row": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(shard) or not len(queries):
            return empty
        graph, exact, ids, rows = _load(shard.iloc[0], width, p.links)
        q, own, named = _padded(queries.v, width), queries["row"].to_numpy(), queries["id"].to_numpy()
        nodes, _ = graph.search(_unit(q), k + 1 + p.spare)
        i, j = np.nonzero(nodes >= 0)
        node = nodes[i, j]
        score = np.concatenate([np.zeros(0), *[cosine(q[i[s : s + LOT]], exact[node[s : s + LOT]]) for s in range(0, len(i), LOT)]])
        out = pd.DataFrame({"query": own[i].repeat(ids.shape[1]), "query_id": named[i].repeat(ids.shape[1]), "vec_id": ids[node].ravel(), "row": rows[node].ravel(), "score": score.repeat(ids.shape[1])})
        out = out[(out.row >= 0) & (out.row != out["query"])].sort_values(["query", "score", "vec_id", "row"], ascending=[True, False, True, True])
        return pd.concat([empty, out[out.groupby("query").cumcount() < k]])

    return run


def build_index(rows: DataFrame, k: int, n: int, width: int, p: Shards) -> DataFrame:
    """rows: (row, id, v), n of them, of so many components at most. One record of INDEX for each shard, written.

    Equal vectors are one node, which names the k + 1 of its rows with the smallest ids: no query needs more. Tasks
    cut down to these before they shuffle, so a vector that very many rows share is no hot key.
    """
    member = Window.partitionBy("v").orderBy("id", "row")
    few = rows.withColumn("at", F.row_number().over(member)).where(F.col("at") <= k + 1)
    listed = few.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("id", "row"))).alias("m"))
    shard = F.pmod(F.xxhash64("v"), F.lit(p.count(n))).cast("int").alias("shard")
    nodes = listed.select("v", F.col("m.id").alias("ids"), F.col("m.row").alias("rows"), F.get("m", F.lit(0))["id"].alias("first_id"), F.get("m", F.lit(0))["row"].alias("first_row"), shard)
    return materialize(nodes.groupBy("shard").applyInPandas(_build(width, p.links), INDEX), "shards")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", p: Shards = Shards()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k rows of largest cosine that are
    found, in double precision on the original vectors; ties to the smaller id.

    Every vector is in the graph of one shard, by a hash of it. Each block of queries is searched in each shard; a
    shard's best are scored exactly and the best of all shards stay. What may be missed is a neighbour
    that a graph's beam does not come by; tests and README have the recall.

    Vectors that are null, all zero or hold a null or non-finite component, and rows without an id, take no
    part. Shorter vectors count as ending in zeros. Every row stands for itself: a query's
    candidates are all rows but its own, others with its id or its vector among them, and rows that
    repeat a query's id are queries too. Fewer than k candidates give fewer rows; an empty table
    none. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL").where(usable(F.col("v")))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "id", "v"), "vectors")
    n, asked, width = rows.agg(F.count(F.lit(1)), F.count_if(F.col("id") % every == 0), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    index = build_index(rows, k, n, width, p)
    blocks = max(1, -(-asked // (p.queries * p.size(n))))
    queries = rows.where(F.col("id") % every == 0).select("row", "id", "v", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
    sent = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asks = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(p.count(n) - 1))))
    found = sent.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInPandas(_search(width, k, p), "query long, query_id long, vec_id long, row long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    out = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out = materialize(out, "neighbours")
    for df in (rows, index):
        drop(df)
    return out
