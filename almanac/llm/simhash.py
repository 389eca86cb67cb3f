"""SimHash near-duplicates: fingerprints within a Hamming distance, by a generalised pigeonhole.

Bits that go together are grouped into partitions. If two fingerprints differ in at most tau bits
and the partitions get thresholds whose sum of (threshold + 1) is tau + 1, they are within the
threshold of at least one partition. A dynamic program on estimated candidate counts shares out
the thresholds; -1 leaves a partition out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import bounded_batches, components, drop, join_hot, materialize

BITS = 64
#: Fingerprints, at most, that the driver reads to find correlated bits and candidate counts.
SAMPLE = 2048
#: Fingerprints of one key beyond which its comparisons are split into pairs of blocks.
BLOCK = 2048
#: Groups up to this many rows are compared pair by pair, larger ones by search from row to row.
SMALL = 32
#: A candidate pair costs about so much of what a probe row costs to shuffle.
PAIR_COST = 0.05


def simhash(text: str | None, shingle: int = 4) -> int:
    """The fingerprint of one text as an unsigned number; 0 if it has no word."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return 0
    if len(ws) < shingle:
        grams = [b" ".join(ws)]
    else:
        grams = map(b" ".join, zip(*[ws[i:] for i in range(shingle)]))
    h = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = 4) -> Column:
    """Column form of simhash(), as a signed long of the same bits."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return run(text)


# -- the plan: partitions and thresholds -----------------------------------------------------


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of the 64 bits; each grows by the bit that correlates most with those in it."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(axis=0) if len(bits) else 0
    norm = np.sqrt((bits**2).sum(axis=0))
    corr = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9)
    left, parts = list(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        rest = corr[np.ix_(left, left)].sum(axis=1)
        part = [left.pop(int(rest.argmax()))]
        while len(part) < size:
            part.append(left.pop(int(corr[np.ix_(left, part)].sum(axis=1).argmax())))
        parts.append(sorted(part))
    return parts


def mask_of(part: list[int]) -> int:
    return sum(1 << b for b in part)


def thresholds(costs: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """costs[i][t]: of threshold t - 1 in partition i, t from 0. The cheapest thresholds whose sum
    of (threshold + 1) is tau + 1, by dynamic programming over partitions and that sum."""
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * (tau + 1)
    for cost in costs:
        best = [min(((best[s - t][0] + cost[t], [*best[s - t][1], t - 1]) for t in range(s + 1)), key=lambda x: x[0]) for s in range(tau + 2)]
    return best[tau + 1]


def make_plan(sample: np.ndarray, n: int, tau: int) -> list[tuple[int, list[int]]]:
    """(mask, flips) of each partition in use: a fingerprint probes mask & fp ^ flip for each flip.

    sample: some of the n distinct fingerprints. The number of partitions is the one whose
    estimated probes and candidates cost least.
    """
    pairs = max(1, len(sample) * (len(sample) - 1) // 2)
    top, found = min(tau, 3), []
    for m in range(2, tau + 2):
        parts, costs = group_bits(sample, m), []
        for part in parts:
            own = sample & np.uint64(mask_of(part))
            near = np.zeros(BITS + 1)
            for i in range(len(own)):
                near += np.bincount(np.bitwise_count(own[i + 1 :] ^ own[i]), minlength=BITS + 1)
            cost = [0.0]
            for t in range(tau + 1):
                ways = sum(comb(len(part), k) for k in range(t + 1))
                share = max(near[: t + 1].sum() / pairs, ways / 2.0 ** len(part))
                cost.append(ways * n + PAIR_COST * share * n * n / 2 if t <= top else float("inf"))
            costs.append(cost)
        total, chosen = thresholds(costs, tau)
        found.append((total, m, [(mask_of(p), [sum(1 << b for b in c) for k in range(t + 1) for c in combinations(p, k)]) for p, t in zip(parts, chosen) if t >= 0]))
    return min(found)[2]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# -- probe and verify ------------------------------------------------------------------------


def links_of_group(fps: np.ndarray, own: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """Links between the fingerprints of one key, enough to connect all that are connected by a
    link with at least one end in own. Each fingerprint is compared with those not yet reached."""
    fps, first = np.unique(fps, return_inverse=True)
    mine = np.zeros(len(fps), dtype=bool)
    np.logical_or.at(mine, first, own)
    todo, out = np.ones(len(fps), dtype=bool), []
    for start in np.flatnonzero(mine):
        if not todo[start]:
            continue
        todo[start], queue = False, [start]
        while queue:
            i = queue.pop()
            rest = np.flatnonzero(todo if mine[i] else todo & mine)
            near = rest[np.bitwise_count(fps[rest] ^ fps[i]) <= tau]
            todo[near] = False
            out += [(i, j) for j in near]
            queue += list(near)
    return [(fps[i], fps[j]) for i, j in out]


def _verify(tau: int):
    def whole_groups(key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> pd.DataFrame:
        """key: group numbers, ascending; in a group rows with own stand first."""
        ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
        starts = np.append(0, ends[:-1])
        size, end = ends - starts, np.repeat(ends, ends - starts)
        i = np.flatnonzero(own & (np.repeat(size, size) <= SMALL))
        left, right = [], []
        for d in range(1, SMALL):
            i = i[i + d < end[i]]
            if not len(i):
                break
            x = fp[i] ^ fp[i + d]
            hit = i[(np.bitwise_count(x) <= tau) & (x != 0)]
            left.append(fp[hit])
            right.append(fp[hit + d])
        for s, e in zip(starts[size > SMALL], ends[size > SMALL]):
            if own[s]:
                ab = np.array(links_of_group(fp[s:e], own[s:e], tau), dtype=np.uint64).reshape(-1, 2)
                left.append(ab[:, 0])
                right.append(ab[:, 1])
        a, b = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (left, right))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by part, key, block; a group that goes on in the next batch waits for it."""
        held: list[pd.DataFrame] = []

        def done(pdf: pd.DataFrame) -> pd.DataFrame:
            k = pdf[["part", "key", "block"]].to_numpy()
            return whole_groups(np.append(0, np.cumsum((k[1:] != k[:-1]).any(axis=1))), pdf.fp.to_numpy().view(np.uint64), pdf.own.to_numpy(dtype=bool))

        for pdf in batches:
            if not len(pdf):
                continue
            k = pdf[["part", "key", "block"]].to_numpy()
            ends = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            if held and (k[0] != held[-1][["part", "key", "block"]].to_numpy()[-1]).any():
                yield done(pd.concat(held))
                held = []
            if len(ends):
                yield done(pd.concat([*held, pdf.iloc[: ends[-1]]]))
                held = []
            held.append(pdf.iloc[ends[-1] if len(ends) else 0 :])
        if held:
            yield done(pd.concat(held))

    return run


def _probes(part: int, key: Column, flips: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(_signed(f)) for f in flips]), lambda f: F.struct(F.lit(part).alias("part"), key.bitwiseXOR(f).alias("key"), (f == 0).alias("own")))


def near_links(fps: DataFrame, tau: int = 4) -> DataFrame:
    """fps: distinct longs fp. Links (a, b) of at most tau differing bits that connect whatever such links connect.

    A key that very many fingerprints share is compared in pairs of blocks, in as many groups as
    it has pairs; a group's comparisons start from the rows whose own key it is.
    """
    spark = fps.sparkSession
    n = fps.count()
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE)
    plan = make_plan(np.array([r.fp for r in sample.collect()], dtype=np.int64).view(np.uint64), n, tau)
    key = [F.col("fp").bitwiseAND(F.lit(_signed(mask))) for mask, _ in plan]
    own = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("part"), k.alias("key")) for i, k in enumerate(key)])).alias("x")).select("x.*")
    hot = materialize(own.groupBy("part", "key").count().where(F.col("count") > BLOCK).select("part", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot-keys")
    probes = F.concat(*[_probes(i, k, flips) for i, (k, (_, flips)) in enumerate(zip(key, plan))])
    rows = fps.select("fp", F.explode(probes).alias("x")).select("x.*", "fp")
    if n_hot := hot.count():
        rows = rows.join(F.broadcast(hot) if n_hot <= 10_000 else hot, ["part", "key"], "left")
        at = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(at, j) * F.col("blocks") + F.greatest(at, j))
        rows = rows.withColumn("block", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)))
    else:
        rows = rows.withColumn("block", F.lit(0).cast("long"))
    rows = rows.select("part", "key", "block", "own", "fp").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part", "key", "block")
    return rows.sortWithinPartitions("part", "key", "block", F.col("own").desc()).mapInPandas(_verify(tau), "a long, b long")


def near_duplicates(docs: DataFrame, tau: int = 4, key_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, the smallest
    doc_id that links of at most tau differing bits reach.

    Equal fingerprints become one row before the search. Null texts and texts without a word have
    fingerprint zero and are linked like any other. Rows that repeat get the same result. Null ids
    are never the smallest; a component with no id has a null component_id. An empty table gives
    an empty result. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    own = materialize(docs.select(F.col(key_col).alias("doc_id"), fingerprint(F.col(text_col), shingle).alias("fp")), "fingerprints")
    classes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    root = components(near_links(classes.select("fp"), tau))
    rooted = classes.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    roots = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("of_root")), "roots")
    # a component may hold most fingerprints, and a fingerprint most documents
    ids = materialize(join_hot(rooted, roots, ["root"], n="of_root").select("fp", "n", "component_id"), "component-ids")
    for df in (classes, rooted, roots):
        drop(df)
    return join_hot(own, ids, ["fp"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
