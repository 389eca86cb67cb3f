"""Near-duplicates by the Jaccard similarity of word shingles: SimHash fingerprints and, for those
that differ in more bits, MinHash bands find candidates, sets decide.

Texts with equal shingle sets are one node. Nodes that agree in a band share a bucket. In a bucket
each node is compared with its smallest one; then those that this left in different groups are
compared with each other, at most 2 * BLOCK in one task, until links join them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm import simhash
from almanac.llm.common import bounded_batches, components, drop, join_hot, materialize, spare


@dataclass(frozen=True)
class Alike:
    """shingle: words. least: the smallest similarity of a link. bands, rows: a pair at 0.8 shares
    none of 20 bands of 4 rows in 1 of 37,000 cases. seed: of the hash functions. bits: by which SimHash fingerprints differ at most."""

    shingle: int = 5
    least: float = 0.8
    bands: int = 20
    rows: int = 4
    seed: int = 11
    bits: int = 4


#: Hashes of a text that are permuted at a time.
LOT = 1 << 12
#: Nodes of one bucket, and hashes of their sets, beyond which its comparisons are split into pairs of blocks.
BLOCK, BLOCK_HASHES = 1024, 1 << 19


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; a shorter text is one shingle."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    grams = map(b" ".join, zip(*[ws[i:] for i in range(size)])) if len(ws) >= size else [b" ".join(ws)]
    return np.unique(np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype=np.uint64))


def band_keys(hashes: np.ndarray, p: Alike) -> np.ndarray:
    """One key for each band: a hash of the band's number and its least permuted hashes."""
    rng = np.random.default_rng(p.seed)
    a = rng.integers(0, 1 << 63, (p.bands * p.rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, (p.bands * p.rows, 1), dtype=np.uint64)
    low = np.full(p.bands * p.rows, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), LOT):
        np.minimum(low, (a * hashes[at : at + LOT] + b).min(axis=1), out=low)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(low.reshape(p.bands, p.rows))], dtype=np.uint64)


def _described(text: Column, p: Alike) -> Column:
    """struct(fp, size, bands, sim): a name of the text's set, its size and band keys, and the text's SimHash fingerprint."""

    @F.pandas_udf("fp long, size int, bands array<long>, sim long")
    def run(texts: pd.Series) -> pd.DataFrame:
        fp, size, bands, sim = [], [], [], []
        for t in texts:
            h = shingles(t, p.shingle)
            fp.append(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64))
            size.append(len(h))
            bands.append(band_keys(h, p).view(np.int64))
            sim.append(np.uint64(simhash.simhash(t)).view(np.int64))
        return pd.DataFrame({"fp": np.array(fp, dtype=np.int64), "size": np.array(size, dtype=np.int32), "bands": bands, "sim": np.array(sim, dtype=np.int64)})

    return run(text)


def _set_of(text: Column, p: Alike) -> Column:
    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, p.shingle).view(np.int64) for t in texts], dtype=object)

    return run(text)


def near_sizes(a: Column, b: Column, least: float) -> Column:
    """Sets whose sizes differ by more can't be similar."""
    return F.least(a, b) >= least * F.greatest(a, b) - 1e-9


def links_of_bucket(fps: list[int], roots: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between nodes of different roots, enough to connect all that links connect."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.append(0, np.cumsum(size))
    group, out = np.unique(roots, return_inverse=True)[1], []
    mark = np.zeros(len(token) + 1, dtype=np.int64)
    for i in range(len(fps) - 1):
        rest = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
        rest = rest[np.minimum(size[rest], size[i]) >= least * np.maximum(size[rest], size[i]) - 1e-9]
        if not len(rest) or not size[i]:
            continue
        mark[token[at[i] : at[i + 1]]] = 1
        some = np.concatenate([token[at[j] : at[j + 1]] for j in rest])
        both = np.add.reduceat(mark[some], np.append(0, np.cumsum(size[rest])[:-1]))
        mark[token[at[i] : at[i + 1]]] = 0
        for j in rest[both >= least * (size[rest] + size[i] - both) - 1e-9]:
            if group[j] != group[i]:
                out.append((fps[i], fps[j]))
                group[group == group[j]] = group[i]
    return out


def _open_links(rooted: DataFrame, sets: DataFrame, p: Alike) -> DataFrame:
    """rooted: (key, fp, size, leader, root). Links between nodes of different roots that share a bucket, but for leaders'."""
    rest = rooted.where("fp <> leader").select("key", "fp", "size", "root")
    found = rest.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("hashes"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("hashes") / BLOCK_HASHES, F.lit(1)))
    split = materialize(found.where("r <> s").select("key", blocks.alias("blocks"), "n"), "open-keys")
    rest = materialize(join_hot(rest, split, ["key"]), "open-buckets")
    spot = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    block = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.least(spot, j) * F.col("blocks") + F.greatest(spot, j)))
    rows = rest.join(sets.select("fp", "s").hint("merge"), "fp").select("key", block.alias("block"), "fp", "root", "s")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        links = links_of_bucket(pdf.fp.tolist(), pdf.root.tolist(), [np.asarray(x, dtype=np.int64) for x in pdf.s], p.least)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    out = materialize(rows.groupBy("key", "block").applyInPandas(run, "a long, b long"), "links")
    drop(rest)
    drop(split)
    return out


def near_fingerprints(own: DataFrame, p: Alike) -> DataFrame:
    """own: (fp, sim). Pairs (leader, fp) of nodes whose texts have SimHash fingerprints that are equal or that near_links() links."""
    sims = materialize(own.select("fp", "sim").distinct(), "sims")
    firsts = materialize(sims.groupBy("sim").agg(F.min("fp").alias("leader"), F.count(F.lit(1)).alias("n")), "sim-leaders")
    equal = join_hot(sims, firsts, ["sim"]).select("leader", "fp")
    side = lambda c, name: firsts.select(F.col("sim").alias(c), F.col("leader").alias(name))
    linked = materialize(simhash.near_links(firsts.select(F.col("sim").alias("fp")), p.bits), "sim-links")
    near = linked.join(side("a", "leader"), "a").join(side("b", "fp"), "b").select("leader", "fp")
    out = materialize(equal.unionByName(near).where("leader <> fp").distinct(), "sim-pairs")
    for df in (sims, firsts, linked):
        drop(df)
    return out


def _leader_links(met: DataFrame, sets: DataFrame, p: Alike) -> DataFrame:
    """Links (a, b) of leaders a with the nodes b of their buckets, written; sets are compared by Spark's own functions."""
    pairs = materialize(met.where("fp <> leader").select(F.col("leader").alias("a"), F.col("fp").alias("b")).distinct(), "leader-pairs")
    of_a = materialize(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")).hint("merge"), "a"), "leader-sets")
    both = join_hot(pairs.join(sets.select(F.col("fp").alias("b"), F.col("s").alias("sb")).hint("merge"), "b"), of_a, ["a"])
    common = F.size(F.array_intersect("sa", "sb"))
    out = materialize(both.where(common >= p.least * (F.size("sa") + F.size("sb") - common) - 1e-9).select("a", "b"), "links")
    drop(of_a)
    drop(pairs)
    return out


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with root: the smallest fp that links reach."""
    return nodes.join(components(links).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component")


def keep_one(docs: DataFrame, p: Alike = Alike(), key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one document of each component of links, pairs of texts whose shingle
    sets have a Jaccard similarity of p.least or more.

    A document is an id and a digest of its whole text, so rows of one id, or of none, that differ
    in text are several. That with the smallest id stays, null last, of equal ids that with the smallest digest, and
    once if the row repeats. Texts without a word are alike. An empty table gives an empty result.
    Other columns pass through.
    """
    bounded_batches(docs.sparkSession)
    id_name, digest_name = spare(docs, "_id", "_digest")
    digest, key = F.xxhash64(F.col(f"`{text_col}`")), F.col(f"`{key_col}`")
    found = docs.select(key.alias("id"), digest.alias("digest"), _described(F.col(f"`{text_col}`"), p).alias("x"))
    own = materialize(found.select("id", "digest", "x.*"), "described")
    similar = near_fingerprints(own, p)
    # equal sets have equal bands; the first document of each node, by id, stands for all of it
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest"))
    nodes = materialize(own.groupBy("fp").agg(first.alias("first"), F.min("digest").alias("digest")), "nodes")
    banded = materialize(own.select("fp", "size", F.explode("bands").alias("key")).distinct(), "bands")
    drop(own)
    several = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("fp", "size")).alias("leader")).where("n > 1")
    several = materialize(several.select("key", "n", F.col("leader.fp").alias("leader"), F.col("leader.size").alias("leader_size")), "band-leaders")
    met = materialize(join_hot(banded, several, ["key"]), "buckets")
    drop(banded)
    drop(several)
    # the set of each node that meets another, from one of its texts
    meet = met.select("fp").unionByName(similar.select("fp")).unionByName(similar.select(F.col("leader").alias("fp"))).distinct()
    wanted = nodes.select("fp", "digest").join(meet.hint("merge"), "fp", "left_semi")
    texts = docs.select(digest.alias("digest"), F.col(f"`{text_col}`").alias("text")).dropDuplicates(["digest"]).join(wanted.hint("merge"), "digest")
    sets = materialize(texts.select("fp", _set_of(F.col("text"), p).alias("s")), "sets")
    banded_pairs = met.where(near_sizes(F.col("size"), F.col("leader_size"), p.least)).select("leader", "fp")
    links = _leader_links(banded_pairs.unionByName(similar), sets, p)
    rooted = materialize(_roots(met.drop("leader_size"), links), "rooted-buckets")
    links = links.unionByName(_open_links(rooted, sets, p))
    kept = _roots(nodes.select("fp", "first"), links).groupBy("root").agg(F.min("first").alias("first"))
    kept = materialize(kept.select(F.col("first.id").alias(id_name), F.col("first.digest").alias(digest_name)), "kept-ids")
    for df in (met, rooted, sets, nodes, similar):
        drop(df)
    # the ids grow with the documents, so they are never broadcast
    some = docs.join(kept.hint("merge"), key.eqNullSafe(F.col(id_name)) & (digest == F.col(digest_name)), "left_semi")
    return some.withColumn(digest_name, digest).dropDuplicates([key_col, digest_name]).drop(digest_name)
