"""SimHash near-duplicates and components against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from almanac.llm import common, queries, simhash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    ws = [w for w in low.split(" ") if w]
    grams = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(nodes, linked):
    group = {n: n for n in nodes}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        group[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def expect(rows):
    fps = {i: slow_fingerprint(t) for i, t in rows}
    ids = list(fps)
    a = np.array([fps[i] for i in ids], dtype=np.uint64)
    links = []
    for k, i in enumerate(ids):
        links += [(i, ids[j]) for j in np.flatnonzero(np.bitwise_count(a ^ a[k]) <= 4) if j > k]
    comp = slow_components(ids, links)
    return sorted((i, f"{fps[i]:016x}", comp[i]) for i in ids)


def got(df):
    return sorted((r.doc_id, r.fingerprint, r.component_id) for r in df.collect())


def test_whole_table_agrees_with_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op2_simhash(spark, d)) == expect(rows)


def test_odd_texts(spark):
    rows = [(5, None), (1, ""), (2, " \n\t"), (3, "A b C d e"), (4, "a B c D E"), (7, "x"), (8, "İ ß one two three"), (9, "w " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    assert got(simhash.near_duplicates(df)) == expect(rows)
    twice = df.union(df)
    assert got(simhash.near_duplicates(twice)) == sorted(expect(rows) * 2)
    assert simhash.near_duplicates(df.where("false")).collect() == []


def test_a_hot_fingerprint_component_and_hub(spark):
    """A third of all rows with one text, a hub with most edges, null ids: the same as brute force, through the joins for hot keys."""
    rng = random.Random(4)
    rows = [(i, "one text that most rows have in common here" if i % 3 else " ".join(rng.choice("abcdefgh") * 3 for _ in range(9))) for i in range(900)]
    assert got(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == expect(rows)
    out = simhash.near_duplicates(spark.createDataFrame([(None, "x y z"), (3, "X y z"), (None, "q")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in out if r.component_id is not None) == [("3", 3), ("None", 3)] and len(out) == 3
    edges = [(0, i) for i in range(1, 700)] + [(i, i + 1) for i in range(1000, 1030)]
    found = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 700)}, **{i: 1000 for i in range(1001, 1031)}}


def test_joins_for_hot_keys_are_joins(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, rng.randrange(2000), None]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, v int")
    table = common.materialize(df.where("k % 5 <> 2").groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s")), "t")
    for how in ("inner", "left"):
        want = df.join(table.drop("n"), ["k"], how)
        assert sorted(map(str, common.join_hot(df, table, ["k"], how).collect())) == sorted(map(str, want.collect()))


def test_near_links_keep_all_connections(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)  # so that dense keys go in pairs of blocks
    rng = random.Random(1)
    fps = set()
    for base in [rng.getrandbits(64) for _ in range(200)] + [7] * 3:
        for _ in range(3 if base != 7 else 300):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(simhash._signed(x) for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    out = {r.node: r.component for r in common.components(simhash.near_links(df)).collect()}
    a = np.array(fps, dtype=np.int64)
    links = [(fps[k], fps[j]) for k in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(a.view(np.uint64) ^ a.view(np.uint64)[k]) <= 4) if j > k]
    assert {x: out.get(x, x) for x in fps} == slow_components(fps, links)


def test_thresholds_fill_the_budget():
    rng = np.random.default_rng(3)
    plan = simhash.make_plan(rng.integers(0, 2**63, 500, dtype=np.uint64), 10**6, 4)
    masks = [m for m, _ in plan]
    assert sum(bin(m).count("1") for m in masks) <= 64 and len({b for m in masks for b in range(64) if m >> b & 1}) == sum(bin(m).count("1") for m in masks)
    best, chosen = simhash.thresholds([[0.0, 1, 5, 9, 20, 50], [0.0, 2, 3, 4, 9, 9], [0.0, 10, 10, 10, 10, 10]], 4)
    assert sum(t + 1 for t in chosen) == 5 and best == 9


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in common.components(edges).collect()} == {**{i: 0 for i in range(1, 61)}, 101: 100}
