"""Near-duplicates by shingle similarity against brute force, on planted copies."""

import random

import corpus_pipeline
from test_pairs import slow_components
from test_rules import text

from almanac.llm import minhash


def slow_set(t):
    ws = (t or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def slow_jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, t, n):
    ws = t.split()
    for i in rng.sample(range(len(ws)), n):
        ws[i] = f"new{rng.randrange(10**9)}"
    return " ".join(ws)


def corpus(rng):
    """Texts with copies at 0.8 to 0.95, some below, and a chain whose ends are not alike."""
    rows, near = [], []
    for i in range(40):
        base = text(rng, 300)
        rows.append((i, base))
        for k, n in enumerate((2, 3, 5, 6, 12)):
            rows.append((1000 + 10 * i + k, edited(rng, base, n)))
            if 0.8 <= slow_jaccard(slow_set(base), slow_set(rows[-1][1])) <= 0.95:
                near.append(rows[-1][0])
    step = text(rng, 300)
    for k in range(12):
        rows.append((3000 + k, step))
        step = edited(rng, step, 4)
    return rows, near


def test_planted_copies_go_and_others_stay(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)  # so that full buckets go in pairs of blocks
    rows, near = corpus(random.Random(5))
    assert len(near) > 60
    sets = {i: slow_set(t) for i, t in rows}
    ids = list(sets)
    comp = slow_components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if slow_jaccard(sets[a], sets[b]) >= 0.8])
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert kept == sorted(set(comp.values())) and not set(near) & set(kept)


def test_odd_rows(spark):
    rng = random.Random(6)
    t, u = text(rng, 80), text(rng, 80)
    w = text(rng, 80)
    rows = [(2, t), (1, t), (1, t), (1, u), (3, u), (None, t), (None, t), (4, None), (5, ""), (6, "A b"), (7, "a  B"), (8, "b"), (None, w), (None, w), (None, w.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((str(r.doc_id), r.text or "") for r in minhash.keep_one(df).collect())
    alone = [x for x in out if x[0] == "None"]  # of the texts without an id that are alike, one
    assert len(alone) == 1 and alone[0][1] in (w, w.upper())
    assert sorted(set(out) - set(alone)) == sorted([("1", t), ("1", u), ("4", ""), ("6", "A b"), ("8", "b")]) and len(out) == 6
    assert minhash.keep_one(df).columns == df.columns
    assert minhash.keep_one(df.where("false")).collect() == []


def test_simhash_finds_near_copies_before_bands(spark, monkeypatch):
    """With bands that nothing shares, copies with fingerprints at 4 bits or fewer still go, and others stay."""
    monkeypatch.setattr(minhash, "band_keys", lambda hashes, p: hashes[:0])
    rng = random.Random(8)
    base = text(rng, 1500)
    rows = [(1, base), (2, edited(rng, base, 1)), (3, text(rng, 200)), (5, text(rng, 1500))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sims = {i: minhash.simhash.simhash(t) for i, t in rows}
    assert (sims[1] ^ sims[2]).bit_count() <= 4
    assert sorted(r.doc_id for r in minhash.keep_one(df).collect()) == [1, 3, 5]
