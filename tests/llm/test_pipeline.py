"""The pipeline: each stage does what its operator promises, and nothing goes that should stay."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_rules import text

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t):
    ws = (t or "").split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_odd_tables(spark, tmp_path):
    """Null and repeated ids, repeated rows, clashing columns, nulls, a very long text: every stage keeps the columns."""
    rng = random.Random(3)
    rows = [(i if i % 5 else None, text(rng, 120), "en", f"s{i % 2}") for i in range(60)] + [(7, text(rng, 150), None, None), (7, text(rng, 160), "en", "s0")]
    rows += [rows[0]] * 20 + [(None, None, None, None), (90, "", "en", "s0"), (91, text(rng, 60_000), "en", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "x", [1], 2) for r in rows], COLUMNS + ", spans string, first_ids array<int>, n_words int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns[:8] == [*[c.split()[0] for c in COLUMNS.split(", ")], "spans", "first_ids", "n_words"] and docs.count() > 50
        names.append({tuple(r) for r in docs.select("spans", "n_words").distinct().collect()})
    assert names == [{("x", 2)}] * 4 and corpus_pipeline.run(spark, str(tmp_path)).count() > 50


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(7)
    passage = text(rng, 70)
    rows = [(i, text(rng, rng.randint(90, 300)), "en", f"s{i % 3}") for i in range(200)]
    rows += [(300 + i, rows[i][1], "en", "s1") for i in range(10)]  # copies
    rows += [(400 + i, f"{text(rng, 80)} {passage} {text(rng, 60)}", "en", "s2") for i in range(5)]
    rows += [(500, "too short", "en", "s0"), (501, None, "en", "s0"), (502, "", None, None)]
    docs = spark.createDataFrame([(i, t, a, s, len(t or "")) for i, t, a, s in rows], COLUMNS)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs, got = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        got[name] = docs
        if name != "pack":
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    ids = {k: sorted(r.doc_id for r in v.select("doc_id").distinct().collect()) for k, v in got.items()}
    assert not {500, 501, 502} & set(ids["quality"]) and len(ids["quality"]) >= 205
    kept = ids["near_dedup"]
    assert not set(range(300, 310)) & set(kept) and set(ids["quality"]) - set(range(300, 310)) - set(kept) == set()
    sets = {i: shingles(t) for i, t, *_ in rows}
    assert all(jaccard(sets[a], sets[b]) < 0.8 for a in kept for b in kept if a < b)
    assert all(any(jaccard(sets[a], sets[b]) >= 0.8 for b in ids["quality"] if b != a) for a in set(ids["quality"]) - set(kept))
    cut = {r.doc_id: r for r in got["substring_dedup"].collect()}
    assert set(cut) == set(kept) and all(cut[i].text == t for i, t, *_ in rows if i in cut and i < 401)
    assert all(len(cut[i].text.split()) < 175 and cut[i].n_chars == len(cut[i].text) for i in range(401, 405) if i in cut)
    mixed = [(r.doc_id, r.text) for r in got["mix_sources"].collect()]
    assert all(t == cut[i].text for i, t in mixed)
    pieces = got["pack"].collect()
    words = sum(r.length for r in pieces)
    per_doc = {}
    for p in pieces:
        per_doc[p.doc_id] = p.doc_tokens
    assert words == sum(per_doc[i] for i, _ in mixed)


def test_run_over_a_whole_table(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.where("length <= 0").count() == 0
    by = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("to"))
    assert by.where("n <> to OR n > 4096").count() == 0


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
