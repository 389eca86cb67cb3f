"""Keywords of a table against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from almanac.functions.text import cleaned
from almanac.operators import keywords


@pytest.mark.parametrize("small", [200_000, 0])
def test_first_keyword(spark, monkeypatch, small):
    """Both plans, on random words: repeated, nested, with blanks, short ones, equal priorities, hot texts, clashing columns."""
    monkeypatch.setattr(keywords, "SMALL_ROWS", small)
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 12))) for _ in range(300)] + [max(vocab, key=len) + " x"] * 200 + ["", None, "ab " * 40_000 + "lastword"]
    listed = [(rng.randint(0, 40), w) for w in rng.choices(vocab, k=60)] + [(rng.randint(0, 40), f"{a} {b}") for a, b in zip(vocab, vocab[1:])]
    listed += [(rng.randint(0, 40), w[1:]) for w in vocab if len(w) > 7] + [(0, ""), (0, None), (50, "lastword"), (60, "a b"), (0, "nowhere at all")]
    table = spark.createDataFrame([(p, w, f"{p}:{w}") for p, w in listed], "priority int, word string, label string")
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumns({"_key": F.lit(1), "label": F.lit("own"), "n": F.lit(2)}).repartition(3)
    out = keywords.first_keyword(rows, "t", table, form=cleaned)
    assert out.columns == [*rows.columns, "label_"]
    got = {r.i: r.label_ for r in out.collect()}

    def plain(t):
        t = t or ""
        fits = lambda w: w in t if len(w) >= 6 or " " in w else len(w) >= 3 and w in t.split()
        best = min(((p, w) for p, w in listed if w and fits(w)), default=None)
        return best and f"{best[0]}:{best[1]}"

    assert len(got) == len(texts) and [(t, got[i], plain(t)) for i, t in enumerate(texts) if got[i] != plain(t)] == []
    assert keywords.first_keyword(rows, "t", table.where("false")).where("label_ IS NOT NULL").count() == 0
    assert keywords.first_keyword(rows.where("false"), "t", table).collect() == []


@pytest.mark.parametrize("head", [(256, 2048), (5, 20)])
def test_texts_meet_keywords_without_copies(spark, monkeypatch, head):
    """400 texts that hold 300 keywords each, all with one stretch: no text is written for each keyword that it may hold."""
    monkeypatch.setattr(keywords, "HEADS", head)
    written, real = {}, keywords.materialize

    def counted(df, name):
        out = real(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(keywords, "materialize", counted)
    ws = [f"friedhof{i:03d}" for i in range(300)]
    table = spark.createDataFrame([(1000 - i, w, w) for i, w in enumerate(ws)] + [(0, "nirgends da", "x")], "priority int, word string, label string")
    rows = spark.createDataFrame([(i, " ".join(ws[: len(ws) - i % 2])) for i in range(400)] + [(400, "nichts"), (401, None)], "i int, t string")
    got = {r.i: r.label for r in keywords.first_keyword(rows, "t", table, form=cleaned).collect()}
    assert got == {i: None if i >= 400 else ws[299 - i % 2] for i in range(402)}
    assert "text-grams" not in written and max(written.values()) <= 10 * 402
