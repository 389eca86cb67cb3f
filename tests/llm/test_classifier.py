"""Quality classifier: trees against plain traversal, held-out accuracy, odd tables."""

import numpy as np
from pyspark.sql import functions as F

from almanac.llm import classifier, queries


def test_trees_fit_and_traverse():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    m = classifier.Trees(classifier.Boost(trees=30)).fit(x, y)
    assert ((m.score(x) > 0.5) == (y > 0.5)).mean() > 0.97
    for row, s in zip(x[:50], m.score(x[:50])):
        total = m.start
        for t in range(m.used):
            i = 0
            for _ in range(m.p.depth):
                i = 2 * i + (2 if row[m.feature[t, i]] > m.threshold[t, i] else 1)
            total += m.leaf[t, i - 15]
        assert abs(1 / (1 + np.exp(-total)) - s) < 1e-9


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    out = queries.op8_quality_classifier(spark, d)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    r = out.where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert len(r) > 1000 and auc(r.score.to_numpy(), r.quality.to_numpy()) > 0.9
    assert (r.predicted == r.quality).mean() > 0.9


def test_odd_tables(spark):
    rows = [(i, "good plain words and more of them here. " * 20, 1) for i in range(40)] + [(100 + i, "BUY!!! $$$ ### " * 30, 0) for i in range(40)] + [(200, None, 1), (201, "", 0), (None, "x", 1), (202, "w " * 200000, 1)]
    docs = spark.createDataFrame([(i, t, 0.0, 1) for i, t, _ in rows], "doc_id long, text string, score double, x int")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(3, None), (4, 7), (999, 1)], "doc_id long, quality int")
    out = classifier.classify(docs, labels)
    r = {x.doc_id: x for x in out.collect()}
    assert len(r) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in r.values())
    assert r[3].predicted == 1 and r[103].predicted == 0
    assert {x.score for x in classifier.classify(docs, labels.where("false")).collect()} == {0.5}
    assert classifier.classify(docs.where("false"), labels).collect() == []
    assert classifier.classify(docs.union(docs), labels).groupBy("doc_id").agg(F.countDistinct("score").alias("n")).where("n > 1").count() == 0


def slow_score(x, y, p):
    """Scores of x by boosted trees whose splits are found by trying every edge of every statistic on the rows themselves."""
    edges = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, p.bins + 1)[1:-1], method="lower").tolist())) for f in range(x.shape[1])]
    total = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    gain = lambda rows, g, h: g[rows].sum() ** 2 / (h[rows].sum() + p.ridge)

    def grow(rows, g, h, depth):
        best = (1e-6, None)
        for f in range(x.shape[1]) if depth else ():
            for e in edges[f]:
                left = rows[x[rows, f] <= e]
                right = rows[x[rows, f] > e]
                if len(left) >= p.least and len(right) >= p.least:
                    won = gain(left, g, h) + gain(right, g, h) - gain(rows, g, h)
                    if won > best[0] + 1e-9:
                        best = won, (left, right)
        if best[1] is None:
            total[rows] += p.rate * g[rows].sum() / (h[rows].sum() + p.ridge)
        else:
            for side in best[1]:
                grow(side, g, h, depth - 1)

    for _ in range(p.trees):
        prob = 1 / (1 + np.exp(-total))
        grow(np.arange(len(y)), y - prob, prob * (1 - prob), p.depth)
    return 1 / (1 + np.exp(-total))


def test_fit_equals_a_brute_force_fit():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4)).astype(np.float32)
    x[:, 3] = np.round(x[:, 3])
    y = (x[:, 0] + 0.5 * x[:, 3] + rng.normal(size=400) * 0.5 > 0).astype(float)
    p = classifier.Boost(trees=6, depth=3, bins=12, least=8)
    assert np.abs(classifier.Trees(p).fit(x, y).score(x) - slow_score(x, y, p)).max() < 1e-6


def test_shared_and_missing_ids(spark):
    """More labelled rows of one id than the sample holds, ids that are null, a rare label."""
    rows = [(6, f"good plain words and more of them, {i}. " * 9, 1) for i in range(300)] + [(6, f"BUY!!! $$$ {i} ### " * 20, 0) for i in range(300)] + [(None, "lost words", 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(6, 1), (6, 0)] * 50 + [(None, 0)], "doc_id long, quality int")
    out = classifier.classify(docs, labels, classifier.Boost(sample=50, fewest=20))
    assert out.count() == 601 and 0.2 < out.agg(F.avg("score")).first()[0] < 0.8
    docs = spark.createDataFrame([(3 * i, t) for i, (_, t, _) in enumerate(rows)], "doc_id long, text string").where("doc_id % 3 = 0")
    labels = spark.createDataFrame([(3 * i, q) for i, (_, _, q) in enumerate(rows)], "doc_id long, quality int")
    got = {r.doc_id: r.predicted for r in classifier.classify(docs, labels, classifier.Boost(sample=300)).collect()}
    assert sum(got[3 * i] == q for i, (_, _, q) in enumerate(rows[:600])) >= 590
