"""Quality rules: statistics against a plain model, verdicts on planted outliers, odd tables."""

import random
import re
from collections import defaultdict

import numpy as np

from almanac.llm import queries, rules


def slow_stats(text):
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)}
    return len(ws), sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def slow_quantile(x, share, value, fine):
    """The middle of the first bin at which `share` of the values is reached."""
    b = np.sort(np.floor(fine(x)))
    return value(b[int(np.ceil(share * len(b) - 1e-9)) - 1] + 0.5)


def slow_factor(cov, floors):
    c = np.linalg.cholesky(cov + np.diag(np.square(floors)))
    return c, 2 * np.log(np.diag(c)).sum()


def slow_distance(x, m, factor):
    return (np.linalg.solve(factor, (x - m).T) ** 2).sum(axis=0)


def slow_estimate(x, r):
    """(location, factor, scale) of one group's rows, straight from the definition."""
    log, back = (lambda v: np.log1p(v) * rules.FINE), (lambda b: np.expm1(b / rules.FINE))
    cut = np.array([[slow_quantile(x[:, i], s, back, log) for s in (0.1, 0.25, 0.5, 0.75, 0.9)] for i in range(5)])
    y = x - cut[:, 2]
    inside = ((x >= cut[:, 0] - 1e-9) & (x <= cut[:, 4] + 1e-9)).all(axis=1)
    starts = [(np.zeros(5), np.diag(((cut[:, 3] - cut[:, 1]) / 1.349) ** 2))] + [(v.mean(axis=0), np.cov(v.T, bias=True)) for v in (y, y[inside]) if len(v)]
    bin_of = lambda d: np.floor(np.log2(np.maximum(d, rules.LEAST_D2)) * rules.FINE_D2)
    found = []
    for m, c in starts:
        m, f, best = m, slow_factor(c, r.floors)[0], np.inf
        for _ in range(r.steps):
            b = bin_of(slow_distance(y, m, f))
            before = np.searchsorted(np.sort(b), b)
            near = y[before < r.coverage * len(y)]
            m2 = near.mean(axis=0)
            f2, det = slow_factor(np.cov(near.T, bias=True).reshape(5, 5), r.floors)
            if det >= best - rules.FALL:
                break
            m, f, best = m2, f2, det
        found.append((best, m, f))
    _, m, f = min(found, key=lambda e: e[0])
    half = slow_quantile(slow_distance(y, m, f), 0.5, lambda b: 2 ** (b / rules.FINE_D2), lambda d: np.log2(np.maximum(d, rules.LEAST_D2)) * rules.FINE_D2)
    return m + cut[:, 2], f, max(half / rules.CHI2_MEDIAN_5, 1.0)


def slow_kept(docs, r=rules.Robust()):
    """{doc_id: (kept, distance)} of rows (doc_id, text, lang, source)."""
    good, where = defaultdict(list), {}
    for i, t, lang, source in docs:
        n, chars, symbols, dup, rep = slow_stats(t)
        if n >= 50 and 100 * rep <= 50 * n:
            where[i] = lang, source, (np.log1p(n), chars / n, np.sqrt(symbols / max(1, chars)), np.sqrt(min(1, dup * 10 / n)), np.sqrt(rep / n))
            good[lang, source].append(i)
    small = defaultdict(int)
    for (lang, _), ids in good.items():
        small[lang] += len(ids) if len(ids) < r.least else 0
    group = {i: (lang, source) if len(good[lang, source]) >= r.least else (lang,) if small[lang] >= r.least else () for i, (lang, source, _) in where.items()}
    estimate = {g: slow_estimate(np.array([where[i][2] for i in where if group[i] == g]), r) for g in set(group.values())}
    out = {i: (False, None) for i, *_ in docs}
    for i, (*_, x) in where.items():
        m, f, scale = estimate[group[i]]
        d = float(slow_distance(np.array([x]), m, f)[0] / scale)
        out[i] = d <= r.cutoff, d
    return out


def test_verdicts_of_whole_table(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    want, got = slow_kept(docs), {r.doc_id: (r.kept, r.distance) for r in queries.op6_quality_rules(spark, d).collect()}
    assert sum(not k and x is not None for k, x in want.values()) > 20
    for i, (kept, distance) in want.items():
        assert got[i][0] == kept and (distance is None) == (got[i][1] is None) and (distance is None or abs(got[i][1] - distance) <= 1e-6 * max(1, distance)), i


def test_statistics_of_whole_table(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = queries.op6_quality_rules(spark, d).collect()
    assert len(out) == len(docs)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_stats(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert 0.5 < sum(r.kept for r in out) / sum(not r.base_failed for r in out)


def text(rng, n, junk=0.0):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) + ("###" if rng.random() < junk else "") for _ in range(n))


def test_outliers_go_and_ordinary_documents_stay(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, rng.randint(80, 400)), "en", f"s{i % 2}") for i in range(300)] + [(1000 + i, text(rng, 200, 0.7), "en", "s0") for i in range(5)]
    out = {r.doc_id: r.kept for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(out[1000 + i] for i in range(5)) and sum(out[i] for i in range(300)) >= 297


def test_odd_tables(spark):
    long = text(random.Random(2), 20000)
    rows = [(1, None, None, None), (2, "", "en", None), (3, " \n\x0b", None, "s"), (4, "a a a a " * 50, "en", "s"), (5, long, None, "s"), (None, "é|\n\né|\nx", "de", "s"), (6, "x\n" * 5000, "de", "s")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, kept int")
    out = {r.doc_id: r for r in rules.quality_rules(df).collect()}
    for i, t, *_ in rows:
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_stats(t)
    assert out[5].kept and not out[1].kept
    assert rules.quality_rules(df.where("false")).collect() == []
    good = rules.keep_good(df)
    assert good.columns == df.columns and [r.doc_id for r in good.collect()] == [5]
    assert rules.quality_rules(df.union(df)).count() == 2 * len(rows)
