"""The divergence audit against a plain version; tries against sorted dictionaries."""

import os
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from almanac.llm import divergence, queries
from almanac.llm.divergence import Audit
from almanac.llm.trie import merged

TERMS = st.lists(st.sampled_from(["a", "ab", "abc", "abd", "b", "ba", "é", "éa", "è", "日本", "日", "z" * 400, "z" * 399 + "y"]), max_size=40)


def leaves(trie, names, paths):
    """(path, documents, counters) of each leaf; the walk gives the same paths."""
    assert trie.terms().to_pylist() == paths.to_pylist()
    counts = [{names[s]: int(n) for s, n in zip(trie.source[a:b], trie.count[a:b])} for a, b in zip(trie.first, trie.first[1:])]
    return list(zip(paths.to_pylist(), trie.docs.tolist(), counts))


def built(terms):
    """A trie of terms, the i-th in document i // 2 of source i // 2 % 3, and what it should hold."""
    want = {}
    for i, t in enumerate(terms):
        docs, counts = want.setdefault(t.encode(), (set(), Counter()))
        docs.add(i // 2)
        counts[f"s{i // 2 % 3}"] += 1
    doc = np.arange(len(terms)) // 2
    trie, paths = divergence.counted(pa.array([t.encode() for t in terms], pa.large_binary()), doc, doc % 3)
    return trie, ["s0", "s1", "s2"], paths, [(t, len(d), dict(c)) for t, (d, c) in sorted(want.items())]


@settings(max_examples=150, deadline=None)
@given(TERMS, TERMS, st.integers(1, 9))
def test_tries_merge_like_dictionaries(one, two, size):
    (a, names, a_paths, a_want), (b, _, b_paths, b_want) = built(one), built(two)
    assert leaves(a, names, a_paths) == a_want
    sizes = [len(x) - k for x, k in zip(a_paths.to_pylist(), a.shared)]
    assert all(k == len(os.path.commonprefix([x, y])) for x, y, k in zip([b"", *a_paths.to_pylist()], a_paths.to_pylist(), a.shared)) and sum(sizes) == sum(map(len, a.label.to_pylist()))
    pages = [x for t, paths in ((a, a_paths), (b, b_paths)) for page in divergence._pages("l", t, paths, names, Audit(page=size)) for x in divergence._tries(page)]
    if pages:
        both = dict((t, (d, Counter(c))) for t, d, c in a_want)
        for t, d, c in b_want:
            old = both.get(t, (0, Counter()))
            both[t] = (old[0] + d, old[1] + Counter(c))
        assert leaves(*merged([(t, own) for _, t, own in pages])) == [(t, d, dict(c)) for t, (d, c) in sorted(both.items())]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZz @[`{é日\x7f\x80 0"), max_size=12), max_size=8))
def test_terms_are_found_in_bytes(texts):
    parts = [t.encode() for t in texts]
    terms, doc = divergence.found_terms(np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([len(t) for t in parts]).astype(int))
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    want = [(i, x.encode()) for i, t in enumerate(texts) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(upper))]
    assert list(zip(doc.tolist(), terms.to_pylist())) == want


def slow(rows, p):
    rows = [tuple(x or "" for x in r) for r in rows]
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    terms = [(lg, s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(upper))) for lg, s, t in rows]
    docs = Counter((lg, t) for lg, _, ts in terms for t in set(ts))
    kept = sorted(k for k, n in docs.items() if n >= p.least)
    count = Counter((lg, s, t) for lg, s, ts in terms for t in ts if docs[lg, t] >= p.least)
    groups, out = sorted({(lg, s) for lg, s, _ in terms}), []
    part = lambda c, n, v: 1 + divisor(c + p.prior, n + p.prior * v)
    divisor = lambda x, y: 1_000_000_000 * x // y
    for lang in sorted({lg for lg, _ in groups}):
        words = [t for lg, t in kept if lg == lang]
        sources = [s for lg, s in groups if lg == lang]
        total = {s: sum(count[lang, s, t] for t in words) for s in sources}
        prob = {(s, t): part(count[lang, s, t], total[s], len(words)) for s in sources for t in words}
        whole = {t: part(sum(count[lang, s, t] for s in sources), sum(total.values()), len(words)) for t in words}
        for s in sources:
            pairs = [(-sum(abs(prob[s, t] - prob[o, t]) for t in words), o.encode(), o) for o in sources if o != s]
            best = [(whole[t] - prob[s, t], t.encode(), t) for t in words if count[lang, s, t] and prob[s, t] > whole[t]]
            out += [(lang, s, "pair", o, -f, i + 1) for i, (f, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -f, i + 1) for i, (f, _, t) in enumerate(sorted(best)[: p.top])]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def documents(n=260):
    words = ["Alpha", "beta", "béta", "Éta", "日本", "gamma-ray", "x1y", "the", "THE", "delta", "a", "ab", "abc", "z" * 5000]
    rows = [(("en", "de", None, "")[i % 4], (f"s{i * i % 7}", None, "s0")[i % 3], " ".join(words[(i * k) % len(words)] for k in range(1, i % 23))) for i in range(n)]
    return rows + [("en", "s0", "hot hot hot the")] * 300 + [("fr", "quiet", None), ("fr", "silent", "12 !?"), ("fr", None, ""), ("en", "Z", None)]


def test_whole_result_on_odd_rows(spark):
    """Nulls, empty texts, groups without terms, ties, repeated rows, long terms, several blocks, small tries and lots."""
    rows = documents()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, item string, value int").repartition(5)
    for p in (Audit(), Audit(least=3, top=4), Audit(least=2, top=3, lot=2000, page=3, range_mb=0.0001, part=2, block=2, step=3), Audit(least=10_000)):
        assert got(divergence.audit(docs, p)) == slow(rows, p)


def test_empty_table(spark):
    assert got(divergence.audit(spark.createDataFrame([], "lang string, source string, text string"))) == []


def test_parts_are_exact_for_large_counts():
    for c, n, v in ((8 * 10**14, 8 * 10**15, 10**6), (10**9, 3 * 10**9, 7), (0, 0, 3)):
        assert int(divergence.parts_of(np.array([c]), np.array([n]), 5, v)[0]) == 1 + 10**9 * (c + 5) // (n + 5 * v)


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    sql = duckdb.sql(queries.OP12_SQL).fetchall()
    assert got(queries.op12_source_divergence(spark, d)) == sorted(sql)


def test_ranges_stay_even_where_tries_begin_alike(spark):
    """The tries of all partitions begin with the same term and fill a page each; terms are dealt to ranges by marks inside pages."""
    words = ["".join(chr(97 + i // 26**k % 26) for k in (2, 1, 0)) for i in range(1500)]
    docs = spark.createDataFrame([("en", f"s{i % 3}", " ".join(words)) for i in range(12)], "lang string, source string, text string").repartition(12)
    kept = divergence.term_leaves(docs, Audit(least=1, range_mb=0.06), docs.lang, docs.source, docs.text)
    sizes = [r["count"] for r in kept.groupBy("range").count().collect()]
    assert sum(sizes) == 1500 and len(sizes) >= 5 and max(sizes) <= 600


@settings(max_examples=100, deadline=None)
@given(TERMS.filter(bool), st.integers(1, 4), st.data())
def test_tries_are_cut_at_any_path(terms, step, data):
    trie, names, paths, want = built(terms)
    cut = data.draw(st.sampled_from(paths.to_pylist())) if len(paths) == 1 else data.draw(st.sampled_from(paths.to_pylist()[1:]))
    if len(paths) > 1:
        at, path = divergence._first_from(trie, paths[::step].to_pylist(), step, cut)
        assert paths[at].as_py() == path == cut
        got = [(0, at, paths[0].as_py()), (at, len(trie), path)]
        assert [x for a, b, first in got for x in leaves(trie.part(a, b, first), names, paths[a:b])] == want
