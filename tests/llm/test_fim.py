"""Fill-in-middle against a plain version, rank and select against counting."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from almanac.llm import fim, queries
from almanac.llm.bits import Bits


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 3000), st.sampled_from([0.0, 0.01, 0.5, 1.0]))
def test_rank_and_select_count_bits(seed, n, share):
    flags = np.random.default_rng(seed).random(n) < share
    bits, upto = Bits(flags), np.concatenate([[0], np.cumsum(flags)])
    assert bits.total == flags.sum()
    assert (bits.rank(np.arange(n + 1)) == upto).all()
    assert (bits.select(np.arange(1, bits.total + 1)) == np.flatnonzero(flags)).all()


def slow(i, text):
    t = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 90:
        return i, len(units), "plain", None, None, t
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h[3] % 100 < 20 else f"<P>{pre}<S>{suf}<M>{mid}"
    return i, len(units), "spm" if h[3] % 100 < 20 else "psm", len(pre), len(mid), out


PIECES = ["a", "Zeb", " ", "\n", "\0", "é", "ß", "😀", "é", "<", ">", "P", "<S", "S>", "7", "ſ"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*PIECES, "<M>"]), max_size=30).map("".join), max_size=8))
def test_texts_are_cut_like_the_plain_version(texts):
    n, form, pre, mid, out = fim.cut_texts(list(range(len(texts))), [t.encode() for t in texts], fim.Middle())
    none = lambda x: None if x < 0 else int(x)
    assert [(i, int(n[i]), form[i], none(pre[i]), none(mid[i]), out[i].decode()) for i in range(len(texts))] == [slow(i, t) for i, t in enumerate(texts)]


def rows_of(spark, rows, schema="doc_id long, text string, output string, n int"):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], schema)


def test_odd_rows_and_round_trip(spark):
    """Nulls, empty and very long texts, marks, repeated rows, a clashing column."""
    rows = [(1, None), (2, ""), (3, "one two, three"), (3, "one two, three"), (None, "no id here"), (4, "a <P> b"), (5, "é" * 300_000 + "x y" * 100_000), (-7, "neg ative"), (6, "<<P" + ">" * 3), (8, "…\n\n\t")]
    rows += [(i, f"some <S words {i} < M > and more of it") for i in range(10, 200)]
    out = fim.fill_in_middle(rows_of(spark, rows)).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: (str(r[0]), r[5])
    assert sorted([tuple(r)[:6] for r in out], key=key) == sorted([slow(i, t) for i, t in rows], key=key)
    assert sorted((str(r.doc_id), r.back) for r in out) == sorted((str(i), t or "") for i, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fim.fill_in_middle(rows_of(spark, [])).collect() == []


def test_query_digests(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in queries.op13_fill_in_middle(spark, d).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted((*slow(i, t)[:5], sha(slow(i, t)[5]), sha(t or "")) for i, t in docs)
