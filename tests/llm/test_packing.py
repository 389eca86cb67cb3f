"""Packing: exact ids, gapless sequences, little padding, and the best cost by brute force."""

import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from almanac.llm import packing, queries

PATH = queries.tokenizer("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)
ENC = packing.Encoder(PATH, 1000)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" \t\n\x0b\x0c\r\x1c\x85\xa0'sİΣ<|endoftext|>"))), max_size=60))
def test_encoding_word_by_word_is_exact(text):
    assert np.frombuffer(ENC.encode(text), dtype="<u4").tolist() == TOK.encode(text, add_special_tokens=False).ids


def check(rows, pieces, least_fill=0.97):
    ids = {i: np.array(TOK.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4") for i, t in rows}
    of, seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
        seq[p.sequence_id].append(p)
    assert set(of) == set(ids)
    for i, ps in of.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[i])
            at += p.length
            assert p.ids_crc32 == zlib.crc32(ids[i][p.start : at].tobytes())
        assert at == len(ids[i])
    padded = 0
    for ps in seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        padded += at if at & (at - 1) == 0 else 4096
    fill = sum(map(len, ids.values())) / padded
    assert fill >= least_fill
    return fill


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert check(rows, queries.op5_packing(spark, d).collect()) > 0.995


def test_small_blocks_and_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "word " * 30000), (4, "A b. C d! " * 900), (5, "x")] + [(i, "some words here. " * (i % 50)) for i in range(6, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    check(rows, packing.pack(df, PATH, packing.Pack(block=8192)).collect(), 0.99)
    assert packing.pack(df.where("false"), PATH).collect() == []
    twice = spark.createDataFrame([(None, "a"), (None, "a"), (7, "a"), (7, "a")], "doc_id long, text string")
    assert len(packing.pack(twice, PATH).collect()) >= 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.sampled_from([0.0, 2.0, 5.0])), min_size=1, max_size=40))
def test_cuts_cost_least(steps):
    p = packing.Pack(window=12)
    place = np.cumsum([0, *[s for s, _ in steps]])
    penalty = np.array([0.0, *[c for _, c in steps]])
    best = [0.0]
    for j in range(1, len(place)):
        options = []
        for i in range(j):
            n = int(place[j] - place[i])
            if n <= 12:
                options.append(best[i] + (0 if n & (n - 1) == 0 else 12 - n))
        best.append(min(options) + penalty[j] + p.per_window)
    assert np.allclose([c for _, c in packing.cut_points(place, penalty, p)], best)
