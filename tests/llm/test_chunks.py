"""Substring dedup against a plain model, and its promises on planted passages."""

import random
import re

import numpy as np
import xxhash

from almanac.llm import chunks, queries


def slow_chunks(text):
    """(start, end, words) by a byte-by-byte gear hash."""
    ws = text.encode().split() if text else []
    cuts, h = [0], 0
    for byte in b"\0" * 32 + (b" ".join(ws) + b" " if ws else b""):
        h = (h << 1) + xxhash.xxh32_intdigest(bytes([byte]), 7) & 0xFFFFFFFF
        if byte == 32:
            cuts.append(-1 if (h >> 28) >= 3 else 1)
    low = [i for i, c in enumerate(cuts) if i and c == 1]
    cuts = sorted({0, len(ws), *low})
    out = []
    for c in cuts[:-1]:
        to = next((x for x in cuts if x >= c + 16), None)
        if to is not None or c == 0:
            out.append([c, to or len(ws)])
    if out:
        out[-1][1] = len(ws)
    return [(s, e, b" ".join(ws[s:e])) for s, e in out]


def words(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


VOCAB = ["".join(random.Random(i).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2 + i % 8)) for i in range(400)]


def test_gear_is_a_rolling_hash():
    data = np.random.default_rng(1).integers(0, 256, 500, dtype=np.uint8)
    h, out = 0, []
    for b in data:
        h = (h << 1) + int(chunks.GEAR[b]) & 0xFFFFFFFF
        out.append(h)
    assert chunks.gear(data).tolist() == out


def test_chunks_cover_texts_and_agree_with_the_model():
    rng = random.Random(2)
    texts = [words(rng, n) for n in (0, 1, 5, 16, 17, 200, 3000)] + [None, " \n ", "é " * 100]
    doc, start, end, digest, _ = chunks.chunk_texts(texts)
    for i, t in enumerate(texts):
        n = len(t.encode().split()) if t else 0
        mine = sorted(zip(start[doc == i].tolist(), end[doc == i].tolist()))
        assert set().union(*[range(s, e) for s, e in mine]) == set(range(n)) if n else not mine
        assert all(e - s >= 16 for s, e in mine) or n < 16
        far = slow_chunks(t)
        assert [x[:2] for x in far] == mine
        want = {s: xxhash.xxh3_64_intdigest(w) for s, _, w in far}
        have = dict(zip(start[doc == i].tolist(), digest[doc == i].view(np.uint64).tolist()))
        assert all(have[s] == d for s, d in want.items())


def test_planted_passages_go_and_clean_documents_stay(spark):
    rng = random.Random(3)
    passage = [words(rng, 60) for _ in range(40)]
    rows, clean = [], []
    for i in range(120):
        parts = [words(rng, rng.randint(40, 120)), words(rng, rng.randint(40, 120))]
        if i < 80:
            rows.append((i, f"{parts[0]}\n{passage[i % 40]}  {parts[1]}"))
        else:
            clean.append((i, " ".join(parts)))
    df = spark.createDataFrame(rows + clean, "doc_id long, text string")
    out = {r.doc_id: r for r in chunks.dedup_substrings(df).collect()}
    assert all(out[i].text == t and not out[i].spans for i, t in clean)
    assert all(out[i].text == t for i, t in rows if i < 40)
    cut = [sum(s.end - s.start for s in out[i].spans) for i in range(40, 80)]
    assert sum(c > 25 for c in cut) >= 39 and max(cut) <= 60
    assert all(out[i].first_ids == [i - 40] for i in range(40, 80) if out[i].spans)


def test_odd_tables(spark):
    text = words(random.Random(4), 50)
    rows = [(1, text, "a"), (2, text, "b"), (2, text, "b"), (3, None, None), (4, "", "c"), (None, text, "d"), (5, "one", "e"), (6, "one", "f"), (7, text + " " + text, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = chunks.dedup_substrings(df)
    assert got.columns == ["doc_id", "text", "spans", "spans_", "first_ids"]
    out = sorted((str(r.doc_id), r.text, r.spans) for r in got.collect())
    assert [x for x in out if x[0] in "1,2,3,4"] == [("1", text, "a"), ("2", "", "b"), ("2", "", "b"), ("3", None, None), ("4", "", "c")]
    assert ("None", "", "d") in out and ("5", "one", "e") in out and ("6", "", "f") in out
    assert chunks.dedup_substrings(df.where("false")).collect() == []


def test_rows_without_an_id_or_with_the_same_are_cut_by_their_own_spans(spark):
    rng = random.Random(8)
    passage, shared = words(rng, 60), words(rng, 60)
    rows = [(i, f"{words(rng, 10 + 40 * k)} {passage} {words(rng, 30)}") for i in (1, None, 5) for k in range(3)]
    rows += [(None, f"{words(rng, 90)} {shared} {words(rng, 9)}"), (None, f"{words(rng, 5)} {shared}"), (None, words(rng, 12)), (5, words(rng, 7)), (1, words(rng, 5))]
    df = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "row int, doc_id long, text string")
    out = {r.row: r for r in chunks.dedup_substrings(df).collect()}
    removed = [sum(s.end - s.start for s in out[k].spans) for k in range(len(rows))]
    assert all(len(out[k].text.split()) == len(t.split()) - removed[k] for k, (_, t) in enumerate(rows))
    assert all(t.startswith(out[k].text[:20]) for k, (_, t) in enumerate(rows[:9]) if k % 3)
    assert sorted(removed[:3])[0] == 0 and all(25 < n <= 60 for n in sorted(removed[:3])[1:] + removed[3:9])
    assert sorted(n > 25 for n in removed[9:11]) == [False, True] and removed[11:] == [0, 0, 0]
    assert all(out[k].first_ids[0] == 1 for k in range(3, 9)) and all(out[k].first_ids == [] for k in (9, 10))


def test_cut_words_keeps_the_rest():
    assert chunks.cut_words("  a b\n\nc  d ", [(1, 3)]) == "  a d "
    assert chunks.cut_words("a b c", [(0, 3)]) == "" and chunks.cut_words("é b\tc", [(2, 3)]) == "é b\t"
    assert chunks.merge_spans([5, 0, 2], [9, 3, 5]) == [(0, 9)]


def test_query_gives_each_document(spark):
    out = queries.op4_substring_dedup(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 200 and all(sum(s.end - s.start for s in r.spans) == r.removed_words for r in out)


def slow_dedup(rows, whole):
    """{(id, text): (text without repeats, spans, first ids)} by reading documents one after the other; whole: digests
    that order texts of one id."""
    docs = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0, whole[r[1]]))
    holders, out = {}, {}
    for i, t in docs:
        spans, ids, own = [], set(), set()
        for s, e, w in slow_chunks(t):
            if w in own:
                spans.append((s, e))
                ids.add(i)
            elif w in holders:
                spans.append((s, e))
                ids.add(holders[w])
            own.add(w)
        for w in own:
            holders.setdefault(w, i)
        gone = {k for s, e in spans for k in range(s, e)}
        at, k, kept = 0, 0, []
        for piece in re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|^[\x20\x09-\x0D]+", t):
            if piece[0] in " \t\n\v\f\r":
                kept.append(piece)
                continue
            if k not in gone:
                kept.append(piece)
            k += 1
        out[i, t] = "".join(kept), chunks.merge_spans([s for s, _ in spans], [e for _, e in spans]), sorted(x for x in ids if x is not None)
    return out


def test_whole_result_against_reading_one_after_the_other(spark):
    """300 documents with shared passages, repeated rows, ids that repeat or are missing, repeats inside a document."""
    rng = random.Random(11)
    passages, rows = [words(rng, n) for n in (20, 35, 60, 90, 400)], []
    for i in range(220):
        parts = [words(rng, rng.choice([0, 3, 17, 40, 120])) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randint(1, 5))]
        rows.append((rng.choice([None, None, 3, i, i, i, i // 2]), rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += rng.choices(rows, k=60) + [rows[0]] * 15 + [(None, None), (4, ""), (5, " \n"), (6, "é " * 60), (6, "é " * 60 + "end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    whole = {r.text: r.w for r in df.select("text", chunks.whole_digest(df.text).alias("w")).collect()}
    want = slow_dedup(rows, whole)
    got = chunks.dedup_substrings(df).join(df.groupBy("doc_id").count(), "doc_id", "left").collect()
    by = sorted((str(r.doc_id), r.text or "", [tuple(s) for s in r.spans], r.first_ids) for r in got)
    assert by == sorted((str(i), *(want[i, t] if t is not None else ("", [], []))) for i, t in rows)
    assert sum(bool(s) for *_, s, _ in by) > 100


def test_many_equal_rows_without_an_id(spark):
    text = words(random.Random(12), 900)
    df = spark.createDataFrame([(None, text, ["x"])] * 500 + [(1, "other words " + text, [])], "doc_id long, text string, spans array<string>")
    assert chunks.added_columns(df) == ("spans_", "first_ids")
    out = chunks.dedup_substrings(df).groupBy("doc_id", "text", "spans_").count().collect()
    assert sorted(r["count"] for r in out) == [1, 500]
