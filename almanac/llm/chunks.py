"""Substring dedup by content-defined chunks: a gear rolling hash sets the cuts, digests compare."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import bounded_batches, drop, join_hot, materialize, spare

#: One random number for each byte value, made by a rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], dtype=np.uint32)
#: With 32-bit sums a byte leaves the gear hash after 32 steps.
REACH = 32
#: Of 16 word ends this many, on average, are cuts.
CUTS_IN_16 = 3
#: A chunk ends at the first cut at which it has this many words.
LEAST_WORDS = 16


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + GEAR[data[i]] modulo 2**32 for all i, by doubling the reach five times."""
    h, step = GEAR[data], 1
    while step < REACH:
        nxt = h.copy()
        nxt[step:] += h[:-step] << np.uint32(step)
        h, step = nxt, step * 2
    return h


def chunk_texts(texts: list[str | None], least: int = LEAST_WORDS, cuts_in_16: int = CUTS_IN_16) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, digest, again) of all chunks, in words of the text of that row.

    Cuts are word ends at which the gear hash of the last 32 bytes, words joined by one space, is
    low, and both ends of the text. A chunk opens at each cut and closes at the first cut that
    gives it `least` words; so chunks overlap, and a passage that two texts share has the same
    chunks in both from 32 bytes after its begin on, wherever it stands. The last chunk goes to
    the text's end, and a shorter text is one chunk. again: an equal chunk stands earlier in the text.
    """
    joined, sizes = [], []
    for t in texts:
        ws = t.encode("utf-8", "surrogatepass").split() if t else []
        sizes.append(len(ws))
        joined.append(b"\0" * REACH + b" ".join(ws) + b" " if ws else b"")
    if not any(sizes):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none.astype(bool)
    buf = b"".join(joined)
    data = np.frombuffer(buf, dtype=np.uint8)
    spaces = np.flatnonzero(data == 32)  # the k-th ends word k of all the words
    low = gear(data)[spaces] >> np.uint32(28) < cuts_in_16
    n = np.array(sizes, dtype=np.int64)
    last = np.cumsum(n)
    base = last - n
    cuts = np.unique(np.concatenate([np.flatnonzero(low) + 1, last, base]))
    opens = cuts[:-1]  # both ends of every text are cuts; the last of all opens nothing
    doc = np.searchsorted(last, opens, side="right")
    closes = cuts[np.minimum(np.searchsorted(cuts, opens + least), len(cuts) - 1)]
    enough = (closes <= last[doc]) & (closes - opens >= least)
    keep = enough | (opens == base[doc])
    opens, closes, doc = opens[keep], closes[keep], doc[keep]
    final = np.append(doc[1:] != doc[:-1], True)
    closes[final] = last[doc[final]]
    # a word starts after the space before it, the first of a text after its padding
    first_byte = np.cumsum([0, *map(len, joined)])[:-1] + REACH
    begin = np.where(opens == base[doc], first_byte[doc], spaces[np.maximum(opens - 1, 0)] + 1)
    end = spaces[closes - 1]
    digest = np.array([xxhash.xxh3_64_intdigest(buf[a:b]) for a, b in zip(begin.tolist(), end.tolist())], dtype=np.uint64).view(np.int64)
    order = np.lexsort((opens, digest, doc))
    same = (digest[order][1:] == digest[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again = np.zeros(len(doc), dtype=bool)
    again[order[1:][same]] = True
    return doc, opens - base[doc], closes - base[doc], digest, again


#: Texts are chunked in lots of about so many characters.
LOT = 1 << 20


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(rows: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        doc, start, end, digest, again = chunk_texts(texts)
        keys = [rows.column(c).take(pa.array(doc)) for c in ("doc_id", "whole")]
        return pa.RecordBatch.from_arrays([*keys, pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(digest), pa.array(again)], names=["doc_id", "whole", "start", "end", "digest", "again"])

    for batch in batches:
        texts, at, size = batch.column("text").to_pylist(), 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= LOT or i == len(texts) - 1:
                yield done(batch.slice(at, i + 1 - at), texts[at : i + 1])
                at, size = i + 1, 0


def whole_digest(text: Column) -> Column:
    """With the id, it names a document: rows of one id that differ in text are several."""
    return F.xxhash64(text)


def repeated_chunks(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, whole, start, end, first_id) of each chunk that stands in an earlier document too
    (first_id: the id of the first) or earlier in its own, in words. Documents are ordered by id,
    null ids last, then by whole, the digest of the whole text; rows equal in both are one document.

    Chunks are written once. A digest's count and smallest id come from sums that tasks make
    before they shuffle; then the chunks meet the digests of several documents by join_hot(), so that
    a very frequent one gathers in no task. Where several documents have the smallest id,
    or all have none, the smallest whole among them is found in the same way. Rows equal in id and
    text give equal chunks, of which all but one are dropped where a document's are gathered.
    """
    bounded_batches(docs.sparkSession)
    text = F.col(text_col)
    rows = docs.select(F.col(key_col).cast("long").alias("doc_id"), whole_digest(text).alias("whole"), text.alias("text"))
    chunks = materialize(rows.mapInArrow(_chunk_rows, "doc_id long, whole long, start int, end int, digest long, again boolean"), "chunks")
    several = chunks.where("NOT again").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
    several = materialize(several, "several")
    met = materialize(join_hot(chunks.where("NOT again"), several, ["digest"]).select("doc_id", "whole", "start", "end", "digest", "first_id"), "met")
    across = met.where("NOT (doc_id <=> first_id)").select("doc_id", "whole", "start", "end", "first_id")
    least = met.where("doc_id <=> first_id")
    tied = least.groupBy("digest").agg(F.min("whole").alias("w"), F.max("whole").alias("v")).where("w < v").select("digest", "w").hint("merge")
    ties = least.join(tied, "digest").where("whole > w").select("doc_id", "whole", "start", "end", "first_id")
    within = chunks.where("again").select("doc_id", "whole", "start", "end", F.col("doc_id").alias("first_id"))
    out = materialize(across.unionByName(ties).unionByName(within), "repeated")
    for df in (chunks, several, met):
        drop(df)
    return out


def merge_spans(start: list[int], end: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(start, end)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and the white space after them."""
    data = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(data, dtype=np.uint8)
    word = np.append(False, (b != 32) & ((b < 9) | (b > 13)))
    begin = np.append(np.flatnonzero(word[1:] & ~word[:-1]), len(b))
    kept, at = [], 0
    for s, e in spans:
        kept.append(data[at : begin[s]])
        at = begin[e]
    return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")


def added_columns(docs: DataFrame) -> tuple[str, str]:
    """What dedup_substrings() calls the columns spans and first_ids that it adds to those of docs."""
    spans, first_ids = spare(docs, "spans", "first_ids")
    return spans, first_ids


def dedup_substrings(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated chunks cut out of the texts, and the columns spans (array of start and
    end, in words of the old text), first_ids (the documents that hold what was cut), after the
    columns of docs; their names get underscores if docs has such columns (added_columns()).

    The first occurrence, by id, null last, then digest of the whole text, and place, stays. Null
    texts stay null; texts without a word stay as they are. Ties can't arise: a place is one of a
    document. Rows with the same id and text count as one document and are cut alike; rows of one
    id, or of none, with different texts are documents of their own. first_ids leaves null ids out.
    An empty table gives an empty result. Other columns pass through.
    """
    spans_name, ids_name, key, whole, cuts = spare(docs, "spans", "first_ids", "_key", "_whole", "_cuts")
    found = repeated_chunks(docs, key_col, text_col)
    lists = found.groupBy("doc_id", "whole").agg(F.collect_set(F.struct("start", "end")).alias("c"), F.array_sort(F.collect_set("first_id")).alias("ids"))
    lists = materialize(lists.select(F.col("doc_id").alias(key), F.col("whole").alias(whole), merged_spans(F.col("c.start"), F.col("c.end")).alias(cuts), F.col("ids").alias(ids_name)), "spans")
    # digests and span lists grow with the documents, so neither is ever broadcast
    joined = docs.join(lists.hint("merge"), F.col(f"`{key_col}`").cast("long").eqNullSafe(F.col(key)) & (whole_digest(F.col(f"`{text_col}`")) == F.col(whole)), "left")
    cut = joined.where(F.col(cuts).isNotNull())
    cut = cut.withColumn(text_col, without_words(F.col(f"`{text_col}`"), F.col(f"{cuts}.start"), F.col(f"{cuts}.end")))
    both = cut.unionByName(joined.where(F.col(cuts).isNull()))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(cuts), empty).alias(spans_name), F.coalesce(F.col(ids_name), F.array().cast("array<long>")).alias(ids_name))


def merged_spans(start: Column, end: Column) -> Column:
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([[{"start": int(a), "end": int(b)} for a, b in merge_spans(s.tolist(), e.tolist())] for s, e in zip(starts, ends)])

    return run(start, end)


def without_words(text: Column, start: Column, end: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else cut_words(t, list(zip(s, e))) for t, s, e in zip(texts, starts, ends)], dtype=object)

    return run(text, start, end)
