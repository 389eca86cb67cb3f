"""Packing documents into token sequences by an order-preserving dynamic program."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import bounded_batches


@dataclass(frozen=True)
class Pack:
    """window: tokens of a full sequence. end_id: closes each document. block: tokens that one
    dynamic program covers; its last window is left to the next block. Penalties in padded tokens:
    sentence for a cut after a sentence inside a document, inside for any other cut in one, window
    for each sequence. stride: sentences longer than this may be cut inside at multiples of it."""

    tokenizer: str = "word_bpe_49k.json"
    window: int = 4096
    end_id: int = 2
    block: int = 1 << 19
    sentence: float = 4.0
    inside: float = 32.0
    per_window: float = 1.0
    stride: int = 256
    cache: int = 500_000


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


#: Latin letters and then signs, none of them a letter or digit.
SIGNED = re.compile(rb"([a-z]+)([!-/:-@\[-`{-~]+)")


#: Bytes of a word whose ids are kept; longer ones, such as a text without spaces, are encoded each time.
LONGEST = 64


class _Ids(dict):
    """Ids of words as little-endian unsigned 32-bit bytes, made when first asked for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        self.tok = Tokenizer.from_file(path)
        self.bpe, self.letters = self.tok.model, dict(enumerate(_byte_letters()))

    def __missing__(self, word: bytes) -> bytes:
        if m := SIGNED.fullmatch(word):  # letters and signs are never in one piece
            out = self[m[1]] + self[m[2]]
        else:
            w = word.decode("utf-8")
            if w.isalpha() and max(w) < "\u0250" and w.lower() == w and is_normalized("NFC", w):
                # a run of small Latin letters is what the tokenizer hands to its model, byte by byte
                ids = [t.id for t in self.bpe.tokenize(w if w.isascii() else word.decode("latin-1").translate(self.letters))]
            else:
                ids = self.tok.encode(w, add_special_tokens=False).ids
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONGEST:
            self[word] = out
        return out


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer folds case and never joins what white space divides, so a text's ids are those
    of its words, A-Z in lower case, one after another. Each word is encoded once and kept; beyond
    `keep` words the older half, which holds the frequent ones, stays.
    """

    def __init__(self, path: str, keep: int):
        self.ids, self.keep = _Ids(path), keep

    def encode(self, text: str | None) -> bytes:
        data = text.encode("utf-8") if text else b""
        if b"<|" not in data:  # special tokens are found before case is folded
            data = data.lower()
        if len(self.ids) > self.keep:
            for w in list(islice(reversed(self.ids), self.keep // 2)):
                del self.ids[w]
        return b"".join(map(self.ids.__getitem__, data.split()))

    def sentence_ends(self) -> np.ndarray:
        """For each id, whether its piece ends a word with a full stop, question or exclamation mark."""
        vocab = self.ids.tok.get_vocab()
        out = np.zeros(max(vocab.values()) + 1, dtype=bool)
        out[[i for piece, i in vocab.items() if piece.endswith((".</w>", "!</w>", "?</w>"))]] = True
        return out


def cut_points(place: np.ndarray, penalty: np.ndarray, p: Pack) -> list[tuple[int, float]]:
    """Best way to cut at places (ascending, from 0, no gap above a window): for each place its best predecessor's
    index and cost.

    cost(j) = penalty(j) + min over i within a window of cost(i) + window - (place(j) - place(i)),
    where a length that is a power of two pads nothing. Without that exception the minimum is of
    cost(i) + place(i) over a sliding range, which a monotone queue keeps; the exception adds the
    pairs of places that lie a power of two apart.
    """
    at, pen = place.tolist(), penalty.tolist()
    later, earlier = [np.array([len(at)])], [np.array([0])]
    for k in range(p.window.bit_length()):
        x = np.searchsorted(place, place - (1 << k))
        j = np.flatnonzero((place - (1 << k) >= 0) & (place[x] == place - (1 << k)))
        later.append(j)
        earlier.append(x[j])
    order = np.argsort(np.concatenate(later), kind="stable")
    pairs = iter(zip(np.concatenate(later)[order].tolist(), np.concatenate(earlier)[order].tolist()))
    pj, pi = next(pairs)
    best: list[tuple[int, float]] = [(-1, 0.0)]
    key, queue = [0.0], deque([0])
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0]] < here - p.window:
            queue.popleft()
        i = queue[0]
        low = key[i] + p.window - here
        while pj == j:
            if best[pi][1] < low:
                low, i = best[pi][1], pi
            pj, pi = next(pairs)
        low += pen[j] + p.per_window
        best.append((i, low))
        k = low + here
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
        key.append(k)
    return best


def cut_block(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, p: Pack, last: bool) -> np.ndarray:
    """Places at which windows end, ascending. Unless last, what follows the last one stays for the next block."""
    n = len(ids)
    is_end = ends_sentence[np.minimum(ids, len(ends_sentence) - 1)]
    cuts = np.unique(np.concatenate([[0], np.flatnonzero(is_end) + 1, doc_ends]))
    if cuts[-1] != n:
        cuts = np.append(cuts, n)
    gaps = np.diff(cuts)
    long = np.flatnonzero(gaps > p.stride)
    more = [np.arange(cuts[i] + p.stride, cuts[i + 1], p.stride) for i in long]
    if last:  # the rest can be cut anywhere, so that it fills sequences that need no padding
        more.append(np.arange(max(1, n - 2 * p.window), n))
    place = np.unique(np.concatenate([cuts, *more]))
    penalty = np.full(len(place), p.inside)
    penalty[np.isin(place, cuts)] = p.sentence
    penalty[np.isin(place, doc_ends)] = 0.0
    best = cut_points(place, penalty, p)
    j = len(place) - 1
    if not last:  # end where the cost is least among the last places
        from_ = np.searchsorted(place, n - p.window)
        costs = [best[k][1] for k in range(from_, len(place) - 1)]
        j = from_ + int(np.argmin(costs)) if costs else j
    out = []
    while j > 0:
        out.append(place[j])
        j = best[j][0]
    return np.array(out[::-1], dtype=np.int64)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(2)
def _encoder(path: str, keep: int) -> Encoder:
    """One for each Python worker, which Spark uses for task after task."""
    return Encoder(path, keep)


def _packer(path: str, p: Pack):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, p.cache)
        ends_sentence = enc.sentence_ends()
        close = np.array([p.end_id], dtype="<u4").tobytes()
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        # documents not yet written: id, tokens of the document already written, all its tokens, bytes of the rest
        held: list[list] = []
        size = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal sequence, held, size
            data = b"".join(h[3] for h in held)
            ids = np.frombuffer(data, dtype="<u4")
            lens = np.array([len(h[3]) // 4 for h in held], dtype=np.int64)
            doc_ends = np.cumsum(lens)
            wins = cut_block(ids, doc_ends, ends_sentence, p, last)
            upto = int(wins[-1])
            edges = np.unique(np.concatenate([[0], wins, doc_ends[doc_ends <= upto]]))
            a, b = edges[:-1], edges[1:]
            d = np.searchsorted(doc_ends, a, side="right")
            w = np.searchsorted(wins, a, side="right")
            win_start = np.append(0, wins[:-1])
            view = memoryview(data)
            doc_start = doc_ends - lens
            out = pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([held[k][0] for k in d], pa.int64()),
                    "start": a - doc_start[d] + np.array([h[1] for h in held], dtype=np.int64)[d],
                    "length": b - a,
                    "ids_crc32": np.array([zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist())], dtype=np.int64),
                    "doc_tokens": np.array([h[2] for h in held], dtype=np.int64)[d],
                    "sequence_id": sequence + w,
                    "offset": a - win_start[w],
                }
            )
            sequence += len(wins)
            rest = int(np.searchsorted(doc_ends, upto, side="right"))
            left = held[rest:]
            if left and (done := upto - int(doc_start[rest])) > 0:
                left[0] = [left[0][0], left[0][1] + done, left[0][2], left[0][3][4 * done :]]
            held, size = left, int(lens.sum()) - upto
            return out

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = enc.encode(text) + close
                held.append([key, 0, len(data) // 4, data])
                size += len(data) // 4
                while size >= p.block:
                    yield flush(False)
        if held:
            yield flush(True)

    return run


def pack(docs: DataFrame, path: str, p: Pack = Pack(), key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. A sequence's pieces lie at offsets without a gap; a sequence that is neither full nor
    as long as a power of two is padded to p.window.

    Documents keep the order of their partition, and nothing is shuffled: a task packs its own
    partition block by block and holds one block and one document. sequence_id is the partition's
    number times 2**33 plus a count. Null and empty texts consist of end_id alone. Rows that
    repeat are packed each; null ids are allowed. Equal costs go to the longer window. An empty
    table gives an empty result. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_packer(path, p), SCHEMA)
