"""Fill-in-middle: texts are cut at two unit boundaries and their parts put in another order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.bits import Bits
from almanac.llm.common import bounded_batches, let


@dataclass(frozen=True)
class Middle:
    """marks: what stands before prefix, suffix and middle. plain_from: of 100 texts, those from this number on stay
    as they are. spm_below: of 100 others, those below this number have the suffix first. seed: of the draws."""

    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    plain_from: int = 90
    spm_below: int = 20
    seed: int = 1


#: Texts are cut in lots of about so many bytes.
LOT = 4 << 20
FORMS = "plain", "psm", "spm"


def unit_ends(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes that end a unit, bytes that end a code point) of texts laid end to end in data, of which those
    that are not empty begin at starts. A unit is a run of A-Z and a-z or one other code point."""
    low = data | np.uint8(32)
    letter = (low >= 97) & (low <= 122)
    follows = np.append((data[1:] & np.uint8(0xC0)) == 0x80, False)  # the next byte belongs to this code point
    char = ~follows
    same = np.append(letter[1:], False) & letter
    same[starts[starts > 0] - 1] = False
    char[starts[starts > 0] - 1] = True
    return char & ~same, char


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def cut_texts(ids: list[int | None], texts: list[bytes], p: Middle) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, list[bytes]]:
    """(units, form, code points of prefix and of middle, or -1 if plain, output) of each text.

    One bitvector over all texts marks the bytes that end a unit, another those that end a code point. The
    ones between the ends of a text are its units; a cut after k units lies behind the one that is k places
    on, found by select; code points are ones of the other vector between cuts.
    """
    size = np.array([len(t) for t in texts], dtype=np.int64)
    end = np.cumsum(size)
    begin = end - size
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    unit, char = map(Bits, unit_ends(data, begin[size > 0]))
    base = unit.rank(begin)
    n = unit.rank(end) - base
    h = np.array([draws(p.seed, i) for i in ids], dtype=np.int64).reshape(-1, 4)
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)

    def place(k: np.ndarray) -> np.ndarray:
        out = begin.copy()
        out[k > 0] = unit.select((base + k)[k > 0]) + 1
        return out

    one, two = place(np.minimum(a, b)), place(np.maximum(a, b))
    marks = [m.encode() for m in p.marks]
    plain = (size == 0) | (h[:, 2] % 100 >= p.plain_from) | np.array([any(m in t for m in marks) for t in texts], dtype=bool)
    form = np.where(plain, 0, np.where(h[:, 3] % 100 < p.spm_below, 2, 1))
    out = []
    for t, f, s, x, y in zip(texts, form.tolist(), begin.tolist(), one.tolist(), two.tolist()):
        pre, mid, suf = t[: x - s], t[x - s : y - s], t[y - s :]
        out.append(t if not f else b"".join([marks[0], pre, marks[1], suf, marks[2], mid] if f == 1 else [marks[1], suf, marks[0], pre, marks[2], mid]))
    chars = [np.where(plain, -1, char.rank(y) - char.rank(x)) for x, y in ((begin, one), (one, two))]
    return n, [FORMS[f] for f in form], *chars, out


def fill_in_middle(docs: DataFrame, p: Middle = Middle(), key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n, form, prefix_chars, middle_chars, output.

    A text has n units; prefix and middle end after numbers of units drawn by a hash of p.seed and the id, so
    reruns and repeated rows agree. form: plain (output is the text), psm or spm. Null texts count as
    empty. Empty texts and texts that hold one of the marks are plain, with null lengths. A null id
    draws as the empty id. Texts of any length are cut whole. An empty table gives an empty result.
    Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            at = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= LOT or i == len(texts) - 1:
                    n, form, pre, mid, out = cut_texts(ids[at : i + 1], texts[at : i + 1], p)
                    lengths = [pa.array(x, mask=x < 0) for x in (pre, mid)]
                    output = pa.array(out, pa.binary()).cast(pa.string(), safe=False)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : i + 1], pa.int64()), pa.array(n), pa.array(form), *lengths, output], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                    at, size = i + 1, 0

    return docs.select(F.col(key_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)


def restore(output: Column, form: Column, p: Middle = Middle()) -> Column:
    """The text that fill_in_middle() made output of."""
    pre, suf, mid = (F.lit(m) for m in p.marks)

    def split(text: Column, mark: Column, body) -> Column:
        at = F.instr(text, mark)
        return body(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(mark), F.length(text)))

    def joined(first: Column, second: Column, psm: bool) -> Column:
        whole = F.substring(output, F.length(first) + 1, F.length(output))
        return let(whole, lambda w: split(w, second, lambda x, rest: split(rest, mid, lambda y, z: F.concat(x, z, y) if psm else F.concat(y, z, x))))

    return F.when(form == "psm", joined(pre, suf, True)).when(form == "spm", joined(suf, pre, False)).otherwise(output)
