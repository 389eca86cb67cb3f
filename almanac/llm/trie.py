"""Radix tries over bytes in flat arrays, with a document count and source counters at each leaf; they can be merged.

A trie lies in depth-first order, which is the order of bytes, and so, for UTF-8, of code points. Of each leaf it
holds how many bytes of its path the leaf before it shares and the label of what follows: a node of the
radix tree is a place where that number falls below the length of the path before. No pointers are kept, so
building, merging and walking are a few passes over arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _bytes_of(terms: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes end to end, offsets) of terms."""
    offsets = np.frombuffer(terms.buffers()[1], dtype=np.int64)[terms.offset : terms.offset + len(terms) + 1]
    data = np.frombuffer(terms.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _terms_of(data: np.ndarray, offsets: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of data from start on, of these sizes, end to end."""
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)
    return data[at]


def shared_bytes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes each term of a list has in common with the one before; the first has none."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros(n, dtype=np.int64)
    live, k = np.arange(1, n), 0
    while len(live):
        live = live[(size[live] > k) & (size[live - 1] > k)]
        live = live[data[offsets[live] + k] == data[offsets[live - 1] + k]]
        k += 1
        out[live] = k
    return out


@dataclass
class Trie:
    """shared, label: of each leaf. docs: documents with its term. first: where its counters begin in source
    and count, and last where they end."""

    shared: np.ndarray
    label: pa.LargeBinaryArray
    docs: np.ndarray
    first: np.ndarray
    source: np.ndarray
    count: np.ndarray

    def __len__(self) -> int:
        return len(self.docs)

    @classmethod
    def of(cls, terms: pa.LargeBinaryArray, docs: np.ndarray, first: np.ndarray, source: np.ndarray, count: np.ndarray) -> Trie:
        """terms: different ones in the order of bytes."""
        data, offsets = _bytes_of(terms)
        shared = shared_bytes(data, offsets)
        size = np.diff(offsets) - shared
        label = _terms_of(gathered(data, offsets[:-1] + shared, size), np.concatenate([[0], np.cumsum(size)]))
        return cls(shared, label, docs, first, source, count)

    def terms(self) -> pa.LargeBinaryArray:
        """The path of each leaf, by a walk in depth-first order."""
        data, offsets = _bytes_of(self.label)
        raw, path, out = data.tobytes(), b"", []
        for k, a, b in zip(self.shared.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            path = path[:k] + raw[a:b]
            out.append(path)
        return pa.array(out, pa.large_binary())

    def take(self, leaves: np.ndarray, terms: pa.LargeBinaryArray) -> Trie:
        """The trie of some leaves, in order; terms: of all."""
        size = np.diff(self.first)[leaves]
        at = gathered(np.arange(len(self.source)), self.first[leaves], size)
        return Trie.of(terms.take(pa.array(leaves)), self.docs[leaves], np.concatenate([[0], np.cumsum(size)]), self.source[at], self.count[at])

    def part(self, x: int, y: int, path: bytes) -> Trie:
        """The trie of the leaves from x up to y, of which the first has this path: slices, but for that one's label."""
        data, offsets = _bytes_of(self.label)
        shared, size = self.shared[x:y].copy(), np.diff(offsets[x : y + 1])
        shared[0], size[0] = 0, len(path)
        label = _terms_of(np.concatenate([np.frombuffer(path, dtype=np.uint8), data[offsets[x + 1] : offsets[y]]]), np.concatenate([[0], np.cumsum(size)]))
        a, b = int(self.first[x]), int(self.first[y])
        return Trie(shared, label, self.docs[x:y], self.first[x : y + 1] - a, self.source[a:b], self.count[a:b])


def merged(tries: list[tuple[Trie, list[str]]]) -> tuple[Trie, list[str], pa.LargeBinaryArray]:
    """(one trie of several, names of its sources in order of code points, its terms). Each trie comes with the
    names that its sources are numbers of. Leaves with one path become one, whose counters add up."""
    terms = pa.chunked_array([t.terms() for t, _ in tries], pa.large_binary()).combine_chunks()
    order, leaf = ranked(terms)
    docs = np.zeros(len(order), dtype=np.int64)
    np.add.at(docs, leaf, np.concatenate([t.docs for t, _ in tries]))
    names = sorted({n for _, own in tries for n in own})
    number = {n: i for i, n in enumerate(names)}
    source = np.concatenate([np.array([number[n] for n in own], dtype=np.int64)[t.source] for t, own in tries])
    owner = np.repeat(leaf, np.concatenate([np.diff(t.first) for t, _ in tries]))
    key, at = np.unique(owner * max(1, len(names)) + source, return_inverse=True)
    count = np.zeros(len(key), dtype=np.int64)
    np.add.at(count, at, np.concatenate([t.count for t, _ in tries]))
    owner, source = np.divmod(key, max(1, len(names)))
    first = np.searchsorted(owner, np.arange(len(order) + 1))
    paths = terms.take(pa.array(order))
    return Trie.of(paths, docs, first, source, count), names, paths


def ranked(terms: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the different terms, in the order of bytes; the number of each term in that order)."""
    coded = terms.dictionary_encode()
    code = coded.indices.to_numpy()
    place = np.zeros(len(coded.dictionary), dtype=np.int64)
    place[code[::-1]] = np.arange(len(code))[::-1]
    by = pc.array_sort_indices(coded.dictionary).to_numpy().astype(np.int64)
    rank = np.empty(len(by), dtype=np.int64)
    rank[by] = np.arange(len(by))
    return place[by], rank[code]
