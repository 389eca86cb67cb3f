"""Token counts by a count-only Viterbi over a unigram vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import bounded_batches

#: What a space and the begin of a text become.
MARK = "▁"
#: An unknown character scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece model file, by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    """Counts the pieces of the best segmentation under a unigram model with byte fallback.

    A text is MARK plus its characters, spaces written as MARK, cut before every MARK; each part
    is segmented by itself, as the tokenizers library's Metaspace and Unigram do. The
    Aho-Corasick automaton gives every piece that ends at a place, the longest first. Of equal
    scores the one with the earliest start, the longest last piece, stays. A character that no piece
    covers alone may stand as unknown; it counts a piece for each of its bytes.

    Counts of `keep` parts of up to `longest` characters are kept; longer ones, such as a text
    without spaces, are counted each time.
    """

    def __init__(self, vocabulary: list[tuple[str, float]], keep: int = 500_000, longest: int = 64):
        self.auto = ahocorasick.Automaton()
        self.single: set[str] = set()
        for piece, score in vocabulary:
            if piece:
                self.auto.add_word(piece, (len(piece), score))
                if len(piece) == 1:
                    self.single.add(piece)
        self.auto.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.keep, self.counts, self.longest, self.reach = keep, {}, longest, max((len(w) for w, _ in vocabulary), default=1)

    def part(self, word: str) -> int:
        """Pieces of one part. Scores and counts are kept for the last `reach` places alone, as no
        piece is longer, so memory does not grow with a part that has no space."""
        reach, single = self.reach + 1, self.single
        best: list[float | None] = [None] * reach
        pieces = [0] * reach
        best[0], done = 0.0, 0

        def step(e: int, matches: list[tuple[int, float]]) -> None:
            top, n = None, 0
            for size, score in sorted(matches, reverse=True):
                total = best[(e - size) % reach] + score
                if top is None or total > top:
                    top, n = total, pieces[(e - size) % reach] + 1
            c = word[e - 1]
            if c not in single:
                total = best[(e - 1) % reach] + self.unknown
                if top is None or total > top:
                    top, n = total, pieces[(e - 1) % reach] + len(c.encode("utf-8", "surrogatepass"))
            best[e % reach], pieces[e % reach] = top, n

        found: list[tuple[int, float]] = []
        for end, match in self.auto.iter(word):
            while done < end:  # places before this match's end are settled, the first by what was found there
                done += 1
                step(done, found)
                found = []
            found.append(match)
        while done < len(word):
            done += 1
            step(done, found)
            found = []
        return pieces[len(word) % reach]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, counts = 0, self.counts
        parts = text.replace(" ", MARK).split(MARK)
        if not parts[0]:
            parts = parts[1:]  # a text that starts with a space gets no mark in addition
        for w in parts:
            k = counts.get(w)
            if k is None:
                if len(counts) > self.keep:
                    counts.clear()
                k = self.part(MARK + w)
                if len(w) <= self.longest:
                    counts[w] = k
            total += k
        return total


@lru_cache(2)
def _counter(path: str) -> Counter:
    """One for each Python worker, which Spark uses for task after task."""
    return Counter(load_vocabulary(path))


def count_tokens(text: Column, path: str) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(path)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return run(text)


def token_counts(docs: DataFrame, path: str, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens of the whole text.

    Null and empty texts have none. Rows that repeat get equal counts. An empty table gives an
    empty result. Other columns are not read. Nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key_col).alias("doc_id"), count_tokens(F.col(text_col), path).alias("n_tokens"))
