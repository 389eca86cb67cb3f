"""Source divergence audit: how far the sources of a language differ in their terms, and in which."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import bounded_batches, drop, join_small, materialize
from almanac.llm.trie import Trie, gathered, merged, ranked

#: What a byte of a term counts as, 0 if it is of none: ASCII letters and all that is not ASCII, A-Z in lower case.
LETTER = np.zeros(256, dtype=np.uint8)
LETTER[ord("a") : ord("z") + 1] = LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
LETTER[128:] = np.arange(128, 256)
#: Probabilities are whole numbers of so many parts, made three digits at a time so that products fit in 64 bits.
PARTS = 1_000_000_000


@dataclass(frozen=True)
class Audit:
    """least: documents of a language that a kept term is in. prior: added to each count. top: ranks of terms.
    lot: bytes of texts whose terms a partition counts at a time. page: leaves of a piece of a trie. mark: leaves
    from one to the next of its paths that are told. range_mb: of pages that are merged in a task, about. part: kept terms, about, and block: sources that are compared in
    a task. step: terms that are compared at a time."""

    least: int = 30
    prior: int = 5
    top: int = 50
    lot: int = 8 << 20
    page: int = 2048
    mark: int = 128
    range_mb: float = 8.0
    part: int = 16_384
    block: int = 256
    step: int = 1024


#: Encoded bytes of a row group of pages, about. Spark's reader holds up to 4,096 rows of one, however long, with several times these bytes.
PAGE_GROUP = 2 << 20
PIECE = "lang string, shared array<int>, label binary, ends array<long>, docs array<long>, first array<int>, source array<int>, count array<long>, names array<string>"
PAGE = f"{PIECE}, high string, marks array<string>, weight long"
LEAVES = "lang string, term string, total long, sources array<string>, counts array<long>"


def found_terms(data: np.ndarray, ends: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """(the terms of texts laid end to end in data, the text of each)."""
    low = LETTER[data]
    inside = low > 0
    cut = np.zeros(len(data) + 1, dtype=bool)  # a text ends before such a byte
    cut[ends] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | cut[1:-1]
    closes[:-1] &= ~inside[1:] | cut[1:-1]
    start = np.flatnonzero(opens)
    offsets = np.append(0, np.cumsum(np.flatnonzero(closes) + 1 - start))
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(low[inside])])
    return terms, np.searchsorted(ends, start, side="right")


def counted(terms: pa.LargeBinaryArray, doc: np.ndarray, source: np.ndarray) -> tuple[Trie, pa.LargeBinaryArray]:
    """The trie of terms and its paths, from the number of the document, ascending, and of the source of each term."""
    order, leaf = ranked(terms)
    n_docs, n_sources = int(doc.max(initial=0)) + 1, int(source.max(initial=0)) + 1
    key, uses = np.unique((leaf * n_sources + source) * n_docs + doc, return_counts=True)
    entry, first = np.unique(key // n_docs, return_index=True)
    count, docs_in = np.add.reduceat(uses, first) if len(first) else uses, np.diff(np.append(first, len(key)))
    owner, who = np.divmod(entry, n_sources)
    bounds = np.searchsorted(owner, np.arange(len(order) + 1))
    docs = np.add.reduceat(docs_in, bounds[:-1]) if len(order) else docs_in
    paths = terms.take(pa.array(order))
    return Trie.of(paths, docs.astype(np.int64), bounds, who, count.astype(np.int64)), paths


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _pages(lang: str, trie: Trie, paths: pa.LargeBinaryArray, names: list[str], p: Audit) -> Iterator[pa.RecordBatch]:
    """A trie cut to pages, each a trie of its own."""
    for at in range(0, len(trie), p.page):
        own = paths[at : at + p.page]
        piece = _piece(lang, trie.take(np.arange(at, at + len(own)), paths), names)
        high, marks = own[-1:].cast(pa.binary()).cast(pa.string()), own[:: p.mark].cast(pa.binary()).cast(pa.string())
        marks = pa.ListArray.from_arrays(pa.array([0, len(marks)], pa.int32()), marks)
        weight = pa.array([16 * len(own) + 12 * len(piece["count"].values) + len(piece["label"][0].as_py())], pa.int64())
        yield pa.RecordBatch.from_arrays([*piece.columns, high, marks, weight], names=[x.split()[0] for x in PAGE.split(", ")])


def _piece(lang: str, t: Trie, names: list[str]) -> pa.RecordBatch:
    used, source = np.unique(t.source, return_inverse=True)
    ends = np.frombuffer(t.label.buffers()[1], dtype=np.int64)[: len(t) + 1]
    one = lambda values, kind: _lists(values, np.array([0, len(values)]), kind)
    arrays = [
        pa.array([lang]), one(t.shared, pa.int32()), pa.array([t.label.buffers()[2].to_pybytes()[: int(ends[-1])]], pa.binary()), one(ends, pa.int64()),
        one(t.docs, pa.int64()), one(t.first, pa.int32()), one(source, pa.int32()), one(t.count, pa.int64()), one(np.array(names, dtype=object)[used], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in PIECE.split(", ")])


def _tries(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[str, Trie, list[str]]]:
    """(language, trie, names of its sources) of each page."""
    of = {c: table.column(c) for c in table.schema.names}
    for i in range(table.num_rows):
        numbers = lambda c: of[c][i].values.to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
        ends = numbers("ends")
        label = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(of["label"][i].as_py())])
        yield of["lang"][i].as_py(), Trie(numbers("shared"), label, numbers("docs"), numbers("first"), numbers("source"), numbers("count")), of["names"][i].as_py()


def _count(p: Audit):
    """Batches of (lang, source, text) to pages of byte tries."""

    def lot(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        by = pc.sort_indices(rows, [("lang", "ascending")])
        rows = rows.take(by).combine_chunks()
        text = rows.column("text").cast(pa.large_binary()).combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
        coded = [rows.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source")]
        coded = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in coded]
        (lang, langs), (source, sources) = [(c.indices.to_numpy(), c.dictionary.to_pylist()) for c in coded]
        for i, name in enumerate(langs):
            a, b = np.searchsorted(lang, [i, i + 1])
            terms, doc = found_terms(data[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a])
            if len(terms):
                own, number = np.unique(source[a:b], return_inverse=True)
                trie, paths = counted(terms, doc, number[doc])
                yield from _pages(name, trie, paths, [sources[x] for x in own], p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(2).nbytes
            if size >= p.lot:
                yield from lot(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from lot(pa.Table.from_batches(held))

    return run


def _first_from(trie: Trie, marks: list[bytes], step: int, cut: bytes) -> tuple[int, bytes]:
    """(number, path) of a trie's first leaf that is not before cut; marks: the path of each step-th leaf. One is before cut, and one is not."""
    k = bisect_left(marks, cut)
    at, path = (k - 1) * step, marks[k - 1]
    last = min(len(trie), k * step + 1)
    labels = trie.label[at:last].to_pylist()
    for i, (same, label) in enumerate(zip(trie.shared[at:last].tolist(), labels)):
        path = path[:same] + label if i else path
        if path >= cut:
            return at + i, path
    raise ValueError("no leaf from the cut on")


def _cut(cuts: list[tuple[str, bytes]], p: Audit):
    """Pages to pieces that lie in one range each, with the number of that range; cuts: the first paths of ranges 1, 2, ...

    Only the leaves between two marks are walked for a cut, and arrays are sliced, so that a page costs little
    however many ranges it is cut to."""
    names = [x.split()[0] for x in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, highs = batch.column("lang").to_pylist(), batch.column("high").cast(pa.binary()).to_pylist()
            marks = [[m.encode() for m in x] for x in batch.column("marks").to_pylist()]
            pieces = batch.select(names)
            ends = [(bisect_right(cuts, (lg, a[0])), bisect_right(cuts, (lg, b))) for lg, a, b in zip(langs, marks, highs)]
            whole = [i for i, (a, b) in enumerate(ends) if a == b]
            some = pieces.take(pa.array(whole, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array([ends[i][0] for i in whole], pa.int32())], names=[*names, "range"])
            for i, (a, b) in enumerate(ends):
                if a < b:
                    lang, trie, sources = next(_tries(pieces.slice(i, 1)))
                    at = [(0, marks[i][0]), *[_first_from(trie, marks[i], p.mark, c) for _, c in cuts[a:b]], (len(trie), b"")]
                    for k, ((x, path), (y, _)) in enumerate(zip(at, at[1:])):
                        if x < y:
                            piece = _piece(lang, trie.part(x, y, path), sources)
                            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array([a + k], pa.int32())], names=[*names, "range"])

    return run


def _merge(least: int):
    """The pages of a range to the leaves of the merged tries that are in enough documents."""

    def run(pages: pa.Table) -> pa.Table:
        tries: dict[str, list] = {}
        for lang, trie, names in _tries(pages):
            tries.setdefault(lang, []).append((trie, names))
        out = []
        for lang, some in sorted(tries.items()):
            trie, names, paths = merged(some)
            keep = np.flatnonzero(trie.docs >= least)
            size = np.diff(trie.first)[keep]
            at = gathered(np.arange(len(trie.source)), trie.first[keep], size)
            ends = np.concatenate([[0], np.cumsum(size)])
            count = trie.count[at]
            total = np.add.reduceat(count, ends[:-1]) if len(keep) else count
            term = paths.take(pa.array(keep)).cast(pa.binary()).cast(pa.string())
            sources = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()).take(pa.array(trie.source[at])))
            out.append(pa.table([pa.array([lang] * len(keep), pa.string()), term, pa.array(total), sources, _lists(count, ends, pa.int64())], names=[x.split()[0] for x in LEAVES.split(", ")]))
        return pa.concat_tables(out)

    return run


def term_leaves(docs: DataFrame, p: Audit, lang: Column, source: Column, text: Column) -> DataFrame:
    """(range, lang, term, total, sources, counts) of the kept terms, one row each, written.

    The bounds of ranges are found by a distributed range partitioning of the pages' marks, of which each stands for as many
    leaves, so that no range grows with the number of tries that begin alike; the driver gets one path for each range."""
    bounded_batches(docs.sparkSession)
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text"))
    pages = materialize(rows.mapInArrow(_count(p), PAGE), "term-pages", **{"parquet.block.size": PAGE_GROUP})
    n = max(1, round((pages.agg(F.sum("weight")).first()[0] or 0) / (p.range_mb * 1e6)))
    bounds = pages.select("lang", F.explode("marks").alias("low")).repartitionByRange(n, "lang", "low").groupBy(F.spark_partition_id()).agg(F.min(F.struct("lang", "low")).alias("m"))
    cuts = sorted((r.m.lang.encode(), r.m.low.encode()) for r in bounds.collect())[1:]
    placed = pages.mapInArrow(_cut([(a.decode(), b) for a, b in cuts], p), PIECE + ", range int")
    kept = placed.groupBy("range").applyInArrow(lambda key, t: _with_range(key, _merge(p.least)(t)), "range int, " + LEAVES)
    kept = materialize(kept, "kept-terms")
    drop(pages)
    return kept


def _with_range(key, leaves: pa.Table) -> pa.Table:
    return leaves.add_column(0, "range", pa.array([key[0].as_py()] * leaves.num_rows, pa.int32()))


def parts_of(count: np.ndarray, total: np.ndarray, prior: int, terms: int) -> np.ndarray:
    """1 + floor(PARTS * (count + prior) / (total + prior * terms)), exact for totals below 9 * 10**15."""
    whole = total + prior * terms
    left, out = count + prior, np.zeros(np.broadcast(count, total).shape, dtype=np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // whole
        left = left % whole
    return out + 1


def _compare(p: Audit):
    """One language, one pair of blocks of sources, one part of the terms, to (part, lang, source, item, value)
    rows. pair: by how much what these terms add differs from what absent terms would add, or, for part -1,
    what all terms would add if absent. term: the best of these terms for each source."""

    def run(leaves: pa.Table, totals: pa.Table) -> pa.Table:
        out: list[tuple[str, str, str, str, int]] = []
        if totals.num_rows:
            totals = totals.sort_by("source")
            sources = totals.column("source").combine_chunks()
            names, block = sources.to_pylist(), totals.column("block").to_numpy()
            n = totals.column("n").to_numpy()[:, None]
            lang, v, n_lang, a, b, part = (totals.column(c)[0].as_py() for c in ("lang", "v", "n_lang", "a", "b", "part"))
            first, second = np.flatnonzero(block == a), np.flatnonzero(block == b)
            zero = parts_of(np.zeros_like(n), n, p.prior, v) if v else np.zeros_like(n)
            gap = np.abs(zero[first] - zero[second].T)
            sums = gap * v if part < 0 else np.zeros_like(gap)
            best = [(np.zeros(0, np.int64), np.zeros(0, object))] * len(names)
            leaves = leaves.sort_by("term")
            for at in range(0, leaves.num_rows, p.step):
                some = leaves.slice(at, p.step).combine_chunks()
                terms = some.num_rows
                lists = [some.column(c).combine_chunks() for c in ("sources", "counts")]
                who = pc.index_in(lists[0].flatten(), value_set=sources).to_numpy(zero_copy_only=False)
                term = np.repeat(np.arange(terms), pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False))
                count = np.zeros((len(names), terms), dtype=np.int64)
                count[who, term] = lists[1].flatten().to_numpy()
                prob = parts_of(count, n, p.prior, v)
                for i, x in enumerate(first):
                    sums[i] += np.abs(prob[second] - prob[x]).sum(axis=1) - terms * gap[i]
                if a == b:
                    q = parts_of(some.column("total").to_numpy(), np.int64(n_lang), p.prior, v)
                    item = np.array(some.column("term").to_pylist(), dtype=object)
                    for i in range(len(names)):
                        hit = np.flatnonzero((count[i] > 0) & (prob[i] > q))
                        value, what = np.append(best[i][0], prob[i][hit] - q[hit]), np.append(best[i][1], item[hit])
                        top = np.argsort(-value, kind="stable")[: p.top]  # terms come in order, so equal ones keep theirs
                        best[i] = value[top], what[top]
            for i, x in enumerate(first):
                out += [("pair", lang, names[x], names[y], int(sums[i, j])) for j, y in enumerate(second) if a != b or x < y]
            for name, (value, what) in zip(names, best):
                out += [("term", lang, name, t, int(f)) for t, f in zip(what, value)]
        cols = list(zip(*out)) or [[]] * 5
        return pa.table({c: pa.array(x, pa.int64() if c == "value" else pa.string()) for c, x in zip(("part", "lang", "source", "item", "value"), cols)})

    return run


def audit(docs: DataFrame, p: Audit = Audit(), lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) of each source of each language.

    Part pair: each other source of the language, by the sum over the language's kept terms of the absolute
    difference of both sources' parts. Part term: the p.top kept terms that the source has more often
    than the language, by that difference. Values fall with rank; equal ones go by bytes of item.

    Partitions count terms in tries, which are cut to pages and merged by ranges of prefixes; only terms in
    p.least documents of their language are kept. Sources are dealt to blocks of about p.block by a
    hash, and each task compares two blocks over one part of the terms, so none holds a whole language or
    all sources; sums and best terms of the parts meet in aggregations.

    Null texts, languages and sources count as empty; empty texts have no term but their source is
    compared. Repeated rows count each. A language without kept terms has pairs of value 0. Terms
    and texts may be of any length. An empty table gives an empty result. Other columns are not read.
    """
    kept = term_leaves(docs, p, F.col(lang_col), F.col(source_col), F.col(text_col))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source")).distinct()
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups = materialize(named.join(each, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "source-totals")
    sums = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    langs = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / p.block).cast("int").alias("blocks"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    langs = materialize(langs.join(sums, "lang", "left").select(F.col("lang").alias("_lang"), "blocks", zero("v"), zero("n_lang")), "lang-totals")
    block = lambda s: F.pmod(F.xxhash64(s), F.col("blocks")).cast("int")
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    tiles = lambda own: F.array_distinct(F.flatten(F.transform(own, lambda x: F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: pair(x, y)))))
    same = F.col("lang") == F.col("_lang")
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("range"))
    parts = kept.groupBy("lang", "range").agg(F.count(F.lit(1)).alias("n"))
    parts = materialize(parts.select(F.col("lang").alias("_l"), F.col("range").alias("_r"), F.floor((upto - 1) / p.part).cast("int").alias("part")), "term-parts")
    told = join_small(kept, parts, (F.col("lang") == F.col("_l")) & (F.col("range") == F.col("_r")), by=F.col("term"))
    told = join_small(told.select("lang", "term", "total", "sources", "counts", "part"), langs, same, by=F.col("term"))
    told = told.withColumn("t", F.explode(tiles(F.array_distinct(F.transform("sources", block)))))
    inside = F.filter(F.arrays_zip("sources", "counts"), lambda x: (block(x["sources"]) == F.col("t.a")) | (block(x["sources"]) == F.col("t.b")))
    told = told.select("lang", F.col("t.a").alias("a"), F.col("t.b").alias("b"), "part", "term", "total", inside.alias("x"))
    told = told.select("lang", "a", "b", "part", "term", "total", F.col("x.sources").alias("sources"), F.col("x.counts").alias("counts"))
    every = parts.select(F.col("_l").alias("lang"), F.col("part").alias("part")).distinct().union(langs.select("_lang", F.lit(-1)))
    sides = join_small(groups, langs, same, by=F.col("source")).withColumn("block", block(F.col("source")))
    sides = sides.withColumn("t", F.explode(tiles(F.array("block")))).drop("_lang").join(every.hint("merge"), "lang")
    sides = sides.select("lang", F.col("t.a").alias("a"), F.col("t.b").alias("b"), "part", "source", "block", "n", "v", "n_lang")
    keys = ["lang", "a", "b", "part"]
    found = told.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(_compare(p), "part string, lang string, source string, item string, value long")
    found = materialize(found, "audit")
    one = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = one.unionByName(one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(best)
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    terms = found.where("part = 'term'").select("lang", "source", F.lit("term").alias("part"), "item", "value", rank.alias("rank")).where(F.col("rank") <= p.top)
    return pairs.unionByName(terms)
