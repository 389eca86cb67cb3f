"""Packing pages into batches, and choosing pages within a budget of requests.

First-fit by falling hits needs only how many pages have how many hits: pages of equal hits fill batches one after
another, so whole runs of like batches are filled at a time. The driver plans on that histogram; pages,
however many, find their places by their rank in a distributed sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.links import rotation_key
from almanac.operators.tables import drop, materialize
from almanac.settings import BATCH_SIZE, MAX_HITS_PER_BATCH, MAX_REQUESTS

#: Different numbers of hits, at most; pages are capped at far fewer.
MOST_VALUES = 10_000
#: Pages that the driver reads at a time while it fills a budget.
WINDOW = 1000

Segment = tuple[int, int, int, int, int, int]


def first_fit(histogram: dict[int, int], size: int = BATCH_SIZE, most: int = MAX_HITS_PER_BATCH) -> tuple[list[Segment], int]:
    """(segments, batches) of first-fit: pages by falling hits, each into the first batch with room for it.

    histogram: {hits: pages}. A segment (hits, lo, hi, batch, per, pos) puts the pages of rank lo to hi among those of
    equal hits into batches from `batch` on, `per` in each, after the pos pages that it has.
    """
    runs: list[tuple[int, int, int]] = []  # batches side by side with equally many pages and hits
    out: list[Segment] = []
    for hits, pages in sorted(histogram.items(), reverse=True):
        rank, at, new = 0, 0, []
        for n, k, s in [*runs, (pages, 0, 0)]:
            is_new = at == sum(r[0] for r in runs)
            room = size - k if hits == 0 else min(size - k, (most - s) // hits)
            room = max(1, room) if is_new else room  # a page beyond all bounds has a batch of its own
            full = min(n, (pages - rank) // room) if room > 0 else 0
            part = pages - rank - full * room if 0 < room and full < n else 0
            if full:
                out.append((hits, rank, rank + full * room, at, room, k))
                new.append((full, k + room, s + room * hits))
            if part:
                out.append((hits, rank + full * room, pages, at + full, room, k))
                new.append((1, k + part, s + part * hits))
            left = n - full - (part > 0)
            if left and not is_new:
                new.append((left, k, s))
            rank += full * room + part
            at += n
        runs = new
    return out, sum(r[0] for r in runs)


def within_budget(pages: DataFrame, histogram: dict[int, int], period: Column, most: int) -> list[tuple[str, int]]:
    """(rotation key, ordinal) of the pages to take: in the period's rotation order, each that still fits
    with those taken before. most * BATCH_SIZE at most.

    Whether a page fits depends on its hits and on those taken, so the driver reads only pages whose hits fit, a
    window at a time, and stops where none would.
    """
    taken: dict[int, int] = {}
    kept: list[tuple[str, int]] = []
    order = pages.select(rotation_key(F.col("url"), period).alias("key"), "ordinal", "hits")
    order = materialize(order, "rotation")

    def fitting() -> set[int]:
        return {h for h in histogram if first_fit({**taken, h: taken.get(h, 0) + 1})[1] <= most}

    fits, seen = fitting(), None
    while fits:
        asked = fits
        rows = order.where(F.col("hits").isin(sorted(asked)))
        if seen:
            rows = rows.where(F.struct("key", "ordinal") > F.struct(F.lit(seen[0]), F.lit(seen[1]).cast("long")))
        got = rows.orderBy("key", "ordinal").limit(WINDOW).collect()
        for r in got:
            seen = (r.key, r.ordinal)
            if r.hits in fits:
                kept.append(seen)
                taken[r.hits] = taken.get(r.hits, 0) + 1
                fits = fitting()
                if not fits <= asked:  # pages that were not read could fit from here on
                    break
        if len(got) < WINDOW and fits <= asked:
            break
    drop(order)
    return kept


def ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows, written, with rank from 0 in the given order, by a distributed sort and the sizes of its partitions."""
    out = materialize(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_m", 33).cast("int")
    sizes = sorted((r["p"], r["count"]) for r in out.groupBy(part.alias("p")).count().collect())
    before = list(accumulate((n for _, n in sizes), initial=0))
    table = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "_p int, _b long")
    rank = F.col("_b") + F.col("_m").bitwiseAND((1 << 33) - 1)
    return out.join(F.broadcast(table), part == F.col("_p")).withColumn("rank", rank).drop("_m", "_p", "_b")


def histogram_of(pages: DataFrame) -> dict[int, int]:
    rows = pages.groupBy("hits").count().limit(MOST_VALUES + 1).collect()
    if len(rows) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} different numbers of hits")
    return {r["hits"]: r["count"] for r in rows}


def _place(pages: DataFrame, histogram: dict[int, int], order: Sequence[Column | str]) -> DataFrame:
    """pages with batch_id and pos by first-fit, pages of equal hits in the given order."""
    spark = pages.sparkSession
    values = sorted(histogram, reverse=True)
    start = dict(zip(values, accumulate((histogram[h] for h in values), initial=0)))
    plan = [(h, start[h] + lo, start[h] + hi, batch, per, pos) for h, lo, hi, batch, per, pos in first_fit(histogram)[0]]
    table = spark.createDataFrame(plan, "_h int, _lo long, _hi long, _batch long, _per long, _pos long")
    at = F.col("rank") - F.col("_lo")
    rows = ranked(pages, F.desc("hits"), *order).join(F.broadcast(table), (F.col("hits") == F.col("_h")) & (F.col("rank") >= F.col("_lo")) & (F.col("rank") < F.col("_hi")))
    batch = (F.col("_batch") + F.floor(at / F.col("_per"))).cast("int")
    return rows.withColumns({"batch_id": batch, "pos": (F.col("_pos") + at % F.col("_per") + 1).cast("int")}).drop("rank", "_h", "_lo", "_hi", "_batch", "_per", "_pos")


def plan_batches(pages: DataFrame, period: int, most: int = MAX_REQUESTS) -> DataFrame:
    """pages (ordinal, url, hits, ...) with batch_id and pos from 1; both null for pages that are put off.

    All pages are packed in their order if that takes `most` batches or fewer, else those that
    within_budget() takes, in rotation order. Ordinals are unique; an empty table gives an empty result.
    """
    histogram = histogram_of(pages)
    if first_fit(histogram)[1] <= most:
        return _place(pages, histogram, ["ordinal"])
    kept = within_budget(pages, histogram, F.lit(period), most)
    table = pages.sparkSession.createDataFrame(kept, "_key string, ordinal long")
    taken = pages.join(F.broadcast(table), "ordinal")
    placed = _place(taken.select("ordinal", "hits", "_key"), histogram_of(taken), ["_key", "ordinal"]).select("ordinal", "batch_id", "pos")
    return pages.join(F.broadcast(placed), "ordinal", "left")
