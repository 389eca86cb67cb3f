"""Facets from an index of bitmaps: choices and counts without a scan of the events.

The index has a bitmap of rows for each region, kind, first day and last day, in buckets of 32,768 rows. A window of days
is what starts by its end and does not end before today, two unions of day bitmaps; a facet's count is the
size of an intersection, bucket by bucket. New rows come as an index of their own, merged by union.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.dates import effective_end
from almanac.operators.present import WINDOWS

DIMS = ("region", "kind")


def build(events: DataFrame, row: str = "ordinal") -> DataFrame:
    """(dim, value, bucket, bits) of events with region, kind and days. row: a column of different numbers from 0 on. Rows
    with a null in a dimension have no bit there; tasks make bitmaps before they shuffle."""
    value = lambda dim, c: F.struct(F.lit(dim).alias("dim"), c.cast("string").alias("value"))
    each = F.array(*[value(d, F.col(d)) for d in DIMS], value("start", F.col("date_start")), value("end", effective_end()), value("all", F.lit("")))
    n = F.col(row) + 1  # bitmaps count from 1
    rows = events.select(F.explode(each).alias("x"), F.bitmap_bucket_number(n).alias("bucket"), F.bitmap_bit_position(n).alias("bit")).where("x.value IS NOT NULL")
    return rows.groupBy("x.dim", "x.value", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def union(*indexes: DataFrame) -> DataFrame:
    """One index of several, whose rows may lie in common buckets."""
    out = indexes[0]
    for x in indexes[1:]:
        out = out.unionByName(x)
    return out.groupBy("dim", "value", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def matching(events: DataFrame, condition: Column, row: str = "ordinal") -> DataFrame:
    """(bucket, bits) of the events that a condition, such as a search in their texts, lets pass."""
    n = F.col(row) + 1
    return events.where(condition).select(F.bitmap_bucket_number(n).alias("bucket"), F.bitmap_bit_position(n).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def facets(index: DataFrame, today: date, region: str = "", kind: str = "", days: int = 0, found: DataFrame | None = None) -> DataFrame:
    """(dim, value, n) as present.facets() has them, for values that occur. found: (bucket, bits) of what a search lets pass,
    if there is one. The index is read twice: for the unions of each bucket, and for what is met with them."""
    if found is not None:
        index = index.unionByName(found.select(F.lit("search").alias("dim"), F.lit("").alias("value"), "bucket", "bits"))
    is_ = lambda dim, cond: F.bitmap_or_agg(F.when((F.col("dim") == dim) & cond, F.col("bits")))
    until = {f"from{d}": is_("start", F.col("value") <= str(today + timedelta(days=d))) for d in {*WINDOWS, days}}
    sets = {"region": is_("region", F.col("value") == region), "kind": is_("kind", F.col("value") == kind), "search": is_("search", F.lit(True)), "until": is_("end", F.col("value") >= str(today)), **until}
    unions = index.groupBy("bucket").agg(*[c.alias(f"_{k}") for k, c in sets.items()])
    chosen = {"region": ["_region"] if region else [], "kind": ["_kind"] if kind else [], "time": [f"_from{days}", "_until"] if days else [], "search": ["_search"] if found is not None else []}
    others = lambda dim: [F.col(c) for d, cs in chosen.items() if d != dim for c in cs]
    own = index.where(F.col("dim").isin(*DIMS)).join(unions, "bucket")
    cells = [own.where(F.col("dim") == d).select("dim", "value", "bucket", F.array("bits", *others(d)).alias("sets")) for d in DIMS]
    times = F.array(*[F.struct(F.lit("time").alias("dim"), F.lit(str(d)).alias("value"), F.array(F.col(f"_from{d}"), F.col("_until"), *others("time")).alias("sets")) for d in WINDOWS])
    cells.append(unions.select("bucket", F.explode(times).alias("x")).select("x.dim", "x.value", "bucket", "x.sets"))
    every = cells[0].unionByName(cells[1]).unionByName(cells[2])
    met = every.select("dim", "value", "bucket", F.explode("sets").alias("bits")).groupBy("dim", "value", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"))
    none = index.sparkSession.createDataFrame([("time", str(d), 0) for d in WINDOWS], "dim string, value string, n long")
    return met.select("dim", "value", "n").unionByName(none).groupBy("dim", "value").agg(F.sum("n").cast("long").alias("n"))
