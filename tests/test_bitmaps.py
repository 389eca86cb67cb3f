"""Facets by bitmaps against the scan."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from almanac.operators import bitmaps, present

TODAY = date(2026, 9, 13)


def test_bitmap_facets_are_those_of_the_scan(spark):
    rng = random.Random(1)
    day = lambda: TODAY + timedelta(days=rng.randint(-40, 120))
    rows = [(rng.choice([i, 40_000 + i, 3 * 32_768 - i]), f"Titel {i % 7}", "", "Ort", rng.choice(["nord", "süd", "ost"]), rng.choice(["lesung", "konzert"]), day()) for i in range(500)]
    rows = [(*r, r[-1] + timedelta(days=rng.randint(0, 50)) if rng.random() < 0.4 else None) for r in {x[0]: x for x in rows}.values()]
    events = spark.createDataFrame(rows, "ordinal long, title string, description string, location string, region string, kind string, date_start date, date_end date").repartition(4)
    index = bitmaps.union(*[bitmaps.build(events.where(F.col("ordinal") % 3 == k)) for k in range(3)])
    shown = lambda df: sorted(tuple(r) for r in df.collect())
    for choice in ({}, {"region": "nord", "kind": "lesung", "days": 30}, {"days": 7, "search": "titel 3"}, {"region": "keine"}):
        found = bitmaps.matching(events, present.predicates(TODAY, search=choice["search"])["search"]) if "search" in choice else None
        got = shown(bitmaps.facets(index, TODAY, **{k: v for k, v in choice.items() if k != "search"}, found=found))
        want = {(r.dim, r.value): r.n for r in present.facets(events, TODAY, **choice).collect()}
        want |= {("time", str(d)): want.get(("time", str(d)), 0) for d in present.WINDOWS}
        assert got == sorted((*k, n) for k, n in want.items())
    none = bitmaps.facets(bitmaps.build(events.where("false")), TODAY, "nord")
    assert shown(none) == [("time", "30", 0), ("time", "7", 0), ("time", "90", 0)]
