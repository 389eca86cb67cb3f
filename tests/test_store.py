"""Stores by manifest: shared files, touched buckets, crashes, compaction, old versions, upserts that read few files."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F
from test_events import DAY, INCOMING, comparable, events, random_rows, row

from almanac.functions import links
from almanac.operators import resolve
from almanac.plans import pipeline
from almanac.sources import store as stores
from almanac.sources.store import EventStore


def keyed(df):
    return df.withColumn("id", links.event_id(F.col("title"), F.col("date_start"), F.col("url")))


def shown(df):
    return sorted(tuple(map(str, r)) for r in df.select("title", "date_start", "date_end", "location").collect())


def files(store, version=None):
    return {f for x in store.manifest(version).values() for f in x["files"]}


def test_versions_share_files_and_old_ones_go(spark, tmp_path):
    store = EventStore(spark, str(tmp_path))
    assert store.versions() == [] and store.read().count() == 0 and store.expire() == 0
    rows = [row(f"Lesung {d}", date(2026, 9, 1 + d % 28), date(2026, 10, d % 9 + 1) if d % 4 == 0 else None) for d in range(60)] + [row("ohne Tag", None)]
    store.write(events(spark, rows))
    first = files(store)
    assert store.read().count() == 61 and sum(x["rows"] for x in store.manifest().values()) == 61
    batch = events(spark, [row("neu", date(2026, 9, 3)), row("spät", date(2027, 1, 1))])
    touched = store.touched(batch)
    assert len(touched) == 1 and stores.NO_DAY not in touched
    store.replace(touched, store.read(buckets=touched).unionByName(batch), "two")
    assert store.read().count() == 63 and len(files(store) & first) == len(first) - len({f for f in first if f not in files(store)}) > 0
    assert store.read(store.versions()[0]).count() == 61
    by_end = store.touched(events(spark, [row("x", date(2030, 1, 1), date(2026, 10, 1))]))
    assert by_end and all((date(2026, 10, 1) - date(1970, 1, 1)).days in store.manifest()[b]["ends"] for b in by_end)
    for i in range(5):
        store.replace([], events(spark, [row(f"mehr {i}", date(2026, 9, 3))]), "more")
    many = max(len(x["files"]) for x in store.manifest().values())
    assert many >= 6 and store.compact(3) and max(len(x["files"]) for x in store.manifest().values()) <= 3 and store.compact(3) is None
    assert store.read().count() == 68
    assert store.expire(2) > 0 and len(store.versions()) == 2 and store.read().count() == 68 and store.read(store.versions()[0]).count() == 68


def test_crashes_and_two_writers(spark, tmp_path, monkeypatch):
    store = EventStore(spark, str(tmp_path))
    store.write(events(spark, [row("a")]))
    spark.conf.set("spark.hadoop.mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    with monkeypatch.context() as m:
        m.setattr(EventStore, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.write(events(spark, [row("b")]))
    assert [r.title for r in store.read().collect()] == ["a"]
    other = EventStore(spark, str(tmp_path))
    with monkeypatch.context() as m:
        m.setattr(other, "versions", lambda: [])  # it has not seen the first version
        with pytest.raises(OSError):
            other.write(events(spark, [row("c")]))
    assert [r.title for r in store.read().collect()] == ["a"] and len(store.versions()) == 1


def test_upsert_of_touched_buckets_is_the_upsert_of_all(spark, tmp_path):
    rng = random.Random(12)
    df = keyed(events(spark, random_rows(rng, 160)))
    old = df.where("ordinal < 110").dropDuplicates(["id"])
    store = EventStore(spark, str(tmp_path), days=1)
    store.write(old)
    for low, high, most in ((110, 113, 6),):
        new = df.where(f"ordinal >= {low} AND ordinal < {high}")
        want = comparable(r.asDict() for r in resolve.upsert(store.read(), new, DAY).collect())
        touched = store.touched(new)
        part = resolve.upsert(store.read(buckets=touched), new, DAY)
        rest = store.read(buckets=set(store.manifest()) - touched).withColumns({"n_new": F.lit(0), "n_updated": F.lit(0)})
        assert comparable(r.asDict() for r in part.unionByName(rest).collect()) == want and len(touched) <= most


def test_incremental_runs_read_few_files(spark, tmp_path):
    """Files that a run opens and writes grow with its batch, not with the store; buckets that are over go unread."""
    def incoming(rows):
        return spark.createDataFrame([(i, t, str(s), None, "", "", f"https://{t[-1]}.example/", "api") for i, (t, s) in enumerate(rows)], INCOMING)

    base = [(f"Führung Friedhof {k} {'abcdefgh'[k % 8]}", date(2026, 9 + k % 3, 1 + k % 28)) for k in range(84)]
    store = EventStore(spark, str(tmp_path), days=2)
    store.write(keyed(events(spark, [row(t, s, url=f"https://{t[-1]}.example/") for t, s in base])))
    before, batch = files(store), [("Lesung im Friedhof b", date(2026, 10, 10)), (base[3][0], base[3][1])]
    want = pipeline.run(store.read(), incoming(batch), date(2026, 8, 2))
    r = pipeline.run_incremental(store, incoming(batch), date(2026, 8, 2))
    assert len(store.manifest()) > 30 and shown(store.read()) == shown(want.store) and r.stats.first() == want.stats.first()
    assert len(before - files(store)) <= 2 and r.stats.first().neu == 1 and r.stats.first().aktualisiert == 1
    before, today = files(store), date(2026, 9, 20)
    r = pipeline.run_incremental(store, incoming([]), today)
    left = [t for t, s in [*base, batch[0]] if s >= today]
    assert sorted(x.title for x in store.read().collect()) == sorted(left) and len(files(store) - before) <= 1
    assert r.stats.first().entfernt == 85 - len(left)
