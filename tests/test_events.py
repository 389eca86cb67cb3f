"""Event operators: golden cases, plain models, and independence of partitions."""

import hashlib
import random
import re
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from almanac.functions import classify, dates, links, text
from almanac.operators import budget, prepare, present, resolve
from almanac.plans import pipeline, queries
from almanac.schemas import EVENTS
from almanac.sources import calendars, store
from almanac.streaming.ingest import ingest_stream

DAY = date(2026, 9, 13)


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(str(v) if v is not None else None for v in values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    "s, want",
    [("2026-02-30, 3.3.2026", "2026-03-03"), ("am 3. März 2026", "2026-03-03"), ("1/2/26", "2026-02-01"), ("5. Foo 2026", None), ("", None), (None, None), ("31.12.2025", "2025-12-31"), ("3. Sept. 2026", "2026-09-03"), ("2026-9-3", "2026-09-03")],
)
def test_dates(spark, s, want):
    assert str(one(spark, dates.parse_date, s) or None) == str(want)


def test_calendar_dates(spark):
    for s, day, whole in [("20260913", DAY, True), ("20260913T180000", DAY, False), ("20260913T160000Z", DAY, False), ("20260231", None, False), ("x", None, False)]:
        got = one(spark, dates.calendar_date, s)
        assert (got.day, got.all_day) == (day, whole)


def test_cleaning_and_stems(spark):
    assert one(spark, text.clean, "  Führung – „Alt“ (neu)/\n x y ") == "führung alt neu x y"
    assert one(spark, text.stem, "sonntagsfuehrung") == one(spark, text.stem, "sonntagsfuehrungen")
    assert sorted(one(spark, text.tokens, "Die Führungen über den alten Friedhof")) == ["alten", "friedhof", "führung"]
    df = spark.createDataFrame([("Gr&auml;ber",), ("Gräber",), (None,)], "t string")
    assert [r.c for r in text.decode_entities(df, ["t"]).select(text.clean(F.col("t")).alias("c")).collect()].count("gräber") == 2


def test_topic_rules(spark):
    def verdict(title, location="", url="https://x.example/", description=None):
        r = one(spark, classify.topic_reason, title, description, location, url)
        return r.relevant, r.reason

    for t in ("Ausgrabung", "ausgegraben", "total", "Altes Testament"):
        assert verdict(t) == (False, "kein sepulkraler Bezug")
    for t in ("Beisetzung Petra Mueller", "Trauerfeier für Hans Schmidt", "Urnenbeisetzung von Anna Weber"):
        assert not verdict(t)[0] and verdict(t)[1].startswith("einzelne")
    for t in ("Redner-Workshop: Zweisprachige Trauerfeiern", "Gedenkfeier fuer einsam Verstorbene", "Beisetzungsformen im Wandel"):
        assert verdict(t)[0]
    assert verdict("Chor", "KapelleDREI, Hamburg", "https://friedhof.example/a") == (True, "Quelle: friedhof")
    assert verdict("FRIEDHÖFE am Abend") == (True, "Titel: FRIEDHÖF")


def test_types_and_regions(spark):
    assert one(spark, classify.event_type, "Kleinmesse über Leben und Tod") == "aktionstag"
    assert one(spark, classify.event_type, "Messe am Sonntag") == "gottesdienst" and one(spark, classify.event_type, "nichts") is None
    regions = (("nord", ("hamburg",)), ("ost", ("halle saale",)))
    region = lambda loc, url: one(spark, lambda a, b: classify.event_region(a, b, regions), loc, url)
    assert region("Halle (Saale)", "") == "ost" and region("", "https://a.hamburg.example/x") == "nord" and region("Online", "https://hamburg.example") == "online" and region("", "") == "sonstige"


def test_condense(spark):
    def cond(s, **k):
        return prepare.condense(spark.createDataFrame([(s,)], "text string"), **k).first()

    long = "x" * 7000 + " 13.09.2026 " + "y" * 490 + " 14.09.2026 " + "z" * 7000
    r = cond(long)
    at = long.index("13.09"), long.index("14.09") + 10
    assert r.text == long[at[0] - 200 : at[1] + 400] and r.hits == 2
    assert tuple(cond("x" * 13000)) == ("x" * 12000, 0)
    assert tuple(cond("1.2.2026 " * 50)) == ("1.2.2026 " * 35, 35)
    dense = "x" * 1000 + " 1.2.2026" * 60  # the first window does not fit: what it begins with stays
    assert tuple(cond(dense, limit=500)) == (dense[801:1301], 33)
    far = "1.2.2026 " + "x" * 900 + " 3.2.2026 " + "x" * 900
    assert text_gap(cond(far, limit=1000).text) == 1


def plain_condense(text, pattern, limit, most, before, after):
    """The same by marking letters: a bit for each letter or gap between letters that a window covers."""
    at = [m.span() for m in re.finditer(pattern, text)]
    if len(text) > limit:
        if not at:
            return text[:limit], 0
        covered = bytearray(2 * len(text) + 1)
        for s, e in at:
            s, e = max(s - before, 0), min(e + after, len(text))
            covered[2 * s : 2 * e + 1] = b"\1" * (2 * (e - s) + 1)
        windows = [text[m.start() // 2 : m.end() // 2] for m in re.finditer(b"\1+", bytes(covered))]
        parts, hits = [], 0
        while len(parts) < len(windows) and hits < most and sum(len(p) + 7 for p in parts) + len(windows[len(parts)]) + 7 <= limit:
            parts.append(windows[len(parts)])
            hits += len(re.findall(pattern, parts[-1]))
        text = " [...] ".join(parts) if parts else text[covered.index(1) // 2 :][:limit]
        at = [m.span() for m in re.finditer(pattern, text)]
    return (text[: at[most][0]], most) if len(at) > most else (text, len(at))


def test_condense_is_that_of_a_plain_model(spark):
    """Random texts, a text with 150,000 matches, empty ones, one long text in a third of the rows, clashing columns."""
    rng = random.Random(11)
    pattern = "[0-9]{1,2}[.][0-9]{1,2}|[0-9]{3,}"
    piece = lambda: rng.choice(["1.2", "2024", "ä" * rng.randint(0, 30), " ", "💐 x", "7", "b" * rng.randint(0, 60), "."])
    texts = ["".join(piece() for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += ["", "x" * 500, "3.4 " * 150_000, "y" * 90_000 + "5.6" + "y" * 90_000] + [max(texts[:300], key=len)] * 150
    df = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in enumerate(texts)] + [(-1, None, "a", 1, 2)], "i int, body string, _key string, first int, _windows int").repartition(3)
    k = dict(limit=200, most=4, before=15, after=25)
    out = prepare.condense(df, "body", pattern=pattern, **k)
    assert out.columns == [*df.columns, "hits"]
    got = {r.i: (r.body, r.hits) for r in out.collect()}
    assert len(got) == len(texts) + 1 and got.pop(-1)[0] is None
    assert [i for i, t in enumerate(texts) if got[i] != plain_condense(t, pattern, **k)] == []
    assert prepare.condense(df.where("false"), "body", **k).collect() == []


def text_gap(s):
    return s.count(" [...] ") + 1


def test_html(spark):
    raw = "<html><nav>no</nav><main>Gr&auml;ber <b>alt</b><script>x</script></main><p>out</p><script type='application/ld+json'>{\"a\": \"&uuml;\"}</script></html>"
    assert prepare.page_text(raw) == 'Gräber alt {"a": "ü"}' and prepare.page_text("<p>a<br>b</p> c") == "a b c"


ICS = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:Rundgang über den alten\r\n  Friedhof\\, Teil 1\r\nDTSTART;VALUE=DATE:20260913\r\nDTEND;VALUE=DATE:20260914\r\nLOCATION:Kapelle\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:Vortrag &amp; mehr\r\nDTSTART;TZID=Europe/Berlin:20260920T180000\r\nDTEND;TZID=Europe/Berlin:20260921T200000\r\nURL:https://a.example/x\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:Lesung\r\nDTSTART:20261001T160000Z\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"


def test_calendars(spark):
    pages = spark.createDataFrame([("https://p.example/", "<link type='text/calendar' href='/cal.ics'>"), ("https://q.example/", "<a href='a.ics'>x</a>" * 4), ("https://r.example/", "<a href='few.ics'>x</a>"), ("https://no.example/", "<link type='text/calendar' href='/cal.ics'>")], "url string, html string")
    bodies = spark.createDataFrame([("https://p.example/cal.ics", ICS), ("https://r.example/few.ics", ICS.replace("SUMMARY:Lesung", "X:1")), ("https://no.example/cal.ics", ICS)], "feed_url string, body string")
    got = calendars.feed_events(pages, bodies, ["no.example"]).orderBy("pos").collect()
    assert [(r.title, str(r.date_start), r.date_end and str(r.date_end), r.url) for r in got] == [
        ("Rundgang über den alten Friedhof, Teil 1", "2026-09-13", None, "https://p.example/"),
        ("Vortrag & mehr", "2026-09-20", "2026-09-21", "https://a.example/x"),
        ("Lesung", "2026-10-01", None, "https://p.example/"),
    ]
    assert calendars.feeds_of("<a href='a.ics'>x</a>" * 4, "https://q.example/") == []


def plain_first_fit(hits, size=8, most=55):
    """Batches of indexes, page by page."""
    batches = []
    for i in sorted(range(len(hits)), key=lambda i: -hits[i]):
        at = next((b for b in batches if len(b) < size and sum(hits[k] for k in b) + hits[i] <= most), None)
        if at is None:
            batches.append([i])
        else:
            at.append(i)
    return batches


def plain_budget(urls, hits, period, most):
    if len(plain_first_fit(hits)) <= most:
        return list(range(len(urls)))
    kept = []
    for i in sorted(range(len(urls)), key=lambda i: hashlib.md5(f"{urls[i]}|{period}".encode()).hexdigest()):
        if len(plain_first_fit([hits[k] for k in [*kept, i]])) <= most:
            kept.append(i)
    return kept


def plain_places(urls, hits, period, most):
    kept = plain_budget(urls, hits, period, most)
    return {kept[i]: (b, p) for b, batch in enumerate(plain_first_fit([hits[i] for i in kept])) for p, i in enumerate(batch, 1)}


def test_batches(spark, monkeypatch):
    assert plain_first_fit([35, 35, 20, 20]) == [[0, 2], [1, 3]]
    rng = random.Random(3)
    for n in (0, 1, 7, 300):
        hits = [rng.choice([0, 1, 5, 20, 35, 55, 70, rng.randint(0, 60)]) for _ in range(n)]
        segments, total = budget.first_fit(Counter(hits))
        want = plain_first_fit(hits)
        assert total == len(want) and sum(hi - lo for _, lo, hi, *_ in segments) == n
    monkeypatch.setattr(budget, "WINDOW", 9)
    for n, most in ((300, 1 << 30), (300, 12), (120, 3), (5, 40), (40, 1)):
        hits, urls = [rng.choice([0, 2, 9, 20, 35, 54]) for _ in range(n)], [f"https://p{i}.example/" for i in range(n)]
        df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(urls, hits))], "ordinal long, url string, hits int").repartition(5)
        got = {r.ordinal: (r.batch_id, r.pos) for r in budget.plan_batches(df, 7, most).collect()}
        want = plain_places(urls, hits, 7, most)
        assert len(got) == n and {k: v for k, v in got.items() if v[0] is not None} == want
    assert budget.plan_batches(df.where("false"), 7).collect() == []


def events(spark, rows):
    full = [(None, i, *r, DAY, DAY) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, EVENTS)


def row(title, start=DAY, end=None, location="", description="", url="https://a.example/"):
    return title, start, end, location, description, url


def test_duplicates(spark):
    rows = [row("Remembrance Sunday"), row("Remembrance Sunday (Erinnerungssonntag)"), row("Führung"), row("Führung", url="https://b.example/", location="Hof")]
    out = resolve.deduplicate(events(spark, rows)).collect()
    assert sorted(r.title for r in out) == ["Führung", "Führung", "Remembrance Sunday (Erinnerungssonntag)"]
    ends = [row("Ausstellung Grab", date(2026, 9, d), date(2026, 12, 1)) for d in (5, 3, 9)]
    out = resolve.deduplicate(events(spark, ends)).collect()
    assert [(r.title, r.date_start) for r in out] == [("Ausstellung Grab", date(2026, 9, 3))]


def test_order_and_ids_of_two_passes(spark):
    """Rows that end with one id: that of the later last day stays, days in the order in which they first occur."""
    e1, e2 = date(2026, 12, 1), date(2026, 12, 2)
    rows = [row("X", date(2026, 9, 1), e2), row("A", date(2026, 9, 2), e1, "Nord"), row("A", date(2026, 9, 2), e2, "Süd"), row("B", date(2026, 9, 5)), row("C", date(2026, 9, 1))]
    out = resolve.deduplicate(events(spark, rows)).orderBy("ordinal").collect()
    assert [(r.title, r.location) for r in out] == [(t, p) for t, p in plain_dedup(spark, rows)] and ("A", "Nord") in [(r.title, r.location) for r in out]
    coded = [row("Gr&auml;ber"), row("Gräber")]
    assert [r.title for r in resolve.deduplicate(events(spark, coded)).collect()] == ["Gräber"]
    feats = resolve.with_features(events(spark, coded)).collect()
    assert feats[0].c_title == feats[1].c_title == "gräber" and feats[0].t_tokens == feats[1].t_tokens


def features_of(spark, df):
    return resolve._rows(resolve.with_features(df).withColumn("new_id", links.event_id(F.col("c_title"), F.col("date_start"), F.col("url"), text.cleaned)).toPandas(), ("ordinal",))


def fold_plainly(groups):
    out = []
    for members in groups.values():
        leaders = []
        for r in members:
            old = next((s for s in leaders if resolve.same_event(r, s)), None)
            if old is None:
                leaders.append(r)
            else:
                resolve.absorb(old, r)
        out += leaders
    return out


def by(rows, day):
    groups = {}
    for r in rows:
        groups.setdefault(r[day], []).append(r)
    return groups


def plain_dedup(spark, rows, df=None):
    """(title, location) in order: both passes, day after day, then ids, the last of equals at the first's place."""
    first = fold_plainly(by([dict(r) for r in features_of(spark, resolve.normalize(df or events(spark, rows)))], "date_start"))
    merged = [r for r in first if not r["date_end"]] + fold_plainly(by([r for r in first if r["date_end"]], "date_end"))
    ids = {}
    for r in merged:
        ids[hashlib.md5(f"{r['c_title']}|{r['date_start'] or ''}|{r['host']}".encode()).hexdigest()] = r
    return [(r["title"], r["location"]) for r in ids.values()]


def sequential(store_rows, new_rows, today):
    state = [dict(r, n_new=0, n_updated=0) for r in store_rows]
    for r in (dict(x) for x in new_rows):
        r.update(first_seen=today, last_seen=today)
        old = next((s for s in state if resolve.same_event(r, s)), None)
        if old is not None:
            resolve.absorb(old, r)
            old["last_seen"] = today
            old["n_updated"] += 1
            continue
        r.update(id=r["new_id"], n_new=1, n_updated=0)
        at = next((i for i, s in enumerate(state) if s["id"] == r["id"]), None)
        if at is None:
            state.append(r)
        else:
            state[at] = {**r, "ordinal": state[at]["ordinal"], "n_new": 1 + state[at]["n_new"], "n_updated": state[at]["n_updated"]}
    return comparable(state)


SHOWN = ("id", "ordinal", "title", "date_start", "date_end", "location", "description", "first_seen", "last_seen", "n_new", "n_updated")


def comparable(rows):
    return sorted((tuple(str(r[c]) for c in SHOWN) for r in rows), key=str)


WORDS = ["Grab", "Hof", "Stein", "Abend", "Lesung", "Rundgang", "Konzert", "über Gräber und Steine", "Führung mit Musik"]


def random_rows(rng, n):
    rows = []
    for _ in range(n):
        s = date(2026, 9, rng.randint(1, 9))
        title = rng.choice(["", "Führung", " ".join(rng.sample(WORDS, rng.randint(1, 3))), "Ein langer Abend über Gräber" + rng.choice(["", " und Steine", " und Stein", " in der Kapelle"])])
        place = rng.choice(["", "Platz Nord", "Platz Süd", "Platz Süd am Tor", "Hof"])
        rows.append(row(title, s, date(2026, 9, rng.randint(10, 14)) if rng.random() < 0.4 else None, place, rng.choice(["", "kurz", "etwas länger"]), rng.choice(["https://a.example/", "https://b.example/", "", None])))
    return rows


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_folds_are_the_sequential_ones_for_any_partitions(spark, seed):
    rng = random.Random(seed)
    rows = random_rows(rng, 220) + [row("Tag des Friedhofs", DAY, None, "Haupttor", "", "https://a.example/")] * 40
    rng.shuffle(rows)
    df = events(spark, rows)
    want = plain_dedup(spark, rows)
    for n in (1, 5):
        assert [(r.title, r.location) for r in resolve.deduplicate(df.repartition(n)).orderBy("ordinal").collect()] == want
    df = df.withColumn("id", links.event_id(F.col("title"), F.col("date_start"), F.col("url")))
    old, new = df.where("ordinal < 60").dropDuplicates(["id"]), df.where("ordinal >= 60")
    every = {r["ordinal"]: r for r in features_of(spark, df)}
    kept = sorted(r.ordinal for r in old.collect())
    want = sequential([every[i] for i in kept], [every[i] for i in range(60, len(rows))], DAY)
    for n in (1, 5):
        assert comparable(r.asDict() for r in resolve.upsert(old.repartition(n), new.repartition(n), DAY).collect()) == want


def test_fold_of_real_titles(spark):
    """The registered rows of the smallest table: pairs, dedup and upsert against the plain fold."""
    store = queries.store_rows(spark, "/root/testdata/sf0.001")
    feats = resolve._rows(resolve.with_features(store, queries.TYPES).toPandas(), ("ordinal",))
    want = sorted((a["ordinal"], b["ordinal"]) for k, a in enumerate(feats) for b in feats[:k] if resolve.same_event(a, b))
    got = sorted((r.a, r.b) for r in resolve.duplicate_pairs(resolve.with_features(store, queries.TYPES)).collect())
    assert got == want and len(got) > 5


def test_ids_that_moved_are_found(spark):
    """An id whose row has another day or title by now is overwritten in its place; untouched rows pass by."""
    id_of = lambda df: df.withColumn("id", links.event_id(F.col("title"), F.col("date_start"), F.col("url")))
    new = id_of(events(spark, [row("Lesung"), row("", date(2026, 9, 2)), row("Führung", date(2026, 9, 4)), row("", date(2026, 9, 2))])).withColumn("ordinal", F.col("ordinal") + 10)
    moved_id = new.where("ordinal = 12").first().id
    old = id_of(events(spark, [row("Lesung"), row("Konzert"), row("", date(2026, 9, 2)), row("Rundgang", date(2026, 9, 3))])).withColumn("id", F.when(F.col("title") == "Rundgang", moved_id).otherwise(F.col("id")))
    want = sequential(features_of(spark, old), features_of(spark, new), DAY)
    out = resolve.upsert(old, new, DAY).collect()
    assert comparable(r.asDict() for r in out) == want and sum(r.n_new for r in out) == 3


INCOMING = "ordinal long, title string, date_start string, date_end string, location string, description string, url string, origin string"


def test_run_store_and_stream(spark, tmp_path):
    root = str(tmp_path / "store")
    assert store.read_store(spark, root).count() == 0
    raw = [("Führung Friedhof", "13.9.2026", "manuell"), ("Alt Friedhof", "2020-01-01", "manuell"), ("Alt Friedhof", "1.1.2020", "feed"), ("Stadtfest", "14.9.2026", "api"), ("Friedhof", "nie", "api"), ("Beisetzung Petra Muster Z", "14.9.2026", "api")]
    incoming = spark.createDataFrame([(i, t, s, None, "", "", "https://a.example/", o) for i, (t, s, o) in enumerate(raw)], INCOMING)
    r = pipeline.run(store.read_store(spark, root), incoming, DAY)
    assert [x.title for x in r.store.collect()] == ["Führung Friedhof"]
    assert r.stats.first().asDict() == {"neu": 1, "aktualisiert": 0, "datum_ungueltig": 1, "vergangen": 1, "thema_verfehlt": 2, "zusammengefuehrt": 0, "entfernt": 0, "manuell_abgelaufen": 1}
    assert sorted(x.title for x in r.rejects.collect()) == ["Stadtfest", "[privat]"]
    store.write_store(r.store, root)
    assert store.read_store(spark, root).count() == 1
    store.write_store(pipeline.run(store.read_store(spark, root), incoming, DAY).store, root)
    assert [x.title for x in store.read_store(spark, root).collect()] == ["Führung Friedhof"]
    (tmp_path / "store" / "versions" / ".v000000000009-cut-1").write_text("{")  # a version that a crash left unfinished
    assert store.read_store(spark, root).count() == 1 and len(store.versions(spark, root)) == 2
    incoming.coalesce(1).write.parquet(str(tmp_path / "in"))

    def stream(checkpoint):
        ingest_stream(spark.readStream.schema(incoming.schema).parquet(str(tmp_path / "in")), str(tmp_path / "s2"), str(tmp_path / checkpoint), DAY).awaitTermination()
        return store.versions(spark, str(tmp_path / "s2"))

    assert len(stream("cp")) == 1 and [x.title for x in store.read_store(spark, str(tmp_path / "s2")).collect()] == ["Führung Friedhof"]
    commits = tmp_path / "cp" / "commits" / "0"
    commits.unlink()  # as if the driver had died after the version was written: the batch is tried again
    (tmp_path / "cp" / "commits" / ".0.crc").unlink(missing_ok=True)
    assert len(stream("cp")) == 1
    assert len(stream("other")) == 2 and store.read_store(spark, str(tmp_path / "s2")).count() == 1


def test_dry_runs_staging_and_the_page(spark, tmp_path):
    root = str(tmp_path / "staging")
    raw = [("Führung <Friedhof> & mehr", "13.9.2026"), ("Lesung im Hospiz", "1.10.2026"), ("Stadtfest", "14.9.2026")]
    incoming = spark.createDataFrame([(i, t, s, None, "Köln", "", "https://a.example/?x=1&y", "api") for i, (t, s) in enumerate(raw)], INCOMING)
    r = pipeline.run(store.read_store(spark, f"{root}/store"), incoming, DAY)
    pipeline.publish(r, root, DAY, dry_run=True)
    assert store.versions(spark, f"{root}/store") == [] and not pipeline.render(spark, root, DAY) and spark.read.json(f"{root}/rejects").count() == 1
    pipeline.publish(r, root, DAY)
    rows = [x.value for x in spark.read.text(f"{root}/page/rows").collect()]
    assert len(rows) == 2 and rows[0].startswith('<tr data-tags="region-west art-fuehrung"><td>2026-09-13</td><td>Führung &lt;Friedhof&gt; &amp; mehr<span class="badge-new">neu</span></td><td>Köln</td>')
    assert 'href="https://a.example/?x=1&amp;y"' in rows[0]
    assert [x.value for x in spark.read.text(f"{root}/page/buttons").collect()] == ['<button data-value="fuehrung">F&uuml;hrungen <span class="count">1</span></button>', '<button data-value="lesung">Lesungen <span class="count">1</span></button>', '<button data-value="west">Westen <span class="count">2</span></button>']


def test_replies(spark):
    placed = spark.createDataFrame([(0, 1, "u1"), (0, 2, "u2")], "batch_id int, pos int, url string")
    good = '```json\n{"events": [{"source_id": 2, "title": "a"}, {"source_id": 3, "title": "b"}]}\n```'
    out = pipeline.read_replies(spark.createDataFrame([(0, good), (0, good[:60])], "batch_id int, reply string"), placed).collect()
    assert [(r.title, r.url) for r in out] == [("a", "u2")]


def test_every_query_runs_and_facets_add_up(spark):
    d = "/root/testdata/sf0.001"
    for name, q in queries.QUERIES.items():
        assert q(spark, d).limit(1).count() >= 0, name
    tagged = queries.tagged(spark, d)
    by = {(r.dim, r.value): r.n for r in present.value_counts(tagged).collect()}
    assert sum(n for (dim, _), n in by.items() if dim == "region") == 200
