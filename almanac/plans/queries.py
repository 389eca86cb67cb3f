"""The registered queries of the event operators over the driver's tables, with SQL where it can say them.

`listing` gives documents the shape of events: the first line is the title, the rest the description.
Keyword lists fit these tables' invented words; the default ones are tried on texts made of their words.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions import classify, dates, links, text
from almanac.operators import bitmaps, budget, keywords, prepare, present, resolve
from almanac.operators.tables import materialize
from almanac.plans import pipeline
from almanac.settings import EVENT_TYPES, REGION_LABELS, TOPICS, TYPE_LABELS, VENUES
from almanac.settings import REGIONS as REGIONS_ALL
from almanac.sources import calendars
from almanac.sources.store import active_sources, problem_report

TODAY = date(2024, 1, 15)
TYPES = (("ding", ("thing", "tion")), ("heit", ("heit", "keit")), ("kurz", ("the", "der", "la")))
REGIONS = (("nord", ("src1", "src3")), ("sued", ("src2", "src4")), ("west", ("src5",)))
NUMBERS = "[0-9]{1,2}\\.[0-9]{1,2}|[0-9]{3,}"
RULES = classify.TopicRules(private="^The [A-Za-z]+ [a-z]", venue="(?i)src1[0-9]|platz src2", topic="(?i)ation|keit|ment")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def listing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    line = F.substring_index("text", "\n", 1)
    n = F.length(line)
    return docs.select(
        F.col("doc_id").alias("ordinal"),
        F.trim(line).alias("title"),
        F.substring("text", n + 2, F.length("text")).alias("description"),
        F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("Platz "), "source")).alias("location"),
        F.date_add(F.lit(date(2024, 1, 1)), n % 30).alias("date_start"),
        F.when(n % 5 == 0, F.date_add(F.lit(date(2024, 2, 1)), n % 7)).alias("date_end"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "lang").alias("url"),
    )


LISTING = """listing AS (
  SELECT doc_id AS ordinal, trim(split_part(text, chr(10), 1)) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS description,
    CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Platz ' || source END AS location,
    CAST(DATE '2024-01-01' + CAST(length(split_part(text, chr(10), 1)) % 30 AS INT) AS DATE) AS date_start,
    CASE WHEN length(split_part(text, chr(10), 1)) % 5 = 0 THEN CAST(DATE '2024-02-01' + CAST(length(split_part(text, chr(10), 1)) % 7 AS INT) AS DATE) END AS date_end,
    'https://' || source || '.example.org/' || lang AS url
  FROM documents)"""


def sql_clean(c: str) -> str:
    signs = r"[–—:,\"`«»„“''()\[\]\-\n\r/|]"
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '{signs}', ' ', 'g'), '\s+', ' ', 'g'))"


def sql_tokens(c: str) -> str:
    stop = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
    stem = "CASE WHEN length(w) < 6 THEN w WHEN regexp_matches(w, '(en|er|es)$') THEN left(w, length(w) - 2) WHEN regexp_matches(w, '[nse]$') THEN left(w, length(w) - 1) ELSE w END"
    return rf"list_distinct(list_transform(list_filter(regexp_extract_all({sql_clean(c)}, '[\p{{L}}\p{{N}}_]{{3,}}'), lambda w: NOT list_contains({stop}, w)), lambda w: {stem}))"


def sql_type(c: str, types=TYPES) -> str:
    cases = []
    for label, keys in types:
        hits = " OR ".join(f"contains({sql_clean(c)}, '{k}')" if len(k) >= 6 or " " in k else rf"list_contains(regexp_extract_all({sql_clean(c)}, '[\p{{L}}\p{{N}}_]{{3,}}'), '{k}')" for k in keys)
        cases.append(f"WHEN {hits} THEN '{label}'")
    return f"CASE {' '.join(cases)} END"


SQL_HOST = r"lower(regexp_extract(coalesce(url, ''), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1))"


def sql_region(regions=REGIONS) -> str:
    def cases(c):
        return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({c}, '{k}')" for k in keys) + f" THEN '{label}'" for label, keys in regions) + " END"

    return f"coalesce({cases(sql_clean('location'))}, {cases(sql_clean(SQL_HOST))}, 'sonstige')"


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, days: tuple[str, ...] = ()):
    """Registers a query and its SQL; columns in days are shown as text in both."""

    def keep(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            out = f(spark, d)
            return out.withColumns({c: F.col(c).cast("string") for c in days}) if days else out

        QUERIES[f.__name__] = run
        if sql:
            cast = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in days)
            ORACLES[f.__name__] = f"SELECT * REPLACE ({cast}) FROM ({sql})" if days else sql
        return f

    return keep


@query(f"WITH {LISTING} SELECT date_start, count(*) AS n, count(DISTINCT {sql_clean('title')}) AS n_titles, count(DISTINCT md5({sql_clean('title')} || '|' || CAST(date_start AS VARCHAR) || '|' || {SQL_HOST})) AS n_ids FROM listing GROUP BY date_start", ("date_start",))
def events_per_day(spark, d):
    e = listing(spark, d).select("date_start", text.clean(F.col("title")).alias("t"), links.event_id(F.col("title"), F.col("date_start"), F.col("url")).alias("id"))
    return e.groupBy("date_start").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("n_titles"), F.countDistinct("id").alias("n_ids"))


@query(f"WITH {LISTING} SELECT ordinal, {sql_clean('title')} AS title FROM listing")
def clean_titles(spark, d):
    return listing(spark, d).select("ordinal", text.clean(F.col("title")).alias("title"))


@query(f"WITH {LISTING} SELECT ordinal, array_to_string(list_sort({sql_tokens('title')}), ' ') AS tokens FROM listing")
def token_sets(spark, d):
    return listing(spark, d).select("ordinal", F.array_join(F.array_sort(text.tokens(F.col("title"))), " ").alias("tokens"))


@query(f"WITH {LISTING} SELECT ordinal, {sql_type('title')} AS kind FROM listing")
def title_type(spark, d):
    return listing(spark, d).select("ordinal", classify.event_type(F.col("title"), TYPES).alias("kind"))


@query(
    rf"""WITH w AS (SELECT conv_id, turn, regexp_extract_all({sql_clean('text')}, '[\p{{L}}\p{{N}}_]{{3,}}') AS ws FROM conversations),
k AS (SELECT conv_id AS priority, unnest(ws) AS word FROM w UNION ALL SELECT conv_id, array_to_string(ws[1:2], ' ') FROM w WHERE len(ws) >= 2),
d AS (SELECT word, min(priority) AS priority FROM k GROUP BY word),
t AS (SELECT doc_id, {sql_clean('text')} AS c, regexp_extract_all({sql_clean('text')}, '[\p{{L}}\p{{N}}_]{{3,}}') AS ws FROM documents),
h AS (SELECT doc_id, priority, word FROM t JOIN d ON contains(c, word) WHERE length(word) >= 6 OR contains(word, ' ')
  UNION ALL SELECT doc_id, priority, word FROM (SELECT DISTINCT doc_id, unnest(ws) AS word FROM t) JOIN d USING (word) WHERE length(word) < 6)
SELECT doc_id, x.w AS label FROM documents LEFT JOIN (SELECT doc_id, min({{'p': priority, 'w': word}}) AS x FROM h GROUP BY doc_id) USING (doc_id)"""
)
def keywords_by_table(spark, d):
    """Documents by the words and first pairs of words of conversations; those of the first conversations come first."""
    w = table(spark, d, "conversations").select("conv_id", text.words(text.clean(F.col("text"))).alias("ws"))
    pairs = w.where(F.size("ws") >= 2).select("conv_id", F.array_join(F.slice("ws", 1, 2), " ").alias("word"))
    found = w.select("conv_id", F.explode("ws").alias("word")).unionByName(pairs)
    known = found.select(F.col("conv_id").alias("priority"), "word", F.col("word").alias("label"))
    return keywords.first_keyword(table(spark, d, "documents").select("doc_id", "text"), "text", known).select("doc_id", "label")


@query(f"WITH {LISTING} SELECT ordinal, {sql_region()} AS region FROM listing")
def region_by_place_or_host(spark, d):
    return listing(spark, d).select("ordinal", classify.event_region(F.col("location"), F.col("url"), REGIONS).alias("region"))


@query(rf"SELECT page_id, {SQL_HOST} AS host, lower({SQL_HOST} || regexp_extract(coalesce(url, ''), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*([^?#;]*)', 1)) AS place FROM pages")
def netloc(spark, d):
    return table(spark, d, "pages").select("page_id", links.host(F.col("url")).alias("host"), links.host_and_path(F.col("url")).alias("place"))


@query(f"WITH {LISTING} SELECT ordinal, md5({sql_clean('title')} || '|' || CAST(date_start AS VARCHAR) || '|' || {SQL_HOST}) AS id FROM listing")
def event_ids(spark, d):
    return listing(spark, d).select("ordinal", links.event_id(F.col("title"), F.col("date_start"), F.col("url")).alias("id"))


@query(
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders""",
    ("day", "parsed"),
)
def parse_dates(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    k = F.col("o_orderkey") % 7
    months = F.array(*[F.lit(m) for m in ("Januar", "Feb", "März", "April", "Mai", "Juni", "Jul", "August", "Sept", "Okt", "November", "Dezember")])
    named = F.concat(F.dayofmonth("day").cast("string"), F.lit(". "), F.element_at(months, F.month("day")), F.lit(" "), F.year("day").cast("string"))
    form = F.when(k == 0, F.date_format("day", "yyyy-MM-dd")).when(k == 1, F.date_format("day", "d.M.yyyy")).when(k == 2, F.concat(F.lit("am "), F.date_format("day", "dd/MM/yyyy"), F.lit(" um 8")))
    form = form.when(k == 3, named).when(k == 4, F.concat(F.lit("2026-02-30, "), F.date_format("day", "d.M.yyyy"))).when(k == 5, F.concat(F.lit("31.2.2024 "), named)).otherwise("kein Datum 5.2026")
    return o.select("o_orderkey", "day", dates.parse_date(form).alias("parsed"))


@query("SELECT event_id, CAST(ts AS DATE) AS day, event_id % 2 = 0 AS all_day FROM events", ("day",))
def calendar_dates(spark, d):
    e = table(spark, d, "events")
    s = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyyMMdd")).otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"))
    return e.select("event_id", dates.calendar_date(s).alias("x")).select("event_id", "x.day", "x.all_day")


@query(rf"SELECT doc_id, CASE WHEN length(text) < 350 THEN 'zu kurz' WHEN NOT regexp_matches(text, '{NUMBERS}') THEN 'kein Datum' END AS reason FROM documents")
def gate(spark, d):
    return table(spark, d, "documents").select("doc_id", prepare.reject_reason(F.col("text"), NUMBERS).alias("reason"))


@query(rf"SELECT CASE WHEN length(text) < 350 THEN 'zu kurz' WHEN NOT regexp_matches(text, '{NUMBERS}') THEN 'kein Datum' END AS kind, count(*) AS n, array_to_string(list_sort(list(source)), ' ') AS urls FROM documents WHERE length(text) < 350 OR NOT regexp_matches(text, '{NUMBERS}') GROUP BY ROLLUP (1)")
def problems_by_kind(spark, d):
    bad = table(spark, d, "documents").select(prepare.reject_reason(F.col("text"), NUMBERS).alias("kind"), F.col("source").alias("url")).where("kind IS NOT NULL")
    return problem_report(bad).select("kind", "n", F.array_join("urls", " ").alias("urls"))


def sql_capped(c: str, pattern: str, most: int) -> str:
    """struct of a text cut before match most + 1 and its matches."""
    found, rests = f"regexp_extract_all({c}, '{pattern}')", f"string_split_regex({c}, '{pattern}')"
    lengths = lambda x, k: f"coalesce(list_sum(list_transform({x}[1:{k}], lambda p: length(p))), 0)"
    begin = f"CAST({lengths(found, most)} + {lengths(rests, most + 1)} AS BIGINT)"
    return f"CASE WHEN len({found}) > {most} THEN {{'text': substr({c}, 1, {begin}), 'hits': {most}}} ELSE {{'text': {c}, 'hits': len({found})}} END"


CONDENSED = {"limit": 1000, "most": 5, "before": 40, "after": 80}


@query(
    rf"""WITH l AS (SELECT doc_id, text, regexp_extract_all(text, '{NUMBERS}') AS hs, string_split_regex(text, '{NUMBERS}') AS rs FROM documents WHERE length(text) > {CONDENSED['limit']}),
x AS (SELECT doc_id, text, unnest(range(1, len(hs) + 1)) AS i, unnest(list_transform(hs, lambda p: length(p))) AS h, unnest(list_transform(rs[1:len(hs)], lambda p: length(p))) AS r FROM l),
e AS (SELECT doc_id, i, h, length(text) AS m, sum(h + r) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM x),
w AS (SELECT doc_id, i, greatest(e - h - {CONDENSED['before']}, 0) AS s, least(e + {CONDENSED['after']}, m) AS e FROM e),
g AS (SELECT *, CASE WHEN s <= lag(e) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM w),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g),
islands AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM n GROUP BY doc_id, island),
f AS (SELECT *, sum(e - s + 7) OVER (PARTITION BY doc_id ORDER BY s) <= {CONDENSED['limit']} AS fits FROM islands),
c AS (SELECT f.doc_id, f.s, substr(text, CAST(f.s + 1 AS BIGINT), CAST(f.e - f.s AS BIGINT)) AS chunk FROM f JOIN l USING (doc_id) WHERE fits),
k AS (SELECT *, coalesce(sum(len(regexp_extract_all(chunk, '{NUMBERS}'))) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hits FROM c),
j AS (SELECT doc_id, string_agg(chunk, ' [...] ' ORDER BY s) AS t FROM k WHERE hits < {CONDENSED['most']} GROUP BY doc_id),
o AS (SELECT doc_id, min(s) AS s FROM islands GROUP BY doc_id),
y AS (SELECT l.doc_id, o.s IS NULL AS none, coalesce(j.t, substr(text, CAST(coalesce(o.s, 0) + 1 AS BIGINT), {CONDENSED['limit']})) AS t FROM l LEFT JOIN o USING (doc_id) LEFT JOIN j USING (doc_id)
  UNION ALL SELECT doc_id, false, text FROM documents WHERE length(text) <= {CONDENSED['limit']} OR text IS NULL),
z AS (SELECT doc_id, CASE WHEN none THEN {{'text': t, 'hits': 0}} ELSE {sql_capped('t', NUMBERS, CONDENSED['most'])} END AS x FROM y)
SELECT doc_id, x.text AS text, CAST(x.hits AS INT) AS hits FROM z"""
)
def condensed(spark, d):
    out = prepare.condense(table(spark, d, "documents").select("doc_id", "text"), pattern=NUMBERS, **CONDENSED)
    return out.select("doc_id", "text", "hits")


@query()
def pages_as_text(spark, d):
    return prepare.with_text(table(spark, d, "pages").select("page_id", "html")).select("page_id", "text")


VENUE_HIT, TOPIC_HIT, PRIVATE_HIT = "(?i)src1[0-9]|platz src2", "(?i)ation|keit|ment", "^The [A-Za-z]+ [a-z]"


def sql_reason(venue: str, topic: str, private: str) -> str:
    hit = lambda name, c, p: f"WHEN regexp_matches({c}, '{p}') THEN '{name}: ' || regexp_extract({c}, '{p}')"
    chain = [("Quelle", "place", venue), ("Ort", "location", venue), ("Titel", "title", topic), ("Beschreibung", "description", topic), ("Ort", "location", topic)]
    return f"CASE WHEN regexp_matches(title, '{private}') THEN 'einzelne Bestattung, keine oeffentliche Veranstaltung' {' '.join(hit(*c) for c in chain)} ELSE 'kein sepulkraler Bezug' END"


REASONED = f"""v AS (SELECT *, lower({SQL_HOST} || '/' || split_part(url, '/', 4)) AS place FROM listing),
reasoned AS (SELECT *, {sql_reason(VENUE_HIT, TOPIC_HIT, PRIVATE_HIT)} AS reason FROM v)"""


@query(f"WITH {LISTING}, {REASONED} SELECT ordinal, NOT (reason LIKE 'einzelne%' OR reason LIKE 'kein %') AS relevant, reason FROM reasoned")
def topic_reason(spark, d):
    e = listing(spark, d)
    return e.select("ordinal", classify.topic_reason(F.col("title"), F.col("description"), F.col("location"), F.col("url"), RULES).alias("x")).select("ordinal", "x.relevant", "x.reason")


@query(f"WITH {LISTING} SELECT ordinal, coalesce(date_end, date_start) AS last_day FROM listing WHERE coalesce(date_end, date_start) >= DATE '2024-01-15'", ("last_day",))
def expire(spark, d):
    return present.current(listing(spark, d), TODAY).select("ordinal", dates.effective_end().alias("last_day"))


def tagged(spark, d):
    e = listing(spark, d)
    return e.withColumns({"region": classify.event_region(F.col("location"), F.col("url"), REGIONS), "kind": classify.event_kind(F.col("title"), F.col("description"), TYPES)})


TAGGED = f"tagged AS (SELECT *, {sql_region()} AS region, coalesce({sql_type('title')}, {sql_type('description')}, 'sonstige') AS kind FROM listing)"
WINDOW = "(date_start <= DATE '2024-01-15' + {n} AND coalesce(date_end, date_start) >= DATE '2024-01-15')"


@query(
    f"""WITH {LISTING}, {TAGGED}, c AS (SELECT 'region' AS dim, region AS value, count(*) AS n FROM tagged GROUP BY region UNION ALL SELECT 'kind', kind, count(*) FROM tagged GROUP BY kind)
SELECT dim, value, n, CAST(row_number() OVER (PARTITION BY dim ORDER BY n DESC, value) AS INT) AS place FROM c"""
)
def facet_counts(spark, d):
    return present.ranked_counts(present.value_counts(tagged(spark, d)))


CHOICE = {"search": "the", "region": "nord", "kind": "kurz", "days": 7}
PASS_SEARCH, PASS_TIME = "contains(lower(title || ' ' || location || ' ' || description), 'the')", WINDOW.format(n=7)


@query(
    f"""WITH {LISTING}, {TAGGED}
SELECT 'region' AS dim, region AS value, count(*) FILTER (WHERE {PASS_SEARCH} AND kind = 'kurz' AND {PASS_TIME}) AS n FROM tagged GROUP BY region
UNION ALL SELECT 'kind', kind, count(*) FILTER (WHERE {PASS_SEARCH} AND region = 'nord' AND {PASS_TIME}) FROM tagged GROUP BY kind
UNION ALL SELECT 'time', '7', count(*) FILTER (WHERE {PASS_SEARCH} AND region = 'nord' AND kind = 'kurz' AND {WINDOW.format(n=7)}) FROM tagged
UNION ALL SELECT 'time', '30', count(*) FILTER (WHERE {PASS_SEARCH} AND region = 'nord' AND kind = 'kurz' AND {WINDOW.format(n=30)}) FROM tagged
UNION ALL SELECT 'time', '90', count(*) FILTER (WHERE {PASS_SEARCH} AND region = 'nord' AND kind = 'kurz' AND {WINDOW.format(n=90)}) FROM tagged"""
)
def facet_leave_one_out(spark, d):
    return present.facets(tagged(spark, d), TODAY, **CHOICE)


@query(ORACLES["facet_leave_one_out"])
def facets_by_bitmaps(spark, d):
    """The same from an index of bitmaps; only the search reads the events."""
    events = tagged(spark, d)
    found = materialize(bitmaps.matching(events, present.predicates(TODAY, search=CHOICE["search"])["search"]), "found")
    return bitmaps.facets(materialize(bitmaps.build(events), "bitmaps"), TODAY, CHOICE["region"], CHOICE["kind"], CHOICE["days"], found)


@query(f"WITH {LISTING}, {TAGGED} SELECT ordinal FROM tagged WHERE {PASS_SEARCH} AND region = 'nord' AND kind = 'kurz' AND {PASS_TIME}")
def visible_events(spark, d):
    return present.visible(tagged(spark, d), TODAY, **CHOICE).select("ordinal")


@query(f"WITH {LISTING} SELECT ordinal, {WINDOW.format(n=7)} AS in_7, {WINDOW.format(n=30)} AS in_30 FROM listing")
def window_overlap(spark, d):
    return listing(spark, d).select("ordinal", present.in_window(TODAY, 7).alias("in_7"), present.in_window(TODAY, 30).alias("in_30"))


@query(f"WITH {LISTING} SELECT ordinal, row_number() OVER (ORDER BY greatest(date_start, DATE '2024-01-15'), date_start, ordinal) - 1 AS rank FROM listing")
def listing_order(spark, d):
    return budget.ranked(listing(spark, d).select("ordinal", "date_start"), *present.listing_key(TODAY)).select("ordinal", "rank")


@query(f"WITH {LISTING} SELECT ordinal, date_end IS NOT NULL AS is_running, date_start = DATE '2024-01-15' AS is_new, DATE '2024-01-15' - date_start > 10 AS is_stale FROM listing")
def badges(spark, d):
    e = listing(spark, d).withColumns({"first_seen": F.col("date_start"), "last_seen": F.col("date_start")})
    return present.with_badges(e, TODAY).select("ordinal", "is_running", "is_new", "is_stale")


FEATURES = f"""f AS (SELECT ordinal, date_start, date_end, {SQL_HOST} AS host, {sql_clean('title')} AS t, {sql_tokens('location')} AS l, {sql_tokens('title')} AS tt, {sql_type('title')} AS kind FROM listing),
pairs AS (SELECT a.ordinal AS a, b.ordinal AS b, a.t AS ta, b.t AS tb, a.tt AS tta, b.tt AS ttb, a.kind AS ka, b.kind AS kb
  FROM f a JOIN f b ON a.ordinal > b.ordinal AND a.date_start = b.date_start
  WHERE ((a.host = '' OR b.host = '' OR a.host = b.host) AND (len(a.l) = 0 OR len(b.l) = 0 OR len(list_intersect(a.l, b.l)) > 0)
     OR len(a.l) > 0 AND len(b.l) > 0 AND len(list_intersect(a.l, b.l)) > 0)
  UNION ALL SELECT a.ordinal, b.ordinal, a.t, b.t, a.tt, b.tt, a.kind, b.kind
  FROM f a JOIN f b ON a.ordinal > b.ordinal AND a.date_end = b.date_end AND a.date_start <> b.date_start
  WHERE ((a.host = '' OR b.host = '' OR a.host = b.host) AND (len(a.l) = 0 OR len(b.l) = 0 OR len(list_intersect(a.l, b.l)) > 0)
     OR len(a.l) > 0 AND len(b.l) > 0 AND len(list_intersect(a.l, b.l)) > 0))"""


def features(spark, d):
    return resolve.with_features(listing(spark, d), TYPES)


@query(f"WITH {LISTING}, {FEATURES} SELECT a, b FROM pairs WHERE ta = tb AND ta <> ''")
def duplicates_by_title(spark, d):
    lots, pairs, _ = resolve.class_pairs(features(spark, d), linked=False)
    return resolve.expanded(lots, pairs)


SHARED = "len(list_intersect(tta, ttb))"


@query(f"WITH {LISTING}, {FEATURES}, j AS (SELECT *, CASE WHEN len(tta) > 0 AND len(ttb) > 0 THEN {SHARED} / (len(tta) + len(ttb) - {SHARED}) ELSE 0.0 END AS jaccard FROM pairs WHERE ta <> tb AND ta <> '' AND tb <> '') SELECT a, b, jaccard FROM j WHERE jaccard >= 0.6 AND 2 * least(length(ta), length(tb)) >= 0.88 * (length(ta) + length(tb))")
def title_jaccard(spark, d):
    lots, pairs, _ = resolve.class_pairs(features(spark, d))
    return resolve.expanded(lots, pairs.where("is_like"), jaccard=F.col("jaccard"))


HALVED = "halved AS (SELECT * REPLACE (CASE WHEN ordinal % 3 = 0 THEN trim(left(title, length(title) // 2)) ELSE title END AS title) FROM listing)"


@query(f"WITH {LISTING}, {HALVED}, {FEATURES.replace('FROM listing', 'FROM halved')} SELECT a, b FROM pairs WHERE ta <> tb AND ta <> '' AND tb <> '' AND least(length(ta), length(tb)) >= 12 AND contains(CASE WHEN length(tb) < length(ta) THEN ta ELSE tb END, CASE WHEN length(tb) < length(ta) THEN tb ELSE ta END)")
def duplicates_by_containment(spark, d):
    """A third of the titles are cut to their first half, so that others hold them."""
    half = F.trim(F.left("title", F.floor(F.length("title") / 2).cast("int")))
    e = listing(spark, d).withColumn("title", F.when(F.col("ordinal") % 3 == 0, half).otherwise(F.col("title")))
    lots, pairs, _ = resolve.class_pairs(resolve.with_features(e, TYPES))
    return resolve.expanded(lots, pairs.where("is_inside"))


@query()
def duplicate_pairs(spark, d):
    return resolve.duplicate_pairs(features(spark, d))


def store_rows(spark, d):
    e = listing(spark, d)
    seen = F.lit(date(2024, 1, 10))
    return e.select(links.event_id(F.col("title"), F.col("date_start"), F.col("url")).alias("id"), "ordinal", "title", "date_start", "date_end", "location", "description", "url", seen.alias("first_seen"), seen.alias("last_seen"))


@query()
def dedup_two_pass(spark, d):
    return resolve.deduplicate(store_rows(spark, d), TYPES).drop("ordinal")  # numbers the new order


@query()
def ingest_upsert(spark, d):
    rows = store_rows(spark, d)
    return resolve.upsert(rows.where("ordinal % 2 = 0"), rows.where("ordinal % 2 = 1"), TODAY, TYPES)


@query(
    f"""WITH {LISTING}, x AS (SELECT *, {sql_clean('title')} AS key FROM listing)
SELECT key, date_start, min(ordinal) AS ordinal, arg_max(title, {{'n': length({sql_clean('title')}), 'o': -ordinal}}) AS title, arg_max(location, {{'n': length({sql_clean('location')}), 'o': -ordinal}}) AS location,
  min(date_start) AS first_day, arg_min(date_end, ordinal) FILTER (WHERE date_end IS NOT NULL) AS date_end, arg_min(url, ordinal) AS url, count(*) AS n FROM x GROUP BY key, date_start""",
    ("date_start", "first_day", "date_end"),
)
def merge_clusters(spark, d):
    return resolve.merge_clusters(listing(spark, d).withColumn("key", text.clean(F.col("title"))), ["key", "date_start"])


@query("SELECT page_id, md5(url || '|738900') AS rotation FROM pages")
def rotation_order(spark, d):
    return table(spark, d, "pages").select("page_id", links.rotation_key(F.col("url"), dates.period(F.lit(TODAY))).alias("rotation"))


def hit_pages(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("ordinal"), "url", F.least(F.regexp_count("html", F.lit("[0-9]{3,}")), F.lit(35)).alias("hits"))


@query()
def pack_batches(spark, d):
    return budget.plan_batches(hit_pages(spark, d), 738900, 1 << 30)


@query()
def budget_select(spark, d):
    return budget.plan_batches(hit_pages(spark, d), 738900, 12)


K = "CAST(json_extract(props, '$.k') AS INT)"


@query(f"SELECT event_id, {K} AS source_id, event_type AS title, 'https://p' || CAST({K} AS VARCHAR) || '.example/' AS url FROM events WHERE {K} BETWEEN 1 AND 3 AND event_id % 10 <> 0")
def reply_sources(spark, d):
    """A reply for each event, in a fence or not, one in ten cut off; batches have three pages."""
    e = table(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    body = F.concat(F.lit('{"events": [{"source_id": '), "k", F.lit(', "title": "'), "event_type", F.lit('", "other": 1}]}'))
    body = F.when(F.col("event_id") % 10 == 0, F.left(body, F.length(body) - 2)).otherwise(body)
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    places = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f"https://p{i}.example/").alias("url")) for i in (1, 2, 3)])
    placed = e.select(F.col("event_id").alias("batch_id"), F.explode(places).alias("p")).select("batch_id", "p.*")
    out = pipeline.read_replies(e.select(F.col("event_id").alias("batch_id"), reply.alias("reply")), placed)
    return out.select(F.col("batch_id").alias("event_id"), "source_id", "title", "url")


@query(
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE user_id % 7 <> 0)
SELECT 'https://u' || CAST(user_id AS VARCHAR) || '.example/x' AS page_url, CAST(k AS INT) AS pos, event_type || ', ' || CAST(event_id AS VARCHAR) AS title, CAST(ts AS DATE) AS date_start,
  CASE WHEN event_id % 3 = 0 THEN CAST(CAST(ts AS DATE) + 2 AS DATE) END AS date_end, 'Saal ' || CAST(event_id % 5 AS VARCHAR) AS location
FROM e WHERE n >= 3 AND k <= 60""",
    ("date_start", "date_end"),
)
def feed_events(spark, d):
    """A page and a calendar for each user of the events table; those of one user in seven are on blocked hosts."""
    e = table(spark, d, "events")
    day = lambda n: F.date_format(F.date_add(F.col("ts").cast("date"), n), "yyyyMMdd")
    whole = F.col("event_id") % 2 == 0
    start = F.when(whole, F.concat(F.lit("DTSTART;VALUE=DATE:"), day(0))).otherwise(F.concat(F.lit("DTSTART:"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")))
    last = F.when(whole, day(3)).otherwise(F.concat(day(2), F.lit("T120000")))
    end = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("DTEND:"), last, F.lit("\r\n"))).otherwise("")
    place = F.concat(F.lit("LOCATION;X=1:Saa\r\n l "), (F.col("event_id") % 5).cast("string"), F.lit("\r\n"))
    lines = F.concat(F.lit("BEGIN:VEVENT\r\nSUMMARY:"), "event_type", F.lit("\\, "), F.col("event_id").cast("string"), F.lit("\r\n"), place, start, F.lit("\r\n"), end, F.lit("END:VEVENT\r\n"))
    host_of = F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example"))
    rows = F.array_sort(F.collect_list(F.struct("event_id", lines.alias("l"))))
    bodies = e.groupBy("user_id").agg(F.array_join(F.transform(rows, lambda r: r["l"]), "").alias("l"))
    bodies = bodies.select(F.concat(host_of, F.lit("/cal.ics")).alias("feed_url"), F.concat(F.lit("BEGIN:VCALENDAR\r\n"), "l", F.lit("END:VCALENDAR\r\n")).alias("body"))
    pages = e.select("user_id").distinct().select(F.concat(host_of, F.lit("/x")).alias("url"), F.lit("<head><link rel='alternate' type='text/calendar' href='cal.ics'></head>").alias("html"))
    blocked = e.where("user_id % 7 = 0").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".example")).alias("host")).distinct()
    return calendars.feed_events(pages, bodies, blocked).select("page_url", "pos", "title", "date_start", "date_end", "location")


@query(rf"SELECT page_id, url FROM pages WHERE {SQL_HOST} NOT IN ('blog.tionsh.example.com', 'tionble.example.org')")
def unblocked_pages(spark, d):
    return calendars.unblocked(table(spark, d, "pages"), ("blog.tionsh.example.com", "tionble.example.org")).select("page_id", "url")


VERDICT = "CASE WHEN ordinal % 50 = 0 THEN 'datum_ungueltig' WHEN coalesce(date_end, date_start) < DATE '2024-01-15' THEN 'vergangen' WHEN reason LIKE 'einzelne%' OR reason LIKE 'kein %' THEN 'thema_verfehlt' ELSE 'ok' END"


def judged(spark, d):
    """The listing as extraction gives it: dates as texts, one in fifty unreadable."""
    e = listing(spark, d)
    start = F.when(F.col("ordinal") % 50 == 0, "bald").otherwise(F.date_format("date_start", "d.M.yyyy"))
    return pipeline.judge(e.withColumns({"date_start": start, "date_end": F.col("date_end").cast("string"), "origin": F.lit("api")}), TODAY, RULES)


@query(f"WITH {LISTING}, {REASONED} SELECT {VERDICT} AS verdict, count(*) AS n FROM reasoned GROUP BY 1")
def run_counters(spark, d):
    return judged(spark, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LISTING}, {REASONED} SELECT CASE WHEN reason LIKE 'einzelne%' THEN '[privat]' ELSE title END AS title, CAST(date_start AS VARCHAR) AS date_start, location, url, reason AS _grund, 'api' AS _herkunft FROM reasoned WHERE {VERDICT} = 'thema_verfehlt'")
def rejected(spark, d):
    return pipeline.reject_log(judged(spark, d)).withColumn("date_start", F.col("date_start").cast("string"))


TOPIC_WORDS = [w.replace(r"\b", "").replace(r"\s+", " ") for w in TOPICS]
REGION_WORDS = [k for _, keys in REGIONS_ALL for k in keys]
WORDED = f"""worded AS (SELECT doc_id AS ordinal, 'Abend zu ' || {sql_list(TOPIC_WORDS)}[doc_id % {len(TOPIC_WORDS)} + 1] || ' im Saal' AS title, '' AS description,
  'Am ' || {sql_list(REGION_WORDS)}[doc_id % {len(REGION_WORDS)} + 1] AS location,
  CASE WHEN doc_id % 3 = 0 THEN 'https://' || {sql_list(VENUES)}[doc_id % {len(VENUES)} + 1] || '.example.org/x' ELSE 'https://stadt.example.org/x' END AS url FROM documents)"""


def worded(spark, d):
    """Rows made of the default words: a topic in the title, a region's word in the place, a venue's in some hosts."""
    pick = lambda words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("doc_id") % len(words) + 1).cast("int"))
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("ordinal"), F.concat(F.lit("Abend zu "), pick(TOPIC_WORDS), F.lit(" im Saal")).alias("title"), F.lit("").alias("description"),
        F.concat(F.lit("Am "), pick(REGION_WORDS)).alias("location"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://"), pick(VENUES), F.lit(".example.org/x"))).otherwise("https://stadt.example.org/x").alias("url"),
    )


@query(f"WITH {WORDED}, v AS (SELECT *, lower({SQL_HOST} || '/x') AS place FROM worded) SELECT ordinal, {sql_reason('(?i)' + '|'.join(VENUES), '(?i)' + '|'.join(TOPICS), '^The [A-Z]x')} AS reason FROM v")
def default_topics(spark, d):
    e = worded(spark, d)
    return e.select("ordinal", classify.topic_reason(F.col("title"), F.col("description"), F.col("location"), F.col("url")).alias("x")).select("ordinal", "x.reason")


@query(f"WITH {WORDED} SELECT ordinal, CASE WHEN contains(lower(location), 'online') THEN 'online' ELSE {sql_region(REGIONS_ALL)} END AS region, coalesce({sql_type('title', EVENT_TYPES)}, 'sonstige') AS kind FROM worded")
def default_regions_and_types(spark, d):
    return pipeline.tagged(worded(spark, d)).select("ordinal", "region", "kind")


@query("SELECT o_orderkey, o_orderkey % 6 = 5 AS private FROM orders")
def private_events(spark, d):
    """Titles of funerals and of events that only begin like them."""
    form = ["Beisetzungsformen im Wandel", "Gedenkfeier fuer einsam Verstorbene", "Abend der Bestattung von Anna Weber", "trauerfeier für alle", "Bestattung heute", "Urnenbeisetzung von Anna Weber"]
    title = F.element_at(F.array(*[F.lit(x) for x in form]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.rlike(title, F.lit(classify.TopicRules().private)).alias("private"))


@query("SELECT o_orderkey, CAST([2, 1, 1, 1, 1, 0][o_orderkey % 6 + 1] AS INT) AS hits, CASE WHEN o_orderkey % 6 = 5 THEN 'kein Datum' END AS reason FROM orders")
def dates_in_texts(spark, d):
    """Hits of the default date pattern in running text, and the gate's reason."""
    day = F.col("o_orderdate").cast("date")
    months = F.array(*[F.lit(m) for m in ("Januar", "Feb.", "März", "APRIL", "Mai", "Juni", "Jul", "August", "Sept", "Okt.", "November", "Dezember")])
    forms = [F.concat(F.date_format(day, "d.M.yyyy"), F.lit(" bis "), F.date_format(day, "d. M. yy")), F.concat(F.lit("nur "), F.date_format(day, "dd.MM."), F.lit(" abends"))]
    forms += [F.concat(F.dayofmonth(day).cast("string"), F.lit(". "), F.element_at(months, F.month(day)), F.lit(" um acht")), F.date_format(day, "yyyy-MM-dd")]
    forms += [F.concat(F.lit("Sa., "), F.dayofmonth(day).cast("string"), F.lit(". im Saal")), F.lit("5 Personen in 3.Raum 17")]
    said = F.element_at(F.array(*forms), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.regexp_count(said, F.lit(text.DATES)).alias("hits"), prepare.reject_reason(said, least=5).alias("reason"))


def sql_escaped(c: str) -> str:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


AGE = "DATE '2024-01-15' - date_start"


@query(
    f"""WITH {LISTING}, {TAGGED} SELECT ordinal, '<tr data-tags="region-' || region || ' art-' || kind || CASE WHEN date_end IS NOT NULL THEN ' laufend' ELSE '' END || '"><td>' || CAST(date_start AS VARCHAR) || CASE WHEN date_end IS NOT NULL THEN '<span class="date-end">bis ' || CAST(date_end AS VARCHAR) || '</span>' ELSE '' END
 || '</td><td>' || {sql_escaped('title')} || CASE WHEN date_end IS NOT NULL THEN '<span class="badge-laufend">l&auml;uft</span>' ELSE '' END || CASE WHEN date_start = DATE '2024-01-15' THEN '<span class="badge-new">neu</span>' ELSE '' END || CASE WHEN {AGE} > 10 THEN '<span class="badge-stale">seit ' || CAST({AGE} AS VARCHAR) || ' Tagen nicht best&auml;tigt</span>' ELSE '' END
 || '</td><td>' || {sql_escaped('location')} || '</td><td>' || {sql_escaped('description')} || '</td><td><a href="' || {sql_escaped('url')} || '">Link</a></td></tr>' AS html FROM tagged"""
)
def page_rows(spark, d):
    e = tagged(spark, d).withColumns({"first_seen": F.col("date_start"), "last_seen": F.col("date_start")})
    return e.select("ordinal", present.row_html(TODAY).alias("html"))


@query(
    f"""WITH {LISTING}, {TAGGED}, c AS (SELECT 'region' AS dim, region AS value, count(*) AS n FROM tagged GROUP BY region UNION ALL SELECT 'kind', kind, count(*) FROM tagged GROUP BY kind)
SELECT dim, '<button data-value="' || value || '">' || CASE value WHEN 'nord' THEN 'Norden' WHEN 'sued' THEN 'S&uuml;den' WHEN 'west' THEN 'Westen' ELSE upper(left(value, 1)) || substr(value, 2) END || ' <span class="count">' || CAST(n AS VARCHAR) || '</span></button>' AS html FROM c"""
)
def page_buttons(spark, d):
    return present.value_counts(tagged(spark, d)).select("dim", present.button_html({**TYPE_LABELS, **REGION_LABELS}).alias("html"))


@query("SELECT event_id, ['HTTP 404', 'Timeout', 'DNS unbekannt', 'TLS-Handshake', 'Verbindung fehlgeschlagen', 'Protokollfehler', 'ReadError', 'WriteTimeout'][event_id % 8 + 1] AS kind FROM events")
def fetch_problems(spark, d):
    """Errors as a fetch leaves them, grouped by kind."""
    cases = [("HTTPStatusError", "not found", 404), ("ReadTimeout", "", None), ("ConnectError", "[Errno -2] Name or service not known", None), ("ConnectError", "handshake failure", None), ("ConnectError", "refused", None)]
    cases += [("RemoteProtocolError", "x", None), ("ReadError", "SSL", None), ("WriteTimeout", "", None)]
    pick = lambda k, t: F.element_at(F.array(*[F.lit(c[k]).cast(t) for c in cases]), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", links.error_kind(pick(0, "string"), pick(1, "string"), pick(2, "int")).alias("kind"))


@query("SELECT page_id, url FROM pages WHERE page_id % 3 = 1 AND (contains(lower(url), 'example.org') OR contains(lower(url), '/de/'))")
def sources_of_a_run(spark, d):
    status = F.element_at(F.array(F.lit("disabled"), F.lit("active"), F.lit("candidate")), (F.col("page_id") % 3 + 1).cast("int"))
    return active_sources(table(spark, d, "pages").withColumn("status", status), [" Example.ORG ", "", "/DE/"]).select("page_id", "url")
