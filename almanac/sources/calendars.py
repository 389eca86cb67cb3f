"""Calendar feeds: finding them in pages and reading their events."""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.functions.dates import calendar_date
from almanac.functions.entities import unescape
from almanac.functions.links import host
from almanac.functions.text import strip
from almanac.operators.tables import spare
from almanac.settings import FEED_BLOCKLIST, GENERATOR_FEEDS, GENERATOR_HINT, MAX_DESCRIPTION, MAX_FEED_CANDIDATES, MAX_FEED_EVENTS, MAX_ICS_LINKS, MIN_FEED_EVENTS

#: Characters of a page in which a generator's mark is looked for.
HINT_LENGTH = 200_000


class _Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.head, self.ics, self.generator = [], [], None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "link" and "href" in a:
            kind, rel = a.get("type", "").lower(), " ".join(a.get("rel", "").split()).lower()
            if "text/calendar" in kind or "alternate" in rel and "ical" in kind:
                self.head.append(a["href"])
        elif tag == "a" and a.get("href", "").lower().split("?")[0].endswith(".ics"):
            self.ics.append(a["href"])
        elif tag == "meta" and a.get("name") == "generator" and self.generator is None:
            self.generator = a.get("content", "").lower()


def feeds_of(raw: str | None, page_url: str) -> list[str]:
    """Absolute feed URLs, the most trusted first: declared in the head, linked if few, known by the generator."""
    if raw is None:
        return []
    p = _Links()
    p.feed(raw)
    found = [*p.head, *(p.ics if len(p.ics) <= MAX_ICS_LINKS else [])]
    hint = raw[:HINT_LENGTH].lower()
    for mark, suffix in GENERATOR_FEEDS:
        if mark in (p.generator or "") or f'"{mark}"' in hint or GENERATOR_HINT in hint:
            found.append(page_url + (suffix.replace("?", "&") if "?" in page_url else suffix))
            break
    whole = [urljoin(page_url, u.strip()) for u in found if u]
    return list(dict.fromkeys(u for u in whole if u.startswith(("http://", "https://"))))


@F.pandas_udf(T.ArrayType(T.StringType()))
def find_feeds(raw: pd.Series, page_url: pd.Series) -> pd.Series:
    return pd.Series([feeds_of(r, u) for r, u in zip(raw, page_url)])


def unfold(text: Column) -> Column:
    """Lines, with folded ones joined."""
    return F.split(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n[ \t]", ""), "\n")


def without_escapes(s: Column) -> Column:
    for a, b in (("\\n", " "), ("\\N", " "), ("\\,", ","), ("\\;", ";"), ("\\\\", "\\")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def one_line(s: Column) -> Column:
    return strip(F.regexp_replace(s, r"(?U)\s+", " "))


def read_calendar(feeds: DataFrame, most: int = MAX_FEED_EVENTS) -> DataFrame:
    """feeds (feed_url, page_url, body) to rows (feed_url, page_url, pos, title, date_start,
    date_end, location, description, url), the first `most` events of each body.

    Native but for entities: lines are split, an event is what stands between its begin and end, and of
    a property that repeats the last value counts. Events need a title and a first day.
    """
    whole = F.array_join(F.transform(unfold(F.col("body")), strip), "\n")
    body = F.split(whole, "(?i)(?<=^|\n)BEGIN:VEVENT(?=\n|$)")
    blocks = feeds.select("feed_url", "page_url", F.posexplode(F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0)))).alias("block", "text"))
    ended = blocks.where(F.rlike("text", F.lit("(?i)(^|\n)END:VEVENT(\n|$)"))).withColumn("text", F.get(F.split(F.col("text"), "(?i)(?<=^|\n)END:VEVENT(?=\n|$)"), F.lit(0)))

    def prop(name: str) -> Column:
        all_ = F.regexp_extract_all(F.concat(F.lit("\n"), F.col("text")), F.lit(f"(?i)\n{name}(?:;[^:\n]*)?:([^\n]*)"), F.lit(1))
        return F.get(all_, F.size(all_) - 1)

    raw = ended.select("feed_url", "page_url", "block", *[prop(n).alias(n.lower()) for n in ("SUMMARY", "LOCATION", "DESCRIPTION", "URL", "DTSTART", "DTEND")])
    texts = ("summary", "location", "description", "url")
    raw = raw.withColumns({c: one_line(unescape(without_escapes(F.coalesce(c, F.lit(""))))) for c in texts})
    rows = raw.withColumns({"s": calendar_date(F.col("dtstart")), "e": calendar_date(F.col("dtend"))})
    start = F.col("s.day")
    end = F.when(F.col("s.all_day"), F.date_sub("e.day", 1)).otherwise(F.col("e.day"))
    built = rows.where((F.col("summary") != "") & start.isNotNull()).select(
        "feed_url", "page_url", "block", F.col("summary").alias("title"), start.alias("date_start"), F.when(end > start, end).alias("date_end"), "location",
        F.left("description", F.lit(MAX_DESCRIPTION)).alias("description"), F.when(F.rlike("url", F.lit("^https?://")), F.col("url")).otherwise(F.col("page_url")).alias("url"),
    )
    order = Window.partitionBy("feed_url", "page_url").orderBy("block")
    return built.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= most).drop("block")


def unblocked(pages: DataFrame, blocked: Sequence[str] | DataFrame = FEED_BLOCKLIST) -> DataFrame:
    """Pages whose host is not blocked. blocked: hosts, or a table (host) of any size."""
    if isinstance(blocked, DataFrame):
        (name,) = spare(pages, "_host")
        return pages.withColumn(name, host(F.col("url"))).join(blocked.select(F.col("host").alias(name)), name, "left_anti").drop(name)
    return pages.where(~host(F.col("url")).isin(list(blocked))) if blocked else pages


def feed_events(pages: DataFrame, bodies: DataFrame, blocked: Sequence[str] | DataFrame = FEED_BLOCKLIST, least: int = MIN_FEED_EVENTS) -> DataFrame:
    """Events of the best feed of each page (url, html): of its first candidates, whose bodies
    (feed_url, body) have been fetched, the one with most events, the first of equals, if it has enough."""
    found = unblocked(pages, blocked).select(F.col("url").alias("page_url"), F.posexplode(F.slice(find_feeds("html", "url"), 1, MAX_FEED_CANDIDATES)).alias("rank", "feed_url"))
    landed = found.join(bodies.where(F.contains(F.upper("body"), F.lit("BEGIN:VCALENDAR"))), "feed_url")
    events = read_calendar(landed).join(found, ["page_url", "feed_url"])
    counted = events.groupBy("page_url", "feed_url", "rank").count().where(F.col("count") >= least)
    best = counted.groupBy("page_url").agg(F.max_by("feed_url", F.struct("count", -F.col("rank"))).alias("feed_url"))
    return events.join(best, ["page_url", "feed_url"], "left_semi").drop("rank")
