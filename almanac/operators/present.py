"""Views of the store: badges, order, counts, filters and leave-one-out facets."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.classify import event_tags
from almanac.functions.dates import effective_end
from almanac.functions.text import capitalize_label, escape_html
from almanac.settings import REGION_LABELS, STALE_AFTER_DAYS, TYPE_LABELS

WINDOWS = (7, 30, 90)


def with_badges(events: DataFrame, today: date, stale: int = STALE_AFTER_DAYS) -> DataFrame:
    day = F.lit(today)
    return events.withColumns(
        {
            "is_running": F.col("date_end").isNotNull(),
            "is_new": F.coalesce(F.col("first_seen") == day, F.lit(False)),
            "is_stale": F.coalesce(F.datediff(day, "last_seen") > stale, F.lit(False)),
        }
    )


def current(events: DataFrame, today: date) -> DataFrame:
    return events.where(effective_end() >= F.lit(today))


def listing_key(today: date) -> list[Column]:
    return [F.greatest("date_start", F.lit(today)), F.col("date_start"), F.col("ordinal")]


def listed(events: DataFrame, today: date) -> DataFrame:
    """Events in the order of the page."""
    return events.orderBy(*listing_key(today))


def in_window(today: date, days: int) -> Column:
    return (F.col("date_start") <= F.date_add(F.lit(today), days)) & (effective_end() >= F.lit(today))


def value_counts(events: DataFrame, dims: Sequence[str] = ("region", "kind")) -> DataFrame:
    """(dim, value, n) for every dimension, in one scan."""
    sets = events.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"_{d}") for d in dims])
    dim, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        dim, value = F.when(F.col(f"_{d}") == 0, d).otherwise(dim), F.when(F.col(f"_{d}") == 0, F.col(d)).otherwise(value)
    return sets.select(dim.alias("dim"), value.alias("value"), "n")


def ranked_counts(counts: DataFrame) -> DataFrame:
    """Counts with their place in the row of buttons: by falling count, then by name."""
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("n"), "value")))


def predicates(today: date, search: str = "", region: str = "", kind: str = "", days: int = 0) -> dict[str, Column]:
    """The filter of each dimension; an empty value lets everything pass."""
    text = F.lower(F.concat_ws(" ", "title", "location", "description"))
    return {
        "search": F.contains(text, F.lit(search.lower())) if search else F.lit(True),
        "region": F.col("region") == region if region else F.lit(True),
        "kind": F.col("kind") == kind if kind else F.lit(True),
        "time": in_window(today, days) if days else F.lit(True),
    }


def visible(events: DataFrame, today: date, **choice) -> DataFrame:
    p = predicates(today, **choice)
    return events.where(p["search"] & p["region"] & p["kind"] & p["time"])


def facets(events: DataFrame, today: date, **choice) -> DataFrame:
    """(dim, value, n): for each value, the events that pass it and the filters of all other dimensions.

    One scan: every event gives a row for its region, one for its kind and one for each window that it
    lies in, each with whether the other filters let it pass; tasks sum these before they shuffle.
    """
    p = predicates(today, **choice)

    def others(dim: str) -> Column:
        out = F.lit(True)
        for k, c in p.items():
            out = out & c if k != dim else out
        return F.coalesce(out, F.lit(False)).cast("long")

    row = lambda dim, value, ok: F.struct(F.lit(dim).alias("dim"), value.alias("value"), ok.alias("ok"))
    times = [row("time", F.lit(str(d)), F.coalesce(in_window(today, d), F.lit(False)).cast("long") * F.col("_time")) for d in WINDOWS]
    each = F.array(row("region", F.col("region"), F.col("_region")), row("kind", F.col("kind"), F.col("_kind")), *times)
    passed = events.withColumns({f"_{d}": others(d) for d in ("region", "kind", "time")})
    return passed.select(F.explode(each).alias("x")).groupBy("x.dim", "x.value").agg(F.sum("x.ok").alias("n"))


def row_html(today: date, stale: int = STALE_AFTER_DAYS) -> Column:
    """One event as a row of the page's table: escaped texts, a guarded link, badges."""
    text = lambda c: escape_html(F.coalesce(F.col(c).cast("string"), F.lit("")))
    age = F.datediff(F.lit(today), "last_seen")
    link = F.when(F.rlike("url", F.lit("^https?://")), text("url")).otherwise("#")
    badge = F.concat(
        F.when(F.col("date_end").isNotNull(), '<span class="badge-laufend">l&auml;uft</span>').otherwise(""),
        F.when(F.col("first_seen") == F.lit(today), '<span class="badge-new">neu</span>').otherwise(""),
        F.when(age > stale, F.concat(F.lit('<span class="badge-stale">seit '), age.cast("string"), F.lit(" Tagen nicht best&auml;tigt</span>"))).otherwise(""),
    )
    end = F.when(F.col("date_end").isNotNull(), F.concat(F.lit('<span class="date-end">bis '), text("date_end"), F.lit("</span>"))).otherwise("")
    cells = [F.concat(text("date_start"), end), F.concat(text("title"), badge), text("location"), text("description"), F.concat(F.lit('<a href="'), link, F.lit('">Link</a>'))]
    tags = F.array_join(event_tags(F.col("region"), F.col("kind"), F.col("date_end")), " ")
    return F.concat(F.lit('<tr data-tags="'), tags, F.lit('"><td>'), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>"))


def button_html(labels: dict[str, str]) -> Column:
    """A filter's button: the value's label, else the value in capitals, and its count."""
    label = capitalize_label(F.col("value"), labels)
    return F.concat(F.lit('<button data-value="'), F.col("value"), F.lit('">'), label, F.lit(' <span class="count">'), F.col("n").cast("string"), F.lit("</span></button>"))


def write_page(events: DataFrame, today: date, path: str) -> None:
    """Writes the rows of the page, in its order, and the buttons of both filters as text below path."""
    events.withColumn("html", row_html(today)).orderBy(*listing_key(today)).select("html").write.mode("overwrite").text(f"{path}/rows")
    counts = ranked_counts(value_counts(events))
    labels = {**TYPE_LABELS, **REGION_LABELS}
    counts.select("dim", "place", button_html(labels).alias("html")).orderBy("dim", "place").select("html").write.mode("overwrite").text(f"{path}/buttons")
