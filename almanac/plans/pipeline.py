"""A full run: pages and feeds in, a new version of the store and its reports out."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions.classify import Labels, TopicRules, event_kind, event_region, topic_reason
from almanac.functions.dates import effective_end, parse_date, period
from almanac.functions.text import decode_entities, strip, strip_fence
from almanac.operators import budget, present, resolve, tables
from almanac.operators.prepare import condense, reject_reason, with_text
from almanac.schemas import EVENT_COLUMNS, REPLY
from almanac.settings import EVENT_TYPES, REGIONS
from almanac.sources.store import EventStore, read_store, write_rejects, write_store


@dataclass
class Result:
    store: DataFrame
    rejects: DataFrame
    stats: DataFrame


def prepare_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages (ordinal, url, html): (condensed texts of those worth reading, (kind, url) of the others)."""
    texts = with_text(pages).select("ordinal", "url", "text").withColumn("kind", reject_reason(F.col("text")))
    return condense(texts.where("kind IS NULL").drop("kind")), texts.where("kind IS NOT NULL").select("kind", "url")


def batches(pages: DataFrame, today: date, most: int = budget.MAX_REQUESTS) -> DataFrame:
    day = pages.sparkSession.range(1).select(period(F.lit(today))).first()[0]
    return budget.plan_batches(pages, day, most)


def read_replies(replies: DataFrame, placed: DataFrame) -> DataFrame:
    """replies (batch_id, reply) joined with the pages of each batch by position. A reply that is
    cut off or no JSON gives no event; events without a page of the batch go."""
    parsed = replies.select("batch_id", F.from_json(strip_fence(F.col("reply")), REPLY).alias("r"))
    events = parsed.select("batch_id", F.posexplode("r.events").alias("row", "e")).select("batch_id", "row", "e.*")
    pages = placed.where("batch_id IS NOT NULL").select("batch_id", F.col("pos").alias("source_id"), "url")
    return events.join(pages, ["batch_id", "source_id"])


def judge(events: DataFrame, today: date, rules: TopicRules = TopicRules()) -> DataFrame:
    """events with texts as dates: parsed days and verdict, one of ok, datum_ungueltig, vergangen,
    thema_verfehlt, and the reason."""
    rows = decode_entities(events, ("title", "location", "description")).withColumns({c: strip(F.col(c)) for c in ("title", "location", "description")})
    rows = rows.withColumns({"date_start": parse_date(F.col("date_start").cast("string")), "date_end": parse_date(F.col("date_end").cast("string"))})
    rows = rows.withColumn("_t", topic_reason(F.col("title"), F.col("description"), F.col("location"), F.col("url"), rules))
    verdict = F.when(F.col("date_start").isNull(), "datum_ungueltig").when(effective_end() < F.lit(today), "vergangen").when(~F.col("_t.relevant"), "thema_verfehlt").otherwise("ok")
    return rows.withColumns({"verdict": verdict, "reason": F.col("_t.reason")}).drop("_t")


def reject_log(judged: DataFrame) -> DataFrame:
    """Events off topic with reason and origin; titles of private events are left out."""
    private = F.startswith(F.col("reason"), F.lit("einzelne Bestattung"))
    return judged.where("verdict = 'thema_verfehlt'").select(F.when(private, F.lit("[privat]")).otherwise(F.col("title")).alias("title"), "date_start", "location", "url", F.col("reason").alias("_grund"), F.col("origin").alias("_herkunft"))


COUNTERS = ("neu", "aktualisiert", "datum_ungueltig", "vergangen", "thema_verfehlt", "zusammengefuehrt", "entfernt", "manuell_abgelaufen")


def run(store: DataFrame, incoming: DataFrame, today: date, rules: TopicRules = TopicRules(), types: Labels = EVENT_TYPES) -> Result:
    """incoming: events with texts as dates, origin and ordinal, in the order manual, feed, api.

    Purge of private events and dedup of the store, filters, upsert, dedup again, expiry. Hand-kept
    events that are over are counted by themselves, as they stay in their list.
    """
    kept = resolve.deduplicate(store.where(~F.rlike(F.coalesce("title", F.lit("")), F.lit(rules.private))), types)
    over = (F.col("origin") == "manuell") & (F.coalesce(parse_date(F.col("date_end")), parse_date(F.col("date_start"))) < F.lit(today))
    judged = tables.materialize(judge(incoming.withColumn("over", F.coalesce(over, F.lit(False))), today, rules), "judged")
    good = judged.where("verdict = 'ok' AND NOT over").withColumns({"id": F.lit(None).cast("string"), "first_seen": F.lit(None).cast("date"), "last_seen": F.lit(None).cast("date")})
    top = kept.agg(F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).first()[0]
    folded = tables.materialize(resolve.upsert(kept, good.withColumn("ordinal", F.col("ordinal") + top).select(*EVENT_COLUMNS), today, types), "upserted")
    final = resolve.deduplicate(folded.select(*EVENT_COLUMNS), types)
    left = present.current(final, today)
    counts = judged.agg(*[F.count_if((F.col("verdict") == v) & ~F.col("over")).alias(v) for v in ("datum_ungueltig", "vergangen", "thema_verfehlt")], F.count_if("over").alias("manuell_abgelaufen"))
    done = folded.agg(F.coalesce(F.sum("n_new"), F.lit(0)).alias("neu"), F.coalesce(F.sum("n_updated"), F.lit(0)).alias("aktualisiert"), F.count(F.lit(1)).alias("_n"))
    end = final.agg(F.count(F.lit(1)).alias("_m"), F.count_if(effective_end() < F.lit(today)).alias("entfernt"))
    # three tables of one row each
    stats = done.join(counts, F.lit(True)).join(end, F.lit(True)).withColumn("zusammengefuehrt", F.col("_n") - F.col("_m")).select(*COUNTERS)
    return Result(left, reject_log(judged.where("NOT over")), stats)


def run_incremental(store: EventStore, incoming: DataFrame, today: date, rules: TopicRules = TopicRules(), types: Labels = EVENT_TYPES, label: str = "run") -> Result:
    """run() on the rows of the store that incoming can touch, and a new version of the store with their outcome.

    Rows that share neither a first nor a last day with an incoming row meet none, so only buckets with such days are
    read and written anew, with those of which some events are over; buckets that are over as a whole are dropped
    unread, and all other files go on as they are. What is not read stays as its last dedup left it.
    """
    good = tables.materialize(judge(incoming, today, rules).where("verdict = 'ok'").select("date_start", "date_end"), "incoming-days")
    gone, some = store.over(today)
    open_ = (store.touched(good) | some) - gone
    result = run(store.read(buckets=open_), incoming, today, rules, types)
    dropped = sum(x["rows"] for b, x in store.manifest().items() if b in gone)
    store.replace(open_ | gone, result.store, label)
    return Result(result.store, result.rejects, result.stats.withColumn("entfernt", F.col("entfernt") + dropped))


def publish(result: Result, root: str, today: date, regions: Labels = REGIONS, types: Labels = EVENT_TYPES, dry_run: bool = False) -> None:
    """Writes the reject log, and, unless it is a dry run, a new version of the store and the page, below root.
    A staging run is one with a root of its own and an empty store."""
    write_rejects(result.rejects, f"{root}/rejects")
    if not dry_run:
        write_store(result.store, f"{root}/store")
        render(result.store.sparkSession, root, today, regions, types)


def render(spark: SparkSession, root: str, today: date, regions: Labels = REGIONS, types: Labels = EVENT_TYPES) -> bool:
    """Writes the page anew from the store below root, which it leaves alone; False if there is nothing to show."""
    store = read_store(spark, f"{root}/store")
    if store.isEmpty():
        return False
    present.write_page(tagged(store, regions, types), today, f"{root}/page")
    return True


def tagged(events: DataFrame, regions: Labels = REGIONS, types: Labels = EVENT_TYPES) -> DataFrame:
    """events with the region and kind that filters and the page use."""
    return events.withColumns({"region": event_region(F.col("location"), F.col("url"), regions), "kind": event_kind(F.col("title"), F.col("description"), types)})
