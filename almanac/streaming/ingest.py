"""Micro-batches of events into the versioned store, by foreachBatch."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from almanac.functions.classify import TopicRules
from almanac.plans.pipeline import run_incremental
from almanac.sources.store import EventStore


def ingest_stream(events: DataFrame, root: str, checkpoint: str, today: date, rules: TopicRules = TopicRules()) -> StreamingQuery:
    """Runs every micro-batch of events against the buckets of the newest version that it touches and writes the next,
    labelled with the stream's id and the batch's number; then buckets of many files are made anew and old versions
    go. A batch whose version is there already is not run again, so a
    batch that is tried again is merged once; a stream with a new checkpoint has a new id and goes on from
    what the store holds."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        label = f"{stream}-{number}"
        store = EventStore(spark, root)
        if not any(v.endswith(label) for v in store.versions()):
            run_incremental(store, batch, today, rules, label=label)
            store.compact()
            store.expire()

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
