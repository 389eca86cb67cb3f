"""Queries on users beyond those of the small tables, and pages in bounded batches."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from almanac.operators import prepare

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_blocked_hosts_follow_the_users(spark, tmp_path):
    """One user in seven is blocked, whatever the numbers of users."""
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    far = e.withColumns({"user_id": F.col("user_id") + 7000, "event_id": F.col("event_id") + 10_000_000})
    e.unionByName(far).write.parquet(f"{tmp_path}/events.parquet")
    out = entry.queries()["feed_events"](spark, str(tmp_path)).select(F.regexp_extract("page_url", "u([0-9]+)", 1).cast("long").alias("u"), "pos")
    n = F.count(F.lit(1)).alias("n")
    users = e.unionByName(far).where("user_id % 7 <> 0").groupBy(F.col("user_id").alias("u")).agg(n).where("n >= 3").withColumn("n", F.least("n", F.lit(60)).cast("long"))
    got = sorted(map(tuple, out.groupBy("u").agg(n).collect()))
    assert got == sorted(map(tuple, users.collect())) and got[0][0] < 3000 < got[-1][0]


def test_pages_come_in_bounded_batches(spark):
    before = spark.conf.get(KEY)
    try:
        spark.conf.set(KEY, "10000")
        rows = spark.range(5000).coalesce(1).select("id", F.concat(F.lit("<p>x</p>"), "id").alias("html"))
        assert prepare.with_text(rows).where(F.col("text") != F.concat(F.lit("x "), "id")).count() == 0
        assert int(spark.conf.get(KEY)) <= 2000
    finally:
        spark.conf.set(KEY, before)
