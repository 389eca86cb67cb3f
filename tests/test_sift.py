"""Rows that meet no other stay where they lie: bitmaps of keys come before the joins of title links."""

from pyspark.sql import functions as F

from almanac.operators import resolve, tables


def test_sift_keeps_what_is_wanted_and_little_else(spark):
    rows = spark.range(0, 60_000).select((F.col("id") * 7919 - 500_000).alias("k"), F.lit("x").alias("_at"))
    wanted = rows.where("k % 3 = 0").select("k")
    out = tables.sift(rows.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, 'x' AS _at")), "k", wanted.unionByName(wanted))
    assert out.columns == rows.columns and out.where("k IS NULL").isEmpty()
    assert wanted.join(out, "k", "left_anti").isEmpty()
    assert 20_000 <= out.count() < 22_000
    assert tables.sift(rows, "k", wanted.limit(0)).isEmpty()


def test_sift_full_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(tables, "SIFT_MOST", tables.BITMAP)
    rows = spark.range(0, 200_000).select(F.xxhash64("id").alias("k"))
    assert tables.sift(rows, "k", rows).count() == 200_000


def test_keys_of_one_title_are_not_joined(spark, monkeypatch):
    """Words that a short and a long title share make keys that no two titles have."""
    seen, real = [], resolve.join_hot
    monkeypatch.setattr(resolve, "join_hot", lambda rows, table, keys, *more: seen.append((keys, rows.count())) or real(rows, table, keys, *more))
    words = [[f"w{i}x{j}" for j in range(40)] for i in range(50)]
    sets = [w for w in words] + [w[:3] for w in words] + [words[0][:39] + ["anders"]]
    titles = tables.materialize(spark.createDataFrame([("", i, w) for i, w in enumerate(sets)], "block string, id long, t_tokens array<string>"), "test")
    keys = resolve.word_keys(titles)
    n = keys.count()
    assert {tuple(r) for r in resolve.met_by_words(keys).collect()} == {(0, 100)}
    shared = keys.groupBy("key").count().where("count > 1").agg(F.sum("count")).first()[0]
    assert shared < n / 2 and [m for k, m in seen if k == ["key"]][0] < shared + n / 10
