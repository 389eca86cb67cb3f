"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: space and the code points 9 to 13.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is
    unset and the master is local, a temporary folder of this session. A cluster must name one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="almanac-")
    return _own_dirs[app]


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts the lineage and
    survives lost executors. The files go when the driver ends, or by drop(). options: of the writer."""
    path = f"{shared_dir(df.sparkSession)}/almanac-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._almanac_path = path
    atexit.register(_quiet_drop, df.sparkSession, path)
    return out


def drop(df: DataFrame) -> None:
    """Deletes what materialize() wrote; df must not be used any more."""
    _delete(df.sparkSession, df._almanac_path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _quiet_drop(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session has ended; its cleaner owns the folder
        pass


#: Bounds of a batch of rows that Spark hands to Python at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the batches that Python workers hold, by rows and bytes, for this session; Spark's own bound
    is 10,000 rows, however long. Smaller settings of the session stay."""
    for key, most in BATCH.items():
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= int(most):
            spark.conf.set(key, most)


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def count_chars(text: Column, chars: str) -> Column:
    """How many code points of a text are in the plain string chars."""
    left = text
    for c in chars:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.length(text) - F.length(left)).cast("long")


def crc32_bucket(key: str, n: int) -> Column:
    """crc32 of a column's text form modulo n; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names built on names that clash with none of df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component) for every node that
    is not the smallest of its component; component is the smallest node.

    Alternates large-star and small-star steps until nothing changes. A step needs the smallest
    neighbour of each node, which tasks find before they shuffle; a node with very many edges meets
    it by join_hot(). Each round is written to the shared folder. Edges never come to the driver,
    only their count and checksum.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    def neighbours(e: DataFrame) -> DataFrame:
        return materialize(e.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "neighbours")

    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = materialize(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    before, seen = None, state(now)
    while seen != before:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = neighbours(both)
        large = join_hot(both, least, ["a"]).select("a", "b", F.least("a", "m").alias("m")).where("b > a")
        large = materialize(large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        first = neighbours(large)
        small = join_hot(large, first, ["a"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = materialize(small.union(first.select("a", F.col("m").alias("b"))).distinct(), "edges")
        for df in (least, large, first, now):
            drop(df)
        now, before, seen = nxt, seen, state(nxt)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


#: A key that has more than one in so many of all rows is hot; so there are fewer hot keys than that.
HOT = 256


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", n: str = "n") -> DataFrame:
    """rows joined, inner or left, with a written table that has one row for each key and in column n how many
    of rows have it. Hot keys, fewer than HOT, are told apart by a hash and broadcast, so that their
    rows stay where they are; all others meet by a shuffle, in which no key is large. n is dropped."""
    total, most = table.agg(F.sum(n), F.max(n)).first()
    edge = max(1, (total or 0) / HOT)
    if (most or 0) <= edge:
        return rows.join(table.drop(n).hint("merge"), keys, how)
    name = F.xxhash64(*keys)
    hot = name.isin([r[0] for r in table.where(F.col(n) > edge).select(name).collect()])
    apart = rows.where(hot).join(F.broadcast(table.where(hot).drop(n)), keys, how)
    return apart.unionByName(rows.where(~hot).join(table.where(~hot).drop(n).hint("merge"), keys, how))


#: Tables of up to so many rows, of a few numbers each, are broadcast; they are counted first.
SMALL_ROWS = 50_000
#: Beyond that, a key of a table is dealt to so many tasks.
SALTS = 32


def join_small(rows: DataFrame, table: DataFrame, cond: Column, how: str = "inner", by: Column | None = None) -> DataFrame:
    """rows joined with a written table that has one row for each key: broadcast if its count is
    small, else dealt by key and a salt, so that a key with very many rows goes to several tasks.
    by: what the salt is a hash of, needed where rows come from a shuffle, whose order a task that
    is run again may not find; rows of a scan get random salts."""
    if table.count() <= SMALL_ROWS:
        return rows.join(F.broadcast(table), cond, how)
    salt, copy = spare(rows, "_salt", "_copy")
    rows = rows.withColumn(salt, (F.floor(F.rand(7) * SALTS) if by is None else F.pmod(F.xxhash64(by), F.lit(SALTS))).cast("int"))
    table = table.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(table, cond & (F.col(salt) == F.col(copy)), how).drop(salt, copy)
