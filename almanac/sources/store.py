"""The event store: JSON in, versions by manifest over shared Parquet files, reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.schemas import EVENT_COLUMNS, EVENTS, STORE_JSON


def read_json_store(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of events by id; their order in it becomes ordinal."""
    one = spark.read.text(path, wholetext=True).select(F.map_entries(F.from_json("value", STORE_JSON)).alias("m"))
    rows = one.select(F.posexplode("m").alias("ordinal", "x")).select(F.col("x.key").alias("id"), F.col("ordinal").cast("long"), "x.value.*")
    days = {c: F.col(c).try_cast("date") for c in ("date_start", "date_end", "first_seen", "last_seen")}
    return rows.withColumns(days).select(*EVENT_COLUMNS)


#: Days of a bucket of a store; and files of one bucket and versions that compact() and expire() leave.
BUCKET_DAYS, MOST_FILES, KEPT_VERSIONS = 7, 8, 10
#: The bucket of rows without a first day.
NO_DAY = -(1 << 30)


def bucket_of(day: Column, days: int = BUCKET_DAYS) -> Column:
    return F.coalesce(F.floor(F.unix_date(day) / days).cast("int"), F.lit(NO_DAY))


class EventStore:
    """Versions of a store of events below root. Rows lie in buckets of first days; a version is one manifest, which names the
    files of each bucket and what is known of it: rows, the least and the greatest last day, and the days on
    which rows end. Versions share the files of buckets that did not change.

    A manifest appears by a rename after all its files are there, so a version is complete or it is none, whatever a
    crash leaves behind; two writers can't make the same version. Files are never changed; those that no version
    names any more go by expire().
    """

    def __init__(self, spark: SparkSession, root: str, days: int = BUCKET_DAYS):
        self.spark, self.root, self.days = spark, root.rstrip("/"), days
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[str]:
        """Names of the versions, the newest last: a number and a label."""
        return [n.removesuffix(".json") for n in self._names("versions") if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: str | None = None) -> dict:
        """{bucket: {files, rows, least, greatest, ends}} of a version, else of the newest; empty if there is none."""
        done = self.versions()
        if not done:
            return {}
        text = self.spark.read.text(f"{self.root}/versions/{version or done[-1]}.json", wholetext=True).first()[0]
        return {int(k): v for k, v in json.loads(text)["buckets"].items()}

    def read(self, version: str | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The events of a version, of all its buckets or of some: only their files are opened."""
        of = self.manifest(version)
        files = [f"{self.root}/data/{f}" for b in (of if buckets is None else set(buckets) & set(of)) for f in of[b]["files"]]
        return self.spark.read.schema(EVENTS).parquet(*sorted(files)) if files else self.spark.createDataFrame([], EVENTS)

    def touched(self, batch: DataFrame) -> set[int]:
        """Buckets of rows that rows of a batch can meet, which share a first or a last day with them; rows that share an id share
        the first day. The driver gets the days of the batch, not its rows."""
        days = batch.select(F.explode(F.array(F.struct(F.lit("s").alias("k"), bucket_of(F.col("date_start"), self.days).alias("d")), F.struct(F.lit("e").alias("k"), F.unix_date("date_end").alias("d")))).alias("x"))
        found = {(r.k, r.d) for r in days.select("x.k", "x.d").where("d IS NOT NULL").distinct().collect()}
        return {b for b, x in self.manifest().items() if ("s", b) in found or any(("e", d) in found for d in x["ends"])}

    def over(self, today: date) -> tuple[set[int], set[int]]:
        """(buckets all of whose events are over, buckets of which some are)."""
        day = (today - date(1970, 1, 1)).days
        of = self.manifest()
        gone = {b for b, x in of.items() if x["greatest"] is not None and x["greatest"] < day and x["dated"]}
        return gone, {b for b, x in of.items() if x["least"] is not None and x["least"] < day} - gone

    def write(self, events: DataFrame, label: str = "run") -> str:
        """A version of these events alone."""
        return self._commit(self._put(events), label)

    def replace(self, buckets: Iterable[int], events: DataFrame, label: str = "run") -> str:
        """A version with these events in place of those of some buckets; the files of all others stay as they are, and events
        that belong to one of them are put beside."""
        gone = set(buckets)
        of = {b: x for b, x in self.manifest().items() if b not in gone}
        for b, x in self._put(events).items():
            old = of.get(b)
            of[b] = x if old is None else self._joined(old, x)
        return self._commit(of, label)

    @staticmethod
    def _joined(a: dict, b: dict) -> dict:
        ends = [x for x in (a["least"], b["least"]) if x is not None], [x for x in (a["greatest"], b["greatest"]) if x is not None]
        return {"files": a["files"] + b["files"], "rows": a["rows"] + b["rows"], "least": min(ends[0], default=None), "greatest": max(ends[1], default=None), "ends": sorted({*a["ends"], *b["ends"]}), "dated": a["dated"] and b["dated"]}

    def _put(self, events: DataFrame) -> dict:
        name = uuid.uuid4().hex
        rows = events.select(*EVENT_COLUMNS, bucket_of(F.col("date_start"), self.days).alias("bucket"))
        rows.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.root}/data/{name}")
        out = {}
        for folder in self._names(f"data/{name}"):
            if folder.startswith("bucket="):
                files = [f"{name}/{folder}/{f}" for f in self._names(f"data/{name}/{folder}") if f.endswith(".parquet")]
                out[int(folder.removeprefix("bucket="))] = {"files": files}
        if out:
            last = F.unix_date(F.coalesce("date_end", "date_start"))
            facts = [F.count(F.lit(1)).alias("rows"), F.min(last).alias("least"), F.max(last).alias("greatest"), F.array_sort(F.collect_set(F.unix_date("date_end"))).alias("ends"), F.bool_and(last.isNotNull()).alias("dated")]
            for r in self.spark.read.schema(f"{EVENTS}, bucket int").parquet(f"{self.root}/data/{name}").groupBy("bucket").agg(*facts).collect():
                out[r.bucket].update({k: v for k, v in r.asDict().items() if k != "bucket"})
        return out

    def _commit(self, buckets: dict, label: str) -> str:
        done = self.versions()
        name = f"v{int(done[-1][1:13]) + 1 if done else 1:012d}-{label}"
        if any(v[:13] == name[:13] for v in done):
            raise ValueError(f"{name[:13]} is there already")
        folder, part = f"{self.root}/versions", self._path(f"{self.root}/versions/.{name}-{uuid.uuid4().hex}")
        self._fs.mkdirs(self._path(folder))
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps({"buckets": {str(k): buckets[k] for k in sorted(buckets)}}).encode()))
        out.close()
        if not self._fs.rename(part, self._path(f"{folder}/{name}.json")):
            raise OSError(f"{name} could not be put in place")
        return name

    def compact(self, most: int = MOST_FILES) -> str | None:
        """A version in which no bucket has more than `most` small files beside each other; None if none has."""
        many = [b for b, x in self.manifest().items() if len(x["files"]) > most]
        return self.replace(many, self.read(buckets=many), "compact") if many else None

    def expire(self, keep: int = KEPT_VERSIONS) -> int:
        """Drops all but the newest versions and the files that none of these names; how many files went. Only what a version
        that goes has named is deleted, so files that another writer is about to name stay."""
        done = self.versions()
        named = lambda vs: {f for v in vs for x in self.manifest(v).values() for f in x["files"]}
        old = done[: max(0, len(done) - keep)]
        gone = named(old) - named(done[len(old) :])
        for v in old:
            self._fs.delete(self._path(f"{self.root}/versions/{v}.json"), False)
        for f in gone:
            self._fs.delete(self._path(f"{self.root}/data/{f}"), False)
        return len(gone)


def versions(spark: SparkSession, root: str) -> list[str]:
    return EventStore(spark, root).versions()


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """The newest version; an empty store if there is none."""
    return EventStore(spark, root).read()


def write_store(events: DataFrame, root: str, label: str = "run") -> str:
    """Writes a new version and returns its name, a number above all others and the label."""
    return EventStore(events.sparkSession, root).write(events, label)


def write_rejects(rejects: DataFrame, path: str) -> None:
    rejects.write.mode("overwrite").json(path)


def problem_report(problems: DataFrame) -> DataFrame:
    """problems (kind, url) to (kind, n, urls), with a total in the row whose kind is null."""
    return problems.rollup("kind").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("url")).alias("urls")).orderBy(F.col("kind").asc_nulls_last())


def active_sources(sources: DataFrame, terms: list[str] = ()) -> DataFrame:
    """Active sources whose URL contains one of the terms, if there are any."""
    keep: Column = F.lit(True)
    if low := [t.strip().lower() for t in terms if t.strip()]:
        keep = F.exists(F.array(*[F.lit(t) for t in low]), lambda t: F.contains(F.lower("url"), t))
    return sources.where((F.col("status") == "active") & keep)
