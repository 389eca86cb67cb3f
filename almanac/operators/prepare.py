"""From pages to condensed texts: HTML to text, the gate, passages around matches."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.functions.text import DATES
from almanac.operators.tables import bounded_batches, join_hot, materialize, spare
from almanac.settings import GAP, MAX_HITS_PER_PAGE, MIN_TEXT_LENGTH, SNIPPET_AFTER, SNIPPET_BEFORE, TEXT_LIMIT

# Elements whose text does not count.
DROPPED = frozenset("script style nav footer header aside form noscript".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Text(HTMLParser):
    """Collects stripped texts of the whole page, of the first main and of the first article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.texts: dict[str, list[str]] = {"": [], "main": [], "article": []}
        self.done: set[str] = set()
        self.linked: list[str] = []
        self.data = None

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append(tag)
        if tag == "script" and dict(attrs).get("type") == "application/ld+json":
            self.data = []

    def handle_endtag(self, tag):
        if tag == "script" and self.data is not None:
            if self.data:
                self.linked.append("".join(self.data))
            self.data = None
        if tag in self.open:
            while (last := self.open.pop()) != tag:
                self._close(last)
            self._close(tag)

    def _close(self, tag):
        if tag in ("main", "article") and tag not in self.open:
            self.done.add(tag)

    def handle_data(self, text):
        if self.data is not None:
            self.data.append(text)
        if DROPPED.intersection(self.open) or not (text := text.strip()):
            return
        self.texts[""].append(text)
        for root in ("main", "article"):
            if root in self.open and root not in self.done:
                self.texts[root].append(text)


def page_text(raw: str | None) -> str | None:
    """The text of the first main, else first article, else page, then its linked-data scripts."""
    if raw is None:
        return None
    p = _Text()
    p.feed(raw)
    p.close()
    seen = {t for t in ("main", "article") if p.texts[t] or t in p.done}
    root = "main" if "main" in seen else "article" if "article" in seen else ""
    out = " ".join(p.texts[root])
    return html.unescape(" ".join([out, *p.linked]) if p.linked else out)


@F.pandas_udf(T.StringType())
def html_to_text(raw: pd.Series) -> pd.Series:
    return raw.map(page_text)


def with_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with text_col, their text, read in batches of bounded rows and bytes."""
    bounded_batches(pages.sparkSession)
    return pages.withColumn(text_col, html_to_text(html_col))


def worth_reading(text: Column, pattern: str = DATES, least: int = MIN_TEXT_LENGTH) -> Column:
    return (F.length(text) >= least) & F.rlike(text, F.lit(pattern))


def reject_reason(text: Column, pattern: str = DATES, least: int = MIN_TEXT_LENGTH) -> Column:
    """Why a text is not worth reading; null if it is."""
    return F.when(F.length(text) < least, "zu kurz").when(~F.rlike(text, F.lit(pattern)), "kein Datum")


def cap_hits(text: Column, most: int = MAX_HITS_PER_PAGE, pattern: str = DATES) -> Column:
    """struct(text, hits): cut before match most + 1."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ahead = F.concat(F.slice(found, F.lit(1), F.lit(most)), F.slice(F.split(text, pattern, most + 2), F.lit(1), F.lit(most + 1)))
    begin = F.aggregate(ahead, F.lit(0), lambda n, piece: n + F.length(piece))
    cut = F.when(F.size(found) > most, F.substring(text, F.lit(1), begin)).otherwise(text)
    return F.struct(cut.alias("text"), F.least(F.size(found), F.lit(most)).alias("hits"))


def passages(texts: DataFrame, key: str, text_col: str, limit: int, pattern: str, before: int, after: int) -> DataFrame:
    """texts: one row for each key. (key, first, windows): of texts with a match, where the first window around matches
    begins, and the windows (s, e), in order, that fit the limit together. Windows that touch are one.

    Each match is a row: its place is a running sum, windows are islands between gaps, and what fits is a
    running sum again. One shuffle by key serves all of these, and no text is in it. Only windows that fit
    are gathered, so never more than limit / len(GAP).
    """
    t = F.col(text_col)
    lengths = lambda pieces: F.transform(pieces, F.length)
    zipped = F.arrays_zip(lengths(F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).alias("hit"), lengths(F.split(t, pattern, -1)).alias("rest"))
    # lengths are taken first, so that a text is not carried beside each of its matches
    matches = texts.select(key, F.length(t).alias("_m"), zipped.alias("_z")).select(key, "_m", F.posexplode("_z").alias("_i", "_x")).where("_x.hit IS NOT NULL")
    in_order = Window.partitionBy(key).orderBy("_i")
    ends = matches.withColumn("_e", F.sum(F.col("_x.hit") + F.col("_x.rest")).over(in_order))
    around = ends.withColumns({"_s": F.greatest(F.col("_e") - F.col("_x.hit") - before, F.lit(0)), "_e": F.least(F.col("_e") + after, F.col("_m"))})
    begins = around.withColumn("_new", F.coalesce(F.col("_s") > F.lag("_e").over(in_order), F.lit(True)).cast("int"))
    islands = begins.withColumn("_w", F.sum("_new").over(in_order)).groupBy(key, "_w").agg(F.min("_s").cast("int").alias("s"), F.max("_e").cast("int").alias("e"))
    fits = F.sum(F.col("e") - F.col("s") + len(GAP)).over(Window.partitionBy(key).orderBy("s")) <= limit
    return islands.withColumn("_fits", fits).groupBy(key).agg(F.min("s").alias("first"), F.sort_array(F.collect_list(F.when(F.col("_fits"), F.struct("s", "e")))).alias("windows"))


def condense(df: DataFrame, text_col: str = "text", limit: int = TEXT_LIMIT, most: int = MAX_HITS_PER_PAGE, pattern: str = DATES, before: int = SNIPPET_BEFORE, after: int = SNIPPET_AFTER) -> DataFrame:
    """df with text_col condensed and hits added. Longer texts keep the passages around matches:
    windows that touch merge, and windows are taken from the first on while they fit and matches
    are few. If the first does not fit, its begin stays up to the limit; without a match the text's.

    Equal long texts are read for passages once; they get them by a join that deals hot texts. A null text stays,
    with null hits. df is written once, as both ways read it.
    """
    key, n, first, windows, chosen = spare(df, "_key", "_n", "_first", "_windows", "_chosen")
    t = F.col(text_col)
    rows = materialize(df.withColumn(key, F.when(F.length(t) > limit, F.sha2(t, 256))), "texts")
    short, long = rows.where(F.col(key).isNull()).drop(key), rows.where(F.col(key).isNotNull())
    texts = long.groupBy(key).agg(F.first(text_col).alias("t"))
    counts = long.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    found = passages(texts, key, "t", limit, pattern, before, after).withColumnsRenamed({"first": first, "windows": windows})
    placed = join_hot(long, materialize(counts.join(found, key, "left"), "passages"), [key], "left", n)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("hits"))

    def take(acc: Column, w: Column) -> Column:
        chunk = F.substring(t, w["s"] + 1, w["e"] - w["s"])
        more = F.struct(F.concat(acc["out"], F.array(chunk)).alias("out"), (acc["hits"] + F.regexp_count(chunk, F.lit(pattern))).alias("hits"))
        return F.when(acc["hits"] >= most, acc).otherwise(more)

    chunks = F.aggregate(windows, start, take, lambda a: a["out"])
    begin = lambda at: F.substring(t, at + 1, F.lit(limit))
    capped = placed.withColumn(chosen, F.when(F.size(windows) > 0, F.array_join(chunks, GAP)).when(F.col(first).isNotNull(), begin(F.col(first))))
    capped = capped.withColumn(chosen, F.when(F.col(chosen).isNull(), F.struct(begin(F.lit(0)).alias("text"), F.lit(0).alias("hits"))).otherwise(cap_hits(F.col(chosen), most, pattern)))
    out = short.withColumn(chosen, cap_hits(t, most, pattern)).unionByName(capped.select(*short.columns, chosen))
    return out.withColumns({text_col: F.col(f"{chosen}.text"), "hits": F.col(f"{chosen}.hits")}).drop(chosen)
