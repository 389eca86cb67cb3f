"""Labels by keywords that are held in a table, however many there are."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.text import clean, words
from almanac.operators.tables import drop, materialize, spare
from almanac.settings import KEYWORD_SUBSTRING

#: Tables of keywords are broadcast up to so many rows and letters; they are counted first, and beyond that shuffled.
SMALL_ROWS, SMALL_LETTERS = 200_000, 16_000_000
#: So many keywords, the first, are tried on each text before all others, and then so many more if that settles half; in lots.
HEADS, LOTS = (256, 2048), 32


def _grams(text: Column, n: int) -> Column:
    """Distinct hashes of the stretches of n letters; none of shorter texts. Letters are split once for each text."""
    at = lambda letters: F.sequence(F.lit(1), F.size(letters) - n + 1)
    some = lambda letters: F.array_distinct(F.transform(at(letters), lambda i: F.xxhash64(F.lit(n), F.slice(letters, i, F.lit(n)))))
    return F.when(F.length(text) >= n, F.element_at(F.transform(F.array(F.split(text, "")), some), 1)).otherwise(F.array().cast("array<bigint>"))


def _asked(table: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(table) if small else table.hint("merge")


def _first_of(head: list[tuple[str, bool]]) -> Column:
    """The first keyword of head that a text (c, ws) holds. It is asked lot by lot, so a text is read only up to its first hit."""
    fits = lambda x: F.when(x["whole"], F.array_contains(F.col("ws"), x["word"])).otherwise(F.contains(F.col("c"), x["word"]))
    out, lot = F.lit(None).cast("string"), -(-len(head) // LOTS)
    for at in reversed(range(0, len(head), lot or 1)):
        some = F.from_json(F.lit(json.dumps([{"word": w, "whole": whole} for w, whole in head[at : at + lot]])), "array<struct<word:string,whole:boolean>>")
        out = F.when(F.exists(some, fits), F.element_at(F.filter(some, fits), 1)["word"]).otherwise(out)
    return out


def _tried(texts: DataFrame, head: list[tuple[str, bool]]) -> DataFrame:
    """texts (k, c) with w, the first of head that they hold, written; the text of a settled row is not written."""
    some = texts.select("k", "c", F.explode(F.array(words(F.col("c")))).alias("ws")).withColumn("w", _first_of(head))
    return materialize(some.select("k", "w", F.when(F.col("w").isNull(), F.col("c")).alias("c")), "keyword-texts")


def first_keyword(rows: DataFrame, text_col: str, keywords: DataFrame, label: str = "label", form=clean) -> DataFrame:
    """rows with label: that of the keyword with the least (priority, word) that the text holds; null if none does.

    keywords: (priority, word, label), words in the form of comparison; of repeated words the least priority counts, then the
    least label; null and empty words fit nothing. Words of KEYWORD_SUBSTRING letters or more and those with a
    blank are found anywhere, shorter ones as whole words of three letters or more (as classify.event_type).

    The first keywords (HEADS) are tried on each text where it lies; a hit among them settles it, as all others come later.
    The texts that this leaves open are not held against all keywords: one that is found anywhere is looked up by its
    rarest stretch of letters, a short one by equality; then the text decides, which meets what it may hold once.
    Only stretches and numbers of rows are shuffled. A null text counts as empty.
    """
    key, taken = spare(rows, "_key", label)
    lists = F.struct("priority", "label")
    table = keywords.where("word <> ''").groupBy("word").agg(F.min(lists).alias("x")).select("word", "x.*")
    size = F.length("word")
    table = materialize(table.withColumn("whole", (size < KEYWORD_SUBSTRING) & ~F.contains("word", F.lit(" "))).withColumn("q", F.least(size, F.lit(KEYWORD_SUBSTRING))), "keywords")
    count, letters = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    small = count <= SMALL_ROWS and letters <= SMALL_LETTERS

    keyed = materialize(rows.withColumn(key, F.monotonically_increasing_id()), "keyword-rows")
    head = [tuple(r) for r in table.orderBy("priority", "word").limit(sum(HEADS)).select("word", "whole").collect()]
    # as a row of a generator, a form is made once, and its expression is not repeated for each lot
    open_ = keyed.select(F.col(key).alias("k"), F.explode(F.array(form(F.coalesce(F.col(text_col), F.lit(""))))).alias("c"))
    rounds, at, n = [], 0, None
    for size in HEADS:
        rounds.append(_tried(open_, head[at : at + size]))
        at, before = at + size, n
        open_ = rounds[-1].where("w IS NULL").select("k", "c")
        n = open_.count()
        if not n or at >= count or 2 * n > (before or rounds[-1].count()):
            break
    settled = rounds[0].select("k", "w")
    for more in rounds[1:]:
        settled = settled.unionByName(more.select("k", "w"))
    named = F.broadcast(table.orderBy("priority", "word").limit(sum(HEADS)).select(F.col("word").alias("w"), "label"))
    best = settled.where("w IS NOT NULL").join(named, "w").select("k", "label")
    if n and at < count:
        best = best.unionByName(_rest(open_, table, small))
    best = materialize(best.select(F.col("k").alias(key), F.col("label").alias(taken)), "keyword-labels")
    for df in (*rounds, table):
        drop(df)
    return keyed.join(best.hint("merge"), key, "left").drop(key)


def _rest(texts: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """(k, label) of the texts (k, c) that hold a keyword of table."""
    whole = table.where("whole").select("word", "priority", "label")
    best = texts.select("k", F.explode(F.array_distinct(words(F.col("c")))).alias("word")).join(_asked(whole, small), "word").groupBy("k").agg(F.min(F.struct("priority", "word", "label")).alias("x"))
    found, used = [materialize(best, "keyword-hits")], []
    anywhere = table.where("NOT whole")
    for q in sorted(r[0] for r in anywhere.select("q").distinct().collect()):  # six sizes at most
        part = anywhere.where(F.col("q") == q)
        theirs = materialize(part.select("word", F.explode(_grams(F.col("word"), q)).alias("g")), "keyword-grams")
        grams = texts.select("k", F.explode(_grams(F.col("c"), q)).alias("g"))
        # stretches of texts are made once to be counted and once to be met, and never written
        often = materialize(grams.select("g").join(_asked(theirs.select("g").distinct(), small), "g", "left_semi").groupBy("g").agg(F.count(F.lit(1)).alias("df")), "keyword-counts")
        # a stretch that no text has settles its keyword; left joins keep it as the rarest
        rarest = theirs.join(often, "g", "left").groupBy("word").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("x")).where("x.df > 0")
        probes = materialize(rarest.select(F.col("x.g").alias("g"), "word").join(part.select("word", "priority", "label"), "word"), "keyword-probes")
        met = grams.join(_asked(probes, small), "g").groupBy("k").agg(F.collect_list(F.struct("priority", "word", "label")).alias("xs"))
        hit = F.array_min(F.filter("xs", lambda x: F.contains(F.col("c"), x["word"])))
        found.append(materialize(met.join(texts.hint("merge"), "k").select("k", hit.alias("x")).where("x IS NOT NULL"), "keyword-hits"))
        used += [theirs, often, probes]
    all_ = found[0]
    for more in found[1:]:
        all_ = all_.unionByName(more)
    out = materialize(all_.groupBy("k").agg(F.min("x").alias("x")).select("k", "x.label"), "keyword-best")
    for df in (*used, *found):
        drop(df)
    return out
