"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import count_words, join_small, materialize, spare

#: A rank is cut to this many bits, read as LEVELS digits of DIGIT bits each.
DIGIT, LEVELS = 10, 3
RANK_BITS = DIGIT * LEVELS


def source_targets(sizes: DataFrame, weights: Sequence[float], max_copies: int) -> DataFrame:
    """From rows (source, size): one row (source, source_size, target) per source.

    Sources by code point, null last, take the weights in turn. They share the sum of all sizes
    by weight; no target exceeds max_copies times its source's size, and what a source can't take
    goes to the others by weight. That fixed point is found at once: with the sources ordered by
    cap / weight, the capped ones are a prefix, and the level that the rest share by weight is the
    highest one: it rises as long as a source is capped and falls after that.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("_w", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("_cap", F.col("source_size").cast("double") * max_copies)
    tight = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, after = tight.rowsBetween(Window.unboundedPreceding, -1), tight.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    by = by.withColumn("_level", level).withColumn("_level", F.max("_level").over(everything))
    return by.select("source", "source_size", F.least(F.col("_cap"), F.col("_level") * F.col("_w")).alias("target"))


def pareto_rank(key: Column, inclusion: Column, seed: str) -> Column:
    """Random odds over inclusion odds, mapped into [0, 2**RANK_BITS): smaller ranks go first.

    The random number is made from md5(seed | key), so that reruns and other partitionings agree.
    """
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    q = (u / (1 - u)) * F.try_divide(1 - inclusion, inclusion)
    return F.least(F.floor(q / (1 + q) * float(2**RANK_BITS)).cast("long"), F.lit(2**RANK_BITS - 1))


def sample_plan(sizes: DataFrame, weights: Sequence[float], max_copies: int, seed: str) -> DataFrame:
    """From rows (key, source, size): per source (source, source_size, target, copies, share, cut).

    Each document of a source is taken `copies` times for certain and once more if its Pareto
    rank, at inclusion probability `share`, is below `cut`. The cut is the rank at which the words
    taken come nearest to the target. It is found digit by digit from sums per (source, digit),
    which tasks sum before they shuffle; no task sees the rows of a source together.
    """
    plan = source_targets(sizes, weights, max_copies)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("copies", F.floor(ratio).cast("int")).withColumn("share", ratio - F.floor(ratio))
    plan = plan.withColumn("_need", F.col("target") - F.col("copies") * F.col("source_size"))
    plan = plan.withColumn("cut", F.lit(0).cast("long")).withColumn("_sum", F.lit(0.0))
    plan = materialize(plan.coalesce(1), "mix-sources")
    for level in range(LEVELS):
        width = 1 << (RANK_BITS - DIGIT * (level + 1))
        a, b = sizes.alias("a"), plan.where("share > 0").alias("b")
        ranked = join_small(a, b, F.col("a.source").eqNullSafe(F.col("b.source"))).select(
            F.col("b.source").alias("source"), "size", "cut", pareto_rank(F.col("a.key"), F.col("b.share"), seed).alias("rank")
        )
        inside = ranked.where((F.col("rank") >= F.col("cut")) & (F.col("rank") < F.col("cut") + width * (1 << DIGIT)))
        bins = inside.groupBy("source", F.floor((F.col("rank") - F.col("cut")) / width).cast("long").alias("digit")).agg(F.sum("size").alias("size"))
        bins = bins.join(plan.select(F.col("source").alias("_s"), "_need", "_sum"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        order = Window.partitionBy("source").orderBy("digit")
        bins = bins.withColumn("_to", F.col("_sum") + F.sum("size").over(order))
        # all digits below the first one that goes past the need are taken whole
        over = F.col("_to") > F.col("_need")
        found = bins.groupBy("source").agg(
            F.min(F.when(over, F.struct("digit", (F.col("_to") - F.col("size")).alias("before"), F.col("_to").alias("to")))).alias("_at"), F.max("_to").alias("_all")
        )
        nxt = plan.join(found.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
        digit = F.col("_at.digit")
        if level == LEVELS - 1:  # stop before or after that digit, whichever is nearer
            digit = digit + F.when(F.col("_at.to") - F.col("_need") < F.col("_need") - F.col("_at.before"), 1).otherwise(0)
        digit = F.coalesce(digit, F.when(F.col("_all").isNotNull(), F.lit(1 << DIGIT)), F.lit(0))
        plan = materialize(
            nxt.select("source", "source_size", "target", "copies", "share", "_need", (F.col("cut") + digit * width).cast("long").alias("cut"), F.coalesce("_at.before", "_all", "_sum").cast("double").alias("_sum")).coalesce(1),
            "mix-cuts",
        )
    return plan.select("source", "source_size", "target", "copies", "share", "cut")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_copies: int = 3,
    key_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
) -> tuple[DataFrame, DataFrame]:
    """(taken, docs_mixed) of a Pareto order sample that brings each source near its target.

    taken: one row per row of docs, (doc_id, size, source, source_size, target, taken); docs_mixed:
    the rows of docs, each as often as it was taken.

    Sizes are word counts of whole texts (null and empty texts: 0; such rows are kept as often
    as their rank says and count no words). A null source is a source of its own, ordered last. Rows that repeat with
    the same id share one rank, so they are taken together. Equal ranks in a source are
    taken together. An empty table gives empty results. Extra columns pass through docs_mixed.
    """
    size = spare(docs, "_size")[0]
    sizes = materialize(
        docs.select(F.col(key_col).alias("key"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size")), "mix-sizes"
    )
    plan = sample_plan(sizes, weights, max_copies, seed)

    def times(df: DataFrame, key: str, source: str) -> tuple[DataFrame, Column]:
        names = spare(df, "_psource", "_psize", "_ptarget", "_pcopies", "_pshare", "_pcut")
        p = plan.toDF(*names)
        joined = join_small(df, p, F.col(f"`{source}`").eqNullSafe(F.col(names[0])))
        extra = (F.col(names[4]) > 0) & (pareto_rank(F.col(f"`{key}`"), F.col(names[4]), seed) < F.col(names[5]))
        return joined, F.col(names[3]) + F.when(extra, 1).otherwise(0)

    t, n = times(sizes, "key", "source")
    taken = t.select(F.col("key").alias("doc_id"), "size", "source", F.col("_psize").alias("source_size"), F.col("_ptarget").alias("target"), (n * F.col("size")).cast("long").alias("taken"))
    m, n = times(docs, key_col, source_col)
    mixed = m.withColumn(size, F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
    return taken, mixed
