"""Quality rules: base statistics of a text, and a robust multivariate outlier test per language
and source (minimum covariance determinant), all with DataFrame functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import GAP, count_chars, drop, join_small, let, materialize, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Robust:
    """coverage: share of a group's rows that the estimate rests on. steps: concentration steps, at
    most; fewer are taken where the determinants stop falling before. least: groups with fewer rows
    are pooled by language, then over all. floors: standard deviations added to each statistic's own,
    so that one that is constant in a group can't reject a row that differs by a trifle.
    cutoff: largest squared distance kept. A chi-square of five statistics goes beyond 50 once in
    a billion; ordinary texts have heavier tails, so it is twice that."""

    coverage: float = 0.75
    steps: int = 20
    least: int = 60
    floors: tuple[float, ...] = (0.25, 0.2, 0.015, 0.04, 0.05)
    cutoff: float = 100.0


#: Median of a chi-square with five degrees of freedom, which puts robust distances to scale.
CHI2_MEDIAN_5 = 4.35146
STATS = ("x1", "x2", "x3", "x4", "x5")
P = len(STATS)
#: Quantiles come from counts of bins, which no order of rows or merges changes: bins of log(1 + x), and of log2 of a distance.
FINE, FINE_D2, LEAST_D2 = 512, 32, 2.0**-20
#: Files that a table of estimates, a few rows for each group, is written in.
FILES = 4
#: A determinant whose logarithm falls by no more than this has stopped falling.
FALL = 1e-3


def repeated_words(ws: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Windows are compared by 64-bit hashes. The sorted hashes show the repeated values; with few
    of these the windows are looked up in them, else the windows themselves are sorted with their
    places, so that the cost stays n log n in texts made of repetitions.
    """

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def covered(places: Column) -> Column:
        return let(places, lambda r: F.size(F.array_distinct(F.flatten(F.array(r, F.transform(r, lambda i: i + 1), F.transform(r, lambda i: i + 2))))))

    def by_lookup(g: Column, again: Column) -> Column:
        return covered(F.filter(F.transform(g, lambda h, i: F.when(F.array_contains(again, h), i)), lambda i: i.isNotNull()))

    def by_sort(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            pairs,
            lambda t: covered(
                F.transform(
                    F.filter(t, lambda x, i: F.coalesce(F.get(t, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(t, i + 1)["h"] == x["h"], F.lit(False))),
                    lambda x: x["i"],
                )
            ),
        )

    def count(g: Column) -> Column:
        again = let(F.sort_array(g), lambda s: F.array_distinct(F.filter(s, lambda h, i: h == F.get(s, i + 1))))
        return let(again, lambda d: F.when(F.size(d) == 0, 0).when(F.size(d) <= 16, by_lookup(g, d)).otherwise(by_sort(g)))

    return let(windows(ws), count).cast("long")


def text_stats(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text; zeros for null."""
    t = F.coalesce(text, F.lit(""))
    lines = let(F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return let(
        words(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(t, GAP, "")).cast("long").alias("word_chars"),
            count_chars(t, SYMBOLS).alias("n_symbols"),
            lines.cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics: log length, word length, and square roots of three shares."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.col("word_chars") / n,
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.least(F.col("n_dup_lines") * 10 / n, F.lit(1.0))),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i + 1)]


def _with_factor(params: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """Adds the Cholesky factor of covariance plus floors as l{i}{j}, one column after another, and logdet."""
    for i, j in _pairs():
        rest = F.col(f"c{i}{j}") + (floors[i] ** 2 if i == j else 0.0)
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    logdet = F.lit(0.0)
    for i in range(P):
        logdet = logdet + 2 * F.log(F.col(f"l{i}{i}"))
    return params.withColumn("logdet", logdet)


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance by forward substitution in L z = x - m."""

    def step(i: int, z: list[Column]) -> Column:
        if i == P:
            out = F.lit(0.0)
            for v in z:
                out = out + v * v
            return out
        rest = F.col(names[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * z[k]
        return let(rest / F.col(f"l{i}{i}"), lambda v: step(i + 1, [*z, v]))

    return step(0, [])


def _small(df: DataFrame) -> DataFrame:
    return materialize(df.coalesce(FILES), "mcd")


def _join(rows: DataFrame, params: DataFrame) -> DataFrame:
    return join_small(rows, params.withColumnRenamed("grp", "_g"), F.col("grp") == F.col("_g")).drop("_g")


Y = [f"y{i}" for i in range(P)]
ESTIMATE = [*[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in _pairs()], "logdet"]


def _moments(sums: DataFrame, keys: list[str], floors: tuple[float, ...]) -> DataFrame:
    """From sums n, a{i} of y and q{i}{j} of products: location, factor and logdet."""
    mean = {i: F.col(f"a{i}") / F.col("n") for i in range(P)}
    cov = [(F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j]).alias(f"c{i}{j}") for i, j in _pairs()]
    return _with_factor(sums.select(*keys, *[mean[i].alias(f"m{i}") for i in range(P)], *cov), floors).select(*keys, *ESTIMATE)


def _sums(where: Column | None = None) -> list[Column]:
    of = lambda c: F.sum(c if where is None else F.when(where, c))
    return [of(F.lit(1)).alias("n"), *[of(F.col(Y[i])).alias(f"a{i}") for i in range(P)], *[of(F.col(Y[i]) * F.col(Y[j])).alias(f"q{i}{j}") for i, j in _pairs()]]


def quantiles(rows: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """rows: (grp, x1..x5). (grp, q{i}_{k}): the k-th share's quantile of statistic i, in the middle of its bin."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.log1p(F.col(x)) * FINE).alias("bin")) for i, x in enumerate(STATS)])
    bins = rows.select("grp", F.explode(each).alias("b")).groupBy("grp", "b.i", "b.bin").count()
    whole = Window.partitionBy("grp", "i")
    bins = bins.withColumns({"upto": F.sum("count").over(whole.orderBy("bin")), "all": F.sum("count").over(whole)})
    value = F.expm1((F.col("bin") + 0.5) / FINE)
    reached = lambda i, s: F.min(F.when((F.col("i") == i) & (F.col("upto") >= s * F.col("all")), value))
    return bins.groupBy("grp").agg(*[reached(i, s).alias(f"q{i}_{k}") for i in range(P) for k, s in enumerate(shares)])


def _concentrate(centred: DataFrame, params: DataFrame, r: Robust) -> DataFrame:
    """One step for each (grp, start) of params: the estimate of the share of rows nearest to it."""
    far = _join(centred, params.select("grp", "start", *ESTIMATE)).select("grp", "start", *Y, _distance(Y).alias("d2"))
    bins = far.groupBy("grp", "start", F.floor(F.log2(F.greatest("d2", F.lit(LEAST_D2))) * FINE_D2).alias("bin")).agg(*_sums())
    whole = Window.partitionBy("grp", "start")
    before = F.sum("n").over(whole.orderBy("bin")) - F.col("n")
    near = bins.withColumns({"_before": before, "_all": F.sum("n").over(whole)}).where(F.col("_before") < r.coverage * F.col("_all"))
    names = ["n", *[f"a{i}" for i in range(P)], *[f"q{i}{j}" for i, j in _pairs()]]
    return _moments(near.groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in names]), ["grp", "start"], r.floors)


def robust_params(rows: DataFrame, r: Robust) -> DataFrame:
    """rows: (grp, x1..x5). One row per group: location m*, factor l*, scale of the squared distance.

    Three starts: medians with quartile distances, all rows, and the rows between the first and
    last tenth of every statistic. Each is concentrated, the nearest share of rows giving the next
    estimate, until its determinant stops falling; the least determinant of a group wins, of equal
    ones the first start. A step is one aggregation that tasks sum before they shuffle, to sums for each bin
    of the distance; so no group is gathered and no result depends on the order of rows,
    but for the last bits of sums.
    """
    cuts = _small(quantiles(rows, (0.1, 0.25, 0.5, 0.75, 0.9)))
    inside = F.lit(True)
    for i, x in enumerate(STATS):
        inside = inside & F.col(x).between(F.col(f"q{i}_0") - 1e-9, F.col(f"q{i}_4") + 1e-9)
    centred = _join(rows, cuts).select("grp", *[(F.col(x) - F.col(f"q{i}_2")).alias(Y[i]) for i, x in enumerate(STATS)], inside.alias("inside"))
    centred = materialize(centred, "mcd-rows")
    spread = [(((F.col(f"q{i}_3") - F.col(f"q{i}_1")) / 1.349) ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _pairs()]
    first = _with_factor(cuts.select("grp", F.lit(0).alias("start"), *[F.lit(0.0).alias(f"m{i}") for i in range(P)], *spread), r.floors)
    keys = ["grp", "start"]
    sums = centred.groupBy("grp").agg(F.array(F.struct(F.lit(1).alias("start"), *_sums()), F.struct(F.lit(2).alias("start"), *_sums(F.col("inside")))).alias("s"))
    others = _moments(sums.select("grp", F.explode("s").alias("s")).select("grp", "s.*").where("n > 0"), keys, r.floors)
    now = first.select(*keys, *ESTIMATE).unionByName(others).withColumn("logdet", F.lit(float("inf")))
    now = _small(now.withColumn("open", F.lit(True)))
    for _ in range(r.steps):
        step = _concentrate(centred, now.where("open"), r).withColumnRenamed("grp", "_g").withColumnRenamed("start", "_s")
        step = step.select("_g", "_s", *[F.col(c).alias(f"n_{c}") for c in ESTIMATE])
        met = now.join(step, (F.col("grp") == F.col("_g")) & (F.col("start") == F.col("_s")), "left")
        falls = F.coalesce(F.col("n_logdet") < F.col("logdet") - FALL, F.lit(False))
        nxt = _small(met.select(*keys, *[F.when(falls, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ESTIMATE], falls.alias("open")))
        drop(now)
        now = nxt
        if now.where("open").isEmpty():
            break
    best = now.groupBy("grp").agg(F.min(F.struct("logdet", "start", *ESTIMATE[:-1])).alias("e")).select("grp", "e.*")
    best = _small(best.drop("start"))
    far = _join(centred, best).select("grp", F.floor(F.log2(F.greatest(_distance(Y), F.lit(LEAST_D2))) * FINE_D2).alias("bin"))
    whole = Window.partitionBy("grp")
    counts = far.groupBy("grp", "bin").count().withColumns({"upto": F.sum("count").over(whole.orderBy("bin")), "all": F.sum("count").over(whole)})
    half = counts.where(F.col("upto") >= 0.5 * F.col("all")).groupBy("grp").agg(F.pow(2.0, (F.min("bin") + 0.5) / FINE_D2).alias("half"))
    # the floors can make distances smaller than a chi-square's, never larger than they are
    scale = F.greatest(F.col("half") / CHI2_MEDIAN_5, F.lit(1.0)).alias("scale")
    middle = cuts.select("grp", *[F.col(f"q{i}_2").alias(f"o{i}") for i in range(P)])
    out = best.join(half, "grp").join(middle, "grp").select("grp", *[(F.col(f"m{i}") + F.col(f"o{i}")).alias(f"m{i}") for i in range(P)], *[f"l{i}{j}" for i, j in _pairs()], scale)
    out = _small(out)
    for df in (cuts, centred, now, best):
        drop(df)
    return out


def fit(stats: DataFrame, robust: Robust) -> tuple[DataFrame, DataFrame]:
    """(group of each language and source, estimates of each group), from the rows that pass the base rules.

    Null languages and sources are groups of their own. Groups with fewer than robust.least rows
    are pooled by language, and those of small languages together.
    """
    good = stats.where(~base_failed())
    pair = good.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    small = pair.where(F.col("n") < robust.least).groupBy("lang").agg(F.sum("n").alias("n_lang"))
    named = pair.join(small.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l")), "left").select(
        F.col("lang").alias("_lang"),
        F.col("source").alias("_source"),
        F.when(F.col("n") >= robust.least, F.concat_ws("\x1f", text("lang"), text("source"))).when(F.col("n_lang") >= robust.least, text("lang")).otherwise("").alias("grp"),
    )
    named = _small(named)
    rows = _grouped(good, named).withColumns(dict(zip(STATS, vector())))
    return named, robust_params(rows.select("grp", *STATS), robust)


def _grouped(rows: DataFrame, named: DataFrame) -> DataFrame:
    cond = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    return join_small(rows, named, cond, "left").drop("_lang", "_source")


def judge(stats: DataFrame, fitted: tuple[DataFrame, DataFrame], robust: Robust) -> DataFrame:
    """stats with base_failed, kept and distance: a function of each row and of its group's estimates.

    distance is the squared robust distance over its scale; null for rows that fail the base rules.
    """
    named, params = fitted
    rows = _grouped(stats.withColumn("base_failed", base_failed()), named).withColumns(dict(zip(STATS, vector())))
    out = join_small(rows, params.withColumnRenamed("grp", "_g"), F.col("grp") == F.col("_g"), "left")
    out = out.withColumn("distance", F.when(~F.col("base_failed"), _distance(list(STATS)) / F.col("scale")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= robust.cutoff, F.lit(True))
    return out.withColumn("kept", kept).select(*stats.columns, "base_failed", "kept", "distance")


def quality_rules(docs: DataFrame, robust: Robust = Robust(), key_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, distance.

    Texts are read once and whole; the estimates then work on the table of statistics, written to
    the shared folder. Null and empty texts have zero statistics and fail the base rules. Rows that
    repeat are judged alike. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(key_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), text_stats(F.col(text_col)).alias("s"))
    stats = materialize(rows.select("doc_id", "lang", "source", "s.*"), "rules-stats")
    return judge(stats, fit(stats, robust), robust).drop("lang", "source")


def keep_good(docs: DataFrame, robust: Robust = Robust()) -> DataFrame:
    """The rows of docs that quality_rules keeps, with the columns of docs.

    Rows are written once with their statistics, as a struct of their own, so that the estimates read
    the statistics alone and no text is read twice or shuffled. Rows that repeat are judged alike.
    An empty table gives an empty result.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # explode keeps the optimizer from copying the statistics into each expression that uses them
    rows = own.select("row", F.col("row.lang").cast("string").alias("lang"), F.col("row.source").cast("string").alias("source"), F.explode(F.array(text_stats(F.col("row.text")))).alias("s"))
    stats = materialize(rows.select("row", "lang", "source", "s.*"), "rules-stats")
    return judge(stats, fit(stats.drop("row"), robust), robust).where("kept").select("row.*")
