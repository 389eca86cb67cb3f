"""URL filters: rules on hosts and paths, and a tree of path templates for what no rule fits."""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import drop, join_hot, join_small, materialize

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


@dataclass(frozen=True)
class Templates:
    """least, share: a segment stays as it is if so many URLs have it and it has such a share of its
    parent's, else it becomes a wildcard. z: sister branches are alike if none of their statistics
    differs by more than so many standard errors. prior: strength of a host's rate in the smoothing,
    and of the corpus rate in a host's. evidence: labelled URLs without which no template is
    rejected. purity: templates with such a smoothed share of block labels are rejected."""

    least: int = 3
    share: float = 0.02
    z: float = 2.58
    prior: float = 4.0
    evidence: int = 4
    purity: float = 0.75


#: A # ends a path, so no segment can be one of these; the second is followed by what the branches share.
WILD, ALIKE, END = "#*", "#=", "#."


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty if url is null or has no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict); null if none does. Of equally long rules the longer host wins."""
    name = verdict = F.lit(None).cast("string")
    for v, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def shape(segment: Column) -> Column:
    """Runs of digits as 9, runs of anything else as a."""
    return F.regexp_replace(F.regexp_replace(segment, "[^0-9]+", "a"), "[0-9]+", "9")


def _two_rates(a: Column, n: Column, b: Column, m: Column, z: float) -> Column:
    """Whether a of n and b of m differ by no more than z standard errors; true if either has no trial."""
    rate = (a + b) / (n + m)
    error = F.sqrt(rate * (1 - rate) * (1 / n + 1 / m))
    return F.when((n > 0) & (m > 0), F.abs(a / n - b / m) <= z * error + 1e-9).otherwise(True)


def _two_means(a: Column, n: Column, b: Column, m: Column, squares: Column, z: float) -> Column:
    """The same for means; squares: the sum of squares of all n + m values."""
    mean = (a + b) / (n + m)
    error = F.sqrt(F.greatest(squares / (n + m) - mean * mean, F.lit(0.0)) * (1 / n + 1 / m))
    return F.when((n > 0) & (m > 0), F.abs(a / n - b / m) <= z * error + 1e-9).otherwise(True)


SUMS = ("n", "paths", "deep", "deep2", "varied")


def branch_tokens(stays: DataFrame, t: Templates) -> DataFrame:
    """(node, seg, token, paths) of the segments that stay, at most 1 / t.share of a node.

    Sisters are compared within a class: segments of one shape and one rounded mean depth of what follows. A
    branch is held against the sum of the others of its class: the mean depth of what follows, the share
    whose next segment has a digit, and how many different paths there are to a URL. Branches that differ
    in none of these merge, whether labelled or not.

    Labels only part what would merge. A branch with t.evidence labelled URLs is on the side of most of them, and
    stands alone if its share of blocked ones differs from that of the others of its side. Branches with fewer
    go with a side that has t.purity of the labels of both, and else with each other.
    """
    rows = stays.withColumn("_class", F.concat_ws(":", shape(F.col("seg")), F.floor(F.col("deep") / F.col("n") + 0.5).cast("string")))
    sisters = Window.partitionBy("node", "_class")
    rows = rows.withColumns({f"_{c}": F.sum(c).over(sisters) for c in SUMS})
    own, all_ = {c: F.col(c) for c in SUMS}, {c: F.col(f"_{c}") for c in SUMS}
    rest = {c: all_[c] - own[c] for c in SUMS}
    alike = (
        (rest["n"] > 0)
        & _two_means(own["deep"], own["n"], rest["deep"], rest["n"], all_["deep2"], t.z)
        & _two_rates(own["varied"], own["n"], rest["varied"], rest["n"], t.z)
        & _two_rates(own["paths"], own["n"], rest["paths"], rest["n"], t.z)
    )
    enough = F.col("_alike") & (F.col("labelled") >= t.evidence)
    side = F.when(enough, F.when(2 * F.col("blocked") >= F.col("labelled"), "b").otherwise("a"))
    rows = rows.withColumn("_alike", alike).withColumn("_side", side)
    of = lambda c, s: F.coalesce(F.sum(F.when(F.col("_side") == s, F.col(c))).over(sisters), F.lit(0))
    rows = rows.withColumns({f"_{c}_{s}": of(c, s) for c in ("labelled", "blocked") for s in "ab"})
    mine = lambda c: F.when(F.col("_side") == "b", F.col(f"_{c}_b")).otherwise(F.col(f"_{c}_a")) - F.col(c)
    agrees = _two_rates(F.col("blocked"), F.col("labelled"), mine("blocked"), mine("labelled"), t.z)
    heavy = lambda x, y: (F.col(f"_labelled_{x}") > 0) & (F.col(f"_labelled_{x}") >= t.purity * (F.col(f"_labelled_{x}") + F.col(f"_labelled_{y}")))
    group = F.when(F.col("_side").isNotNull(), F.when(agrees, F.col("_side"))).when(heavy("b", "a"), "b").when(heavy("a", "b"), "a").otherwise("u")
    token = F.when(F.col("_alike") & group.isNotNull(), F.concat(F.lit(ALIKE), "_class", F.lit(":"), group)).otherwise(F.col("seg"))
    return rows.select("node", "seg", token.alias("token"), "paths")


def template_paths(paths: DataFrame, t: Templates) -> DataFrame:
    """paths: (host, path, n, labelled, blocked), one row each. (host, path, template, labelled, blocked).

    Level by level, for as long as some path goes on: sums per node and segment, which tasks make
    before they shuffle, then sums per node from these. Segments that few URLs have become
    wildcards, branches that stay may merge (branch_tokens). A path is finished at once where its
    node has no other path, and where too few URLs follow for any segment to stay.
    """
    segments = F.array_remove(F.split("path", "/"), "")
    tree = materialize(paths.select("host", "path", "n", "labelled", "blocked", segments.alias("s"), F.lit(0).alias("at"), F.col("host").alias("node")), "tree")
    finished = []
    while not tree.isEmpty():
        left = F.size("s") - F.col("at") - 1
        rows = tree.withColumn("seg", F.coalesce(F.get("s", F.col("at")), F.lit(END)))
        weigh = lambda c: F.sum(F.col("n") * c)
        child = rows.groupBy("node", "seg").agg(
            *[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")], F.count(F.lit(1)).alias("paths"), weigh(left).cast("double").alias("deep"),
            weigh(left * left).cast("double").alias("deep2"), weigh(F.coalesce(F.rlike(F.get("s", F.col("at") + 1), F.lit("[0-9]")), F.lit(False)).cast("int")).alias("varied"),
        )
        child = materialize(child, "tree-children")
        node = materialize(child.groupBy("node").agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("rows")), "tree-nodes")
        big = child.where((F.col("n") >= t.least) & (F.col("seg") != END))
        stays = join_hot(big, node, ["node"], n="rows").where(F.col("n") >= t.share * F.col("all_n"))
        token = materialize(branch_tokens(stays, t), "tree-tokens")
        # what follows a node's wildcard, where it is enough for a segment to stay again
        kept = token.select("node", "seg", F.lit(True).alias("_told"))
        others = child.where(F.col("seg") != END).join(kept.hint("merge"), ["node", "seg"], "left_anti")
        wild = materialize(others.groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= t.least).select(F.col("node").alias("_wild")), "tree-wild")
        told = token.select(F.col("node").alias("_n"), F.col("seg").alias("_s"), "token", "paths")
        on = rows.where(F.col("seg") != END)
        on = join_small(on, told, (F.col("node") == F.col("_n")) & (F.col("seg") == F.col("_s")), "left", F.col("path"))
        on = join_small(on, wild, F.col("token").isNull() & (F.col("node") == F.col("_wild")), "left", F.col("path"))
        after = F.slice("s", F.col("at") + 2, F.greatest(left, F.lit(0)))
        alone = F.coalesce((F.col("token") == F.col("seg")) & (F.col("paths") == 1), F.lit(False))
        few = F.col("token").isNull() & F.col("_wild").isNull()
        tail = F.when(alone, F.concat(after, F.array(F.lit(END)))).when(few, F.concat(F.transform(after, lambda _: F.lit(WILD)), F.array(F.lit(END))))
        name = F.concat_ws("/", "node", F.coalesce("token", F.lit(WILD)))
        ended = tail.isNotNull()
        step = on.select("host", "path", "n", "labelled", "blocked", "s", (F.col("at") + 1).alias("at"), F.when(ended, F.concat_ws("/", name, F.array_join(tail, "/"))).otherwise(name).alias("node"), ended.alias("ended"))
        done = rows.where(F.col("seg") == END).select("host", "path", "n", "labelled", "blocked", "s", "at", F.concat_ws("/", "node", F.lit(END)).alias("node"), F.lit(True).alias("ended"))
        new = materialize(step.unionByName(done), "tree")
        finished.append(new.where("ended"))
        for df in (tree, child, node, token, wild):
            if hasattr(df, "_almanac_path"):
                drop(df)
        tree = new.where("NOT ended").drop("ended")
    out = finished[0] if finished else tree.limit(0)
    for df in finished[1:]:
        out = out.unionByName(df)
    return out.select("host", "path", F.col("node").alias("template"), "n", "labelled", "blocked")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, t: Templates = Templates(), key_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, template.

    URLs that a rule fits have its verdict and are the labelled ones. Any other is blocked if its
    template has t.evidence labelled URLs or more and the share of blocked among them, smoothed
    towards that of its host, and that towards all, reaches t.purity; so nothing is blocked
    without evidence of its own, whatever the share in all. Paths are read to their end, however deep.
    URLs that are null or have no :// have an empty host and path and share a template. Repeated
    URLs count each and get equal verdicts. An empty table gives an empty result. Other columns
    are not read.
    """
    host, path = parse(F.col(url_col))
    rows = pages.select(F.col(key_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("by_rule").alias("labelled"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("blocked"))
    paths = materialize(paths, "paths")
    found = materialize(template_paths(paths, t), "templated")
    share = lambda prior: (F.col("blocked") + t.prior * prior) / (F.col("labelled") + t.prior)
    totals = [F.sum(c).alias(c) for c in ("labelled", "blocked")]
    hosts = found.groupBy("host").agg(*totals)
    corpus = found.agg(F.coalesce(F.sum("blocked") / F.greatest(F.sum("labelled"), F.lit(1)), F.lit(0.0)).alias("rate")).first()["rate"]
    hosts = hosts.select("host", share(F.lit(corpus)).alias("host_rate"))
    sums = found.groupBy("host", "template").agg(*totals, F.count(F.lit(1)).alias("n")).where(F.col("labelled") >= t.evidence)
    bad = sums.join(hosts.hint("merge"), "host").where(share(F.col("host_rate")) >= t.purity).select("template", "n", F.lit(True).alias("bad"))
    known = join_hot(found, materialize(bad, "rejected"), ["template"], "left").select("host", "path", "n", "template", F.coalesce("bad", F.lit(False)).alias("bad"))
    out = join_hot(rows, materialize(known, "path-verdicts"), ["host", "path"])
    final = F.coalesce("by_rule", F.when(F.col("bad"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", final.alias("verdict"), "template")
