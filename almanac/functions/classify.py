"""Types, regions, tags and topic rules. All dictionaries and word lists are parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac.functions.links import host, host_and_path
from almanac.functions.text import clean, words
from almanac.settings import EVENT_TYPES, FUNERAL_PREFIXES, FUNERAL_WORDS, KEYWORD_SUBSTRING, ONLINE_WORDS, REGIONS, TOPICS, VENUES

Labels = Sequence[tuple[str, Sequence[str]]]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _first_hit(labels: Labels, hits) -> Column:
    """The label of the first keyword, in order of labels, that hits(keyword) finds; null if none."""
    keys = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(w).alias("word"), F.lit(len(w) < KEYWORD_SUBSTRING and " " not in w).alias("short")) for label, words_ in labels for w in words_])
    return F.get(F.filter(keys, hits), F.lit(0))["label"]


def event_type(title: Column, types: Labels = EVENT_TYPES, form=clean) -> Column:
    """The first label with a keyword in the title; null if none. Keywords of six letters or more and
    those with a blank match anywhere, shorter ones a whole word. form: text.cleaned, if the title is clean already."""
    return _let(form(title), lambda t: _let(words(t), lambda ws: _first_hit(types, lambda k: F.when(k["short"], F.array_contains(ws, k["word"])).otherwise(F.contains(t, k["word"])))))


def first_label(cleaned: Column, labels: Labels) -> Column:
    return _let(cleaned, lambda t: _first_hit(labels, lambda k: F.contains(t, k["word"])))


def event_region(location: Column, url: Column, regions: Labels = REGIONS, online: Sequence[str] = ONLINE_WORDS) -> Column:
    """`online`, else the first region named in the place, else in the URL's host, else `sonstige`."""
    def named(place: Column) -> Column:
        far = F.lit(False)
        for w in online:
            far = far | F.contains(place, F.lit(w))
        return F.when(far, "online").otherwise(first_label(place, regions))

    return F.coalesce(_let(clean(location), named), first_label(clean(host(url)), regions), F.lit("sonstige"))


def event_kind(title: Column, description: Column, types: Labels = EVENT_TYPES) -> Column:
    return F.coalesce(event_type(title, types), event_type(description, types), F.lit("sonstige"))


def event_tags(region: Column, kind: Column, date_end: Column) -> Column:
    return F.array_compact(F.array(F.concat(F.lit("region-"), region), F.concat(F.lit("art-"), kind), F.when(date_end.isNotNull(), "laufend")))


def any_of(patterns: Sequence[str]) -> str:
    """Java pattern of any of these, in any case of letters."""
    return "(?iuU)(?:" + "|".join(patterns) + ")"


def funeral_pattern(prefixes: Sequence[str] = FUNERAL_PREFIXES, kinds: Sequence[str] = FUNERAL_WORDS) -> str:
    """Java pattern of titles that announce one person's funeral: its kind, then a name of two words in capitals."""
    capital = "[A-ZÄÖÜ]"
    return rf"(?U)^\s*(?iu:(?:{'|'.join(prefixes)})?\s*(?:{'|'.join(kinds)}))\b\s*(?iu:für|von)?\s*{capital}[\w-]+\s+{capital}"


@dataclass(frozen=True)
class TopicRules:
    """Java patterns of private events, of venues and of topics."""

    private: str = funeral_pattern()
    venue: str = any_of(VENUES)
    topic: str = any_of(TOPICS)


def topic_reason(title: Column, description: Column, location: Column, url: Column, rules: TopicRules = TopicRules()) -> Column:
    """struct(relevant, reason) by the first rule that fits: a private event's title rejects; a
    venue in the source or place, then a topic in title, description or place accepts."""
    title, description, location = (F.coalesce(c, F.lit("")) for c in (title, description, location))
    verdict = lambda ok, why: F.struct(F.lit(ok).alias("relevant"), why.alias("reason"))
    out = verdict(False, F.lit("kein sepulkraler Bezug"))
    chain = [("Quelle", host_and_path(url), rules.venue), ("Ort", location, rules.venue), ("Titel", title, rules.topic), ("Beschreibung", description, rules.topic), ("Ort", location, rules.topic)]
    for name, col, pattern in reversed(chain):
        out = F.when(F.rlike(col, F.lit(pattern)), verdict(True, F.concat(F.lit(name + ": "), F.regexp_extract(col, pattern, 0)))).otherwise(out)
    return F.when(F.rlike(title, F.lit(rules.private)), verdict(False, F.lit("einzelne Bestattung, keine oeffentliche Veranstaltung"))).otherwise(out)

