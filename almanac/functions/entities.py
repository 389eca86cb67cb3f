"""HTML entities decoded by expressions, as the standard library's html.unescape does it."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that end in a semicolon, and the older ones that need none, which may also begin a longer word.
NAMES = {k: v for k, v in html5.items() if k.endswith(";")}
OLD = {k: v for k, v in html5.items() if not k.endswith(";")}
SHORTEST, LONGEST = min(map(len, OLD)), max(map(len, OLD))
NAME = r"^[^\t\n\f <&#;]{1,32};?"
DECIMAL, HEX = r"^#0*([0-9]+);?", r"^#[xX]0*([0-9a-fA-F]+);?"
#: What numbers 128 to 159 mean: the characters that Windows has there, where it has any.
WINDOWS = [bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)]
UNKNOWN = "�"


def _map(pairs: dict[str, str]) -> Column:
    """A literal map; Spark folds it once."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def character(n: Column) -> Column:
    """The text of one code point, from 1 to 0x10FFFF and none of the surrogates."""
    four = lambda x: F.lpad(F.hex(x), 4, "0")
    high = n - 0x10000
    pair = F.concat(four(F.lit(0xD800) + F.floor(high / 1024)), four(F.lit(0xDC00) + high % 1024))
    return F.decode(F.unhex(F.when(n < 0x10000, four(n)).otherwise(pair)), "UTF-16BE")


def _numbered(n: Column) -> Column:
    """The text of a numeric entity: nothing for controls and non-characters, a mark for what is no code point."""
    none = n.between(1, 8) | n.between(14, 31) | n.isin(11, 127) | n.between(0xFDD0, 0xFDEF) | (n % 0x10000 >= 0xFFFE)
    windows = F.get(F.array(*[F.lit(c) for c in WINDOWS]), (n - 128).cast("int"))
    return F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), UNKNOWN).when(n.between(128, 159), windows).when(none, "").otherwise(character(n))


def _number(piece: Column, pattern: str, base: int) -> Column:
    """The number that a piece begins with; beyond seven digits it is no code point."""
    digits = F.regexp_extract(piece, pattern, 1)
    return F.when(F.length(digits) > 7, F.lit(0x110000).cast("long")).otherwise(F.conv(digits, base, 10).cast("long"))


def _named(piece: Column) -> Column:
    def old(s: Column) -> Column:
        """The longest older name that a word begins with, and the rest of the word."""
        known = lambda k: F.try_element_at(_map(OLD), F.left(s, F.lit(k)))
        cut = [F.when(F.length(s) >= k, F.concat(known(k), F.substring(s, F.lit(k + 1), F.length(s)))) for k in range(LONGEST, SHORTEST - 1, -1)]
        return F.coalesce(*cut, F.concat(F.lit("&"), s))

    return _let(F.regexp_extract(piece, NAME, 0), lambda s: F.coalesce(F.when(F.endswith(s, F.lit(";")), F.try_element_at(_map(NAMES), s)), old(s)))


def _decoded(piece: Column) -> Column:
    """What follows an ampersand, with what they mean together in place of both."""
    after = lambda p: F.regexp_replace(piece, p, "")
    return (
        F.when(F.rlike(piece, F.lit(HEX)), F.concat(_numbered(_number(piece, HEX, 16)), after(HEX)))
        .when(F.rlike(piece, F.lit(DECIMAL)), F.concat(_numbered(_number(piece, DECIMAL, 10)), after(DECIMAL)))
        .when(F.rlike(piece, F.lit(NAME)), F.concat(_named(piece), after(NAME)))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def unescape(s: Column) -> Column:
    """s with entities decoded: no match reaches beyond the next ampersand, so pieces between these are decoded one by one."""
    pieces = F.split(s, "&", -1)
    rest = F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _decoded), "")
    return F.when(F.contains(s, F.lit("&")), F.concat(F.get(pieces, F.lit(0)), rest)).otherwise(s)
