"""Hosts and paths of URLs, ids of events, rotation keys, guarded links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac.functions.text import clean

AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"
REST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*([^?#;]*)"


def host(url: Column) -> Column:
    """The authority in lower case, with a port or user if it has one; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), AUTHORITY, 1))


def host_and_path(url: Column) -> Column:
    return F.lower(F.concat(host(url), F.regexp_extract(F.coalesce(url, F.lit("")), REST, 1)))


def event_id(title: Column, date_start: Column, url: Column, form=clean) -> Column:
    """md5 of the cleaned title, first day and host. The place is not part of it. form: cleaned, if the title is clean already."""
    return F.md5(F.concat_ws("|", form(title), F.coalesce(date_start.cast("string"), F.lit("")), host(url)))


def rotation_key(url: Column, period: Column) -> Column:
    """Hex digits that order URLs differently in each period."""
    return F.md5(F.concat_ws("|", url, period.cast("string")))


def safe_link(url: Column) -> Column:
    return F.when(F.rlike(url, F.lit("^https?://")), url).otherwise("#")


# Classes of fetch errors, and what a failed connection's message says of names and of encryption.
TIMEOUTS = ("ConnectTimeout", "ReadTimeout", "PoolTimeout")
NO_NAME = ("Name or service not known", "nodename nor servname")


def error_kind(error_class: Column, message: Column, status: Column) -> Column:
    """A group of fetch errors, from the class, message and status that the fetch left: the status,
    then timeouts, then what a failed connection's message tells, then protocol errors; else the class."""
    said, c = F.coalesce(message, F.lit("")), F.coalesce(error_class, F.lit(""))
    named = F.lit(False)
    for part in NO_NAME:
        named = named | F.contains(said, F.lit(part))
    sealed = F.contains(said, F.lit("SSL")) | F.contains(F.upper(said), F.lit("HANDSHAKE"))
    failed = c == "ConnectError"
    return (
        F.when(status.isNotNull(), F.concat(F.lit("HTTP "), status.cast("string")))
        .when(c.isin(*TIMEOUTS), "Timeout")
        .when(failed & named, "DNS unbekannt")
        .when(failed & sealed, "TLS-Handshake")
        .when(failed, "Verbindung fehlgeschlagen")
        .when(c == "RemoteProtocolError", "Protokollfehler")
        .otherwise(c)
    )
