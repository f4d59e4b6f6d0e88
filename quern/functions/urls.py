"""Addresses of web pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import WHITE, strip

#: Scheme, authority, path, query and fragment of an address (RFC 3986, appendix B).
PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
#: An address inside of a text, and what is no part of its end.
IN_TEXT = rf"(?i)https?://[^{WHITE})\],>\"']+"
TAIL = "[.,;:!?]+$"
#: Words of addresses of tools and forms.
TOOLS = ("finder", "tool", "submit", "submission", "application-submission")


def normalize_url(url: Column) -> Column:
    """The form in which addresses are compared: host in lower case without leading ``www.``, http as https, no slash
    at the end (but the path ``/`` alone stays), no empty query or fragment. Null stays null, empty stays empty.
    Scheme names are lower-cased; white space around is dropped."""
    u = strip(url)
    part = lambda n: F.regexp_extract(u, PARTS, n)
    scheme = F.lower(part(1))
    host = F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    path = F.when(part(3) == "/", "/").otherwise(F.regexp_replace(part(3), r"/+(;[^/]*)?$", "$1"))
    tail = F.concat(F.when(part(4) != "?", part(4)).otherwise(""), F.when(part(5) != "#", part(5)).otherwise(""))
    head = F.when(scheme == "", "").otherwise(F.concat(F.when(scheme == "http", "https").otherwise(scheme), F.lit(":")))
    return F.when(u == "", "").otherwise(F.concat(head, F.when(part(2) == "", "").otherwise(F.concat(F.lit("//"), host)), path, tail))


def host_of(url: Column) -> Column:
    """The host of an address in lower case without user, port and leading ``www.``; null where there is none."""
    host = F.regexp_extract(F.lower(strip(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", ""), F.lit(""))


def cited_urls(text: Column) -> Column:
    """The distinct addresses in a text in the order of their first place; null gives none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({IN_TEXT})"), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda u: F.regexp_replace(u, TAIL, "")), lambda u: u != ""))


def is_tool_url(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike("|".join(TOOLS)), F.lit(False))


def title_from_uri(uri: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(uri, "/+$", ""), "/", -1), -1)
