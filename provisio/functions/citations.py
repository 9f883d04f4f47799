"""Citations as columns: parsing, ids, mentions and match keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide results (fixed values).
PROVISION = r"(?i)(?:§\s?|IRC\s+(?:§\s?)?)(\d+[A-Za-z]*)(?!\.)((?:\([a-zA-Z0-9]+\))*)"
SEGMENT = r"\(([a-zA-Z0-9]+)\)"
MENTION = (
    r"(?i)(IRC\s+§\s?\d+[A-Za-z]*(?:\([a-zA-Z0-9]+\))*"
    r"|§\s?\d+[A-Za-z]*(?:\([a-zA-Z0-9]+\))*"
    r"|Treas\.\s?Reg\.\s?§[\d.]+-\d+(?:\([a-zA-Z0-9]+\))*"
    r"|Pub\.?\s?\d+"
    r"|Form\s?\d+"
    r"|Schedule C Instructions"
    r"|Schedule SE Instructions)"
)
TOKEN = r"(§\s?\d+[A-Za-z]*(?:\([a-zA-Z0-9]+\))*|Pub\.?\s?\d+|Form\s?\d+|Treas\.\s?Reg\.\s?§[\d.]+-\d+)"


def section(text: Column) -> Column:
    """Section of the first statute citation in the text, lower-cased; null where there is none."""
    found = F.regexp_extract(text, PROVISION, 1)
    return F.when(found != "", F.lower(found))


def path(text: Column) -> Column:
    """Path segments of that citation, lower-cased; null where there is no citation."""
    segments = F.regexp_extract_all(F.regexp_extract(text, PROVISION, 2), F.lit(SEGMENT), F.lit(1))
    return F.when(section(text).isNotNull(), F.transform(segments, F.lower))


def provision_id(sec: Column, segments: Column) -> Column:
    return F.when(sec.isNotNull(), F.concat_ws("-", F.lit("irc"), sec, segments))


def mentions(text: Column) -> Column:
    """Every citation mention in order, as written."""
    return F.regexp_extract_all(text, F.lit(MENTION), F.lit(1))


def mention_key(mention: Column) -> Column:
    """Without blanks and dots, lower-cased, without a leading ``irc``."""
    return F.regexp_replace(F.lower(F.regexp_replace(mention, r"[\s.]", "")), "^irc", "")


def token_of(citation: Column) -> Column:
    """The first identifying token, else the whole string."""
    found = F.regexp_extract(citation, TOKEN, 1)
    return F.when(found != "", found).otherwise(citation)


def citation_key(citation: Column) -> Column:
    return F.lower(F.regexp_replace(token_of(citation), r"[\s.]", ""))


def cited_tokens(text: Column) -> Column:
    """Distinct citation tokens in a text, as written."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)))


def keys_match(a: Column, b: Column) -> Column:
    """Does either key begin with the other?"""
    return a.startswith(b) | b.startswith(a)


def required(field: Column) -> Column:
    """The non-empty parts of a ``;``-separated field; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(field, F.lit("")), ";"), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: c != "")


def prefixes(key: Column) -> Column:
    """Every non-empty prefix of a short key, so that a prefix match becomes an equality."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1))), lambda n: F.substring(key, F.lit(1), n))
