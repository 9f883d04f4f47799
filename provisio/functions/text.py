"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of the sparse index (fixed values).
STOPWORDS = (
    "a an the and or but if is are was were be been being do does did "
    "what which who whom this that these those to of in on at for from "
    "with as by it its into about how when where why not no can could "
    "should would will shall may might must have has had i you he she "
    "we they them his her their your my our"
).split()

#: Lines that page generators put on every page (fixed values).
FURNITURE = (
    r"Page\s+\d+\s+of\s+\d+",
    r"\d{1,2}:\d{2}\s*-\s*\d{1,2}-[A-Za-z]{3}-\d{4}",
    r"AH XSL/XML",
    r"Publication\s+\d+\s*\(\d{4}\)",
    r"\b(Userid|Fileid|Schema|Leadpct)\s*:",
    r"Draft Ok to Print",
)


def tokens(text: Column) -> Column:
    """Lower-cased word runs without stopwords; null text has none. Letters and digits of any script count."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS))


def slug(text: Column) -> Column:
    """Lower case, everything but ASCII letters and digits collapsed to single dashes, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def is_furniture(line: Column) -> Column:
    return line.rlike("(?i)" + "|".join(f"(?:{p})" for p in FURNITURE))


def has_real_word(line: Column) -> Column:
    return line.rlike("[A-Za-z]{3,}")


def display_safe(text: Column) -> Column:
    """Dollar signs escaped, so that a renderer doesn't take them for formulas."""
    return F.replace(text, F.lit("$"), F.lit("\\$"))
