"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, lowercase: bool = True) -> Column:
    """White-space separated tokens, repeats kept; punctuation is part of a token."""
    t = F.coalesce(text, F.lit(""))
    return F.filter(F.split(F.lower(t) if lowercase else t, r"\s+"), lambda x: x != "")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def prefix_key(text: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def term_vector(text: Column, terms: list[str]) -> Column:
    """A unit vector of substring counts of some terms; no occurrence at all gives a small last component.

    The text and the counts are lambda variables, so that no optimiser copies what computes them.
    """
    bound = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    count = lambda t, term: (F.length(t) - F.length(F.replace(t, F.lit(term), F.lit("")))) / F.lit(float(len(term)))
    nothing = F.array(*([F.lit(0.0)] * (len(terms) - 1)), F.lit(0.1))
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y))
    unit = lambda v: bound(size(v), lambda n: F.transform(v, lambda x: x / n))
    filled = lambda v: F.when(F.exists(v, lambda x: x > 0), v).otherwise(nothing)
    counts = bound(text, lambda t: F.array(*(count(t, term) for term in terms)))
    return bound(counts, lambda v: bound(filled(v), unit))
