"""Text expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from readalike import params

WHITESPACE = " \t\n\r\x0b\x0c"


def strip(col: Column) -> Column:
    """Trim every kind of ASCII whitespace, not only spaces."""
    return F.btrim(col, F.lit(WHITESPACE))


def lower_trim(col: Column) -> Column:
    return F.trim(F.lower(col))


def is_blank(col: Column) -> Column:
    return F.coalesce(col, F.lit("")) == ""


def title_by_author(title: Column, author: Column) -> Column:
    """``title by author``, or the title alone when there is no author."""
    return F.when(is_blank(author), F.coalesce(title, F.lit(""))).otherwise(
        F.concat(F.coalesce(title, F.lit("")), F.lit(" by "), author)
    )


def tag_set(subjects: Column) -> Column:
    """Distinct trimmed lower-case tags of a comma-joined string."""
    parts = F.transform(F.split(F.coalesce(subjects, F.lit("")), ","), lambda t: F.lower(strip(t)))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def age_bracket(age: Column) -> Column:
    """Label of the bracket that holds the age; null outside all of them."""
    return F.coalesce(*[
        F.when((age >= first) & (age <= last), label) for first, last, label in params.AGE_BRACKETS])


def genre(subjects: Column, keywords=params.GENRE_KEYWORDS) -> Column:
    """First genre, in the fixed order, with a keyword inside the subjects."""
    text = F.lower(subjects)
    hits = [F.when(reduce(or_, (text.contains(word) for word in words)), name) for name, words in keywords]
    return F.coalesce(*hits, F.lit("Other"))


def ngrams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1)))
    grams = F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.coalesce(grams, F.array().cast("array<string>")))
