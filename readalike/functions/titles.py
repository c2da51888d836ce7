"""Edition test: are two titles nearly the same string?

The measure is the indel ratio 200 * LCS / (len(a) + len(b)), compared in
integers. Most pairs never need the LCS: the indel distance lies between the
Levenshtein distance and twice that, so length and Levenshtein decide them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from readalike import params


WORD_BITS = 62  # of a long, so that a sum with carry stays within it


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda other expressions are evaluated anew each time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence, bit-parallel.

    A bit per character of ``a`` says whether the length does not grow there. Each character of ``b``
    updates all bits with one addition: with the places U of the character among the bits V that are set, V becomes
    (V + U) | (V - U). The number is spread over words of ``WORD_BITS`` bits, through which the carry is folded.
    """
    full = (1 << WORD_BITS) - 1

    def places(chars: Column) -> Column:
        """Per distinct character a word's bits for each word of ``a``."""
        def word(char: Column, w: Column) -> Column:
            within = F.slice(chars, w * WORD_BITS + 1, WORD_BITS)
            hit = F.transform(within, lambda c, i: F.when(c == char, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(
                F.lit(0).cast("long")))
            return F.aggregate(hit, F.lit(0).cast("long"), lambda total, bit: total + bit)

        keys = F.array_distinct(chars)
        return F.map_from_arrays(keys, F.transform(keys, lambda char: F.transform(
            F.sequence(F.lit(0), words(chars) - 1), lambda w: word(char, w))))

    def words(chars: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.size(chars) / WORD_BITS).cast("int"))

    def update(bits: Column, masks: Column) -> Column:
        """The words of V after a character with these places; a null mask is a character that ``a`` lacks."""
        start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("done"))

        def step(state: Column, pair: Column) -> Column:
            v, m = pair["v"], pair["m"]
            total = v + v.bitwiseAND(m) + state["carry"]
            new = total.bitwiseAND(F.lit(full)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m)))
            return F.struct(F.shiftright(total, WORD_BITS).alias("carry"), F.concat(state["done"], F.array(new)).alias("done"))

        pairs = F.zip_with(bits, masks, lambda v, m: F.struct(v.alias("v"), m.alias("m")))
        return F.when(masks.isNull(), bits).otherwise(F.aggregate(pairs, start, step)["done"])

    def fold(both: Column) -> Column:
        start = F.array_repeat(F.lit(full), both["words"])
        last = F.aggregate(F.split(b, ""), start, lambda bits, char: update(bits, F.try_element_at(both["places"], char)))
        unset = F.aggregate(last, F.lit(0), lambda total, v: total + F.lit(WORD_BITS) - F.bit_count(v))
        return unset

    return _let(F.split(a, ""), lambda chars: _let(
        F.struct(places(chars).alias("places"), words(chars).alias("words")), fold))


def is_edition(a: Column, b: Column, ratio: int = params.EDITION_RATIO) -> Column:
    """True when the lower-cased titles reach ``ratio``; blank titles never do."""
    a, b = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    total = F.length(a) + F.length(b)
    # indel distance d = total - 2 * LCS; an edition has 100 * d <= budget
    budget = total * (100 - ratio)
    distance = F.levenshtein(a, b)
    return (
        F.when((a == "") | (b == ""), F.lit(False))
        .when(a == b, F.lit(True))
        .when(F.abs(F.length(a) - F.length(b)) * 100 > budget, F.lit(False))
        .when(distance * 100 > budget, F.lit(False))
        .when(distance * 200 <= budget, F.lit(True))
        .otherwise(lcs_length(a, b) * 200 >= total * ratio)
    )
