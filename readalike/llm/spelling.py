"""Spelling variants of words by pivotal grams.

1. Words: maximal runs of Latin letters of every text, counted slice by slice as arrays; Spark adds up the counts. A
   seeded hash of the document's id and the run takes one letter out of every 199th kind of run.
2. Bigrams have one order for all words, rarest first, from their counts over the words: a table of at most the
   square of the alphabet. A word's prefix is its ``EDITS * 2 + 1`` first bigrams in that order (and others equal to the last of
   them). Its pivots are two disjoint bigrams of the prefix with the least counts, chosen by dynamic programming.
3. One edit can destroy only one of two disjoint bigrams. So of two near words, the pivots of that whose prefix ends
   earlier in the order have one that stands in the other's prefix. The edit lies on one side of it: up to the first
   pivot the words are alike, or from the second one to the end. Hence pivots are joined with prefix
   bigrams on the bigram together with that whole unchanged side, which fixes its position (from the word's begin or
   from its end). The other side has the one edit, so one of its halves is alike too and is part of the key, as is the
   length of the pivots' word, so keys of frequent bigrams stay short of partners.
4. Every pair that meets is verified by its exact edit distance.

The near words of largest count give each word its form, and pointers are doubled until each word has its root.
A form has at least ``RATIO`` times the count, so the longest chain has a logarithm of the largest count as length.

Nothing but the bigram counts goes through the driver. The index has some forty narrow rows a word, whatever the
text; the join reads stored tables on both sides, so adaptive execution can split a frequent key.

Defined cases: a null text has no words; a null id counts as an empty one in the hash; rows that repeat an id count
each; of near words with equally large counts the first in code-point order is the form; an empty table gives an empty
result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readalike.llm import text_arrays as ta
from readalike.llm.shipping import with_package
from readalike.sources.store import Store

LEAST_LETTERS = 6
LEAST_COUNT = 5
DAMAGED = 199   # every so many kinds of runs lose a letter
RATIO = 5
EDITS = 1
GRAM = 2
SLICE = 1 << 22
PRIME, BASE = (1 << 61) - 1, 0x5851F42D4C957F2D

_COUNTED = "word string, n long"
_KEYS = "key long, id long, last int"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
LETTER = np.zeros(256, bool)
LETTER[ord("a"):ord("z") + 1] = True
LATIN = 0xC3    # leads the two bytes of U+00C0 to U+00FF
FOLLOWS = np.zeros(256, bool)
FOLLOWS[0x80:0xC0] = True


def _crc_steps() -> np.ndarray:
    """What each byte does to a CRC-32 state."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(0xEDB88320), state >> 1)
    return state


CRC = _crc_steps()


def crc32(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """CRC-32 of every byte range, going on from the CRC in ``begin``."""
    state = begin ^ np.uint32(0xFFFFFFFF)
    size = stops - starts
    longest_first = np.argsort(-size, kind="stable")
    counts = np.bincount(size)
    active = len(size)
    for k in range(int(size.max(initial=0))):
        active -= counts[k]
        at = longest_first[:active]
        state[at] = CRC[(state[at] ^ data[starts[at] + k]) & 0xFF] ^ (state[at] >> 8)
    return state ^ np.uint32(0xFFFFFFFF)


def runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of at least ``LEAST_LETTERS`` letters of texts in lower case: start, stop, text, letters."""
    lead = data == LATIN
    second = np.zeros(len(data), bool)
    second[1:] = lead[:-1] & FOLLOWS[data[1:]]
    inside = LETTER[data] | lead | second
    edge = np.zeros(len(data) + 1, bool)
    edge[begins] = True
    edge[ends] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
    stops = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
    before = np.append(0, np.cumsum(second, dtype=np.int64))
    letters = stops - starts - (before[stops] - before[starts])
    enough = letters >= LEAST_LETTERS
    starts, stops = starts[enough], stops[enough]
    return starts, stops, np.searchsorted(ends, starts, "right"), letters[enough]


def slice_counts(part: ta.Slice, ids: list[int | None]) -> tuple[list[str], list[int]]:
    """Words of a slice and how often they occur."""
    data = LOWER[part.data]
    starts, stops, text, letters = runs(data, part.begins, part.ends)
    if not len(starts):
        return [], []
    begin = np.array([zlib.crc32(b":" if i is None else b"%d:" % i) for i in ids], np.uint32)
    hashed = crc32(data, starts, stops, begin[text])
    hit = hashed % DAMAGED == 0
    whole = np.flatnonzero(~hit)
    raw = data.tobytes()
    found, example, which = ta.distinct(ta.span_hashes(data, starts[whole], stops[whole]))
    example = whole[example]
    words = [raw[a:b].decode() for a, b in zip(starts[example].tolist(), stops[example].tolist(), strict=True)]
    counts = np.bincount(which, minlength=len(found)).tolist()
    for k in np.flatnonzero(hit & (letters > LEAST_LETTERS)).tolist():
        word = raw[starts[k]:stops[k]].decode()
        at = int(hashed[k]) % len(word)
        words.append(word[:at] + word[at + 1:])
        counts.append(1)
    return words, counts


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts, words of at least ``LEAST_COUNT`` occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for part in ta.slices(batch.column("text"), SLICE):
                words, counts = slice_counts(part, ids[part.first:part.first + part.n])
                yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array(counts, pa.int64())})

    narrow = with_package(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = narrow.filter("text IS NOT NULL").mapInArrow(count, _COUNTED)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def gram_ranks(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Rank, rarest first, and count of every bigram; there are no more than pairs of letters."""
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - GRAM + 1),
                                 lambda i: F.col("word").substr(i, F.lit(GRAM))))
    counts = words.select(gram.alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    order = sorted((r.n, r.gram) for r in counts)
    return {gram: (rank, n) for rank, (n, gram) in enumerate(order)}


def prefix(word: str, ranks: dict[str, tuple[int, int]]) -> tuple[list[int], int]:
    """Places of the word's first bigrams in the common order, and the rank of the last."""
    ranked = sorted((ranks[word[i:i + GRAM]][0], i) for i in range(len(word) - GRAM + 1))
    last = ranked[GRAM * EDITS][0]
    return sorted(i for rank, i in ranked if rank <= last), last


def pivots(word: str, places: list[int], ranks: dict[str, tuple[int, int]]) -> list[int]:
    """``EDITS + 1`` disjoint places of least total count.

    best[m] is the cheapest choice of m disjoint bigrams among the places looked at so far;
    a bigram joins the best choice among those that end before it.
    """
    need = EDITS + 1
    nothing: list[tuple[int, list[int]] | None] = [(0, [])] + [None] * need
    best_after = [(-GRAM, nothing)]
    for place in places:
        best = list(best_after[-1][1])
        free = next(table for last, table in reversed(best_after) if last + GRAM <= place)
        cost = ranks[word[place:place + GRAM]][1]
        for m in range(need):
            if free[m] is not None:
                joined = (free[m][0] + cost, free[m][1] + [place])
                if best[m + 1] is None or joined < best[m + 1]:
                    best[m + 1] = joined
        best_after.append((place, best))
    return best_after[-1][1][need][1]


_powers = [1]


class Way:
    """A word read from one of its ends: number of any stretch from running polynomial sums."""

    def __init__(self, letters: str):
        self.n = len(letters)
        self.sums = [0]
        for letter in letters:
            self.sums.append((self.sums[-1] * BASE + ord(letter)) % PRIME)
        while len(_powers) <= self.n:
            _powers.append(_powers[-1] * BASE % PRIME)

    def keys(self, side: int, end: int, n: int) -> Iterator[int]:
        """Keys of a pair alike in the first ``end`` letters, whose pivots' word has ``n`` letters: in the rest of that
        word the first half is alike too, or the second one, counted from the other end. Numbers of whole tuples, equal
        in all processes; unlike stretches with the same key cost a verification."""
        first = (n - end) // 2
        second = n - end - first
        if end + first <= self.n:
            yield hash((side, n, end, 0, self.sums[end + first]))
        if end + second <= self.n:
            tail = (self.sums[self.n] - self.sums[self.n - second] * _powers[second]) % PRIME
            yield hash((side, n, end, 1, self.sums[end], tail))


def pivot_keys(word: str, chosen: list[int]) -> Iterator[int]:
    """Keys of one word under which a near word whose prefix holds the pivot is found: all up to the first
    pivot's end is alike, or all from the second pivot on."""
    n = len(word)
    yield from Way(word).keys(0, chosen[0] + GRAM, n)
    yield from Way(word[::-1]).keys(1, n - chosen[-1], n)


def prefix_keys(word: str, places: list[int]) -> Iterator[int]:
    """Keys under which pivots of a word with one letter less, as many, or one more find this one."""
    n = len(word)
    ways = Way(word), Way(word[::-1])
    for place in places:
        for side, end in ((0, place + GRAM), (1, n - place)):
            for other in range(max(LEAST_LETTERS, end, n - EDITS), n + EDITS + 1):
                yield from ways[side].keys(side, end, other)


def index_rows(words: DataFrame, ranks: dict[str, tuple[int, int]], pivot: bool) -> DataFrame:
    """(key, id, last) of (id, word): the pivots' index or that of the prefixes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                some = batch.slice(begin, 2000)
                out: list[int] = []
                each, lasts = [], []
                for word in some.column("word").to_pylist():
                    places, last = prefix(word, ranks)
                    keys = set(pivot_keys(word, pivots(word, places, ranks)) if pivot else prefix_keys(word, places))
                    out.extend(keys)
                    each.append(len(keys))
                    lasts.append(last)
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(out, pa.int64()), "id": some.column("id").take(pa.array(np.repeat(np.arange(len(each)), each))),
                    "last": pa.array(np.repeat(np.array(lasts, np.int32), each))})

    return with_package(words).select("id", "word").mapInArrow(rows, _KEYS)


def near_pairs(words: DataFrame, store: Store) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of words at one inserted, deleted or replaced letter, each once. A word's hash
    stands for it in the index, so that a long one isn't repeated; two words of the same hash are both looked at."""
    ranks = gram_ranks(words)
    named = store.write(words.withColumn("id", F.xxhash64("word")))
    pivot = store.write(index_rows(named, ranks, True))
    other = store.write(index_rows(named, ranks, False))
    p, q = pivot.alias("p"), other.alias("q")
    met = p.join(q, F.col("p.key") == F.col("q.key")).filter(F.col("p.last") <= F.col("q.last"))
    met = store.write(met.select(F.least("p.id", "q.id").alias("x"), F.greatest("p.id", "q.id").alias("y")).distinct())
    x = named.select(F.col("id").alias("x"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    y = named.select(F.col("id").alias("y"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    return met.filter("x <> y").join(x, "x").join(y, "y").filter(F.levenshtein("a", "b", EDITS) == EDITS).select(
        "a", "a_n", "b", "b_n")


def roots(forms: DataFrame, store: Store) -> DataFrame:
    """(word, root) of every word with a form, by doubling pointers."""
    at = store.write(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("via"), F.col("root").alias("next"))
        at = store.write(at.join(further, F.col("root") == F.col("via"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if at.filter("moved").isEmpty():
            return at.select("word", "root")


def variants(words: DataFrame, store: Store) -> DataFrame:
    """Per word of (word, n): form, root, n, n_near, form_n."""
    pairs = store.write(near_pairs(words, store))
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    grouped = both.groupBy("word", "n").agg(best.alias("best"), F.count(F.lit(1)).alias("n_near"))
    holds = -F.col("best.less") >= RATIO * F.col("n")
    near = store.write(grouped.select(
        "word", "n_near", F.when(holds, F.col("best.near")).alias("form"), F.when(holds, -F.col("best.less")).alias("form_n")))
    rooted = roots(near.filter("form IS NOT NULL"), store)
    return words.join(near, "word", "left").join(rooted, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, store: Store) -> DataFrame:
    """Words of (doc_id, text), each with its near words' number, its form and its root."""
    return variants(store.write(word_counts(docs)), store)
