"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items become tokens: lower-cased runs of letters, digits and
non-ASCII characters. A text and an item meet if they share a seed of ``SEED`` tokens. The
hashes of all windows of that length come from a running polynomial; seeds
on one diagonal join to matches, the longest match whose tokens are free on both
sides becomes a tile, what is left of cut matches goes back to the queue, and so on
until no free match of ``SEED`` tokens is left. Where tokens repeat so often that places with the same seed are too many to list,
the same tiles are found length by length in memory of both texts' size. Tiles may lie in any order, so
reordered passages count in full. A text is contaminated if the tiles of one item
cover ``COVERAGE`` of its tokens.

The benchmark is the query set: it goes to the tasks in blocks of about
``BLOCK_BYTES`` of text, one chained pass over the documents for each block, and documents
are never shuffled. Within a task each text's seeds are looked up in
the block's sorted seeds, so only texts that share a seed are tiled.

Defined cases: null or empty texts and items match nothing; an item shorter than a
seed is matched as a whole; of items that cover alike the smallest id is
named; rows are judged each for itself, also those with null or repeated ids, for any number of blocks:
every pass hands on each row's text and its best item so far.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readalike.llm import text_arrays as ta
from readalike.llm.near_dedup import pieces
from readalike.llm.shipping import with_package

SEED = 5
COVERAGE = 0.5
BLOCK_BYTES = 4 << 20
FILTER_BITS = 20
PAIRS = 1 << 18    # of places with the same seed, up to which they are listed

BEST = ("item_id", "item_tokens", "tiled_tokens", "n_tiles")

_APART = np.zeros(256, bool)
_APART[:128] = [not chr(c).isalnum() for c in range(128)]


@dataclass
class Block:
    """Items, and by seed length the distinct pairs of seed and item, sorted by hash, with their number
    and a filter of the hashes."""
    ids: list[int | None]
    tokens: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def tokens(texts: pa.Array) -> Iterator[tuple[ta.Slice, ta.Words]]:
    for part in ta.slices(pc.utf8_lower(texts.cast(pa.large_string()))):
        yield part, ta.words(part, _APART)


def block_of(ids: list[int | None], texts: list[str | None]) -> Block:
    items: list[np.ndarray] = []
    by_length: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for part, found in tokens(pa.array(texts, pa.large_string())):
        first = found.first
        for i in range(part.n):
            items.append(found.hash[first[i]:first[i] + found.per_text[i]])
        for n in range(1, SEED + 1):
            code, at = ta.grams(found, n)
            item = found.text[at]
            mine = (found.per_text[item] == n) if n < SEED else np.ones(len(at), bool)
            if mine.any():
                by_length.setdefault(n, []).append((code[mine], item[mine] + part.first))
    seeds = {}
    for n, rows in by_length.items():
        code, item, times = counted(*(np.concatenate(x) for x in zip(*rows, strict=True)))
        may = np.zeros(1 << FILTER_BITS, bool)
        may[(code >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        seeds[n] = code, item, times, may
    return Block(ids, items, seeds)


def counted(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of hash and owner in that order, and how often each occurs."""
    order = np.lexsort((owner, code))
    code, owner = code[order], owner[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    return code[begin], owner[begin], np.diff(np.append(begin, len(code)))


def benchmark_blocks(benchmark: DataFrame) -> Iterator[Block]:
    """Blocks of the benchmark; each goes through the driver by itself."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield block_of([r["item_id"] for r in rows], [r["text"] for r in rows])


def meetings(found: ta.Words, block: Block) -> list[tuple[int, int, int, int]]:
    """Texts and items that share seeds: (text, item, seed length, pairs of places with the same seed)."""
    out = []
    for n, (code, item, times, may) in block.seeds.items():
        mine, at = ta.grams(found, n)
        keep = may[(mine >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
        mine, text, often = counted(mine[keep], found.text[at[keep]])
        low, high = np.searchsorted(code, mine, "left"), np.searchsorted(code, mine, "right")
        size = high - low
        which = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        text, item_of, pairs = np.repeat(text, size), item[which], np.repeat(often, size) * times[which]
        order = np.lexsort((item_of, text))
        text, item_of, pairs = text[order], item_of[order], pairs[order]
        if len(text):
            begin = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (item_of[1:] != item_of[:-1])))
            out.extend(zip(text[begin].tolist(), item_of[begin].tolist(), [n] * len(begin),
                           np.add.reduceat(pairs, begin).tolist(), strict=True))
    return sorted(out)


def windows(sequence: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``n`` tokens, from running sums."""
    up, down = ta.powers(len(sequence) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sequence * up[:len(sequence)], dtype=np.uint64)])
        return ta.mixed((sums[n:] - sums[:-n]) * down[:len(sequence) - n + 1])


def places(text: np.ndarray, item: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places in text and item with the same ``n`` tokens (by hash)."""
    mine, theirs = windows(text, n), windows(item, n)
    order = np.argsort(theirs, kind="stable")
    low, high = np.searchsorted(theirs[order], mine, "left"), np.searchsorted(theirs[order], mine, "right")
    size = high - low
    which = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(np.arange(len(mine)), size), order[which]


def tile_by_length(text: np.ndarray, item: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """The tiles of ``tile`` without its list of all pairs of places, which for repeated tokens is as long as
    both texts' product: the largest length at which free windows agree is found by bisection with
    running Karp-Rabin hashes, its matches are marked in order of place, and so on with smaller lengths."""
    taken_p, taken_q = np.zeros(len(text), np.int64), np.zeros(len(item), np.int64)
    tiles: list[tuple[int, int, int]] = []

    def free(taken: np.ndarray, length: int) -> np.ndarray:
        sums = np.append(0, np.cumsum(taken))
        return sums[length:] == sums[:-length]

    def agreeing(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Free places of the text that agree with a free window of the item, and the item's free places and hashes."""
        q = np.flatnonzero(free(taken_q, length))
        theirs = windows(item, length)[q]
        p = np.flatnonzero(free(taken_p, length))
        return p[np.isin(windows(text, length)[p], theirs)], q, theirs

    most = min(len(text), len(item))
    while most >= n:
        low, high = n - 1, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(agreeing(middle)[0]) else (low, middle - 1)
        if low < n:
            break
        p, q, theirs = agreeing(low)
        mine = windows(text, low)
        waiting: dict[int, list[int]] = {}
        for place, code in zip(q[::-1].tolist(), theirs[::-1].tolist(), strict=True):
            waiting.setdefault(code, []).append(place)      # the first place is the last of the list
        before = len(tiles)
        end = 0
        for a in p.tolist():
            if a < end or not waiting:
                continue
            left = waiting.get(int(mine[a]), [])
            while left and taken_q[left[-1]:left[-1] + low].any():
                left.pop()
            if not left:
                waiting.pop(int(mine[a]), None)
                continue
            b = left.pop()
            if (text[a:a + low] == item[b:b + low]).all():
                tiles.append((low, a, b))
                taken_p[a:a + low] = taken_q[b:b + low] = 1
                end = a + low
        most = low if len(tiles) > before else low - 1
    return tiles


def matches(p: np.ndarray, q: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Seeds (place in text, place in item) that follow each other, joined: (length, p, q)."""
    order = np.lexsort((q, p - q))
    p, q = p[order], q[order]
    new = np.append(True, (p[1:] - q[1:] != p[:-1] - q[:-1]) | (q[1:] != q[:-1] + 1))
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(p))) + n - 1
    return list(zip(length.tolist(), p[begin].tolist(), q[begin].tolist(), strict=True))


def free_runs(taken_p: set[int], taken_q: set[int], length: int, p: int, q: int) -> list[tuple[int, int, int]]:
    """What of a match is free on both sides, as runs."""
    runs, begin = [], None
    for k in range(length + 1):
        free = k < length and p + k not in taken_p and q + k not in taken_q
        if free and begin is None:
            begin = k
        elif not free and begin is not None:
            runs.append((k - begin, p + begin, q + begin))
            begin = None
    return runs


def tile(text: np.ndarray, item: np.ndarray, p: np.ndarray, q: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Tiles (length, place in text, place in item), the longest free match first; ties go to
    the earliest place. Tokens are compared again, so equal seed hashes alone make no tile."""
    same = np.ones(len(p), bool)
    for k in range(n):
        same &= text[p + k] == item[q + k]
    queue = [(-length, a, b) for length, a, b in matches(p[same], q[same], n)] if same.any() else []
    heapq.heapify(queue)
    taken_p: set[int] = set()
    taken_q: set[int] = set()
    tiles = []
    while queue:
        length, a, b = heapq.heappop(queue)
        runs = free_runs(taken_p, taken_q, -length, a, b)
        if runs == [(-length, a, b)]:
            tiles.append(runs[0])
            taken_p.update(range(a, a - length))
            taken_q.update(range(b, b - length))
        else:
            for run in runs:
                if run[0] >= n:
                    heapq.heappush(queue, (-run[0], run[1], run[2]))
    return tiles


def best_items(texts: pa.Array, block: Block) -> dict[str, list]:
    """For every text the item that its tiles cover most."""
    out: dict[str, list] = {name: [] for name in ("item", "tiled", "tiles")}
    for part, found in tokens(texts):
        best: list[tuple[int | None, int, int]] = [(None, 0, 0)] * part.n
        if block.seeds and len(found.hash):
            for t, i, n, pairs in meetings(found, block):
                begin = found.first[t]
                text, item = found.hash[begin:begin + found.per_text[t]], block.tokens[i]
                tiles = tile(text, item, *places(text, item, n), n) if pairs <= PAIRS else tile_by_length(text, item, n)
                covered = sum(x[0] for x in tiles)
                have = best[t]
                if covered and (have[0] is None or covered * len(block.tokens[have[0]]) > have[1] * len(block.tokens[i])):
                    best[t] = (i, covered, len(tiles))
        for name, column in zip(out, zip(*best, strict=True), strict=True):
            out[name].extend(column)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row: the item it covers most, and the verdict."""
    found = with_package(docs).select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(None).cast("long").alias("item_id"),
        *(F.lit(0).cast("long").alias(c) for c in ("item_tokens", "tiled_tokens", "n_tiles")))
    for block in benchmark_blocks(benchmark):
        found = found.mapInArrow(_better(block), found.schema)
    share = F.when(F.col("item_tokens") > 0, F.col("tiled_tokens") / F.col("item_tokens")).otherwise(0.0)
    return found.select("doc_id", "item_id", "item_tokens", "tiled_tokens", "n_tiles", share.alias("coverage"),
                        (share >= COVERAGE).alias("contaminated"))


def _better(block: Block):
    """Every row with the item of the block if that covers more than the row's item so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            best = best_items(batch.column("text"), block)
            columns = [batch.column(c).to_pylist() for c in BEST]
            rows = []
            for i, tiled, tiles, *have in zip(best["item"], best["tiled"], best["tiles"], *columns, strict=True):
                if i is not None:
                    item, size = block.ids[i], len(block.tokens[i])
                    # Null ids come first, as in a block; a row without an item so far has no tokens tiled.
                    gain = tiled * (have[1] or 1) - have[2] * size
                    if gain > 0 or (gain == 0 and have[0] is not None and (item is None or item < have[0])):
                        have = [item, size, tiled, tiles]
                rows.append(have)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text": batch.column("text"),
                **{c: pa.array(column, pa.int64()) for c, column in zip(BEST, zip(*rows, strict=True), strict=True)}})
    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no benchmark item contaminates, all columns as they are."""
    place = docs.columns.index("text")

    def clean(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                if batch.num_rows:
                    best = best_items(batch.column(place), block)
                    yield batch.filter(pa.array([
                        i is None or t < COVERAGE * len(block.tokens[i])
                        for i, t in zip(best["item"], best["tiled"], strict=True)], pa.bool_()))
        return run

    kept = with_package(docs)
    for block in benchmark_blocks(benchmark):
        kept = kept.mapInArrow(clean(block), docs.schema)
    return kept
