"""N-gram Jaccard join as a blocked sparse matrix product.

The rows of the matrix A are the documents' sets of word n-grams (five words, see ``shingles``), its columns the
n-grams. Entries of AAᵀ are overlaps, and two documents are linked if the overlap is large enough against both sizes:
100 * I >= 80 * (a + b - I), that is 9 * I >= 4 * (a + b), in whole numbers. The product is never formed whole:

1. Equal sets are one row of A, whatever their number. Sizes a <= b can be linked only if 5 * a >= 4 * b.
2. Columns have one order, n-grams of rare hash buckets first (counted over all documents, in a table of fixed size;
   it decides cost, not results). A linked pair shares at least 4/5 of the larger row, so of the first
   n - ceil(4 n / 5) + l columns of each it shares l or more: only this block of A is multiplied out, with l = n / 20 + 1
   of the smaller row. Columns in which the block has a single entry go, then rows with fewer than the least l of a fitting size.
3. A column with m entries would add m * m / 2 products. First each entry meets two of its column, the row with most entries
   and its neighbour in that order; pairs that meet in l columns or more are verified, and linked rows are joined to components. Columns
   whose rows are one component have nothing left to say.
4. Other columns of at most ``LIGHT`` entries are multiplied out for rows of different components. Overlaps
   are accumulated over all columns, and a pair is discarded if even with all columns that can still count it stays
   below the bound: what it shares in the block, at most all of its longer columns, and the larger rest outside the block.
5. Columns with more entries are multiplied in cells of bounded size, chunk of rows by chunk of rows, inside a task, with whole
   sets, and only between components; a cell returns links that join components, at most one fewer than its rows.
   So many texts that are similar but not linked cost time to the square of their number, in
   bounded cells over all tasks, and never rows.

Every link that is used was verified on whole sets, and every pair that could be a link was verified or lies in one
component already, so the components are exact but for collisions of 64-bit n-gram hashes. Which links connect a component depends
on that order; ``links`` are enough to connect it, not all pairs in it.

What goes through the driver has a fixed size: the bucket counts, and a bitmap of ids that tells which texts
are read again. Where that is full in very large tables, more sets are stored than needed; results don't change.

Defined cases: a document without text or words has an empty set and is its own component; one of fewer words than n has the whole
sequence as its only n-gram; a null id has no component (null) and takes no part in links; rows that
repeat an id are each returned, and the id is linked with whatever one of its texts is linked with; an empty table
gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readalike.llm import text_arrays as ta
from readalike.llm.near_dedup import components, shingles
from readalike.llm.shipping import with_package
from readalike.sources.buckets import write_bucketed
from readalike.sources.store import Store

BUCKETS = 1 << 18
SLICE = 1 << 18
LIGHT = 64              # entries of a column that is multiplied out as rows
CELL = 1 << 20          # n-grams in a chunk of a cell
FILTER_BITS = 1 << 27   # of the bitmap of ids at most

_COUNTED = "doc_id long, n int, digest binary, bucket int, df long"
_ROW = "digest binary, doc_id long, n int, prefix array<long>"
_ENTRY = "shingle long, member long, n int"
_SET = "member long, codes binary"
_LINK = "a long, b long, overlap long"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def sets(texts: pa.Array) -> Iterator[tuple[ta.Slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slice by slice the texts with words, where each one's sorted n-grams begin and end, and the n-grams."""
    for part in ta.slices(texts, SLICE):
        owner, code, _ = shingles(ta.Slice(part.first, LOWER[part.data], part.begins, part.ends))
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        yield part, owner[first], first, np.append(first[1:], len(code))[:len(first)], code


def bucket_of(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint64(20) & np.uint64(BUCKETS - 1)).astype(np.int64)


def digest_of(codes: np.ndarray) -> bytes:
    return hashlib.md5(codes.tobytes(), usedforsecurity=False).digest()


def counted_rows(docs: DataFrame, store: Store) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, digest) of every document, stored, and how many sets have an n-gram in each hash bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part, who, first, last, code in sets(batch.column("text")):
                df += np.bincount(bucket_of(code), minlength=BUCKETS)
                size = np.zeros(part.n, np.int32)
                size[who] = last - first
                digests: list[bytes | None] = [None] * part.n
                for t, a, b in zip(who.tolist(), first.tolist(), last.tolist(), strict=True):
                    digests[t] = digest_of(code[a:b])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(part.first, part.n), "n": size, "digest": pa.array(digests, pa.binary()),
                    "bucket": pa.nulls(part.n, pa.int32()), "df": pa.nulls(part.n, pa.int64())})
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.nulls(len(used), pa.int64()), "n": pa.nulls(len(used), pa.int32()), "digest": pa.nulls(len(used), pa.binary()),
            "bucket": used.astype(np.int32), "df": df[used]})

    both = store.write(docs.mapInArrow(count, _COUNTED))
    found = both.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found["bucket"]] = found["df"]
    return both.filter("bucket IS NULL").select("doc_id", "n", "digest"), counts


def least_shared(n: int) -> int:
    """Columns of the block that a linked pair shares, whose smaller row has ``n``."""
    return n // 20 + 1


def prefix_length(n: int) -> int:
    return min(n, n - (4 * n + 4) // 5 + least_shared(n))


def matrix_rows(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(member, n, prefix): of each distinct set its smallest id, its size and its columns of the block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, who, first, last, code in sets(batch.column("text")):
                df = counts[bucket_of(code)]
                digests, prefixes = [], []
                for a, b in zip(first.tolist(), last.tolist(), strict=True):
                    mine = code[a:b]
                    digests.append(digest_of(mine))
                    prefixes.append(mine[np.lexsort((mine, df[a:b]))[:prefix_length(b - a)]].view(np.int64))
                yield pa.RecordBatch.from_pydict({
                    "digest": pa.array(digests, pa.binary()), "doc_id": batch.column("doc_id").take(pa.array(who + part.first)),
                    "n": (last - first).astype(np.int32), "prefix": pa.array(prefixes, pa.list_(pa.int64()))})

    found = docs.filter("doc_id IS NOT NULL").mapInArrow(rows, _ROW)
    first = found.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "prefix")).alias("first"))
    return first.select(F.col("first.doc_id").alias("member"), "first.n", "first.prefix")


def shared_entries(entries: DataFrame) -> DataFrame:
    """Entries (shingle, member, n) of columns that have several, found in one pass over sorted rows."""

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, if its like may still come
        before = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            shingle = batch.column("shingle").to_numpy()
            like_last = np.append(shingle[0] == before if held is None and before is not None else False, shingle[1:] == shingle[:-1])
            like_next = np.append(shingle[1:] == shingle[:-1], False)
            keep = like_last | like_next
            yield batch.filter(pa.array(keep))
            before = shingle[-1]
            held = None if keep[-1] else batch.slice(batch.num_rows - 1)

    return entries.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(several, _ENTRY)


def id_bitmap(ids: DataFrame, n: int) -> np.ndarray:
    """Bits of the ids in ``member``: up to sixteen bits an id, in a bitmap of at most ``FILTER_BITS``."""
    bits = int(min(FILTER_BITS, max(1 << 16, 1 << (16 * n).bit_length())))
    bit = F.pmod(F.xxhash64("member"), F.lit(bits))
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(bit & 31))")).alias("mask")).toPandas()
    bitmap = np.zeros(bits >> 5, np.uint32)
    bitmap[words["word"]] = words["mask"].astype(np.uint32)
    return bitmap


def packed_sets(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(member, codes): whole sets of the documents that the bitmap lets pass."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((bitmap[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1))
            for part, who, first, last, code in sets(batch.column("text")):
                yield pa.RecordBatch.from_pydict({
                    "member": batch.column("doc_id").take(pa.array(who + part.first)),
                    "codes": pa.array([code[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary())})

    bit = F.pmod(F.xxhash64("doc_id"), F.lit(len(bitmap) << 5)).alias("bit")
    return docs.select("doc_id", "text", bit).mapInArrow(pack, _SET)


def dealt_sets(packed: DataFrame, store: Store) -> DataFrame:
    """The sets, stored in buckets of their rows: they are shuffled for this once and by no join with them."""
    buckets = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return write_bucketed(packed, store.folder("sets"), "member", buckets=buckets)


def enough(overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 9 * overlap >= 4 * (a + b)


def sizes_fit(a: str, b: str) -> Column:
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def verified(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """Pairs (a, b) that are links, with the overlap of the whole sets."""

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            left = [np.frombuffer(v.as_buffer(), np.uint64) for v in x]
            right = [np.frombuffer(v.as_buffer(), np.uint64) for v in y]
            same = np.array([common(p, q) for p, q in zip(left, right, strict=True)], np.int64)
            near = enough(same, np.array([len(p) for p in left], np.int64), np.array([len(q) for q in right], np.int64))
            yield pa.RecordBatch.from_pydict({
                "a": batch.column("a"), "b": batch.column("b"), "overlap": same}).filter(pa.array(near))

    a, b = (packed.select(F.col("member").alias(k), F.col("codes").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(overlaps, _LINK)


def common(p: np.ndarray, q: np.ndarray) -> int:
    """How many values two sorted arrays share."""
    if len(p) > len(q):
        p, q = q, p
    place = np.minimum(np.searchsorted(q, p), len(q) - 1)
    return int((q[place] == p).sum())


def centre_pairs(entries: DataFrame) -> DataFrame:
    """Every entry's row with the first of its column and with the one before it, as pairs a < b of fitting sizes. Rows with
    most entries come first: a text that others were made from shares more columns than they do. Pairs that meet in fewer
    columns than a link shares are left out, as they are seldom links and their sets would be sent for nothing; those that
    are have different components or are joined by others, so steps 4 and 5 find them."""
    by_entries = Window.partitionBy("shingle").orderBy(F.desc("entries"), "n", "member")
    row = F.struct("member", "n")
    placed = entries.select("member", "n", F.first(row).over(by_entries).alias("top"), F.lag(row).over(by_entries).alias("last"))
    met = placed.select("member", "n", F.explode(F.array("top", "last")).alias("c"))
    met = met.filter((F.col("member") != F.col("c.member")) & sizes_fit("n", "c.n"))
    times = met.groupBy(F.least("member", "c.member").alias("a"), F.greatest("member", "c.member").alias("b")).agg(
        F.count(F.lit(1)).alias("times"), F.min(F.least("n", "c.n")).alias("small"))
    return times.filter(F.col("times") >= F.expr("small div 20 + 1")).select("a", "b")


def shared_by(n: str) -> Column:
    """``least_shared`` of the smallest set that fits a column's size."""
    return F.expr(f"(4 * {n} + 4) div 5 div 20 + 1")


def full_rows(entries: DataFrame, store: Store) -> DataFrame:
    """Entries of rows that have enough of them to be linked with any other, and how many they have. They are stored in
    buckets of their rows, so they are shuffled for this once and not again when the rows get labels."""
    buckets = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_row = Window.partitionBy("member", "n")   # at most the columns of the block
    counted = entries.repartition(buckets, "member").withColumn("entries", F.count(F.lit(1)).over(of_row))
    return write_bucketed(counted.filter(F.col("entries") >= shared_by("n")), store.folder("entries"), "member",
                          buckets=buckets, dealt=True)


def light_pairs(light: DataFrame, heavy: DataFrame) -> DataFrame:
    """Pairs of different components that share a light column, unless the overlap accumulated over the light columns is
    too small even if all heavy columns and all of the larger rest were shared."""
    long_ones = heavy.groupBy("member").agg(F.count(F.lit(1)).alias("heavy"))
    rows = light.join(long_ones, "member", "left").select(
        "shingle", "member", "part", "n", F.coalesce("heavy", F.lit(0)).alias("heavy"))
    x, y = rows.alias("x"), rows.alias("y")
    met = x.join(y, F.col("x.shingle") == F.col("y.shingle")).filter(
        (F.col("x.member") < F.col("y.member")) & (F.col("x.part") != F.col("y.part")) & sizes_fit("x.n", "y.n"))
    overlap = met.groupBy(F.col("x.member").alias("a"), F.col("y.member").alias("b"), F.col("x.n").alias("an"), F.col("y.n").alias("bn")).agg(
        F.count(F.lit(1)).alias("seen"), F.max(F.least("x.heavy", "y.heavy")).alias("heavy"))
    at_most = F.col("seen") + F.col("heavy")
    rest = F.greatest(F.lit(0), *[F.expr(f"(4 * {n} + 4) div 5 - {n} div 20 - 1") for n in ("an", "bn")])  # columns outside the block
    return overlap.filter((9 * (at_most + rest) >= 4 * (F.col("an") + F.col("bn")))
                          & (at_most >= F.expr("least(an, bn) div 20 + 1"))).select("a", "b").distinct()


def cell_links(table: pa.Table) -> pa.Table:
    """Links that join the components of one cell: chunk ``one`` of a column's rows against the others, or all if it
    is the only chunk. Overlaps of a row with all others are one product of its indicator with the cell."""
    rows = sorted(zip(table.column("member").to_pylist(), table.column("part").to_pylist(),
                      table.column("one").to_pylist(), table.column("codes").to_pylist(), strict=True))
    found: list[tuple[int, int, int]] = []
    if rows:
        member, part, one, codes = (list(c) for c in zip(*rows, strict=True))
        arrays = [np.frombuffer(c, np.uint64) for c in codes]
        size = np.array([len(c) for c in arrays])
        begin = np.append(0, np.cumsum(size)[:-1])
        distinct, column = np.unique(np.concatenate(arrays), return_inverse=True)
        label = np.unique(np.array(part), return_inverse=True)[1]
        side = np.array(one)
        apart = not side.all()  # two chunks: only pairs across
        largest = np.bincount(label).argmax()
        inside = np.zeros(len(distinct), bool)
        for x in range(len(rows)):
            # a pair in which both belong to what was the largest component needs no look
            if (label == label[x]).all() or label[x] == largest:
                continue
            inside[column[begin[x]:begin[x] + size[x]]] = True
            overlap = np.add.reduceat(inside[column].astype(np.int32), begin)
            inside[column[begin[x]:begin[x] + size[x]]] = False
            near = enough(overlap, size[x], size) & (label != label[x])
            if apart:
                near &= side != side[x]
            for y in np.flatnonzero(near):
                if label[y] != label[x]:
                    found.append((min(member[x], member[y]), max(member[x], member[y]), int(overlap[y])))
                    old, new = (label[x], label[y]) if label[y] == largest else (label[y], label[x])
                    label[label == old] = new
    columns = list(zip(*found, strict=True)) or [()] * 3
    return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("a", "b", "overlap"), columns, strict=True)})


def heavy_links(heavy: DataFrame, packed: DataFrame, store: Store) -> DataFrame:
    """Links between components in columns of many entries, cell by cell."""
    chunks = store.write(heavy.groupBy("shingle").agg(F.ceil(F.sum("n") / CELL).cast("int").alias("chunks")))
    placed = heavy.join(chunks, "shingle").withColumn("mine", F.pmod(F.xxhash64("member"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    cells = store.write(placed.withColumn("other", other).select(
        "shingle", "member", "part", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        (F.col("mine") <= F.col("other")).alias("one")))
    filled = with_package(cells.join(packed, "member"))
    return filled.groupBy("shingle", "i", "j").applyInArrow(cell_links, _LINK)


def links(docs: DataFrame, rows: DataFrame, counts: np.ndarray, store: Store) -> DataFrame:
    """Verified links (a, b, overlap) between the smallest ids of distinct sets, which connect every component;
    ``rows`` and ``counts`` are those of ``counted_rows``."""
    block = matrix_rows(docs, counts)
    entries = store.write(shared_entries(block.select(F.explode("prefix").alias("shingle"), "member", "n")))
    entries = full_rows(entries, store)
    members = store.write(entries.select("member").distinct())
    bitmap = id_bitmap(members, members.count())
    packed = packed_sets(docs.filter("doc_id IS NOT NULL"), bitmap)
    if len(bitmap) << 5 == FILTER_BITS:
        packed = packed.join(members, "member", "left_semi")     # a full bitmap lets too many pass
    if not rows.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").isEmpty():
        packed = packed.dropDuplicates(["member", "codes"])
    packed = dealt_sets(packed, store)

    found = store.write(verified(store.write(centre_pairs(entries)), packed))
    joined = components(found, store)
    parted = store.write(entries.join(joined, F.col("member") == F.col("id"), "left").select(
        "shingle", "member", "n", F.coalesce("label", "member").alias("part")))
    open_columns = parted.groupBy("shingle").agg(
        F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("m")).filter("low < high")
    rest = store.write(parted.join(store.write(open_columns.select("shingle", "m")), "shingle"))
    heavy = store.write(rest.filter(F.col("m") > LIGHT))
    more = store.write(light_pairs(rest.filter(F.col("m") <= LIGHT), heavy))
    return store.write(found.unionByName(verified(more, packed)).unionByName(heavy_links(heavy, packed, store)))


def jaccard_components(docs: DataFrame, store: Store) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document row."""
    read = with_package(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows, counts = counted_rows(read, store)
    found = links(read, rows, counts, store)

    sets_of = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("member"), F.count(F.lit(1)).alias("copies"))
    same = store.write(sets_of.filter("copies > 1").select("digest", "member"))
    placed = store.write(rows.join(same, "digest", "left").select(
        "doc_id", F.col("n").cast("long").alias("n"), F.when(F.col("doc_id").isNotNull(), F.coalesce("member", "doc_id")).alias("member")))
    # an id with several sets links them
    several = placed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("member").alias("a"), F.max("member").alias("high"))
    several = several.filter("a < high").select("doc_id", "a")
    chained = placed.join(store.write(several), "doc_id").filter("a < member").select("a", F.col("member").alias("b"))
    joined = components(found.select("a", "b").unionByName(chained).distinct(), store)
    return placed.join(joined, F.col("member") == F.col("id"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "member").alias("component_id"))
