"""Near duplicates by consistent weighted sampling.

A text's features are its shingles of five lower-cased words, weighted by TF-IDF; a text
of fewer words has the one shingle of all its words. The inverse frequency lies between 1 and 2:
without that bound the shingles that a large group of near copies shares would count for little
against the few in which its members differ, and the group would fall apart. The steps:

1. Document frequencies over all documents, in ``DF_BUCKETS`` hash buckets: a
   table of fixed size, which is what a task needs to weigh a text.
2. Improved consistent weighted sampling: ``BANDS * ROWS`` samples per text, whose
   chance to agree is the weighted Jaccard similarity. ``ROWS`` samples make a band key.
3. Equal texts become one class before anything is joined. Classes that share a
   band key form a bucket; in a bucket each class meets two centres, the class that shares
   most buckets with others and one by hash, so a bucket of n classes has at most 2n candidates.
4. A candidate is a link if the exact weighted Jaccard similarity of the two texts
   is ``SIMILARITY`` or more. Linked classes are joined to components. Buckets that
   hold several components are searched again, component against component with
   other centres, until a round finds no link.
5. What buckets then still hold several components is finished exactly: shingles have one order,
   rarest first, and of each member only those count behind which enough weight is left for
   ``SIMILARITY``. Two texts as similar as that share one of these, and the weights left on both
   sides there bound what they share; all pairs of different components within that bound are
   verified. So every pair that shares a band key is linked or in one component or known to be less similar.

Aggregates combine before their shuffle; joins with texts read stored tables on both sides,
which adaptive execution splits where a key is hot. Centres and sizes of a bucket come from windows over its
rows, a few numbers each, which a task sorts and spills. What goes through the driver has a
fixed size: the frequency table and a bitmap of the ids whose texts are compared, so that
these texts are found again without shuffling all texts.

Defined cases: null or wordless texts are never duplicates; a null id is left
out of the result and kept by ``drop_near_duplicates``; rows that share an id are one document in
``near_duplicates``, but ``drop_near_duplicates`` judges each by its own text, and of rows with the same
id and text one stays; the smallest id of a group stands for it. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readalike.llm import text_arrays as ta
from readalike.llm.mixing import free_names, quoted
from readalike.llm.shipping import with_package
from readalike.sources.store import Store

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
DF_BUCKETS = 1 << 18
SLICE = 1 << 18
PIECE = 1024
LEVELS = 1 << 16
FILTER_BITS = 1 << 23

_COUNTED = "bucket int, df long"
_SIGNED = "doc_id long, digest binary, bands array<long>"
_VECTOR = "doc_id long, digest binary, shingles binary, weights binary"
_SCORED = "a long, b long, similarity double"
_PREFIX = "member long, shingle long, spare double, total double, light boolean"
# What two texts share is at least this part of the sum of their weights; a little less, for rounding.
SHARED = (SIMILARITY - 1e-5) / (1.0 + SIMILARITY)


def shingles(part: ta.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every text: text, hash, count; sorted by text and hash."""
    found = ta.words(part)
    code, at = ta.grams(found, SHINGLE)
    owner = found.text[at]
    short = np.flatnonzero((found.per_text > 0) & (found.per_text < SHINGLE))
    first = found.first
    for n in range(1, SHINGLE):
        mine = short[found.per_text[short] == n]
        if len(mine):
            whole, begin = ta.grams(found, n)
            owner = np.concatenate([owner, mine])
            code = np.concatenate([code, whole[np.searchsorted(begin, first[mine])]])
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    return owner[begin], code[begin], np.diff(np.append(begin, len(code)))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``PIECE`` rows, so that copies of their texts stay small."""
    for batch in batches:
        for k in range(0, batch.num_rows, PIECE):
            yield batch.slice(k, PIECE)
    pa.default_memory_pool().release_unused()


def lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()))


def bucket_of(code: np.ndarray) -> np.ndarray:
    return (code & np.uint64(DF_BUCKETS - 1)).astype(np.int64)


def idf_table(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each bucket over all documents: 1 for a shingle of every
    document, up to 2 for one that no other shares if it has its bucket to itself; in large tables
    rare shingles share buckets and weigh less."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DF_BUCKETS, np.int64)
        n = 0
        for batch in pieces(batches):
            n += batch.num_rows
            for part in ta.slices(lower(batch.column("text")), SLICE):
                df += np.bincount(bucket_of(shingles(part)[1]), minlength=DF_BUCKETS)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({
            "bucket": np.append(used, -1).astype(np.int32), "df": np.append(df[used], n)})

    counted = with_package(docs).select(F.col("text").cast("string")).mapInArrow(count, _COUNTED)
    rows = counted.groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    n = int(rows.loc[rows["bucket"] == -1, "df"].sum())
    rows = rows[rows["bucket"] >= 0]
    df = np.ones(DF_BUCKETS)
    df[rows["bucket"]] = rows["df"]
    return 1.0 + np.log(np.maximum(1.0, n / df)) / np.log(DF_BUCKETS)


@lru_cache
def gamma_levels() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middle of each level."""
    u = (np.arange(LEVELS) + 0.5) / LEVELS
    x = np.linspace(0.0, 40.0, 1 << 20)
    return np.interp(u, 1.0 - (1.0 + x) * np.exp(-x), x)


def samples(code: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Consistent weighted samples, one row per text that begins at ``first``.

    For sample k and shingle s, r and c are Gamma(2, 1) and beta is uniform, all taken from
    one hash of (k, s). With t = floor(ln w / r + beta) the shingle with the least
    ln c - r (t - beta) - r is the sample, together with its t.
    """
    size = np.diff(np.append(first, len(code)))
    gamma = gamma_levels()
    log_gamma = np.log(gamma)
    log_w = np.log(weight)
    out = np.empty((len(first), BANDS * ROWS), np.uint64)
    low = np.uint64(LEVELS - 1)
    with np.errstate(over="ignore"):
        for k in range(BANDS * ROWS):
            bits = ta.mixed(code + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15))
            r = gamma[(bits & low).astype(np.int64)]
            beta = (bits >> np.uint64(32)).astype(np.float64) * 2.0**-32
            t = np.floor(log_w / r + beta)
            value = log_gamma[((bits >> np.uint64(16)) & low).astype(np.int64)] - r * (t - beta + 1.0)
            least = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, first), size))
            at = least[np.searchsorted(least, first)]
            out[:, k] = ta.mixed(code[at] ^ (t[at].astype(np.int64).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
    return out


def band_keys(sampled: np.ndarray) -> np.ndarray:
    keys = np.empty((len(sampled), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(sampled), band + 1, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                key = ta.mixed(key * np.uint64(0xD6E8FEB86659FD93) + sampled[:, k])
            keys[:, band] = key
    return keys.view(np.int64)


def digests(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.md5(x.as_buffer(), usedforsecurity=False).digest() for x in texts.cast(pa.large_binary())],
                    pa.binary())


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """Per document with an id and a word: digest of the text and its band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids = batch.column("doc_id")
            plain = batch.column("text")
            for part in ta.slices(lower(plain), SLICE):
                owner, code, times = shingles(part)
                if not len(owner):
                    continue
                first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                keys = band_keys(samples(code, times * idf[bucket_of(code)], first))
                rows = pa.array(owner[first] + part.first)
                flat = pa.array(keys.ravel())
                offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids.take(rows), "digest": digests(plain.take(rows)),
                    "bands": pa.ListArray.from_arrays(offsets, flat)})

    narrow = with_package(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.filter("doc_id IS NOT NULL").mapInArrow(sign, _SIGNED)


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bitmap of fixed size with the hash of every id in ``doc_id`` set; other ids may be hit by
    chance, the more the more ids there are, which costs work and changes no result."""
    bit = F.pmod("doc_id", F.lit(FILTER_BITS))
    words = ids.groupBy(F.shiftright(bit, 5).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, int(pmod(doc_id, {FILTER_BITS}) & 31))")).alias("bits")).toPandas()
    bitmap = np.zeros(FILTER_BITS >> 5, np.uint32)
    bitmap[words["word"]] = words["bits"].astype(np.uint32)
    return bitmap


def vectors(docs: DataFrame, idf: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """Per document that the filter lets pass its shingles in order and their weights, as packed
    numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            bit = batch.column("doc_id").to_numpy() % FILTER_BITS
            batch = batch.filter(pa.array((wanted[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1))
            if not batch.num_rows:
                continue
            plain = batch.column("text")
            for part in ta.slices(lower(plain), SLICE):
                owner, code, times = shingles(part)
                if not len(owner):
                    continue
                weight = (times * idf[bucket_of(code)]).astype(np.float32)
                first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                last = np.append(first[1:], len(code))
                rows = pa.array(owner[first] + part.first)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").take(rows), "digest": digests(plain.take(rows)),
                    "shingles": pa.array([code[a:b].tobytes() for a, b in zip(first, last, strict=True)]),
                    "weights": pa.array([weight[a:b].tobytes() for a, b in zip(first, last, strict=True)])})

    return with_package(docs).mapInArrow(pack, _VECTOR)


def weighted_jaccard(code_a: np.ndarray, weight_a: np.ndarray,
                     code_b: np.ndarray, weight_b: np.ndarray) -> float:
    """Sum of smaller weights over sum of larger weights; both sides sorted by shingle."""
    place = np.minimum(np.searchsorted(code_b, code_a), len(code_b) - 1)
    both = code_b[place] == code_a
    shared = np.minimum(weight_a[both], weight_b[place[both]]).sum(dtype=np.float64)
    return float(shared / (weight_a.sum(dtype=np.float64) + weight_b.sum(dtype=np.float64) - shared))


def links(candidates: DataFrame, packed: DataFrame) -> DataFrame:
    """Candidates (a, b) whose texts are similar enough, with the similarity."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            columns = [batch.column(name) for name in ("sa", "wa", "sb", "wb")]
            value = np.array([weighted_jaccard(
                *(np.frombuffer(column[i].as_buffer(), kind) for column, kind in
                  zip(columns, (np.uint64, np.float32) * 2, strict=True))) for i in range(len(a))])
            near = value >= SIMILARITY - 1e-6
            yield pa.RecordBatch.from_pydict({"a": a[near], "b": b[near], "similarity": value[near]})

    left = packed.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"), F.col("weights").alias("wa"))
    right = packed.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"), F.col("weights").alias("wb"))
    return candidates.join(left, "a").join(right, "b").mapInArrow(score, _SCORED)


def candidates(members: DataFrame, store: Store, turn: int, compared: DataFrame | None) -> DataFrame:
    """Pairs (a, b), a < b, of bucket members (bucket, member, part, mates) with the two centres of
    the bucket: the member with most bucket mates, which an original has that its copies were made
    from, and one by hash. Members of the same part need no comparison, nor do pairs in ``compared``."""
    bucket = Window.partitionBy("bucket")
    placed = members.select(
        "member", "part", F.max(F.struct("mates", (-F.col("member")).alias("less"), "member", "part")).over(bucket).alias("x"),
        F.min(F.struct(F.xxhash64(F.lit(turn), "member").alias("h"), "member", "part")).over(bucket).alias("y"))
    met = placed.select("member", "part", F.explode(F.array(*(F.struct(f"{c}.member", f"{c}.part") for c in "xy"))).alias("c"))
    met = met.filter(F.col("part") != F.col("c.part"))
    pairs = met.select(F.least("member", "c.member").alias("a"), F.greatest("member", "c.member").alias("b")).distinct()
    return store.write(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"))


def prefixes(packed: DataFrame, idf: np.ndarray) -> DataFrame:
    """Per member the shingles that can be the first one shared with a text of ``SIMILARITY``, in an order that
    all texts have. ``spare`` is the weight from there on less this text's part of what both must share, so
    it must reach the other's part; ``light`` says whether the other may be as heavy as this one."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for member, shingle, weight in zip(*(batch.column(c) for c in ("doc_id", "shingles", "weights")), strict=True):
                code = np.frombuffer(shingle.as_buffer(), np.uint64)
                weight = np.frombuffer(weight.as_buffer(), np.float32).astype(np.float64)
                order = np.lexsort((code, -idf[bucket_of(code)]))
                left = np.cumsum(weight[order][::-1])[::-1]
                total = left[0]
                # The lightest text that is as similar weighs SIMILARITY of this one.
                n = int((left >= (SIMILARITY - 1e-5) * total).sum())
                spare = left[:n] - SHARED * total
                yield pa.RecordBatch.from_pydict({
                    "member": np.full(n, member.as_py()), "shingle": code[order[:n]].view(np.int64), "spare": spare,
                    "total": np.full(n, total), "light": pa.array(spare >= SHARED * total)})

    return packed.mapInArrow(first, _PREFIX)


def remaining_pairs(parted: DataFrame, packed: DataFrame, idf: np.ndarray, store: Store) -> DataFrame:
    """All pairs (a, b), a < b, of members (member, part) of different parts that can be as similar as
    ``SIMILARITY``. Parts meet first, so that a large one is not compared with itself."""
    members = store.write(parted.select("member", "part").distinct())
    chosen = store.write(packed.join(members.select(F.col("member").alias("doc_id")), "doc_id", "left_semi"))
    rows = store.write(prefixes(chosen, idf))
    rows = store.write(rows.join(members, "member"))
    several = rows.groupBy("shingle").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.max("light").alias("any"))
    several = store.write(several.filter("low < high AND any").select("shingle"))
    rows = store.write(rows.join(several, "shingle", "left_semi"))

    def side(table: DataFrame, name: str) -> DataFrame:
        return table.select("shingle", *(F.col(c).alias(f"{name}_{c}") for c in table.columns if c != "shingle"))

    def meet(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
        return x.join(y, on).filter(
            (F.col("x_part") != F.col("y_part")) & (F.col("x_total") <= F.col("y_most"))
            & (F.col("x_spare") >= SHARED * F.col("y_total")) & (F.col("y_spare") >= SHARED * F.col("x_total")))

    # Of each part at a shingle the most that a member may spare, the least and the largest weight.
    def outline(table: DataFrame) -> DataFrame:
        return store.write(table.groupBy("shingle", "part").agg(
            F.max("spare").alias("spare"), F.min("total").alias("total"), F.max("total").alias("most")))

    met = meet(side(outline(rows.filter("light")), "x"), side(outline(rows), "y"), ["shingle"])
    met = store.write(met.select("shingle", "x_part", "y_part"))
    lights = store.write(met.join(side(rows.filter("light"), "x"), ["shingle", "x_part"]))
    pairs = meet(lights, side(rows.withColumn("most", F.col("total")), "y"), ["shingle", "y_part"])
    return store.write(pairs.select(F.least("x_member", "y_member").alias("a"),
                                    F.greatest("x_member", "y_member").alias("b")).distinct())


def components(edges: DataFrame, store: Store) -> DataFrame:
    """Smallest reachable id of every id in (a, b): neighbours' minimum, then the label's own
    label, until nothing changes."""
    both = store.write(edges.select("a", "b").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = store.write(both.groupBy(F.col("a").alias("id")).agg(
        F.min(F.least("a", "b")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        lowered = store.write(labels.join(near, F.col("id") == F.col("a")).select(
            "id", F.least("label", "near").alias("label"), F.col("label").alias("before")))
        roots = lowered.select(F.col("id").alias("root"), F.col("label").alias("next"))
        jumped = store.write(lowered.join(roots, F.col("label") == F.col("root")).select(
            "id", F.least("label", "next").alias("label"), "before"))
        labels = jumped.select("id", "label")
        if jumped.filter("label <> before").isEmpty():
            return labels


def distinct_texts(signed: DataFrame, store: Store) -> tuple[DataFrame, bool]:
    """(digest, doc_id, member, bands, n) of each text: its smallest id, the number that stands for it, and how many rows
    have it. That number is the id, unless the id is the smallest of several texts: all but one of these get a hash of id
    and text. Says whether there are such ids."""
    texts = signed.groupBy("digest").agg(
        F.min(F.struct("doc_id", "bands")).alias("first"), F.count(F.lit(1)).alias("n"))
    texts = store.write(texts.select("digest", F.col("first.doc_id").alias("doc_id"),
                                     F.col("first.bands").alias("bands"), "n"))
    several = texts.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    several = store.write(several.filter("low < high").select("doc_id", "low"))
    if several.isEmpty():
        return texts.withColumn("member", F.col("doc_id")), False
    own = F.col("low").isNull() | (F.col("low") == F.col("digest"))
    return store.write(texts.join(several, "doc_id", "left").withColumn(
        "member", F.when(own, F.col("doc_id")).otherwise(F.xxhash64("doc_id", "digest"))).drop("low")), True


def text_classes(docs: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest) that have an id and a word; and of each distinct text (digest) with several rows, or that is not the
    first text of its group (smallest id, then digest), the id of that first text, ``class_id``, and whether it is that text,
    ``stands``."""
    idf = idf_table(docs)
    signed = store.write(signatures(docs, idf))
    texts, several = distinct_texts(signed, store)
    banded = texts.select("member", F.explode("bands").alias("bucket"))
    of_bucket, of_member = Window.partitionBy("bucket"), Window.partitionBy("member")
    crowd = banded.withColumn("others", F.count(F.lit(1)).over(of_bucket) - 1).filter("others > 0")
    buckets = store.write(crowd.select("bucket", "member", F.sum("others").over(of_member).alias("mates")))
    wanted = store.write(buckets.select("member").distinct().join(texts, "member").select("member", "doc_id", "digest")
                         if several else buckets.select("member", F.col("member").alias("doc_id")).distinct())
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    packed = vectors(read.filter("doc_id IS NOT NULL"), idf, id_filter(wanted))
    if several:
        packed = packed.join(wanted, ["doc_id", "digest"]).drop("doc_id").withColumnRenamed("member", "doc_id")
    packed = store.write(packed.select("doc_id", "shingles", "weights"))

    members = buckets.withColumn("part", F.col("member"))
    compared = candidates(members, store, 0, None)
    edges = store.write(links(compared, packed))
    joined = components(edges, store)
    turn = 0
    while True:
        turn += 1
        parted = buckets.join(joined, F.col("member") == F.col("id"), "left").select(
            "bucket", "member", F.coalesce("label", "member").alias("part"), "mates")
        # A bucket of one component stays one, so only the others are looked at from now on.
        parted = parted.withColumn("several", F.min("part").over(of_bucket) < F.max("part").over(of_bucket))
        parted = store.write(parted.filter("several").drop("several"))
        buckets = parted.drop("part")
        rest = parted.groupBy("bucket", "part").agg(
            F.max(F.struct("mates", F.xxhash64(F.lit(turn), "member").alias("h"), "member")).alias("m")).select(
            "bucket", F.col("m.member").alias("member"), "part", F.col("m.mates").alias("mates"))
        pairs = candidates(rest, store, turn, compared)
        ids = store.write(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        found = store.write(links(pairs, packed.join(ids, "doc_id", "left_semi")))
        compared = compared.unionByName(pairs)
        if found.isEmpty():
            break
        edges = edges.unionByName(found)
        joined = components(edges, store)
    pairs = store.write(remaining_pairs(parted, packed, idf, store).join(compared, ["a", "b"], "left_anti"))
    ids = store.write(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    found = store.write(links(pairs, packed.join(ids, "doc_id", "left_semi")))
    if not found.isEmpty():
        joined = components(edges.unionByName(found), store)

    classes = texts.join(joined, F.col("member") == F.col("id"), "left").select(
        "digest", "doc_id", "n", F.coalesce("label", "member").alias("label"))
    if several:
        classes = store.write(classes)
        firsts = classes.groupBy("label").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
        classes = classes.join(store.write(firsts), "label").select(
            "digest", "n", F.col("first.doc_id").alias("class_id"), (F.col("first.digest") == F.col("digest")).alias("stands"))
    else:
        classes = classes.select("digest", "n", F.col("label").alias("class_id"), (F.col("doc_id") == F.col("label")).alias("stands"))
    # The only row of a text that stands for its group is in the group of its id: nothing has to be said of it.
    return signed.select("doc_id", "digest"), store.write(classes.filter("n > 1 OR NOT stands").drop("n"))


def near_duplicates(docs: DataFrame, store: Store) -> DataFrame:
    """(doc_id, class_id) of every document with an id: class_id is the smallest id of its group."""
    rows, classes = text_classes(docs, store)
    # An id whose rows have different texts is one document here, in the smallest of their groups.
    placed = rows.join(classes, "digest").groupBy("doc_id").agg(F.min(F.least("class_id", "doc_id")).alias("class_id"))
    every = docs.select(F.col("doc_id").cast("long")).filter("doc_id IS NOT NULL").distinct()
    return every.join(placed, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, store: Store) -> DataFrame:
    """One row for each group of texts, its first, all columns as they are; rows without an id or a word stay.

    Rows are judged by their own text: one of a repeated id goes only if its text belongs to a group that
    another row stands for.
    """
    rows, classes = text_classes(docs, store)
    judged = rows.join(classes, "digest").groupBy("doc_id", "digest").agg(
        F.max(F.col("stands") & (F.col("doc_id") == F.col("class_id"))).alias("stays"), F.count(F.lit(1)).alias("n"))
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id")).filter("doc_id IS NOT NULL")
    repeated = store.write(ids.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    gone = store.write(judged.filter("NOT stays").select("doc_id").distinct())
    if repeated.isEmpty():
        return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
    # Only rows of ids that repeat are told apart by their texts.
    marked = store.write(judged.filter("NOT stays OR n > 1").join(repeated, "doc_id", "left_semi").select("doc_id", "digest", "stays"))
    decided = store.write(gone.unionByName(repeated).distinct())
    key, text, stays, digest = free_names(docs, "key", "text_digest", "stays", "digest")
    back = [quoted(c) for c in docs.columns]
    single = docs.join(decided, docs["doc_id"].cast("long") == decided["doc_id"], "left_anti")
    several = docs.join(repeated, docs["doc_id"].cast("long") == repeated["doc_id"], "left_semi")
    named = several.withColumn(text, F.upper(F.md5(several["text"].cast("string"))))
    marks = marked.select(F.col("doc_id").alias(key), F.hex("digest").alias(digest), F.col("stays").alias(stays))
    same = (named["doc_id"].cast("long") == F.col(key)) & (F.col(text) == F.col(digest))
    stay = named.join(marks, same, "left_anti").select(*back)
    # Repeated rows of a text that stays: any one of them.
    once = named.join(marks.filter(F.col(stays)), same).dropDuplicates([key, text]).select(*back)
    return single.unionByName(stay).unionByName(once)
