"""Toxicity: logistic regression on hashed word n-grams, trained by FTRL-proximal.

A text's features are the distinct buckets of its words, pairs of neighbours and skip-grams
(pairs with one word between), lower-cased and without punctuation. Each coordinate has a
learning rate of its own, from the squared gradients it has seen, and an L1 term
that keeps weights at exactly 0 until evidence exceeds it, so that the model is a
short list of (bucket, weight), at most ``BUCKETS`` of them.

It learns from at most ``TRAIN_ROWS`` labelled rows, lowest hash of the id first, as far as their features fit in
``TRAIN_FEATURES`` (a row that doesn't fit any more is left out), and only from
rows whose crc32 of the id modulo 3 isn't 1; these bounds make training one task
of known size. Every text is scored, whole.

Defined cases: a null or empty text has the score of the bias alone; without
labelled rows every score is 0.5; rows with null ids are scored and never learnt from;
of several labels of one id the largest counts; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readalike.llm import text_arrays as ta
from readalike.llm.decontaminate import _APART
from readalike.llm.shipping import with_package
from readalike.sources.store import Store

BUCKETS = 1 << 20
BIAS = BUCKETS
TRAIN_ROWS = 20_000
TRAIN_FEATURES = 80_000_000   # four bytes each
EPOCHS = 8
ALPHA, BETA, L1, L2 = 3.0, 1.0, 8.0, 0.0
TOXIC_WEIGHT = 3.0     # of a toxic row, as there are fewer of them
THRESHOLD = 0.7

SCORES = "doc_id long, score double"


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice: its first text, number of texts, and distinct (text, bucket) in order."""
    for part in ta.slices(pc.utf8_lower(texts.cast(pa.large_string()))):
        found = ta.words(part, _APART)
        h, text = found.hash, found.text
        owners, codes = [text], [h]
        with np.errstate(over="ignore"):
            for gap, mark in ((1, np.uint64(0xA24BAED4963EE407)), (2, np.uint64(0x9FB21C651E98DF25))):
                pair = np.flatnonzero(text[:-gap] == text[gap:]) if len(h) > gap else np.zeros(0, np.int64)
                owners.append(text[pair])
                codes.append(ta.mixed(h[pair] * mark + h[pair + gap]) if len(pair) else np.zeros(0, np.uint64))
        key = np.concatenate(owners).astype(np.int64) * BUCKETS + (
            np.concatenate(codes) >> np.uint64(44)).astype(np.int64)
        key = np.sort(pd.unique(key))
        yield part.first, part.n, key // BUCKETS, key % BUCKETS


class Ftrl:
    """State of the learner: sums z and n of each coordinate, the bias last."""

    def __init__(self) -> None:
        self.z = np.zeros(BUCKETS + 1)
        self.n = np.zeros(BUCKETS + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, buckets: np.ndarray, label: float) -> None:
        """One row; all its features have the value 1."""
        at = np.append(buckets, BIAS)
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0))) - label
        g *= TOXIC_WEIGHT if label else 1.0
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(labels: DataFrame, rows: int = TRAIN_ROWS) -> pd.Series:
    """Label by id of the rows to learn from, in the order of learning."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = (usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)).toPandas()
    return pd.Series(chosen["toxic"].to_numpy(np.float64), chosen["doc_id"].to_numpy(np.int64))


def fitting(sizes: dict[int, int], order: list[int], limit: int) -> list[int]:
    """Ids in order as far as their sizes fit in ``limit``."""
    kept, used = [], 0
    for i in order:
        if i in sizes and used + sizes[i] <= limit:
            kept.append(i)
            used += sizes[i]
    return kept


def trained(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, limit: int = TRAIN_FEATURES,
            store: Store | None = None) -> np.ndarray:
    """Weights of all buckets and the bias."""
    wanted = training_rows(labels, rows)
    if wanted.empty:
        return np.zeros(BUCKETS + 1)
    ids = np.sort(wanted.index.to_numpy())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.filter(pa.array(np.isin(batch.column("doc_id").to_numpy(), ids)))
            if mine.num_rows:
                have = mine.column("doc_id").to_numpy()
                for first, n, owner, bucket in features(mine.column("text")):
                    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": have[first:first + n],
                        "buckets": pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket.astype(np.int32)))})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for batch in batches:
            for i, buckets in zip(batch.column("doc_id").to_pylist(), batch.column("buckets"), strict=True):
                known[i] = buckets.values.to_numpy()
        model = Ftrl()
        for _ in range(EPOCHS):
            for i, label in wanted.items():
                if i in known:
                    model.learn(known[i], label)
        w = model.weights(slice(None))
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"bucket": used.astype(np.int32), "weight": w[used]})

    read = with_package(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows_read = read.filter("doc_id IS NOT NULL").mapInArrow(extract, "doc_id long, buckets array<int>")
    # Rows that share an id have to be learnt in one order: the smallest feature list is taken.
    store = store or Store(docs.sparkSession)
    single = store.write(rows_read.groupBy("doc_id").agg(F.min("buckets").alias("buckets")))
    sizes = {r.doc_id: r.size for r in single.select("doc_id", F.size("buckets").alias("size")).collect()}   # at most ``rows``
    kept = fitting(sizes, wanted.index.tolist(), limit)
    if len(kept) < len(sizes):
        wanted = wanted[kept]
        single = single.filter(F.col("doc_id").isin(kept))
    found = single.coalesce(1).mapInArrow(learn, "bucket int, weight double").toPandas()
    weights = np.zeros(BUCKETS + 1)
    weights[found["bucket"]] = found["weight"]
    return weights


def scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every document row."""
    used = np.flatnonzero(weights[:BUCKETS])
    value, bias = weights[used], float(weights[BIAS])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS)
        table[used] = value
        for batch in batches:
            if batch.num_rows:
                out = []
                for _, n, owner, bucket in features(batch.column("text")):
                    out.append(bias + np.bincount(owner, table[bucket], minlength=n))
                logit = np.clip(np.concatenate(out), -700.0, 700.0)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"), "score": 1.0 / (1.0 + np.exp(-logit))})

    narrow = with_package(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(score, SCORES)
