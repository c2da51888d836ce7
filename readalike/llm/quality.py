"""Quality rules: plain rules on words and lines, then a log-likelihood ratio.

The ratio compares two multinomials over hashed four-byte grams: one counted
over the whole raw corpus, one over trusted texts (labelled ``quality = 1``). A
text's ratio is summed, divided by its number of grams plus a constant, and
compared with a fixed threshold, so each text is judged by itself and alike in
every run.

Trusted texts are a bounded sample of the labelled rows, lowest hash of the id
first; everything else covers all rows. What is broadcast is a table of
``BUCKETS`` ratios and at most ``TRUSTED_ROWS`` ids, whatever the size of the data.

Defined cases: a null text is an empty one and fails the rules; without any
trusted row all ratios are 0; rows with a null id are judged like others;
repeated rows are judged each; labels may repeat an id or be null. Columns of
the input other than ``doc_id`` and ``text`` are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readalike.llm import text_arrays as ta
from readalike.llm.shipping import with_package

GRAM = 4
BUCKETS = 1 << 16
TRUSTED_ROWS = 50_000
PRIOR_COUNT = 50       # grams added to each bucket at the corpus-wide rate, on both sides
PRIOR_GRAMS = 100      # added to a text's grams before the division
THRESHOLD = -0.2       # mean ratio below which a text is rejected
MIN_WORDS = 20
MAX_REPEATED = 30      # percent of words in repeated windows
WINDOW = 8

VERDICT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
           "n_repeat_words long, base_failed boolean, ratio double, kept boolean")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.arange(256) == 10


def hashed_grams(part: ta.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every four-byte gram, and the text that it belongs to."""
    have = len(part.data) - GRAM + 1
    if have <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = part.data.astype(np.uint64)
    code = np.zeros(have, np.uint64)
    for k in range(GRAM):
        code = (code << np.uint64(8)) | wide[k:k + have]
    owner = np.repeat(np.arange(part.n), part.ends - part.begins)
    whole = owner[:have] == owner[GRAM - 1:]
    bucket = (ta.mixed(code) >> np.uint64(48)).astype(np.int64)
    return bucket[whole], owner[:have][whole]


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> np.ndarray:
    """Ids of at most ``rows`` trusted documents, lowest hash first."""
    chosen = (labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return np.sort(chosen.toPandas()["doc_id"].to_numpy(np.int64))


def gram_counts(docs: DataFrame, trusted: np.ndarray) -> DataFrame:
    """Rows (bucket, raw, trusted): grams in all texts and in the trusted ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            known = np.isin(ids, trusted) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for part in ta.slices(batch.column("text")):
                bucket, owner = hashed_grams(part)
                raw += np.bincount(bucket, minlength=BUCKETS)
                mine = known[part.first:part.first + part.n]
                good += np.bincount(bucket[mine[owner]], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict(
            {"bucket": used.astype(np.int32), "raw": raw[used], "trusted": good[used]})

    counted = with_package(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        count, "bucket int, raw long, trusted long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def gram_ratios(docs: DataFrame, labels: DataFrame, rows: int = TRUSTED_ROWS) -> np.ndarray:
    """Log of trusted over raw probability per bucket.

    Both multinomials have the same prior, so a bucket that is too rare to tell has a
    ratio near 0 however few the trusted texts are.
    """
    counts = gram_counts(docs, trusted_ids(labels, rows)).toPandas()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]] = counts["raw"]
    good[counts["bucket"]] = counts["trusted"]
    if not good.sum():
        return np.zeros(BUCKETS)
    return np.log(good / good.sum() * raw.sum() + PRIOR_COUNT) - np.log(raw + PRIOR_COUNT)


def repeated_words(found: ta.Words) -> np.ndarray:
    """Per text, the words that lie in a window which the text holds twice or more."""
    code, at = ta.grams(found, WINDOW)
    with np.errstate(over="ignore"):
        keyed = ta.mixed(code + found.text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    again = at[pd.Series(keyed).duplicated(keep=False).to_numpy()]
    edge = np.zeros(len(found.hash) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return np.bincount(found.text[covered], minlength=len(found.per_text))


def repeated_lines(part: ta.Slice, found: ta.Words) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line."""
    starts, stops = ta.spans(part, _NEWLINE)
    if not len(starts):
        return np.zeros(part.n, np.int64)
    upto = np.searchsorted(found.starts, np.stack([starts, stops]))
    spoken = upto[1] > upto[0]
    starts, stops = starts[spoken], stops[spoken]
    text = np.searchsorted(part.ends, starts, "right")
    lines = pd.DataFrame({"text": text, "hash": ta.span_hashes(part.data, starts, stops)})
    return np.bincount(text[lines.duplicated().to_numpy()], minlength=part.n)


def judge(texts: pa.Array, ratios: np.ndarray) -> dict[str, np.ndarray]:
    """All columns of the verdict but the id."""
    out: dict[str, list[np.ndarray]] = {}
    for part in ta.slices(texts):
        found = ta.words(part)
        data = part.data
        begins_char = ((data & 0xC0) != 0x80) & ~ta.WHITE[data]
        bucket, owner = hashed_grams(part)
        grams = np.bincount(owner, minlength=part.n)
        row = {
            "n_words": found.per_text,
            "word_chars": part.sums(begins_char),
            "n_symbols": part.sums(_SYMBOL[data]),
            "n_dup_lines": repeated_lines(part, found),
            "n_repeat_words": repeated_words(found),
            "ratio": np.bincount(owner, ratios[bucket], minlength=part.n) / (grams + PRIOR_GRAMS),
        }
        row["base_failed"] = ((row["n_words"] < MIN_WORDS)
                              | (100 * row["n_repeat_words"] > MAX_REPEATED * row["n_words"]))
        row["kept"] = ~row["base_failed"] & (row["ratio"] >= THRESHOLD)
        for name, values in row.items():
            out.setdefault(name, []).append(values)
    return {name: np.concatenate(values) for name, values in out.items()}


def quality_verdicts(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """One verdict per document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = judge(batch.column("text"), ratios)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {
                    name: pa.array(values) for name, values in rows.items()}).select(names)

    names = [field.split()[0] for field in VERDICT.split(", ")]
    narrow = with_package(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, VERDICT)


def keep_quality(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """The documents that pass, all columns as they are."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(judge(batch.column(place), ratios)["kept"]))

    return with_package(docs).mapInArrow(run, docs.schema)
