import re
from collections import Counter

import numpy as np
import pytest

from readalike.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for k, w in enumerate(windows) if often[w] > 1 for j in range(k, k + 8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def facts(df):
    return [tuple(r) for r in df.select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]


@pytest.fixture(scope="module")
def ratios(docs, labels):
    return quality.gram_ratios(docs, labels)


def test_rules_equal_brute_force(docs, texts, ratios):
    found = quality.quality_verdicts(docs, ratios)
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert by_id.keys() == texts.keys()
    for i, text in texts.items():
        assert tuple(by_id[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute(text)
        assert by_id[i]["kept"] == (not by_id[i]["base_failed"] and by_id[i]["ratio"] >= quality.THRESHOLD)


def test_ratio_equals_brute_force(docs, labels, texts, ratios):
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    raw, trusted = Counter(), Counter()

    def grams(text):
        data = text.encode()
        return [data[k:k + 4] for k in range(len(data) - 3)]

    bucket = {}

    def bucket_of(gram):
        if gram not in bucket:
            part = quality.ta.Slice(0, np.frombuffer(gram, np.uint8), np.array([0]), np.array([4]))
            bucket[gram] = int(quality.hashed_grams(part)[0][0])
        return bucket[gram]

    for i, text in texts.items():
        mine = Counter(map(bucket_of, grams(text)))
        raw += mine
        if i in good:
            trusted += mine
    scale = sum(raw.values()) / sum(trusted.values())
    by_id = {r["doc_id"]: r["ratio"] for r in quality.quality_verdicts(docs, ratios).collect()}
    for i in list(texts)[:25]:
        mine = [bucket_of(g) for g in grams(texts[i])]
        total = sum(np.log(trusted[b] * scale + quality.PRIOR_COUNT) - np.log(raw[b] + quality.PRIOR_COUNT) for b in mine)
        assert by_id[i] == pytest.approx(total / (len(mine) + quality.PRIOR_GRAMS), abs=1e-9)


def test_filter_keeps_rows_as_they_are(docs, ratios):
    kept = quality.keep_quality(docs, ratios)
    assert kept.schema == docs.schema
    wanted = {r["doc_id"] for r in quality.quality_verdicts(docs, ratios).filter("kept").collect()}
    rows = {tuple(r) for r in docs.collect() if r["doc_id"] in wanted}
    assert {tuple(r) for r in kept.collect()} == rows


def test_odd_rows(odd_docs, labels, ratios):
    assert sorted(facts(quality.quality_verdicts(odd_docs, ratios))) == sorted(brute(r["text"]) for r in odd_docs.collect())
    assert quality.keep_quality(odd_docs, ratios).columns == odd_docs.columns


def test_empty_tables(no_docs, docs, labels):
    assert not quality.gram_ratios(no_docs, labels).any()
    assert not quality.gram_ratios(docs, labels.limit(0)).any()
    assert quality.quality_verdicts(no_docs, np.zeros(quality.BUCKETS)).count() == 0


def test_junk_goes_and_clean_text_stays(spark, docs, labels):
    import os
    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        pytest.skip("larger tables are absent")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality_verdicts(docs, quality.gram_ratios(docs, labels)).join(labels, "doc_id")
    clean = found.filter("quality = 1 AND NOT base_failed").selectExpr("avg(int(kept))").first()[0]
    junk = found.filter("quality = 0").selectExpr("avg(int(kept))").first()[0]
    assert clean > 0.99 and junk < 0.1
