from collections import Counter

import pytest

import corpus_pipeline
from readalike.llm import decontaminate, mixing, near_dedup, quality, training_order
from readalike.llm.queries import table, tokenizer_file
from test_near_dedup import brute_classes
from test_training_order import expected

SF = "/root/testdata/sf0.001"


def test_run_equals_its_parts_by_brute_force(spark, store):
    docs, labels, benchmark = (table(spark, SF, t) for t in ("documents", "labels", "benchmark"))
    good = {r["doc_id"] for r in quality.quality_verdicts(docs, quality.gram_ratios(docs, labels)).filter("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in good}
    classes = brute_classes(texts)
    texts = {i: t for i, t in texts.items() if classes[i] == i}
    rest = docs.filter(docs["doc_id"].isin(list(texts)))
    bad = {r["doc_id"] for r in decontaminate.contamination(rest, benchmark).filter("contaminated").collect()}
    assert bad
    rest = store.write(rest.filter(~docs["doc_id"].isin(list(bad))))
    copies = {r["doc_id"]: r["n_copies"] for r in mixing.mixing_plan(rest, store).collect()}
    wanted = expected([(i, texts[i]) for i, n in copies.items() for _ in range(n)])
    found = Counter((r["doc_id"], r["seq"], r["n_tokens"], r["crc"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert found == wanted


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd_docs, SF)
    assert name == "training_shards" or out.columns == odd_docs.columns
    out.collect()
    assert stage(spark, no_docs, SF).count() == 0


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "decontamination", "source_mixing", "training_shards"]
    assert training_order.STRIDE == 16 + 2 * training_order.LENGTH and tokenizer_file() and near_dedup.SHINGLE == 5
