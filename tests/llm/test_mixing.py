import re

import pytest
from pyspark.sql import functions as F

from readalike.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Share, cut what is too much, share that again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= cap * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_plan_equals_brute_force(docs, store):
    rows = {r["doc_id"]: (r["source"], len(WORD.findall(r["text"]))) for r in docs.collect()}
    sizes = {}
    for source, n in rows.values():
        sizes[source] = sizes.get(source, 0) + n
    target = brute_targets(sizes)
    plan = {r["doc_id"]: r for r in mixing.mixing_plan(docs, store).collect()}
    assert plan.keys() == rows.keys()
    for i, (source, n) in rows.items():
        assert (plan[i]["size"], plan[i]["source_size"]) == (n, sizes[source])
        assert plan[i]["target"] == pytest.approx(target[source])
        assert abs(plan[i]["n_copies"] - target[source] / sizes[source]) < 1 and plan[i]["n_copies"] <= 2
    again = {r["doc_id"]: r["n_copies"] for r in mixing.mixing_plan(docs.repartition(7), store).collect()}
    assert again == {i: r["n_copies"] for i, r in plan.items()}


def test_mix_repeats_rows_as_planned(docs, store):
    plan = {r["doc_id"]: r["n_copies"] for r in mixing.mixing_plan(docs, store).collect()}
    mixed = mixing.mix(docs, store)
    assert mixed.schema == docs.schema
    taken = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert taken == {i: n for i, n in plan.items() if n}


@pytest.mark.parametrize("names", [("__copy", "__mix"), ("copy", "Rate"), ("rate", "copy_"), ("a.b", "source_size")])
def test_columns_of_any_name_come_through(docs, store, names):
    named = docs.withColumns({n: F.lit(k) for k, n in enumerate(names)})
    mixed = mixing.mix(named, store)
    assert mixed.columns == named.columns
    assert mixed.count() == mixing.mix(docs, store).count()
    assert {tuple(r[-2:]) for r in mixed.collect()} == {(0, 1)}


def test_large_sources_come_near_their_targets(spark, store):
    rows = spark.range(60_000).selectExpr(
        "id AS doc_id", "repeat('w ', int(1 + id % 50)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source")
    plan = mixing.mixing_plan(rows, store).selectExpr("source_size", "target", "size * n_copies AS taken")
    for r in plan.groupBy("source_size", "target").sum("taken").collect():
        assert r["sum(taken)"] == pytest.approx(r["target"], rel=0.05)


def test_odd_rows(odd_docs, no_docs, store):
    plan = mixing.mixing_plan(odd_docs, store).collect()
    assert len(plan) == odd_docs.count()
    assert {r["size"] for r in plan if r["doc_id"] in (1, 2, 6)} == {0}
    mixed = mixing.mix(odd_docs, store)
    assert mixed.columns == odd_docs.columns
    assert mixing.mixing_plan(no_docs, store).count() == 0 and mixing.mix(no_docs, store).count() == 0
