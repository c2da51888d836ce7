import random
import re

import numpy as np
import pytest

from readalike.llm import ngram_join as j

DOCS = "doc_id long, text string, n long, member string, codes string"
ASCII = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)}


def brute(rows):
    """(doc_id, n, component) of every row by comparing all sets."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    label = {i: i for i, _ in rows if i is not None}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def found(spark, rows, store):
    df = spark.createDataFrame([(i, t, 1, "m", "c") for i, t in rows], DOCS)
    out = j.jaccard_components(df, store)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, out.collect()), key=str)


def variants(seed, n, words, changes, pool=4000):
    """Texts made from one by replacing words, so that some pairs lie on either side of the bound."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(pool)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(changes + 1)):
            text[rng.randrange(words)] = f"v{rng.randrange(pool)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("light,cell", [(64, 1 << 20), (1, 1 << 20), (2, 300), (1 << 30, 1)])
def test_equals_brute_force_whatever_way_columns_are_multiplied(spark, store, monkeypatch, light, cell):
    monkeypatch.setattr(j, "LIGHT", light)
    monkeypatch.setattr(j, "CELL", cell)
    texts = [t for seed in range(6) for t in variants(seed, 14, 30 + 17 * seed, 2 + seed)]
    texts += variants(9, 30, 60, 9) + [f"{t} {u}" for t in variants(10, 6, 40, 2) for u in ("", "one more tail")]
    rows = list(enumerate(texts, 5))
    random.Random(0).shuffle(rows)
    assert found(spark, rows, store) == brute(rows)


def test_bound_is_exact(spark, store):
    words = [f"w{k}" for k in range(49)]              # 45 shingles
    rows = [(1, " ".join(words)), (2, " ".join(words[:-9])),   # 36 of 45: linked
            (3, " ".join(words[1:-9])),                         # 35 of 45 with 1, 35 of 36 with 2: a chain
            (4, " ".join(f"x{k}" for k in range(49))), (5, " ".join(f"x{k}" for k in range(39)))]  # 35 of 45
    assert found(spark, rows, store) == brute(rows) == [(1, 45, 1), (2, 36, 1), (3, 35, 1), (4, 45, 4), (5, 35, 5)]


def test_odd_rows(spark, store, odd_docs, no_docs):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "One two"), (5, "one  TWO"), (6, "É two"), (7, "é two"), (8, "one two three four five"),
            (None, "one two"), (9, "a b c d e f g"), (9, "one two"), (10, "g f e d c b a"), (9, "g f e d c b a"),
            (11, "x y z x y z x y z x y z"), (12, "x y z x y z x y z"), (11, "x y z x y z x y z x y z"), (13, "A B C D E F G"), (None, None)]
    assert found(spark, rows, store) == brute(rows)
    assert found(spark, [], store) == []
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, j.jaccard_components(odd_docs, store).collect()), key=str) == brute(odd)
    assert j.jaccard_components(no_docs, store).count() == 0


def test_links_are_verified_and_connect(spark, store):
    texts = variants(3, 60, 80, 4)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows, counts = j.counted_rows(docs, store)
    sets = [shingle_set(t) for t in texts]
    for r in j.links(docs, rows, counts, store).collect():
        same = len(sets[r.a] & sets[r.b])
        assert r.a < r.b and r.overlap == same and 100 * same >= 80 * len(sets[r.a] | sets[r.b])


def test_single_entries_are_dropped_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(k, m, 1) for k in range(40) for m in range(1 + k % 4)]
        df = spark.createDataFrame(rows, "shingle long, member long, n int")
        assert sorted(map(tuple, j.shared_entries(df).collect())) == [r for r in rows if r[0] % 4]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_similar_but_unlinked_texts_give_no_rows_to_the_square(spark, store, monkeypatch):
    """300 texts that share three quarters pairwise: their columns are multiplied in cells."""
    base = " ".join(f"b{k}" for k in range(64))
    rows = [(k, f"{base} " + " ".join(f"u{k}_{m}" for m in range(20))) for k in range(300)]
    sizes = []
    write = store.write
    monkeypatch.setattr(store, "write", lambda df, name=None: sizes.append(write(df, name)) or sizes[-1])
    assert found(spark, rows, store) == sorted(((k, 80, k) for k in range(300)), key=str)
    assert max(t.count() for t in sizes) < 300 * 299 / 4


def test_pairs_that_meet_too_seldom_are_not_sent_and_rows_are_dealt_once(spark, store):
    # rows 1 and 2 meet in twelve columns, row 3 shares a single one with them; all have 100 n-grams
    cells = [(c, m, 100) for c in range(12) for m in (1, 2)] + [(0, 3, 100)] + [(c, 3, 100) for c in range(50, 60)]
    cells += [(c, 4, 100) for c in range(50, 60)] + [(99, 5, 100)]
    entries = j.full_rows(spark.createDataFrame(cells, j._ENTRY), store)
    assert sorted({r.member for r in entries.collect()}) == [1, 2, 3, 4]
    assert sorted(map(tuple, j.centre_pairs(entries).collect())) == [(1, 2), (3, 4)]
    labels = spark.createDataFrame([(1, 1)], "id long, label long").hint("merge")
    plan = entries.join(labels, entries.member == labels.id, "left")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_sets_are_dealt_once(spark, store):
    packed = j.dealt_sets(spark.createDataFrame([(k, bytes(np.arange(9 + k % 2, dtype=np.uint64))) for k in range(50)], j._SET), store)
    pairs = store.write(spark.createDataFrame([(k, k + 2) for k in range(40)], "a long, b long"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = j.verified(pairs, packed)
        assert sorted(tuple(r) for r in found.collect()) == [(k, k + 2, 9 + k % 2) for k in range(40)]
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Bucketed: true") == 2 and initial.count("Exchange hashpartitioning") == 2   # the pairs, once by either id
