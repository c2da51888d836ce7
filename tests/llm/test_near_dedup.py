import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from readalike.llm import near_dedup as nd


def classes(df, store):
    return {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(df, store).collect()}


def shingled(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return Counter(tuple(words[k:k + n]) for k in range(len(words) - n + 1)) if words else Counter()


def brute_classes(texts):
    """All pairs that share a shingle, by exact weighted Jaccard with exact frequencies."""
    bags = {i: shingled(t) for i, t in texts.items()}
    df = Counter(s for bag in bags.values() for s in bag)
    idf = {s: 1 + np.log(len(texts) / n) / np.log(nd.DF_BUCKETS) if n < len(texts) else 1.0 for s, n in df.items()}
    holders = defaultdict(list)
    for i, bag in bags.items():
        for s in bag:
            holders[s].append(i)
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        shared = sum(min(bags[a][s], bags[b][s]) * idf[s] for s in bags[a].keys() & bags[b].keys())
        total = sum(n * idf[s] for bag in (bags[a], bags[b]) for s, n in bag.items())
        if shared / (total - shared) >= 0.8:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in texts}


def test_classes_equal_brute_force(docs, texts, store):
    assert classes(docs, store) == brute_classes(texts)


def test_samples_agree_as_often_as_the_texts_are_similar():
    rng = np.random.default_rng(5)
    agree, similar = [], []
    for share in (0.5, 0.7, 0.9):
        for _ in range(12):
            code = rng.integers(0, 1 << 63, 400).astype(np.uint64)
            other = np.where(rng.random(400) < share, code, rng.integers(0, 1 << 63, 400).astype(np.uint64))
            weight = dict(zip(np.concatenate([code, other]).tolist(), rng.exponential(1, 800) + 0.1, strict=True))
            a, b = np.sort(code), np.sort(other)
            wa, wb = (np.array([weight[x] for x in side.tolist()]) for side in (a, b))
            one, two = nd.samples(a, wa, np.array([0])), nd.samples(b, wb, np.array([0]))
            agree.append((one == two).mean())
            similar.append(nd.weighted_jaccard(a, wa, b, wb))
    assert abs(np.mean(agree) - np.mean(similar)) < 0.03
    assert np.corrcoef(agree, similar)[0, 1] > 0.9


def test_group_of_many_copies_and_chains(spark, store):
    rng = random.Random(9)
    base = [f"tok{rng.randint(0, 99999)}" for _ in range(200)]
    rows = [(1000 + k, " ".join(base)) for k in range(60)]
    for k in range(60):
        near = list(base)
        near[rng.randrange(200)] = f"edit{k}"
        rows.append((2000 + k, " ".join(near)))
    other = [(5, " ".join(f"else{k}" for k in range(200)))]
    found = classes(spark.createDataFrame(rows + other, "doc_id long, text string"), store)
    assert {found[i] for i, _ in rows} == {1000} and found[5] == 5


def test_large_group_of_near_copies_among_other_texts(spark, store):
    """A third of all texts are made from one original by two edits each, and are less like each
    other than links ask for; the original has neither the first id nor the first hash."""
    rng = random.Random(4)
    base = [f"tok{rng.randint(0, 99999)}" for _ in range(200)]
    rows = []
    for k in range(150):
        near = list(base)
        near[rng.randrange(5, 195)], near[rng.randrange(5, 195)] = f"x{k}", f"y{k}"
        rows.append((k, " ".join(near)))
    rows.append((500, " ".join(base)))
    rows += [(1000 + k, " ".join(f"w{rng.randint(0, 99999)}" for _ in range(200))) for k in range(300)]
    found = classes(spark.createDataFrame(rows, "doc_id long, text string"), store)
    assert {found[k] for k in [*range(150), 500]} == {0}
    assert all(found[1000 + k] == 1000 + k for k in range(300))


def test_pairs_within_crowded_buckets(spark, store):
    """Variants of one text without the original: most are less like each other than links ask for, but
    two and two belong together, whichever members of their crowded buckets are centres."""
    rng = random.Random(11)
    base = [f"tok{rng.randint(0, 99999)}" for _ in range(200)]
    texts = {}
    for k in range(120):
        near = list(base)
        for place in rng.sample(range(8, 192), 2):
            near[place] = f"pair{k}at{place}"
        for twin in (2 * k, 2 * k + 1):
            own = list(near)
            own[rng.randrange(5, 195)] = f"own{twin}"
            texts[twin] = " ".join(own)
    expected = brute_classes(texts)
    assert len(set(expected.values())) > 20
    assert classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), store) == expected


def test_odd_rows(odd_docs, no_docs, store):
    found = classes(odd_docs, store)
    assert found == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8}
    kept = nd.drop_near_duplicates(odd_docs, store)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7, 8]
    assert classes(no_docs, store) == {}
    assert nd.drop_near_duplicates(no_docs, store).count() == 0


def some_text(seed, n=60, changed=()):
    words = [f"w{seed}x{k}" for k in range(n)]
    for k in changed:
        words[k] += "y"
    return " ".join(words)


@pytest.mark.parametrize("turned", [False, True])
def test_rows_of_one_id_are_judged_by_their_own_text(spark, store, turned):
    a, x, unique, y = some_text(1), some_text(2), some_text(3), some_text(4)
    near_x, near_y = some_text(2, changed=[30]), some_text(4, changed=[20])
    rows = [(1, a), (7, a), (7, unique), (8, x), (8, y), (9, near_x), (10, ""), (10, None), (10, some_text(5)), (10, some_text(5)),
            (11, some_text(6)), (11, some_text(6, changed=[9])), (3, near_y), (None, a), (12, some_text(7)), (12, some_text(7, changed=[9])),
            (2, some_text(7, changed=[40]))]
    stay = [(1, a), (7, unique), (8, x), (10, ""), (10, None), (10, some_text(5)), (3, near_y), (None, a), (2, some_text(7, changed=[40]))]
    df = spark.createDataFrame([(i, t, "k", "s", 1) for i, t in (rows[::-1] if turned else rows)],
                               "doc_id long, text string, `key` string, stays string, digest long")
    kept = nd.drop_near_duplicates(df, store)
    assert kept.columns == df.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    eleven = [t for i, t in found if i == 11]
    assert len(eleven) == 1 and eleven[0] in (some_text(6), some_text(6, changed=[9]))
    assert sorted((f for f in found if f[0] != 11), key=str) == sorted(stay, key=str)
    assert classes(df, store) == {1: 1, 7: 1, 8: 3, 9: 8, 10: 10, 11: 11, 3: 3, 12: 2, 2: 2}


def test_filter_lets_every_wanted_id_pass(spark):
    ids = spark.range(-500, 100_000, 37).withColumnRenamed("id", "doc_id")
    bitmap = nd.id_filter(ids)
    have = np.array([r[0] for r in ids.collect()]) % nd.FILTER_BITS
    assert ((bitmap[have >> 5] >> (have & 31).astype(np.uint32)) & 1).all()
    assert np.unpackbits(bitmap.view(np.uint8)).sum() == len(have)


@pytest.mark.parametrize("edges,expected", [
    ([(5, 9), (9, 7), (7, 3)], {3: 3, 5: 3, 7: 3, 9: 3}),
    ([(1, 2), (3, 4), (2, 3), (10, 11)], {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10})])
def test_components(spark, store, edges, expected):
    found = nd.components(spark.createDataFrame(edges, "a long, b long"), store)
    assert {r["id"]: r["label"] for r in found.collect()} == expected


def test_few_tables_are_stored(docs, store, monkeypatch):
    written = []
    keep = store.write
    monkeypatch.setattr(store, "write", lambda df, *name: written.append(0) or keep(df, *name))
    buckets = docs.selectExpr("doc_id div 3 AS bucket", "doc_id AS member", "doc_id AS part", "doc_id % 7 AS mates")
    rows = {(r["bucket"], r["member"], r["mates"]) for r in buckets.collect()}
    found = {tuple(r) for r in nd.candidates(buckets, store, 0, None).collect()}
    assert len(written) == 1
    for bucket in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == bucket]
        top = max(mine, key=lambda r: (r[2], -r[1]))[1]
        assert {(min(top, m), max(top, m)) for _, m, _ in mine if m != top} <= found
    assert all(a // 3 == b // 3 and a < b for a, b in found)
