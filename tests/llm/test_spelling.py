import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readalike.llm import spelling as s
from readalike.llm.queries import op12_spelling_variants, table

SF = "/root/testdata/sf0.001"
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]
ASCII = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def brute_counts(rows):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def brute_near(words):
    """Words that meet after one letter of one or of both is left out, at the same place."""
    holes = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[w[:k] + "\0" + w[k + 1:]].add(w)
        for k in range(len(w) + 1):
            holes[w[:k] + "\0" + w[k:]].add(w)
    near = defaultdict(set)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    # a hole that two words fill by nothing makes them equal, so all others are one edit apart
    return near


def brute(rows):
    words = brute_counts(rows)
    near = brute_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def found(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, folder):
    wanted = brute([(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()])
    assert found(op12_spelling_variants(spark, folder)) == wanted
    assert any(r[1] for r in wanted) and any(r[4] for r in wanted)


def test_odd_and_empty_tables(spark, store, odd_docs, no_docs):
    wanted = brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert found(s.spelling_variants(odd_docs, store)) == wanted
    assert found(s.spelling_variants(no_docs, store)) == set()


def test_letters_ties_chains_and_long_runs(spark, store):
    long = "abcdefghij" * 3000
    text = ("fooobar " * 400 + "foobar " * 60 + "foobarr " * 5 + "ÀÉabcdef àÉabcdef " * 6 + "Straße×÷x " * 5
            + "abcdefgh bbcdefgh cbcdefgh " * 7 + "abcdefāghijkl 日本abcdefg " * 6 + f"{long} {long[:-1]} {long}x " * 5
            + "aaaaaa aaaaaaa aaaaaaaa " * 9)
    rows = [(1, text, "", "", 1), (None, text.upper(), None, None, None), (1, text, "", "", 1), (2, None, "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n string, key long")
    wanted = brute([r[:2] for r in rows])
    assert found(s.spelling_variants(docs, store)) == wanted
    chain = {r[0]: r[1:3] for r in wanted}
    assert chain["foobarr"] == ("foobar", "fooobar") and chain["bbcdefgh"][0] is None


WORDS = st.lists(st.text("abcé", min_size=6, max_size=9), min_size=2, max_size=60, unique=True)


@settings(max_examples=200, deadline=None)
@given(WORDS, st.integers(0, 5))
def test_every_near_pair_meets_under_a_key(words, shift):
    counts = Counter(w[i:i + 2] for w in words for i in range(len(w) - 1))
    ranks = {g: (k, n) for k, (n, g) in enumerate(sorted((n, g) for g, n in counts.items()))}
    places = {w: s.prefix(w, ranks) for w in words}
    chosen = {w: s.pivots(w, places[w][0], ranks) for w in words}
    for w in words:
        a, b = chosen[w]
        assert b - a >= 2 and {a, b} <= set(places[w][0])
        cost = [counts[w[i:i + 2]] + counts[w[j:j + 2]] for i in places[w][0] for j in places[w][0] if j - i >= 2]
        assert counts[w[a:a + 2]] + counts[w[b:b + 2]] == min(cost)
    keys = {w: set(s.pivot_keys(w, chosen[w])) for w in words}
    others = {w: set(s.prefix_keys(w, places[w][0])) for w in words}
    for w, near in brute_near(words).items():
        for v in near:
            if places[w][1] <= places[v][1]:
                assert keys[w] & others[v], (w, v)
