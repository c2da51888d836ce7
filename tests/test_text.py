import random

import pytest

from pyspark.sql import functions as F

from readalike.functions import text
from readalike.functions.titles import is_edition, lcs_length
from readalike.operators import enrich, vectors
from readalike.operators.features import item_index
from tests.conftest import rows


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_edition_ratio_matches_brute_force(spark):
    rng = random.Random(1)
    pairs = [("the hobbit", "the hobbit (2nd ed)"), ("The Hobbit", "the hobbit"), ("", "x"),
             ("x", None), ("", ""), ("abcdefghijklmnopqrstuvwxy", "abcdefghijklmnopqrstuvxzy")]
    for _ in range(150):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 30)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "d"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.withColumn("e", is_edition(F.col("a"), F.col("b"))).collect():
        a, b = (r.a or "").lower(), (r.b or "").lower()
        expected = bool(a and b) and 200 * lcs(a, b) >= 88 * (len(a) + len(b))
        assert r.e == expected, (a, b)
    plain = df.filter("a <> '' and b <> ''")
    for r in plain.withColumn("n", lcs_length(F.col("a"), F.col("b"))).collect():
        assert r.n == lcs(r.a, r.b)


def test_lcs_of_several_words_of_bits(spark):
    rng = random.Random(5)
    pairs = [("a" * 62, "a" * 62), ("a" * 63, "a" * 61), ("ab" * 31, "ba" * 31), ("x" * 124, "y"), ("é" * 70 + "z", "z" + "é" * 70)]
    for n in (61, 62, 63, 124, 125, 200, 200):
        pairs.append(tuple("".join(rng.choice("abcdé ") for _ in range(n + rng.randint(-2, 2))) for _ in "ab"))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.withColumn("n", lcs_length(F.col("a"), F.col("b"))).collect():
        assert r.n == lcs(r.a, r.b), (r.a, r.b)


def test_metadata_parsing(spark):
    data = [
        ("s", '{"description": "plain", "subjects": [{"name": "A"}, {"url": "u"}, {"name": "B"}]}'),
        ("o", '{"description": {"type": "t", "value": "inner"}}'),
        ("n", '{"description": {"type": "t"}, "subjects": []}'),
        ("j", '{"description": "{\\"value\\": 1}"}'),
        ("m", "{}"), ("b", "not json"), ("x", None),
    ]
    df = spark.createDataFrame(data, "isbn string, payload string")
    got = {r.isbn: (r.description, r.subjects) for r in enrich.parse_metadata(df).collect()}
    assert got == {"s": ("plain", ["A", "B"]), "o": ("inner", []), "n": ("", []),
                   "j": ('{"value": 1}', []), "m": ("", []), "b": ("", []), "x": ("", [])}


def test_fetch_plan_and_cache(spark, store):
    books = spark.createDataFrame([(f"{i:03d}",) for i in range(25)], "isbn string")
    schema = "isbn string, description string, subjects array<string>"
    cache = spark.createDataFrame([("003", "old", ["x"]), ("zzz", "kept", [])], schema)
    missing = enrich.missing_keys(books, cache)
    plan = enrich.fetch_plan(item_index(store, missing), batch=10, wave=2).orderBy("batch_id").collect()
    assert [(r.batch_id, r.wave, r.n_keys) for r in plan] == [(0, 0, 10), (1, 0, 10), (2, 1, 4)]
    assert plan[0].bibkeys.startswith("ISBN:000,ISBN:001,ISBN:002,ISBN:004")
    new = spark.createDataFrame([("003", "new", ["y"])], schema)
    assert rows(enrich.upsert_cache(cache, new)) == [("003", "new", ["y"]), ("zzz", "kept", [])]
    filled = enrich.with_failed_defaults(books.limit(1), cache)
    assert rows(filled) == [("000", "", [])]


def test_upsert_replaces_only_the_folders_it_touches(spark, store, tmp_path):
    schema = "isbn string, description string, subjects array<string>"
    cache = spark.createDataFrame([(f"i{k:03d}", f"old {k}", ["a", None]) for k in range(200)], schema)
    new = spark.createDataFrame([("i007", "new", []), ("i900", None, None)], schema)
    path = str(tmp_path / "cache")
    enrich.write_cache(cache, path, 16)

    def files():
        return {str(f.relative_to(path)) for f in (tmp_path / "cache").rglob("*.parquet")}

    before = files()
    merged = enrich.upsert_cache_table(spark, path, new, store, 16)
    assert merged.columns == ["isbn", "description", "subjects"]
    assert rows(merged) == rows(enrich.upsert_cache(cache, new))
    gone = {f.split("/")[0] for f in before - files()}
    assert 1 <= len(gone) <= 2 and len(before & files()) >= len(before) - 2
    again = enrich.upsert_cache_table(spark, path, new.limit(0), store, 16)
    assert rows(again) == rows(merged) and enrich.read_cache(spark, path).count() == 201


def test_enriched_rows_and_text(spark):
    books = spark.createDataFrame(
        [("a", "t", "w"), ("b", "t", None), ("c", "t", ""), ("d", "t", "w")],
        "isbn string, title string, author string")
    meta = spark.createDataFrame([("a", "long description", [f"s{i}" for i in range(25)])],
                                 "isbn string, description string, subjects array<string>")
    enriched = enrich.enrich_books(books, meta)
    got = {r.isbn: r for r in enriched.collect()}
    assert got["a"].subjects == ", ".join(f"s{i}" for i in range(20))
    assert [got[i].description for i in "bcd"] == ["t", "t", "t by w"]
    texts = {r.isbn: r.text for r in vectors.embedding_text(enriched).collect()}
    assert texts["a"].startswith("t by w. long description. Genres: s0, s1")
    assert texts["b"] == "t" and texts["d"] == "t by w"
    assert enrich.description_coverage(enriched).first().coverage_pct == 0.0


@pytest.mark.parametrize("subjects,expected", [
    ("Dragons, Murder", "Fantasy"), ("murder", "Mystery"), ("Historical fiction", "History"),
    ("historical romance", "Romance"), ("", "Other"), (None, "Other"), ("cooking", "Other")])
def test_genre(spark, subjects, expected):
    df = spark.createDataFrame([(subjects,)], "s string")
    assert df.select(text.genre(F.col("s"))).first()[0] == expected


def test_strip_and_tags(spark):
    df = spark.createDataFrame([(" \tA , b,,a,\n",)], "s string")
    assert df.select(text.tag_set(F.col("s"))).first()[0] == ["a", "b"]
    assert df.select(text.ngrams(F.lit("abab"), 2)).first()[0] == ["ab", "ba"]
    assert df.select(text.ngrams(F.lit("a"), 2)).first()[0] == []
