import pytest
from pyspark.sql import functions as F

from readalike.operators import lookup
from tests.conftest import rows

STATS = "isbn string, title string, author string, rating_count long, bayesian_rating double"


@pytest.fixture(scope="module")
def stats(spark):
    return spark.createDataFrame([
        ("1", "the ring", "a", 5, 5.0), ("2", "the ring of fire", "a", 90, 5.0),
        ("3", "ring", "a", 50, 5.0), ("4", "c++ (2nd.) a.b", "a", 7, 5.0),
        ("5", "axb", "a", 9, 5.0), ("6", None, "a", 9, 5.0), ("7", "ring the", "a", 90, 5.0)], STATS)


@pytest.mark.parametrize("scan_limit", [0, 64])
def test_search(spark, stats, scan_limit):
    queries = spark.createDataFrame(
        [("The Ring ",), ("ring",), ("a.b",), ("c++",), ("  ",), ("",), ("zzz",), ("x",), ("zring",),
         ("\tRING\n",)], "query string")
    got = {}
    for r in lookup.search_books(queries, stats, 3, scan_limit).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.isbn))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {
        "The Ring ": ["1", "2"], "ring": ["3", "2", "7"], "\tRING\n": ["3", "2", "7"],
        "a.b": ["4"], "c++": ["4"], "x": ["5"]}


def test_no_cell_of_the_index_is_above_its_bound(spark, store):
    """A gram in all titles, asked for by many queries."""
    titles = [(f"{k:04d}", f"{'the ring' if k % 3 else 'ring the'} no {k % 50}", "a", k % 97, 5.0) for k in range(600)]
    books = spark.createDataFrame(titles, STATS)
    index = lookup.title_index(books, store, 32)
    sizes = [r[0] for r in index.cells.select(F.size("numbers")).collect()]
    assert max(sizes) <= 32 and index.counts.filter("gram = 'rin'").first()["n"] == 600
    asked = ["ring", "the", "ring the", "e", "ng no 4", "no 49", "in", "the ring no 7", "ring no 12", "x", "the rung"] + [
        f"ring no {k}" for k in range(90)]
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    got = {}
    for r in lookup.search_books(queries, index, 4, 0, store).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.isbn))
    for q in asked:
        hits = sorted((t != q, -n, i) for i, t, _, n, _ in titles if q in t)[:4]
        assert [i for _, i in sorted(got.get(q, []))] == [i for *_, i in hits]


def test_get_books_and_resolution(spark, stats):
    isbns = spark.createDataFrame([("3",), ("3",), ("9",)], "isbn string")
    assert [r[0] for r in rows(lookup.get_books(isbns, stats))] == ["3"]
    requests = spark.createDataFrame(
        [("1", "ring"), ("9", "ring"), (None, "ring"), ("", "fire"), (None, "nope"), (None, None)],
        "request_isbn string, request_title string")
    got = [(r.request_isbn, r.request_title, r.isbn, r.error)
           for r in lookup.resolve_seeds(requests, stats).collect()]
    assert sorted(got, key=str) == sorted([
        ("1", "ring", "1", None), ("9", "ring", None, "no book has this isbn"),
        (None, "ring", "3", None), ("", "fire", "2", None),
        (None, "nope", None, "no title matches"), (None, None, None, "no title matches"),
    ], key=str)


def test_display_and_percent(spark):
    recs = spark.createDataFrame([
        ("s", "m", 0.5, "t", "a", "T by A", " x , ,y,z,w"),
        ("s", "m", 0.25, "t", "a", "q" * 36, ""), ("s", "m", 0.0, "t", "a", "short", None)],
        "seed_isbn string, strategy string, score double, title string, author string,"
        " description string, subjects string")
    shown = lookup.display_columns(lookup.score_percent(recs)).orderBy(F.desc("score")).collect()
    assert [r.score_pct for r in shown] == [100, 50, 0]
    assert [r.has_description for r in shown] == [False, True, False]
    assert shown[0].tags == ["x", "y", "z"] and shown[2].tags == []
