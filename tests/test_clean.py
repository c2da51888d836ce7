from readalike.operators import clean
from tests.conftest import rows

BOOKS = "isbn string, title string, author string, year string, publisher string"
RATINGS = "user_id int, isbn string, rating int"


def test_drop_nulls(spark):
    df = spark.createDataFrame([(1, "a", 5), (None, "a", 5), (1, None, 5), (1, "b", None)], RATINGS)
    assert rows(clean.drop_nulls(df, ["user_id", "isbn", "rating"])) == [(1, "a", 5)]


def test_highest_of_repeated_ratings_stays(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "a", 8), (2, "a", 3)], RATINGS)
    assert rows(clean.dedupe_ratings(df)) == [(1, "a", 8), (2, "a", 3)]


def test_explicit_range_and_users(spark):
    data = [(1, "a", 0), (1, "b", 1), (1, "c", 10), (1, "d", 11), (1, "e", None), (1, "f", 5),
            (2, "a", 5), (2, "b", 6), (3, "a", 0), (3, "a", 11), (3, "b", 4), (3, "c", 4), (3, "d", 4)]
    df = spark.createDataFrame(data, RATINGS)
    # user 2 has two explicit ratings; user 3's repeated rating is 11 and leaves
    assert rows(clean.clean_ratings(df)) == [
        (1, "b", 1), (1, "c", 10), (1, "f", 5), (3, "b", 4), (3, "c", 4), (3, "d", 4)]


def test_year_and_age(spark):
    years = ["0", "-5", "1499", "1500", "2025", "2026", "abc", None]
    df = spark.createDataFrame([(str(i), "t", "a", y, "p") for i, y in enumerate(years)], BOOKS)
    assert [r[3] for r in rows(clean.clean_year(df))] == [
        None, None, None, 1500, 2025, None, None, None]
    ages = ["12", "13", "34.9", "100", "101", "n/a", None]
    users = spark.createDataFrame([(i, "x", a) for i, a in enumerate(ages)],
                                  "user_id int, location string, age string")
    assert [r[2] for r in rows(clean.clean_users(users))] == [None, 13, 34, 100, None, None, None]


def test_book_threshold_and_editions(spark):
    def rated(isbn, n):
        return [(u, isbn, 5) for u in range(n)]

    ratings = spark.createDataFrame(
        rated("a", 4) + rated("b", 5) + rated("c", 7) + rated("d", 7) + rated("e", 6)
        + rated("f", 6), RATINGS)
    books = spark.createDataFrame([
        ("a", "Few", "x", "1999", "p"), ("b", " One Title ", "X", "1999", "p"),
        ("c", "one title", "x ", "1999", "p"), ("d", "ONE TITLE", "x", "1999", "p"),
        ("e", "lone", None, "1999", "p"), ("f", "lone", None, "1999", "p"),
        ("g", "unrated", "x", "1999", "p")], BOOKS)
    kept = [r[0] for r in rows(clean.clean_books(books, ratings))]
    assert kept == ["c", "e"]
    by_isbn = clean.dedupe_editions(clean.normalize_text(books, "title"))
    assert "f" not in [r[0] for r in rows(by_isbn)]
    assert [r[0] for r in rows(clean.books_with_ratings(books, ratings))] == list("abcdef")
    assert [r[0] for r in rows(clean.min_ratings_per_book(books, ratings))] == list("bcdef")


def test_isbn_with_two_titles_does_not_multiply_ratings(spark):
    ratings = spark.createDataFrame([(u, "a", 5) for u in range(6)], RATINGS)
    books = spark.createDataFrame(
        [("a", "two", "x", "1999", "p"), ("a", "one", "x", "1999", "p")], BOOKS)
    cleaned = clean.clean_books(books, ratings)
    assert [r[:2] for r in rows(cleaned)] == [("a", "one")]
    assert clean.ratings_of_books(ratings, books).count() == 6


def test_ratings_are_written_and_counted_once(spark, monkeypatch):
    data = [(u, f"b{i}", 5) for u in range(12) for i in range(u % 5 + 1)]
    ratings = spark.createDataFrame(data, RATINGS)
    wanted = sorted(row for row in data if row[0] % 5 >= 2)
    for limit, tables in ((500_000, 2), (0, 3)):   # with many rare users the result is a table of its own
        monkeypatch.setattr(clean.params, "RARE_USERS", limit)
        store, written = clean.Store(spark), []
        monkeypatch.setattr(store, "write", lambda df, _w=store.write, _l=written: (_l.append(df), _w(df))[1])
        monkeypatch.setattr(clean, "Store", lambda _s, _t=store: _t)
        kept = clean.clean_ratings(ratings, store=store)
        assert rows(kept) == wanted and len(written) == tables
        assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
        monkeypatch.undo()
    books = spark.createDataFrame([(f"b{i}", "t", "a", "1999", "p") for i in range(7)], BOOKS)
    cleaned = clean.clean_books(books, kept)
    assert [r[0] for r in rows(cleaned)] == ["b0"]
    assert cleaned._jdf.queryExecution().optimizedPlan().toString().count("count(1)") == 1
    assert [r[0] for r in rows(clean.clean_books(books, kept, 0))] == ["b0"]
    assert rows(clean.clean_books(books, kept, 9)) == []


def test_users_with_few_ratings_leave_without_a_shuffle_of_the_ratings(spark, monkeypatch):
    data = [(u, f"b{i}", 5) for u in range(30) for i in range(u % 5)] + [(None, "b1", 5)] * 4
    ratings = spark.createDataFrame(data, "user_id int, isbn string, rating int")
    wanted = sorted(row for row in data if row[0] is not None and row[0] % 5 >= 3)
    df = clean.min_ratings_per_user(ratings, 3)
    assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    assert rows(df) == wanted
    monkeypatch.setattr(clean.params, "RARE_USERS", 2)   # more of them than are broadcast
    assert rows(clean.min_ratings_per_user(ratings, 3)) == wanted
