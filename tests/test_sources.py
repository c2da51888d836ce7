import pytest
from pyspark.sql import functions as F

from readalike.plans import build
from readalike.sources import raw, views
from tests.conftest import rows


def write_raw(folder):
    books = ["ISBN,Book-Title,Book-Author,Year-Of-Publication,Publisher,"
             "Image-URL-S,Image-URL-M,Image-URL-L"]
    books += [f'{i:03d}," The ""Title"" {i} ",Ann O\xe9,{1990 + i},P,s,m,l' for i in range(6)]
    books += ['900,"quoted, comma",Bob,0,P,s,m,l']
    ratings = ["User-ID,ISBN,Book-Rating"]
    ratings += [f"{u},{i:03d},{(u * 3 + i * 5) % 11}" for u in range(1, 13) for i in range(6)]
    ratings += ["1,000,9", "x,000,5"]
    users = ["User-ID,Location,Age"] + [f'{u},"a, b",{14 + u}.0' for u in range(1, 13)]
    for name, lines in (("Books", books), ("Ratings", ratings), ("Users", users)):
        (folder / f"{name}.csv").write_bytes("\n".join(lines).encode("latin-1"))


def test_csv_scan(spark, tmp_path):
    write_raw(tmp_path)
    books = raw.read_raw(spark, f"{tmp_path}/Books.csv", "books")
    assert books.columns[:5] == ["isbn", "title", "author", "year", "publisher"]
    by_isbn = {r.isbn: r for r in books.collect()}
    assert by_isbn["001"].author == "Ann O\xe9" and by_isbn["900"].title == "quoted, comma"
    ratings = raw.read_raw(spark, f"{tmp_path}/Ratings.csv", "ratings")
    assert dict(ratings.dtypes) == {"user_id": "int", "isbn": "string", "rating": "int"}
    assert ratings.filter("user_id IS NULL").count() == 1


def test_build_end_to_end(spark, tmp_path):
    write_raw(tmp_path)
    counts = build.ingest(spark, str(tmp_path), f"{tmp_path}/processed")
    books, ratings, users = raw.load_processed(spark, f"{tmp_path}/processed")
    assert counts == {"books": books.count(), "ratings": ratings.count(), "users": users.count()}
    assert counts["books"] == 6 and counts["users"] == 12
    built = build.build_features(spark, f"{tmp_path}/processed", f"{tmp_path}/features")
    assert set(built) == {"item_index", "item_pairs", "item_similarity", "book_stats",
                          "age_group_dominant", "age_group_top_books"}
    assert built["item_similarity"] == 2 * built["item_pairs"] > 0
    for name, n in built.items():
        assert spark.read.parquet(f"{tmp_path}/features/{name}.parquet").count() == n


def test_from_csv_to_recommendations(spark, tmp_path):
    from pyspark.sql import functions as F
    from readalike.operators import strategies
    from readalike.sources.store import Store
    write_raw(tmp_path)
    processed, out = f"{tmp_path}/processed", f"{tmp_path}/features"
    cache = spark.createDataFrame([("000", "cached words", ["S"])], "isbn string, description string, subjects array<string>")

    def fetch(plan):
        return plan.select("batch_id", F.lit(
            '{"ISBN:001": {"description": {"value": "fetched words"}, "subjects": [{"name": "T"}]}}').alias("payload"))

    counts = build.build_all(spark, str(tmp_path), processed, out, cache, fetch, dim=16)
    assert (counts["ingest"]["books"], counts["metadata"]["metadata"], counts["metadata"]["enriched"]) == (6, 6, 6)
    enriched = {r.isbn: r for r in spark.read.parquet(f"{out}/enriched.parquet").collect()}
    assert [enriched[i].description for i in ("000", "001")] == ["cached words", "fetched words"]
    assert enriched["002"].subjects == "" and enriched["002"].description
    assert counts["vectors"] == {"book_embeddings": 6, "catalogue": 6}
    seeds = spark.createDataFrame([("000",)], "seed_isbn string")
    found = strategies.recommend_all(seeds, build.artefacts(spark, out), Store(spark)).collect()
    assert {"age_group", "same_author"} <= {r.strategy for r in found}


def test_bucketed_edges_are_read_without_a_shuffle(spark, tmp_path):
    from readalike.operators.strategies import cf_candidates
    from readalike.sources import buckets
    edges = spark.createDataFrame([(f"s{a}", f"b{b}", (a * b % 7) / 7) for a in range(40) for b in range(30)],
                                  "isbn string, other_isbn string, similarity double")
    path = str(tmp_path / "edges")
    for _ in range(2):   # a second build replaces the first
        stored = buckets.write_bucketed(edges, path, "isbn", "similarity", buckets=4)
    assert rows(stored) == rows(edges) and len(list((tmp_path / "edges").glob("*.parquet"))) == 4
    spark.sql(f"DROP TABLE {buckets._table(path)}")     # what a new session knows
    again = buckets.read_bucketed(spark, path, "isbn", "similarity", buckets=4)
    assert rows(again) == rows(edges)
    seeds = spark.createDataFrame([("s1",), ("s7",)], "seed_isbn string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lists = cf_candidates(seeds, again, 5)
        assert rows(lists) == rows(cf_candidates(seeds, edges, 5))
        plan = lists._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan     # that of the seeds
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_save_overwrites_and_counts(spark, tmp_path):
    assert raw.save(spark.range(10), f"{tmp_path}/t") == 10
    assert raw.save(spark.range(3), f"{tmp_path}/t") == 3
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3


def test_header_repair_and_coercion(spark):
    df = spark.createDataFrame([("1", "5"), ("2", "x"), ("3", None), ("4", "7.0"), ("5", "NaN")],
                               ['\xef\xbb\xbf "ISBN"', ' Book-Rating" '])
    fixed = raw.repair_headers(df)
    assert fixed.columns == ["ISBN", "Book-Rating"]
    assert raw.find_column(fixed, "RATING") == "Book-Rating"
    with pytest.raises(ValueError, match="author"):
        raw.find_column(fixed, "author")
    assert rows(raw.coerce_numeric(fixed, "Book-Rating")) == [("1", 5), ("4", 7)]


def test_store_uses_the_configured_folder(spark, store):
    from readalike.sources.store import shared_folder
    from readalike.sources.store import Store
    assert store.root.startswith(shared_folder(spark))
    assert rows(store.write(spark.range(2))) == [(0,), (1,)]
    before = spark.sparkContext.getCheckpointDir()
    own = Store(spark)
    table = own.write(spark.range(3))
    own.drop()
    assert spark.sparkContext.getCheckpointDir() == before
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(table.inputFiles()[0])


def test_texts_of_other_books_are_not_shuffled(spark, tmp_path):
    """Metadata of a few books is that of the view, and only their texts reach the join."""
    part = spark.range(1000).select(F.col("id").alias("p_partkey"), F.lit("a b").alias("p_name"), F.lit("T").alias("p_type"),
                                    F.lit(1).alias("p_size"))
    documents = spark.range(0, 1000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    for name, df in (("part", part), ("documents", documents)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    books = spark.createDataFrame([(f"{i:010d}",) for i in (3, 4, 998, 5000)], "isbn string")
    df = views.metadata_of(spark, str(tmp_path), books)
    wanted = views.role_view(spark, str(tmp_path), "raw_metadata").join(books, "isbn", "left_semi")
    assert rows(df) == rows(wanted) and df.count() == 3
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 2
