"""The tables that the registered queries read, built once per test folder.

The chain is that of ``plans.build``: role views, processed tables, feature
tables. Each stage that later ones share is stored, as the build stores it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readalike.operators import clean, enrich, explore, features, strategies, vectors
from readalike.operators.lookup import TitleIndex, title_index
from readalike.operators.pairs import PairTable, pair_table
from readalike.sources.buckets import write_bucketed
from readalike.sources.store import Store
from readalike.sources.views import metadata_of, role_view


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.store = Store(spark)

    def raw(self, name: str) -> DataFrame:
        return role_view(self.spark, self.sf_dir, name)

    # processed tables
    @cached_property
    def all_ratings(self) -> DataFrame:
        """Clean ratings before the restriction to surviving books."""
        return clean.clean_ratings(self.raw("raw_ratings"), store=self.store)

    @cached_property
    def books(self) -> DataFrame:
        return self.store.write(
            clean.clean_books(self.raw("raw_books"), self.all_ratings), "books")

    @cached_property
    def ratings(self) -> DataFrame:
        return self.store.write(
            clean.ratings_of_books(self.all_ratings, self.books), "ratings")

    @cached_property
    def users(self) -> DataFrame:
        return self.store.write(clean.clean_users(self.raw("raw_users")), "users")

    # feature tables
    @cached_property
    def index(self) -> DataFrame:
        return self.store.write(features.item_index(self.store, self.books), "item_index")

    @cached_property
    def pair_table(self) -> PairTable:
        """Sums of all co-rated pairs, once for similarities and rankings."""
        return pair_table(features.center_ratings(self.ratings), self.store, self.index)

    @cached_property
    def pairs(self) -> DataFrame:
        similar = features.item_similarity(self.ratings, table=self.pair_table)
        return self.store.write(similar, "item_pairs")

    @cached_property
    def similarity(self) -> DataFrame:
        edges = features.symmetric_similarity(self.pairs, self.books)
        return write_bucketed(edges, self.store.folder("item_similarity"), "isbn", "similarity")

    @cached_property
    def stats(self) -> DataFrame:
        return self.store.write(features.book_stats(self.books, self.ratings), "book_stats")

    @cached_property
    def dominant(self) -> DataFrame:
        return self.store.write(
            features.age_group_dominant(self.ratings, self.users), "age_group_dominant")

    @cached_property
    def top_books(self) -> DataFrame:
        return self.store.write(features.age_group_top_books(
            self.ratings, self.users, self.stats), "age_group_top_books")

    @cached_property
    def title_index(self) -> TitleIndex:
        return title_index(self.stats, self.store)

    # text and vectors
    def metadata_of_books(self) -> DataFrame:
        """What is known of the processed books, which is all that a catalogue of them can need."""
        return metadata_of(self.spark, self.sf_dir, self.books)

    def payloads(self, meta: DataFrame | None = None) -> DataFrame:
        """Fetched responses as JSON text; every other description is an object."""
        meta = self.raw("raw_metadata") if meta is None else meta
        names = F.transform(F.split("subjects", ", "), lambda s: F.struct(s.alias("name")))
        as_text = F.to_json(F.struct("description", names.alias("subjects")))
        value = F.struct(F.lit("/type/text").alias("type"), F.col("description").alias("value"))
        as_object = F.to_json(F.struct(value.alias("description"), names.alias("subjects")))
        odd = F.substring("isbn", -1, 1).isin("1", "3", "5", "7", "9")
        return meta.select("isbn", F.when(odd, as_object).otherwise(as_text).alias("payload"))

    def cache(self) -> DataFrame:
        """Metadata fetched earlier: the books that came with a description."""
        meta = self.raw("raw_metadata").filter(F.col("description") != "")
        return meta.select("isbn", "description", F.split("subjects", ", ").alias("subjects"))

    @cached_property
    def metadata(self) -> DataFrame:
        return self.store.write(enrich.parse_metadata(self.payloads(self.metadata_of_books())), "metadata")

    @cached_property
    def enriched(self) -> DataFrame:
        return self.store.write(enrich.enrich_books(self.books, self.metadata), "enriched")

    @cached_property
    def catalogue(self) -> DataFrame:
        return self.store.write(strategies.catalogue(self.stats, self.enriched), "catalogue")

    @cached_property
    def vectors(self) -> DataFrame:
        """Unit vectors of the processed books that have one."""
        known = self.raw("book_embeddings").join(self.books.select("isbn"), "isbn", "left_semi")
        return self.store.write(vectors.l2_normalize(known), "vectors")

    # exploratory tables
    @cached_property
    def explicit_once(self) -> DataFrame:
        return explore.explicit_once(self.raw("raw_ratings"), self.store)

    @cached_property
    def explored(self) -> tuple[DataFrame, DataFrame]:
        books = self.store.write(explore.explore_clean(self.raw("raw_books"), self.explicit_once)[0], "explored_books")
        return books, self.store.write(clean.ratings_of_books(self.explicit_once, books), "explored_ratings")

    @cached_property
    def explored_index(self) -> DataFrame:
        return self.store.write(
            features.item_index(self.store, self.explored[0]), "explored_index")

    # seeds and results
    @property
    def seeds(self) -> DataFrame:
        """Every processed book is a seed."""
        return self.books.select(F.col("isbn").alias("seed_isbn"))

    @property
    def artefacts(self) -> Workspace:
        """The workspace itself: a table that a strategy reads is made then, others not at all."""
        return self

    @cached_property
    def recommendations(self) -> DataFrame:
        recs = strategies.recommend_all(self.seeds, self.artefacts, self.store)
        return self.store.write(recs, "recommendations")


_workspaces: dict[tuple[str, str], tuple[list[tuple[str, int, int]], Workspace]] = {}


def _files(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """Name, time and size of what lies in a folder, and in folders in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    entries = system.listStatus(path)
    entries = [*entries, *(e for top in entries if top.isDirectory() for e in system.listStatus(top.getPath()))]
    return sorted((e.getPath().toString(), e.getModificationTime(), e.getLen()) for e in entries)


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The tables of one folder, made anew when its files have changed."""
    folder = sf_dir.rstrip("/")
    key, files = (spark.sparkContext.applicationId, folder), _files(spark, folder)
    if key not in _workspaces or _workspaces[key][0] != files:
        _workspaces[key] = files, Workspace(spark, folder)
    return _workspaces[key][1]
