"""Plain-query baselines that the strategies are compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readalike import params
from readalike.functions import scores
from readalike.functions.text import is_blank, tag_set
from readalike.operators.ids import to_ids, to_isbns
from readalike.operators.pairs import ranked_co_ratings
from readalike.operators.ranking import top_k
from readalike.operators.skew import join_per_key
from readalike.operators.strategies import best_per_group
from readalike.sources.store import Store


def co_rated_top(seeds: DataFrame, ratings: DataFrame, k: int = params.TOP_K,
                 index: DataFrame | None = None, **options) -> DataFrame:
    """Books rated by the seed's raters, by co-raters, then mean rating."""
    return ranked_co_ratings(seeds, ratings, "count_mean", k, index, **options).select(
        "seed_isbn", "rank", "isbn", "co_raters", "mean_rating")


def co_rated_gems(seeds: DataFrame, ratings: DataFrame, stats: DataFrame, k: int = params.TOP_K,
                  pool: int = params.GEM_POOL, index: DataFrame | None = None,
                  **options) -> DataFrame:
    """The most co-rated books, re-ranked by co-raters over log popularity."""
    rows = ranked_co_ratings(seeds, ratings, "count", pool, index, **options)
    counted = rows.drop("rank").join(stats.select("isbn", "rating_count"), "isbn", "left")
    divisor = F.when(F.col("rating_count") > 0, F.log(1.0 + F.col("rating_count"))).otherwise(1.0)
    gems = counted.withColumn("score", scores.settle(F.col("co_raters") / divisor))
    return top_k(gems, ["seed_isbn"], [F.desc("score"), F.asc("isbn")], k).select(
        "seed_isbn", "rank", "isbn", "co_raters", scores.published(F.col("score")).alias("score"))


def _jaccard(common: Column, size_a: Column, size_b: Column) -> Column:
    return common / (size_a + size_b - common)


def subject_jaccard(seeds: DataFrame, enriched: DataFrame, k: int = params.TOP_K,
                    index: DataFrame | None = None, store: Store | None = None,
                    probes: int = params.TAG_PROBES) -> DataFrame:
    """Most similar books by Jaccard of the tag sets, positive overlap only.

    An exact top-k set-similarity join. Books of equal tag sets form a class and are compared
    once, by their first k + 1 members. Tags are ordered rarest first, and classes meet through pairs of tags:

    1. For the pairs among its ``probes`` rarest tags a seed looks at the k + 1 smallest classes
       of each pair. The (k + 1)-th best score so far is a bound: what scores less can't be in the list.
    2. A class of b tags that reaches the bound shares at least o(b) tags with a seed of a tags. If that
       is two or more, the first two shared ones stand among the first a - o + 2 tags of the seed and the
       first b - o + 2 of the class. So seeds and classes are joined on pairs of these tags and on b.
    3. What shares a single tag scores 1 / (a + b - 1), so of each tag only the k + 1 first by
       b and isbn can be in a list; seeds whose bound is that low look at them.

    How often a tag occurs decides how long its lists are, never whether they are looked at whole.
    """
    store = store or Store(enriched.sparkSession)
    tagged = enriched.select("isbn", F.array_sort(tag_set(F.col("subjects"))).alias("tags")).filter(F.size("tags") > 0)
    books = store.write(to_ids(tagged, index, "isbn"))
    classes = _tag_classes(books, k + 1, store)
    pairs = store.write(_tag_pairs(classes).select("key", "n", "upto", "class"))
    wanted = to_ids(seeds.select(F.col("seed_isbn").alias("isbn")).distinct(), index, "isbn")
    seed_books = store.write(books.join(wanted, "isbn", "left_semi").select(F.col("isbn").alias("seed_isbn"), "tags"))
    asked = store.write(classes.join(seed_books.select("tags").distinct(), "tags", "left_semi"))

    shortest = [F.asc("n"), F.asc("class")]
    short = top_k(pairs, ["key"], shortest, k + 1).select("key", "class")
    probed = _tag_pairs(asked).filter(F.col("upto") <= probes).select("key", F.col("class").alias("seed"))
    near = probed.join(short, "key").select("seed", "class").unionByName(
        asked.select(F.col("class").alias("seed"), "class")).distinct()
    first = store.write(_best_classes(near, asked, classes, k + 1))
    bound = _best_books(first, classes, k + 1).filter(F.col("rank") == k + 1).select(
        F.col("seed").alias("class"), F.col("score").alias("bound"))
    bounded = store.write(asked.join(bound, "class", "left").fillna(0.0, subset=["bound"]).filter("bound < 1"))

    # sizes that a class can have, and the least overlap with it; a little less, for rounding
    longest = classes.agg(F.max("n")).scalar()
    low = F.greatest(F.lit(1), F.ceil(F.col("bound") * F.col("n") - 1e-9)).cast("int")
    high = F.when(F.col("bound") > 0, F.least(F.floor(F.col("n") / F.col("bound") + 1e-9), longest)).otherwise(longest).cast("int")
    least = F.ceil(F.col("bound") * (F.col("n") + F.col("b")) / (1.0 + F.col("bound")) - 1e-9).cast("int")
    sized = bounded.filter(low <= high).withColumn("b", F.explode(F.sequence(low, high))).withColumn(
        "least", F.greatest(F.lit(2), least)).filter((F.col("least") <= F.col("n")) & (F.col("least") <= F.col("b")))
    looked = _tag_pairs(sized, "b", "least").filter(F.col("upto") <= F.col("n") - F.col("least") + 2).select(
        "key", "b", "least", F.col("class").alias("seed"))
    met = looked.alias("l").join(pairs.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.b") == F.col("r.n"))).filter(
        F.col("r.upto") <= F.col("l.b") - F.col("l.least") + 2).select("l.seed", "r.class")
    by_tag = classes.select("n", "class", F.explode("ordered").alias("tag"))
    loose = bounded.filter(F.col("bound") <= 1.0 / F.col("n") + 1e-9).select(
        F.explode("ordered").alias("tag"), F.col("class").alias("seed"))
    single = join_per_key(store.write(loose), store.write(top_k(by_tag, ["tag"], shortest, k + 1).groupBy("tag").agg(
        F.collect_list("class").alias("classes"))), "tag").select("seed", F.explode("classes").alias("class"))

    fresh = met.unionByName(single).distinct()
    second = _best_classes(fresh, asked, classes, k + 1).unionByName(first).distinct()
    order = [F.desc("score"), F.asc("class")]
    best = store.write(_best_books(top_k(second, ["seed"], order, k + 1).drop("rank"), classes, k + 1).join(
        asked.select(F.col("class").alias("seed"), "tags"), "seed").select("tags", "isbn", "score"))
    found = seed_books.join(best, "tags").filter(F.col("isbn") != F.col("seed_isbn"))
    lists = top_k(found, ["seed_isbn"], [F.desc("score"), F.asc("isbn")], k)
    return to_isbns(lists, index, "seed_isbn", "isbn").select(
        "seed_isbn", "rank", "isbn",
        scores.published(scores.settle(F.col("score"))).alias("score"))


def _tag_classes(books: DataFrame, size: int, store: Store) -> DataFrame:
    """(class, tags, n, ordered, members): per distinct tag set its first ``size`` books, named by the very first,
    and its tags rarest first."""
    first = top_k(books, ["tags"], [F.asc("isbn")], size)
    listed = first.groupBy("tags").agg(F.sort_array(F.collect_list("isbn")).alias("members"))
    listed = store.write(listed.withColumn("class", F.element_at("members", 1)))
    by_tag = store.write(listed.select("class", F.explode("tags").alias("tag")))
    counts = store.write(by_tag.groupBy("tag").agg(F.count(F.lit(1)).alias("books")))
    ordered = join_per_key(by_tag, counts, "tag").groupBy("class").agg(
        F.sort_array(F.collect_list(F.struct("books", "tag")))["tag"].alias("ordered"))
    return store.write(listed.join(ordered, "class").withColumn("n", F.size("tags")))


def _tag_pairs(classes: DataFrame, *kept: str) -> DataFrame:
    """Rows of the pairs of tags of each class: ``key`` is their hash, ``upto`` the place of the second one. Pairs of the
    same key are only candidates, so two of one hash cost work and change nothing."""
    def ending(place: Column) -> Column:
        last = F.element_at("ordered", place)
        return F.transform(F.slice("ordered", F.lit(1), place - 1), lambda tag: F.struct(
            F.xxhash64(tag, last).alias("key"), place.alias("upto")))

    every = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n")), ending))
    return classes.filter("n > 1").select("class", "n", *kept, F.inline(every))


def _best_classes(near: DataFrame, asked: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(seed, class, score): the first ``size`` classes of each seed among its candidates (seed, class)."""
    seed_tags = asked.select(F.col("class").alias("seed"), F.col("tags").alias("seed_tags"))
    both = near.join(seed_tags, "seed").join(classes.select("class", "tags"), "class")
    common = F.size(F.array_intersect("seed_tags", "tags"))
    # equal fractions are equal doubles, so the ranking needs no rounding
    scored = both.select("seed", "class", _jaccard(common, F.size("seed_tags"), F.size("tags")).alias("score"))
    return top_k(scored.filter("score > 0"), ["seed"], [F.desc("score"), F.asc("class")], size).drop("rank")


def _best_books(best: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(seed, isbn, score, rank): the first ``size`` books of each seed, which come from its first ``size`` classes."""
    members = best.join(classes.select("class", "members"), "class").select("seed", "score", F.explode("members").alias("isbn"))
    return top_k(members, ["seed"], [F.desc("score"), F.asc("isbn")], size)


def author_or_subject(seeds: DataFrame, stats: DataFrame, enriched: DataFrame,
                      k: int = params.TOP_K, pool: int = params.SUBJECT_POOL) -> DataFrame:
    """Same author or any common tag, by bayesian rating.

    The subject side is cut at ``pool`` by the same rating, so only its first
    min(pool, k) can reach the answer. Those are among the first of each tag,
    and no pair of books beyond them is formed.
    """
    rated = stats.select("isbn", "author", "bayesian_rating")
    wanted = seeds.select("seed_isbn").distinct()
    seed_rows = rated.withColumnRenamed("isbn", "seed_isbn").join(wanted, "seed_isbn", "left_semi")
    by_score = [F.desc("score"), F.asc("isbn")]

    authored = rated.filter(~is_blank(F.col("author")))
    author_best = best_per_group(authored, "author", "bayesian_rating", k + 1)
    same_author = join_per_key(seed_rows, author_best, "author").select("seed_isbn", F.inline("best")).drop(
        "rank")

    kept = min(pool, k)
    tags = enriched.select("isbn", F.explode(tag_set(F.col("subjects"))).alias("tag"))
    tag_best = best_per_group(tags.join(rated, "isbn"), "tag", "bayesian_rating", kept + 1)
    seed_tags = tags.withColumnRenamed("isbn", "seed_isbn").join(
        seed_rows.select("seed_isbn"), "seed_isbn", "left_semi")
    by_subject = (
        join_per_key(seed_tags, tag_best, "tag").select("seed_isbn", F.inline("best")).drop("rank")
        .filter(F.col("isbn") != F.col("seed_isbn")).dropDuplicates(["seed_isbn", "isbn"])
    )
    subject_pool = top_k(by_subject, ["seed_isbn"], by_score, kept).drop("rank")

    both = same_author.unionByName(subject_pool).filter(
        F.col("isbn") != F.col("seed_isbn")).dropDuplicates(["seed_isbn", "isbn"])
    return top_k(both, ["seed_isbn"], by_score, k).select(
        "seed_isbn", "rank", "isbn", scores.published(F.col("score")).alias("score"))


def list_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per seed: books in both lists, only in the left, only in the right."""
    sides = (
        left.select("seed_isbn", "isbn", F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.select("seed_isbn", "isbn", F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy("seed_isbn", "isbn").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    )
    return sides.groupBy("seed_isbn").agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("in_both"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("only_left"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("only_right"))
