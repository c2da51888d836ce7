"""URL filter: host and path rules, and gradient-boosted trees for the urls without a rule.

The labelled urls are those that a rule decides. Trees learn from their lexical
features only: lengths, depth, digit ratio, entropy of characters, counts of parameters and of
other marks, and statistics of the host's last label and the path's ending (how
often they occur among the labelled urls, and what share of them is blocked). Training
takes at most ``TRAIN_ROWS`` labelled urls, lowest hash of url and id first; the statistics
count all of them.

All steps are DataFrame expressions and Spark ML. The tables of suffix statistics are
stored, so that Spark knows their size and can broadcast them or split a hot suffix.

Defined cases: a url that is null or has no ``://`` has an empty host and path, no rule, and
the features of an empty text; if the labelled urls have less than two verdicts, the method
allows what has no rule; repeated rows and null ids are kept, each row for itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readalike.sources.store import Store

# Fixed values: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
TRAIN_ROWS = 50_000
TREES, DEPTH, BINS = 10, 4, 32
PRIOR = 10.0           # labelled urls at the overall rate, added to those of each suffix
SEED = 7
FEATURES = ("url_length", "host_length", "path_length", "query_length", "n_labels", "depth", "digit_ratio",
            "entropy", "n_parameters", "n_hyphens", "n_dots", "has_fragment", "secure", "ends_with_slash",
            "tld_count", "tld_blocked", "ending_count", "ending_blocked")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p),
                   F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))]
    return F.coalesce(*fits)


def entropy(text: Column) -> Column:
    """Bits per character of a text."""
    size = F.length(text)

    def term(total: Column, char: Column) -> Column:
        share = (size - F.length(F.replace(text, char, F.lit("")))) / size
        return total - F.when(share > 0, share * F.log2(share)).otherwise(0.0)

    return F.when(size > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), term)).otherwise(0.0)


def lexical(pages: DataFrame) -> DataFrame:
    """page_id, host, path, fit (the rule, if any) and the features of the url itself."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))

    def number(text: Column, mark: str) -> Column:
        return F.length(text) - F.length(F.translate(text, mark, ""))

    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    parts = parts.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    host, path = F.col("host"), F.col("path")
    return parts.select(
        "page_id", "url", "host", "path", rule_of(host, path).alias("fit"),
        F.regexp_extract(host, r"([^.]*)$", 1).alias("tld"),
        F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).alias("ending"),
        F.length(url).cast("double").alias("url_length"),
        F.length(host).cast("double").alias("host_length"),
        F.length(path).cast("double").alias("path_length"),
        F.length(query).cast("double").alias("query_length"),
        (number(host, ".") + 1).cast("double").alias("n_labels"),
        number(path, "/").cast("double").alias("depth"),
        F.when(F.length(url) > 0, digits / F.length(url)).otherwise(0.0).alias("digit_ratio"),
        entropy(url).alias("entropy"),
        F.when(query == "", 0.0).otherwise(number(query, "&") + 1.0).alias("n_parameters"),
        number(url, "-").cast("double").alias("n_hyphens"),
        number(url, ".").cast("double").alias("n_dots"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
        F.startswith(url, F.lit("https:")).cast("double").alias("secure"),
        F.endswith(path, F.lit("/")).cast("double").alias("ends_with_slash"))


def suffix_statistics(labelled: DataFrame, name: str, rate: float, store: Store) -> DataFrame:
    """Per value of a suffix: log count and smoothed share of blocked among labelled urls."""
    n = F.count(F.lit(1))
    return store.write(labelled.groupBy(F.col(name).alias(f"{name}_value")).agg(
        F.log1p(n).alias(f"{name}_count"),
        ((F.sum("label") + PRIOR * rate) / (n + PRIOR)).alias(f"{name}_blocked")))


def verdicts(pages: DataFrame, store: Store, rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, and the trees' probability of block where no rule fits."""
    urls = lexical(pages)
    labelled = urls.filter("fit IS NOT NULL").withColumn("label", (F.col("fit.verdict") == "block").cast("double"))
    sample = store.write(labelled.orderBy(F.xxhash64("url", "page_id"), "url", "page_id").limit(rows).drop("fit"))
    low, high = sample.agg(F.min("label"), F.max("label")).first()
    learnt = low is not None and low != high
    if learnt:
        rate = labelled.agg(F.avg("label")).first()[0]
        statistics = [(name, suffix_statistics(labelled, name, rate, store)) for name in ("tld", "ending")]

        def described(table: DataFrame) -> DataFrame:
            joined = reduce(lambda t, s: t.join(s[1], F.col(s[0]) == F.col(f"{s[0]}_value"), "left"), statistics, table)
            filled = joined.fillna({f"{name}_{k}": v for name, _ in statistics for k, v in (("count", 0.0), ("blocked", rate))})
            return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(filled)

        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, seed=SEED).fit(
            store.write(described(sample).select("features", "label")))
        urls = trees.transform(described(urls)).withColumn(
            "blocked", vector_to_array("probability")[1])
    else:
        urls = urls.withColumn("blocked", F.lit(0.0))
    return urls.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("blocked") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("fit").isNull(), F.col("blocked")).alias("blocked"))
