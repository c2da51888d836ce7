"""Times the headline queries and prints one JSON line.

The stages of the build are timed first, as they make the tables that the
recommendation queries read; every later query is timed from those tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from readalike.plans.queries import registered  # noqa: E402
from readalike.plans.workspace import workspace  # noqa: E402

STAGES = ("all_ratings", "books", "ratings", "users", "index", "pair_table", "pairs", "similarity", "stats",
          "dominant", "top_books", "title_index", "metadata", "enriched", "catalogue", "vectors", "explicit_once", "explored",
          "explored_index")
HEADLINE = (
    "clean_ratings", "clean_books", "item_similarity", "book_stats", "age_group_dominant",
    "age_group_top_books", "enrich_books", "embedding_text", "encode_text", "knn_inner_product",
    "readers_also", "hidden_gems", "similar_themes", "same_author", "age_group_picks",
    "top_picks", "recommend_all", "search_books", "resolve_seeds", "co_rated_top",
    "co_rated_gems", "subject_jaccard", "author_or_subject", "fan_co_reads",
    "similarity_report", "long_tail_histogram",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    tables, runs, seconds = workspace(spark, sf_dir), registered(), {}

    for stage in STAGES:
        started = time.perf_counter()
        getattr(tables, stage)
        seconds[f"build_{stage}"] = time.perf_counter() - started

    for name in names:
        started = time.perf_counter()
        runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = time.perf_counter() - started

    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {name: round(s, 3) for name, s in seconds.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
