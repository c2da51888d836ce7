"""Role views: the catalogue, rating, user, metadata and vector tables as they
are read from the test schema. One text serves Spark and the SQL checks; the
``{name}`` places take a DataFrame in Spark and a table name elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLE_VIEWS = {
    "raw_books": """
        SELECT lpad(CAST(p_partkey AS STRING), 10, '0') AS isbn,
               concat(' ', upper(p_name), ' ', CAST(p_partkey % 20 AS STRING), ' ') AS title,
               CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE concat(p_brand, ' ') END AS author,
               CASE WHEN p_partkey % 10 = 0 THEN '0'
                    WHEN p_partkey % 10 = 1 THEN 'unknown'
                    ELSE CAST(1890 + p_partkey % 150 AS STRING) END AS year,
               p_type AS publisher
        FROM {part}""",
    "raw_ratings": """
        SELECT CAST(o.o_custkey AS INT) AS user_id,
               lpad(CAST(l.l_partkey AS STRING), 10, '0') AS isbn,
               CAST(l.l_quantity AS INT) % 11 AS rating
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "raw_users": """
        SELECT CAST(c.c_custkey AS INT) AS user_id,
               n.n_name AS location,
               CASE WHEN c.c_custkey % 20 = 0 THEN 'n/a'
                    ELSE concat(CAST(CAST(floor(c.c_acctbal / 100) AS INT) AS STRING), '.0')
               END AS age
        FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "raw_metadata": """
        SELECT lpad(CAST(p.p_partkey AS STRING), 10, '0') AS isbn,
               coalesce(d.text, '') AS description,
               concat(replace(p.p_name, ' ', ', '), ', ', lower(p.p_type),
                      ', size ', CAST(p.p_size AS STRING)) AS subjects
        FROM {part} p LEFT JOIN {documents} d ON d.doc_id = p.p_partkey""",
    "book_embeddings": """
        SELECT lpad(CAST(vec_id AS STRING), 10, '0') AS isbn, embedding FROM {embeddings}""",
}

TABLES = ("part", "lineitem", "orders", "customer", "nation", "documents", "embeddings")


def role_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = ROLE_VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    if "lineitem" in used:
        # orders are unique and far fewer, so a task hashes its share of them and sorts neither side
        used["orders"] = used["orders"].hint("shuffle_hash")
    return spark.sql(text, **used)


def metadata_of(spark: SparkSession, sf_dir: str, books: DataFrame) -> DataFrame:
    """The rows of ``raw_metadata`` whose isbn is among ``books``. The view joins texts; those of other isbns leave
    where they are read, so they are neither shuffled nor parsed."""
    part, documents = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "documents"))
    isbn = F.lpad(F.col("p_partkey").cast("string"), 10, "0")
    kept = part.join(books.select("isbn"), isbn == F.col("isbn"), "left_semi")
    texts = documents.join(kept.select("p_partkey"), F.col("doc_id") == F.col("p_partkey"), "left_semi")
    return spark.sql(ROLE_VIEWS["raw_metadata"], part=kept, documents=texts)


def role_sql(name: str) -> str:
    return ROLE_VIEWS[name].format(**{t: t for t in TABLES})
