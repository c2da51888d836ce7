"""Text to vectors, and exact nearest neighbours by inner product."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readalike import params
from readalike.functions.text import is_blank, title_by_author
from readalike.operators.ranking import top_k
from readalike.sources.store import Store


Encoder = Callable[[pd.Series], np.ndarray]


def embedding_text(enriched: DataFrame) -> DataFrame:
    """(isbn, text): header, description unless it repeats the header, genres."""
    header = title_by_author(F.col("title"), F.col("author"))
    description = F.coalesce("description", F.lit(""))
    text = F.concat_ws(
        ". ",
        F.when(header != "", header),
        F.when((description != "") & (description != header), description),
        F.when(~is_blank(F.col("subjects")), F.concat(F.lit("Genres: "), F.col("subjects"))),
    )
    return enriched.select("isbn", text.alias("text"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. What is merely named is copied by the optimizer to wherever
    it is read, and in a lambda computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _runs(ordered: Column) -> Column:
    """(bucket, n) of each run of equal values of a sorted array, in one pass."""
    starts = F.filter(F.transform(ordered, lambda b, i: F.when(~b.eqNullSafe(F.get(ordered, i - 1)), i)), lambda i: i.isNotNull())
    return _let(starts, lambda p: F.transform(p, lambda at, j: F.struct(
        F.get(ordered, at).alias("bucket"), (F.coalesce(F.get(p, j + 1), F.size(ordered)) - at).alias("n"))))


def hashed_tf_idf(texts: DataFrame, dim: int) -> DataFrame:
    """(isbn, embedding): counts of a text's words in ``dim`` hash buckets times the inverse document
    frequency of the bucket, ln((documents + 1) / (documents with it + 1)).

    Each row is counted where it is read; the counts are stored, so that texts are split once. Nothing
    but the frequencies is shuffled, ``dim`` rows a task.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\w+"), F.lit(0))
    buckets = F.sort_array(F.transform(words, lambda word: F.pmod(
        F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")))
    counts = Store(texts.sparkSession).write(texts.select("isbn", _let(buckets, _runs).alias("counts")))
    total = counts.count()
    found = counts.select(F.explode("counts.bucket").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("with_it"))
    with_it = dict(map(tuple, found.collect()))  # at most ``dim`` rows
    idf = F.lit([math.log((total + 1.0) / (with_it.get(b, 0) + 1.0)) for b in range(dim)])

    def last_bucket(place: Column) -> Column:
        return F.coalesce(F.get("counts", place)["bucket"], F.lit(-1))

    def zeros(before: Column, place: Column) -> Column:
        return F.array_repeat(F.lit(0.0), (place - before - 1).cast("int"))

    filled = F.flatten(F.transform("counts", lambda c, i: F.concat(
        zeros(last_bucket(i - 1), c["bucket"]), F.array(c["n"] * F.get(idf, c["bucket"])))))
    return counts.select("isbn", F.concat(filled, zeros(last_bucket(F.size("counts") - 1), F.lit(dim))).alias("embedding"))


def _checked(make_encoder: Callable[[], Encoder], dim: int | None) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    def make() -> Callable[[np.ndarray], np.ndarray]:
        encoder = make_encoder()

        def predict(texts: np.ndarray) -> np.ndarray:
            rows = np.asarray(encoder(pd.Series(texts)), dtype=np.float32)
            if rows.ndim != 2 or len(rows) != len(texts) or rows.shape[1] != (dim or rows.shape[1]):
                raise ValueError(f"the encoder gave {rows.shape} for {len(texts)} texts of {dim} values")
            return rows

        return predict

    return make


def encode(df: DataFrame, col: str = "text", encoder: Encoder | None = None, dim: int | None = None,
           make_encoder: Callable[[], Encoder] | None = None, batch_size: int = params.ENCODE_BATCH_TEXTS) -> DataFrame:
    """(isbn, embedding): unit vectors of ``dim`` floats.

    An encoder turns a batch of texts into a (rows, dim) array, which is checked; without ``dim`` any width
    will do. ``make_encoder`` makes one, which each Python worker does once and keeps for all its batches, so a model is
    loaded where it is used and never sent with a task; a light encoder can be given itself. Without either: hashed
    term counts weighted by inverse document frequency, in ``params.EMBEDDING_DIM`` buckets.
    """
    texts = df.select("isbn", F.coalesce(F.col(col), F.lit("")).alias("text"))
    if encoder is not None:
        def make_encoder() -> Encoder:
            return encoder
    if make_encoder is None:
        vectors = hashed_tf_idf(texts, dim or params.EMBEDDING_DIM)
    else:
        run = predict_batch_udf(_checked(make_encoder, dim), return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
        vectors = texts.select("isbn", run("text").alias("embedding"))
    unit = l2_normalize(vectors, "embedding")
    return unit.withColumn("embedding", F.col("embedding").cast("array<float>"))


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))


def l2_normalize(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Unit length in double; a zero vector stays zero."""
    def divided(vector: Column) -> Column:
        return _let(_norm(vector), lambda norm: F.transform(
            vector, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm)))

    return df.withColumn(col, _let(F.col(col).cast("array<double>"), divided))


def dim_report(df: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    """One row: vectors, and how many are not ``dim`` long or lack a value."""
    wrong = F.coalesce((F.size(col) != dim) | F.exists(col, lambda x: x.isNull()), F.lit(True))
    return df.agg(F.count(F.lit(1)).alias("n_vectors"), F.count_if(wrong).alias("n_wrong_dim"))


def check_dim(df: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    """``df`` itself, after counting that every vector has ``dim`` values."""
    report = dim_report(df, dim, col).first()
    if report.n_wrong_dim:
        raise ValueError(
            f"{report.n_wrong_dim} of {report.n_vectors} vectors do not have {dim} values")
    return df


def _best_products(k: int, dim: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Best ``k`` items for each seed of one cell; a seed that lists ``open`` clusters meets only their items,
    and one with a ``least`` score only what reaches it.

    The returned function refers to nothing of this package, so the executors
    need only numpy and pyarrow.
    """
    schema = pa.schema([("seed_isbn", pa.string()), ("isbn", pa.string()), ("score", pa.float64())])
    seed_step, item_step = 256, 2048

    def matrix(table: pa.Table, col: str) -> np.ndarray:
        values = table.column(col).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        if len(values) != table.num_rows * dim:
            raise ValueError(f"a vector does not have {dim} values")
        return values.astype(np.float64).reshape(table.num_rows, dim)

    def first(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, seeds: int) -> tuple:
        """The first ``k`` of each row, by score, then by item."""
        order = np.lexsort((cols, -scores, rows))
        rows, cols, scores = rows[order], cols[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(seeds))[rows]
        return rows[place < k], cols[place < k], scores[place < k], place[place < k]

    def best(seeds: np.ndarray, items: np.ndarray, least: np.ndarray) -> tuple:
        """(row, item, score) for items in isbn order: what ties with the k-th of earlier ones is out, and only the few products
        that come near a bound are rounded and sorted."""
        least, tied_out = least.copy(), np.zeros(len(seeds), bool)
        rows, cols, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for start in range(0, len(items), item_step):
            block = seeds @ items[start:start + item_step].T
            near = least.copy()
            unbound = np.isneginf(least)
            if unbound.any() and block.shape[1] > k:
                near[unbound] = np.partition(block[unbound], block.shape[1] - k, axis=1)[:, block.shape[1] - k]
            bound = np.isfinite(near)
            near[bound] -= 1e-8 * (1.0 + np.abs(near[bound]))   # scores have nine decimals
            r, c = np.nonzero(block >= near[:, None])
            s = np.round(block[r, c], 9) + 0.0
            kept = np.where(tied_out[r], s > least[r], s >= least[r])
            rows, cols, scores, place = first(np.concatenate([rows, r[kept]]), np.concatenate([cols, c[kept] + start]),
                                              np.concatenate([scores, s[kept]]), len(seeds))
            full = place == k - 1
            least[rows[full]], tied_out[rows[full]] = scores[full], True
        return rows, cols, scores

    def run(seeds: pa.Table, items: pa.Table) -> pa.Table:
        if not seeds.num_rows or not items.num_rows:
            return schema.empty_table()
        items = items.sort_by("isbn")
        item_rows, seed_rows = matrix(items, "embedding"), matrix(seeds, "seed_embedding")
        least = np.full(len(seed_rows), -np.inf)
        if "least" in seeds.column_names:
            least = seeds.column("least").to_numpy()
        every = np.arange(len(seed_rows))
        meetings = [(every, np.arange(len(item_rows)))]
        if "open" in seeds.column_names:
            open_lists = seeds.column("open").combine_chunks()
            of_seed, cluster = np.repeat(every, open_lists.value_lengths().to_numpy()), open_lists.flatten().to_numpy()
            item_cluster = items.column("cluster").to_numpy()
            meetings = [(of_seed[cluster == c], np.flatnonzero(item_cluster == c)) for c in np.unique(item_cluster)]
        found = []
        for wanted, at in meetings:
            for start in range(0, len(wanted), seed_step):
                rows = wanted[start:start + seed_step]
                r, c, s = best(seed_rows[rows], item_rows[at], least[rows])
                found.append((rows[r], at[c], s))
        if not found:
            return schema.empty_table()
        rows, cols, scores, _ = first(*(np.concatenate(part) for part in zip(*found)), len(seed_rows))
        return pa.Table.from_arrays([
            seeds.column("seed_isbn").take(pa.array(rows)), items.column("isbn").take(pa.array(cols)), pa.array(scores),
        ], schema=schema)

    return run


def _nearest_pivot(pivots: np.ndarray, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to every vector its nearest pivot and the distance from it."""
    squares = (pivots * pivots).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dim)
            apart = squares - 2.0 * (x @ pivots.T)
            cluster = apart.argmin(axis=1)
            far = np.linalg.norm(x - pivots[cluster], axis=1)
            yield pa.RecordBatch.from_pydict({
                "isbn": batch.column("isbn"), "embedding": batch.column("embedding"),
                "cluster": cluster.astype(np.int32), "far": far})

    return run


def _open_bundles(pivots: np.ndarray, radius: np.ndarray, blocks: np.ndarray, bundles: np.ndarray,
                  dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(seed, bundle, open): the bundles with the clusters in them that can hold a vector whose product with the seed
    reaches ``least``, but not the block that the seed has met.

    A member x of a cluster around p has q.x = q.p + q.(x - p) <= q.p + |q| radius.
    """
    first_block = np.concatenate([[0], np.cumsum(blocks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column("seed_embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dim)
            least = batch.column("least").to_numpy(zero_copy_only=False)
            norm = np.linalg.norm(q, axis=1)[:, None]
            most = q @ pivots.T + norm * radius
            # room for the rounding of scores and of the sums here
            room = 1e-8 * (1.0 + norm * (np.linalg.norm(pivots, axis=1) + np.maximum(radius, 0.0)))
            rows, cluster = np.nonzero((most + room >= least[:, None]) & (radius >= 0.0))
            # every block of these clusters, numbered through
            many = blocks[cluster]
            rows, cluster = np.repeat(rows, many), np.repeat(cluster, many)
            block = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
            met = first_block[batch.column("cluster").to_numpy()] + batch.column("block").to_numpy()
            new = first_block[cluster] + block != met[rows]
            rows, cluster, bundle = rows[new], cluster[new], (bundles[cluster] + block)[new]
            # bundles rise with their clusters, so those of one bundle stand together
            starts = np.flatnonzero(np.diff(rows, prepend=-1) | np.diff(bundle, prepend=-1))
            taken = pa.array(rows[starts])
            yield pa.RecordBatch.from_pydict({
                "seed_isbn": batch.column("seed_isbn").take(taken), "seed_embedding": batch.column("seed_embedding").take(taken),
                "least": batch.column("least").take(taken), "bundle": pa.array(bundle[starts].astype(np.int32)),
                "open": pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)).astype(np.int32)),
                                                 pa.array(cluster.astype(np.int32)))})

    return run


def _products(left: DataFrame, right: DataFrame, cell: list[str], k: int, dim: int) -> DataFrame:
    """Best ``k`` of each cell's items for each of its seeds."""
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(
        _best_products(k, dim), "seed_isbn string, isbn string, score double")


def _hash_part(key: str, parts: Column | int) -> Column:
    return F.pmod(F.xxhash64(key), parts if isinstance(parts, Column) else F.lit(parts)).cast("int")


def _bundled(sizes: list[int], blocks: list[int], rows: int) -> list[int]:
    """The first bundle of each cluster: one for each block of a large cluster, a common one for small ones
    that follow each other and have at most ``rows`` members together."""
    first, at, room = [], -1, 0
    for n, cuts in zip(sizes, blocks, strict=True):
        if cuts > 1 or n > room:
            at, room = at + 1, rows
        first.append(at)
        at, room = (at + cuts - 1, 0) if cuts > 1 else (at, room - n)
    return first


@dataclass
class BlockReport:
    """How many (seed, block) products were made, of how many that there are."""
    compared: int
    possible: int


def knn(items: DataFrame, seeds: DataFrame, k: int,
        block_bytes: int = params.VECTOR_BLOCK_BYTES, pivots: int = params.VECTOR_PIVOTS,
        store: Store | None = None, reports: list[BlockReport] | None = None,
        task_bytes: int = params.VECTOR_BLOCK_BYTES) -> DataFrame:
    """Exact ``k`` nearest items of each seed by inner product, itself included.

    ``items``: (isbn, embedding); ``seeds``: (seed_isbn), those with a vector answer. Items without a vector
    are left out; vectors of unequal length are an error, counted before any work.

    Items that fit in one block of ``block_bytes`` meet all seeds as one matrix product per
    seed block. More of them are clustered around ``pivots`` items chosen by hash; a cluster of more than a block and more
    than ``task_bytes`` is cut into blocks, and small clusters share a bundle of up to as much:

    1. A seed meets the block that its own vector lies in: its k-th score there is a bound.
    2. A cluster whose product with the seed can't reach the bound (pivot's product + seed's
       length x cluster's radius) is skipped; the seed is sent once to each bundle that holds others, and meets these.

    Every product returns only its best ``k`` per seed, so no pair is a row before the cut. Pivots, radii and counts
    are a table of ``pivots`` rows, whatever the data. Without any cluster skipped, S seeds
    and N items move some 2 * S * N / B vectors for B rows to a bundle. ``reports`` gets what was compared, at the cost of a count.
    Returns seed_isbn, isbn, score (9 decimals), rank.
    """
    vectors = items.select("isbn", "embedding").filter(F.col("embedding").isNotNull())
    length = F.size("embedding")
    shape = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("dim"), F.count_if(F.exists(
        "embedding", lambda x: x.isNull())).alias("gaps"), F.min(length).alias("least")).first()
    dim = shape.dim or 1
    if shape.n and (shape.gaps or shape.least != dim):
        check_dim(vectors, dim)
    width = 4 if dict(vectors.dtypes)["embedding"] == "array<float>" else 8
    block_rows = max(1, block_bytes // (width * max(1, dim)))
    wanted = seeds.select("seed_isbn").distinct()
    order = [F.desc("score"), F.asc("isbn")]

    if shape.n <= block_rows:
        seed_vectors = vectors.select(
            F.col("isbn").alias("seed_isbn"), F.col("embedding").alias("seed_embedding")).join(wanted, "seed_isbn", "left_semi")
        parts = max(1, -(-shape.n // params.SEED_BLOCK_ROWS))
        left = seed_vectors.withColumn("part", _hash_part("seed_isbn", parts))
        right = vectors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return top_k(_products(left, right, ["part"], k, dim), ["seed_isbn"], order, k)

    store = store or Store(items.sparkSession)
    task_rows = max(block_rows, task_bytes // (width * max(1, dim)))
    chosen = vectors.orderBy(F.xxhash64("isbn"), "isbn").limit(max(1, pivots)).collect()
    centres = np.array([r.embedding for r in chosen], np.float64)
    schema = T.StructType([*vectors.select("isbn", "embedding").schema, T.StructField("cluster", T.IntegerType()),
                           T.StructField("far", T.DoubleType())])
    assigned = store.write(vectors.mapInArrow(_nearest_pivot(centres, dim), schema))
    clusters = {r.cluster: r for r in assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()}
    radius = np.array([clusters[c].radius if c in clusters else -1.0 for c in range(len(centres))])
    sizes = [clusters[c].n if c in clusters else 0 for c in range(len(centres))]
    blocks = [max(1, -(-n // task_rows)) for n in sizes]
    bundles = _bundled(sizes, blocks, task_rows)
    placed = assigned.select("isbn", "embedding", "cluster", _hash_part(
        "isbn", F.get(F.lit(blocks), F.col("cluster"))).alias("block"))
    asked = store.write(placed.join(wanted.withColumnRenamed("seed_isbn", "isbn"), "isbn", "left_semi").select(
        F.col("isbn").alias("seed_isbn"), F.col("embedding").alias("seed_embedding"), "cluster", "block"))
    n_seeds = asked.count()
    parts = max(1, -(-n_seeds // task_rows))

    near = store.write(_products(asked, placed, ["cluster", "block"], k, dim))
    least = near.groupBy("seed_isbn").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
    bounded = asked.join(least.drop("n"), "seed_isbn", "left").fillna(float("-inf"), subset=["least"])
    schema = T.StructType([f for f in bounded.schema if f.name not in ("cluster", "block")] + [
        T.StructField("bundle", T.IntegerType()), T.StructField("open", T.ArrayType(T.IntegerType()))])
    others = bounded.mapInArrow(_open_bundles(centres, radius, np.array(blocks), np.array(bundles), dim), schema)
    if reports is not None:
        others = store.write(others)
        met = others.agg(F.coalesce(F.sum(F.size("open")), F.lit(0))).first()[0]
        reports.append(BlockReport(n_seeds + met, n_seeds * sum(b for n, b in zip(sizes, blocks) if n)))
    in_bundle = placed.select("isbn", "embedding", "cluster", (F.get(F.lit(bundles), F.col("cluster")) + F.col("block")).alias("bundle"))
    left = others.withColumn("part", _hash_part("seed_isbn", parts))
    right = in_bundle.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return top_k(near.unionByName(_products(left, right, ["bundle", "part"], k, dim)), ["seed_isbn"], order, k)
