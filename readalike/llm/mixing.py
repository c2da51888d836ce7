"""Mixing sources to target weights.

Words are summed per source, the mix's words are shared among the sources by
weight, a source's repetition rate is its target over its words, and each
document is taken floor(rate) times plus once more with probability equal to
the rest, decided by a seeded hash of its id.

The sums combine before the shuffle, so a source that holds a third of all rows
sends one row per task. The table of sources is written once: its size is then
known, Spark broadcasts it if it is small, and otherwise joins two scans, which
adaptive execution splits where a source is hot.

Defined cases: a null text has size 0; a null source is a source of its own and
comes last; rows that repeat an id are decided alike, each for itself; a null id
has the hash of an empty id; a source without words has target 0 and rate 0; an
empty table gives an empty result. The input's other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readalike.sources.store import Store

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)    # of the sources in order, again and again
SHARE = 1.5            # words of the mix over words of the input
CAP = 2.0              # a source's target over its own words, at most
SEED = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(doc_id: Column, seed: int = SEED) -> Column:
    """Number in [0, 1) from the seed and the id: the first 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed} "), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, store: Store, weights: tuple[int, ...] = WEIGHTS,
                   share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source its words, target and rate; ``sizes`` has (source, size).

    Targets are in proportion to the weights, up to the cap; what a capped source
    leaves is shared again among the others. A source is capped exactly if its
    cap over its weight lies below the common level, so the level follows from
    running sums in the order of that quotient. There is one row per source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    named = total.select("source", "source_size", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")).alias("weight"))
    quotient = F.col("source_size") * cap / F.col("weight")
    rising = Window.orderBy(quotient, F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(quotient).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(everything) - F.coalesce(
        cap * F.sum("source_size").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(before), F.lit(0.0))
    levels = named.withColumn("level", left / weight_left).withColumn("quotient", quotient)
    # The level falls to its final value at the first source that stays under its cap.
    final = F.min(F.when(F.col("level") < F.col("quotient"),
                         F.struct("quotient", "level"))).over(everything)["level"]
    target = F.least(F.col("source_size") * cap,
                     F.coalesce(F.col("weight") * final, F.col("source_size") * cap))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return store.write(levels.withColumn("target", target).withColumn("rate", rate).select(
        "source", "source_size", "weight", "target", "rate"))


def copies(rate: Column, doc_id: Column, seed: int = SEED) -> Column:
    """How often a document is taken."""
    whole = F.floor(rate)
    return (whole + (unit_hash(doc_id, seed) < rate - whole).cast("long")).cast("int")


def mixing_plan(docs: DataFrame, store: Store, seed: int = SEED) -> DataFrame:
    """Per document row: doc_id, size, source_size, target, n_copies."""
    sizes = store.write(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = source_targets(sizes, store)
    joined = sizes.alias("d").join(targets.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    return joined.select("d.doc_id", "d.size", "s.source_size", "s.target",
                         copies(F.col("s.rate"), F.col("d.doc_id"), seed).alias("n_copies"))


def mix(docs: DataFrame, store: Store, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, columns unchanged."""
    targets = source_targets(
        docs.select("source", word_count(F.col("text")).alias("size")), store)
    rate, copy = free_names(docs, "rate", "copy")
    rates = targets.select(F.struct("source", "rate").alias(rate))
    taken = docs.join(rates, docs["source"].eqNullSafe(F.col(f"{rate}.source")))
    taken_times = copies(F.col(f"{rate}.rate"), docs["doc_id"], seed)
    return taken.select(*[docs[quoted(c)] for c in docs.columns],
                        F.explode(F.array_repeat(F.lit(True), taken_times)).alias(copy)).drop(copy)


def quoted(name: str) -> str:
    """A column's name as it is, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (name + "_" * k for k in range(len(taken) + 1)) if n not in taken) for name in names]
