"""Seeded shuffles, samples and class balancing. The seed and a row key decide, never the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoramill.operators.forum import positions


def order_key(key: str, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``df`` with shuffle_rank, its place in a uniform permutation."""
    return positions(df.withColumn("__k", order_key(key, seed)), [F.col("__k"), F.col(key)], "shuffle_rank").drop("__k")


def sampled(df: DataFrame, key: str, n: int | None, seed: int = 42) -> DataFrame:
    """``n`` rows by the seeded order (all, if n is null or 0): a top-k, not a sort."""
    return df.orderBy(order_key(key, seed), key).limit(n) if n else df


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Classes ascending with their counts and the largest and smallest count; there are few classes."""
    c = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))
    return c.withColumn("n_max", F.max("n").over(every)).withColumn("n_min", F.min("n").over(every))


def _ranked(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Rank within the class, from global positions in the order (class, hash): no task holds a whole class."""
    counts = class_counts(df, label).withColumn("__start", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("label").rowsBetween(Window.unboundedPreceding, -1)))
    placed = positions(df.where(F.col(label).isNotNull()).withColumn("__k", order_key(key, seed)), [F.col(label), F.col("__k"), F.col(key)], "__pos").drop("__k")
    return placed.join(F.broadcast(counts), placed[label] == counts["label"]).drop(counts["label"]).withColumn("__rn", F.col("__pos") - F.coalesce("__start", F.lit(0))).drop("__pos", "__start")


def undersampled(df: DataFrame, label: str, key: str, seed: int = 42, cap: int | None = None) -> DataFrame:
    """Each class cut to the smallest class (and the cap)."""
    least = F.least("n_min", F.lit(cap)) if cap else F.col("n_min")
    return _ranked(df, label, key, seed).where(F.col("__rn") <= least).drop("__rn", "n", "n_max", "n_min")


def oversampled(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Each class repeated up to the largest: every row q times, the first r rows of the seeded order once more. copy counts from 1."""
    times = F.floor(F.col("n_max") / F.col("n")) + F.when(F.col("__rn") <= F.col("n_max") % F.col("n"), 1).otherwise(0)
    return _ranked(df, label, key, seed).withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop("__rn", "n", "n_max", "n_min")


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the order given."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def batches(df: DataFrame, rank: str, size: int) -> DataFrame:
    return df.withColumn("batch", F.floor((F.col(rank) - 1) / size))
