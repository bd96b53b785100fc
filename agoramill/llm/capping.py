"""Problem 6: cap the records of dominant contributors, keeping the best-scored ones.

Method: accounts above the cap are found by a partial aggregation; their messages are range-sorted by (account, score
descending, id). The rows of each sorted partition are counted, the prefix sums of these counts give every row its exact
global position, and the position less the account's first position is its rank.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoramill.runtime import stage


def account(c: Column) -> Column:
    """``c`` without outer white space, in lower case; a blank one is null."""
    a = F.lower(F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    return F.when(a != "", a)


def messages(df: DataFrame, key: str = "msg_id", contributor: str = "user", score: str = "priority_weight") -> DataFrame:
    """One row per key: its account (the smallest, if copies differ) and its score (the highest; NaN counts as null)."""
    w = F.col(score).cast("double")
    return df.groupBy(F.col(key).alias("__id")).agg(F.min(account(F.col(contributor))).alias("__account"), F.max(F.when(~F.isnan(w), w)).alias("__score"))


def ranked_over_cap(df: DataFrame, cap: int | None = None, share: float | None = 0.01, key: str = "msg_id", contributor: str = "user", score: str = "priority_weight") -> tuple[DataFrame, int]:
    """Messages of every contributor with more than the cap, with their rank (1 is best), and the cap.

    The cap is ``cap`` records, or ``share`` of the distinct keys rounded up. With a share s fewer than 1/s accounts
    can be above it, which bounds the broadcast list of accounts. Null keys are no messages; null or blank
    contributors are nobody and never capped; null and NaN scores come last; ties go to the smaller key; copies of a
    key count once; an empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    spark = df.sparkSession
    one = stage(messages(df.where(F.col(key).isNotNull()), key, contributor, score), "messages")
    total = one.count()
    if cap is None:
        cap = math.ceil(round(total * share, 9))
    counts = one.where(F.col("__account").isNotNull()).groupBy("__account").count().where(F.col("count") > cap)
    bounded = total / max(cap, 1) <= 100_000  # accounts above the cap; beyond, the join shuffles
    over = counts.select("__account")
    rows = one.join(F.broadcast(over) if bounded else over, "__account", "left_semi")
    order = [F.col("__account"), F.col("__score").desc_nulls_last(), F.col("__id")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = stage(sorted_rows.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1)), "ranked")
    sizes = {r[0]: r[1] for r in placed.groupBy("__part").count().collect()}  # one row per partition
    offset, at = {}, 0
    for p in sorted(sizes):
        offset[p], at = at, at + sizes[p]
    offsets = F.broadcast(spark.createDataFrame([(p, o) for p, o in offset.items()], "__part int, __offset bigint"))
    positions = placed.join(offsets, "__part").withColumn("__pos", F.col("__at") + F.col("__offset"))
    starts = positions.groupBy("__account").agg(F.min("__pos").alias("__start"))
    ranked = positions.join(F.broadcast(starts) if bounded else starts, "__account")
    return ranked.select(F.col("__id").alias(key), F.col("__account").alias("account"), F.col("__score").alias("score"), (F.col("__pos") - F.col("__start") + 1).alias("rank")), cap


def left_out(df: DataFrame, **kw) -> DataFrame:
    """The keys to leave out: those of rank above the cap."""
    ranked, cap = ranked_over_cap(df, **kw)
    return ranked.where(F.col("rank") > cap)


def capped(df: DataFrame, key: str = "msg_id", **kw) -> DataFrame:
    """``df`` without the rows of the keys to leave out."""
    return df.join(left_out(df, key=key, **kw).select(key), key, "left_anti")


def p6_found(spark, sf_dir):
    return left_out(spark.read.parquet(f"{sf_dir}/anonymous_forum_prioritized.parquet")).select("msg_id")


def p6_kept(spark, sf_dir):
    """The number of messages each capped account keeps and loses."""
    ranked, cap = ranked_over_cap(spark.read.parquet(f"{sf_dir}/anonymous_forum_prioritized.parquet"))
    return ranked.groupBy("account").agg(F.count("*").alias("n_messages"), F.sum((F.col("rank") <= cap).cast("bigint")).alias("n_kept"))


QUERIES = {"p6_found": p6_found, "p6_kept": p6_kept}

_RANKED = """
WITH m AS (SELECT msg_id, min(nullif(lower(trim(user)), '')) AS account, max(CASE WHEN isnan(priority_weight) THEN NULL ELSE priority_weight END) AS w
           FROM anonymous_forum_prioritized WHERE msg_id IS NOT NULL GROUP BY msg_id),
r AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY w DESC NULLS LAST, msg_id) AS k, count(*) OVER (PARTITION BY account) AS n FROM m WHERE account IS NOT NULL),
c AS (SELECT CAST(ceil(count(*) / 100.0) AS BIGINT) AS cap FROM m)
"""
ORACLE = {
    "p6_found": _RANKED + "SELECT msg_id FROM r, c WHERE k > cap",
    "p6_kept": _RANKED + "SELECT account, count(*) AS n_messages, CAST(sum(CASE WHEN k <= cap THEN 1 ELSE 0 END) AS BIGINT) AS n_kept FROM r, c WHERE n > cap GROUP BY account",
}
