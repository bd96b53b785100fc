"""Metrics of predictions against truths, and the leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoramill.functions.verdicts import cleaned

METRICS = ["Precision_0", "Recall_0", "F1_0", "Precision_1", "Recall_1", "F1_1", "Accuracy", "ROC_AUC"]


def joined(truth: DataFrame, predictions: DataFrame, key: str = "content", target: str = "label", predicted: str = "label") -> DataFrame:
    """(target, prediction) of all pairs of equal texts; repeated texts fan out and null texts meet, as equals."""
    t = truth.select(F.col(key).alias("__t"), F.col(target).alias("target"))
    p = predictions.select(F.col(key).alias("__p"), F.col(predicted).alias("prediction"))
    return t.join(p, F.col("__t").eqNullSafe(F.col("__p"))).select("target", "prediction")


def pair_counts(truth: DataFrame, predictions: DataFrame, key: str = "content", target: str = "label", predicted: str = "label") -> DataFrame:
    """(target, prediction, n) of the same join without fanning out: both sides are counted per text first, so a text
    that holds a third of all rows joins as one row."""
    t = truth.groupBy(F.col(key).alias("__t"), F.col(target).alias("target")).agg(F.count("*").alias("a"))
    p = predictions.groupBy(F.col(key).alias("__p"), F.col(predicted).alias("prediction")).agg(F.count("*").alias("b"))
    return t.join(p, F.col("__t").eqNullSafe(F.col("__p"))).groupBy("target", "prediction").agg(F.sum(F.col("a") * F.col("b")).alias("n"))


def _over(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(counts: DataFrame) -> DataFrame:
    """tp, fp, tn, fn and n from (target, prediction, n); labels other than 0 and 1 count in n only."""
    t, p, n = F.col("target"), F.col("prediction"), F.col("n")
    of = lambda a, b: F.coalesce(F.sum(F.when((t == a) & (p == b), n)), F.lit(0))
    side = lambda c, v: F.coalesce(F.sum(F.when(c == v, n)), F.lit(0))
    return counts.agg(of(1, 1).alias("tp"), of(0, 1).alias("fp"), of(0, 0).alias("tn"), of(1, 0).alias("fn"), side(t, 0).alias("true_0"), side(t, 1).alias("true_1"), side(p, 0).alias("said_0"), side(p, 1).alias("said_1"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(t == p, n)), F.lit(0)).alias("same"))


def report(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of both classes and accuracy; a division by zero is 0."""
    c = confusion(counts)
    p0, r0, p1, r1 = _over(F.col("tn"), F.col("said_0")), _over(F.col("tn"), F.col("true_0")), _over(F.col("tp"), F.col("said_1")), _over(F.col("tp"), F.col("true_1"))
    x = c.select(p0.alias("Precision_0"), r0.alias("Recall_0"), p1.alias("Precision_1"), r1.alias("Recall_1"), _over(F.col("same"), F.col("n")).alias("Accuracy"))
    f = lambda k: _over(2 * F.col(f"Precision_{k}") * F.col(f"Recall_{k}"), F.col(f"Precision_{k}") + F.col(f"Recall_{k}"))
    return x.withColumn("F1_0", f(0)).withColumn("F1_1", f(1))


def auc(counts: DataFrame) -> DataFrame:
    """ROC_AUC of any scores by mid-ranks (Mann-Whitney); 0 if the targets hold only one class.

    ``counts`` (target, prediction, n) are first summed per score. Of few scores (labels) the window is small; of many,
    the cumulative counts come from a range-sorted order with prefix sums.
    """
    per = counts.where("target IN (0, 1) AND prediction IS NOT NULL").groupBy(F.col("prediction").cast("double").alias("s")).agg(F.sum(F.when(F.col("target") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("target") == 0, F.col("n")).otherwise(0)).alias("q"))
    below = _cumulative(per)
    s = below.agg(F.coalesce(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)), F.lit(0.0)).alias("u"), F.coalesce(F.sum("p"), F.lit(0)).alias("n1"), F.coalesce(F.sum("q"), F.lit(0)).alias("n0"))
    return s.select(_over(F.col("u"), F.col("n1") * F.col("n0")).alias("ROC_AUC"))


def _cumulative(per: DataFrame) -> DataFrame:
    """Negatives with a smaller score, by a range sort: windows within partitions plus the sums of the partitions before."""
    from pyspark.sql import Window

    from agoramill.runtime import stage

    parts = max(int(per.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = stage(per.repartitionByRange(parts, "s").withColumn("part", F.spark_partition_id()), "scores")
    at, offsets = 0, []
    for p, q in sorted((r[0], r[1]) for r in placed.groupBy("part").agg(F.sum("q")).collect()):  # one row per partition
        offsets.append((p, at))
        at += q
    w = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(per.sparkSession.createDataFrame(offsets, "part int, o bigint")), "part").withColumn("below", F.col("o") + F.coalesce(F.sum("q").over(w), F.lit(0)))


def leaderboard_row(counts: DataFrame, model: str) -> DataFrame:
    key = F.lit(model).alias("Model")
    return report(counts).select(key, "*").join(F.broadcast(auc(counts).select(key, "ROC_AUC")), "Model").select("Model", *METRICS)  # two tables of one row


def upserted(board: DataFrame, row: DataFrame, key: str = "Model") -> DataFrame:
    """The board with the row in place of any of the same model."""
    return board.join(row.select(key), key, "left_anti").unionByName(row, allowMissingColumns=True)


def evaluated(truth: DataFrame, predictions: DataFrame, model: str, board: DataFrame | None = None, key: str = "content") -> DataFrame:
    """From raw predictions to the board: both label columns cleaned by their type, joined on the text, reported, and
    the model's row put in place of any it had. No common text gives the board as it was.

    A label that is missing (null, NaN, a failed request's null) is no prediction and drops out; "Error" and other texts
    that are no yes count as 0, and -1 counts in accuracy only.
    """
    t = truth.select(F.col(key).alias("content"), cleaned(truth, "label").alias("label")).where("label IS NOT NULL")
    p = predictions.select("content", cleaned(predictions, "label").alias("label")).where("label IS NOT NULL")
    counts = pair_counts(t, p)
    row = leaderboard_row(counts, model)
    some = counts.agg(F.count("*").alias("__n")).where("__n > 0").select(F.lit(model).alias("Model"))  # one row or none
    row = row.join(F.broadcast(some), "Model", "left_semi")
    if board is None:
        return row
    return board.join(row.select("Model"), "Model", "left_anti").unionByName(row, allowMissingColumns=True)


def f1(counts: DataFrame) -> DataFrame:
    """F1 of class 1 of argmax predictions, the metric of the encoder's training."""
    return report(counts).select(F.col("F1_1").alias("f1"))
