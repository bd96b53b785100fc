"""Responses of running batches as a stream of JSON lines, applied to the checkpoint table as they land.

An extension: the raw files stay in the landing folder; a micro-batch is merged once, by id, so a replay changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoramill.operators.annotate import answers, merged
from agoramill.sources.files import RESPONSE, replace_table


def landed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(RESPONSE).json(folder)


def apply_all(spark: SparkSession, folder: str, checkpoint: str, step: str, state: str) -> int:
    """Merge every response that has landed since the last call into the Parquet table ``checkpoint``; returns the micro-batches."""
    done = []

    def one(batch: DataFrame, number: int) -> None:
        got = answers(batch, step).groupBy("msg_id").agg(F.max("answer").alias("answer"))
        replace_table(merged(spark.read.parquet(checkpoint), got, step), checkpoint)
        done.append(number)

    query = landed(spark, folder).writeStream.foreachBatch(one).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)
