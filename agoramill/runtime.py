"""Session, shared staging and skew helpers used by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "agoramill", cores: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster the submitter's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Only a local session without one gets its own."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="agoramill-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._agoramill_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete a table that ``stage`` wrote and that nothing needs any more."""
    path = getattr(df, "_agoramill_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, spread: Column, how: str = "inner", salts: int = 48, share: int = 1000) -> DataFrame:
    """Equi-join of ``left`` with ``right`` (unique in ``key``) in which no key lands in one task.

    ``right[weight]`` counts the left rows of the key and ``total`` all of them. A key with more than ``total / share``
    rows is hot; there are fewer than ``share`` such keys, so their list (keys only) is broadcast. Left rows of hot keys
    get a salt from ``spread`` (any column that varies within a key) and the right row of a hot key is repeated per salt.
    ``weight`` is dropped.
    """
    limit = max(10_000, total // share)
    hot = right.where(F.col(weight) > limit).select(F.col(key).alias("__hot"))
    at = F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    a = left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", at).drop("__hot")
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(F.col(weight) > limit, salts - 1).otherwise(0)))).withColumn("__salt", F.col("__salt").cast("int")).drop(weight)
    return a.join(b, [key, "__salt"], how).drop("__salt")
