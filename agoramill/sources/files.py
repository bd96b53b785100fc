"""Readers and writers at the borders of the engine: CSV, JSON lines, Parquet, prompt files, secrets."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The schemas of the tables, as the formats of the files demand them.
RAW_FORUM = "user string, topic string, msg_id string, content string, date string, deleted boolean, banned boolean, topic_url string, profile_url string"
BENCHMARK = "content string, label int"
PREDICTIONS = "content string, label string"
RESPONSE = "custom_id string, error string, response struct<body:struct<choices:array<struct<message:struct<content:string>>>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>>>"
REQUEST = "custom_id string, method string, url string, body struct<model:string,messages:array<struct<role:string,content:string>>,max_tokens:int>"
# Texts that count as missing in a CSV file.
MISSING = ["", "NA", "N/A", "n/a", "nan", "NaN", "null", "NULL", "None"]


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, missing: bool = True) -> DataFrame:
    """UTF-8 with a header, doubled quotes and line ends inside quotes. Such files can't be split: convert them to
    Parquet once. Texts of ``MISSING`` become null."""
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    if missing:
        df = df.select(*[F.when(~F.col(c).isin(MISSING), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    return df


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with an explicit schema; a line that isn't JSON comes out with its text in _corrupt."""
    return spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_parquet(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A table, or one split of it; a table partitioned by split is pruned."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df


def read_words(spark: SparkSession, path: str, *more: DataFrame) -> DataFrame:
    """One word per line, lower-cased and distinct, together with other tables (word)."""
    df = spark.read.text(path).select(F.lower("value").alias("word"))
    for m in more:
        df = df.union(m.select(F.lower("word")))
    return df.where("word <> ''").distinct()


def read_prompt(path: str) -> str:
    p = Path(path)
    if not p.is_file():
        raise FileNotFoundError(f"no prompt file at {p}")
    return p.read_text(encoding="utf-8").strip()


def read_config(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def secret(spec: dict) -> str:
    """From the environment ({"type": "env", "name": ...}) or a file ({"type": "file", "path": ...}); never logged."""
    if spec.get("type") == "env":
        return os.environ[spec["name"]]
    return Path(spec["path"]).read_text(encoding="utf-8").strip()


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """UTF-8 with a header and doubled quotes; white space at the ends of a text is kept."""
    df.write.mode(mode).csv(path, header=True, escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_requests(df: DataFrame, path: str) -> None:
    """JSON lines of requests; the id column stays out."""
    df.select(F.to_json(F.struct("custom_id", "method", "url", "body")).alias("value")).write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Write ``df``, which may read ``path``, beside it and then put it in its place."""
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    jvm = spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(new), at(path))
    fs.delete(at(old), True)
    spark.catalog.refreshByPath(path)


def write_mappings(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/mapping_{name}")
