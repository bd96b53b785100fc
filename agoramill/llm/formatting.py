"""Problem 5: collapse records that differ only in white space, case, punctuation or field order.

Method: progressive partition refinement. Every row gets cheap invariants inside the JVM (number of letters and digits,
a histogram of ASCII letters) that no change of layout alters. Only rows whose class of equal invariants holds several
ids go on to the costlier keys (composed, lower-cased letters and digits in order; sorted fields of labelled contents).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoramill.runtime import release, salted_join, stage

_HISTOGRAM = ["e", "a", "s", "i", "n", "t", "r", "u", "l", "o", "0123456789"]
_OTHER = regex.compile(r"[^\p{L}\p{N}]+")
_LABEL = r"[\p{L}\p{N}][\p{L}\p{N}\p{M} '’_\-]{0,200}\s*[:=]"
_SPLIT = regex.compile(rf"[^\p{{L}}\p{{N}}\p{{M}}:=]+(?={_LABEL})")
_FIELD = regex.compile(rf"\s*({_LABEL})(.*)", regex.S)


def letters_key(text: str) -> str:
    """Letters and digits of ``text`` in order, composed and in lower case."""
    return _OTHER.sub("", unicodedata.normalize("NFC", text).lower().replace("ß", "ss").replace("ς", "σ"))


def fields_key(text: str) -> str | None:
    """The sorted fields of a content made only of two or more labelled fields, else null."""
    if text.count(":") + text.count("=") < 2:
        return None
    pieces = [p for p in _SPLIT.split(unicodedata.normalize("NFC", text)) if _OTHER.sub("", p)]
    if len(pieces) < 2:
        return None
    fields = []
    for p in pieces:
        m = _FIELD.fullmatch(p)
        if not m or not _OTHER.sub("", m[2]):
            return None
        fields.append(letters_key(p))
    return "\x1f".join(sorted(fields))


def _keys(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"lk": text.map(letters_key), "fk": text.map(fields_key)})


def invariants(c: Column) -> Column:
    """A hash of the number of letters and digits and of the histogram; equal for all layouts of a content.

    Conjoining and composed Hangul, whose number of letters depends on composition, is left out of the count.
    """
    low = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    size = F.length(F.regexp_replace(low, r"[^\p{L}\p{N}]+|[ᄀ-ᇿ가-힣]+", ""))
    plain = F.regexp_replace(F.regexp_replace(low, r"\p{L}\p{M}+", ""), "[^a-z0-9]+", "")
    return F.xxhash64(size, *[F.length(F.regexp_replace(plain, f"[^{x}]+", "")) for x in _HISTOGRAM])


def _by_field(now: DataFrame) -> DataFrame:
    return now.join(now.groupBy("fk").agg(F.min("g").alias("__g")), "fk").groupBy("lk").agg(F.min("__g").alias("g"))


def _merged(labelled: DataFrame) -> DataFrame:
    """(lk, g): letter keys that share a field key, directly or through others, get the same g."""
    now = stage(labelled.groupBy("lk", "fk").agg(F.min("lk").alias("g")), "labels")
    if now.groupBy("lk").count().where("count > 1").limit(1).count() == 0:  # every letter key has one field key
        return _by_field(now)
    while True:
        by_field = now.groupBy("fk").agg(F.min("g").alias("__g"))
        nxt = now.join(by_field, "fk").groupBy("lk").agg(F.min("__g").alias("__g"))
        new = stage(now.join(nxt, "lk").select("lk", "fk", F.least("g", "__g").alias("g"), (F.col("__g") < F.col("g")).alias("changed")), "labels")
        changed = new.where("changed").limit(1).count() > 0
        release(now)
        now = new.drop("changed")
        if not changed:
            return now.groupBy("lk").agg(F.min("g").alias("g"))


def copies(df: DataFrame, key: str = "msg_id", text: str = "content") -> DataFrame:
    """(first, copy): for every id of a group of equal contents but its smallest, the smallest and the id.

    Rows with a null id or content, and contents without a letter or digit, belong to no group. Rows delivered twice
    under one id are one record. A label has at most 201 characters; what is longer is no label. An id whose rows differ in content is in the group of each. No rows, no result.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"), invariants(F.col(text)).alias("inv"))
    classes = stage(rows.groupBy("inv").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("inv", "n"), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    keys = F.pandas_udf(_keys, "lk string, fk string")
    kept = salted_join(rows, classes, "inv", "n", total, F.col("id")).withColumn("k", keys("text")).where(F.col("k.lk") != "")
    hashed = stage(kept.select("id", F.md5("k.lk").alias("lk"), F.md5("k.fk").alias("fk")).distinct(), "keys")
    cells = hashed.groupBy("lk", "fk").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    same = _merged(cells.where(F.col("fk").isNotNull()))
    per_key = cells.groupBy("lk").agg(F.min("first").alias("first"), F.sum("n").alias("n")).join(same, "lk", "left").withColumn("g", F.coalesce("g", "lk"))
    per_key = stage(per_key, "groups")
    groups = per_key.groupBy("g").agg(F.min("first").alias("first"), F.sum("n").alias("m")).where("m > 1")
    lookup = per_key.select("lk", "g", "n").join(groups.select("g", "first"), "g").select("lk", "first", "n")
    size = per_key.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return salted_join(hashed.select("id", "lk"), lookup, "lk", "n", size, F.col("id")).where("id <> first").select("first", F.col("id").alias("copy")).distinct()


def collapsed(df: DataFrame, key: str = "msg_id", text: str = "content") -> DataFrame:
    """One record per group with its number of copies (distinct ids, itself included); null ids are left out."""
    pairs = stage(copies(df, key, text), "copies")
    n = pairs.groupBy("first").agg(F.count("*").alias("n")).withColumnRenamed("first", key)
    cols = [c for c in df.columns if c != key]
    # of rows delivered under one id with different values the first by their text form, so that every run keeps the same
    order = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("__row"))
    one = first.select(key, "__row.*").join(pairs.select(F.col("copy").alias(key)).distinct(), key, "left_anti")
    return one.join(n, key, "left").withColumn("n_copies", F.coalesce(F.col("n"), F.lit(0)) + 1).drop("n")


def p5_found(spark, sf_dir):
    return copies(spark.read.parquet(f"{sf_dir}/anonymous_forum_filtered.parquet")).select(F.col("first").alias("msg_id_first"), F.col("copy").alias("msg_id_copy"))


def p5_collapsed(spark, sf_dir):
    return collapsed(spark.read.parquet(f"{sf_dir}/anonymous_forum_filtered.parquet")).select("msg_id", "n_copies")


QUERIES = {"p5_found": p5_found, "p5_collapsed": p5_collapsed}
