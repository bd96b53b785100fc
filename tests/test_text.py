"""Unicode edge cases of the text expressions and cleaning patterns."""

import re

from pyspark.sql import functions as F

from agoramill.functions import verdicts as v
from agoramill.functions.patterns import CLEANING, matches, sensitive
from agoramill.functions.text import fold, strip, word_count

EDGES = ["", None, "a b\x1cc", "  x y　z ", "@é", "u/é", "é@à.b", "é1234567", "http:// x", "٠٦ ٣٩٩ ٨٨٧٦", "NA", 'un "mot"\ncité', "12.34.56.78", "\x85x ", "a" * 5000 + " " + "b" * 5000]


def test_word_count_is_pythons_split(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(EDGES)], "i int, s string")
    got = {r.i: r.n for r in df.select("i", word_count(F.col("s")).alias("n")).collect()}
    assert got == {i: len(str(s if s is not None else "nan").split()) for i, s in enumerate(EDGES)}


def test_strip_is_pythons(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(EDGES)], "i int, s string")
    got = {r.i: r.n for r in df.select("i", strip(F.col("s")).alias("n")).collect()}
    assert got == {i: s if s is None else s.strip() for i, s in enumerate(EDGES)}


def test_patterns_are_pythons(spark):
    texts = [s for s in EDGES if s is not None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    for name, p in CLEANING.items():
        got = {r.i: r.m for r in df.select("i", matches(F.col("s"), name).alias("m")).collect()}
        assert got == {i: bool(re.search(p.replace(r"\x1c-\x1f", ""), s, re.I)) for i, s in enumerate(texts)}, name
    assert df.where(sensitive(F.lit(None).cast("string"))).count() == 0


def test_fold(spark):
    row = spark.createDataFrame([("ÉLÈVE Cœur é z​z",)], "s string").select(fold(F.col("s"))).first()
    assert row[0] == "eleve coeur e zz"


def test_verdicts(spark):
    rows = [("C'est NON-TOXIQUE.", "0"), ("toxique", "1"), (" ? ", "?")]
    df = spark.createDataFrame(rows, "s string, w string")
    assert all(r.g == r.w for r in df.select("w", v.by_substring(F.col("s")).alias("g")).collect())
    out = spark.createDataFrame([("oui <|im_end|>",), ("... non<|im_end|>",), ("oui",), (None,)], "s string").select(v.by_pattern(F.col("s"))).collect()
    assert [r[0] for r in out] == [1, 0, -1, -1]
    labels = spark.createDataFrame([("oui",), ("Toxic",), ("toxique",), ("1.0",), (" 1 ",), (None,)], "s string").select(v.clean_label(F.col("s"))).collect()
    assert [r[0] for r in labels] == [1, 1, 0, 0, 1, None]
    tail = spark.createDataFrame([("toxique Ce message est-il toxique ? assistant non-toxique",), ("Ce message est-il toxique ? rien",)], "s string")
    assert [r[0] for r in tail.select(v.by_tail(F.col("s"))).collect()] == [0, 0]
    assert [r[0] for r in tail.select(v.by_tail(F.col("s"), default=1)).collect()] == [0, 1]


def test_harm_labels(spark):
    df = spark.createDataFrame([({"Toxicity": 2.5},), ({"Violence": 1.5, "Toxicity": 1.0},), ({"Toxicity": 2.0, "Insult": 1.0},), ({},)], "m map<string,double>")
    assert [r[0] for r in df.select(v.harm_label(F.col("m"))).collect()] == [1, 1, 0, 0]
    assert v.retry_delay(3) == 16 and v.retry_delay(2, 3, "power", 0.5) == 9.5 and v.retry_delay(1, kind="limit", jitter=1) == 8
