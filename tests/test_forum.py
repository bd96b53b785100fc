"""Aliases, scrubbing, cleaning, weights and ranks."""

import hashlib
import math

from pyspark.sql import functions as F

from agoramill.operators import forum

RAW = "user string, topic string, msg_id string, content string, date string, deleted boolean, banned boolean, topic_url string, profile_url string"


def raw(spark):
    rows = [
        ("Zorglub_9", "t", "1", "bonjour à tous les amis ici", "2024-01-02 03:04:05", True, False, "u", "p"),
        ("Soleil", None, "2", "merci zorglub_9 pour ton aide précieuse", "03/02/2024 10:00:00", False, True, "u", "p"),
        (None, "t", "3", None, "5 mars 2024 à 23:00:00", False, False, None, None),
        ("Zorglub_9", "t", "4", "zorglub_99 et zorglub_9é ce n'est pas lui", "hier", None, False, "u", "p"),
    ]
    return spark.createDataFrame(rows, RAW), spark.createDataFrame([("soleil",), ("SOLEIL",), (None,)], "word string")


def test_anonymized(spark):
    df, words = raw(spark)
    got = {r.content: r for r in forum.anonymized(df, words).collect()}
    h = lambda s, n: hashlib.sha256(s.encode()).hexdigest()[:n]
    first = got["bonjour à tous les amis ici"]
    assert first.user == "anon_user_" + h("Zorglub_9", 10) and first.topic == "anon_topic_" + h("t", 8) and first.msg_id == "anon_msg_" + h("1", 12) and first.hour == 3
    assert got["merci zorglub_9 pour ton aide précieuse"].user == "frenchword_" + h("Soleil", 10)
    assert got[None].user is None and got[None].hour == 23
    assert [r.hour for r in got.values() if r.content and "99" in r.content] == [None]
    assert "date" not in first.asDict() and "topic_url" not in first.asDict()


def test_scrubbed_boundaries(spark):
    df, _ = raw(spark)
    names = spark.createDataFrame([("Zorglub_9",), ("",), (None,), ("tous les",)], "name string")
    left = {r.msg_id for r in forum.scrubbed(df, names).collect()}
    # an accented letter is a boundary, a digit is not; names of several words count; null contents stay
    assert left == {"3"}
    assert {r.msg_id for r in forum.scrubbed(df, names.where("name = 'tous les'")).collect()} == {"2", "3", "4"}
    assert forum.scrubbed(df.limit(0), names).count() == 0


def test_weights_and_ranks(spark):
    df = spark.createDataFrame([("a", 6, True, True), ("b", 6, False, False), ("c", None, False, False), ("d", 8, None, False)], "msg_id string, hour tinyint, banned boolean, deleted boolean")
    w = {r.msg_id: r.priority_weight for r in forum.weighted(df).collect()}
    assert w["b"] == 0.5 and w["a"] == 0.5 * 44 and w["c"] is None and w["d"] is None
    ranked = {r.msg_id: r.priority_rank for r in forum.prioritized(forum.weighted(df)).collect()}
    assert sorted(ranked.values()) == [1, 2, 3, 4] and {ranked["c"], ranked["d"]} == {3, 4}


def test_rank_law_and_partitions(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("msg_id"), F.when(F.col("id") < 200, 10.0).otherwise(1.0).alias("priority_weight"))
    one = {r.msg_id: r.priority_rank for r in forum.prioritized(df.coalesce(1)).collect()}
    assert one == {r.msg_id: r.priority_rank for r in forum.prioritized(df.repartition(7)).collect()}
    heavy = sum(one[str(i)] for i in range(200)) / 200
    assert heavy < 500 < sum(one.values()) / 2000


def test_reports(spark):
    df, _ = raw(spark)
    rep = {r.step: r for r in forum.cleaning_report(df).collect()}
    assert rep["length"].n_before == 4 and rep["length"].n_after == 3 and rep["sensitive"].n_removed == 0
    assert forum.inspected(df).first().n_users == 2
    empty = {r.step: r.share_removed for r in forum.cleaning_report(df.limit(0)).collect()}
    assert empty["length"] == 0.0


def test_monthly(spark):
    df = spark.sql("SELECT explode(array(timestamp_ntz'2024-01-31 10:00:00', timestamp_ntz'2024-04-01 00:00:00', timestamp_ntz'2024-04-02 00:00:00', null)) AS ts")
    assert [(str(r[0]), r[1]) for r in forum.monthly(df, "ts").orderBy("month").collect()] == [("2024-01-01", 1), ("2024-02-01", 0), ("2024-03-01", 0), ("2024-04-01", 2)]
    assert forum.monthly(df.limit(0), "ts").count() == 0


def test_gaussian(spark):
    got = spark.range(24).select(forum.gaussian(F.col("id"))).collect()
    assert all(math.isclose(r[0], math.exp(-((h - 6) ** 2) / 12.5)) for h, r in enumerate(got))


def test_mentions_by_runs_of_words(spark):
    names = spark.createDataFrame([("jean",), ("jean_paul",), ("le grand chef",), ("a.b",), ("élan",), ("x\\Ey",), ("!!",), (None,)], "name string")
    texts = ["salut Jean !", "jean_paul dit", "c'est LE GRAND CHEF ici", "le grand, chef", "vu a.b hier", "vu a b hier", "un élan.", "tape x\\Ey là", "jeannot", None, "", "le " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, content string")
    assert {r.k for r in forum.mentioning(df, names, "k").collect()} == {0, 1, 2, 4, 6, 7}
    assert forum.mentioning(df, names.limit(0), "k").count() == 0
