"""Files: quoted line ends, missing texts, JSON lines, staged replacement, the response stream, the driver's contract."""

from pyspark.sql import functions as F

from agoramill.operators import annotate
from agoramill.sources import files
from agoramill.streaming import responses


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('content,label\n"un ""mot""\ncité",1\nNA,0\n,\n', encoding="utf-8")
    rows = files.read_csv(spark, str(p), files.BENCHMARK).collect()
    assert [tuple(r) for r in rows] == [('un "mot"\ncité', 1), (None, 0), (None, None)]
    empty = tmp_path / "b.csv"
    empty.write_text("content,label\n")
    assert files.read_csv(spark, str(empty), files.BENCHMARK).count() == 0


def test_csv_round_trip_keeps_blanks(spark, tmp_path):
    texts = [" un ", "\nligne\n", 'a "b"', "c,d", "\\x", "é"]
    df = spark.createDataFrame([(t, str(i).zfill(3)) for i, t in enumerate(texts)], "content string, label string")
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"), files.PREDICTIONS).collect()
    assert sorted((r.label, r.content) for r in back) == [(str(i).zfill(3), t) for i, t in enumerate(texts)]


def test_split_scan_is_pruned(spark, tmp_path):
    spark.createDataFrame([(1, "train"), (2, "test")], "i int, split string").write.partitionBy("split").parquet(str(tmp_path / "s"))
    df = files.read_parquet(spark, str(tmp_path / "s"), "test")
    assert [r.i for r in df.collect()] == [2] and len(df.inputFiles()) >= 1


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"output": "x.csv"}}')
    (tmp_path / "k").write_text(" s\n")
    assert files.read_config(str(tmp_path / "c.json"))["a"]["output"] == "x.csv" and files.secret({"type": "file", "path": str(tmp_path / "k")}) == "s"


def test_words_prompts_and_secrets(spark, tmp_path, monkeypatch):
    (tmp_path / "w.txt").write_text("Un\nun\ndeux\n\n")
    assert {r.word for r in files.read_words(spark, str(tmp_path / "w.txt"), spark.createDataFrame([("TROIS",)], "word string")).collect()} == {"un", "deux", "trois"}
    (tmp_path / "p.txt").write_text(" bonjour \n")
    assert files.read_prompt(str(tmp_path / "p.txt")) == "bonjour"
    monkeypatch.setenv("A_KEY", "k")
    assert files.secret({"type": "env", "name": "A_KEY"}) == "k"


def test_replace_table_reads_its_own_path(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    files.replace_table(spark.read.parquet(path).where("id > 2"), path)
    assert spark.read.parquet(path).count() == 2


def test_stream_is_idempotent(spark, tmp_path):
    ck, land, state = str(tmp_path / "ck"), tmp_path / "land", str(tmp_path / "state")
    land.mkdir()
    annotate.with_step(spark.createDataFrame([("1", "a"), ("2", "b")], "msg_id string, content string"), "ton").write.parquet(ck)
    line = '{"custom_id":"ton_%s","error":%s,"response":{"body":{"choices":[{"message":{"content":"%s"}}],"usage":{"prompt_tokens":1,"completion_tokens":2,"total_tokens":3}}}}\n'
    (land / "1.json").write_text(line % ("1", "null", "gai") + line % ("2", '"x"', "triste"))
    assert responses.apply_all(spark, str(land), ck, "ton", state) == 1
    assert responses.apply_all(spark, str(land), ck, "ton", state) == 0
    assert {r.msg_id: r.ton for r in spark.read.parquet(ck).collect()} == {"1": "gai", "2": None}
    bad = files.read_jsonl(spark, str(land), files.RESPONSE)
    assert annotate.failures(bad).count() == 1 and annotate.cost(annotate.answers(bad, "ton")).first().prompt_tokens == 1


def test_requests_round_trip(spark, tmp_path):
    req = annotate.requests(spark.createDataFrame([("1", "é")], "msg_id string, content string"), "ton")
    files.write_requests(req, str(tmp_path / "r"))
    back = files.read_jsonl(spark, str(tmp_path / "r"), files.REQUEST).first()
    assert back.custom_id == "ton_1" and "« é »" in back.body.messages[1].content


def test_contract(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and "priority_queue" in q
    assert e.entry(spark).count() > 0


def test_salted_join(spark):
    from agoramill.runtime import salted_join

    left = spark.range(40000).select(F.when(F.col("id") < 20000, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    assert salted_join(left, right, "k", "n", 40000, F.col("id")).agg(F.count("*"), F.sum((F.col("m") >= F.col("id")).cast("int"))).first()[:] == (40000, 40000)
