"""Published metrics, segment blocks, balancing, formats, annotation and predictors."""

import math

import pytest
from pyspark.sql import functions as F

from agoramill.functions import verdicts
from agoramill.operators import annotate, evaluate, predictors, sampling, training
from agoramill.plans.catalog import PROMPTS

# Published confusion counts (tp, fp, tn, fn), accuracy, F1_0 and F1_1.
GOLDEN = [(497, 173, 521, 197, 0.7334, 0.7380, 0.7287), (401, 35, 659, 293, 0.7637, 0.8007, 0.7097), (589, 83, 611, 105, 0.8646, 0.8667, 0.8624), (275, 40, 307, 72, 0.8386, 0.8457, 0.8308), (41, 2, 54, 15, 0.8482, 0.8640, 0.8283)]


@pytest.mark.parametrize("tp,fp,tn,fn,acc,f0,f1", GOLDEN)
def test_published_rows(spark, tp, fp, tn, fn, acc, f0, f1):
    counts = spark.createDataFrame([(1, 1, tp), (0, 1, fp), (0, 0, tn), (1, 0, fn)], "target int, prediction int, n long")
    r = evaluate.leaderboard_row(counts, "m").first()
    assert (round(r.Accuracy, 4), round(r.F1_0, 4), round(r.F1_1, 4)) == (acc, f0, f1)
    assert math.isclose(r.ROC_AUC, (r.Recall_0 + r.Recall_1) / 2)


def test_metrics_survive_odd_labels(spark):
    r = evaluate.leaderboard_row(spark.createDataFrame([(1, -1, 3), (0, -1, 2)], "target int, prediction int, n long"), "m").first()
    assert r.Accuracy == 0.0 and r.F1_1 == 0.0 and r.ROC_AUC == 0.5
    ranks = spark.createDataFrame([(1, -1, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1), (0, 0, 1), (0, 1, 1)], "target int, prediction int, n long")
    assert math.isclose(evaluate.auc(ranks).first()[0], 2.5 / 9)
    assert evaluate.auc(ranks.limit(0)).first()[0] == 0.0


def test_join_fans_out_and_nulls_meet(spark):
    t = spark.createDataFrame([("a", 1), ("a", 0), (None, 1)], "content string, label int")
    p = spark.createDataFrame([("a", 1), ("a", 1), (None, 0)], "content string, label int")
    assert evaluate.joined(t, p).count() == 5
    assert evaluate.pair_counts(t, p).agg(F.sum("n")).first()[0] == 5


def test_leaderboard(spark):
    old = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "Model string, Accuracy double")
    new = spark.createDataFrame([("a", 0.9, 1.0)], "Model string, Accuracy double, F1_1 double")
    twice = evaluate.upserted(evaluate.upserted(old, new), new)
    assert sorted((r.Model, r.Accuracy) for r in twice.collect()) == [("a", 0.9), ("b", 0.2)]


def test_segments(spark):
    toks = "p S a E b S c E d".split()
    df = spark.createDataFrame([(1, i, t, -0.5) for i, t in enumerate(toks)], "seq_id long, pos int, token_id string, logprob double")
    m = training.segments(df, "S", "E").orderBy("pos").collect()
    assert [r.block for r in m] == [0, 1, 1, 1, 0, 2, 2, 2, 0] and m[-1].next_token == "-100"
    marked = training.segments(df, "S", "E")
    assert math.isclose(training.segment_loss(marked, [1, 1, 1]).first()[0], 0.5)
    assert math.isclose(training.segment_loss(marked, [0, 1, 0]).first()[0], 0.5 * 3 / 8)
    assert math.isclose(training.segment_loss(marked, [1.0], dft=True).first()[0], 0.5 * math.exp(-0.5))
    assert training.segment_loss(marked.limit(0), [1.0]).first()[0] == 0.0


def test_schedule(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (0.6,), (9.0,)], "epoch double")
    got = [r.alphas for r in training.scheduled(df, [(0.5, [1.0]), (0.5, [2.0]), (0.7, [3.0])]).orderBy("epoch").collect()]
    assert got == [[1.0], [2.0], [2.0], [3.0]]
    assert training.scheduled(df, []).first().alphas == [1.0]


def test_formats(spark):
    df = spark.createDataFrame([(" salut ", "un", " ", "", None, "oui")], "content string, a string, b string, c string, d string, literal_conclusion_annotator string")
    r = training.sft(df, cot=["a", "b", "c", "d"]).first()
    assert r.prompt == "Message:\nsalut\n\nAnalyse:\n" and r.completion == "un\n\n\nConclusion : oui\n<|im_end|>" and r.text == r.prompt + r.completion


def test_balancing(spark):
    df = spark.range(103).select("id", F.when(F.col("id") < 10, 1).when(F.col("id") < 100, 0).alias("label"))
    over = sampling.oversampled(df, "label", "id")
    assert {r.label: r["count"] for r in over.groupBy("label").count().collect()} == {0: 90, 1: 90}
    under = sampling.undersampled(df.repartition(7), "label", "id")
    assert {r.label: r["count"] for r in under.groupBy("label").count().collect()} == {0: 10, 1: 10}
    assert {tuple(r) for r in under.collect()} == {tuple(r) for r in sampling.undersampled(df.coalesce(1), "label", "id").collect()}
    assert sampling.undersampled(df, "label", "id", cap=3).count() == 6
    assert sampling.sampled(df, "id", None).count() == 103 and sampling.sampled(df, "id", 5).count() == 5


def test_annotation_round(spark):
    msgs = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b"), ("3", None)], "msg_id string, content string")
    ck = annotate.with_step(msgs, "explication").withColumn("explication", F.when(F.col("msg_id") == "2", "ok").when(F.col("msg_id") == "3", "  "))
    q = annotate.queue(msgs, ck, "explication", spark.createDataFrame([("3",)], "msg_id string"))
    assert {r.msg_id for r in q.collect()} == {"1"}
    req = annotate.requests(ck, "toxicite_score").where("msg_id = '2'").first()
    assert req.custom_id == "toxicite_score_2" and "**Explication** :\n« ok »" in req.body.messages[1].content
    got = spark.createDataFrame([("1", "x"), ("2", ""), ("3", "z")], "msg_id string, answer string")
    once = annotate.merged(ck, got, "explication")
    assert {r.msg_id: r.explication for r in once.collect()} == {"1": "x", "2": "ok", "3": "z"}
    again = annotate.merged(once, got, "explication")
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))
    assert annotate.earlier("conclusion") == ["toxicite_score", "certitude"] and annotate.earlier("ton") == ["explication"]
    assert spark.range(1).select(annotate.id_of(F.lit("toxicite_score_score_7"), "toxicite_score")).first()[0] == "score_7"


def test_predictors(spark):
    class Stubborn(predictors.Rehearsal):
        def raw(self, texts):
            self.n = getattr(self, "n", 0) + 1
            return ["oui<|im_end|>" if self.n > 1 else "?" for _ in texts]

    df = spark.createDataFrame([("a",), ("b",), (None,)], "content string").coalesce(1)
    out = predictors.predicted(df, Stubborn(), resolved=lambda x: "im_end" in x)
    assert [r.label for r in predictors.labelled(out, "FineTunedPredictor").collect()] == [1, 1, 1]
    truth = spark.createDataFrame([("a", 1), ("b", None), ("c", 0)], "content string, label int")
    assert [r.content for r in predictors.pending(truth, df).collect()] == ["c"]
    assert len(predictors.RULES) == 19


def test_runner_resumes(spark, tmp_path):
    truth = spark.createDataFrame([("aaa", 1), ("aaa", 1), ("bb", 0)], "content string, label int")
    path = str(tmp_path / "predictions")
    assert predictors.run_and_append(truth.where("content = 'bb'"), predictors.Rehearsal(), "FineTunedPredictor", path).count() == 1
    out = predictors.run_and_append(truth, predictors.Rehearsal(), "FineTunedPredictor", path)
    assert {r.content: r.label for r in out.collect()} == {"aaa": "1", "bb": "0"} and out.count() == 2


def test_fewshot_prompt():
    from agoramill.functions.verdicts import fewshot_prompt

    p = fewshot_prompt("Exemples :\n<insert here>\nFin", ["a"], ["b"], seed=1)
    assert p.count("Ce message est-il toxique ?") == 2 and "« a »\nCe message est-il toxique ?\ntoxique" in p and p.endswith("\nFin")
    assert p == fewshot_prompt("Exemples :\n<insert here>\nFin", ["a"], ["b"], seed=1)


def test_labels_by_type(spark):
    df = spark.createDataFrame([(1.0, 1, True, "Oui "), (-1.0, -1, False, "1.0"), (float("nan"), None, None, None), (0.9, 2, True, "Error")], "d double, i int, b boolean, s string")
    got = [tuple(r) for r in df.select(*[verdicts.cleaned(df, c) for c in df.columns]).collect()]
    assert got == [(1, 1, 1, 1), (-1, -1, 0, 0), (None, None, None, None), (0, 2, 1, 0)]


def test_evaluated_from_raw_predictions(spark):
    truth = spark.createDataFrame([(str(i), "oui" if i % 2 else "non") for i in range(8)] + [("x", "oui")], "content string, label string")
    said = spark.createDataFrame([(str(i), float(i % 2 or i == 0)) for i in range(6)] + [("6", -1.0), ("7", float("nan"))], "content string, label double")
    board = spark.createDataFrame([("m", 0.1), ("o", 0.2)], "Model string, Accuracy double")
    rows = {r.Model: r for r in evaluate.evaluated(truth, said, "m", board).collect()}
    assert rows["o"].Accuracy == 0.2 and math.isclose(rows["m"].Accuracy, 5 / 7) and math.isclose(rows["m"].Precision_1, 3 / 4)
    assert evaluate.evaluated(truth, said.limit(0), "m", board).where("Accuracy = 0.1").count() == 1
    texts = spark.createDataFrame([("1", "Oui"), ("2", "Error"), ("3", None)], "content string, label string")
    assert evaluate.evaluated(truth, texts, "t").first().Accuracy == 1.0


@pytest.mark.parametrize("tp,fp,tn,fn", [g[:4] for g in GOLDEN[-1:]])
def test_published_row_from_predictions(spark, tp, fp, tn, fn):
    cells = [(1, 1)] * tp + [(0, 1)] * fp + [(0, 0)] * tn + [(1, 0)] * fn
    truth = spark.createDataFrame([(f"c{i}", t) for i, (t, _) in enumerate(cells)], "content string, label int")
    said = spark.createDataFrame([(f"c{i}", str(p)) for i, (_, p) in enumerate(cells)], "content string, label string")
    assert round(evaluate.evaluated(truth, said, "m").first().Accuracy, 4) == 0.8482


def test_progress_and_estimate(spark):
    ck = spark.createDataFrame([("a b", "un deux", None), ("c", "", "x"), ("d", "  ", "x"), ("e", None, "x y")], "content string, explication string, ton string")
    systems = annotate.system_prompts(PROMPTS)
    rows = {r.step: tuple(r)[1:] for r in annotate.progress(ck, systems).collect()}
    assert list(rows) == annotate.REPORTED and rows["explication"] == (12, 3, 2) and rows["ton"] == (12, 2, 1) and rows["labels"] == (13, None, None)
    assert annotate.token_estimate(ck, "intention", systems).first() == (4, 4 * (12 + 12 + 7) + 2 + 4)
    assert annotate.token_estimate(ck, "intention", systems, base=("ton",)).first() == (4, 4 * (12 + 7) + 2)
    assert annotate.token_estimate(ck.limit(0), "ton", systems).first() == (0, 0)
    with pytest.raises(FileNotFoundError, match="explication.txt"):
        annotate.system_prompts("/nowhere")


def test_failing_model():
    class Shaky:
        calls = 0

        def start(self):
            pass

        def raw(self, texts):
            Shaky.calls += 1
            if "never" in texts:
                raise RuntimeError("429 rate limit")
            if Shaky.calls == 1:
                raise ValueError("once")
            return [t.upper() for t in texts]

    waits = []
    policy = predictors.Policy(3, 2.0, "power", 0.0, "Error", 2)
    assert predictors.row_wise(Shaky(), predictors.Policy(3, 2.0, "power", 0.0, "Error"), waits.append)(["a", "never", "b"]) == ["A", "Error", "B"]
    assert waits[0] == 1.0 and 6 <= waits[1] <= 9 and 7 <= waits[2] <= 10 and len(waits) == 3
    assert predictors.batched(Shaky(), policy, 2, sleep=waits.append)(["a", "never", "b"]) == ["A", "Error", "B"]
    assert predictors.row_wise(Shaky(), policy, waits.append)(["x", "y", "z"]) == ["X", "Y", "Z"]
    asked = []

    class Vague:
        def raw(self, texts):
            asked.append(len(texts))
            return ["?" if t == "q" else "ok" for t in texts]

    assert predictors.batched(Vague(), policy, 2, rounds=2, resolved=lambda x: x == "ok")(["a", "q", "b"]) == ["ok", "?", "ok"] and asked == [2, 1, 1, 1]
    assert predictors.POLICIES["GPTPredictor"].delay(3, ValueError("x")) == 4.0


def test_checkpoints_by_rows(spark, tmp_path):
    path, truth = str(tmp_path / "p"), spark.range(40).select(F.concat(F.lit("text "), "id").alias("content"), F.lit(1).alias("label"))
    out = predictors.run_and_append(truth, predictors.Rehearsal(), "FineTunedPredictor", path, rows=10)
    assert out.count() == 40 and len({r[0] for r in out.select(F.input_file_name()).distinct().collect()}) >= 4


def test_preparers_and_generation(spark):
    df = spark.createDataFrame([(i, f"mot {i} " * 3, "oui" if i < 3 else "non") for i in range(10)] + [(10, None, None)], "row_id long, content string, literal_conclusion_annotator string")
    over = training.prepared_sft(df, "row_id", oversampling=True, cot=[], max_length=5).collect()
    assert len(over) == 14 and sorted(r.rank for r in over) == list(range(1, 15)) and all(len(r.tokens) == len(r.mask) == 5 for r in over)
    assert len(training.prepared_sft(df, "row_id", cot=[]).collect()) == 11
    under = training.prepared_dpo(df, "row_id", cot=[]).collect()
    assert len(under) == 6 and all(r.text == r.prompt + r.completion for r in under)
    enc = training.prepared_encoder(df, "row_id", max_length=8).collect()
    assert all(len(r.tokens) == len(r.mask) == 8 for r in enc) and {r.label for r in enc} == {0, 1} and sum(enc[0].mask) == 6
    prompts = spark.createDataFrame([("p", "r"), (None, "s")], "prompt string, reference string")
    got = training.generated(prompts, lambda ps: [[p, p[::-1]] for p in ps], 2).collect()
    assert got[0].prompt == "p" and got[0].candidates == ["p<think>\n", "\n>kniht<p"] and got[1].candidates[0] == "<think>\n"


def test_first_examples(spark):
    df = spark.createDataFrame([(i, i % 2, f"t{i}") for i in range(20)] + [(30, None, "x")], "row_id long, label int, text string")
    got = sorted((r.label, r.row_id, r.text) for r in verdicts.first_examples(df, "label", "row_id", 3).collect())
    assert got == [(0, 0, "t0"), (0, 2, "t2"), (0, 4, "t4"), (1, 1, "t1"), (1, 3, "t3"), (1, 5, "t5")]
    assert verdicts.first_examples(df.limit(0), "label", "row_id", 3).count() == 0


def test_encoder_verdict(spark):
    df = spark.createDataFrame([([0.0, 1.0],), ([1.0, 1.0],)], "x array<double>")
    got = [r[0] for r in df.select(verdicts.encoder_verdict(F.col("x"))).collect()]
    assert got[0].label == "Toxic" and math.isclose(got[0].probability, math.e / (1 + math.e)) and tuple(got[1]) == ("Non Toxic", 0.5)
