"""Predictors: a protocol, their decision rules and failure policies, and runners that retry, isolate rows and resume."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoramill.functions import verdicts as v


class Predictor(Protocol):
    """A model: ``start`` once per worker, then raw outputs for lists of texts. Either may raise."""

    def start(self) -> None: ...

    def raw(self, texts: list[str]) -> list[str]: ...


@dataclass(frozen=True)
class Policy:
    """What a predictor does about failures: tries per row, the back-off between them, and the outcome after the last.

    ``kind`` and ``base`` are those of ``verdicts.retry_delay``, ``jitter`` the most seconds added; a limited request
    (429) waits by its own rule. ``failure`` is the raw output of a row that never succeeded.
    """

    tries: int = 1
    base: float = 2.0
    kind: str = "linear"
    jitter: float = 0.0
    failure: str | None = None
    workers: int = 1

    def delay(self, attempt: int, error: Exception) -> float:
        limited = "429" in str(error) or "rate limit" in str(error).lower()
        if limited and self.kind == "power":
            return v.retry_delay(attempt, kind="limited", jitter=random.uniform(0, 3))
        return v.retry_delay(attempt, self.base, self.kind, random.uniform(0, self.jitter))


# Tries, delays, outcomes and parallel requests of the hosted models.
POLICIES: dict[str, Policy] = {
    "GPTPredictor": Policy(5, 0.5, "linear", 0.0, "Error", 10),
    "DeepseekPredictor": Policy(5, 2.0, "power", 1.0, None, 10),
    "GeminiPredictor": Policy(5, 2.0, "power", 1.0, None, 1),
    "MistralAPIPredictor": Policy(10, 2.0, "power", 1.0, None, 2),
}

#: The rule that turns the raw output of each predictor into a label, as an expression.
RULES: dict[str, Callable[[Column], Column]] = {
    "GPTPredictor": lambda c: F.when(c == "Error", "Error").otherwise(v.by_substring(c)),
    "DeepseekPredictor": lambda c: v.by_substring(c, keep=False),
    "MistralAPIPredictor": lambda c: v.by_substring(c, keep=False),
    "GeminiPredictor": lambda c: v.by_substring(c, keep=False),
    "MistralPredictor": lambda c: v.by_tail(c, default=0),
    "Qwen25Predictor": lambda c: v.by_tail(c, default=1, lower=True),
    "Qwen3Predictor": lambda c: v.by_tail(c, default=1, lower=True),
    "LlamaGuardPredictor": v.unsafe,
    "ShieldGemmaPredictor": lambda x: (v.softmax(x)[0] > 0.5).cast("int"),
    "MistralModerationPredictor": v.any_flag,
    "OpenAIModerationPredictor": lambda c: c.cast("int"),
    "PerspectiveAPIPredictor": v.any_at_least,
    "CamemBertPredictor": lambda x: v.any_but_first(v.softmax(x)),
    "DistilBertPredictor": lambda x: (v.sigmoid(x[0]) > 0.5).cast("int"),
    "PolyGuardPredictor": v.argmax,
    "ToxicBertPredictor": lambda x: (v.sigmoid(x[0]) > 0.5).cast("int"),
    "FineTunedPredictor": v.by_pattern,
    "FrenchToxicityClassifierPredictor": lambda c: (c == "toxic").cast("int"),
    "EncoderPredictor": v.encoder_verdict,
}


def pending(truth: DataFrame, known: DataFrame | None, key: str = "content") -> DataFrame:
    """The texts without a prediction yet; rows without a text or label are left out."""
    todo = truth.na.drop(subset=[c for c in (key, "label") if c in truth.columns])
    return todo.join(known.select(key).distinct(), key, "left_anti") if known is not None else todo


def attempted(call: Callable[[str], str], text: str, policy: Policy, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The output for one text after at most ``policy.tries`` tries, or the policy's failure; other rows don't notice."""
    for attempt in range(policy.tries):
        try:
            return call(text)
        except Exception as error:  # noqa: BLE001 - whatever a model raises
            if attempt + 1 < policy.tries:
                sleep(policy.delay(attempt, error))
    return policy.failure


def row_wise(predictor: Predictor, policy: Policy, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[str | None]]:
    """A batch as single requests, ``policy.workers`` at a time, each with its own retries."""

    def run(texts: list[str]) -> list[str | None]:
        one = lambda t: predictor.raw([t])[0]
        if policy.workers == 1:
            return [attempted(one, t, policy, sleep) for t in texts]
        with ThreadPoolExecutor(policy.workers) as pool:
            return list(pool.map(lambda t: attempted(one, t, policy, sleep), texts))

    return run


def batched(predictor: Predictor, policy: Policy, size: int = 8, rounds: int = 0, resolved: Callable[[str], bool] | None = None, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[str | None]]:
    """Batches of ``size``; outputs that aren't ``resolved`` are asked for again, ``rounds`` times. A batch that fails is
    tried row by row, so one bad row costs only itself."""
    single = row_wise(predictor, policy, sleep)

    def some(texts: list[str]) -> list[str | None]:
        try:
            return list(predictor.raw(texts))
        except Exception:  # noqa: BLE001
            return single(texts)

    def run(texts: list[str]) -> list[str | None]:
        out: list[str | None] = [x for i in range(0, len(texts), size) for x in some(texts[i : i + size])]
        for _ in range(rounds if resolved else 0):
            left = [i for i, x in enumerate(out) if x is None or not resolved(x)]
            if not left:
                break
            for i, x in zip(left, [x for j in range(0, len(left), size) for x in some([texts[i] for i in left[j : j + size]])]):
                out[i] = x
        return out

    return run


def predicted(df: DataFrame, predictor: Predictor, key: str = "content", retries: int = 3, resolved: Callable[[str], bool] | None = None, policy: Policy | None = None, size: int = 8, threaded: bool = False) -> DataFrame:
    """(key, raw) of every row, in Arrow batches. ``threaded`` asks row by row with the policy's workers, else in batches
    of ``size`` with ``retries`` rounds for outputs that aren't ``resolved``. A null text is asked for as an empty one."""
    policy = policy or Policy()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor.start()
        ask = row_wise(predictor, policy) if threaded else batched(predictor, policy, size, retries, resolved)
        for part in parts:
            yield pd.DataFrame({key: part[key], "raw": ask(part[key].fillna("").tolist())})

    return df.select(key).mapInPandas(run, f"{key} string, raw string")


class Rehearsal:
    """A deterministic stand-in for a model: answers by the length of the text."""

    def start(self) -> None:
        self.ready = True

    def raw(self, texts: list[str]) -> list[str]:
        return [("oui" if len(t) % 3 == 0 else "non") + "<|im_end|>" for t in texts]


class Faulty:
    """A stand-in that fails: always on texts whose length divides by seven, and in batches that hold one."""

    def start(self) -> None:
        self.ready = True

    def raw(self, texts: list[str]) -> list[str]:
        if any(len(t) % 7 == 0 for t in texts):
            raise RuntimeError("429 rate limit")
        return [" Non-toxique." if len(t) % 3 else "TOXIQUE" if len(t) % 2 else "peut-être" for t in texts]


def labelled(outputs: DataFrame, name: str) -> DataFrame:
    return outputs.withColumn("label", RULES[name](F.col("raw")))


def run_and_append(truth: DataFrame, predictor: Predictor, name: str, path: str, key: str = "content", rows: int | None = None, **kw) -> DataFrame:
    """Predict the texts that the Parquet table at ``path`` lacks and append them. Returns the whole table.

    With ``rows``, at most about so many are predicted and appended at a time, by a hash of the text: a checkpoint, from
    which a run that dies goes on. Texts are asked for once, however often they occur.
    """
    spark = truth.sparkSession
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    known = spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None
    todo = pending(truth, known, key).select(key).distinct()
    slices = max(1, -(-todo.count() // rows)) if rows else 1
    for i in range(slices):
        part = todo.where(F.pmod(F.xxhash64(key), F.lit(slices)) == i) if slices > 1 else todo
        labelled(predicted(part, predictor, key, **kw), name).select(key, F.col("label").cast("string").alias("label")).write.mode("append").parquet(path)
    return spark.read.parquet(path)
