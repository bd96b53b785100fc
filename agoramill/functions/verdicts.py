"""Labels, verdicts of models and their decision rules, as expressions on raw outputs."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agoramill.functions.text import strip

# The answers and questions of the two languages.
ANSWERS = {"fr": ("non-toxique", "toxique"), "en": ("non-toxic", "toxic")}
QUESTIONS = {"fr": "Ce message est-il toxique ?", "en": "Is this message toxic?"}


def clean_label(c: Column) -> Column:
    """Of a text: 1 for oui, toxic, true and 1; 0 for any other; null stays null."""
    return F.when(c.isNotNull(), strip(F.lower(c)).isin("oui", "toxic", "true", "1").cast("int"))


def clean_number(c: Column) -> Column:
    """A numeric label without its fraction, as int() cuts it: 1.0 is 1, -1 stays -1; null and NaN are null."""
    return F.when(~F.isnan(c.cast("double")), c.cast("double").cast("int"))


def cleaned(df: DataFrame, name: str) -> Column:
    """The label column by its type: numbers and booleans are cut to whole numbers, texts cleaned."""
    kind = df.schema[name].dataType
    return clean_number(F.col(name).cast("int") if kind == T.BooleanType() else F.col(name)) if isinstance(kind, (T.NumericType, T.BooleanType)) else clean_label(F.col(name))


def class_label(c: Column) -> Column:
    """1 if the lower-cased label contains oui; null is 0."""
    return F.coalesce(F.contains(F.lower(c), F.lit("oui")), F.lit(False)).cast("int")


def by_substring(c: Column, lang: str = "fr", keep: bool = True) -> Column:
    """"0" or "1", or the answer itself (null, unless ``keep``) where it contains neither; the negative answer holds the positive one, so it goes first."""
    no, yes = ANSWERS[lang]
    s = strip(F.lower(c))
    return F.when(s.contains(no), "0").when(s.contains(yes), "1").otherwise(s if keep else F.lit(None))


def by_tail(c: Column, lang: str = "fr", default: int = 0, lower: bool = False) -> Column:
    """The verdict after the last question; ``default`` where neither answer stands there (1: anything but a no)."""
    no, yes = ANSWERS[lang]
    tail = strip(F.replace(F.element_at(F.split(c, "\\Q" + QUESTIONS[lang] + "\\E"), -1), F.lit("assistant"), F.lit("")))
    tail = F.lower(tail) if lower else tail
    return F.when(c.isNull(), None).when(tail.contains(no), 0).when(tail.contains(yes), 1).otherwise(default)


def by_pattern(c: Column) -> Column:
    """1 or 0 by the first "oui" or "non" before the end marker, else -1."""
    v = F.regexp_extract(F.lower(c), r"(oui|non)\s*<\|im_end\|>", 1)
    return F.when(v == "oui", 1).when(v == "non", 0).otherwise(-1)


def softmax(x: Column) -> Column:
    """Of an array; shifted by its maximum."""
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def argmax(x: Column) -> Column:
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def any_at_least(scores: Column, threshold: float = 0.5) -> Column:
    """1 if any score of the array reaches the threshold; missing scores are 0."""
    return F.exists(scores, lambda v: F.coalesce(v, F.lit(0.0)) >= threshold).cast("int")


def any_flag(flags: Column) -> Column:
    return F.exists(flags, lambda v: F.coalesce(v, F.lit(False))).cast("int")


def any_but_first(p: Column) -> Column:
    """1 if all classes but the first together outweigh it."""
    return ((1 - p[0]) > p[0]).cast("int")


def unsafe(c: Column) -> Column:
    return F.contains(F.lower(c), F.lit("unsafe")).cast("int")


def encoder_verdict(logits: Column) -> Column:
    """struct<label, probability> of two logits: the likelier class, "Non Toxic" of equals, and its probability."""
    p = softmax(logits)
    return F.transform(F.array(p), lambda q: F.when(q[1] > q[0], F.struct(F.lit("Toxic").alias("label"), q[1].alias("probability"))).otherwise(F.struct(F.lit("Non Toxic").alias("label"), q[0].alias("probability"))))[0]


def harm_label(annotations: Column) -> Column:
    """1 if Toxicity (missing: 1) is above 2 or any other category above 1."""
    others = F.map_values(F.map_filter(annotations, lambda k, _: k != "Toxicity"))
    return ((F.coalesce(F.try_element_at(annotations, F.lit("Toxicity")), F.lit(1.0)) > 2.0) | F.exists(others, lambda v: v > 1.0)).cast("int")


def graded_label(c: Column) -> Column:
    return (c >= 1).cast("int")


def retry_delay(attempt: int, base: float = 2.0, kind: str = "linear", jitter: float = 0.0) -> float:
    """Seconds before the next try: base times 2^attempt, base^attempt plus jitter, or 5 + 2^attempt plus jitter when limited."""
    return base * 2**attempt if kind == "linear" else base**attempt + jitter if kind == "power" else 5 + 2**attempt + jitter


def log_prob(logits: Column, index: Column) -> Column:
    top = F.array_max(logits)
    return F.element_at(logits, index + 1) - (top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, v: a + F.exp(v - top))))


def joined(parts: Sequence[Column | str]) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def classification_prompt(text: Column, template: str = "", lang: str = "fr", local: bool = False, system: str = "") -> Column:
    """The prompt of a hosted model, of a local one, or with the system prompt in front."""
    q = QUESTIONS[lang]
    body = joined([template, "« ", text, " »", f"\n {q}\n"]) if local else joined([f"{template} « ", text, f" »\n{q}\n"])
    return joined([system + "\n", body]) if system else body


def filled(template: str, text: Column) -> Column:
    """The template with <TEXT> replaced by the stripped text."""
    return strip(F.replace(F.lit(template), F.lit("<TEXT>"), strip(text)))


def fewshot_block(text: Column, answer: Column) -> Column:
    return joined(["Message :\n« ", text, f" »\n{QUESTIONS['fr']}\n", answer])


def first_examples(df: DataFrame, label: str, key: str, k: int) -> DataFrame:
    """The first ``k`` rows of each class by ``key``: ``k`` rows per class and task reach one place, never a class."""
    few = df.where(F.col(label).isNotNull()).select(label, key, F.struct(key, *[c for c in df.columns if c not in (label, key)]).alias("__row"))
    classes = [r[0] for r in few.select(label).distinct().orderBy(label).collect()]  # there are few classes
    parts = [few.where(F.col(label) == c).orderBy(key).limit(k) for c in classes]
    out = parts[0] if parts else few.limit(0)
    for p in parts[1:]:
        out = out.union(p)
    return out.select(label, "__row.*")


def fewshot_prompt(template: str, toxic: Sequence[str], calm: Sequence[str], seed: int = 42) -> str:
    """The template with the examples, in a seeded order and separated by blank lines, at <insert here>. Examples are a
    handful of texts of the experiment's configuration, so this runs on the driver."""
    blocks = [f"Message :\n« {t} »\n{QUESTIONS['fr']}\n{a}" for a, ts in zip(("toxique", "non-toxique"), (toxic, calm)) for t in ts]
    random.Random(seed).shuffle(blocks)
    return template.replace("<insert here>", "\n\n".join(blocks))
