"""The batch annotation of messages: queue, requests, responses, merge, progress and cost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoramill.functions.text import is_blank, word_count
from agoramill.operators.sampling import first_per_key, sampled
from agoramill.sources.files import read_prompt


@dataclass(frozen=True)
class Step:
    """One annotation: its title in later prompts, the end of its prompt, and the name of its system prompt's file."""

    title: str
    end: str
    file: str


# The texts of the prompts, in the order of the steps.
START = "Voici les informations à analyser :\n\n"
STEPS = {
    "explication": Step("Explication", "Ta tâche est de reformuler, résumer et expliquer ce message de manière claire et neutre.\n\n", "explication.txt"),
    "ton": Step("Ton", "Ta tâche est d’identifier de façon nuancée les tons présents dans ce message.\n\n", "ton.txt"),
    "intention": Step("Intention", "Ta tâche est d’identifier les intentions principales du message de manière nuancée.\n\n", "intention.txt"),
    "categorie": Step("Catégorie", "Ta tâche est d’identifier les catégories correspondant au message de manière nuancée.\n\n", "categorie.txt"),
    "labels": Step("Labels selon la taxonomie", "Ta tâche est d’identifier les labels appropriés selon la taxonomie donnée.\n\n", "taxonomie.txt"),
    "toxicite_score": Step("Score de toxicité", "Ta tâche est d’attribuer une note de toxicité en tenant compte de toutes ces analyses et en suivant le barème donné.\n\n", "bareme.txt"),
    "certitude": Step("Certitude", "Ta tâche est d’évaluer la certitude du score de toxicité.\n\n", "certitude.txt"),
    "conclusion": Step("Conclusion", "Ta tâche est conclure sur la toxicité du contenu.\n\n", "conclusion.txt"),
}
#: The steps of the progress table and of the token estimate, in order.
REPORTED = [s for s in STEPS if s != "certitude"]
# Dollars per thousand tokens.
PROMPT_PRICE, COMPLETION_PRICE = 0.0005, 0.0015


def system_prompts(folder: str) -> dict[str, str]:
    """The system prompt of every step from its file in ``folder``; a missing file is an error that names it."""
    return {name: read_prompt(f"{folder}/{step.file}") for name, step in STEPS.items()}


def earlier(step: str) -> list[str]:
    """The steps whose answers a step sees."""
    if step == "certitude":
        return ["toxicite_score"]
    if step == "conclusion":
        return ["toxicite_score", "certitude"]
    return [s for s in list(STEPS)[: list(STEPS).index(step)] if s != "certitude"]


def with_step(df: DataFrame, step: str) -> DataFrame:
    return df if step in df.columns else df.withColumn(step, F.lit(None).cast("string"))


def queue(messages: DataFrame, checkpoint: DataFrame | None, step: str, in_flight: DataFrame | None = None, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Messages without an answer to ``step`` that no running batch holds; at most ``limit``, by a seeded order.

    One answered copy of an id takes all its rows out; blank answers count as none.
    """
    todo = messages
    if checkpoint is not None and step in checkpoint.columns:
        todo = todo.join(checkpoint.where(~is_blank(F.col(step))).select("msg_id").distinct(), "msg_id", "left_anti")
    if in_flight is not None:
        todo = todo.join(in_flight.select("msg_id").distinct(), "msg_id", "left_anti")
    return sampled(todo, "msg_id", limit, seed)


def user_prompt(step: str, columns: list[str], content: str = "content") -> Column:
    """The prompt of a row: the message, then the answers to earlier steps that are columns, in the columns' order."""
    fields = [("Message original", F.col(content))] + [(STEPS[c].title, F.col(c)) for c in columns if c in earlier(step)]
    blocks = [F.concat(F.lit(f"**{name}** :\n« "), F.coalesce(v.cast("string"), F.lit("nan")), F.lit(" »\n\n")) for name, v in fields]
    return F.concat(F.lit(START), *blocks, F.lit(STEPS[step].end))


def requests(queued: DataFrame, step: str, model: str = "gpt-4o-mini", max_tokens: int = 150, order: list[str] | None = None, systems: dict[str, str] | None = None) -> DataFrame:
    """One request per id (custom_id, msg_id, method, url, body); of copies the first in ``order``. ``systems`` holds the
    system prompt of each step; without it the system message is empty."""
    one = first_per_key(queued, "msg_id", order or ["msg_id", "content"])
    system, user = F.struct(F.lit("system").alias("role"), F.lit((systems or {}).get(step, "")).alias("content")), F.struct(F.lit("user").alias("role"), user_prompt(step, one.columns).alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(system, user).alias("messages"), F.lit(max_tokens).alias("max_tokens"))
    return one.select(F.concat(F.lit(step + "_"), "msg_id").alias("custom_id"), "msg_id", F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))


def id_of(custom_id: Column, step: str) -> Column:
    """The id behind the step's prefix; null for another step's request."""
    return F.when(F.startswith(custom_id, F.lit(step + "_")), F.substring(custom_id, len(step) + 2, 2**31 - 1))


def answers(responses: DataFrame, step: str) -> DataFrame:
    """(msg_id, answer, prompt_tokens, completion_tokens) of the responses without an error."""
    ok = F.coalesce(F.col("error"), F.lit("")).isin("", "{}", "null")
    return responses.where(ok).select(id_of(F.col("custom_id"), step).alias("msg_id"), F.col("response.body.choices")[0]["message"]["content"].alias("answer"), "response.body.usage.prompt_tokens", "response.body.usage.completion_tokens").where("msg_id IS NOT NULL")


def failures(responses: DataFrame) -> DataFrame:
    return responses.where(~F.coalesce(F.col("error"), F.lit("")).isin("", "{}", "null")).select("custom_id", "error")


def merged(checkpoint: DataFrame, results: DataFrame, step: str) -> DataFrame:
    """The checkpoint with the answers: a new one wins only if it isn't empty. Repeated ids in ``results`` fan out."""
    base = with_step(checkpoint, step)
    new = results.select(F.col("msg_id").alias("__id"), F.col("answer").alias("__new"))
    return base.join(new, F.col("msg_id").eqNullSafe(F.col("__id")), "left").withColumn(step, F.coalesce(F.when(F.col("__new") != "", F.col("__new")), F.col(step))).drop("__id", "__new")


def _n_words(text: str | None) -> int:
    return len((text or "").split())


def progress(checkpoint: DataFrame, systems: dict[str, str] | None = None) -> DataFrame:
    """(step, prompt_words, n_distinct, n_todo), one row per reported step, from one pass.

    Distinct answers don't count nulls but count an empty one; to do are nulls and empty answers, not blank ones. A step
    without a column has null counts. Answers are compared by a digest, so their texts aren't multiplied.
    """
    here = [s for s in REPORTED if s in checkpoint.columns]
    aggs = [a for s in here for a in (F.count_distinct(F.md5(s)).alias(f"{s}_d"), F.sum((F.col(s).isNull() | (F.col(s) == "")).cast("bigint")).alias(f"{s}_t"))]
    one = checkpoint.agg(F.count("*").alias("__all"), *aggs)
    null = F.lit(None).cast("bigint")
    rows = [F.struct(F.lit(s).alias("step"), F.lit(_n_words((systems or {}).get(s))).alias("prompt_words"), (F.col(f"{s}_d") if s in here else null).alias("n_distinct"), (F.coalesce(F.col(f"{s}_t"), F.lit(0)) if s in here else null).alias("n_todo")) for s in REPORTED]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def token_estimate(checkpoint: DataFrame, step: str, systems: dict[str, str] | None = None, base: tuple[str, ...] = ()) -> DataFrame:
    """(n_rows, n_words): words that a run over all rows sends: the system prompts of the step and of the earlier steps
    that are columns, per row, and the words of those steps' answers. Null answers have no words, the messages aren't
    counted, and columns that the messages already had (``base``) are no answers."""
    before = [s for s in REPORTED[: REPORTED.index(step)] if s in checkpoint.columns and s not in base]
    per_row = sum(_n_words((systems or {}).get(s)) for s in [*before, step])
    words = F.lit(0).cast("bigint")
    for s in before:
        words = words + F.when(F.col(s).isNull(), 0).otherwise(word_count(F.col(s)))
    return checkpoint.agg(F.count("*").alias("n_rows"), (F.count("*") * per_row + F.coalesce(F.sum(words), F.lit(0))).alias("n_words"))


def cost(results: DataFrame) -> DataFrame:
    p, c = F.coalesce(F.sum("prompt_tokens"), F.lit(0)), F.coalesce(F.sum("completion_tokens"), F.lit(0))
    return results.agg(p.alias("prompt_tokens"), c.alias("completion_tokens"), (p / 1000 * PROMPT_PRICE + c / 1000 * COMPLETION_PRICE).alias("dollars"))


# Structured fields of the answers: an extension, the answers themselves are kept as they are.
def note(c: Column) -> Column:
    return F.regexp_extract(c, r"Note ?: ?(\d{1,2}) ?/ ?10", 1).try_cast("int")


def taxonomy(c: Column) -> Column:
    """The labels S, H, V, R, A, I with their grade 0 to 3."""
    return F.regexp_extract_all(c, F.lit(r"\b([SHVRAI][0-3])\b"), F.lit(1))
