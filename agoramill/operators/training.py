"""Training data: formatting, candidate groups, and the segment-weighted token loss."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoramill.functions.text import strip
from agoramill.functions.verdicts import class_label
from agoramill.operators.sampling import oversampled, shuffled, undersampled

# The frame of a training text.
COT = ["CoT_explication", "CoT_tons", "CoT_intentions", "CoT_categorie", "CoT_score", "cot_final_question"]
LABEL, EOS, IGNORED = "literal_conclusion_annotator", "<|im_end|>", -100


def prompt(text: Column) -> Column:
    return F.concat(F.lit("Message:\n"), strip(text), F.lit("\n\nAnalyse:\n"))


def completion(cot: list[str], label: str, eos: str = EOS) -> Column:
    """The stripped parts, joined by blank lines, then the verdict. A part is left out if it is null or empty before it is stripped."""
    parts = F.filter(F.array(*[F.when(F.col(c) != "", strip(F.col(c))) for c in cot]).cast("array<string>"), lambda x: x.isNotNull())
    return F.concat(F.array_join(parts, "\n\n"), F.lit("\nConclusion : "), F.coalesce(F.col(label), F.lit("None")), F.lit("\n" + eos))


def sft(df: DataFrame, text: str = "content", cot: list[str] | None = None, label: str = LABEL, eos: str = EOS) -> DataFrame:
    """``df`` with prompt, completion and text. Rows without a text have null ones; parts that are no columns are left out."""
    here = [c for c in (COT if cot is None else cot) if c in df.columns]
    out = df.withColumn("prompt", prompt(F.col(text))).withColumn("completion", completion(here, label, eos))
    return out.withColumn("text", F.concat("prompt", "completion"))


def dpo(df: DataFrame, text: str = "content", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    return df.select(prompt(F.col(text)).alias("prompt"), strip(F.col(chosen)).alias("chosen"), strip(F.col(rejected)).alias("rejected"))


def by_blanks(text: Column) -> Column:
    """The stand-in tokenizer: words between blanks. Any function from a text column to an array column takes its place."""
    return F.split(text, " ")


def tokenized(df: DataFrame, tokenizer: Callable[[Column], Column], max_length: int = 1024, text: str = "text", pad: Column | None = None) -> DataFrame:
    """``df`` with tokens, at most ``max_length`` of them, and its attention mask; with ``pad`` filled up to that length."""
    out = df.withColumn("tokens", F.slice(tokenizer(F.col(text)), 1, max_length))
    n = F.size("tokens")
    if pad is None:
        return out.withColumn("mask", F.transform("tokens", lambda _: F.lit(1)))
    out = out.withColumn("mask", F.transform(F.sequence(F.lit(1), F.lit(max_length)), lambda i: (i <= n).cast("int")))
    return out.withColumn("tokens", F.concat("tokens", F.array_repeat(pad, max_length - n)))


def prepared_sft(df: DataFrame, key: str, tokenizer: Callable[[Column], Column] = by_blanks, oversampling: bool = False, label: str = LABEL, seed: int = 42, max_length: int = 1024, label_class: str | None = None, **kw) -> DataFrame:
    """Oversampled and shuffled where asked for, formatted, tokenised and cut: (key, copy, rank, text, prompt, completion,
    tokens, mask). Classes are those of ``label_class``, else the label's texts; rows without one are left out by
    oversampling only."""
    rows = df.withColumn("copy", F.lit(1)) if not oversampling else oversampled(df, label_class or label, key, seed)
    if oversampling:
        rows = shuffled(rows.withColumn("__id", F.concat_ws("/", F.col(key).cast("string"), F.col("copy").cast("string"))), "__id", seed).withColumnRenamed("shuffle_rank", "rank")
    else:
        rows = rows.withColumn("rank", F.lit(None).cast("bigint"))
    return tokenized(sft(rows, label=label, **kw), tokenizer, max_length).select(key, "copy", "rank", "text", "prompt", "completion", "tokens", "mask")


def prepared_dpo(df: DataFrame, key: str, tokenizer: Callable[[Column], Column] = by_blanks, undersampling: bool = True, label: str = LABEL, seed: int = 42, max_length: int = 1024, label_class: str | None = None, **kw) -> DataFrame:
    """Undersampled to the smallest class and shuffled, formatted, tokenised and cut: (key, rank, text, prompt, completion,
    tokens, mask)."""
    rows = shuffled(undersampled(df, label_class or label, key, seed) if undersampling else df, key, seed).withColumnRenamed("shuffle_rank", "rank")
    return tokenized(sft(rows, label=label, **kw), tokenizer, max_length).select(key, "rank", "text", "prompt", "completion", "tokens", "mask")


def prepared_encoder(df: DataFrame, key: str, tokenizer: Callable[[Column], Column] = by_blanks, pad: str = "<pad>", text: str = "content", label: str = LABEL, max_length: int = 128) -> DataFrame:
    """(key, label, tokens, mask) of exactly ``max_length`` tokens, for a classifier of two classes."""
    out = df.select(key, class_label(F.col(label)).alias("label"), F.coalesce(strip(F.col(text)), F.lit("")).alias("text"))
    return tokenized(out, tokenizer, max_length, pad=F.lit(pad)).select(key, "label", "tokens", "mask")


def generated(prompts: DataFrame, generate: Callable[[list[str]], list[list[str]]], n: int, batch: int = 16) -> DataFrame:
    """(prompt, reference, candidates): ``n`` candidates for each row of ``prompts`` (prompt, reference).

    ``generate`` gets prompts that end in an opened thought and returns ``n`` texts for each; it runs in Arrow batches
    on the executors. The prompt that comes out is the one that went in. Fewer or more than ``n`` texts are an error.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            asked = [p + "<think>\n" for p in part["prompt"].fillna("")]
            out = [c for i in range(0, len(asked), batch) for c in generate(asked[i : i + batch])]
            if any(len(c) != n for c in out) or len(out) != len(part):
                raise ValueError(f"the generator must return {n} texts per prompt")
            yield pd.DataFrame({"prompt": part["prompt"], "reference": part["reference"], "candidates": out})

    return prompts.select("prompt", "reference").mapInPandas(run, "prompt string, reference string, candidates array<string>")


def candidate_groups(outputs: DataFrame, prompts: DataFrame, n: int) -> DataFrame:
    """(prompt, reference, candidates): outputs (pos, text) j*n to j*n+n-1 belong to prompt j (pos, prompt, reference), in order."""
    lists = outputs.groupBy(F.floor(F.col("pos") / n).cast("bigint").alias("j")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("candidates"))
    return prompts.join(lists, F.col("pos") == F.col("j")).select("prompt", "reference", "candidates")


def segments(tokens: DataFrame, start: int | str, end: int | str, seq: str = "seq_id", pos: str = "pos", token: str = "token_id") -> DataFrame:
    """``tokens`` with block (0 outside; an end token belongs to its block) and next_token (-100 at the end)."""
    w = Window.partitionBy(seq).orderBy(pos)
    starts = F.sum((F.col(token) == start).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ends = F.coalesce(F.sum((F.col(token) == end).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = tokens.withColumn("__s", starts).withColumn("__e", ends).withColumn("next_token", F.lead(token, 1, IGNORED if isinstance(start, int) else str(IGNORED)).over(w))
    return x.withColumn("block", F.when(F.col("__s") > F.col("__e"), F.col("__s")).otherwise(0)).drop("__s", "__e")


def segment_weight(block: Column, alphas: Column) -> Column:
    """The block's weight; blocks beyond the list weigh 1."""
    return F.coalesce(F.try_element_at(alphas, (block + 1).cast("int")), F.lit(1.0))


def token_loss(logprob: Column, dft: bool = False) -> Column:
    return -F.exp(logprob) * logprob if dft else -logprob


def segment_loss(marked: DataFrame, alphas: list[float], dft: bool = False, items: int | None = None) -> DataFrame:
    """The weighted mean loss over tokens that have a next one; the mean is over ``items`` where given."""
    a = segment_weight(F.col("block"), F.array(*map(F.lit, map(float, alphas))))
    mask = (F.col("next_token").cast("string") != str(IGNORED)).cast("double")
    total = F.sum(a * token_loss(F.col("logprob"), dft) * mask)
    return marked.agg(F.coalesce(F.try_divide(total, F.lit(float(items)) if items else F.sum(mask)), F.lit(0.0)).alias("loss"))


def segment_report(marked: DataFrame, start: int | str, token: str = "token_id") -> DataFrame:
    return marked.agg(F.sum((F.col(token) == start).cast("bigint")).alias("n_blocks"), F.count("*").alias("n_tokens"), F.sum((F.col("block") > 0).cast("bigint")).alias("n_in_block"))


def scheduled(epochs: DataFrame, schedule: list[tuple[float, list[float]]]) -> DataFrame:
    """``epochs`` (epoch) with the alphas of the last entry of the list at or before; [1.0] before the first. The
    schedule is a short list of the training configuration and travels as a literal."""
    entries = F.array(*[F.struct(F.lit(float(e)).alias("epoch"), F.array(*map(F.lit, map(float, a))).alias("alphas")) for e, a in schedule]) if schedule else None
    default = F.array(F.lit(1.0))
    if entries is None:
        return epochs.withColumn("alphas", default)
    past = F.filter(entries, lambda x: x["epoch"] <= F.col("epoch"))
    return epochs.withColumn("alphas", F.coalesce(F.try_element_at(past, F.lit(-1))["alphas"], default))
