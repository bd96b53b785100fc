"""Problem 3: abusive, hateful or sexual content.

Method: cumulative-link (proportional odds) ordinal regression. The grades of annotated messages ("Note : 7/10") are
predicted from sparse word sequences with one weight vector shared by all ordered thresholds; the output is the expected
severity. Features are sequences of two and three words, and the same with the words of a small lexicon (insults, violent
verbs) replaced by their class, so that a turn of phrase learned with one word holds for the others; a few turns that
insult or threaten whatever the table have a prior weight, towards which the fit is drawn as it is towards zero elsewhere.
Quoted and reported words are masked by a sign that takes part in the sequences; disguised letters are restored. The flag
lies where it serves best on labelled messages that the fit hasn't seen.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoramill.llm.capping import account
from agoramill.runtime import stage

#: Bounds of the labelled samples (to fit, and to place the flag) and of the model's features, documented parameters.
SAMPLE, HELD_OUT, FEATURES = 20_000, 5_000, 200_000
# Signs that stand for letters.
_LOOKALIKE = str.maketrans("аеорсухіјѕԁһΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορν", "aeopcyxijsdhABEZHIKMNOPTYXaopv")
_LEET = str.maketrans("0134578@$€!|", "oieastbasei" + "l")
_SPACED = regex.compile(r"(?<![\p{L}\p{N}])(?:\p{L}[.\-*_•·]+){2,}\p{L}(?![\p{L}\p{N}])")
_MIXED = regex.compile(r"(?<![\p{L}\p{N}@$])(?=[\p{L}\p{N}@$€!|]*\p{L})(?=[\p{L}\p{N}@$€!|]*[0134578@$€])[\p{L}\p{N}@$€!|]{3,}(?<!!)(?<!\|)")
_QUOTED = regex.compile(r"«[^«»]{1,200}»|“[^“”]{1,200}”|(?<![\p{L}\p{N}])\"[^\"]{1,200}\"(?![\p{L}\p{N}])")
_REPORTED = regex.compile(r"\b(trait(?:er|es?|ez|ent|ait|e+)(?: \p{L}+(?:'\p{L}+)?)?) (?:de |d')(?:\p{L}+ ){0,2}?\p{L}+(?= )")
_CONDEMNED = regex.compile(r"\b(?:arrete[zr]?|cesse[zr]?|inadmissible|honteux|scandaleux) de (?:dire|repeter|croire|penser|pretendre)\b.*|\bc'est (?:du|de la|de l')(?: )?(?:racisme|xenophobie|sexisme|homophobie|antisemitisme|harcelement|diffamation|haine)\b")
_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_MARK = re.compile("[\u0300-\u036f\u200b-\u200f\u2060-\u2064\ufeff\u00ad]+")
_ODD = regex.compile(r"[\p{M}\p{Cf}]+")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_NAME = "§"
# Common French insults and verbs of violence, singular and without accents.
_CLASSES = {
    "¶i": "abruti abrutie andouille batard batarde bouffon boulet con connard connasse conne cretin cretine debile encule enculee enfoire enfoiree idiot idiote imbecile merde minable ordure parasite pouffiasse pourriture pute raclure salaud salopard salope tocard",
    "¶t": "assommer buter cogner crever defoncer demolir egorger eventrer fracasser frapper massacrer planter saigner tabasser tuer",
}
_CLASS = {form: k for k, words in _CLASSES.items() for w in words.split() for form in (w, w + "s")}
#: Turns of phrase that insult or threaten, and the weight that they have before any label.
FRAMES = ("sale ¶i", "sales ¶i", "gros ¶i", "grosse ¶i", "grosses ¶i", "espece de ¶i", "bande de ¶i", "pauvre ¶i", "fils de ¶i", "es un ¶i", "es une ¶i", "qu un ¶i", "qu une ¶i", "nique ta", "niquer ta", "ta gueule", "va te faire", "vais te ¶t", "va te ¶t", "vais vous ¶t", "vont te ¶t")
PRIOR = 5.0


def restored(text: str) -> str:
    """The text in one alphabet, without marks, disguises and long repetitions."""
    t = text.replace("’", "'").replace("œ", "oe")
    if not t.isascii():
        t = _MARK.sub("", unicodedata.normalize("NFKD", t))
        if not t.isascii():
            t = _ODD.sub("", t)
            if regex.search(r"\p{IsCyrillic}|\p{IsGreek}", t):
                t = t.translate(_LOOKALIKE)
    if any(x in t for x in ".-*_•·"):
        t = _SPACED.sub(lambda m: regex.sub(r"[^\p{L}]+", "", m[0]), t)
    if any(x in t for x in "0134578@$€"):
        t = _MIXED.sub(lambda m: m[0].translate(_LEET), t)
    return _LONG.sub(r"\1", t)


def tokens(text: str, names: frozenset[str] = frozenset()) -> list[str]:
    t = restored(text)
    t = (_QUOTED.sub(" ¤ ", t) if any(x in t for x in "«“\"") else t).lower()
    if "trait" in t:
        t = _REPORTED.sub(r"\1 ¤ ", t + " ")
    t = _CONDEMNED.sub(" ", t)
    return [_NAME if w in names else "#" if w[0].isdigit() else w for w in _TOKEN.findall(t.replace("¤", " quote "))]


def sequences(words: list[str]) -> set[str]:
    """Distinct sequences of two and three words, also with classes for the lexicon's words; ends count as words."""
    w = ["^", *words, "$"]
    out = set(map(" ".join, zip(w, w[1:])))
    out.update(map(" ".join, zip(w, w[1:], w[2:])))
    if not _CLASS.keys().isdisjoint(words):
        c = [_CLASS.get(x, x) for x in w]
        out.update(map(" ".join, zip(c, c[1:])))
        out.update(map(" ".join, zip(c, c[1:], c[2:])))
    return out


def proper(texts: list[str]) -> frozenset[str]:
    """Words that the texts in mixed case nearly always capitalise inside a sentence: names of persons, things, groups."""
    up, all_ = Counter(), Counter()
    for t in texts:
        t = restored(t)
        if t.isupper() or t.islower():
            continue
        for m in regex.finditer(r"(?<=[\p{L}\p{N},;'] ?)\b\p{L}+", t):
            if m[0].isupper() and len(m[0]) > 1:
                continue
            w = m[0].lower()
            all_[w] += 1
            up[w] += m[0][0].isupper()
    return frozenset(w for w, n in all_.items() if up[w] >= 0.8 * n)


class Ordinal:
    """P(grade <= k) = sigmoid(theta_k - w x), theta increasing; the weights are shared by all thresholds."""

    def __init__(self, grades: list[int], l2: float = 7e-4, rounds: int = 300, rate: float = 0.15):
        self.grades, self.l2, self.rounds, self.rate = grades, l2, rounds, rate

    def fit(self, rows: np.ndarray, cols: np.ndarray, y: np.ndarray, n: int, d: int, prior: np.ndarray | None = None) -> Ordinal:
        prior = np.zeros(d) if prior is None else prior
        k = len(self.grades)
        freq = np.bincount(y, minlength=k).cumsum()[:-1] / n
        start = np.log(np.clip(freq, 1e-3, 1 - 1e-3) / (1 - np.clip(freq, 1e-3, 1 - 1e-3)))
        p = np.concatenate([prior, start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
        m, v = np.zeros_like(p), np.zeros_like(p)
        for step in range(1, self.rounds + 1):
            w, raw = p[:d], p[d:]
            theta = np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])
            x = np.bincount(rows, w[cols], n)
            up = np.where(y < k - 1, 1 / (1 + np.exp(-np.clip(theta[np.minimum(y, k - 2)] - x, -30, 30))), 1.0)
            lo = np.where(y > 0, 1 / (1 + np.exp(-np.clip(theta[np.maximum(y - 1, 0)] - x, -30, 30))), 0.0)
            prob = np.maximum(up - lo, 1e-9)
            du, dl = up * (1 - up) / prob, lo * (1 - lo) / prob
            gx = (du - dl) / n  # of the loss by x
            gt = -np.bincount(np.minimum(y, k - 2), np.where(y < k - 1, du, 0), k - 1) / n + np.bincount(np.maximum(y - 1, 0), np.where(y > 0, dl, 0), k - 1) / n
            tail = np.cumsum(gt[::-1])[::-1]
            g = np.concatenate([np.bincount(cols, gx[rows], d) + self.l2 * (w - prior), tail[:1], tail[1:] * np.exp(raw[1:])])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p -= self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.w, raw = p[:d], p[d:]
        self.theta = np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])
        return self

    def expected(self, x: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(-np.clip(self.theta[None, :] - np.asarray(x)[:, None], -30, 30)))
        cum = np.concatenate([np.zeros((len(below), 1)), below, np.ones((len(below), 1))], axis=1)
        return np.diff(cum, axis=1) @ np.asarray(self.grades, float)


def _design(texts: list[str], names: frozenset[str], index: dict[str, int]):
    """Rows and columns of the known sequences, in compact arrays: the texts are cut again rather than kept as sets."""
    rows, cols = array("i"), array("i")
    for i, t in enumerate(texts):
        known = [index[s] for s in sequences(tokens(t, names)) if s in index]
        rows.extend([i] * len(known))
        cols.extend(known)
    return np.frombuffer(rows, np.int32) if rows else np.zeros(0, np.int32), np.frombuffer(cols, np.int32) if cols else np.zeros(0, np.int32)


def graded(labelled: DataFrame, text: str = "content", grade: str = "CoT_score", bound: int = SAMPLE + HELD_OUT) -> pd.DataFrame:
    """(t, g) of at most ``bound`` distinct texts with a grade "n/10", those with the smallest hashes, in their order.

    The hashes of all graded texts are counted first, so that little more than ``bound`` rows go on to be sorted and sent
    to the driver, whatever the number of partitions.
    """
    g = F.try_element_at(F.regexp_extract_all(F.col(grade), F.lit(r"(\d{1,2}) ?/ ?10"), F.lit(1)), F.lit(1)).cast("int")
    rows = labelled.select(F.col(text).alias("t"), F.xxhash64(text).alias("h"), g.alias("g")).where("t IS NOT NULL AND g BETWEEN 0 AND 10")
    n = rows.select("h").distinct().count()
    if n > bound:  # a tenth and a thousand more than needed
        least = -(2**63) + int(2**64 * min(1.0, (bound * 1.1 + 1000) / n))
        rows = rows.where(F.col("h") < F.lit(min(least, 2**63 - 1)))
    return rows.groupBy("h", "t").agg(F.max("g").alias("g")).orderBy("h", "t").limit(bound).select("t", "g").toPandas()


def _flag_at(severity: np.ndarray, bad: np.ndarray, gap: tuple[int, int]) -> float:
    """Where the flag lies by held-out labels: in the middle of the places around the best one whose F1 is within a
    two-hundredth of its. Without labels of both kinds in the middle of the gap."""
    if not len(bad) or bad.all() or not bad.any():
        return sum(gap) / 2
    order = np.unique(severity)
    cuts = np.concatenate([order, [order[-1] + 1]])  # from this severity on
    f1 = np.array([2 * (bad & (severity >= c)).sum() / ((severity >= c).sum() + bad.sum()) for c in cuts])
    near = f1 >= f1.max() - 0.005
    lo = hi = int(f1.argmax())
    while lo and near[lo - 1]:
        lo -= 1
    while hi + 1 < len(cuts) and near[hi + 1]:
        hi += 1
    return float(((order[lo - 1] if lo else cuts[lo]) + cuts[hi]) / 2)  # as far down as no other message lies


def fitted(labelled: DataFrame, text: str = "content", grade: str = "CoT_score", bound: int = SAMPLE, held_out: int = HELD_OUT) -> dict | None:
    """The model as a plain dictionary: names, weights by sequence, thresholds, grades and where the flag lies.

    At most ``bound + held_out`` distinct texts with a grade go to the driver; of every five the fit sees four and the
    flag is placed on the fifth. A message is bad from the upper end of the widest gap between grades on, where the
    annotators leave one, else from half the scale on. Null without labels.
    """
    pdf = graded(labelled, text, grade, bound + held_out)
    if pdf["g"].nunique() < 2:
        return None
    apart = np.arange(len(pdf)) % 5 == 4
    if pdf["g"][~apart].nunique() < 2:
        apart[:] = False
    own, other = pdf[~apart], pdf[apart]
    texts = own["t"].tolist()
    names = proper(texts)
    counts = Counter(s for t in texts for s in sequences(tokens(t, names)))
    kept = {s for s, c in counts.most_common(FEATURES) if c >= 2} | set(FRAMES)
    del counts
    index = {s: i for i, s in enumerate(sorted(kept))}
    prior = np.zeros(len(index))
    prior[[index[f] for f in FRAMES]] = PRIOR
    grades = sorted(map(int, own["g"].unique()))
    y = own["g"].map({v: i for i, v in enumerate(grades)}).to_numpy()
    rows, cols = _design(texts, names, index)
    model = Ordinal(grades).fit(rows, cols, y, len(texts), len(index), prior)
    gap = max(zip(grades, grades[1:]), key=lambda p: (p[1] - p[0], -abs(p[0] + p[1] - 10)))
    gap = gap if gap[1] - gap[0] > 1 else (4, 6)
    weights = {s: float(model.w[i]) for s, i in index.items() if abs(model.w[i]) > 1e-4}
    out = {"names": names, "weights": weights, "model": model, "gap": gap}
    seen = model.expected(np.array([sum(weights.get(q, 0.0) for q in sequences(tokens(t, names))) for t in other["t"]], float))
    out["flag"] = _flag_at(seen, other["g"].to_numpy() >= gap[1], gap)
    said, bad = seen >= out["flag"], other["g"].to_numpy() >= gap[1]
    out["held_out"] = {"n": len(other), "hit": int((said & bad).sum()), "said": int(said.sum()), "bad": int(bad.sum())}
    return out


def _scorer(model: dict):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, names = model["weights"], model["names"]
        for s in parts:
            x = [sum(weights.get(q, 0.0) for q in sequences(tokens(t, names))) if t else 0.0 for t in s]
            yield pd.Series(model["model"].expected(np.array(x, float)) if len(x) else [], dtype=float)

    return F.pandas_udf(run, "double")


def scored(df: DataFrame, labelled: DataFrame, text: str = "content") -> DataFrame:
    """``df`` with severity (the expected grade, 0 to 10) and flagged.

    Null texts have a null severity and are not flagged; empty texts score as texts without any known sequence. Without
    labels every severity is null. All rows and columns are kept.
    """
    model = fitted(labelled)
    if model is None:
        return df.withColumn("severity", F.lit(None).cast("double")).withColumn("flagged", F.lit(False))
    severity = F.when(F.col(text).isNotNull(), _scorer(model)(F.coalesce(text, F.lit(""))))
    out = stage(df.withColumn("severity", severity), "severity")  # scored once, however often it is read
    return out.withColumn("flagged", F.coalesce(F.col("severity") >= model["flag"], F.lit(False)))


def annotated(sft: DataFrame, dpo: DataFrame) -> DataFrame:
    """(content, CoT_score): the messages with grades of both training tables; a completion holds its message's grade."""
    message = F.regexp_replace(F.regexp_replace("prompt", r"(?s)^\s*Message ?:\s*", ""), r"(?s)\s*Analyse ?:\s*$", "")
    return sft.select("content", "CoT_score").union(dpo.select(message, F.regexp_extract("completion", r"Note ?: ?\d{1,2} ?/ ?10", 0)))


def _scored(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/anonymous_forum_prioritized.parquet").select("msg_id", "topic", "content")
    return scored(df, annotated(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sft_rows", "dpo_formatted"))))


def p3_found(spark, sf_dir):
    return _scored(spark, sf_dir).where("flagged AND msg_id IS NOT NULL").select("msg_id").distinct()


def p3_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("msg_id", F.round("severity", 6).alias("severity"), "flagged")


def p3_rates(spark, sf_dir):
    """The rate of flagged messages per topic; copies of a message count once."""
    one = _scored(spark, sf_dir).withColumn("topic", account(F.col("topic"))).groupBy("msg_id", "topic").agg(F.max("flagged").alias("flagged"))
    return one.groupBy("topic").agg(F.count("*").alias("n_messages"), F.sum(F.col("flagged").cast("bigint")).alias("n_flagged")).withColumn("rate", F.round(F.col("n_flagged") / F.col("n_messages"), 6))


def p3_held_out(spark, sf_dir):
    """How the flag does on labelled messages that the fit hasn't seen."""
    model = fitted(annotated(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sft_rows", "dpo_formatted"))))
    h = model["held_out"] if model else {"n": 0, "hit": 0, "said": 0, "bad": 0}
    return spark.createDataFrame([(h["n"], h["bad"], h["said"], h["hit"], float(model["flag"]) if model else None)], "n_messages bigint, n_bad bigint, n_flagged bigint, n_both bigint, flag double")


QUERIES = {"p3_held_out": p3_held_out, "p3_found": p3_found, "p3_scores": p3_scores, "p3_rates": p3_rates}
