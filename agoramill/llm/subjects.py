"""Problem 10: the subject areas of each document.

Method: a multi-pattern automaton matches curated subject terms in the sentences of a document. The terms of a subject
stand in a file of its own, one a line, with a weight after a tab if it isn't 1; they are all that decides, and no text
changes the list. A term weighs its curated weight times its rarity over the sentences of all documents; a sentence deals
with the subject of the largest weight per square root of its length, and a document with every subject whose share of
sentences reaches the subject's threshold, calibrated on the hand-labelled sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoramill.functions.text import fold
from agoramill.runtime import release, stage

#: The folder of the curated terms: folded, without words of one or two letters.
TERMS = str(Path(__file__).parent / "terms")
#: The least weight per square root of the words of a sentence.
LEAST = 0.05
# What French letters become when UTF-8 is read as Latin-1, and HTML entities.
BROKEN = {"Ã©": "é", "Ã¨": "è", "Ãª": "ê", "Ã«": "ë", "Ã ": "à", "Ã ": "à", "Ã¢": "â", "Ã§": "ç", "Ã®": "î", "Ã¯": "ï", "Ã´": "ô", "Ã»": "û", "Ã¹": "ù", "Å“": "œ", "â€™": "'", "&eacute;": "é", "&egrave;": "è", "&ecirc;": "ê", "&agrave;": "à", "&ccedil;": "ç", "&ocirc;": "ô", "&icirc;": "î", "&nbsp;": " ", "&#39;": "'", "&rsquo;": "'", "&quot;": '"', "&amp;": "&"}


def repaired(c: Column) -> Column:
    fixed = c
    for a, b in BROKEN.items():
        fixed = F.replace(fixed, F.lit(a), F.lit(b))
    return F.when(c.rlike("[ÃÅâ][^ ]?|&[a-z#]"), fixed).otherwise(c)


def sentences(c: Column) -> Column:
    """The sentences of a text as strings of folded words of three letters or more, blanks around each; null if null.

    Links, tags and sentences without such a word are left out; line ends and . ! ? … end a sentence.
    """
    plain = F.regexp_replace(fold(repaired(c)), r"https?://\S+|www\.\S+|</?[A-Za-z][^>]*>|\[/?[A-Za-z]+[^\]]*\]|^[ >]+", " ")
    raw = F.filter(F.split(plain, r"[.!?…]+(?=[\s»\"')]|$)|[\n\r]+"), lambda s: s.rlike(r"[a-z]{3}"))
    return F.transform(raw, lambda s: F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(s, F.lit(r"[a-z]{3,}"), F.lit(0)), " "), F.lit(" ")))


def curated(subjects_: list[str], folder: str = TERMS) -> list[tuple[str, int, float]]:
    """(term, number of the subject, curated weight) of the subjects that have a file; the lists are the operator's
    parameter and don't depend on any text."""
    out = []
    for k, name in enumerate(subjects_):
        path = Path(folder) / f"{name}.txt"
        for line in path.read_text(encoding="utf-8").splitlines() if path.is_file() else ():
            term, _, weight = line.strip().partition("\t")
            if term:
                out.append((term, k, float(weight or 1)))
    return out


_FOUND = "sizes array<int>, terms array<int>"


def _matched(terms: list[str], keys: list[str]):
    """Documents (keys, s) to the words and matches of each sentence, two numbers a sentence, and the matched terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        places: dict[str, list[int]] = {}
        for i, term in enumerate(terms):
            places.setdefault(term, []).append(i)
        for term, own in places.items():
            automaton.add_word(f" {term} ", own)
        if terms:
            automaton.make_automaton()
        for batch in batches:
            sizes, found, edge, cut = [], [], [0], [0]
            for doc in batch.column("s").to_pylist():
                for sentence in doc or ():
                    hits = {i for _, own in automaton.iter(sentence) for i in own} if terms else ()
                    sizes += (sentence.count(" ") - 1, len(hits))
                    found += hits
                edge.append(len(sizes))
                cut.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, pa.int32())) for o, v in ((edge, sizes), (cut, found))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *lists], [*keys, "sizes", "terms"])

    return run


def rarities(found: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """The number of sentences and, of each of the ``n`` terms, of those with it: partial sums of ``n`` numbers a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = 0, np.zeros(n, np.int64)
        for batch in batches:
            total += len(batch.column("sizes").flatten()) // 2
            counts += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, n)), pa.array(np.concatenate([[total], counts]))], ["i", "n"])

    rows = found.select("sizes", "terms").mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n")).collect()
    by = {r[0]: r[1] for r in rows}
    return by.get(-1, 0), np.array([by.get(i, 0) for i in range(n)], float)


def weights(terms: list[tuple[str, int, float]], total: int, counts: np.ndarray) -> np.ndarray:
    """Curated weight times rarity: 1 for a term that no sentence has, 0 for one that all have."""
    scale = np.log(total + 2)
    return np.array([w for _, _, w in terms]) * np.log((total + 2) / (counts + 1)) / scale if terms else np.zeros(0)


def _scored(subject: np.ndarray, weight: np.ndarray, n: int, least: float):
    """Matches to counts: the sentences of each subject, then all sentences. Ties go to the subject listed first."""

    def run(sizes: pd.Series, terms: pd.Series) -> pd.Series:
        docs = np.array([len(x) // 2 for x in sizes])
        flat = (np.concatenate([np.asarray(x) for x in sizes]) if docs.sum() else np.zeros(0)).astype(np.int64).reshape(-1, 2)
        ids = (np.concatenate([np.asarray(x) for x in terms]) if flat[:, 1].sum() else np.zeros(0)).astype(np.int64)
        m = len(flat)
        at = np.repeat(np.arange(m), flat[:, 1])
        score = np.bincount(at * n + subject[ids], weight[ids], m * n).reshape(m, n) if m else np.zeros((0, n))
        best = score.argmax(1) if m else np.zeros(0, int)
        ok = score.max(1) > least * np.sqrt(np.maximum(flat[:, 0], 1)) if m else np.zeros(0, bool)
        doc = np.repeat(np.arange(len(docs)), docs)
        counts = np.bincount(doc[ok] * n + best[ok], minlength=len(docs) * n).reshape(len(docs), n)
        return pd.Series([[*map(int, row), int(k)] for row, k in zip(counts, docs)])

    return F.pandas_udf(run, "array<int>")


def calibrated(counts: DataFrame, labels: DataFrame, names: list[str], key: str = "doc_id", bound: int = 20_000, default: float = 0.25, enough: int = 20) -> list[float]:
    """For each subject the share of sentences from which a document deals with it: the threshold with the best F1 on the
    labels, of equals the nearest to ``default``.

    At most ``bound`` labelled documents (the smallest hashes of their ids) are used. A subject with fewer than ``enough``
    positive ones takes the threshold of all subjects together, and without as many labels at all it is ``default``.
    """
    some = labels.groupBy(key).agg(F.collect_set("subject").alias("true")).orderBy(F.xxhash64(key), key).limit(bound)
    rows = counts.join(F.broadcast(some), key).select("true", "c", "n").collect()
    seen = [[(r["c"][k] / r["n"], s in r["true"]) for r in rows if r["n"]] for k, s in enumerate(names)]
    grid = [x / 200 for x in range(12, 80)]

    def best(pairs: list[tuple[float, bool]], otherwise: float) -> float:
        positives = sum(y for _, y in pairs)
        if positives < enough:
            return otherwise
        f1 = {t: 2 * sum(y for x, y in pairs if x >= t) / (sum(1 for x, _ in pairs if x >= t) + positives) for t in grid}
        return min((t for t in grid if f1[t] >= max(f1.values()) - 0.002), key=lambda t: abs(t - default))

    together = best([p for pairs in seen for p in pairs], default)
    return [best(pairs, together) for pairs in seen]


def _counted(df: DataFrame, areas: DataFrame, key: str, text: str, folder: str) -> tuple[DataFrame, list[str], list[tuple[str, int, float]], np.ndarray, np.ndarray]:
    """Counts per document (key, c, n), staged, the subjects, the terms, their sentences and their weights."""
    names = sorted(r["subject"] for r in areas.where("subject IS NOT NULL").select("subject").distinct().collect())  # a closed list
    terms = curated(names, folder)
    kind = df.schema[key].dataType.simpleString()
    split = df.select(F.col(key).alias("k"), sentences(F.col(text)).alias("s"))
    found = stage(split.mapInArrow(_matched([t for t, _, _ in terms], ["k"]), f"k {kind}, {_FOUND}"), "matches")
    total, sums = rarities(found, len(terms))
    w = weights(terms, total, sums)
    n = len(names)
    subject = np.array([k for _, k, _ in terms], np.int64)
    c = found.select(F.col("k").alias(key), _scored(subject, w, max(n, 1), LEAST)("sizes", "terms").alias("c"))
    counts = stage(c.select(key, F.slice("c", 1, max(n, 1)).alias("c"), F.col("c")[max(n, 1)].alias("n")), "counts")
    release(found)
    return counts, names, terms, sums, w


def subjects(df: DataFrame, labels: DataFrame, areas: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TERMS) -> DataFrame:
    """(key, subject, share): every subject of ``areas`` that a document deals with.

    Null and blank texts, and texts without any term, deal with none; terms are French and English. Repeated rows of a
    document count once. Ties of a sentence go to the subject first by name. Subjects of ``areas`` for which there is no
    file of terms never come out.
    """
    counts, names, *_ = _counted(df, areas, key, text, folder)
    at = calibrated(counts, labels, names, key)
    share = [F.struct(F.lit(s).alias("subject"), (F.col("c")[k] / F.col("n")).alias("share"), F.lit(at[k]).alias("at")) for k, s in enumerate(names)]
    if not share:
        return counts.select(key, F.lit("").alias("subject"), F.lit(0.0).alias("share")).limit(0)
    found = counts.where("n > 0").select(key, F.explode(F.array(*share)).alias("x")).where("x.share >= x.at")
    return found.select(key, "x.subject", "x.share").dropDuplicates([key, "subject"])


def _tables(spark, sf_dir):
    return tuple(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "subject_labels", "subject_areas"))


def p10_found(spark, sf_dir):
    return subjects(*_tables(spark, sf_dir)).select("doc_id", "subject")


def p10_composition(spark, sf_dir):
    """The make-up of the corpus: documents of each subject, per source."""
    docs, labels, areas = _tables(spark, sf_dir)
    found = subjects(docs, labels, areas)
    return found.join(docs.select("doc_id", "source").dropDuplicates(["doc_id"]), "doc_id").groupBy("source", "subject").agg(F.count("*").alias("n_documents"), F.round(F.avg("share"), 6).alias("mean_share"))


def p10_terms(spark, sf_dir):
    """The whole list of terms that decides, with the sentences of each and its weight."""
    docs, _, areas = _tables(spark, sf_dir)
    _, names, terms, sums, w = _counted(docs, areas, "doc_id", "text", TERMS)
    return spark.createDataFrame([(names[k], t, int(n), round(float(x), 6)) for (t, k, _), n, x in zip(terms, sums, w)], "subject string, term string, n_sentences bigint, weight double")


QUERIES = {"p10_found": p10_found, "p10_composition": p10_composition, "p10_terms": p10_terms}
