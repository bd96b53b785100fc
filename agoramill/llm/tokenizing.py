"""Problem 8: encode the corpus with a public byte-level BPE vocabulary.

Method: texts are split into words by the vocabulary's pattern inside the JVM; every distinct word is encoded once, by
folding ranked merges over its bytes with Spark's higher-order functions and a literal rank map. The literal map is kept
as an array of small maps, found by the CRC of the bytes, because a lookup in one literal map of 50,000 entries scans it.
The ids come back to the texts in place: the most frequent words, as many as fit into ``BROADCAST_BYTES``, are broadcast
and looked up in Arrow batches; only words outside this head are exploded and joined by a shuffle. Decoding concatenates
the binary pieces of the ids. Words of more than ``LONG`` bytes (runs of signs or blanks) are merged with a heap in an
Arrow function instead, since the fold takes time quadratic in the length; both ways give the same ids.
"""

from __future__ import annotations

import base64
import functools
import heapq
import importlib.util
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agoramill.runtime import release, stage

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits texts before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 4096
LONG = 48
BROADCAST_BYTES = 32 << 20


def vocabulary_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    """The file's place: in ``folder``, else AGORAMILL_TOKENIZERS, else the installed package, else /opt/tokenizers."""
    folder = folder or os.environ.get("AGORAMILL_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


@functools.lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _rank_map(path: str) -> Column:
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks(path).items():
        h = piece.hex().upper()
        buckets[zlib.crc32(h.encode()) % BUCKETS][h] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def merged_ids(word: Column, path: str) -> Column:
    """The ids of one word, all within higher-order functions."""
    none = F.lit(2**31 - 1)

    def fold(m: Column) -> Column:
        def rank(h: Column) -> Column:
            return F.try_element_at(F.element_at(m, (F.crc32(h.cast("binary")) % BUCKETS + 1).cast("int")), h)

        def step(acc: Column) -> Column:
            pieces = acc["pieces"]
            pairs = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda j: F.struct(F.coalesce(rank(F.concat(F.element_at(pieces, j), F.element_at(pieces, j + 1))), none).alias("r"), j.alias("j")))

            def merge(best: Column) -> Column:
                j = best["j"]
                joined = F.concat(F.slice(pieces, F.lit(1), j - 1), F.array(F.concat(F.element_at(pieces, j), F.element_at(pieces, j + 1))), F.slice(pieces, j + 2, F.size(pieces)))
                return F.when(best["r"] < none, F.struct(joined.alias("pieces"), (F.size(pieces) > 2).alias("go"))).otherwise(F.struct(pieces.alias("pieces"), F.lit(False).alias("go")))

            return F.transform(F.array(F.array_min(pairs)), merge)[0]

        h = F.hex(F.encode(word, "UTF-8"))
        n = F.length(h) / 2
        start = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.substring(h, i * 2 - 1, 2))
        folded = F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int") - 1, F.lit(1))), F.struct(start.alias("pieces"), (n > 1).alias("go")), lambda acc, _: F.when(acc["go"], step(acc)).otherwise(acc), lambda acc: F.transform(acc["pieces"], rank))
        return F.when(rank(h).isNotNull(), F.array(rank(h))).otherwise(folded)

    return F.transform(F.array(_rank_map(path)), fold)[0]


def heap_ids(word: bytes, table: dict[bytes, int]) -> list[int]:
    """The same merges with a heap over a linked list, for long words."""
    if word in table:
        return [table[word]]
    n = len(word)
    piece: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(table[r], i, piece[i] + piece[i + 1]) for i in range(n - 1) if (r := piece[i] + piece[i + 1]) in table]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = right[i]
        if piece[i] is None or j < 0 or piece[i] + piece[j] != both:
            continue
        piece[i], piece[j] = both, None
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for a in (left[i], i):
            b = right[a] if a >= 0 else -1
            if b >= 0 and (pair := piece[a] + piece[b]) in table:
                heapq.heappush(heap, (table[pair], a, pair))
    return [table[p] for p in piece if p is not None]


def _long_ids(table: dict[bytes, int]):
    """Travels with its table, so executors need no vocabulary file."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda w: heap_ids(w.encode(), table))

    return F.pandas_udf(run, "array<int>")


def words(text: Column) -> Column:
    """The words of a text, blanks included; joined they are the text again."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0))


def dictionary(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(word, n, ids) of every distinct word of the column, staged."""
    path = path or vocabulary_path()
    counted = df.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counted = stage(counted, "words")
    short = counted.where(F.octet_length("word") <= LONG).withColumn("ids", merged_ids(F.col("word"), path))
    long = counted.where(F.octet_length("word") > LONG).withColumn("ids", _long_ids(ranks(path))("word"))
    both = stage(short.unionByName(long), "dictionary")
    release(counted)
    return both


def head(dic: DataFrame) -> tuple[pa.Table, int]:
    """The most frequent words of a dictionary, at most ``BROADCAST_BYTES`` of them, and the least count of a word in it
    (0: the dictionary is whole). The cut lies at a power of two, found from at most 64 sums."""
    size = F.octet_length("word") + F.size("ids") * 4 + 16
    level = F.floor(F.log2("n")).cast("int")
    sums = {r[0]: r[1] for r in dic.groupBy(level.alias("level")).agg(F.sum(size)).collect()}
    taken, least = 0, 0
    for k in sorted(sums, reverse=True):
        taken += sums[k]
        if taken > BROADCAST_BYTES:
            least = 2 ** (k + 1)
            break
    return dic.where(F.col("n") >= least).select("word", "ids").toArrow(), least


def _looked_up(known, names: list[str], counts: bool):
    """Arrow batches of (..., words) to (..., ids or tokens, missing): the words' ids in order, and the words unknown to
    the head with the number of tokens before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.ipc.open_stream(known.value).read_all().combine_chunks()
        words = table.column("word").combine_chunks() if table.num_rows else pa.array([], pa.string())
        lists = table.column("ids").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
        starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        sizes = np.diff(starts)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("words")
            texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
            per_row = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = pc.index_in(pc.list_flatten(texts).cast(words.type), value_set=words)
            at = pc.fill_null(found, -1).to_numpy(zero_copy_only=False)
            n = np.where(at >= 0, sizes[at] if len(sizes) else 0, 0).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(n)])
            edge = np.concatenate([[0], np.cumsum(per_row)])
            bounds = ends[edge]
            rest = np.flatnonzero(at < 0)
            row = np.searchsorted(edge, rest, side="right") - 1
            missing = pa.StructArray.from_arrays([pa.array((ends[rest] - bounds[row]).astype(np.int32)), pa.array(np.arange(len(rest), dtype=np.int32)), pc.list_flatten(texts).take(pa.array(rest))], ["at", "nth", "word"])
            left = pa.ListArray.from_arrays(pa.array(np.searchsorted(rest, edge).astype(np.int32)), missing)
            if counts:
                out = pa.array(np.diff(bounds).astype(np.int32))
            else:
                steps = np.arange(ends[-1]) - np.repeat(ends[:-1], n)
                ids = flat[np.repeat(starts[:-1][at] if len(sizes) else at, n) + steps] if ends[-1] else np.zeros(0, np.int32)
                out = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), out, left], [*names, "out", "missing"])

    return run


def _resolved(df: DataFrame, keys: list[str], text: str, path: str | None, counts: bool) -> DataFrame:
    """(keys, out): the ids or their number for every row of ``df``."""
    spark = df.sparkSession
    dic = dictionary(df, text, path)
    table, least = head(dic)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    known = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    names = ["__row", *[f"__k{i}" for i in range(len(keys))]]
    rows = df.select(F.monotonically_increasing_id().alias("__row"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], words(F.col(text)).alias("words"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    first = rows.mapInArrow(_looked_up(known, names, counts), f"{kinds}, out {'int' if counts else 'array<int>'}, missing array<struct<at:int,nth:int,word:string>>")
    back = [F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)]
    if not least:
        return first.select(*back, "out")
    first = stage(first, "looked-up")
    tail = dic.where(F.col("n") < least).select("word", "ids")
    each = first.select("__row", F.explode("missing").alias("m")).select("__row", "m.at", "m.nth", "m.word").join(tail, "word")  # rare words only: none is hot
    if counts:
        more = each.groupBy("__row").agg(F.sum(F.size("ids")).cast("int").alias("more"))
        whole = F.col("out") + F.coalesce("more", F.lit(0))
    else:
        more = each.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("at", "nth", "ids"))).alias("more"))
        start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("at"))
        step = lambda acc, m: F.struct(F.concat(acc["ids"], F.slice("out", acc["at"] + 1, m["at"] - acc["at"]), m["ids"]).alias("ids"), m["at"].alias("at"))
        end = lambda acc: F.concat(acc["ids"], F.slice("out", acc["at"] + 1, F.size("out") - acc["at"]))
        whole = F.when(F.col("more").isNull(), F.col("out")).otherwise(F.aggregate("more", start, step, end))
    incomplete = first.where(F.size("missing") > 0).join(more, "__row", "left").select(*back, whole.alias("out"))
    return first.where(F.size("missing") == 0).select(*back, "out").union(incomplete)


def encoded(df: DataFrame, keys: list[str], text: str = "text", path: str | None = None, out: str = "ids") -> DataFrame:
    """``keys`` of every row of ``df`` and the token ids of its text, as a list of integers without special tokens.

    A null text and an empty text both have the empty list. Every row comes out once, also repeated ones; keys may be
    null or repeat. Texts don't leave their partition unless they hold words outside the dictionary's head.
    """
    return _resolved(df, keys, text, path, False).select(*keys, F.col("out").alias(out))


def token_counts(df: DataFrame, keys: list[str], text: str = "text", path: str | None = None, out: str = "tokens") -> DataFrame:
    """``keys`` of every row and the number of its token ids, without making them; 0 for null and empty texts."""
    return _resolved(df, keys, text, path, True).select(*keys, F.col("out").alias(out))


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of a list of ids: their binary pieces, concatenated and read as UTF-8."""
    table = {r: p.hex().upper() for p, r in ranks(path or vocabulary_path()).items()}
    pieces = F.from_json(F.lit(json.dumps([table.get(i, "") for i in range(max(table) + 1)])), "array<string>")
    return F.decode(F.unhex(F.transform(F.array(pieces), lambda m: F.array_join(F.transform(ids, lambda i: F.element_at(m, i + 1)), ""))[0]), "UTF-8")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def p8_ids(spark, sf_dir):
    return encoded(_documents(spark, sf_dir), ["doc_id"])


def p8_lengths(spark, sf_dir):
    """How much of the corpus the heap handles: words and occurrences of more than 48 bytes."""
    all_ = _documents(spark, sf_dir).select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    long = (F.octet_length("word") > LONG).cast("bigint")
    return all_.agg(F.count("*").alias("n_words"), F.sum(long).alias("n_long"), F.sum("n").alias("n_occurrences"), F.sum(long * F.col("n")).alias("n_long_occurrences"))


def p8_roundtrip(spark, sf_dir):
    """The number of documents, of tokens, and of documents whose ids decode to another text."""
    ids = encoded(_documents(spark, sf_dir), ["doc_id", "text"])
    wrong = decoded(F.col("ids")) != F.coalesce("text", F.lit(""))
    return ids.agg(F.count("*").alias("n_documents"), F.sum(F.size("ids")).alias("n_tokens"), F.sum(wrong.cast("bigint")).alias("n_wrong"))


QUERIES = {"p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip, "p8_lengths": p8_lengths}
