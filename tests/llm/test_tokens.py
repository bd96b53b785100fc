"""Problems 8 and 9: exact ids and round trips, containers that hold everything."""

import os
import random

import pytest
from pyspark.sql import functions as F

from agoramill.llm import packing, tokenizing

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizing.vocabulary_path()), reason="no vocabulary file")

TEXTS = [None, "", " ", "Bonjour à tous !", "l'été 2024 :\n\n  fin  ", "😂🙄 ok", "=" * 300, "a" * 200 + " b", "don't we'll", "\t\x1c\xa0x", "élève ", "中文字", "mot " * 3000]


def reference(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizing.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_ids_are_exact(spark, monkeypatch, limit):
    monkeypatch.setattr(tokenizing, "BROADCAST_BYTES", limit)  # 0: the joining way
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "z"), (None, "x", "z")], "doc_id long, text string, ids string")
    rows = tokenizing.encoded(df, ["doc_id"]).collect()
    assert len(rows) == len(TEXTS) + 2
    got = {r.doc_id: r.ids for r in rows}
    assert [got[i] for i in range(len(TEXTS))] == reference(TEXTS)
    assert tokenizing.encoded(df.limit(0), ["doc_id"]).count() == 0


def test_round_trip_and_heap(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS[1:]], "text string")
    back = tokenizing.encoded(df, ["text"]).select("text", tokenizing.decoded(F.col("ids")).alias("b")).collect()
    assert all(r.text == r.b for r in back)
    table = tokenizing.ranks(tokenizing.vocabulary_path())
    r = random.Random(2)
    words = ["".join(r.choice("abcdé €") for _ in range(r.randrange(1, 30))) for _ in range(60)]
    folded = spark.createDataFrame([(w,) for w in words], "w string").select("w", tokenizing.merged_ids(F.col("w"), tokenizing.vocabulary_path()).alias("i")).collect()
    assert all(x.i == tokenizing.heap_ids(x.w.encode(), table) for x in folded)


def test_plan_places_everything():
    r = random.Random(1)
    for cap, n in ((100, 500), (2048, 3000), (10, 40), (7, 0)):
        h = {}
        for _ in range(n):
            v = min(cap, 1 + int(r.expovariate(4 / cap)))
            h[v] = h.get(v, 0) + 1
        got = {}
        containers = 0
        for pattern, times, _ in packing.plan(h, cap):
            assert sum(pattern) <= cap and times > 0
            containers += times
            for v in pattern:
                got[v] = got.get(v, 0) + times
        assert got == h
        if n >= 3000:
            assert sum(len(p) * k for p, k, ok in packing.plan(h, cap) if ok) >= 0.5 * n
        if n >= 500:
            assert containers <= 1.03 * sum(v * c for v, c in h.items()) / cap + 1


def test_packed(spark):
    r = random.Random(7)
    sizes = [(i, r.choice([0, None, 5, 64, 65, 200, r.randrange(1, 64)]), "z") for i in range(500)] + [(1, 30, "z"), (1, 30, "z")]
    df = spark.createDataFrame(sizes, "doc_id long, tokens int, container string")
    rows = packing.packed(df, 64).collect()
    fill = {}
    for x in rows:
        if x.container is None:
            assert x.tokens == 0
        else:
            fill[x.container] = fill.get(x.container, 0) + x.tokens
    assert max(fill.values()) <= 64 and sorted(fill) == list(range(len(fill)))
    assert sum(fill.values()) == sum(s or 0 for _, s, _ in sizes)
    assert {x.doc_id for x in rows} == set(range(500))
    small = {i for i, s, _ in sizes if s and s <= 64 and i != 1}
    assert all(sum(1 for x in rows if x.doc_id == i) == 1 for i in list(small)[:50])
    assert packing.packed(df.limit(0), 64).count() == 0
