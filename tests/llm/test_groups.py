"""Problems 4 to 7 against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import math
import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from agoramill.llm import capping, components, formatting, overlap

FORUM = "user string, topic string, msg_id string, content string, priority_weight double, count long, n long"


def forum_rows():
    r = random.Random(3)
    rows = []
    for i in range(400):
        user = r.choice(["Anna", " anna", "ANNA ", "bob", None, "  ", f"u{i}"])
        w = r.choice([0.5, 0.5, 0.1, None, float("nan"), 2.0])
        rows.append((user, r.choice(["t1", None, f"t{i}", "T1 "]), f"m{i:04d}", "x", w, 1, 2))
    return rows + rows[:30] + [("anna", "t", None, None, 9.0, 1, 1)]


def test_cap_is_brute_force(spark):
    rows = forum_rows()
    df = spark.createDataFrame(rows, FORUM)
    one = {}
    for u, _, m, _, w, _, _ in rows:
        if m is not None:
            one[m] = ((u or "").strip().lower() or None, None if w is None or math.isnan(w) else w)
    cap = math.ceil(len(one) / 100)
    by = defaultdict(list)
    for m, (u, w) in one.items():
        if u:
            by[u].append((w is None, -(w or 0), m))
    want = {m for v in by.values() for _, _, m in sorted(v)[cap:]}
    assert {r.msg_id for r in capping.left_out(df).collect()} == want
    kept = capping.capped(df)
    assert kept.columns[0] == "msg_id" and kept.where(F.col("msg_id").isin(list(want))).count() == 0
    assert capping.left_out(df, cap=10**6).count() == 0
    assert capping.left_out(df.limit(0)).count() == 0


def test_formatting_is_brute_force(spark):
    texts = ["Bonjour à tous !", "BONJOUR, à tous", "bonjour à tous…", "bonjour a tous", "Jeu : A ; Rôle : chef", "rôle=CHEF | jeu=a", "Jeu A Rôle chef", "Jeu : A ; Rôle : tank", None, "", "?!", "!!", unicodedata.normalize("NFD", "Élève doué"), "élève doué", "가나", unicodedata.normalize("NFD", "가나"), "STRASSE", "straße", "a" * 30000, ("a " * 30000).strip()]
    rows = [(f"m{i:02d}", t, 1) for i, t in enumerate(texts)] + [("m00", texts[0], 1), (None, texts[0], 1)]
    df = spark.createDataFrame(rows, "msg_id string, content string, first long")
    got = {tuple(r) for r in formatting.copies(df).collect()}
    assert got == {("m00", "m01"), ("m00", "m02"), ("m04", "m05"), ("m04", "m06"), ("m12", "m13"), ("m14", "m15"), ("m16", "m17"), ("m18", "m19")}
    n = {r.msg_id: r.n_copies for r in formatting.collapsed(df).collect()}
    assert n["m00"] == 3 and n["m04"] == 3 and n["m03"] == 1 and "m01" not in n and len(n) == 20 - 8
    assert formatting.copies(df.limit(0)).count() == 0


def brute_components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["path", "random", "star", "none"])
def test_components_are_brute_force(spark, kind):
    r = random.Random(5)
    pairs = {"path": [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)], "random": [(f"n{r.randrange(80)}", f"n{r.randrange(80)}") for _ in range(50)], "star": [("z", f"n{i}") for i in range(40)], "none": []}[kind]
    got = {x.node: x.root for x in components.connected(spark.createDataFrame(pairs, "u string, v string")).collect()}
    assert got == brute_components(pairs)


def test_splits_incremental(spark):
    make = lambda rows: spark.createDataFrame(rows, "user string, topic string, split string, node string")
    first = make([(f"u{i}", f"t{i // 2}", "x", "y") for i in range(400)] + [(None, "t1", "", ""), ("u0", None, "", "")])
    state = components.updated(None, components.links(first), components.weights(first))
    rows = {r.node: r for r in state.collect()}
    assert len(rows) == 400 and all(rows[f"u{2 * i}"].split == rows[f"u{2 * i + 1}"].split for i in range(200))
    share = Counter(r.split for r in rows.values())
    assert abs(share["train"] - 320) <= 4 and abs(share["test"] - 40) <= 4
    by = defaultdict(list)
    for r in rows.values():
        by[r.split].append(r.node)
    a, b, c = by["train"][0], by["test"][0], by["train"][-1]
    second = make([(a, "new", "", ""), ("fresh", "new", "", ""), (b, "clash", "", ""), (c, "clash", "", ""), ("lone", None, "", "")])
    after = {r.node: r for r in components.updated(state, components.links(second), components.weights(second.union(first))).collect()}
    assert after["fresh"].split == "train" and after[b].split == after[c].split == components.QUARANTINE and after["lone"].split in components.SPLITS
    untouched = [n for n, r in rows.items() if r.root not in (rows[b].root, rows[c].root)]
    assert all(after[n].split == rows[n].split for n in untouched)
    lonely = make([(None, None, f"m{i}", "") for i in range(300)])
    out = components.assigned(first.union(lonely).withColumnRenamed("split", "msg_id").drop("node"), state)
    assert out.count() == 702 and out.where("split IS NULL").count() == 0
    alone = Counter(r.split for r in out.where("user IS NULL AND topic IS NULL").collect())
    assert len(alone) == 3 and alone["train"] > 200
    assert components.updated(None, components.links(first.limit(0)), components.weights(first.limit(0))).count() == 0


def sft_rows():
    r = random.Random(9)
    words = [f"mot{i}" for i in range(300)]
    base = [" ".join(r.choice(words) for _ in range(r.randrange(4, 30))) for _ in range(60)]
    rows = [(i, "train", t, 1) for i, t in enumerate(base)]
    for i, t in enumerate(base[:30]):
        w = t.split()
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((100 + i, r.choice(["test", "validation"]), " ".join(w).upper(), 1))
    return rows + [(200, "test", None, 1), (201, "test", "", 1), (202, "test", "!!!", 1), (203, "train", " !!! ", 1), (204, "train", base[0], 1), (0, "train", base[0], 1), (205, "test", "l'été", 1), (206, "train", "L’ÉTÉ", 1), (207, None, base[0], 1)]


@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.8])
def test_overlap_is_brute_force(spark, threshold):
    rows = sft_rows()
    df = spark.createDataFrame(rows, "row_id long, split string, content string, term long")
    cut = overlap.classes(df, "row_id", "content", "split").where("words <> ''").select("id", "train", "words", overlap.terms(F.col("words")).alias("t")).collect()
    classes, sides = {}, defaultdict(set)
    for r in cut:
        classes[r.words] = set(r.t)
        sides[r.words].add(r.train)
    n = len(classes)
    seen, where = Counter(t for k in classes.values() for t in k), defaultdict(set)
    for k, ts in classes.items():
        for t in ts:
            where[t] |= sides[k]
    w = {t: round(math.log(1 + min(n / c, overlap.RARITY)) ** 2 * 1000 * (1 if len(where[t]) == 2 else overlap.ONE_SIDED)) for t, c in seen.items()}
    norm = lambda s: sum(w[t] for t in s)
    grams = lambda x: {x[i : i + 4] for i in range(max(1, len(x) - 3))}
    want = set()
    for a in cut:
        for b in cut:
            if a.train and not b.train and a.id != b.id:
                ta, tb, ga, gb = classes[a.words], classes[b.words], grams(a.words), grams(b.words)
                cosine = norm(ta & tb) / math.sqrt(norm(ta) * norm(tb))
                if a.words == b.words or (cosine >= threshold and len(ga & gb) / len(ga | gb) >= overlap.AGREEMENT):
                    want.add((a.id, b.id))
    got = overlap.pairs(df, threshold=threshold).collect()
    assert {(r.train_id, r.other_id) for r in got} == want and len(got) == len(want)
    assert {(203, 202), (206, 205)} <= want and overlap.pairs(df.limit(0)).count() == 0


def test_overlap_report_counts_pairs(spark):
    rows = sft_rows()
    df = spark.createDataFrame([(i, s, "ab"[i % 2], t) for i, s, t, _ in rows if s], "row_id long, split string, source string, content string")
    want = defaultdict(lambda: [0, set()])
    place = {i: (s, "ab"[i % 2]) for i, s, _, _ in rows}
    for r in overlap.pairs(df).collect():
        cell = want[place[r.other_id]]
        cell[0] += 1
        cell[1].add(r.other_id)
    got = {(r.split, r.source): (r.n_pairs, r.n_rows) for r in overlap.report(df).collect()}
    assert got == {k: (n, len(v)) for k, (n, v) in want.items()}


@pytest.mark.parametrize("size", [1500, 6000])
def test_overlap_finds_typos_at_any_size(spark, size):
    r = random.Random(2)
    say = lambda: " ".join(f"k{k} v{k}x{r.randrange(30)}" for k in range(8)) + " fin"
    copied = say().split()
    typos = [w + "e" if i in (5, 11) else w for i, w in enumerate(copied)]
    rows = [(i, r.choice(["train", "test"]), say()) for i in range(size)] + [(9000, "train", " ".join(copied)), (9001, "test", " ".join(typos))]
    df = spark.createDataFrame(rows, "row_id long, split string, content string")
    assert overlap.pairs(df).where("train_id = 9000 AND other_id = 9001").count() == 1


def test_overlap_is_the_same_by_shuffles_and_blocks(spark, monkeypatch):
    df = spark.createDataFrame(sft_rows(), "row_id long, split string, content string, term long")
    want = sorted(overlap.pairs(df, threshold=0.3).collect())
    for known, block, at_once in ((0, 10**9, 4), (10**9, 50, 2), (0, 50, 1)):
        monkeypatch.setattr(overlap, "_KNOWN", known)
        monkeypatch.setattr(overlap, "_BLOCK", block)
        monkeypatch.setattr(overlap, "_AT_ONCE", at_once)
        assert sorted(overlap.pairs(df, threshold=0.3).collect()) == want
    for amounts in ([0, 3, 0, 9, 1, 1], [0, 0], [], [5]):
        parts = [amounts[s] for s in overlap._runs(overlap.np.array(amounts, dtype=int), 4)]
        assert sum(parts, []) == amounts and all(parts)


def test_overlap_shuffles_no_pairs_that_share_a_sentence(spark):
    def written(after: int) -> tuple[int, int]:
        gateway = spark.sparkContext._gateway
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        seen = [(s.stageId(), s.shuffleWriteBytes()) for s in (stages.apply(i) for i in range(stages.size()))]
        return max([after, *(i for i, _ in seen)]), sum(n for i, n in seen if i > after)

    r = random.Random(5)
    pool = [" ".join(f"s{k}m{r.randrange(1000)}" for _ in range(9)) for k in range(40)]
    rows = [(i, "train" if i % 2 else "test", ". ".join([*r.sample(pool, 4), f"fin{i}"])) for i in range(3000)]
    copied = rows[1][2]
    rows += [(9000, "test", copied + "e")]
    df = spark.createDataFrame(rows, "row_id long, split string, content string")
    last, _ = written(-1)
    got = {(p.train_id, p.other_id) for p in overlap.pairs(df).collect()}
    assert (1, 9000) in got
    assert written(last)[1] < 2 * sum(len(t) for _, _, t in rows)
