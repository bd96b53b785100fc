"""Problem 9: fill containers of fixed capacity with the texts of a corpus, measured in tokens.

Method: non-negative least squares. Combinations of lengths that fill a window below the capacity are enumerated from the
histogram of lengths, as deep as the lengths demand: every draw of lengths is closed at each depth by the longest that
still fits. The repeat counts of these patterns are solved against the histogram and rounded to the nearest, the largest
first, up to the solved total; what is left of the histogram is solved again while that places enough, and the residuals
are packed greedily (best fit, longest first). All of that handles only counts: the histogram has at most ``capacity``
rows and a round at most ``PATTERNS`` patterns, whatever the corpus; the bound shapes the fill and drops no item.
Documents then take the places of their length by their exact rank in a global order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agoramill.llm.tokenizing import token_counts
from agoramill.runtime import stage

CAPACITY = 2048
#: Patterns of a round, its draws, and the number of rounds, documented parameters.
PATTERNS, DRAWS, ROUNDS = 20_000, 6_000, 12


def combinations(counts: dict[int, int], capacity: int, window: int, seed: int = 0) -> list[tuple[int, ...]]:
    """Multisets of lengths with a sum in [capacity - window, capacity], none with more of a length than there are.

    Lengths are drawn in proportion to their counts; each draw is closed at every depth, if a length lies in the window
    of the room that is left. Fullest patterns first, at most ``PATTERNS``.
    """
    lengths = np.array(sorted(counts))
    if not len(lengths):
        return []
    weight = np.array([counts[v] for v in lengths], float)
    upto = np.concatenate([[0.0], np.cumsum(weight)])
    r = np.random.default_rng(seed)
    found: set[tuple[int, ...]] = {(int(v),) for v in lengths if capacity - window <= v <= capacity}
    room = np.full(DRAWS, capacity)
    drawn: list[np.ndarray] = []
    alive = np.arange(DRAWS)
    while len(alive) and len(found) < PATTERNS:
        fits = np.searchsorted(lengths, room[alive], side="right")
        alive = alive[fits > 0]
        fits = fits[fits > 0]
        closing = lengths[fits - 1]
        for i in np.flatnonzero(room[alive] - closing <= window):
            found.add(tuple(sorted((*(int(d[alive[i]]) for d in drawn), int(closing[i])), reverse=True)))
        pick = lengths[np.minimum(np.searchsorted(upto, r.random(len(alive)) * upto[fits], side="right") - 1, fits - 1)]
        step = np.zeros(DRAWS, int)
        step[alive] = pick
        drawn.append(step)
        room[alive] -= pick
        alive = alive[room[alive] >= lengths[0]]
    possible = [c for c in found if all(counts[v] >= c.count(v) for v in set(c))]
    return sorted(possible, key=lambda c: (-sum(c), c))[:PATTERNS]


def repeats(patterns: list[tuple[int, ...]], counts: dict[int, int], rounds: int = 300) -> np.ndarray:
    """x >= 0 that brings the patterns' lengths close to the histogram: multiplicative updates of the least squares."""
    if not patterns:
        return np.zeros(0)
    index = {v: i for i, v in enumerate(sorted(counts))}
    rows = np.array([index[v] for p in patterns for v in p])
    cols = np.array([j for j, p in enumerate(patterns) for _ in p])
    h = np.array([counts[v] for v in sorted(counts)], float)
    x = np.full(len(patterns), h.sum() / max(len(rows), 1))
    target = np.bincount(cols, h[rows], len(patterns))
    for _ in range(rounds):
        now = np.bincount(rows, x[cols], len(h))
        x *= target / np.maximum(np.bincount(cols, now[rows], len(patterns)), 1e-12)
    return x


def solved(left: dict[int, int], capacity: int) -> dict[tuple[int, ...], int]:
    """(pattern to repeats) of the rounded solutions; ``left`` keeps what they don't place."""
    out: dict[tuple[int, ...], int] = {}
    for k in range(ROUNDS):
        items = sum(left.values())
        window = (0, 0, 1, 2)[k] if k < 4 else max(2, capacity // 256)
        patterns = combinations(left, capacity, min(window, capacity // 64), k)
        x = repeats(patterns, left)
        budget = round(float(x.sum()))
        for j in np.argsort(-x, kind="stable"):
            if budget <= 0:
                break
            p = patterns[j]
            n = min(max(1, round(float(x[j]))), budget, *(left.get(v, 0) // p.count(v) for v in set(p)))
            if n > 0:
                out[p] = out.get(p, 0) + n
                budget -= n
                for v in p:
                    left[v] -= n
        for v in [v for v, n in left.items() if n <= 0]:
            del left[v]
        if k >= 4 and items - sum(left.values()) < items * 0.02:
            break
    return out


def greedy(left: dict[int, int], capacity: int) -> dict[tuple[int, ...], int]:
    """The longest item opens containers, the longest that fit fill them; equal containers go together."""
    import bisect

    out: dict[tuple[int, ...], int] = {}
    order = sorted(left)
    while order:
        top = order[-1]
        pattern, room = [top], capacity - top
        use = {top: 1}
        while True:
            j = bisect.bisect_right(order, room) - 1
            while j >= 0 and left[order[j]] - use.get(order[j], 0) <= 0:
                j -= 1
            if j < 0:
                break
            v = order[j]
            k = min(room // v, left[v] - use.get(v, 0))
            pattern += [v] * k
            use[v] = use.get(v, 0) + k
            room -= v * k
        n = max(1, min(left[v] // k for v, k in use.items()))
        key = tuple(pattern)
        out[key] = out.get(key, 0) + n
        for v, k in use.items():
            left[v] -= n * k
        order = [v for v in order if left[v] > 0]
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int, bool]]:
    """(pattern, number of containers, whether solved) that place every item of the histogram (length to count)."""
    left = {int(v): int(n) for v, n in histogram.items() if n > 0 and v > 0}
    first = solved(left, capacity)
    second = greedy({v: n for v, n in left.items() if n > 0}, capacity)
    order = lambda t: (-sum(t[0]), t[0])
    return [(p, n, True) for p, n in sorted(first.items(), key=order)] + [(p, n, False) for p, n in sorted(second.items(), key=order)]


def _placed(slots: list[tuple[int, int, int, bool]]):
    """(tokens, rank) to (container, solved): the slot (tokens, first rank, container of that rank) found by bisection."""
    tokens, lo, base, ok = (np.array(x, np.int64) for x in zip(*slots)) if slots else (np.zeros(0, np.int64),) * 4
    length = np.unique(tokens)
    edges = np.searchsorted(tokens, length)

    def run(t: pd.Series, r: pd.Series) -> pd.DataFrame:
        t, r = t.to_numpy(np.int64), r.to_numpy(np.int64)
        container, flag = np.full(len(t), -1, np.int64), np.zeros(len(t), bool)
        for v in np.unique(t):
            k = np.searchsorted(length, v)
            if v <= 0 or k >= len(length) or length[k] != v:
                continue
            end = edges[k + 1] if k + 1 < len(edges) else len(tokens)
            own = np.flatnonzero(t == v)
            at = edges[k] + np.searchsorted(lo[edges[k] : end], r[own], side="right") - 1
            container[own], flag[own] = base[at] + r[own] - lo[at], ok[at]
        return pd.DataFrame({"container": pd.array(np.where(container >= 0, container, 0), "Int64"), "solved": flag})

    return F.pandas_udf(run, "container bigint, solved boolean")


def packed(sizes: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """(key, part, tokens, container): the container of every item of ``sizes`` (key, tokens).

    An item of up to the capacity has one part; a larger one is cut into full parts, each a container of its own, and
    a last part that is packed like the others. Items of size zero or null need no room: their container is null.
    Repeated rows are items of their own. Containers are numbered from 0; an empty table gives no rows.
    """
    return _planned(sizes, capacity, key).select(key, "part", "tokens", "container")


def _planned(sizes: DataFrame, capacity: int, key: str) -> DataFrame:
    spark = sizes.sparkSession
    n = F.coalesce(F.col("tokens"), F.lit(0)).cast("bigint")
    full, rest = F.floor(n / capacity).cast("int"), (n % capacity).cast("int")
    none = F.array().cast("array<struct<part:int,tokens:int>>")
    whole = F.when(full > 0, F.transform(F.sequence(F.lit(1), full), lambda i: F.struct((i - 1).cast("int").alias("part"), F.lit(capacity).alias("tokens")))).otherwise(none)
    last = F.when((rest > 0) | (full == 0), F.array(F.struct(full.alias("part"), rest.alias("tokens")))).otherwise(none)
    items = stage(sizes.select(F.col(key), F.explode(F.concat(whole, last)).alias("x")).select(key, "x.part", "x.tokens"), "sizes")
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["tokens", key, "part"]
    placed = stage(items.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "items")
    placed = placed.withColumn("p", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    # rows of each (partition, length): at most one row per partition and length, and lengths are at most the capacity
    cells = placed.groupBy("p", "tokens").agg(F.count("*").alias("n"), F.min("at").alias("lo"))
    histogram = {r["tokens"]: r["n"] for r in cells.groupBy("tokens").agg(F.sum("n").alias("n")).collect()}
    slots, base, used = [], 0, {}
    for pattern, times, ok in plan(histogram, capacity):
        for v in pattern:
            slots.append((v, used.get(v, 0), base, ok))
            used[v] = used.get(v, 0) + times
        base += times
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tokens").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cells.withColumn("start", before - F.col("lo")).select("p", "tokens", "start")
    ranked = placed.join(F.broadcast(starts), ["p", "tokens"]).withColumn("rank", F.col("at") + F.col("start"))
    found = ranked.withColumn("x", _placed(sorted(slots))("tokens", "rank"))
    return found.select(key, "part", "tokens", F.when(F.col("tokens") > 0, F.col("x.container")).alias("container"), F.col("x.solved").alias("solved"))


def _sizes(spark, sf_dir):
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])


def p9_containers(spark, sf_dir):
    """Every part of every document with its container of 2,048 tokens."""
    return packed(_sizes(spark, sf_dir))


def p9_fill(spark, sf_dir):
    """Containers, tokens, the share of room used, the least number of containers that could hold the tokens, and the
    share of the items that the solved patterns place."""
    items = _planned(_sizes(spark, sf_dir), CAPACITY, "doc_id").where("container IS NOT NULL")
    per = items.groupBy("container").agg(F.sum("tokens").alias("used"), F.count("*").alias("n"), F.count_if("solved").alias("s"))
    return per.agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("max_used"), F.round(F.sum("used") / F.count("*") / CAPACITY, 6).alias("fill"), F.ceil(F.sum("used") / CAPACITY).alias("least_containers"), F.round(F.sum("s") / F.sum("n"), 4).alias("solved"))


QUERIES = {"p9_containers": p9_containers, "p9_fill": p9_fill}
