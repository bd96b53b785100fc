"""Problem 7: splits that keep connected records together.

Method: a persisted table (node, root, split) is brought up to date with a batch of links. The links are mapped to the
roots they already have, roots hook onto their smallest neighbour, pointer jumping flattens the hooks, and the contracted
graph goes round again until no link is left. Existing components keep their split, new ones fill the deficits, and a
merge of components of different splits is quarantined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoramill.llm.capping import account
from agoramill.runtime import release, salted_join, stage

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
QUARANTINE = "quarantine"
STATE = "node string, root string, split string"


def links(df: DataFrame, left: str = "user", right: str = "topic") -> DataFrame:
    """(u, v): every account and the smallest account of each of its topics; an account without a topic links to itself.

    Null or blank values connect nothing. The pairs (account, topic) are made distinct before anything is shuffled by
    topic, and a hot topic is spread over salts.
    """
    pairs = stage(df.select(account(F.col(left)).alias("u"), account(F.col(right)).alias("t")).where(F.col("u").isNotNull()).distinct(), "pairs")
    hubs = pairs.where(F.col("t").isNotNull()).groupBy("t").agg(F.min("u").alias("v"), F.count("*").alias("n"))
    total = pairs.count()
    joined = salted_join(pairs.where(F.col("t").isNotNull()), hubs, "t", "n", total, F.col("u")).select("u", "v")
    return joined.union(pairs.select("u", F.col("u").alias("v"))).distinct()


def _flat(hooks: DataFrame) -> DataFrame:
    """Pointer jumping: every a points to the root of its tree."""
    now = stage(hooks, "hooks")
    while True:
        up = now.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        new = stage(now.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "hooks")
        release(now)
        now = new
        if now.where("moved").limit(1).count() == 0:
            return now


#: Roots that change in a round up to which their map is broadcast; beyond, they are joined by a shuffle.
_FEW = 200_000


def _relabelled(df: DataFrame, col: str, moved: DataFrame, few: bool) -> DataFrame:
    """``df`` with ``col`` brought to its new root; ``moved`` (a, p) holds only roots that change. While they are few no
    row of ``df`` leaves its place, however many hang on one root."""
    to = moved.select(F.col("a").alias(col), F.col("p").alias("__p"))
    return df.join(F.broadcast(to) if few else to, col, "left").withColumn(col, F.coalesce("__p", col)).drop("__p")


def connected(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node connected with each node of the pairs (u, v). A staged table."""
    comp = stage(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().withColumn("root", F.col("node")), "roots")
    edges = stage(pairs.where("u <> v").select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")).distinct(), "edges")
    while edges.limit(1).count():
        both = edges.select(F.col("x").alias("a"), F.col("y").alias("b")).union(edges.select("y", "x"))
        flat = _flat(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")))
        moved = flat.where("a <> p").select("a", "p")
        few = moved.count() <= _FEW
        new = stage(_relabelled(_relabelled(edges, "x", moved, few), "y", moved, few).where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
        comp2 = stage(_relabelled(comp, "root", moved, few), "roots")
        for t in (edges, comp, flat):
            release(t)
        edges, comp = new, comp2
    return comp


def _assigned(sizes: DataFrame, filled: dict[str, int], proportions: dict[str, float], total: int) -> DataFrame:
    """(root, split) for new components (root, n): the large ones to the split with the largest deficit, one by one; the
    small ones, ordered by a hash, along the remaining deficits by exact prefix sums."""
    spark = sizes.sparkSession
    names = list(proportions)
    need = {s: proportions[s] * total - filled.get(s, 0) for s in names}
    large = sizes.where(F.col("n") * 1000 > total)  # fewer than 1000
    picks = []
    for root, n in sorted(((r["root"], r["n"]) for r in large.collect()), key=lambda x: (-x[1], x[0])):
        s = max(names, key=lambda k: (need[k], -names.index(k)))
        need[s] -= n
        picks.append((root, s))
    small = sizes.where(F.col("n") * 1000 <= total).withColumn("h", F.sha2("root", 256))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = stage(small.repartitionByRange(parts, "h", "root").sortWithinPartitions("h", "root").withColumn("at", F.monotonically_increasing_id()), "placed")
    placed_part = placed.withColumn("part", F.shiftright("at", 33))
    sums = {r[0]: r[1] for r in placed_part.groupBy("part").agg(F.sum("n")).collect()}  # one row per partition
    offset, at = [], 0
    for p in sorted(sums):
        offset.append((p, at))
        at += sums[p]
    room = {s: max(0.0, need[s]) for s in names}
    scale = at / (sum(room.values()) or 1.0)
    bounds, edge = [], 0.0
    for s in names:
        edge += room[s] * scale
        bounds.append((edge, s))
    from pyspark.sql import Window

    w = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pos = placed_part.join(F.broadcast(spark.createDataFrame(offset, "part int, o bigint")), "part").withColumn("end", F.sum("n").over(w) + F.col("o"))
    choice: Column = F.lit(bounds[-1][1])
    for e, s in reversed(bounds[:-1]):
        choice = F.when(F.col("end") - F.col("n") / 2 <= e, s).otherwise(choice)
    return pos.select("root", choice.alias("split")).union(spark.createDataFrame(picks, "root string, split string"))


def updated(state: DataFrame | None, pairs: DataFrame, weights: DataFrame, proportions: dict[str, float] | None = None) -> DataFrame:
    """The state (node, root, split) after a batch of links (u, v).

    ``weights`` (node, n) are the records of each node, by which proportions are measured. A component that joins old
    ones of one split keeps it; of several, all its nodes get the split ``quarantine``; without an old one it fills the
    largest deficit. Roots are the smallest nodes. A batch without rows returns the state. The state can be written
    and passed again with the next batch.
    """
    spark = pairs.sparkSession
    proportions = proportions or SPLITS
    old = state if state is not None else spark.createDataFrame([], STATE)
    known = old.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    mapped = pairs
    if state is not None:
        for c in ("u", "v"):
            mapped = mapped.join(known, F.col(c) == F.col("__n"), "left").withColumn(c, F.coalesce("__r", c)).drop("__n", "__r")
    top = connected(mapped)
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    if state is not None:
        nodes = old.select("node", "root").union(nodes.join(old, "node", "left_anti").withColumn("root", F.col("node")))
    else:
        nodes = nodes.withColumn("root", F.col("node"))
    moved = top.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("p"))
    few = moved.count() <= _FEW
    all_nodes = stage(_relabelled(nodes, "root", moved, few).select("node", "root"), "nodes")
    before = _relabelled(old.select("root", "split").distinct(), "root", moved, few)
    kept = before.groupBy("root").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).select("root", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(QUARANTINE).alias("split"))
    sized = stage(all_nodes.join(weights, "node", "left").groupBy("root").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.count("*").alias("m")).join(kept, "root", "left"), "sized")
    totals = {r["split"]: r["n"] for r in sized.groupBy("split").agg(F.sum("n").alias("n")).collect()}  # one row per split
    total = sum(n for s, n in totals.items() if s != QUARANTINE)
    fresh = _assigned(sized.where(F.col("split").isNull()).select("root", "n"), totals, proportions, total)
    splits = sized.where(F.col("split").isNotNull()).select("root", "split").union(fresh)
    release(top)
    # a component may hold most of the nodes: its nodes are spread over salts
    return salted_join(all_nodes, splits.join(sized.select("root", "m"), "root"), "root", "m", all_nodes.count(), F.col("node")).select("node", "root", "split")


def weights(df: DataFrame, left: str = "user") -> DataFrame:
    return df.groupBy(account(F.col(left)).alias("node")).agg(F.count("*").alias("n")).where(F.col("node").isNotNull())


def assigned(df: DataFrame, state: DataFrame, left: str = "user", right: str = "topic", proportions: dict[str, float] | None = None, key: str = "msg_id") -> DataFrame:
    """``df`` with its split. A row without an account takes that of its topic's accounts, one whose topic has none that
    of the topic's hash; a row without both is alone and takes one by the hash of its key, so copies of it agree."""
    names = proportions or SPLITS
    a, t = account(F.col(left)), account(F.col(right))
    rows = df.withColumn("__a", a).withColumn("__t", t)
    by_node = state.select(F.col("node").alias("__a"), F.col("split").alias("__s1"))
    topics = rows.where("__a IS NOT NULL AND __t IS NOT NULL").select("__a", "__t").distinct().join(by_node, "__a").groupBy("__t").agg(F.min("__s1").alias("__s2"))
    own = F.coalesce(F.concat(F.lit("t:"), F.col("__t")), F.concat(F.lit("k:"), F.col(key).cast("string")), F.lit(""))
    u, edge, choice = F.pmod(F.xxhash64(own, F.lit(7)), F.lit(10**6)) / 1e6, 1.0, F.lit(list(names)[-1])
    for s in reversed(list(names)[:-1]):
        edge -= names[list(names)[list(names).index(s) + 1]]
        choice = F.when(u < edge, s).otherwise(choice)
    n = rows.groupBy("__a").count().where("__a IS NOT NULL").withColumnRenamed("count", "__n")
    total = df.count()
    with_account = salted_join(rows.where("__a IS NOT NULL"), by_node.join(n, "__a"), "__a", "__n", total, F.col("__t")).withColumnRenamed("__s1", "split")
    rest = rows.where("__a IS NULL AND __t IS NOT NULL").join(topics, "__t", "left").withColumn("split", F.coalesce("__s2", choice)).drop("__s2")
    alone = rows.where("__a IS NULL AND __t IS NULL").withColumn("split", choice)
    return with_account.unionByName(rest).unionByName(alone).drop("__a", "__t")


def p7_found(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/anonymous_forum_prioritized.parquet")
    state = updated(None, links(df), weights(df))
    return state.where("node <> root").select(F.col("root").alias("user_first"), F.col("node").alias("user_other"))


def p7_splits(spark, sf_dir):
    """Every message with its split."""
    df = spark.read.parquet(f"{sf_dir}/anonymous_forum_prioritized.parquet")
    state = stage(updated(None, links(df), weights(df)), "state")
    return assigned(df, state).select("msg_id", "user", "topic", "split")


def p7_incremental(spark, sf_dir):
    """Messages and accounts per split after anonymous_forum_prioritized and then, as a second batch, raw_forum."""
    first, second = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("anonymous_forum_prioritized", "raw_forum"))
    state = stage(updated(None, links(first), weights(first)), "state")
    both = weights(first.select("user").union(second.select("user")))
    after = updated(state, links(second), both)
    return after.join(both, "node", "left").groupBy("split").agg(F.count("*").alias("n_accounts"), F.sum(F.coalesce("n", F.lit(0))).alias("n_messages"))


QUERIES = {"p7_found": p7_found, "p7_splits": p7_splits, "p7_incremental": p7_incremental}

ORACLE = {
    "p7_found": """
WITH RECURSIVE p AS (SELECT DISTINCT nullif(lower(trim(user)), '') AS u, nullif(lower(trim(topic)), '') AS t FROM anonymous_forum_prioritized),
e AS (SELECT DISTINCT a.u AS x, b.u AS y FROM p a JOIN (SELECT t, min(u) AS u FROM p WHERE u IS NOT NULL AND t IS NOT NULL GROUP BY t) b USING (t) WHERE a.u IS NOT NULL),
s AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
walk(node, root) AS (SELECT u, u FROM p WHERE u IS NOT NULL UNION SELECT s.y, walk.root FROM walk JOIN s ON s.x = walk.node WHERE walk.root < s.y)
SELECT min(root) AS user_first, node AS user_other FROM walk GROUP BY node HAVING min(root) <> node"""
}
