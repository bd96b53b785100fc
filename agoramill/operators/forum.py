"""From the raw forum to the prioritised one: aliases, scrubbing, cleaning and weak-signal weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoramill.functions.patterns import CLEANING, matches, sensitive
from agoramill.functions.text import word_count

# Prefixes and lengths of the aliases, bounds of the length filter, and the weights' constants.
PREFIX = {"user": ("anon_user_", 10), "word": ("frenchword_", 10), "topic": ("anon_topic_", 8), "msg_id": ("anon_msg_", 12)}
MIN_WORDS, MAX_WORDS = 5, 25
MU, SIGMA, BANNED, DELETED = 6.0, 2.5, 10.0, 3.0
# French months, for dates written out.
MONTHS = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()
#: Bytes of the names up to which they are broadcast.
_BYTES = 32 << 20


def alias(c: Column, kind: str) -> Column:
    prefix, n = PREFIX[kind]
    return F.concat(F.lit(prefix), F.substring(F.sha2(c.cast("string"), 256), 1, n))


def known_words(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.select(F.lower("word").alias("word")).where("word IS NOT NULL").distinct()


def with_real(df: DataFrame, vocabulary: DataFrame, user: str = "user") -> DataFrame:
    """``df`` with is_real: the user's lower-cased name is no word of the vocabulary. Null users are null."""
    words = known_words(vocabulary).withColumn("__known", F.lit(True))
    joined = df.join(words, F.lower(F.col(user)) == F.col("word"), "left")
    return joined.withColumn("is_real", F.when(F.col(user).isNotNull(), F.col("__known").isNull())).drop("word", "__known")


def parsed_date(c: Column) -> Column:
    """A timestamp without zone from ISO, day/month/year and written-out French dates; null for anything else."""
    written = F.lower(c)
    for i, m in enumerate(MONTHS, 1):
        written = F.regexp_replace(written, rf"^(\d{{1,2}}) {m} (\d{{4}}) à ", rf"$2-{i:02d}-$1 ")
    iso = F.regexp_replace(F.regexp_replace(written, r"^(\d{4}-\d{2}-\d{2})t", "$1 "), "z$", "")
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-d HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy"]
    return F.coalesce(*[F.try_to_timestamp(iso, F.lit(f)) for f in forms]).cast("timestamp_ntz")


def hour(c: Column) -> Column:
    return F.hour(c).cast("tinyint")


def anonymized(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Aliases for user, topic and msg_id (null stays null), the hour of the date, and no date, links or profile."""
    marked = with_real(df, vocabulary)
    user = F.when(F.col("is_real"), alias(F.col("user"), "user")).otherwise(alias(F.col("user"), "word"))
    out = marked.withColumn("hour", hour(parsed_date(F.col("date")))).withColumn("user", user)
    out = out.withColumn("topic", alias(F.col("topic"), "topic")).withColumn("msg_id", alias(F.col("msg_id"), "msg_id"))
    return out.drop("date", "topic_url", "profile_url", "is_real")


def mappings(df: DataFrame, vocabulary: DataFrame) -> dict[str, DataFrame]:
    """The three tables (original, anonymous) of distinct values."""
    users = with_real(df.select("user").na.drop().distinct(), vocabulary)
    return {
        "users": users.select(F.col("user").alias("original_user"), F.when(F.col("is_real"), alias(F.col("user"), "user")).otherwise(alias(F.col("user"), "word")).alias("anonymous_user")),
        "topics": df.select("topic").na.drop().distinct().select(F.col("topic").alias("original_topic"), alias(F.col("topic"), "topic").alias("anonymous_topic")),
        "msg_ids": df.select("msg_id").na.drop().distinct().select(F.col("msg_id").alias("original_msg_id"), alias(F.col("msg_id"), "msg_id").alias("anonymous_msg_id")),
    }


def _keyword_tokens(c: Column) -> Column:
    """Runs of A-Z, a-z, 0-9 and _ in lower case; anything else, accented letters included, is a boundary."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9_]+"), lambda t: t != "")


def mentioning(df: DataFrame, names: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key) of the rows whose content holds a name (column name) between boundaries, in any case.

    Names and contents are cut into the same tokens, and the join is on the hash of a name's whole run of tokens, so a
    common first word doesn't multiply rows. A hit is then compared with the name as written: a name of one plain token
    is that token, any other must stand in the content between boundaries. Run lengths come from the names (a list of
    distinct lengths); the names are broadcast while their texts have at most ``_BYTES`` bytes, else joined by a shuffle.
    """
    n = names.select(F.lower("name").alias("name")).where("name IS NOT NULL AND name <> ''").distinct().withColumn("toks", _keyword_tokens(F.col("name"))).where(F.size("toks") > 0)
    n = n.select("name", F.size("toks").alias("k"), F.xxhash64("toks").alias("run"))
    sizes = n.agg(F.coalesce(F.sum(F.length("name") + 64), F.lit(0)).alias("bytes"), F.collect_set("k").alias("ks")).first()
    runs = n.where(F.col("k").isNotNull()).select("name", "k", "run")
    rows = df.select(F.col(key).alias("__id"), F.lower(content).alias("low")).where("low IS NOT NULL")
    toks = _keyword_tokens(F.col("low"))

    def of(k: int):
        if k == 1:
            return lambda t: F.transform(t, lambda x: F.struct(F.lit(1).alias("k"), F.xxhash64(F.array(x)).alias("run")))
        starts = lambda t: F.when(F.size(t) >= k, F.sequence(F.lit(1), F.size(t) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return lambda t: F.transform(starts(t), lambda i: F.struct(F.lit(k).alias("k"), F.xxhash64(F.slice(t, i, F.lit(k))).alias("run")))

    ks = sorted(sizes["ks"]) or [1]
    grams = F.transform(F.array(toks), lambda t: F.array_distinct(F.concat(*[of(k)(t) for k in ks])))[0]
    each = rows.select("__id", "low", F.explode(grams).alias("x")).select("__id", "low", "x.k", "x.run")
    hit = each.join(F.broadcast(runs) if sizes["bytes"] <= _BYTES else runs, ["k", "run"])
    plain = (F.col("k") == 1) & ~F.col("name").rlike("[^a-z0-9_]")
    # as written: only names of several tokens or other signs, of which few rows are left
    quoted = F.concat(F.lit(r"(?<![a-z0-9_])\Q"), F.replace("name", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![a-z0-9_])"))
    written = F.regexp_like("low", quoted)
    return hit.where(F.when(plain, True).otherwise(written)).select(F.col("__id").alias(key)).distinct()


def scrubbed(df: DataFrame, names: DataFrame, content: str = "content") -> DataFrame:
    """``df`` without the rows that mention a name; null contents stay. All copies of a content go alike."""
    bad = mentioning(df.select(F.col(content).alias("__c")).distinct().withColumnRenamed("__c", content).withColumn("__k", F.col(content)), names, "__k", content)
    return df.join(bad.withColumnRenamed("__k", "__bad"), F.col(content) == F.col("__bad"), "left_anti")


def inspected(df: DataFrame) -> DataFrame:
    """Rows, distinct users and topics, deleted rows, and whether the ids are unique, in one row. Digests are counted, so
    that no text is multiplied."""
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(F.md5("user")).alias("n_users"), F.count_distinct(F.md5("topic")).alias("n_topics"), F.sum(F.col("deleted").cast("bigint")).alias("n_deleted"), (F.count_distinct(F.md5("msg_id")) == F.count("msg_id")).alias("unique_ids"))


def of_length(df: DataFrame, lo: int = MIN_WORDS, hi: int = MAX_WORDS, content: str = "content") -> DataFrame:
    return df.where(word_count(F.col(content)).between(lo, hi))


def without_sensitive(df: DataFrame, content: str = "content") -> DataFrame:
    return df.where(~sensitive(F.col(content)))


def cleaning_report(df: DataFrame, content: str = "content") -> DataFrame:
    """Rows before, after and removed by each step and the share removed, from one pass."""
    n_ok = word_count(F.col(content)).between(MIN_WORDS, MAX_WORDS)
    bad = sensitive(F.col(content))
    s = df.select(n_ok.alias("a"), bad.alias("b")).agg(F.count("*").alias("n"), F.sum(F.col("a").cast("bigint")).alias("n1"), F.sum((F.col("a") & ~F.col("b")).cast("bigint")).alias("n2"))
    steps = F.array(F.struct(F.lit("length").alias("step"), F.col("n").alias("n_before"), F.col("n1").alias("n_after")), F.struct(F.lit("sensitive").alias("step"), F.col("n1").alias("n_before"), F.col("n2").alias("n_after")))
    x = s.select(F.explode(steps).alias("x")).select("x.*")
    return x.withColumn("n_removed", F.col("n_before") - F.col("n_after")).withColumn("share_removed", F.round(F.coalesce(F.try_divide("n_removed", "n_before"), F.lit(0.0)), 9))


def pattern_counts(df: DataFrame, content: str = "content") -> DataFrame:
    sums = df.agg(*[F.sum(matches(F.col(content), p).cast("bigint")).alias(p) for p in CLEANING])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(p).alias("n_rows")) for p in CLEANING])).alias("x")).select("x.*")


def gaussian(h: Column, mu: float = MU, sigma: float = SIGMA) -> Column:
    return F.exp(-((h - mu) * (h - mu)) / (2 * sigma * sigma))


def hour_volume(df: DataFrame) -> DataFrame:
    return df.where("hour IS NOT NULL").groupBy("hour").agg(F.count("*").alias("n_messages"))


def weighted(df: DataFrame, mu: float = MU, sigma: float = SIGMA, banned: float = BANNED, deleted: float = DELETED) -> DataFrame:
    """``df`` with priority_weight: the Gaussian of the hour by the hour's volume, boosted for banned and deleted.

    The volumes are at most 24 rows and broadcast. A null hour, banned or deleted gives a null weight.
    """
    volume = hour_volume(df).select(F.col("hour").alias("__h"), F.col("n_messages").alias("__n"))
    base = gaussian(F.col("hour"), mu, sigma) / F.greatest(F.col("__n"), F.lit(1))
    boost = (1 + banned * F.col("banned").cast("int")) * (1 + deleted * F.col("deleted").cast("int"))
    return df.join(F.broadcast(volume), F.col("hour") == F.col("__h"), "left").withColumn("priority_weight", base * boost).drop("__h", "__n")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of seed and key; the same in any partitioning."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") / float(2**52)


def permutation_key(weight: Column, key: Column, seed: int) -> Column:
    """The smaller, the earlier in a weighted random order without replacement; null for weights that are no chance."""
    u = uniform(key, seed)
    return F.when(weight > 0, -F.log(F.greatest(u, F.lit(2.0**-53))) / weight)


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its position (from 1) in a global order, without a single-partition window: rows are range-sorted,
    partitions counted, and the prefix sums of the counts added. Ordering columns must identify rows."""
    from agoramill.runtime import stage

    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = stage(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "positions")
    placed = placed.withColumn("__p", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))
    at, offsets = 0, []
    for p, n in sorted((r[0], r[1]) for r in placed.groupBy("__p").count().collect()):  # one row per partition
        offsets.append((p, at))
        at += n
    table = spark.createDataFrame(offsets, "__p int, __o bigint")
    return placed.join(F.broadcast(table), "__p").withColumn(name, F.col("__at") + F.col("__o") + 1).drop("__p", "__at", "__o")


def prioritized(df: DataFrame, seed: int = 42, key: str = "msg_id", weight: str = "priority_weight") -> DataFrame:
    """``df`` with priority_rank, a weighted random permutation; null, zero and NaN weights come last, by key."""
    w = F.when(~F.isnan(weight), F.col(weight))
    return positions(df.withColumn("__k", permutation_key(w, F.col(key), seed)), [F.col("__k").asc_nulls_last(), F.col(key)], "priority_rank").drop("__k")


def monthly(df: DataFrame, ts: str, name: str = "n_events") -> DataFrame:
    """Rows per month, with zeros for months without any between the first and the last."""
    counts = df.where(F.col(ts).isNotNull()).groupBy(F.trunc(F.to_date(ts), "month").alias("month")).agg(F.count("*").alias(name))
    spine = counts.agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a IS NOT NULL").select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return spine.join(counts, "month", "left").select("month", F.coalesce(name, F.lit(0)).alias(name))
