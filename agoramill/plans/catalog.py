"""All queries of the core and their SQL for DuckDB."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoramill.functions import verdicts as v
from agoramill.functions.text import strip, word_count
from agoramill.operators import annotate, evaluate, forum, predictors, sampling, training
from agoramill.runtime import shared_dir, table
from agoramill.sources import files

#: The system prompts of the annotation steps, one file each.
PROMPTS = str(Path(__file__).parent / "prompts")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# -- SQL pieces: Unicode white space, the uniform number, dates, labels
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_S = r"[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_W = r"[\p{L}\p{M}\p{N}_]"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def _words(x: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array(coalesce({x}, 'nan'), '{_WS}+'), lambda w: w <> '')) AS INTEGER)"


_PATTERNS = {
    "http": f"(?i)https?://{_S}+",
    "www": rf"(?i)www\.{_S}+",
    "email": rf"(?i){_W}{_S}*@{_S}+\.{_S}*{_W}",
    "phone": rf"(^|[^\p{{L}}\p{{M}}\p{{N}}_])\d{{1,4}}([-.]|{_WS})?\d{{1,4}}([-.]|{_WS})?\d{{3,4}}($|[^\p{{L}}\p{{M}}\p{{N}}_])",
    "mention": f"@{_W}+",
    "community": f"(?i)u/{_W}+",
    "ip": r"(^|[^\p{L}\p{M}\p{N}_])\d{1,3}(\.\d{1,3}){3}($|[^\p{L}\p{M}\p{N}_])",
}
_SENSITIVE = "coalesce(" + " OR ".join(f"regexp_matches({{0}}, '{p}')" for p in _PATTERNS.values()) + ", false)"


def _sensitive(x: str) -> str:
    return _SENSITIVE.replace("{0}", x)


_DATE = "lower(date)"
for _i, _m in enumerate(forum.MONTHS, 1):
    _DATE = f"replace({_DATE}, ' {_m} ', '/{_i:02d}/')"
_DATE = f"try_strptime(replace(regexp_replace(regexp_replace({_DATE}, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})t', '\\1 '), 'z$', ''), ' à ', ' '), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%d/%m/%Y %H:%M:%S', '%d/%m/%Y %H:%M', '%d/%m/%Y'])"
_UNIFORM = "(('0x' || substr(sha256('42:' || msg_id), 1, 13))::BIGINT / 4503599627370496.0)"
_ANON = f"""
words AS (SELECT DISTINCT lower(word) AS word FROM vocabulary WHERE word IS NOT NULL),
anon AS (SELECT CASE WHEN r.user IS NULL THEN NULL WHEN w.word IS NULL THEN 'anon_user_' || substr(sha256(r.user), 1, 10) ELSE 'frenchword_' || substr(sha256(r.user), 1, 10) END AS user,
  'anon_topic_' || substr(sha256(r.topic), 1, 8) AS topic, 'anon_msg_' || substr(sha256(r.msg_id), 1, 12) AS msg_id, content, deleted, banned, CAST(hour({_DATE}) AS TINYINT) AS hour
  FROM raw_forum r LEFT JOIN words w ON lower(r.user) = w.word)"""


def _weights(source: str) -> str:
    return f"""vol AS (SELECT hour, count(*) AS n FROM {source} WHERE hour IS NOT NULL GROUP BY hour),
weighted AS (SELECT s.*, exp(-((s.hour - 6.0) * (s.hour - 6.0)) / (2 * 2.5 * 2.5)) / greatest(vol.n, 1) * ((1 + 10.0 * CAST(banned AS INTEGER)) * (1 + 3.0 * CAST(deleted AS INTEGER))) AS w FROM {source} s LEFT JOIN vol ON s.hour = vol.hour)"""


_RANK = f"row_number() OVER (ORDER BY CASE WHEN w > 0 THEN -ln(greatest({_UNIFORM}, 1.1102230246251565e-16)) / w END NULLS LAST, msg_id)"

# -- forum


@query("SELECT count(*) AS n_rows, count(DISTINCT user) AS n_users, count(DISTINCT topic) AS n_topics, CAST(sum(CAST(deleted AS INTEGER)) AS BIGINT) AS n_deleted, count(DISTINCT msg_id) = count(msg_id) AS unique_ids FROM raw_forum")
def inspect_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forum.inspected(table(spark, sf_dir, "raw_forum"))


@query("WITH words AS (SELECT DISTINCT lower(word) AS word FROM vocabulary WHERE word IS NOT NULL) SELECT DISTINCT user AS original_user, CASE WHEN word IS NULL THEN 'anon_user_' ELSE 'frenchword_' END || substr(sha256(user), 1, 10) AS anonymous_user FROM raw_forum LEFT JOIN words ON lower(user) = word WHERE user IS NOT NULL")
def alias_users(spark, sf_dir):
    return forum.mappings(table(spark, sf_dir, "raw_forum"), table(spark, sf_dir, "vocabulary"))["users"]


@query("SELECT DISTINCT topic AS original_topic, 'anon_topic_' || substr(sha256(topic), 1, 8) AS anonymous_topic FROM raw_forum WHERE topic IS NOT NULL")
def alias_topics(spark, sf_dir):
    return forum.mappings(table(spark, sf_dir, "raw_forum"), table(spark, sf_dir, "vocabulary"))["topics"]


@query("SELECT DISTINCT msg_id AS original_msg_id, 'anon_msg_' || substr(sha256(msg_id), 1, 12) AS anonymous_msg_id FROM raw_forum WHERE msg_id IS NOT NULL")
def alias_messages(spark, sf_dir):
    return forum.mappings(table(spark, sf_dir, "raw_forum"), table(spark, sf_dir, "vocabulary"))["msg_ids"]


@query("WITH words AS (SELECT DISTINCT lower(word) AS word FROM vocabulary WHERE word IS NOT NULL) SELECT user, count(*) AS n_rows FROM raw_forum LEFT JOIN words ON lower(user) = word WHERE user IS NOT NULL AND word IS NULL GROUP BY user")
def vocabulary_users(spark, sf_dir):
    """Accounts whose name is no word of the vocabulary."""
    return forum.with_real(table(spark, sf_dir, "raw_forum"), table(spark, sf_dir, "vocabulary")).where("is_real").groupBy("user").agg(F.count("*").alias("n_rows"))


@query(f"WITH {_ANON} SELECT user, topic, msg_id, content, deleted, banned, hour FROM anon")
def anonymized_forum(spark, sf_dir):
    return forum.anonymized(table(spark, sf_dir, "raw_forum"), table(spark, sf_dir, "vocabulary")).select("user", "topic", "msg_id", "content", "deleted", "banned", "hour")


def _real_names(spark, sf_dir):
    return forum.with_real(table(spark, sf_dir, "raw_forum").select("user").distinct(), table(spark, sf_dir, "vocabulary")).where("is_real").select(F.col("user").alias("name"))


@query(r"""WITH words AS (SELECT DISTINCT lower(word) AS word FROM vocabulary WHERE word IS NOT NULL),
names AS (SELECT DISTINCT lower(user) AS name FROM raw_forum LEFT JOIN words ON lower(user) = word WHERE user IS NOT NULL AND user <> '' AND word IS NULL AND regexp_matches(lower(user), '[a-z0-9_]')),
texts AS (SELECT DISTINCT content FROM raw_forum WHERE content IS NOT NULL),
bad AS (SELECT DISTINCT content FROM texts JOIN names ON contains(lower(content), name) AND regexp_matches(lower(content), '(^|[^a-z0-9_])' || regexp_escape(name) || '($|[^a-z0-9_])'))
SELECT msg_id, content FROM raw_forum WHERE content IS NULL OR content NOT IN (SELECT content FROM bad)""")
def scrub_usernames(spark, sf_dir):
    return forum.scrubbed(table(spark, sf_dir, "raw_forum"), _real_names(spark, sf_dir)).select("msg_id", "content")


@query(f"SELECT msg_id, {_words('content')} AS n_words FROM anonymous_forum WHERE {_words('content')} BETWEEN 5 AND 25")
def length_filter(spark, sf_dir):
    return forum.of_length(table(spark, sf_dir, "anonymous_forum")).select("msg_id", word_count(F.col("content")).alias("n_words"))


@query(f"SELECT doc_id, {_words('text')} AS n_words FROM documents WHERE {_words('text')} BETWEEN 5 AND 25")
def length_filter_docs(spark, sf_dir):
    return forum.of_length(table(spark, sf_dir, "documents"), content="text").select("doc_id", word_count(F.col("text")).alias("n_words"))


@query(f"SELECT msg_id, content FROM anonymous_forum WHERE NOT {_sensitive('content')}")
def pii_filter(spark, sf_dir):
    return forum.without_sensitive(table(spark, sf_dir, "anonymous_forum")).select("msg_id", "content")


@query(" UNION ALL ".join(f"SELECT '{n}' AS pattern, CAST(sum(CASE WHEN regexp_matches(content, '{p}') THEN 1 ELSE 0 END) AS BIGINT) AS n_rows FROM anonymous_forum" for n, p in _PATTERNS.items()))
def pii_pattern_counts(spark, sf_dir):
    return forum.pattern_counts(table(spark, sf_dir, "anonymous_forum"))


@query(f"""WITH s AS (SELECT count(*) AS n, CAST(sum(CASE WHEN a THEN 1 ELSE 0 END) AS BIGINT) AS n1, CAST(sum(CASE WHEN a AND NOT b THEN 1 ELSE 0 END) AS BIGINT) AS n2
FROM (SELECT {_words('content')} BETWEEN 5 AND 25 AS a, {_sensitive('content')} AS b FROM anonymous_forum)),
x AS (SELECT 'length' AS step, n AS n_before, n1 AS n_after FROM s UNION ALL SELECT 'sensitive', n1, n2 FROM s)
SELECT step, n_before, n_after, n_before - n_after AS n_removed, round((n_before - n_after) / n_before, 9) AS share_removed FROM x""")
def cleaning_report(spark, sf_dir):
    return forum.cleaning_report(table(spark, sf_dir, "anonymous_forum"))


@query("SELECT hour, count(*) AS n_messages FROM anonymous_forum WHERE hour IS NOT NULL GROUP BY hour")
def hour_volume(spark, sf_dir):
    return forum.hour_volume(table(spark, sf_dir, "anonymous_forum"))


@query(f"WITH {_weights('anonymous_forum_filtered')} SELECT msg_id, round(w, 12) AS priority_weight FROM weighted")
def priority_weights(spark, sf_dir):
    return forum.weighted(table(spark, sf_dir, "anonymous_forum_filtered")).select("msg_id", F.round("priority_weight", 12).alias("priority_weight"))


@query(f"WITH {_weights('anonymous_forum_filtered')} SELECT min(w) AS min_weight, max(w) AS max_weight FROM weighted")
def priority_range(spark, sf_dir):
    return forum.weighted(table(spark, sf_dir, "anonymous_forum_filtered")).agg(F.min("priority_weight").alias("min_weight"), F.max("priority_weight").alias("max_weight"))


def _queue(spark, sf_dir):
    anon = forum.anonymized(table(spark, sf_dir, "raw_forum"), table(spark, sf_dir, "vocabulary"))
    return forum.prioritized(forum.weighted(forum.without_sensitive(forum.of_length(anon))))


_QUEUE = f"WITH {_ANON}, clean AS (SELECT * FROM anon WHERE {_words('content')} BETWEEN 5 AND 25 AND NOT {_sensitive('content')}), {_weights('clean')}, ranked AS (SELECT *, {_RANK} AS priority_rank FROM weighted)"


@query(_QUEUE + " SELECT msg_id, user, hour, round(w, 12) AS priority_weight, priority_rank FROM ranked")
def priority_queue(spark, sf_dir):
    """From the raw forum to the ranked queue: alias, clean, weigh, permute."""
    return _queue(spark, sf_dir).select("msg_id", "user", "hour", F.round("priority_weight", 12).alias("priority_weight"), "priority_rank")


@query(_QUEUE + " SELECT priority_rank, msg_id FROM ranked WHERE priority_rank <= 100")
def priority_topk(spark, sf_dir):
    """The first hundred of the queue, for review."""
    return _queue(spark, sf_dir).where("priority_rank <= 100").select("priority_rank", "msg_id")


_SPINE = "spine AS (SELECT CAST(unnest(generate_series((SELECT min(month) FROM c), (SELECT max(month) FROM c), INTERVAL 1 MONTH)) AS DATE) AS month) SELECT CAST(spine.month AS VARCHAR) AS month, coalesce(n, 0) AS n_events FROM spine LEFT JOIN c USING (month)"


@query(f"WITH c AS (SELECT CAST(date_trunc('month', {_DATE}) AS DATE) AS month, count(*) AS n FROM raw_forum WHERE {_DATE} IS NOT NULL GROUP BY 1), {_SPINE}")
def monthly_volume(spark, sf_dir):
    df = table(spark, sf_dir, "raw_forum").withColumn("ts", forum.parsed_date(F.col("date")))
    return forum.monthly(df, "ts").withColumn("month", F.col("month").cast("string"))


@query(f"WITH c AS (SELECT CAST(date_trunc('month', o_orderdate + to_years(CAST(o_orderkey % 3 AS INTEGER) * 20)) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1), {_SPINE}")
def monthly_zero_filled(spark, sf_dir):
    """All orders, moved by none, twenty or forty years by their key: the months between have none."""
    df = table(spark, sf_dir, "orders").withColumn("ts", F.expr("add_months(to_date(o_orderdate), CAST(o_orderkey % 3 AS INT) * 240)"))
    return forum.monthly(df, "ts").withColumn("month", F.col("month").cast("string"))


# -- sampling
_LABELLED = f"lab AS (SELECT row_id, CASE WHEN literal_conclusion_annotator IS NULL THEN NULL WHEN {_strip('lower(literal_conclusion_annotator)')} IN ('oui', 'toxic', 'true', '1') THEN 1 ELSE 0 END AS label, sha256('42:' || row_id) AS h FROM sft_rows)"
_RANKED = f"WITH {_LABELLED}, r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY h, row_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM lab WHERE label IS NOT NULL), m AS (SELECT min(n) AS lo, max(n) AS hi FROM r)"


def _sft(spark, sf_dir):
    return table(spark, sf_dir, "sft_rows").withColumn("label", v.clean_label(F.col("literal_conclusion_annotator")))


@query("SELECT row_id, row_number() OVER (ORDER BY sha256('42:' || row_id), row_id) AS shuffle_rank FROM sft_rows")
def seeded_shuffle(spark, sf_dir):
    return sampling.shuffled(table(spark, sf_dir, "sft_rows").select("row_id"), "row_id")


@query("SELECT row_id FROM sft_rows ORDER BY sha256('42:' || row_id), row_id LIMIT 50")
def seeded_sample(spark, sf_dir):
    """Fifty rows by the seeded order: a sampling operator."""
    return sampling.sampled(table(spark, sf_dir, "sft_rows").select("row_id"), "row_id", 50)


@query(f"WITH {_LABELLED}, c AS (SELECT label, count(*) AS n FROM lab WHERE label IS NOT NULL GROUP BY label) SELECT label, n, max(n) OVER () AS n_max, min(n) OVER () AS n_min FROM c")
def class_counts(spark, sf_dir):
    return sampling.class_counts(_sft(spark, sf_dir), "label")


@query(_RANKED + " SELECT row_id, label FROM r, m WHERE rn <= lo")
def undersample(spark, sf_dir):
    return sampling.undersampled(_sft(spark, sf_dir), "label", "row_id").select("row_id", "label")


@query(_RANKED + " SELECT row_id, label FROM r, m WHERE rn <= least(lo, 100)")
def undersample_capped(spark, sf_dir):
    return sampling.undersampled(_sft(spark, sf_dir), "label", "row_id", cap=100).select("row_id", "label")


@query(_RANKED + " SELECT row_id, label, CAST(unnest(range(1, hi // n + CASE WHEN rn <= hi % n THEN 2 ELSE 1 END)) AS INTEGER) AS copy FROM r, m")
def oversample(spark, sf_dir):
    return sampling.oversampled(_sft(spark, sf_dir), "label", "row_id").select("row_id", "label", "copy")


# -- annotation: deleted messages are answered, banned ones blank
_CHECKPOINT = "ck AS (SELECT msg_id, content, deleted, banned, CASE WHEN deleted THEN 'fait ' || content WHEN banned THEN '  ' END AS explication, CASE WHEN deleted THEN 'Note : 7/10' END AS toxicite_score FROM anonymous_forum_prioritized)"


def _checkpoint(spark, sf_dir):
    df = table(spark, sf_dir, "anonymous_forum_prioritized").select("msg_id", "content", "deleted", "banned")
    done = F.when(F.col("deleted"), F.concat(F.lit("fait "), "content")).when(F.col("banned"), "  ")
    return df.withColumn("explication", done).withColumn("toxicite_score", F.when(F.col("deleted"), "Note : 7/10"))


@query(f"WITH {_CHECKPOINT} SELECT msg_id FROM ck WHERE msg_id NOT IN (SELECT msg_id FROM ck WHERE explication IS NOT NULL AND {_strip('explication')} <> '')")
def annotation_queue(spark, sf_dir):
    ck = _checkpoint(spark, sf_dir)
    return annotate.queue(ck.select("msg_id"), ck, "explication")


@query(f"WITH {_CHECKPOINT} SELECT msg_id FROM ck WHERE msg_id NOT IN (SELECT msg_id FROM ck WHERE explication IS NOT NULL AND {_strip('explication')} <> '') AND msg_id NOT IN (SELECT msg_id FROM anonymous_forum_prioritized WHERE hour = 3)")
def annotation_queue_excluding(spark, sf_dir):
    ck = _checkpoint(spark, sf_dir)
    return annotate.queue(ck.select("msg_id"), ck, "explication", table(spark, sf_dir, "anonymous_forum_prioritized").where("hour = 3"))


@query(f"WITH {_CHECKPOINT}, one AS (SELECT DISTINCT ON (msg_id) msg_id, content, explication FROM ck ORDER BY msg_id, content) SELECT 'ton_' || msg_id AS custom_id, 'Voici les informations à analyser :' || chr(10) || chr(10) || '**Message original** :' || chr(10) || '« ' || coalesce(content, 'nan') || ' »' || chr(10) || chr(10) || '**Explication** :' || chr(10) || '« ' || coalesce(explication, 'nan') || ' »' || chr(10) || chr(10) || 'Ta tâche est d’identifier de façon nuancée les tons présents dans ce message.' || chr(10) || chr(10) AS prompt, 'Nomme le ton du message et dis si tu en es sûr.' AS system FROM one")
def annotation_requests(spark, sf_dir):
    """Requests with the step's system prompt from its file."""
    r = annotate.requests(_checkpoint(spark, sf_dir), "ton", systems=annotate.system_prompts(PROMPTS))
    return r.select("custom_id", F.col("body.messages")[0]["content"].alias("system"), F.col("body.messages")[1]["content"].alias("prompt"))


def _responses(spark, sf_dir):
    """A rehearsed batch of responses: banned messages fail."""
    df = table(spark, sf_dir, "anonymous_forum_prioritized").where("msg_id IS NOT NULL").groupBy("msg_id").agg(F.max("content").alias("content"), F.max("banned").alias("banned"))
    usage = F.struct(F.length("content").cast("bigint").alias("prompt_tokens"), F.lit(7).cast("bigint").alias("completion_tokens"), (F.length("content") + 7).cast("bigint").alias("total_tokens"))
    choice = F.array(F.struct(F.struct(F.when(F.length("content") % 5 == 0, "").otherwise(F.concat(F.lit("Note : "), (F.length("content") % 11).cast("string"), F.lit("/10"))).alias("content")).alias("message")))
    return df.select(F.concat(F.lit("toxicite_score_"), "msg_id").alias("custom_id"), F.when(F.col("banned"), "limit").alias("error"), F.struct(F.struct(choice.alias("choices"), usage.alias("usage")).alias("body")).alias("response"))


_RESP = "resp AS (SELECT msg_id, max(content) AS content, max(banned) AS banned FROM anonymous_forum_prioritized WHERE msg_id IS NOT NULL GROUP BY msg_id), ans AS (SELECT msg_id, CASE WHEN length(content) % 5 = 0 THEN '' ELSE 'Note : ' || (length(content) % 11) || '/10' END AS answer, CAST(length(content) AS BIGINT) AS prompt_tokens, CAST(7 AS BIGINT) AS completion_tokens FROM resp WHERE banned IS NOT TRUE)"


@query(f"WITH {_RESP} SELECT msg_id, answer, prompt_tokens, completion_tokens FROM ans")
def parse_responses(spark, sf_dir):
    return annotate.answers(_responses(spark, sf_dir), "toxicite_score")


@query(f"WITH {_RESP} SELECT 'toxicite_score_' || msg_id AS custom_id, 'limit' AS error FROM resp WHERE banned")
def response_errors(spark, sf_dir):
    return annotate.failures(_responses(spark, sf_dir))


@query(f"WITH {_CHECKPOINT}, {_RESP} SELECT ck.msg_id, coalesce(nullif(answer, ''), toxicite_score) AS toxicite_score FROM ck LEFT JOIN ans ON ck.msg_id IS NOT DISTINCT FROM ans.msg_id")
def merge_annotations(spark, sf_dir):
    return annotate.merged(_checkpoint(spark, sf_dir), annotate.answers(_responses(spark, sf_dir), "toxicite_score"), "toxicite_score").select("msg_id", "toxicite_score")


@query(f"WITH {_CHECKPOINT}, {_RESP} SELECT msg_id, CAST(regexp_extract(answer, 'Note : ([0-9]+)/10', 1) AS INTEGER) AS note FROM ans WHERE answer <> ''")
def structured_notes(spark, sf_dir):
    """An extension: the note of each answer as a number."""
    a = annotate.answers(_responses(spark, sf_dir), "toxicite_score")
    return a.select("msg_id", annotate.note(F.col("answer")).alias("note")).where("note IS NOT NULL")


# words of the system prompts, of the steps that are columns; nulls and empty answers are to do, blank ones are not
_PROMPT_WORDS = {"explication": 12, "ton": 12, "intention": 7, "categorie": 11, "labels": 13, "toxicite_score": 15, "conclusion": 11}


@query(
    f"WITH {_CHECKPOINT} "
    + " UNION ALL ".join(
        f"SELECT '{s}' AS step, CAST({n} AS INTEGER) AS prompt_words, "
        + (f"count(DISTINCT {s}) AS n_distinct, count(*) FILTER (WHERE {s} IS NULL) + count(*) FILTER (WHERE {s} = '') AS n_todo FROM ck" if s in ("explication", "toxicite_score") else "CAST(NULL AS BIGINT) AS n_distinct, CAST(NULL AS BIGINT) AS n_todo")
        for s, n in _PROMPT_WORDS.items()
    )
)
def annotation_progress(spark, sf_dir):
    return annotate.progress(_checkpoint(spark, sf_dir), annotate.system_prompts(PROMPTS))


def _said_words(x: str) -> str:
    return f"coalesce(len(list_filter(regexp_split_to_array({x}, '{_WS}+'), lambda w: w <> '')), 0)"


@query(f"WITH {_CHECKPOINT} SELECT count(*) AS n_rows, CAST(count(*) * (12 + 12) + sum({_said_words('explication')}) AS BIGINT) AS n_words FROM ck")
def token_estimate(spark, sf_dir):
    """System prompts of the step and of the one before it, per row, and the words of its answers."""
    return annotate.token_estimate(_checkpoint(spark, sf_dir), "ton", annotate.system_prompts(PROMPTS))


@query(f"WITH {_CHECKPOINT} SELECT count(*) AS n_rows, CAST(count(*) * (12 + 15 + 11) + sum({_said_words('explication')}) + sum({_said_words('toxicite_score')}) AS BIGINT) AS n_words FROM ck")
def token_estimate_last(spark, sf_dir):
    """The last step, after two steps with answers."""
    return annotate.token_estimate(_checkpoint(spark, sf_dir), "conclusion", annotate.system_prompts(PROMPTS))


@query(f"WITH {_RESP} SELECT CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum(prompt_tokens) / 1000 * 0.0005 + sum(completion_tokens) / 1000 * 0.0015, 6) AS dollars FROM ans")
def token_cost(spark, sf_dir):
    return annotate.cost(annotate.answers(_responses(spark, sf_dir), "toxicite_score")).withColumn("dollars", F.round("dollars", 6))


# -- labels, verdicts and decision rules
_NOTE = "TRY_CAST(regexp_extract(CoT_score, '([0-9]+)/10', 1) AS INTEGER)"


def _notes(spark, sf_dir):
    return table(spark, sf_dir, "sft_rows").select("*", F.regexp_extract("CoT_score", r"([0-9]+)/10", 1).try_cast("int").alias("note"))


@query(f"SELECT row_id, CASE WHEN ({_NOTE} IS NOT NULL AND {_NOTE} / 3.0 > 2.0) OR ({_NOTE} IS NOT NULL AND ({_NOTE} % 4) / 2.0 > 1.0) THEN 1 ELSE 0 END AS label FROM sft_rows")
def harm_labels(spark, sf_dir):
    """Binary labels from a map of category scores."""
    n = F.col("note")
    scores = F.when(n.isNotNull(), F.create_map(F.lit("Toxicity"), n / 3.0, F.lit("Violence"), (n % 4) / 2.0)).otherwise(F.create_map().cast("map<string,double>"))
    return _notes(spark, sf_dir).select("row_id", v.harm_label(scores).alias("label"))


@query(f"SELECT row_id, CASE WHEN {_NOTE} >= 1 THEN 1 WHEN {_NOTE} < 1 THEN 0 END AS label FROM sft_rows WHERE source = 'forum_principal'")
def graded_labels(spark, sf_dir):
    return _notes(spark, sf_dir).where("source = 'forum_principal'").select("row_id", v.graded_label(F.col("note")).alias("label"))


@query("SELECT row_id, CASE WHEN contains(lower(coalesce(literal_conclusion_annotator, 'none')), 'oui') THEN 1 ELSE 0 END AS label FROM sft_rows")
def class_labels(spark, sf_dir):
    return table(spark, sf_dir, "sft_rows").select("row_id", v.class_label(F.col("literal_conclusion_annotator")).alias("label"))


_NUMBER = f"CASE WHEN row_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN row_id % 7 = 0 THEN -1.0 ELSE {_NOTE} / 3.0 END"


@query(f"WITH {_LABELLED}, num AS (SELECT row_id, {_NUMBER} AS x FROM sft_rows) SELECT lab.row_id, label, CASE WHEN NOT isnan(x) THEN CAST(trunc(x) AS INTEGER) END AS number FROM lab JOIN num ON lab.row_id = num.row_id")
def clean_labels(spark, sf_dir):
    """Labels written as texts, and labels that are numbers: -1, fractions and NaN among them."""
    x = F.when(F.col("row_id") % 11 == 0, F.lit(float("nan"))).when(F.col("row_id") % 7 == 0, -1.0).otherwise(F.col("note") / 3.0)
    df = _notes(spark, sf_dir).withColumn("x", x)
    return df.select("row_id", v.cleaned(df, "literal_conclusion_annotator").alias("label"), v.cleaned(df, "x").alias("number"))


_SAID = "replace(replace(lower(completion), 'conclusion : oui', 'toxique'), 'conclusion : non', 'non-toxique')"


def _said(spark, sf_dir):
    c = F.replace(F.replace(F.lower("completion"), F.lit("conclusion : oui"), F.lit("toxique")), F.lit("conclusion : non"), F.lit("non-toxique"))
    return table(spark, sf_dir, "dpo_formatted").select("row_id", "completion", c.alias("said"))


@query(f"SELECT row_id, CASE WHEN contains({_SAID}, 'non-toxique') THEN '0' WHEN contains({_SAID}, 'toxique') THEN '1' ELSE {_strip(_SAID)} END AS label FROM dpo_formatted")
def verdict_substring(spark, sf_dir):
    return _said(spark, sf_dir).select("row_id", v.by_substring(F.col("said")).alias("label"))


@query("WITH t AS (SELECT row_id, list_extract(string_split(replace(replace(completion, 'Conclusion : oui', 'toxique'), 'Conclusion : non', 'non-toxique'), 'Ce message est-il toxique ?'), -1) AS tail FROM dpo_formatted) SELECT row_id, CASE WHEN tail IS NULL THEN NULL WHEN contains(tail, 'non-toxique') THEN 0 WHEN contains(tail, 'toxique') THEN 1 ELSE 0 END AS label FROM t")
def verdict_tail(spark, sf_dir):
    c = F.replace(F.replace("completion", F.lit("Conclusion : oui"), F.lit("toxique")), F.lit("Conclusion : non"), F.lit("non-toxique"))
    return table(spark, sf_dir, "dpo_formatted").select("row_id", v.by_tail(c).alias("label"))


@query(r"SELECT row_id, CASE regexp_extract(lower(completion), '(oui|non)\s*<\|im_end\|>', 1) WHEN 'oui' THEN 1 WHEN 'non' THEN 0 ELSE -1 END AS label FROM dpo_formatted")
def verdict_pattern(spark, sf_dir):
    return table(spark, sf_dir, "dpo_formatted").select("row_id", v.by_pattern(F.col("completion")).alias("label"))


def _logits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


_X = "x AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings), s AS (SELECT vec_id, x, list_sum(list_transform(x, lambda e: exp(e))) AS z FROM x)"


@query(f"WITH {_X} SELECT vec_id, round(exp(x[1]) / z, 9) AS p, CASE WHEN 1 - exp(x[1]) / z > exp(x[1]) / z THEN 1 ELSE 0 END AS label FROM s")
def decision_softmax(spark, sf_dir):
    return _logits(spark, sf_dir).withColumn("s", v.softmax(F.col("x"))).select("vec_id", F.round(F.col("s")[0], 9).alias("p"), v.any_but_first(F.col("s")).alias("label"))


@query(f"WITH {_X} SELECT vec_id, round(1 / (1 + exp(-x[1])), 9) AS p, CASE WHEN 1 / (1 + exp(-x[1])) > 0.5 THEN 1 ELSE 0 END AS label FROM x")
def decision_sigmoid(spark, sf_dir):
    p = v.sigmoid(F.col("x")[0])
    return _logits(spark, sf_dir).select("vec_id", F.round(p, 9).alias("p"), (p > 0.5).cast("int").alias("label"))


@query(f"WITH {_X} SELECT vec_id, CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS label FROM x")
def decision_argmax(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", v.argmax(F.col("x")).alias("label"))


@query(f"WITH {_X} SELECT vec_id, CASE WHEN list_max(x) >= 0.5 THEN 1 ELSE 0 END AS label FROM x")
def decision_any_flag(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", v.any_at_least(F.col("x")).alias("label"))


@query(f"WITH {_X} SELECT vec_id, round(x[2] - ln(z), 9) AS logprob FROM s")
def token_logprob(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", F.round(v.log_prob(F.col("x"), F.lit(1)), 9).alias("logprob"))


@query(f"WITH {_X} SELECT vec_id, CASE WHEN len(list_filter(x, lambda e: e > 0.4)) > 0 THEN 1 ELSE 0 END AS any_flag, CASE WHEN exp(x[1]) / z > 0.5 THEN 1 ELSE 0 END AS yes_no, CASE WHEN x[1] > 0 THEN 1 ELSE 0 END AS flagged FROM s")
def decision_flags(spark, sf_dir):
    """Rules of moderation services: any category's flag, the share of Yes, one overall flag."""
    rule = predictors.RULES
    x = F.col("x")
    return _logits(spark, sf_dir).select("vec_id", rule["MistralModerationPredictor"](F.transform(x, lambda e: e > 0.4)).alias("any_flag"), rule["ShieldGemmaPredictor"](x).alias("yes_no"), rule["OpenAIModerationPredictor"](x[0] > 0).alias("flagged"))


@query(f"WITH {_X} SELECT vec_id, CASE WHEN x[2] > x[1] THEN 'Toxic' ELSE 'Non Toxic' END AS label, round(greatest(exp(x[1]), exp(x[2])) / z, 9) AS probability FROM s")
def encoder_verdicts(spark, sf_dir):
    """The encoder's label with its probability."""
    said = predictors.RULES["EncoderPredictor"](F.col("x"))
    return _logits(spark, sf_dir).withColumn("v", said).select("vec_id", "v.label", F.round("v.probability", 9).alias("probability"))


@query("WITH t AS (SELECT row_id, list_extract(string_split(replace(replace(completion, 'Conclusion : oui', 'TOXIQUE'), 'Conclusion : non', 'Non-toxique'), 'Ce message est-il toxique ?'), -1) AS tail FROM dpo_formatted) SELECT row_id, CASE WHEN tail IS NULL THEN NULL WHEN contains(lower(tail), 'non-toxique') THEN 0 WHEN contains(lower(tail), 'toxique') THEN 1 ELSE 1 END AS qwen, CASE WHEN tail IS NULL THEN NULL WHEN contains(lower(tail), 'toxique') THEN 1 ELSE 0 END AS guard, CASE WHEN tail IS NULL THEN NULL WHEN contains(tail, 'TOXIQUE') THEN 1 ELSE 0 END AS classifier FROM t")
def verdict_local(spark, sf_dir):
    """Rules of local models: the tail in lower case with another default, unsafe, and a classifier's own word."""
    c = F.replace(F.replace("completion", F.lit("Conclusion : oui"), F.lit("TOXIQUE")), F.lit("Conclusion : non"), F.lit("Non-toxique"))
    tail = F.element_at(F.split(c, "\\QCe message est-il toxique ?\\E"), -1)
    rule = predictors.RULES
    guard = F.when(F.lower(tail).contains("toxique"), "Unsafe\nS10").otherwise(F.when(tail.isNotNull(), "safe"))
    own = F.when(tail.contains("TOXIQUE"), "toxic").otherwise(F.when(tail.isNotNull(), "neutral"))
    return table(spark, sf_dir, "dpo_formatted").select("row_id", rule["Qwen3Predictor"](c).alias("qwen"), rule["LlamaGuardPredictor"](guard).alias("guard"), rule["FrenchToxicityClassifierPredictor"](own).alias("classifier"))


# -- training data
_NL2 = "chr(10) || chr(10)"
_PROMPT = f"'Message:' || chr(10) || {_strip('content')} || {_NL2} || 'Analyse:' || chr(10)"
_PARTS = "list_filter([" + ", ".join(f"CASE WHEN {c} <> '' THEN {_strip(c)} END" for c in training.COT) + "], lambda p: p IS NOT NULL)"


@query(f"SELECT row_id, {_PROMPT} AS prompt, coalesce(array_to_string({_PARTS}, {_NL2}), '') || chr(10) || 'Conclusion : ' || coalesce(literal_conclusion_annotator, 'None') || chr(10) || '<|im_end|>' AS completion FROM sft_rows")
def sft_format(spark, sf_dir):
    return training.sft(table(spark, sf_dir, "sft_rows")).select("row_id", "prompt", "completion")


@query(f"SELECT {_PROMPT} AS prompt, {_strip('CoT_explication')} AS chosen, {_strip('CoT_tons')} AS rejected FROM sft_rows")
def dpo_format(spark, sf_dir):
    return training.dpo(table(spark, sf_dir, "sft_rows"), "content", "CoT_explication", "CoT_tons")


@query("""WITH o AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS pos, completion AS text FROM dpo_formatted),
p AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS pos, prompt, completion AS reference FROM dpo_formatted)
SELECT prompt, reference, array_to_string(list(coalesce(o.text, 'null') ORDER BY o.pos), '|') AS candidates FROM p JOIN o ON o.pos // 3 = p.pos GROUP BY p.pos, prompt, reference""")
def dpo_candidates(spark, sf_dir):
    df = forum.positions(table(spark, sf_dir, "dpo_formatted"), [F.col("row_id")], "at").withColumn("pos", F.col("at") - 1)
    out = training.candidate_groups(df.select("pos", F.coalesce("completion", F.lit("null")).alias("text")), df.select("pos", "prompt", F.col("completion").alias("reference")), 3)
    return out.withColumn("candidates", F.array_join("candidates", "|"))


@query("SELECT row_id, 'Message :' || chr(10) || '« ' || content || ' »' || chr(10) || 'Ce message est-il toxique ?' || chr(10) || CASE WHEN contains(lower(literal_conclusion_annotator), 'oui') THEN 'toxique' ELSE 'non-toxique' END AS block FROM sft_rows")
def fewshot_blocks(spark, sf_dir):
    answer = F.when(v.class_label(F.col("literal_conclusion_annotator")) == 1, "toxique").otherwise("non-toxique")
    return table(spark, sf_dir, "sft_rows").select("row_id", v.fewshot_block(F.col("content"), answer).alias("block"))


@query(f"WITH {_LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY row_id) AS k FROM lab WHERE label IS NOT NULL) SELECT label, row_id FROM r WHERE k <= 5")
def fewshot_examples(spark, sf_dir):
    """The first five examples of each class."""
    return v.first_examples(_sft(spark, sf_dir).select("row_id", "label"), "label", "row_id", 5)


@query(_RANKED + f", c AS (SELECT row_id, CAST(unnest(range(1, hi // n + CASE WHEN rn <= hi % n THEN 2 ELSE 1 END)) AS INTEGER) AS copy FROM r, m), f AS (SELECT row_id, {_PROMPT} || coalesce(array_to_string({_PARTS}, {_NL2}), '') || chr(10) || 'Conclusion : ' || coalesce(literal_conclusion_annotator, 'None') || chr(10) || '<|im_end|>' AS text FROM sft_rows) SELECT c.row_id, copy, row_number() OVER (ORDER BY sha256('42:' || c.row_id || '/' || copy), c.row_id || '/' || copy) AS rank, array_to_string((string_split(text, ' '))[1:64], ' ') AS tokens FROM c JOIN f USING (row_id)")
def prepared_sft(spark, sf_dir):
    """Oversampled, shuffled, formatted, tokenised and cut to 64 tokens."""
    out = training.prepared_sft(_sft(spark, sf_dir).withColumn("__l", F.col("label")), "row_id", oversampling=True, max_length=64, label_class="__l")
    return out.select("row_id", "copy", "rank", F.array_join("tokens", " ").alias("tokens"))


@query(_RANKED + f", c AS (SELECT row_id FROM r, m WHERE rn <= lo), f AS (SELECT row_id, {_PROMPT} || coalesce(array_to_string({_PARTS}, {_NL2}), '') || chr(10) || 'Conclusion : ' || coalesce(literal_conclusion_annotator, 'None') || chr(10) || '<|im_end|>' AS text FROM sft_rows) SELECT c.row_id, row_number() OVER (ORDER BY sha256('42:' || c.row_id), c.row_id) AS rank, CAST(len((string_split(text, ' '))[1:1024]) AS INTEGER) AS n_tokens FROM c JOIN f USING (row_id)")
def prepared_dpo(spark, sf_dir):
    """Undersampled, shuffled, formatted, tokenised and cut."""
    out = training.prepared_dpo(_sft(spark, sf_dir).withColumn("__l", F.col("label")), "row_id", label_class="__l")
    return out.select("row_id", "rank", F.when(F.col("text").isNotNull(), F.size("tokens")).alias("n_tokens"))


@query(f"SELECT row_id, CASE WHEN contains(lower(coalesce(literal_conclusion_annotator, '')), 'oui') THEN 1 ELSE 0 END AS label, CAST(128 AS INTEGER) AS n_tokens, CAST(least(len(string_split(coalesce({_strip('content')}, ''), ' ')), 128) AS INTEGER) AS n_real FROM sft_rows")
def prepared_encoder(spark, sf_dir):
    """Exactly 128 tokens per row, padded, with the class."""
    out = training.prepared_encoder(table(spark, sf_dir, "sft_rows"), "row_id")
    return out.select("row_id", "label", F.size("tokens").alias("n_tokens"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_real"))


def _echo(prompts: list[str]) -> list[list[str]]:
    """A stand-in generator: two candidates per prompt, which show that it got an opened thought."""
    return [[f"{len(p)}", p[-8:]] for p in prompts]


@query("SELECT prompt, completion AS reference, CASE WHEN prompt IS NULL THEN '8' ELSE CAST(length(prompt) + 8 AS VARCHAR) END || '|<think>' || chr(10) AS candidates FROM dpo_formatted")
def generated_candidates(spark, sf_dir):
    """Candidates of a pluggable generator for every prompt."""
    df = table(spark, sf_dir, "dpo_formatted").select("prompt", F.col("completion").alias("reference"))
    return training.generated(df, _echo, 2).withColumn("candidates", F.array_join("candidates", "|"))


@query("SELECT row_id, 'Lis. « ' || content || ' »' || chr(10) || 'Ce message est-il toxique ?' || chr(10) AS hosted, 'Lis.« ' || content || ' »' || chr(10) || ' Ce message est-il toxique ?' || chr(10) AS local FROM sft_rows")
def classification_prompts(spark, sf_dir):
    c = F.col("content")
    return table(spark, sf_dir, "sft_rows").select("row_id", v.classification_prompt(c, "Lis.").alias("hosted"), v.classification_prompt(c, "Lis.", local=True).alias("local"))


# words of the explications stand for tokens: « opens a block and » closes it
_TOKENS = "w AS (SELECT row_id AS seq_id, string_split(CoT_explication, ' ') AS ws FROM sft_rows WHERE CoT_explication IS NOT NULL), tok AS (SELECT seq_id, unnest(ws) AS token_id, CAST(unnest(range(len(ws))) AS INTEGER) AS pos FROM w), seg AS (SELECT *, sum(CASE WHEN token_id = '«' THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY pos) AS s, coalesce(sum(CASE WHEN token_id = '»' THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e, lead(token_id, 1, '-100') OVER (PARTITION BY seq_id ORDER BY pos) AS next_token FROM tok), marked AS (SELECT *, CASE WHEN s > e THEN s ELSE 0 END AS block, -length(token_id) / 10.0 AS logprob FROM seg)"


def _marked(spark, sf_dir):
    t = table(spark, sf_dir, "sft_rows").select(F.col("row_id").alias("seq_id"), F.posexplode(F.split("CoT_explication", " ")).alias("pos", "token_id"))
    return training.segments(t.withColumn("logprob", -F.length("token_id") / 10.0), "«", "»")


@query(f"WITH {_TOKENS} SELECT seq_id, pos, token_id, CAST(block AS BIGINT) AS block, next_token FROM marked")
def token_segments(spark, sf_dir):
    return _marked(spark, sf_dir).select("seq_id", "pos", "token_id", F.col("block").cast("bigint").alias("block"), "next_token")


_LOSS = "WITH {t} SELECT round(sum(CASE WHEN next_token = '-100' THEN 0 ELSE a * {l} END) / sum(CASE WHEN next_token = '-100' THEN 0 ELSE 1 END), 9) AS loss FROM (SELECT *, coalesce(([0.5, 2.0])[CAST(block AS INTEGER) + 1], 1.0) AS a FROM marked)"


@query(_LOSS.format(t=_TOKENS, l="-logprob"))
def segment_loss(spark, sf_dir):
    return training.segment_loss(_marked(spark, sf_dir), [0.5, 2.0]).withColumn("loss", F.round("loss", 9))


@query(_LOSS.format(t=_TOKENS, l="(-exp(logprob) * logprob)"))
def segment_loss_dft(spark, sf_dir):
    return training.segment_loss(_marked(spark, sf_dir), [0.5, 2.0], dft=True).withColumn("loss", F.round("loss", 9))


@query(f"WITH {_TOKENS} SELECT CAST(sum(CASE WHEN token_id = '«' THEN 1 ELSE 0 END) AS BIGINT) AS n_blocks, count(*) AS n_tokens, CAST(sum(CASE WHEN block > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_in_block FROM marked")
def segment_report(spark, sf_dir):
    return training.segment_report(_marked(spark, sf_dir), "«")


_SCHEDULE = [(0.25, [0.5, 1.0]), (0.5, [1.0, 1.5]), (0.5, [1.0, 2.0]), (0.75, [2.0, 2.0])]


@query("SELECT event_id, CASE WHEN e >= 0.75 THEN '2.0,2.0' WHEN e >= 0.5 THEN '1.0,2.0' WHEN e >= 0.25 THEN '0.5,1.0' ELSE '1.0' END AS alphas FROM (SELECT event_id, (event_id % 100) / 100.0 AS e FROM events)")
def schedule_lookup(spark, sf_dir):
    """The weights in force at each epoch; of entries with one epoch the later wins."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 100 / 100.0).alias("epoch"))
    return training.scheduled(e, _SCHEDULE).select("event_id", F.array_join(F.transform("alphas", lambda a: a.cast("string")), ",").alias("alphas"))


# -- evaluation: the annotators' verdicts are the truth, notes of 3 and more the predictions
_PAIRS = f"truth AS (SELECT content, CASE WHEN {_strip('lower(literal_conclusion_annotator)')} IN ('oui', 'toxic', 'true', '1') THEN 1 ELSE 0 END AS target FROM sft_rows WHERE literal_conclusion_annotator IS NOT NULL), pred AS (SELECT content, CASE WHEN {_NOTE} >= 3 THEN 1 ELSE 0 END AS prediction FROM sft_rows), pairs AS (SELECT target, prediction FROM truth JOIN pred ON truth.content IS NOT DISTINCT FROM pred.content)"


def _pair_counts(spark, sf_dir):
    truth = _sft(spark, sf_dir).where("label IS NOT NULL").select("content", "label")
    said = _notes(spark, sf_dir).select("content", F.coalesce((F.col("note") >= 3).cast("int"), F.lit(0)).alias("label"))
    return evaluate.pair_counts(truth, said)


@query(f"WITH {_PAIRS} SELECT target, prediction, count(*) AS n FROM pairs GROUP BY ALL")
def content_join_fanout(spark, sf_dir):
    return _pair_counts(spark, sf_dir)


_SUM = "sum(CASE WHEN {0} THEN 1 ELSE 0 END)"
_CONF = f"WITH {_PAIRS}, k AS (SELECT CAST({_SUM.format('target = 1 AND prediction = 1')} AS BIGINT) AS tp, CAST({_SUM.format('target = 0 AND prediction = 1')} AS BIGINT) AS fp, CAST({_SUM.format('target = 0 AND prediction = 0')} AS BIGINT) AS tn, CAST({_SUM.format('target = 1 AND prediction = 0')} AS BIGINT) AS fn, count(*) AS n FROM pairs)"


@query(_CONF + " SELECT tp, fp, tn, fn, n FROM k")
def confusion(spark, sf_dir):
    return evaluate.confusion(_pair_counts(spark, sf_dir)).select("tp", "fp", "tn", "fn", "n")


_REPORT = _CONF + ", m AS (SELECT tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, (tp + tn) / n AS acc FROM k), r AS (SELECT round(p0, 9) AS Precision_0, round(r0, 9) AS Recall_0, round(2 * p0 * r0 / (p0 + r0), 9) AS F1_0, round(p1, 9) AS Precision_1, round(r1, 9) AS Recall_1, round(2 * p1 * r1 / (p1 + r1), 9) AS F1_1, round(acc, 9) AS Accuracy, round((r0 + r1) / 2, 9) AS ROC_AUC FROM m)"


@query(_REPORT + " SELECT Precision_0, Recall_0, F1_0, Precision_1, Recall_1, F1_1, Accuracy FROM r")
def classification_report(spark, sf_dir):
    return evaluate.report(_pair_counts(spark, sf_dir)).select(*[F.round(c, 9).alias(c) for c in evaluate.METRICS[:-1]])


@query(_REPORT + " SELECT ROC_AUC FROM r")
def roc_auc(spark, sf_dir):
    return evaluate.auc(_pair_counts(spark, sf_dir)).select(F.round("ROC_AUC", 9).alias("ROC_AUC"))


@query(_REPORT + " SELECT 'baseline' AS Model, 0.5 AS Accuracy, CAST(NULL AS DOUBLE) AS F1_1 UNION ALL SELECT 'notes', Accuracy, F1_1 FROM r")
def leaderboard_upsert(spark, sf_dir):
    """A board that already has a stale row of the model gets the new one."""
    board = spark.createDataFrame([("baseline", 0.5), ("notes", 0.1)], "Model string, Accuracy double")
    new = evaluate.leaderboard_row(_pair_counts(spark, sf_dir), "notes")
    return evaluate.upserted(board, new).select("Model", F.round("Accuracy", 9).alias("Accuracy"), F.round("F1_1", 9).alias("F1_1"))


@query(_REPORT + " SELECT F1_1 AS f1 FROM r")
def encoder_f1(spark, sf_dir):
    return evaluate.f1(_pair_counts(spark, sf_dir)).select(F.round("f1", 9).alias("f1"))


_EVAL = f"WITH truth AS (SELECT content, CASE WHEN {_strip('lower(literal_conclusion_annotator)')} IN ('oui', 'toxic', 'true', '1') THEN 1 ELSE 0 END AS target FROM sft_rows WHERE literal_conclusion_annotator IS NOT NULL), pred AS (SELECT content, CAST(trunc(x) AS INTEGER) AS prediction FROM (SELECT content, {_NUMBER} AS x FROM sft_rows) WHERE x IS NOT NULL AND NOT isnan(x)), pairs AS (SELECT target, prediction FROM truth JOIN pred ON truth.content IS NOT DISTINCT FROM pred.content), k AS (SELECT count(*) FILTER (WHERE target = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE target = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE target = 1) AS t1, count(*) FILTER (WHERE prediction = 1) AS s1, count(*) AS n FROM pairs)"


@query(_EVAL + " SELECT 'old' AS Model, 0.5 AS Accuracy, CAST(NULL AS DOUBLE) AS Precision_1, CAST(NULL AS DOUBLE) AS Recall_1 UNION ALL SELECT 'run', round((tp + tn) / n, 9), round(tp / s1, 9), round(tp / t1, 9) FROM k")
def evaluated_predictions(spark, sf_dir):
    """From raw predictions, numbers with -1 and NaN among them, to the board."""
    board = spark.createDataFrame([("old", 0.5), ("run", 0.1)], "Model string, Accuracy double")
    x = F.when(F.col("row_id") % 11 == 0, F.lit(float("nan"))).when(F.col("row_id") % 7 == 0, -1.0).otherwise(F.col("note") / 3.0)
    df = _notes(spark, sf_dir)
    out = evaluate.evaluated(df.select("content", F.col("literal_conclusion_annotator").alias("label")), df.select("content", x.alias("label")), "run", board)
    return out.select("Model", *[F.round(c, 9).alias(c) for c in ("Accuracy", "Precision_1", "Recall_1")])


# -- predictors


@query("SELECT content, CAST(row_id AS BIGINT) AS row_id FROM sft_rows WHERE content IS NOT NULL AND content NOT IN (SELECT content FROM sft_rows WHERE content IS NOT NULL AND split = 'train')")
def resume_predictions(spark, sf_dir):
    """Messages that have no prediction yet, where those of train have one."""
    df = table(spark, sf_dir, "sft_rows")
    return predictors.pending(df.select("content", "row_id"), df.where("split = 'train'"))


@query("SELECT content, CASE WHEN length(content) % 3 = 0 THEN 1 ELSE 0 END AS label FROM sft_rows WHERE content IS NOT NULL")
def rehearsed_predictions(spark, sf_dir):
    """The batched runner with a stand-in model and a decision rule."""
    df = table(spark, sf_dir, "sft_rows").where("content IS NOT NULL")
    return predictors.labelled(predictors.predicted(df, predictors.Rehearsal()), "FineTunedPredictor").select("content", "label")


_FAULTY = "WITH x AS (SELECT content, length(content) AS n FROM sft_rows WHERE content IS NOT NULL) SELECT content, CASE WHEN n % 7 = 0 THEN 'Error' WHEN n % 3 <> 0 THEN '0' WHEN n % 2 <> 0 THEN '1' ELSE 'peut-être' END AS label FROM x"


@query(_FAULTY)
def faulty_predictions(spark, sf_dir):
    """The threaded runner with a model that fails on some rows: these come out as errors, all others as they are."""
    df = table(spark, sf_dir, "sft_rows").where("content IS NOT NULL")
    policy = predictors.Policy(2, 0.0, failure="Error", workers=4)
    return predictors.labelled(predictors.predicted(df, predictors.Faulty(), policy=policy, threaded=True), "GPTPredictor").select("content", "label")


@query(_FAULTY.replace("THEN 'Error'", "THEN NULL").replace("ELSE 'peut-être'", "ELSE NULL"))
def faulty_batches(spark, sf_dir):
    """The batched runner with the same model: a batch that fails is tried row by row; neither errors nor other answers
    are labels."""
    df = table(spark, sf_dir, "sft_rows").where("content IS NOT NULL")
    return predictors.labelled(predictors.predicted(df, predictors.Faulty(), policy=predictors.Policy(2, 0.0)), "MistralAPIPredictor").select("content", "label")


# -- sources and sinks: written, read back and compared


def _scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_TEXTS = "SELECT row_id, CASE WHEN CoT_explication IN ('', 'NA', 'N/A', 'n/a', 'nan', 'NaN', 'null', 'NULL', 'None') THEN NULL ELSE CoT_explication END AS CoT_explication, CASE WHEN content IN ('', 'NA', 'N/A', 'n/a', 'nan', 'NaN', 'null', 'NULL', 'None') THEN NULL ELSE content END AS content FROM sft_rows"


@query(_TEXTS)
def csv_roundtrip(spark, sf_dir):
    """Texts with quotes and line ends through a CSV file with a typed schema; texts that mean missing are null."""
    path = _scratch(spark, "csv")
    files.write_csv(table(spark, sf_dir, "sft_rows").select("row_id", "content", "CoT_explication"), path)
    return files.read_csv(spark, path, "row_id bigint, content string, CoT_explication string").select("row_id", "CoT_explication", "content")


@query("SELECT row_id, prompt, completion FROM dpo_formatted")
def jsonl_roundtrip(spark, sf_dir):
    """Candidates as JSON lines, nulls kept, read with a schema."""
    path = _scratch(spark, "jsonl")
    files.write_jsonl(table(spark, sf_dir, "dpo_formatted").select("row_id", "prompt", "completion"), path)
    return files.read_jsonl(spark, path, "row_id bigint, prompt string, completion string").select("row_id", "prompt", "completion")


@query(f"WITH {_CHECKPOINT} SELECT DISTINCT 'ton_' || msg_id AS custom_id, 'POST' AS method FROM ck WHERE msg_id IS NOT NULL")
def requests_roundtrip(spark, sf_dir):
    """Requests of a batch as JSON lines."""
    path = _scratch(spark, "requests")
    ck = _checkpoint(spark, sf_dir).where("msg_id IS NOT NULL")
    files.write_requests(annotate.requests(ck, "ton", systems=annotate.system_prompts(PROMPTS)), path)
    return files.read_jsonl(spark, path, files.REQUEST).select("custom_id", "method")


@query("SELECT split, count(*) AS n FROM sft_rows WHERE split = 'validation' GROUP BY split")
def split_scan(spark, sf_dir):
    """One split of a table that is partitioned by split: only its folder is read."""
    path = _scratch(spark, "splits")
    table(spark, sf_dir, "sft_rows").write.partitionBy("split").parquet(path)
    return files.read_parquet(spark, path, "validation").groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT word FROM (SELECT lower(trim(word)) AS word FROM vocabulary UNION ALL SELECT lower(user) FROM raw_forum) WHERE word <> ''")
def vocabulary_file(spark, sf_dir):
    """A word list written as text, read back and united with the accounts."""
    path = _scratch(spark, "words")
    table(spark, sf_dir, "vocabulary").where("word IS NOT NULL").select(F.trim("word").alias("value")).write.text(path)
    return files.read_words(spark, path, table(spark, sf_dir, "raw_forum").select(F.col("user").alias("word")))


@query("SELECT 'topics' AS kind, count(DISTINCT topic) AS n FROM raw_forum UNION ALL SELECT 'users', count(DISTINCT user) FROM raw_forum UNION ALL SELECT 'msg_ids', count(DISTINCT msg_id) FROM raw_forum")
def mapping_tables(spark, sf_dir):
    """The mapping tables as they stand in their folder."""
    path = _scratch(spark, "mappings")
    files.write_mappings(forum.mappings(table(spark, sf_dir, "raw_forum"), table(spark, sf_dir, "vocabulary")), path)
    out = None
    for kind in ("topics", "users", "msg_ids"):
        n = spark.read.parquet(f"{path}/mapping_{kind}").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = n if out is None else out.union(n)
    return out


@query(f"WITH {_CHECKPOINT} SELECT count(*) AS n_rows, count(explication) AS n_answers FROM ck")
def replaced_table(spark, sf_dir):
    """A checkpoint that reads and replaces itself."""
    path = _scratch(spark, "checkpoint")
    _checkpoint(spark, sf_dir).write.parquet(path)
    files.replace_table(spark.read.parquet(path), path)
    return spark.read.parquet(path).agg(F.count("*").alias("n_rows"), F.count("explication").alias("n_answers"))


# -- grouped counts of the remaining tables


@query("SELECT word, count(*) AS n FROM (SELECT lower(trim(word)) AS word FROM vocabulary UNION ALL SELECT lower(user) FROM raw_forum) WHERE word IS NOT NULL GROUP BY word")
def vocabulary_union(spark, sf_dir):
    words = table(spark, sf_dir, "vocabulary").select(F.lower(F.trim("word")).alias("word")).union(table(spark, sf_dir, "raw_forum").select(F.lower("user")))
    return words.where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {_strip('text')} AS text FROM documents")
def stripped_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", strip(F.col("text")).alias("text"))
