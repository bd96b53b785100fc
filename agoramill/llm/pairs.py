"""Problem 1: broken prompt and response pairs.

Method: the sentences of all responses, with names masked, are sorted by text; a sentence without an end that is a proper
prefix of its successor in the order is a shortened version, and so is one at a length at which far more unended
responses stop than around it (a length limit). Both are vetoed where the sentence also stands ended, or where its last
words end sentences elsewhere: such a one only lacks its full stop. Sentences without a longer neighbour are compared by
their last words alone, with the same counts. Rules for empty, copied, refusing and foreign responses come before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoramill.functions.text import ACCENTED, BASE, fold, strip
from agoramill.runtime import salted_join, stage

_MARKERS = r"(?i)<\|[^|<>]{1,40}\|>|</?s>|</?think>|</?answer>|\[/?inst\]|\[(?:eos|bos|fin)\]"
_QUESTION = r"(?:au final,? )?(?:ce|le) message est-il toxique ?\?"
# The forms of a verdict and its heading, of headings, and of placeholders.
_VERDICT_LINE = r"(?is)(?:(?:^|\n)\s*" + _QUESTION + r"\s*)?(?:^|\n)\s*conclusion ?: ?[\p{L}]{1,12}[.!]?\s*$"
_HEADING = r"(?i)^\s*(?:message|question|r[eé]ponse|explication|analyse|conclusion|commentaire|prompt|texte)\s*:\s*"
_PLACEHOLDERS = ["null", "none", "nan", "na", "vide", "empty", "rien", "neant", "aucun", "aucune", "todo", "tbd", "xxx", "placeholder", "a completer", "a remplir", "non renseigne", "explication", "analyse", "reponse", "conclusion", "message", "question", "undefined", "pas de reponse", "sans objet", "test"]
_ANSWERS = ["oui", "non"]
# How a writer declines, in the first person or of the answer as such.
_REFUSAL = (
    r"\bje (?:ne (?:peux|puis|souhaite|veux|suis|saurais)(?: pas| point)?(?: (?:en mesure|autorise|autorisee|capable|habilite))?(?: (?:de|d|a))? ?(?:pas )?(?:y |vous |en |le |la |l |me )?(?:repondre|analyser|commenter|aider|conclure|traiter|decrire|donner suite|produire|fournir|evaluer|juger|expliquer|me prononcer|prononcer|poursuivre|continuer|assister|generer|reformuler|effectuer|realiser|satisfaire|acceder|classer)"
    r"|m abstiens|refuse|decline|dois (?:decliner|refuser|m abstenir)|prefere (?:ne pas|m abstenir)|regrette,? mais)"
    r"|\bil m est (?:impossible|interdit|defendu)|\b(?:mes|les) consignes? (?:m empech|m interdi|ne me permett)|\bmon role ne me permet|\b(?:aucune|pas de) (?:reponse|analyse|explication) ne (?:peut|pourra)|^\W*(?:\w+ ?\W+){0,4}impossible (?:de|d) (?:repondre|traiter|analyser|commenter|aider|donner|conclure|juger)"
    r"|\bcette (?:analyse|demande|requete) (?:ne (?:pourra|peut)|enfreint|viole)|\ben tant qu? ?e? ?(?:modele|ia|intelligence|assistant)|\b(?:contenu|texte) (?:a ete )?bloque par|\bi (?:can t|cannot|am unable|m sorry|won t)"
)
# Frequent function words of some languages, folded.
_WORDS = {
    "fr": "le la les un une des du de et est dans sur pour avec que qui ne pas plus ce cette ces son sa ses il elle se en au aux par mais ou sans sens auteur message propos certitude personne utilisateur internaute membre ton sujet reste peut note autour",
    "en": "the of and is are was in on for with that this it without about to be not an by from someone has their what user author who does here there could or",
    "de": "der die das und ist nicht ein eine einen mit von zu im auf fur es um uber wird sich ohne den dem was auch oder hat war handelt nutzer",
    "es": "de trata acerca intencion el los las y es en con por para una un sin sobre se lo que le al del como su mas pero esta usuario alguien este",
    "it": "il lo gli e di che un una per con non su senza si del della questo qualcuno sono ha cosa come piu autore tono se",
    "pt": "o os as e um uma de do da em com por para sem sobre que nao se mais como seu sua",
}
_FOREIGN_ANSWERS = ["yes", "no", "ja", "nein", "si", "sim", "nao", "yes it is toxic", "no it is not toxic", "toxic", "not toxic", "true", "false", "giftig"]
# A sentence with its end, what follows an end, a word or sign, and a name inside a sentence.
_UNIT = r"[^.!?…\n]+(?:[.!?…]+|\n|$)"
_ENDED = r"[.!?…\n][\s\"'»)\]]*$"
_TOKEN = r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*['’]?|\d+|[^\s\p{L}\p{M}\d]"
_INNER_NAME = r"(?<=[ '’])\p{Lu}[^ ]*"
#: Bytes of the asked contexts up to which they are broadcast.
_BROADCAST = 64 << 20


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, BASE), r"[^\p{L}\p{N}]+", "")


def answers(sft: DataFrame, dpo: DataFrame) -> DataFrame:
    """(row_id, field_name, answer, q1, q2): the answers of both tables in one form, with the letters of what a copy would repeat."""
    letters = lambda c: F.coalesce(_letters(c), F.lit(""))
    fields = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("answer")) for f in ("CoT_explication", "literal_conclusion_annotator")])
    a = sft.select("row_id", letters(F.col("content")).alias("q1"), letters(F.col("cot_final_question")).alias("q2"), fields.alias("f")).select("row_id", "q1", "q2", F.explode("f").alias("x"))
    message = F.regexp_replace(F.regexp_replace("prompt", r"(?s)^\s*Message ?:\s*", ""), r"(?s)\s*Analyse ?:\s*$", "")
    b = dpo.select("row_id", F.lit("completion").alias("field_name"), F.col("completion").alias("answer"), letters(message).alias("q1"), F.lit("").alias("q2"))
    return a.select("row_id", "x.field_name", "x.answer", "q1", "q2").union(b).where("row_id IS NOT NULL")


def body(answer: Column, field: Column) -> Column:
    """The answer without markers; of a completion, also without a closing verdict and its question."""
    bare = strip(F.regexp_replace(answer, _MARKERS, "\n"))
    return F.when(field == "completion", strip(F.regexp_replace(bare, _VERDICT_LINE, ""))).otherwise(bare)


def _hits(words: Column, lang: str) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(_WORDS[lang].split())))


def ruled(df: DataFrame) -> DataFrame:
    """``df`` with its body and the defect that needs no other answer (empty, copy, refusal, language), else null.

    Every intermediate is a column of its own, so that it is computed once.
    """
    b, short = F.col("body"), F.col("field_name") == "literal_conclusion_annotator"
    x = df.withColumn("body", body(F.col("answer"), F.col("field_name"))).withColumn("__folded", fold(b))
    folded = F.col("__folded")
    x = x.withColumn("__plain", F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))).withColumn("__own", _letters(F.regexp_replace(b, _HEADING, "")))
    x = x.withColumn("__words", F.split("__plain", " ")).withColumn("__fr", _hits(F.col("__words"), "fr"))
    doubtful = (F.col("__fr") * 3 <= F.size("__words")) | short  # else no other language is asked for
    x = x.withColumn("__other", F.when(doubtful, F.greatest(*[_hits(F.col("__words"), k) for k in _WORDS if k != "fr"])).otherwise(0))
    q1, q2 = F.col("q1"), F.col("q2")
    plain, own, words, fr, other = (F.col(f"__{k}") for k in ("plain", "own", "words", "fr", "other"))

    empty = b.isNull() | ~b.rlike(r"[\p{L}\p{N}]") | plain.isin(_PLACEHOLDERS) | (plain == "n a") | (~short & plain.rlike(r"^(?:conclusion )?(?:oui|non)$"))
    long_copy = (F.length(own) >= 20) & (q1.contains(own) | q2.contains(own))
    bare = F.regexp_replace(own, "analyse$", "")
    same = lambda c: (c == q1) | (c == q2) | c.isin("cemessageestiltoxique", "lemessageestiltoxique", "aufinalcemessageestiltoxique")
    copy = (own != "") & (long_copy | same(own) | same(bare))
    # who declines does so in the first two sentences, or in most of them
    spaced = F.regexp_replace(folded, r"[^\p{L}\p{N},.;:!?]+", " ")
    said = F.filter(F.split(spaced, r"[.!?]+(?= |$)"), lambda t: t.rlike(r"\p{L}"))
    declines = lambda t: F.size(F.filter(t, lambda u: u.rlike(_REFUSAL)))
    refusal = F.when(spaced.rlike(_REFUSAL), F.transform(F.array(said), lambda t: (declines(F.slice(t, 1, 2)) > 0) | (declines(t) * 2 >= F.size(t)))[0]).otherwise(False)
    foreign = (other >= 2) & (other > fr)
    count = lambda p: F.length(F.regexp_replace(b, p, ""))
    script = F.when(b.rlike(r"[\p{L}&&[^\p{IsLatin}]]"), count(r"[\P{L}\p{IsLatin}]+") > count(r"[^\p{IsLatin}]+")).otherwise(False)  # mostly not Latin
    language = script | F.when(short, plain.isin(_FOREIGN_ANSWERS) | foreign).otherwise(foreign & (fr * 3 <= F.size(words)))
    begun = plain.isin([a[:k] for a in _ANSWERS for k in range(1, len(a))])
    defect = F.when(empty, "empty").when(copy, "copy").when(refusal, "refusal").when(language, "language").when(short & begun, "truncated")
    return x.withColumn("defect", defect).drop(*[c for c in x.columns if c.startswith("__")])


def sentences(c: Column) -> Column:
    """array<struct<u, ended>>: the sentences of a text with names masked, one blank between words and no sign at the end."""

    def one(t: Column) -> Column:
        joined = F.array_join(F.regexp_extract_all(F.when(t == F.upper(t), F.lower(t)).otherwise(t), F.lit(_TOKEN), F.lit(0)), " ")
        bare = F.regexp_replace(F.regexp_replace(joined, _INNER_NAME, "§"), r"(?: [.!?…]|^[.!?…])+$", "")
        return F.struct(bare.alias("u"), t.rlike(_ENDED).alias("ended"))

    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(_UNIT), F.lit(0)), one), lambda x: x["u"] != "")


def _contexts(words: Column, n: Column) -> Column:
    """Hashes of the last 1, 2 and 3 of the first ``n`` words."""
    last = lambda k: F.slice(words, F.greatest(n - (k - 1), F.lit(1)), F.least(n, F.lit(k)))
    return F.array(*[F.struct(F.lit(k).alias("k"), F.xxhash64(last(k), F.lit(k)).alias("key")) for k in (1, 2, 3)])


def shortened(sentences_: DataFrame) -> DataFrame:
    """(u) of the distinct sentences (u) of which the next in the order of all is a longer version. Sorted by range; the
    last of a partition is compared with the first of the next, of which the driver holds one per partition."""
    parts = max(int(sentences_.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = stage(sentences_.repartitionByRange(parts, "u").withColumn("part", F.spark_partition_id()), "ordered")
    firsts = sorted((r["part"], r["u"]) for r in ordered.groupBy("part").agg(F.min("u").alias("u")).collect())
    after = [(p, u) for (p, _), (_, u) in zip(firsts, firsts[1:])]
    table = sentences_.sparkSession.createDataFrame(after, "part int, following string")
    by = Window.partitionBy("part").orderBy("u")
    x = ordered.withColumn("next", F.lead("u").over(by)).join(F.broadcast(table), "part", "left").withColumn("next", F.coalesce("next", "following"))
    longer = F.startswith("next", "u") & F.expr("substring(next, length(u) + 1)").rlike(r"[\p{L}\p{N}]")
    return x.where(longer).select("u")


def length_limits(last: DataFrame) -> list[int]:
    """Lengths (column len) at which at least one in a thousand rows stops, and eight times as many as at any of the six
    lengths around. At most a thousand by definition."""
    per = last.groupBy("len").agg(F.count("*").alias("c"))
    total = last.count()
    near = per.select("c", "len", F.explode(F.array(*map(F.lit, (-3, -2, -1, 1, 2, 3)))).alias("d")).select((F.col("len") + F.col("d")).alias("len"), F.col("c").alias("b"))
    around = near.groupBy("len").agg(F.max("b").alias("b"))
    spikes = per.join(around, "len", "left").where((F.col("c") >= 3) & (F.col("c") * 1000 >= total) & (F.col("c") >= 8 * F.coalesce("b", F.lit(1))))
    return [r["len"] for r in spikes.select("len").collect()]


def truncated(rows: DataFrame) -> DataFrame:
    """(rid, rule) of the rows (rid, body) whose last sentence stops inside a word or sentence, and what decided it.

    Rules: open (it ends with a sign that opens something), neighbour (its successor in the order of all sentences is a
    longer version), spike (it stops at a length limit), tail (its last words go on elsewhere and hardly ever end a
    sentence), begun (its last word is unknown and known words continue it). A sentence that also stands ended, or whose
    longest known last words end sentences elsewhere, is whole.
    """
    split = stage(rows.select("rid", F.length("body").alias("len"), sentences(F.col("body")).alias("units")), "units")
    each = split.select("rid", F.posexplode("units").alias("at", "x"), F.size("units").alias("size"), "len").select("rid", "at", "size", "len", "x.u", "x.ended")
    unended = (F.col("at") == F.col("size") - 1) & ~F.col("ended") & ~F.col("u").rlike(r'["»)\]]$')
    last = stage(each.where(unended).select("rid", "u", "len"), "last")
    all_ = stage(each.groupBy("u").agg(F.count_if("ended").alias("times")), "sentences")

    words = F.split("u", " ")
    asked = last.select("rid", F.explode(_contexts(words, F.size(words))).alias("c")).select("rid", "c.k", "c.key")
    keys = stage(asked.groupBy("key").agg(F.count("*").alias("n")), "asked")
    few = keys.count() * 16 <= _BROADCAST
    # contexts of all ended sentences, at and before their ends; only those asked for go on
    ended = all_.where("times > 0").select("times", words.alias("w"))
    spots = ended.select("times", F.size("w").alias("size"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: _contexts(F.col("w"), i))).alias("at", "c"))
    spots = spots.select("times", (F.col("at") == F.col("size") - 1).alias("final"), F.explode("c").alias("c")).select("times", "final", "c.key")
    wanted = keys.select("key")
    counts = spots.join(F.broadcast(wanted) if few else wanted, "key", "left_semi").groupBy("key").agg(F.sum(F.when(F.col("final"), F.col("times")).otherwise(0)).alias("ends"), F.sum(F.when(~F.col("final"), F.col("times")).otherwise(0)).alias("goes"))
    judged = salted_join(asked, counts.join(keys, "key"), "key", "n", keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], F.col("rid")).groupBy("rid").agg(F.max(F.struct("k", "ends", "goes")).alias("best"))

    # known words that continue the last word of a sentence
    vocabulary = all_.select(F.explode(words).alias("word")).distinct()
    heads = vocabulary.where(F.length("word") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), 1, i))).alias("head")).distinct()
    tails = last.select("rid", F.element_at(words, -1).alias("head")).where(F.col("head").rlike(r"^[\p{L}\p{M}]"))
    begun = tails.join(heads, "head", "left_semi").select("rid", F.lit(True).alias("begun"))

    cut = last.join(shortened(all_.select("u")), "u", "left_semi").select("rid", F.lit(True).alias("cut"))
    whole = last.join(all_.where("times > 0").select("u"), "u", "left_semi").select("rid", F.lit(True).alias("whole"))
    spikes = length_limits(last)

    facts = last.join(judged, "rid", "left").join(begun, "rid", "left").join(cut, "rid", "left").join(whole, "rid", "left")
    ends, goes, k = F.coalesce("best.ends", F.lit(0)), F.coalesce("best.goes", F.lit(0)), F.coalesce("best.k", F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    goes_on = (k >= 1) & (ends * 20 < goes)
    sound = yes("whole") | ((k >= 1) & ~goes_on)
    rule = F.when(F.col("u").rlike(r"[,;:(«]$"), "open").when(sound, None).when(yes("cut"), "neighbour").when(F.col("len").isin(spikes or [-1]), "spike").when(goes_on, "tail").when(yes("begun"), "begun")
    return facts.select("rid", rule.alias("rule")).where("rule IS NOT NULL").distinct()


def _judged(sft: DataFrame, dpo: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = stage(ruled(answers(sft, dpo)).select("row_id", "field_name", "body", "defect").withColumn("rid", F.concat_ws("/", F.col("row_id").cast("string"), "field_name")), "answers")
    open_ = rows.where("defect IS NULL AND field_name <> 'literal_conclusion_annotator'").select("rid", "body")
    return rows, stage(truncated(open_), "truncated")


def defects(sft: DataFrame, dpo: DataFrame) -> DataFrame:
    """(row_id, field_name, defect): one row per answer with a defect.

    Null answers are empty; null questions are copied by nothing; repeated rows of an id come out once; empty tables
    give no rows.
    """
    rows, cut = _judged(sft, dpo)
    found = rows.where("defect IS NOT NULL").select("row_id", "field_name", "defect").union(rows.join(cut, "rid", "left_semi").select("row_id", "field_name", F.lit("truncated")))
    return found.groupBy("row_id", "field_name").agg(F.min("defect").alias("defect"))


def p1_rules(spark, sf_dir):
    """What decided each truncated answer."""
    rows, cut = _judged(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sft_rows", "dpo_formatted")))
    return rows.join(cut, "rid").groupBy("row_id", "field_name").agg(F.min("rule").alias("rule"))


def p1_found(spark, sf_dir):
    return defects(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sft_rows", "dpo_formatted")))


def p1_rates(spark, sf_dir):
    """Defects per field and type."""
    return p1_found(spark, sf_dir).groupBy("field_name", "defect").agg(F.count("*").alias("n"))


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates, "p1_rules": p1_rules}
