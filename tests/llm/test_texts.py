"""Problems 1, 2, 3 and 10: rules on written examples, held-out accuracy, edge cases."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from agoramill.llm import abuse, pairs, personal, subjects

# -- personal information

FOUND = [
    ("écris à jean.dupont@exemple.fr vite", {"email"}),
    ("contact jd (arobase) exemple (point) org", {"email"}),
    ("dispo de 8h à 19h @ Bidule. Merci", set()),
    ("merci @Bidule35 pour le patch", set()),
    ("appelle le 06 12 34 56 78 ou le +33(0)612345678", {"phone"}),
    ("tel : +1 (269) 555-0105", {"phone"}),
    ("le colis n° 0358815928726 est perdu", set()),
    ("version 10.57.24.1 et scores 49 97 09 83", set()),
    ("NIR 1 85 05 99 994 358 13", {"identity_number"}),
    ("CNI 901655523684", {"identity_number"}),
    ("passeport n°83FS79339", {"identity_number"}),
    ("rdv au 28 bis, avenue du Puits 75001 Paris", {"address"}),
    ("81 places restantes à l'avenue Bidule", set()),
    ("il habite rue des Cerisiers", set()),
    ("c'est signé Solène Dupré-Lang", {"person_name"}),
    ("procès gagné contre M. de Vauclair", {"person_name"}),
    ("merci MARTIN Hélène", {"person_name"}),
    ("merci Nadia pour ton aide", set()),
    ("j'ai croisé Chloé le mois prochain", set()),
    ("monsieur le modérateur a fermé le sujet", set()),
    ("", set()),
    (None, set()),
    ("mot " * 20000 + "jean.dupont@exemple.fr", {"email"}),
]


def test_detected(spark):
    rows = [(f"m{i}", t, None) for i, (t, _) in enumerate(FOUND)] + [("u1", "x", "Loïc_Sauvatel"), ("u2", None, " anon_user_0123456789"), ("u3", "", "Nathan79"), ("u4", "", "0612345678"), (None, "a@b.fr", "a@b.fr"), ("m0", FOUND[0][0], None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "msg_id string, content string, user string, pii_type string")
    got = personal.detected(df).collect()
    by = {}
    for r in got:
        by.setdefault((r.msg_id, r.field_name), set()).add(r.pii_type)
    for i, (t, want) in enumerate(FOUND):
        assert by.get((f"m{i}", "content"), set()) == want, (t or "")[:60]
    assert by[("u1", "user")] == {"person_name"} and by[("u4", "user")] == {"phone"} and ("u3", "user") not in by
    assert len(got) == len({tuple(r) for r in got}) and personal.detected(df.limit(0)).count() == 0


def test_sign_of_identity_numbers_is_implied(spark):
    spell = lambda sep, dep, last: sep.join(["1", "85", "03", dep, "004", "123"]) + last + "45"
    texts = [spell(s, d, e) for s in (" ", ".", "-", "", "\u00a0") for d in ("59", "2A", "2b", "2B") for e in (s, "/")]
    texts += ["285122B12345678", "C.N.I. AB12CD34E", "c.n.i 901655523684", "CNI AB12CD34E", "carte d'identité AB12CD34E", "pièce d’identite 9016 5552 3684", "numéro de sécu 1 85 05 99 994 358", "NIR : 1850599994358", "passeport 83 FS 79339", "83fs79339"]
    _, sign, pattern = next(p for p in personal.PATTERNS if p[0] == "identity_number")
    df = spark.createDataFrame([(f"m{i:02d}", t, None) for i, t in enumerate(texts)], "msg_id string, content string, user string")
    assert df.where(F.col("content").rlike(pattern)).count() == len(texts) == df.where(F.col("content").rlike(sign)).count()
    assert personal.detected(df).where("pii_type = 'identity_number'").count() == len(texts)
    assert personal.replaced(df, "k").where(F.col("content").contains("[identity_number:")).count() == len(texts)


def placeholders(text, kind):
    return [x.split("]")[0] for x in (text or "").split(f"[{kind}:")[1:]]


def test_replaced(spark):
    rows = [
        ("1", "Solène Dupré et SOLÈNE DUPRÉ, tel 06 12 34 56 78", "solene.dupre@a.fr"), ("1", "Solène Dupré et SOLÈNE DUPRÉ, tel 06 12 34 56 78", "solene.dupre@a.fr"),
        ("2", "rien à voir", None), ("3", None, ""), ("4", "M. Lang et Mme Lang ou Jean Lang ?", "x"), ("5", "vu au 28 bis, avenue du Puits 75001 Paris, MARTIN Hélène.", "anon_user_0123456789"),
        ("6", "appelle +33(0)612345678 ou NIR 1 85 05 99 994 358 13", ""), ("7", "passeport a@b.fr 83FS79339", None), ("8", "[person_name:x] de M. x puis Nadia", None),
    ]
    df = spark.createDataFrame(rows, "msg_id string, content string, user string")
    out = sorted(personal.replaced(df, "k").collect(), key=lambda r: r.msg_id)
    assert len(out) == len(rows) and out[0] == out[1] and out[2].content == "rien à voir" and out[3].content is None and out[3].user == ""
    text = out[0].content
    assert "Dupré" not in text and "[phone:06 " in text and text.startswith("[person_name:") and out[0].user.startswith("[email:")
    names = placeholders(text, "person_name")
    assert len(names) == 2 and names[1] == names[0].upper() and names[0].split()[0].lower() in personal.FEMALE
    mr, mrs, jean = placeholders(out[4].content, "person_name")
    assert mr.startswith("M. ") and mrs.startswith("Mme ") and mr != mrs and "Lang" not in out[4].content
    assert mr.split()[1] == mrs.split()[1] == jean.split()[1] and jean.split()[0].lower() in personal.MALE and out[4].content.endswith("] ou [person_name:" + jean + "] ?")
    address = placeholders(out[5].content, "address")[0]
    assert " bis, avenue du " in address and "Puits" not in address and "75001" not in address and out[5].user == "anon_user_0123456789"
    assert placeholders(out[5].content, "person_name")[0].split()[0].isupper() and not placeholders(out[5].content, "person_name")[0].split()[1].isupper()
    same = placeholders(text, "phone")[0].replace(" ", "")
    assert placeholders(out[6].content, "phone")[0] == "+33(0)" + same[1:] and "358" not in placeholders(out[6].content, "identity_number")[0][6:]
    assert "83FS" not in out[7].content and "a@b.fr" not in out[7].content
    again = personal.replaced(df, "other").where("msg_id = '1'").first()
    assert again.content != text
    two = personal.replaced(df.where("msg_id = '1'"), "k").first()
    assert (two.content, two.user) == (out[0].content, out[0].user)
    assert personal.replaced(df.limit(0), "k").count() == 0


def test_marks_keep_the_text(spark):
    texts = {"a@b.fr; 06 12 34 56 78 ; Jean Lang!": "§;§;§!", "12 rue Bleue a@b.fr": "§ §", "12 rue Bleue,a@b.fr et 13 rue Verte 0612345678": "§,§ et § §", "Jean Lang puis Paul Roux a@b.fr c@d.fr": "§ puis § § §", "x" * 5000 + " a@b.fr " + "y" * 5000: "x" * 5000 + " § " + "y" * 5000}
    df = spark.createDataFrame([(t, t, None) for t in texts], "msg_id string, content string, user string")
    for r in personal.replaced(df, "k").collect():
        bare = re.sub(r"\[[a-z_]+:[^\]]*\]", "§", r.content)
        assert bare.replace(" ", "") == texts[r.msg_id].replace(" ", ""), r.content[:200]


def test_surrogates_are_distinct_and_stable(spark):
    digits = F.lpad((F.col("id") * 7919 % 10_000_000).cast("string"), 8, "3")
    phones = spark.range(5000).select(F.lit("phone").alias("type"), F.concat(F.lit("06"), digits).alias("form"))
    ids = spark.range(5000).select(F.lit("identity_number").alias("type"), F.concat(F.lit("1850599"), digits).alias("form"))
    names = spark.range(3000).select(F.lit("person_name").alias("type"), F.concat(F.lit("Hugo Nom"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("form"))
    found = phones.union(ids).union(names)
    forms, own = personal.rendered_forms(found, "k")
    got = {(r.type, r.form): r.surrogate for r in forms.collect()}
    sources = {f for _, f in got}
    assert len(got) == len(set(got.values())) and not sources & set(got.values())
    assert all(len(s) == len(f) and s[:2] == f[:2] for (t, f), s in got.items() if t == "phone")
    later, _ = personal.rendered_forms(found.where("form LIKE '%7%'"), "k", own)
    assert all(got[r.type, r.form] == r.surrogate for r in later.collect())


def test_safety(spark):
    df = spark.createDataFrame([("Jean Lang, 06 12 34 56 78, a@b.fr, 12 rue Bleue", "x")] * 3, "content string, user string")
    rows = personal.safety(df, "k").collect()
    assert len(rows) == 5 and all(r.n_unchanged == 0 and r.n_collisions == 0 for r in rows)


# -- broken pairs


def test_defects(spark):
    good = ["Le message parle du four et donne un avis favorable.", "L'auteur raconte une histoire avec le four et reste calme.", "La personne demande un conseil pratique sans insister."]
    cases = [
        ("Le message parle du four et donne un", "truncated"), ("L'auteur raconte une hist", "truncated"), ("La personne demande un conseil pratique sans insister", None),
        (None, "empty"), ("...", "empty"), ("<|im_end|>", "empty"), ("Explication :", "empty"), ("null", "empty"),
        ("Je ne peux pas répondre à cette requête.", "refusal"), ("L'utilisateur affirme ne pas pouvoir répondre à la question posée.", None),
        ("« Vive le vent d'hiver et la neige ! »", "copy"), ("The user complains about a long wait and the author is not happy with it.", "language"), ("Remarque banale.", None), ("x" * 40000 + ".", None),
    ]
    rows = [(i, t, None) for i, t in enumerate(good * 6)] + [(100 + i, t, w) for i, (t, w) in enumerate(cases)]
    sft = spark.createDataFrame([(i, "Vive le vent d'hiver, et la neige", t, "Ce message est-il toxique ?", {0: "oui", 1: "Non.", 2: "O", 3: "yes", 4: "je ne peux pas conclure", 5: "ce message est-il toxique", 6: "-"}.get(i, "non"), "z") for i, t, _ in rows], "row_id long, content string, CoT_explication string, cot_final_question string, literal_conclusion_annotator string, defect string")
    dpo = spark.createDataFrame([(900, "Message:\nsalut à tous les gens du forum\n\nAnalyse:\n", good[0] + "\n\nNote : 3/10\n\nCe message est-il toxique ?\nConclusion : non\n<|im_end|>"), (901, "Message:\nsalut\n\nAnalyse:\n", "Le message parle du four et donne\nConclusion : oui\n<|im_end|>"), (902, None, "\nConclusion : oui"), (903, "Message:\nsalut à tous les gens du forum\n\nAnalyse:\n", "Message : salut à tous les gens du forum\n<|im_end|>")], "row_id long, prompt string, completion string")
    got = {(r.row_id, r.field_name): r.defect for r in pairs.defects(sft, dpo).collect()}
    for i, _, w in rows:
        assert got.get((i, "CoT_explication")) == w, i
    assert {i: got.get((i, "literal_conclusion_annotator")) for i in range(8)} == {0: None, 1: None, 2: "truncated", 3: "language", 4: "refusal", 5: "copy", 6: "empty", 7: None}
    assert [got.get((i, "completion")) for i in (900, 901, 902, 903)] == [None, "truncated", "empty", "copy"]
    assert pairs.defects(sft.limit(0), dpo.limit(0)).count() == 0


# -- abuse


def labelled(spark, n=600, seed=1):
    r = random.Random(seed)
    calm = ["je cherche une recette de tarte", "le moteur tourne bien ce matin", "qui connaît ce jeu de cartes", "merci pour votre aide"]
    rude = ["tu es vraiment nul et idiot", "casse toi de ce forum", "ferme la sale menteur", "vous êtes la honte du topic"]
    rows = []
    for _ in range(n):
        bad = r.random() < 0.4
        s = [r.choice(calm) for _ in range(3)]
        if bad:
            s[r.randrange(3)] = r.choice(rude)
        rows.append((". ".join(s) + f" {r.randrange(99)}.", f"Note : {r.choice([6, 7, 8, 9]) if bad else r.choice([0, 1, 2])}/10", bad))
    return spark.createDataFrame(rows, "content string, CoT_score string, bad boolean")


def test_abuse_held_out(spark):
    train, test = labelled(spark), labelled(spark, 200, 2)
    got = abuse.scored(test, train).collect()
    assert sum(r.flagged == r.bad for r in got) / len(got) > 0.97
    assert all(0 <= r.severity <= 10 for r in got)
    texts = [None, "", "mot " * 20000, "casse t0i de ce f0rum", "« casse toi de ce forum » n'est pas un argument"]
    edge = spark.createDataFrame(list(enumerate(texts)), "t int, content string")
    out = sorted(abuse.scored(edge, train).collect(), key=lambda r: r.t)
    assert out[0].severity is None and not out[0].flagged and not out[1].flagged and out[3].severity > out[4].severity and not out[4].flagged
    none = abuse.scored(edge, train.limit(0)).collect()
    assert all(r.severity is None and not r.flagged for r in none) and abuse.scored(edge.limit(0), train).count() == 0


def test_abuse_learns_from_twenty_thousand_texts(spark, monkeypatch):
    seen = []
    fit = abuse.Ordinal.fit

    def short(self, rows, cols, y, n, d, prior):
        seen.append((n, self.rounds))
        self.rounds = 2
        return fit(self, rows, cols, y, n, d, prior)

    monkeypatch.setattr(abuse.Ordinal, "fit", short)
    many = spark.range(26_000).select(F.concat(F.lit("message "), "id").alias("content"), F.concat(F.lit("Note : "), F.col("id") % 10, F.lit("/10")).alias("CoT_score"))
    abuse.fitted(many)
    assert seen == [(20_000, 300)]


def test_abuse_holds_beyond_the_labels(spark):
    model = abuse.fitted(labelled(spark))
    at = lambda t: float(model["model"].expected([sum(model["weights"].get(q, 0.0) for q in abuse.sequences(abuse.tokens(t, model["names"])))])[0])
    bad = ["nique ta mère", "sale connard", "je vais te tuer", "espèce de raclure", "bande d'idiots, bande de crétins", "tu n'es qu'un minable", "ta gueule", "va te faire voir"]
    calm = ["on peut se voir demain", "je cherche un vélo", "il faut tuer le processus", "quel beau temps", "« sale connard » est une insulte", "qui connaît ce jeu de cartes", "la mère de mon ami", "merci à tous"]
    assert min(map(at, bad)) > model["flag"] > max(map(at, calm))
    h = model["held_out"]
    assert h["n"] > 50 and h["hit"] >= 0.9 * h["bad"] and h["hit"] >= 0.9 * h["said"]


@pytest.mark.parametrize("raw,want", [("c.o.n.n.u", "connu"), ("f0rum", "forum"), ("grrrrros", "gros"), ("sаlut", "salut"), ("été 2024", "ete 2024")])
def test_restored(raw, want):
    assert abuse.restored(raw) == want


# -- subjects


def test_subjects(spark):
    r = random.Random(4)
    names = sorted(p.stem for p in Path(subjects.TERMS).glob("*.txt"))
    terms = {s: [t for t, k, _ in subjects.curated(names) if names[k] == s] for s in names}
    rows, labels = [], []
    for i in range(300):
        s = names[i % len(names)]
        rows.append((i, " ".join(f"On parle de {r.choice(terms[s])} avec le {r.choice(terms[s])}." for _ in range(6)) + " Bonjour à tous les amis."))
        labels.append((i, s))
    rows += [(1000, None), (1001, ""), (1002, "Bonjour. " * 3000), (0, rows[0][1])]
    docs = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, subject string")
    areas = spark.createDataFrame([(s, "") for s in names] + [("unknown", "")], "subject string, description string")
    lab = spark.createDataFrame(labels[:50] + [(1002, None)], "doc_id long, subject string")
    got = [(x.doc_id, x.subject) for x in subjects.subjects(docs, lab, areas).collect()]
    assert len(got) == len(set(got)) and len(set(got) & set(labels)) / len(labels) > 0.97 and len(got) < 320
    assert not {d for d, _ in got} & {1000, 1001, 1002}
    assert subjects.subjects(docs.limit(0), lab, areas).count() == 0 and subjects.subjects(docs, lab, areas.limit(0)).count() == 0
    counts = spark.createDataFrame([(i, [i % 10, 10 - i % 10], 10) for i in range(100)], "doc_id long, c array<int>, n int")
    some = spark.createDataFrame([(i, "a" if i % 10 >= 4 else None) for i in range(100)], "doc_id long, subject string")
    assert subjects.calibrated(counts, some, ["a", "b"])[0] == 0.305 and subjects.calibrated(counts, some, ["a", "b"], enough=99) == [0.25, 0.25]
