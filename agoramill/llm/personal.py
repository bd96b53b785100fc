"""Problem 2: personal information inside free text.

Method: entities are found by patterns inside the JVM, type after type, each on a text in which the earlier types are
already masked. Surrogate generation then gives every distinct entity a keyed replacement of its type: digits and letters
of numbers are replaced one by one, so plan prefix, separators and length stay; a name is taken apart, its title stays,
its first name becomes another of its gender and its family name an invented one, the same for all bearers, so that
"Jean Lang" and "M. Lang" still agree; an address keeps its street type and the form of its postcode. Candidates that
equal any source form or another surrogate are drawn again until all are distinct (the collision check). The draw depends
on the key and the entity alone; a registry of earlier surrogates makes it the same in every batch. A placeholder names
the type and holds the surrogate: ``[person_name:Mme Jeanne Marbadier]``. Names are found in Latin script only.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import secrets
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoramill.functions.text import ACCENTED, BASE
from agoramill.runtime import release, salted_join, stage

# Common first names in French texts, without accents, by gender.
FEMALE = (
    "adele agathe agnes aicha alice alix amandine amelie amina anais andrea anne annie assia audrey aurelie axelle beatrice brigitte camille capucine caroline catherine cecile celine "
    "chantal charlotte chloe christelle christine claire clara clemence coralie corinne delphine diane dominique elisa elise elodie elsa emilie emma estelle eva fanny farida fatima "
    "fatou florence francoise gaelle genevieve helene ines isabelle jade jeanne jessica josephine julia julie juliette justine karine khadija laetitia laura laure lea leila leonie "
    "lila lina lisa louise lucie madeleine maelle manon marcelle margaux margot maria marie marine marion mathilde maud melanie melissa michele mireille monique morgane myriam nadia "
    "nathalie nina noemie nora oceane odile olivia pauline perrine rachel romane rosalie sabrina samira sandrine sarah solene sonia sophie stephanie sylvie valerie vanessa veronique "
    "victoria virginie yasmine zoe"
).split()
MALE = (
    "abdel adam adrien ahmed alain alexandre alexis ali amine anthony antoine arnaud arthur aurelien axel baptiste bastien benjamin benoit bernard bilal bruno cedric charles christian "
    "christophe clement corentin cyril damien daniel david denis didier dylan emmanuel enzo eric ethan etienne fabien fabrice florent florian francis franck francois frederic gabriel "
    "gael gaetan georges gerard gilles gregory guillaume guy hakim hamza henri hugo ibrahim idriss ismael jacques jean jerome jeremy joel jonathan jordan joseph jules julien karim kevin "
    "killian laurent leo lionel loic louis luc lucas ludovic malik marc marcel martin mathieu matthieu maxime mehdi michel mickael mohamed mourad nathan nicolas noah olivier omar oscar "
    "pascal patrick paul philippe pierre quentin rachid raphael rayan remi remy robin romain samuel samy sebastien simon stephane sylvain tarek theo thibault thierry thomas timothee "
    "tristan valentin victor vincent william xavier yacine yann yanis youssef yves"
).split()
# Words that follow a first name without being a family name.
STOP = (
    "a à ai ainsi alors après as au aussi autre aux avait avant avec avoir beaucoup bien bonjour c'est car ce cela celle celui ces cet cette chaque chez chose comme comment contre d'abord "
    "dans de demain depuis derrière des dès deux devant dimanche dit dois doit donc dont du durant elle en encore enfin ensuite entre es est et était eu eux faire fait faut fois grâce hein "
    "hier ici il ils jamais je jeudi juste justement l'an là la le les leur lol lorsque lui lundi m'a ma maintenant mais malgré mardi me même merci mercredi mes mieux moi moins mon ne ni "
    "nos notre nous on ont ou où oui par parce parfois parmi pas pendant personne peu peut plus plutôt point pour pourquoi près presque puis qu'il quand que quel quelle quelqu'un qui quoi "
    "rien sa samedi sans sauf se selon sera ses seul si son sont sous souvent sur ta tandis te tel tes toi ton toujours tous tout toute toutes très trop tu un une va vais vendredi vers "
    "veut veux voici voilà vos votre vous vraiment y"
).split()
#: First names that are ordinary words in lower case; only their capitalised form counts.
WORDS = {"adam", "agathe", "alix", "axel", "capucine", "claire", "clement", "diane", "dominique", "jade", "jean", "jules", "laure", "leo", "lila", "lina", "madeleine", "marc", "maria", "marine", "martin", "maxime", "noah", "pierre", "robin", "rosalie", "victor", "victoria", "oscar", "omar", "romane", "ali"}

_ACCENTS = {"a": "aàâäá", "e": "eéèêë", "i": "iîïí", "o": "oôöó", "u": "uùûüú", "c": "cç", "n": "nñ", "y": "yÿ"}


def _loose(name: str) -> str:
    return "".join(f"[{_ACCENTS[x]}]\\p{{M}}?" if x in _ACCENTS else x for x in name)


def _any(names: list[str]) -> str:
    """An alternation that branches at the first letter."""
    by: dict[str, list[str]] = {}
    for n in sorted(set(names), key=lambda x: (-len(x), x)):
        by.setdefault(n[0], []).append(n[1:])
    return "(?:" + "|".join(f"{_loose(k)}(?:{'|'.join(map(_loose, v))})" for k, v in sorted(by.items())) + ")"


_FIRST = _any(FEMALE + MALE)
_LOWER_FIRST = _any([n for n in FEMALE + MALE if n not in WORDS])
_WORD_FIRST = _any(sorted(WORDS))
_NOT_STOP = "(?!(?iu:" + "|".join(sorted(STOP, key=len, reverse=True)) + r")(?![\p{L}\p{M}]))"
_L, _LU, _LL = r"[\p{L}\p{M}]", r"\p{Lu}\p{M}?", r"\p{Ll}\p{M}?"
_PARTICLE = r"(?:(?iu:de la|du|des|de|le|la|el|ben|van|von)[ ]|(?iu:d)['’])?"
_NEAR = r"(?:(?iu:du|des|de)[ ]|(?iu:d)['’])?"
_FAMILY = rf"{_NOT_STOP}{_LU}{_L}+(?:['’\-]{_L}+)*"
_LOWER_FAMILY = rf"{_NOT_STOP}{_LL}{_L}{{2,}}(?:['’\-]{_L}+)*"
_EDGE, _END = r"(?<![\p{L}\p{M}\p{N}_@\-])", r"(?![\p{L}\p{M}\p{N}_@])"
_AT = r"(?:[ ]?@[ ]?|[ ]?[(\[][ ]?(?:arobase|at)[ ]?[)\]][ ]?|[ ]arobase[ ])"
_DOT = r"(?:\.|[ ]\.[ ]|[ ]?[(\[](?:point|dot)[)\]][ ]?|[ ]point[ ])"
_GAP = r"[ .\-/\u00a0\u202f\u2009]"
_SP = r"[ .\-\u00a0\u202f\u2009]?"
_STREET = r"(?:rue|avenue|boulevard|place|square|chemin|impasse|all[eé]e|quai|route|cours|passage|esplanade|faubourg|sentier|ruelle|lotissement|r[eé]sidence|av\.?|ave\.?|bd\.?|bld\.?|blvd\.?|pl\.?|sq\.?|ch\.?|imp\.?|all\.?|rte\.?|r\.)"

#: (type, cheap sign that the pattern can match, pattern), in the order of masking.
PATTERNS = [
    ("email", lambda t: t.contains("@") | t.contains("robase") | t.contains("ROBASE") | t.rlike(r"[\[(][ ]?[aA][tT]"), rf"(?iu)(?:mailto:)?(?<![\p{{L}}\p{{N}}._%+\-])[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}._%+\-]*{_AT}[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}\-]*[\p{{L}}\p{{N}}])?(?:{_DOT}[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}\-]*[\p{{L}}\p{{N}}])?)*{_DOT}\p{{L}}{{2,12}}(?![\p{{L}}\p{{N}}])"),
    (
        "identity_number",
        r"(?iu)[0-9](?:[^0-9a-z]?[0-9]){8}|[0-9][^0-9a-z]?2[ab][^0-9a-z]?[0-9]|[0-9]{2} ?[a-z]{2} ?[0-9]{5}|cni|c\.n\.i|identit",
        r"(?iu)(?=[\p{L}0-9])(?<![\p{L}\p{N}\-])(?:[12]" + _SP + r"\d{2}" + _SP + r"(?:0[1-9]|1[0-2]|[2-9]\d)" + _SP + r"(?:\d{2}|2[ab])" + _SP + r"\d{3}" + _SP + r"\d{3}" + f"(?:{_SP}|/)" + r"\d{2}(?![\p{L}\p{N}]|-\d)"
        r"|(?:n(?:um[eé]ro|°|o|um)?\s*(?:de\s*)?)?(?:s[eé]cu(?:rit[eé] sociale)?|nir|assur[eé](?:e)?|immatriculation)(?![\p{L}\p{M}])[^\d\n]{0,20}[12](?:" + _SP + r"\d){12}(?:(?:" + _SP + r"\d){2})?(?!\d)"
        r"|(?:carte (?:nationale )?d['’ ]identit[eé]|cni|c\.n\.i\.?|pi[eè]ce d['’ ]identit[eé])[^\d\n]{0,20}(?:\d{12}|\d(?:[ ]?\d){11}|[a-z0-9]{9})(?![\p{L}\p{N}])"
        r"|passeport[^\d\n]{0,20}\d{2}[ ]?[a-z]{2}[ ]?\d{5}(?![\p{L}\p{N}])|\d{2}[a-z]{2}\d{5}(?![\p{L}\p{N}]))",
    ),
    (
        "phone",
        r"[0-9](?:[^0-9A-Za-z]{0,3}[0-9]){7}|[zZ][eéEÉ][rR][oO]",
        rf"(?iu)(?=[+0z(])(?<![\p{{L}}\p{{N}}+\-.,/]|\d[ ])(?:(?:(?:\+|00)[ ]?33{_GAP}?(?:\(0\){_GAP}?)?[1-9]|0[1-9])(?:(?:{_GAP}?\d\d){{4}}|\d\d{_GAP}\d{{3}}{_GAP}\d{{3}}|{_GAP}\d{{4}}{_GAP}\d{{4}}|{_GAP}?\d{{3}}{_GAP}\d{{2}}{_GAP}\d{{3}})"
        rf"|(?:\+|00)(?!33)[1-9]\d{{0,2}}{_GAP}?(?:\(\d{{1,4}}\){_GAP}?)?\d(?:{_GAP}?\d){{5,11}}"
        r"|z[eé]ro[ \-](?:un|deux|trois|quatre|cinq|six|sept|huit|neuf)(?:[ .\-]?\d\d){4})(?![\p{L}\p{N}]|[.\-]\d)",
    ),
    ("address", "[0-9]", rf"(?iu)(?=[0-9])(?<![\p{{L}}\p{{N}}\-])\d{{1,4}}[ ]?(?:bis|ter|quater|[a-d])?(?:[ ]?,[ ]?|[ ]){_STREET}[ ](?:(?:de|du|des|de la|de l['’]|d['’]|la|le|les|l['’])[ ]?)*(?!restant|assis|libre|dispo)\p{{L}}[\p{{L}}\p{{M}}'’\-]+(?:[ ](?-i:\p{{Lu}})[\p{{L}}\p{{M}}'’\-]+)*(?:[ ]?[,\-–][ ]?|[ ])?(?:\d{{5}}[ ](?:\p{{Lu}}|\p{{Ll}})[\p{{L}}\p{{M}}'’\-]+)?"),
]
_TITLE = r"(?:M\.|Mr\.?|Mme\.?|Mlle\.?|Monsieur|Madame|Mademoiselle|Dr\.?|Docteur|(?<!\p{Lu}\p{Ll}{0,14}[ ])Me|Ma[iî]tre|Pr\.?|Professeur|MONSIEUR|MADAME|MME|MLLE|MR)"
_LOWER_TITLE = r"(?:m\.|mr\.?|mme\.?|mlle\.?|monsieur|madame|mademoiselle)"


def _name(gap: str) -> str:
    first, lower = rf"(?:(?=\p{{Lu}})(?iu:{_LOWER_FIRST}(?:-{_FIRST})?)|(?=\p{{Lu}}\p{{Ll}})(?iu:{_WORD_FIRST}(?:-{_FIRST})?))", rf"(?=\p{{Ll}})(?iu:{_LOWER_FIRST}(?:-{_LOWER_FIRST})?)"
    return (
        r"(?=\p{L})" + f"{_EDGE}(?:{_TITLE}[ ](?:{first}[ ])?{_PARTICLE}{_FAMILY}|{_LOWER_TITLE}[ ](?:(?:{lower}[ ])?{_NEAR}{_LOWER_FAMILY}|(?:{first}[ ])?{_PARTICLE}{_FAMILY})"
        + (f"|{first}[._\\-]{_PARTICLE}{_LOWER_FAMILY}" if "_" in gap else "")
        + f"|{first}{gap}{_PARTICLE}{_FAMILY}|{lower}{gap}{_NEAR}{_LOWER_FAMILY}|{_NOT_STOP}\\p{{Lu}}{{3,}}(?:[-'’]\\p{{Lu}}+)*{gap}(?=\\p{{Lu}}\\p{{Ll}}|\\p{{Lu}}-\\p{{Lu}})(?iu:{_FIRST}(?:-{_FIRST})?)){_END}"
    )


NAME = _name(r"[   ]+")
USER_NAME = _name(r"[ ._\- ]+")
_MARKS = "".join(map(chr, (0x300, 0x301, 0x302, 0x303, 0x308, 0x327)))
_CUES = sorted({*FEMALE, *MALE, "mr", "mme", "mlle", "monsieur", "madame", "mademoiselle", "dr", "docteur", "maitre", "pr", "professeur"})


def _has_cue(c: Column) -> Column:
    """Whether a word of the text is a first name or a title; a hash lookup per word, before any name pattern runs."""
    plain = F.translate(F.lower(c), ACCENTED + _MARKS, BASE)
    return F.exists(F.split(plain, "[^a-z]+"), lambda w: w.isin(_CUES)) | c.rlike(r"(?:[Mm]\. ?|\bMe )\p{L}")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _chain(name: str):
    return [*((k, s if callable(s) else lambda t, s=s: t.rlike(s), p) for k, s, p in PATTERNS), ("person_name", _has_cue, name)]


_NO_ENTITY = "array<struct<type:string,form:string>>"
#: One noncharacter per type marks the place of an entity; such characters of a source become the replacement character.
_PLACES = {k: chr(0xFDD0 + i) for i, k in enumerate(("email", "identity_number", "phone", "address", "person_name"))}


def located(c: Column, name: str = NAME) -> Column:
    """struct<found: array<struct<type, form>>, rest: string>: the personal data of a text, type by type and in the text's
    order within one, and the text with a mark in the place of each; null for a null text."""
    none = F.array().cast(_NO_ENTITY)

    def step(chain: list, text: Column) -> Column:
        kind, cue, pattern = chain[0]
        hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("type"), x.alias("form")))
        masked = F.regexp_replace(text, pattern, f" {_PLACES[kind]} ")
        rest = chain[1:]

        def after(go: Column) -> Column:
            here = F.when(go, hits).otherwise(none)
            if not rest:
                return F.struct(here.alias("found"), F.when(go, masked).otherwise(text).alias("rest"))
            return _let(F.when(go, masked).otherwise(text), lambda t: _let(step(rest, t), lambda later: F.struct(F.concat(here, later["found"]).alias("found"), later["rest"].alias("rest"))))

        return _let(cue(text), after)

    return F.when(c.isNotNull(), _let(F.translate(c, "".join(_PLACES.values()), "\ufffd" * len(_PLACES)), lambda t: step(_chain(name), t)))


def entities(c: Column, name: str = NAME) -> Column:
    """array<struct<type, form>> of the personal data in a text, null for a null text. Every occurrence is listed."""
    none = F.array().cast(_NO_ENTITY)

    def step(chain: list, text: Column) -> Column:
        kind, cue, pattern = chain[0]
        hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("type"), x.alias("form")))
        rest = chain[1:]
        if not rest:
            return F.when(cue(text), hits).otherwise(none)
        return _let(cue(text), lambda go: F.concat(F.when(go, hits).otherwise(none), _let(F.when(go, F.regexp_replace(text, pattern, f" {_PLACES[kind]} ")).otherwise(text), lambda t: step(rest, t))))

    return F.when(c.isNotNull(), step(_chain(name), c))


def _own_alias(c: Column) -> Column:
    return F.trim(c).rlike(r"(?i)^(?:anon_user|frenchword)_[0-9a-f]{10}$")


def detected(df: DataFrame, key: str = "msg_id") -> DataFrame:
    """(key, field_name, pii_type): one row per record, field (content, user) and type present.

    Null keys and null or empty fields hold nothing; a record delivered twice comes out once; other columns are ignored.
    """
    own = _own_alias(F.coalesce("user", F.lit("")))
    kinds = lambda e: F.array_distinct(F.transform(F.coalesce(e, F.array().cast("array<struct<type:string,form:string>>")), lambda x: x["type"]))
    fields = F.array(F.struct(F.lit("content").alias("field_name"), kinds(entities(F.col("content"))).alias("kinds")), F.struct(F.lit("user").alias("field_name"), kinds(F.when(~own, entities(F.trim("user"), USER_NAME))).alias("kinds")))
    each = df.where(F.col(key).isNotNull()).select(F.col(key), F.explode(fields).alias("f")).where(F.size("f.kinds") > 0)
    return each.select(key, "f.field_name", F.explode("f.kinds").alias("pii_type")).distinct()


# -- surrogates: the parts of an entity, their keyed replacements, and the forms put together again
_START = "Bar Bel Bor Cas Cor Del Dor Far Fer Gal Gor Jas Lan Lor Mar Mer Nor Pas Per Rou Sal Tal Val Vil".split()
_MID = "ba be bi da de di fa ga ge la li lo ma mi mo na ni ra re ro sa ta va vi".split()
_LAST = "bert bois card chet dard dier fort gnon lain land let loz mard mont naud quet rel rin rond son tier vel vert zac".split()
_TITLES = regex.compile(rf"(?:{_TITLE}|{_LOWER_TITLE})(?=[ ])")
_GIVEN = regex.compile(rf"(?<![\p{{L}}\p{{M}}])(?iu:{_FIRST}(?:-{_FIRST})*)(?![\p{{L}}\p{{M}}'’]|-(?=\p{{Lu}}))")
_NUMBER = regex.compile(r"(?i)(?:\d{2} ?[a-z]{2} ?\d{5}|[12](?:[ .\-/\u00a0\u202f\u2009]?[0-9ab]){12,14}|\d(?: ?\d){11}|[a-z0-9]{9})$")
_ADDRESS = regex.compile(rf"(?iu)^(\d{{1,4}})([ ]?(?:bis|ter|quater|[a-d])?(?:[ ]?,[ ]?|[ ]){_STREET}[ ](?:(?:de|du|des|de la|de l['’]|d['’]|la|le|les|l['’])[ ]?)*)(.*?)((?:[ ]?[,\-–][ ]?|[ ])(\d{{5}})[ ](.+?))?([ ,\-–]*)$", regex.S)
_SPOKEN = {w: str(i) for i, w in enumerate("zero un deux trois quatre cinq six sept huit neuf".split())}
_FEMALE_TITLE = regex.compile(r"(?i)^(?:mme|mlle|madame|mademoiselle)")
_PARTS = "array<struct<kind:string,norm:string>>"


def _folded(text: str) -> str:
    t = unicodedata.normalize("NFKD", text.lower().replace("œ", "oe"))
    return regex.sub(r"[\p{M}\p{Cf}]+", "", t)


def _phone(form: str) -> str:
    """The digits of a number, of a French one in the national form; spoken digits count."""
    low = regex.sub(r"\p{L}+", lambda m: _SPOKEN.get(m[0], m[0]), _folded(form))
    digits = regex.sub(r"\D", "", low)
    if low.lstrip("( ").startswith(("+", "00")):
        digits = digits.removeprefix("00")
        return "0" + digits[2:].removeprefix("0") if digits.startswith("33") else "+" + digits
    return digits


def _split_name(form: str) -> tuple[str, str, list[tuple[str, int, int]]]:
    """The title, the gender, and the pieces of a name as (given or family, start, end)."""
    m = _TITLES.match(form)
    at = m.end() if m else 0
    title = form[:at]
    pieces: list[tuple[str, int, int]] = []
    several = list(_GIVEN.finditer(form, at))
    turned = regex.match(r"\p{Lu}{3,}(?![\p{Ll}]).*\p{Ll}", form[at:], regex.S) is not None  # FAMILY Given
    g = (several[-1] if turned and several[-1].end() == len(form) else several[0]) if several else None
    if g and form[at : g.start()].strip(" ._-") and form[g.end() :].strip(" ._-"):
        g = None  # a given name between others is part of the family name
    spans = [(at, len(form))] if not g else [(at, g.start()), (g.end(), len(form))]
    if g:
        pieces.append(("given", g.start(), g.end()))
    for a, b in spans:
        inner = regex.search(r"[\p{L}](?:.*[\p{L}\p{M}])?", form[a:b], regex.S)
        if inner:
            pieces.append(("family", a + inner.start(), a + inner.end()))
    first = _folded(form[g.start() : g.end()]).split("-")[0] if g else ""
    female = bool(_FEMALE_TITLE.match(title)) if title and (_FEMALE_TITLE.match(title) or regex.match(r"(?i)m\.|mr|monsieur", title)) else first in FEMALE
    return title, "f" if female else "m", sorted(pieces, key=lambda x: x[1])


def parts_of(kind: str, form: str) -> list[tuple[str, str]]:
    """(kind, norm) of what of an entity is replaced; spellings of one entity have equal norms."""
    if kind == "person_name":
        _, gender, pieces = _split_name(form)
        return [(k if k == "family" else f"given_{gender}", regex.sub(r"[^\p{L}]+", " ", _folded(form[a:b])).strip()) for k, a, b in pieces]
    if kind == "phone":
        return [(kind, _phone(form))]
    if kind == "identity_number":
        m = _NUMBER.search(form)
        return [(kind, regex.sub(r"[^0-9a-z]", "", (m[0] if m else form).lower()))]
    if kind == "address":
        return [(kind, regex.sub(r"[^\p{L}\p{N}]+", " ", _folded(form)).strip())]
    return [(kind, regex.sub(r"\s+", "", _folded(form)).removeprefix("mailto:"))]


def _stream(secret: str, *parts: str) -> Iterator[int]:
    """Endless keyed numbers below 2^32."""
    n = 0
    while True:
        d = hmac.new(secret.encode(), "\x1f".join((*parts, str(n))).encode(), hashlib.sha256).digest()
        yield from (int.from_bytes(d[i : i + 4]) for i in range(0, 32, 4))
        n += 1


def _invented(r: Iterator[int]) -> str:
    return _START[next(r) % 24] + _MID[next(r) % 24] + _MID[next(r) % 24] + _LAST[next(r) % 24]


def _same_class(text: str, r: Iterator[int], keep: int = 0) -> str:
    """Digits become digits and letters letters; the first ``keep`` signs stay."""
    return text[:keep] + "".join(str(next(r) % 10) if c.isdigit() else chr(97 + next(r) % 26) if c.isalpha() else c for c in text[keep:])


def candidate(secret: str, kind: str, norm: str, k: int) -> str:
    """The ``k``-th replacement of a part; equal in every batch."""
    r = _stream(secret, kind, norm, str(k))
    if kind == "phone":
        return _same_class(norm, r, 3 if norm.startswith("+") else 2)
    if kind == "identity_number":
        if regex.fullmatch(r"[12]\d{4}[0-9ab]{8}(?:\d\d)?", norm):  # sex, year, month, department, numbers, key
            return f"{1 + next(r) % 2}{next(r) % 100:02d}{1 + next(r) % 12:02d}{_same_class(norm[5:], r).translate(str.maketrans('cdefghijklmnopqrstuvwxyz', 'ab' * 12))}"
        return _same_class(norm, r)
    if kind == "address":
        return f"{1 + next(r) % 180}\x1f{_invented(r)}\x1f{1 + next(r) % 95:02d}{next(r) % 1000:03d}\x1f{_invented(r)}"
    if kind == "email":
        return f"{_invented(r)}.{_invented(r)}{next(r) % 1000}@exemple.invalid".lower()
    if kind == "family":
        return _invented(r)
    own = FEMALE if kind == "given_f" else MALE
    order = sorted(own, key=lambda n: hmac.new(secret.encode(), n.encode(), hashlib.sha256).digest())
    # a keyed rotation: no name stays, and different names stay different
    turn = 1 + (next(_stream(secret, kind, "turn")) + k) % (len(own) - 1)
    return "-".join(order[(order.index(x) + turn) % len(own)].title() if x in own else _invented(r) for x in norm.split())


def _cased(value: str, like: str) -> str:
    letters = regex.sub(r"[^\p{L}]", "", like)
    return value.upper() if len(letters) > 1 and letters.isupper() else value.lower() if letters.islower() else value


def _from_right(form: str, new: str) -> str:
    """The letters and digits of ``form`` replaced from the right by those of ``new``; what is longer stays."""
    out, at = list(form), len(new)
    for i in range(len(form) - 1, -1, -1):
        if at and form[i].isalnum():
            at -= 1
            if new[at].isdigit() == form[i].isdigit():
                out[i] = new[at].upper() if form[i].isupper() else new[at]
    return "".join(out)


def rendered(kind: str, form: str, by: list[str]) -> str:
    """``form`` with its parts, in their order, replaced by ``by``."""
    if kind == "person_name":
        _, _, pieces = _split_name(form)
        out, at = "", 0
        for (_, a, b), new in zip(pieces, by):
            out, at = out + form[at:a] + _cased(new, form[a:b]), b
        return out + form[at:]
    if kind == "phone":
        digits = sum(c.isdigit() for c in form)
        return _from_right(form, by[0][-min(digits, len(by[0]) - (3 if by[0][0] == "+" else 2)) :])
    if kind == "identity_number":
        m = _NUMBER.search(form)
        at = m.start() if m else 0
        return form[:at] + _from_right(form[at:], by[0])
    if kind == "address":
        m = _ADDRESS.match(form)
        number, street, postcode, city = by[0].split("\x1f")
        if not m:
            return f"{number} rue {street}"
        end = m[4][: m.start(5) - m.start(4)] + postcode + " " + _cased(city, m[6]) if m[4] else ""
        return number + m[2] + _cased(street, m[3]) + end + m[7]
    return _cased(by[0], form)


def _parts_udf():
    def run(kind: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": a, "norm": b} for a, b in parts_of(k, f)] for k, f in zip(kind, form)])

    return F.pandas_udf(run, _PARTS)


def _candidates(secret: str, k: int):
    def run(kind: pd.Series, norm: pd.Series) -> pd.Series:
        return pd.Series([candidate(secret, a, b, k) for a, b in zip(kind, norm)], dtype=object)

    return F.pandas_udf(run, "string")


def _render_udf():
    def run(kind: pd.Series, form: pd.Series, by: pd.Series) -> pd.Series:
        return pd.Series([rendered(k, f, list(b)) for k, f, b in zip(kind, form, by)], dtype=object)

    return F.pandas_udf(run, "string")


def plain_norm(kind: Column, surrogate: Column) -> Column:
    """A surrogate as its kind's norms are written, to compare both."""
    return F.when(kind == "address", F.lower(F.replace(surrogate, F.lit("\x1f"), F.lit(" ")))).otherwise(F.lower(surrogate))


def surrogates(parts: DataFrame, secret: str, registry: DataFrame | None = None) -> DataFrame:
    """(kind, norm, surrogate) of the distinct parts (kind, norm), staged.

    Parts of ``registry`` (the same columns, from earlier batches) keep their surrogates. No surrogate equals a norm of
    its kind or another surrogate: those that would are drawn again. Given names only change places among themselves, so
    they are exempt; a person differs by the family name. Each round leaves a small share, and a round without rest ends it.
    """
    left = parts.select("kind", "norm").distinct()
    done = registry.select("kind", "norm", "surrogate") if registry is not None else None
    if done is not None:
        left = left.join(done, ["kind", "norm"], "left_anti")
    norms = stage(parts.select("kind", "norm").union(done.select("kind", "norm")).distinct() if done is not None else parts.select("kind", "norm").distinct(), "norms")
    new, k = None, 0
    left = stage(left, "parts")
    while left.limit(1).count():
        drawn = left.withColumn("surrogate", _candidates(secret, k)("kind", "norm")).withColumn("p", plain_norm(F.col("kind"), F.col("surrogate")))
        drawn = stage(drawn, "drawn")
        free = F.startswith(F.col("kind"), F.lit("given"))
        first = drawn.groupBy("kind", "p").agg(F.min("norm").alias("norm"))
        ok = drawn.join(first, ["kind", "p", "norm"], "left_semi").join(norms.withColumnRenamed("norm", "p"), ["kind", "p"], "left_anti")
        taken = done if new is None else new if done is None else done.union(new)
        if taken is not None:
            ok = ok.join(taken.select("kind", plain_norm(F.col("kind"), F.col("surrogate")).alias("p")), ["kind", "p"], "left_anti")
        ok = stage(ok.where(~free).union(drawn.where(free).select(*ok.columns)).select("kind", "norm", "surrogate"), "kept")
        rest = stage(left.join(ok, ["kind", "norm"], "left_anti"), "parts")
        release(left)
        release(drawn)
        left, k, new = rest, k + 1, ok if new is None else stage(new.union(ok), "surrogates")
    release(norms)
    new = new if new is not None else left.withColumn("surrogate", F.lit(""))
    return stage(new.union(done.join(parts.select("kind", "norm").distinct(), ["kind", "norm"], "left_semi")), "surrogates") if done is not None else new


def rendered_forms(found: DataFrame, secret: str, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(type, form, n, surrogate) of the distinct forms of ``found`` (type, form), and the surrogates of their parts."""
    forms = stage(found.groupBy("type", "form").agg(F.count("*").alias("n")).withColumn("parts", _parts_udf()("type", "form")), "forms")
    each = stage(forms.select("type", "form", "n", F.posexplode("parts").alias("at", "x")).select("type", "form", "n", "at", "x.kind", "x.norm"), "parts-of-forms")
    own = surrogates(each, secret, registry)
    counts = each.groupBy("kind", "norm").agg(F.count("*").alias("m"))
    keyed = own.join(counts, ["kind", "norm"]).select(F.struct("kind", "norm").alias("k"), "surrogate", "m")
    joined = salted_join(each.withColumn("k", F.struct("kind", "norm")), keyed, "k", "m", each.count(), F.col("form"))
    by = joined.groupBy("type", "form", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "surrogate"))), lambda x: x["surrogate"]).alias("by"))
    return stage(by.select("type", "form", "n", _render_udf()("type", "form", "by").alias("surrogate")), "rendered"), own


def replaced(df: DataFrame, secret: str, fields: dict[str, str] | None = None, registry: DataFrame | None = None) -> DataFrame:
    """``df`` with every detected entity of ``fields`` (column to name pattern) replaced by its placeholder, in its place.

    Rows without entities, nulls and empty texts stay as they are; rows, also repeated ones, and their other columns are
    kept. A replacement keeps the case of its form. Equal entities have one surrogate in all fields, and in all batches
    if ``registry`` passes the surrogates of earlier ones. An alias of the forum's own is nobody's name.
    """
    fields = fields or {"content": NAME, "user": USER_NAME}
    cols = df.columns
    marked = df.withColumn("__row", F.monotonically_increasing_id())
    for f, pattern in fields.items():
        marked = marked.withColumn(f"__l_{f}", located(F.when(~_own_alias(F.col(f)), F.col(f)), pattern))
    marked = stage(marked, "located")
    union = None
    for f in fields:
        part = marked.select("__row", F.lit(f).alias("field"), F.posexplode(f"__l_{f}.found").alias("at", "e")).select("__row", "field", "at", "e.type", "e.form")
        union = part if union is None else union.union(part)
    found = stage(union.withColumn("k", F.md5(F.concat_ws("\x1f", "type", "form"))), "found")
    forms, _ = rendered_forms(found, secret, registry)
    lookup = forms.select(F.md5(F.concat_ws("\x1f", "type", "form")).alias("k"), "surrogate", "n")
    joined = salted_join(found.select("__row", "field", "at", "type", "k"), lookup, "k", "n", found.count(), F.col("__row"))
    swap = F.struct("at", "type", F.concat(F.lit("["), "type", F.lit(":"), F.regexp_replace("surrogate", r"(?s)^(.*?)([ ,\-–]*)$", "$1]$2")).alias("to"))  # separators stay outside
    out = marked
    for f in fields:
        swaps = joined.where(F.col("field") == f).groupBy("__row").agg(F.array_sort(F.collect_list(swap)).alias(f"__s_{f}"))
        out = out.join(swaps, "__row", "left").withColumn(f, F.when(F.col(f"__s_{f}").isNotNull(), _spliced(F.col(f"__l_{f}.rest"), F.col(f"__s_{f}"))).otherwise(F.col(f)))
    return out.select(*cols)


def _spliced(rest: Column, swaps: Column) -> Column:
    """``rest`` with its marks replaced in order, the last type masked first: its forms may hold marks of earlier types."""

    def of(kind: str) -> Column:
        return F.filter(swaps, lambda s: s["type"] == kind)

    for kind, mark in reversed(_PLACES.items()):
        own = of(kind)
        pieces = F.split(rest, f" ?{mark} ?")
        rest = F.when(F.contains(rest, F.lit(mark)), F.array_join(F.zip_with(pieces, own, lambda p, s: F.concat(F.coalesce(p, F.lit("")), F.coalesce(s["to"], F.lit("")))), "")).otherwise(rest)
    return rest


def p2_found(spark, sf_dir):
    return detected(spark.read.parquet(f"{sf_dir}/anonymous_forum.parquet"))


def _secret() -> str:
    """The key of the queries here, from the environment; the operators take theirs as an argument without a default."""
    return os.environ.get("AGORAMILL_SURROGATE_KEY") or secrets.token_hex(32)


def p2_replaced(spark, sf_dir):
    return replaced(spark.read.parquet(f"{sf_dir}/anonymous_forum.parquet").select("msg_id", "user", "content"), _secret())


def safety(df: DataFrame, secret: str, fields: dict[str, str] | None = None) -> DataFrame:
    """(pii_type, n_unchanged, n_collisions), one row per type: forms whose replacement is a form of the source, and
    surrogates that two different entities share."""
    fields = fields or {"content": NAME, "user": USER_NAME}
    union = None
    for f, pattern in fields.items():
        part = df.select(F.explode(entities(F.col(f), pattern)).alias("e")).select("e.*")
        union = part if union is None else union.union(part)
    forms, own = rendered_forms(stage(union, "found"), secret)
    sources = forms.select("type", F.lower("form").alias("form")).distinct()
    unchanged = forms.select("type", F.lower("surrogate").alias("form")).join(sources, ["type", "form"], "left_semi").groupBy("type").agg(F.count("*").alias("n_unchanged"))
    twice = own.where("kind NOT LIKE 'given%'").groupBy("kind", "surrogate").agg(F.count("*").alias("m")).groupBy(F.when(F.col("kind") == "family", "person_name").otherwise(F.col("kind")).alias("type")).agg(F.sum(F.col("m") - 1).alias("n_collisions"))
    kinds = df.sparkSession.createDataFrame([(k,) for k in _PLACES], "type string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return kinds.join(unchanged, "type", "left").join(twice, "type", "left").select(F.col("type").alias("pii_type"), zero("n_unchanged"), zero("n_collisions"))


def p2_safe(spark, sf_dir):
    """What the replacement of anonymous_forum leaves or confuses: nothing."""
    return safety(spark.read.parquet(f"{sf_dir}/anonymous_forum.parquet"), _secret())


QUERIES = {"p2_found": p2_found, "p2_replaced": p2_replaced, "p2_safe": p2_safe}
ORACLE = {"p2_safe": "SELECT t AS pii_type, CAST(0 AS BIGINT) AS n_unchanged, CAST(0 AS BIGINT) AS n_collisions FROM (SELECT unnest(['email', 'identity_number', 'phone', 'address', 'person_name']) AS t)"}
