"""Personal data in texts: regular expressions propose spans, checksums confirm them, words nearby adjust their score.

Everything is expressed in SQL functions. A pattern gives the matched strings with ``regexp_extract_all`` and the stretches
between them with ``split``; their lengths, added up, are the places. Quantifiers are possessive and patterns begin only
where a run of their characters begins, so that no text makes them backtrack or recurse; matches are the same.

Base kinds, leftmost and without overlap per kind: email, ip (parts at most 255), card (13 to 19 digits, Luhn), phone (9 to
15 digits). Further kinds: iban (mod 97), ssn (never issued numbers excluded; a word such as "social security" must be near),
secret (a run of at least 20 letters, digits and the signs of base64, with letters and digits among them and at least
``SECRET_SIGNS`` different ones; a word such as "token" must be near).

Each span has a score. A kind begins with its own, a passed checksum raises it, a word of the kind within ``CONTEXT`` characters
before or after raises it, a word that speaks against it (order, tracking, version ...) within those before lowers it. What
stands after reaches to the kind's next match at most. Spans of base kinds are reported whatever the score; of the others, from
``MIN_SCORE``.

Defined results: a null or empty text has no spans; repeated rows are rows of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.keys import packed

CONTEXT = 40
MIN_SCORE = 0.6
SECRET_SIGNS = 10
CHECKED, SUPPORTED, DOUBTED = 0.3, 0.3, -0.2
SPEAKS_AGAINST = "order|tracking|version|invoice|serial|isbn|part no"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: what every text that has a match contains
    hint: str
    score: float
    context: str
    base: bool = True


KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write|address"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "digit", 0.6, "ip|host|server|address|client"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", "digit", 0.5, "card|credit|visa|master|pay|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|tel|call|mobile|fax|ruf|llam|appel"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "digit", 0.5,
         "iban|account|bank|konto|cuenta|compte", base=False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "digit", 0.4, "ssn|social security|tax id", base=False),
    Kind("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+", "digit", 0.4, "token|secret|passw|api.?key|access.?key|private.?key|bearer|credential", base=False),
]
BASE = [k.name for k in KINDS if k.base]


def _digits(match: Column) -> Column:
    return F.translate(match, " -+().", "")


def _luhn(match: Column) -> Column:
    """Whether 13 to 19 digits have a right check digit."""
    d = _digits(match)
    padded = F.reverse(F.lpad(d, 20, "0"))
    plain = F.concat(*(F.substring(padded, i, 1) for i in range(1, 21, 2)))
    # twice a digit, with its own digits added up
    twice = F.translate(F.concat(*(F.substring(padded, i, 1) for i in range(2, 21, 2))), "0123456789", "0246813579")
    total = sum((F.substring(text, i, 1).cast("int") for text in (plain, twice) for i in range(1, 11)), F.lit(0))
    return F.when(F.length(d).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def _mod97(match: Column) -> Column:
    """Whether an international account number leaves 1 when divided by 97, letters standing for 10 to 35."""
    plain = F.translate(match, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(rest, char):
        code = F.ascii(char)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.length(plain).between(15, 34) & (F.aggregate(chars, F.lit(0), step) == 1)


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _holds(kind: Kind, match: Column) -> Column:
    if kind.name == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind.name == "card":
        return _luhn(match)
    if kind.name == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind.name == "iban":
        return _mod97(match)
    if kind.name == "secret":
        different = F.size(F.array_distinct(F.split(match, "")))
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (different >= SECRET_SIGNS)
    return F.lit(True)


def _places(kind: Kind, text: Column) -> Column:
    """Array of match, start, end (code points, end exclusive): gaps between matches and matches, added up."""
    shape = "array<struct<match:string,start:int,end:int>>"
    pieces = F.arrays_zip(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"), F.split(text, kind.pattern, -1).alias("g"))

    def step(acc, piece):
        start = acc["at"] + F.length(piece["g"])
        end = start + F.length(piece["m"])
        one = F.array(F.struct(piece["m"].alias("match"), start.alias("start"), end.alias("end")))
        return F.when(piece["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["found"], one).alias("found")))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(shape).alias("found"))
    return F.aggregate(pieces, none, step)["found"]


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def _spans(kind: Kind, text: Column) -> Column:
    def scored(place, next_start):
        before = F.lower(F.substring(text, F.greatest(place["start"] - CONTEXT, F.lit(0)) + 1, F.least(place["start"], F.lit(CONTEXT))))
        reach = F.least(F.coalesce(next_start - place["end"], F.lit(CONTEXT)), F.lit(CONTEXT))
        after = F.lower(F.substring(text, place["end"] + 1, reach))
        first = kind.score + (CHECKED if kind.name in ("card", "iban") else 0.0)
        score = (F.lit(first) + F.when(before.rlike(kind.context) | after.rlike(kind.context), SUPPORTED).otherwise(0.0)
                 + F.when(before.rlike(SPEAKS_AGAINST), DOUBTED).otherwise(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), place["start"].alias("start"), place["end"].alias("end"),
                        F.round(F.least(score, F.lit(1.0)), 6).alias("score"))

    there = F.col("has_digit") if kind.hint == "digit" else F.contains(text, F.lit(kind.hint))
    held = F.filter(_places(kind, text), lambda p: _holds(kind, p["match"]))
    # the matches are found once, however often they are referred to
    spans = F.get(F.transform(F.array(held), lambda all_: F.transform(all_, lambda p, i: scored(p, F.get(all_, i + 1)["start"]))), F.lit(0))
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= MIN_SCORE)
    return F.when(there, spans).otherwise(F.array().cast(SPANS))


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` (with a column text, and none called pii, pii_text or has_digit) and pii: an array of spans (kind, start, end,
    score), by kind as in ``KINDS`` and then by start."""
    taken = {"pii", "pii_text", "has_digit"}.intersection(docs.columns)
    if taken:
        raise ValueError(f"columns called {', '.join(sorted(taken))} would be lost")
    plain = docs.withColumn("pii_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    plain = plain.withColumn("has_digit", F.col("pii_text").rlike("[0-9]"))
    found = plain.withColumn("pii", F.concat(*(_spans(k, F.col("pii_text")) for k in KINDS)))
    return found.drop("pii_text", "has_digit")


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of text replaced by its kind in brackets, and n_chars, where there, counted anew. Of spans
    that overlap the first, and the longest of those, counts."""
    found = find_pii(packed(docs))
    ordered = F.sort_array(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def step(acc, s):
        before = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] >= acc["at"], F.struct(
            (-s["back"]).alias("at"), F.concat(acc["out"], before, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))).otherwise(acc)

    folded = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                         lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    found = found.withColumn("masked", F.when(F.size("pii") > 0, folded).otherwise(F.col("text")))
    new = {"text": F.col("masked")} | ({"n_chars": F.length("masked").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def digest(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256, spans of every row."""
    found = find_pii(docs.select("doc_id", "text")).drop("text")
    def of(*kinds):
        return F.filter("pii", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(digest(of(*BASE)), 256).alias("base_sha256"), digest(F.col("pii")).alias("spans"))
