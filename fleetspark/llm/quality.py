"""Quality rules: how far the make-up of a text is from that of written language.

A text is described by two histograms: classes of characters, and its language's most common words. Both are compared to
references of several languages by Jensen-Shannon distance (base 2, so 0 to 1); the nearest language counts. A histogram says
little of a short text: character classes are judged from ``MIN_CHARS`` characters that are no space, words from ``MIN_WORDS``
words.

A histogram is judged only where a reference applies. Words are if the text has enough of the listed words of some language, in
share and in kinds; texts in other languages are kept whatever their word distance, and so is prose of invented words. Characters
of texts mostly in letters without case (Chinese, Arabic, Hindi ...) are compared to references for those, with their signs; no
labelled texts were there to set these on.

Plain counts go with them: words, their characters, symbols, repeated lines, words inside five-word windows that occur
twice or more. A text of fewer than ten words, or with over a fifth of its words in such windows, fails outright. Words are what
stands between blanks; ``good_texts``, which filters a corpus, takes ``UNSPACED_CHARS`` letters for a word in that least length
where most letters are of a script without blanks between words. Repeats inside lines of such texts are not seen.

Everything is an expression on the row, in SQL functions: no shuffle, no Python.

Defined results: a null or empty text has no words, fails and has null distances; repeated rows are rows of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.keys import packed

MIN_TEXT_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: From how many characters and words on a histogram is judged, and the distances that are let through.
MIN_CHARS, MIN_WORDS = 250, 100
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.185, 0.28

#: Shares of character classes in prose, spaces left out (upper case, digits, sentence marks, other,
#: lower case).
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "mark": r"[.,;:!?'\"()\-]", "other": r"[^\p{Ll}\p{Lu}\p{Nd}.,;:!?'\"()\-\x20]"}
PROSE = [0.030, 0.005, 0.030, 0.005, 0.930]
#: The like (digits, signs, other, letters) of scripts without case, with blanks between words or without.
SIGNS = r"[.,;:!?'\"()\-\u2010-\u201F\u2026\u3001\u3002\u3008-\u3011\u30FB\uFF01\uFF08\uFF09\uFF0C\uFF0E\uFF1A\uFF1B\uFF1F\u00AB\u00BB\u060C\u061B\u061F\u06D4\u0964\u0965\u05BE\u104A\u104B\u1362\u17D4]"
UNCASED = [[0.005, 0.030, 0.005, 0.960], [0.010, 0.110, 0.005, 0.875]]
UNSPACED = "[" + "".join(rf"\p{{Is{name}}}" for name in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan")) + "]"
UNSPACED_CHARS = 2
#: From which share and number of a language's listed words on they are judged.
MIN_COMMON_SHARE, MIN_COMMON_KINDS = 0.05, 5
#: Common words and their shares of all words in prose, roughly.
COMMON = {
    "en": {"the": 0.060, "of": 0.032, "and": 0.028, "to": 0.026, "a": 0.021, "in": 0.020, "that": 0.011, "is": 0.011, "was": 0.010, "for": 0.009},
    "de": {"der": 0.032, "die": 0.031, "und": 0.026, "in": 0.018, "den": 0.012, "von": 0.011, "zu": 0.011, "das": 0.011, "mit": 0.009, "ist": 0.008},
    "fr": {"de": 0.045, "la": 0.027, "le": 0.021, "et": 0.021, "les": 0.018, "des": 0.016, "en": 0.013, "un": 0.011, "que": 0.009, "pour": 0.008},
    "es": {"de": 0.055, "la": 0.034, "que": 0.026, "el": 0.026, "en": 0.024, "y": 0.023, "los": 0.016, "del": 0.012, "se": 0.011, "con": 0.009},
}
_COMMON = sorted({w for words in COMMON.values() for w in words})
_COMMON_PATTERN = r"(?<!\p{L})(?:" + "|".join(_COMMON) + r")(?!\p{L})"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _windows(words: Column) -> Column:
    """Five-word windows as strings; words hold no blank, so different windows are different strings."""
    n = F.greatest(F.size(words) - WINDOW + 1, F.lit(0))
    return F.arrays_zip(*(F.slice(words, i, n).alias(f"w{i}") for i in range(1, WINDOW + 1))).cast("array<string>")


def _covered(windows: Column) -> Column:
    """Number of words inside windows that have an equal one: when sorted, equal windows are neighbours."""
    n = F.size(windows) - 1
    placed = F.sort_array(F.arrays_zip(windows.alias("w"), F.sequence(F.lit(0), n).alias("at")))
    equal = _let(placed, lambda p: F.filter(F.arrays_zip(F.slice(p, 1, n).alias("a"), F.slice(p, 2, n).alias("b")),
                                            lambda x: x["a"]["w"] == x["b"]["w"]))
    starts = F.array_distinct(F.flatten(F.transform(equal, lambda x: F.array(x["a"]["at"], x["b"]["at"]))))
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda at: F.sequence(at, at + WINDOW - 1)))))


def _distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of two histograms of the same bins: of p and q, 1 + sum(p log p + q log q - (p+q) log(p+q)) / 2."""
    of_reference = sum(q * math.log2(q) for q in reference)
    terms = F.zip_with(shares, F.array(*map(F.lit, reference)),
                       lambda p, q: F.when(p > 0, p * F.log2(p)).otherwise(0.0) - (p + q) * F.log2(p + q))
    return F.round(F.sqrt(F.greatest(1 + F.aggregate(terms, F.lit(of_reference), lambda x, y: x + y) / 2, F.lit(0.0))), 6)


def _shares(counts: Column, total: Column) -> Column:
    """Shares of the counted bins, and of the rest."""
    def with_rest(shares):
        return F.concat(shares, F.array(F.greatest(F.aggregate(shares, F.lit(1.0), lambda x, y: x - y), F.lit(0.0))))

    return _let(F.transform(counts, lambda n: n / F.greatest(total, F.lit(1))), with_rest)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (with a column text, and none whose name begins with q_) and, of every text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance,
    word_distance, and what references apply: unspaced_letters (null if the text is not of a script without blanks), words_apply."""
    out = docs.withColumn("q_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumn("q_flat", F.translate("q_text", "\t\n\x0b\x0c\r", "     "))
    out = out.withColumn("q_words", F.array_remove(F.split("q_flat", " "), ""))
    blank = F.lit(" \t\n\x0b\x0c\r")
    lines = F.filter(F.split("q_text", "\n"), lambda x: F.trim(x, blank) != "")
    out = (out.withColumn("q_lines", F.when(F.contains("q_text", F.lit("\n")), lines))
           .withColumn("q_windows", _windows(F.col("q_words")))
           .withColumn("n_words", F.size("q_words").cast("long"))
           .withColumn("word_chars", F.length(F.replace("q_flat", F.lit(" "), F.lit(""))).cast("long"))
           .withColumn("n_symbols", (F.length("q_text") - F.length(F.translate("q_text", SYMBOLS, ""))).cast("long"))
           .withColumn("n_dup_lines", F.coalesce(F.size("q_lines") - F.size(F.array_distinct("q_lines")), F.lit(0)).cast("long"))
           .withColumn("n_repeat_words", F.when(F.size("q_windows") > F.size(F.array_distinct("q_windows")), _covered(F.col("q_windows")))
                       .otherwise(0).cast("long")))
    for name, chars in CLASSES.items():
        out = out.withColumn(f"q_{name}", F.length("q_flat") - F.length(F.regexp_replace("q_flat", f"{chars}+", "")))
    out = out.withColumn("q_classes", _shares(F.array(*(F.col(f"q_{name}") for name in CLASSES)), F.col("word_chars")))

    def number(chars):
        return F.length("q_flat") - F.length(F.regexp_replace("q_flat", f"{chars}+", ""))

    # letters without case are among the other characters; only texts with many of those are looked at again
    odd = 3 * F.col("q_other") > F.col("word_chars")
    out = out.withColumn("q_uncased", F.when(odd, number(r"[\p{Lo}\p{Lm}\p{M}]")).otherwise(0))
    out = out.withColumn("q_letters", F.when(F.col("q_uncased") > 0, F.col("q_uncased") + number(r"[\p{Ll}\p{Lu}]")).otherwise(0))
    uncased = 2 * F.col("q_uncased") > F.col("q_letters")
    out = out.withColumn("q_signs", F.when(uncased, number(SIGNS)).otherwise(0))
    out = out.withColumn("q_unspaced", F.when(uncased, number(UNSPACED)).otherwise(0))
    out = out.withColumn("unspaced_letters", F.when(uncased & (2 * F.col("q_unspaced") > F.col("q_letters")), F.col("q_letters")))
    rest = F.greatest(F.col("word_chars") - F.col("q_digit") - F.col("q_signs") - F.col("q_letters"), F.lit(0))
    out = out.withColumn("q_parts", F.when(uncased, _shares(F.array("q_digit", "q_signs", rest), F.col("word_chars"))))
    out = out.withColumn("char_distance", F.when(uncased, F.least(*(_distance(F.col("q_parts"), x) for x in UNCASED))).when(
        F.col("word_chars") > 0, _distance(F.col("q_classes"), PROSE)))
    # each common word between two blanks of its own, so that it can be counted by taking it out
    common = F.array_join(F.regexp_extract_all(F.lower("q_flat"), F.lit(_COMMON_PATTERN), F.lit(0)), "  ")
    out = out.withColumn("q_common", F.concat(F.lit(" "), common, F.lit(" ")))
    out = out.withColumn("q_counts", F.array(*(
        ((F.octet_length("q_common") - F.octet_length(F.replace("q_common", F.lit(f" {w} "), F.lit("")))) / (len(w.encode()) + 2)).cast("int")
        for w in _COMMON)))
    distances, applies = [], F.lit(False)
    for words in COMMON.values():
        counts = F.transform(F.array(*(F.lit(_COMMON.index(w)) for w in words)), lambda i: F.get("q_counts", i))
        applies = applies | ((F.aggregate(counts, F.lit(0), lambda x, y: x + y) >= MIN_COMMON_SHARE * F.col("n_words"))
                             & (F.size(F.filter(counts, lambda n: n > 0)) >= MIN_COMMON_KINDS))
        distances.append(_distance(_shares(counts, F.col("n_words")), [*words.values(), 1 - sum(words.values())]))
    out = out.withColumn("word_distance", F.when(F.col("n_words") > 0, F.least(*distances))).withColumn("words_apply", applies)
    return out.drop(*(c for c in out.columns if c.startswith("q_")))


def base_failed(words: Column | str = "n_words") -> Column:
    words = F.col(words) if isinstance(words, str) else words
    return (words < MIN_TEXT_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def words_or_letters() -> Column:
    """Words, or what a text without blanks has in letters for them."""
    return F.greatest("n_words", F.coalesce(F.floor(F.col("unspaced_letters") / UNSPACED_CHARS), F.lit(0)))


def verdict() -> Column:
    """Whether both distances are small enough, where a reference applies and the text is long enough to tell."""
    return ((F.col("word_chars") < MIN_CHARS) | (F.col("char_distance") <= MAX_CHAR_DISTANCE)) & (
        (F.col("n_words") < MIN_WORDS) | ~F.col("words_apply") | (F.col("word_distance") <= MAX_WORD_DISTANCE))


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts, distances, base_failed, kept of every row."""
    return (measured(docs.select("doc_id", "text")).drop("text").withColumn("base_failed", base_failed())
            .withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict()))
            .drop("unspaced_letters", "words_apply"))


def good_texts(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, as they are."""
    judged = measured(packed(docs)).select("row", (~base_failed(words_or_letters()) & verdict()).alias("kept"), F.monotonically_increasing_id().alias("number"))
    # the row number keeps the filter above: pushed down, it would hold every expression as often as it is referred to
    return judged.where(F.col("kept") & (F.col("number") >= 0)).select("row.*")
