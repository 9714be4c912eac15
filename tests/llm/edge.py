"""Rows that every operator must take: nulls, empty and long texts, repeated rows, extra columns with names in the way."""

from __future__ import annotations

LONG = " ".join(f"word{i % 977} number {i}." for i in range(20_000))
PROSE = ("The river ran past the old mill and the people of the town were glad of it, for the water was clear in the "
         "morning and the fields that lay along the bank had been dry for a long time before the rain came to them.")

DOCS = [
    (1, PROSE, "en"), (1, PROSE, "en"), (2, None, "en"), (3, "", None), (4, "   \n\t ", "en"), (5, LONG, "en"), (None, PROSE + " Again", "de"),
    (6, "one", "en"), (7, "one two", "en"), (8, "ALL THE WORDS HERE ARE LOUD AND THE SHOUTING GOES ON AND ON", "en"),
    (9, "Über größere Straßen, über Brücken 日本語 🦙   x", "de"), (10, "a\x00b <|endoftext|> ▁c", None), (None, None, None),
]


def documents(spark, rows=DOCS):
    """The rows, with columns whose names operators might use themselves."""
    shape = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row string, q_text string, rank int, pii string, shard int"
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "k", "r", "q", 1, "p", 99) for i, t, lang in rows], shape)


def empty(spark):
    return documents(spark).where("false")
