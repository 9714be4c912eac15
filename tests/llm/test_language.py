"""Languages: held-out accuracy, code sizes against plain encoding, defined results."""

from __future__ import annotations

import random
import zlib

import zstandard

from fleetspark.llm import language
from tests.llm.edge import documents, empty

WORDS = {
    "aa": ["kalo", "miru", "tenaka", "poli", "suma", "rakito", "nela", "vori"], "bb": ["strund", "grolf", "bempt", "kwist", "drang", "splett", "thorm", "wulp"],
    "cc": ["ыва", "прол", "джэн", "смить", "бютор", "цукен", "гшщз", "фыва"],
}


def texts(count, seed, least=3):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        lang = rng.choice(sorted(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) + rng.choice(["", ".", "!", " 12"]) for _ in range(rng.randint(least, 80))), lang))
    return out


def test_held_out(spark):
    rows = texts(600, 5)
    got = {r["doc_id"]: r for r in language.language_report(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert len(got) == 600
    for i, _, _ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(got[i], lang) for i, _, lang in rows if got[i]["held_out"]]
    assert len(held) > 100 and all(r["lang_pred"] == lang and 0.5 < r["score"] <= 1 for r, lang in held)


def test_given_table(spark):
    """At least 0.99 of held-out documents of the given table."""
    import os

    docs = spark.read.parquet(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01") + "/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in language.language_report(docs).collect() if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.99 * len(held)


def test_looks_away(spark):
    """Languages of held-out rows, and all other columns, change nothing."""
    rows = texts(300, 6)
    turned = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, t, y in rows]
    shape = "doc_id bigint, text string, lang string"
    a, b = (sorted(tuple(r) for r in language.language_report(spark.createDataFrame(x, shape)).collect()) for x in (rows, turned))
    assert a == b and all(r[2] != "zz" for r in a)


def test_smallest_code():
    """Sizes are those of plain encoding, chunk by chunk, and the smallest wins."""
    rng = random.Random(1)
    known = {y: language.letters_of(" ".join(rng.choice(w) for _ in range(500))).encode() for y, w in WORDS.items()}
    machine = language.Languages(known)
    for text, y in [(t, y) for _, t, y in texts(40, 8, 1)] + [("kalo miru " * 5000 + "grolf " * 100, "aa")]:
        data = language.letters_of(text).encode()
        sizes = []
        for level in (language.LEVEL, language.STRONG_LEVEL):
            found = []
            for name in sorted(known):
                made = zstandard.ZstdCompressionParameters.from_level(
                    level, dict_size=len(known[name]), source_size=language.CHUNK, write_content_size=False, write_checksum=False, write_dict_id=False)
                total = 0
                for i in range(0, len(data), language.CHUNK):
                    plain = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(known[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=made)
                    total += len(plain.compress(data[i:i + language.CHUNK] + language.FILL))
                found.append(total)
            sizes.append(found)
        used = sizes[1] if machine.close(machine.sizes(machine.first, data), language.NARROW) else machine.sizes(machine.first, data)
        got, score, rejected = machine.predict(text)
        assert got == sorted(known)[used.index(min(used))] == y
        assert abs(score - 1 / sum(2 ** ((min(used) - s) / language.TEMPER) for s in used)) < 1e-9
        assert rejected == (sorted(used)[1] - min(used) <= max(0.005 * min(used), 1))


def test_edges(spark):
    got = language.language_report(documents(spark)).collect()
    assert len(got) == 13
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {2, 3, 4, None}
    assert all(r["score"] == 0 and r["rejected"] for r in got if r["lang_pred"] == "und")
    assert all(0 <= r["score"] <= 1 for r in got) and {r["lang_pred"] for r in got} <= {"und", "en", "de"}
    assert language.language_report(empty(spark)).count() == 0
    # nothing to learn from
    bare = spark.createDataFrame([(1, "some words", None), (2, "12 34", "en"), (3, None, "en")], "doc_id bigint, text string, lang string")
    assert {tuple(r)[2:] for r in language.language_report(bare).collect()} == {("und", 0.0, True)}
    # one language, and a text of marks in front
    one = spark.createDataFrame([(i, f"́ words of one {i}", "en") for i in range(8)], "doc_id bigint, text string, lang string")
    assert {r["lang_pred"] for r in language.language_report(one).collect()} == {"en"}


def test_operator_keeps_columns(spark):
    docs = spark.createDataFrame([("kalo miru", 1, 2.0)], "text string, lang_pred int, `a``b c` double")
    out = language.languages(docs, {"aa": b"kalo miru tenaka ", "bb": b"grolf bempt "})
    row = out.first()
    assert row["lang_pred"] == "aa" and tuple(row["row"]) == ("kalo miru", 1, 2.0)
