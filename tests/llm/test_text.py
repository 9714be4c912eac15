"""Personal data, quality, token counts and pieces, against plain versions."""

from __future__ import annotations

import hashlib
import random
import re

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from fleetspark.llm import bpe, pieces, pii, quality
from fleetspark.llm.pieces import Pieces
from tests.llm.edge import PROSE, documents, empty

BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out


PII_TEXTS = [
    "mail a@b.c%d@e.f and x.y@z-q.co.uk., a@b no", "héllo 1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.004 1.2.3", "card 4111 1111 1111 1111, 4111-1111-1111-1112 0000000000000 12 345",
    "🦙 +1 (988) 555-2485 or +12 3 x +49.30.123456789-0) ++1", "IBAN DE89 3704 0044 0532 0130 00 and account GB82WEST12345698765432 X", "order 078-05-1120", "ssn 078-05-1120",
    "1 " * 500 + "+1 " * 400, "a@" * 300 + "b.c", "4111111111111111" * 3, "+" + "1" * 5000, "x" * 20_000 + "@", "1" * 20_000,
]


def test_base_spans(spark):
    rng = random.Random(5)
    texts = PII_TEXTS + ["".join(rng.choices("01459+-. ()@ab%é", k=rng.randint(1, 120))) for _ in range(1500)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id bigint, text string")
    for row in pii.pii_report(docs).collect():
        text = ([*texts, None, ""])[row["doc_id"]]
        want = base_spans(text)
        assert [row[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in want) for k in pii.BASE], text
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), text
        assert [s for s in row["spans"].split(",") if s.split(":")[0] in pii.BASE] == [f"{k}:{a}:{b}" for k, a, b in want]


def test_added_spans(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(PII_TEXTS[4:7])], "doc_id bigint, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.pii_report(docs).collect()}
    assert "iban:5:32" in spans[0] and "iban:45:67" in spans[0]
    assert spans[1] == "" and spans[2] == "ssn:4:15"


def test_masking(spark):
    docs = documents(spark, [(1, "call +1 (988) 555-2485 or a.b@c.de now", "en"), (2, PROSE, "en"), (3, None, "en")])
    rows = {r["doc_id"]: r for r in pii.mask_pii(docs).collect()}
    assert rows[1]["text"] == "call [PHONE] or [EMAIL] now" and rows[1]["n_chars"] == len(rows[1]["text"])
    assert rows[2]["text"] == PROSE and rows[3]["text"] is None and rows[1]["pii"] == "p"
    assert pii.mask_pii(docs).columns == docs.columns


def quality_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    hit = {p for at in seen.values() if len(at) > 1 for a in at for p in range(a, a + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["a", "b", "a b", " ", "\n", "#|", "\x0b", "é, f", "{", ", ", "x,"], k=rng.randint(0, 90))) for _ in range(600)]
    texts += [None, "", "a b c d e a b c d e", "a a a a a a", "a, b c d e f a, b c d e", PROSE]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in quality.quality_report(docs).collect():
        want = quality_counts(texts[row["doc_id"]])
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, texts[row["doc_id"]]
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert row["base_failed"] == failed and not (failed and row["kept"])


def test_quality_verdict(spark):
    loud, odd = PROSE.upper() * 3, " ".join(w + "$$$" for w in (PROSE * 3).split())
    sets = {"good": PROSE * 1, "loud": loud, "odd": odd, "table": " | ".join(f"w{i}x" for i in range(150))}
    docs = documents(spark, [(i, t, "en") for i, t in enumerate(sets.values())])
    assert [r["doc_id"] for r in quality.good_texts(docs).collect()] == [0]
    assert quality.good_texts(docs).columns == docs.columns


def test_quality_of_other_languages(spark):
    """Texts to which no reference applies are kept; scripts without case are held to references of their own."""
    spaced = {
        "ru": "река текла мимо старой мельницы люди города были рады воде утром поля вдоль берега долго стояли сухими пока не пришёл дождь",
        "el": "το ποτάμι κυλούσε δίπλα στον παλιό μύλο οι άνθρωποι της πόλης χαίρονταν επειδή νερό ήταν καθαρό κάθε πρωί χωράφια όχθη",
        "fi": "joki virtasi vanhan myllyn ohi kaupungin ihmiset olivat siitä iloisia koska vesi oli aamulla kirkasta pellot rannalla kuivia",
        "pl": "rzeka płynęła obok starego młyna a ludzie z miasta byli to zadowoleni bo woda była rano czysta pola nad brzegiem suche",
        "ar": "كان النهر يجري قرب الطاحونة القديمة وكان أهل المدينة سعداء به لأن الماء صاف في الصباح والحقول على الضفة جافة",
        "hi": "नदी पुरानी चक्की के पास बहती थी और नगर के लोग प्रसन्न थे क्योंकि सुबह पानी साफ था खेत सूखे थे",
        "ko": "강은 오래된 방앗간 옆을 흘렀고 마을 사람들은 아침마다 맑은 물을 보며 기뻐했다 강둑의 밭은 오랫동안 말라 있었다"}
    unspaced = {"zh": "河水流过古老的磨坊镇上的人们都很高兴因为早晨的水十分清澈岸边的田地已经干旱了很久", "ja": "川は古い水車小屋のそばを流れ町の人々は朝の澄んだ水を喜んだ岸辺の畑は長く乾いていた",
                "th": "แม่น้ำไหลผ่านโรงสีเก่าและชาวเมืองต่างดีใจเพราะน้ำใสในตอนเช้าทุ่งนาริมฝั่งแห้งแล้งมานาน"}
    rng, texts, junk = random.Random(8), {}, {}
    for name, sample in spaced.items():
        stop = "।" if name == "hi" else "."
        texts[name] = " ".join(" ".join(rng.choices(sample.split(), k=9)).capitalize() + stop for _ in range(40))
        junk[f"{name} junk"] = " ".join(w + rng.choice(["$$$", "***", "&&&"]) for w in texts[name].split())
    for name, sample in unspaced.items():
        texts[name] = "".join("".join(rng.choices(sample, k=7)) + "，" + "".join(rng.choices(sample, k=9)) + "。" for _ in range(40))
        junk[f"{name} junk"] = " ".join("".join(rng.choices(sample, k=4)) + rng.choice(["$$$", "***", "&&&"]) for _ in range(200))
    docs = documents(spark, [(i, t, "x") for i, t in enumerate([*texts.values(), *junk.values()])])
    kept = {[*texts, *junk][r["doc_id"]] for r in quality.good_texts(docs).collect()}
    assert kept == set(texts)


def test_token_counts(spark):
    docs = documents(spark)
    library = tokenizers.Tokenizer.from_file(BPE)
    rows = bpe.token_counts(docs, BPE).collect()
    want = sorted((i is None, i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in
                  [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows)


def strings(seed, count=1500):
    rng = random.Random(seed)
    letters = ["a", "b", "th", "ing", " ", "  ", "\n", "\t", "é", "日", "🦙", "1", "23", ".", "!!", "'s", "▁", "<|endoftext|>", "　", " ", "\r\n", "zz"]
    return ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(count)]


def test_counts_as_the_library():
    texts = strings(1)
    library = tokenizers.Tokenizer.from_file(BPE)
    assert bpe.ByteBpe(BPE).counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_pieces_as_the_library():
    texts = strings(2) + [" ".join(strings(7, 50))]
    machine, library = Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = machine.encode(texts)
    assert [list(memoryview(g).cast("i")) for g in got] == library.encode(texts)
    assert [machine.decode(g) for g in got] == [t.replace("▁", " ") for t in texts]


def test_pieces_operator(spark):
    docs = documents(spark)
    out = pieces.encode(docs, MODEL)
    assert out.columns == [*docs.columns, "piece_ids"]
    back = pieces.decode(out, MODEL, out="again").collect()
    assert len(back) == docs.count() and all(r["again"] == (r["text"] or "").replace("▁", " ") for r in back)
    digests = pieces.encode(docs.select("doc_id", "text"), MODEL, digest=True).collect()
    assert all(r["round_trip"] or r["doc_id"] == 10 for r in digests) and sum(r["n_pieces"] for r in digests) == sum(len(r["piece_ids"]) for r in back)


@pytest.mark.parametrize("run", [pii.pii_report, pii.mask_pii, quality.quality_report, quality.good_texts, lambda d: bpe.token_counts(d, BPE),
                                 lambda d: pieces.encode(d, MODEL)])
def test_edges(spark, run):
    assert run(empty(spark)).collect() == []
    assert len(run(documents(spark)).collect()) >= 3
