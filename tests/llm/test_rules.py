"""Operators against their SQL on rows that the given tables do not hold, and the path through a transcript against all paths."""

from __future__ import annotations

import itertools
import random

import duckdb
import numpy as np

from fleetspark.llm import bpe, chat, pieces, pii, quality, queries
from fleetspark.llm.cache import Recent
from tests.oracle import rows_of

SCRIPTS = {
    "zh": "河水流过古老的磨坊镇上的人们都很高兴因为早晨的水十分清澈岸边的田地已经干旱了很久", "th": "แม่น้ำไหลผ่านโรงสีเก่าและชาวเมืองต่างดีใจเพราะน้ำใสในตอนเช้าทุ่งนาริมฝั่งแห้งแล้งมานาน",
    "ru": "река текла мимо старой мельницы люди города были рады воде утром поля вдоль берега долго стояли сухими", "hi": "नदी पुरानी चक्की के पास बहती थी और नगर के लोग प्रसन्न थे",
    "fi": "joki virtasi vanhan myllyn ohi kaupungin ihmiset olivat siitä iloisia koska vesi oli aamulla kirkasta pellot rannalla kuivia",
}


def test_quality_is_its_sql(spark, tmp_path):
    """Chinese, Thai, Russian ... rows, with and without blanks, clean and not, long and short."""
    rng = random.Random(3)
    texts = [None, "", "  \n "]
    for name, sample in SCRIPTS.items():
        for n in (1, 9, 12, 60, 400):
            if name in ("zh", "th"):
                texts += ["".join(rng.choices(sample, k=n)) + "。", " ".join("".join(rng.choices(sample, k=5)) for _ in range(n))]
            words = [rng.choice(sample.split()) if " " in sample else "".join(rng.choices(sample, k=3)) for _ in range(n)]
            texts += [" ".join(words) + ".", " ".join(w + rng.choice(["$$$", "", "12"]) for w in words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    path = f"{tmp_path}/documents.parquet"
    docs.toPandas().to_parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(queries.ORACLE["op5_quality"])
    want = rows_of([d[0] for d in found.description], found.fetchall())
    got = quality.quality_report(docs)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == want
    short = [i for i, t in enumerate(texts) if t and len(t.split()) < 10]
    assert all(r["base_failed"] for r in got.collect() if r["doc_id"] in short) and len(short) > 10


def test_secrets_and_context(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    texts = {
        f'token = "{key}"': [("secret", 9, 49)], f"the checksum is {key}": [], "password: aaaaaaaaaaaaaaaaaaaaaaa1": [], "token: internationalizationworks": [],
        "123-45-6789 is my social security number": [("ssn", 0, 11)], "123-45-6789 is a part": [], "123-45-6789 and 123-45-6788 (SSN)": [("ssn", 16, 27)],
        "api_key=AbCdEf0123456789/+xyzQRS==": [("secret", 8, 34)],
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in pii.pii_report(docs).collect():
        text = list(texts)[row["doc_id"]]
        spans = [s.split(":") for s in row["spans"].split(",") if s]
        assert [(k, int(a), int(b)) for k, a, b in spans if k in ("secret", "ssn")] == texts[text], text
    masked = {r["text"] for r in pii.mask_pii(docs).collect()}
    assert 'token = "[SECRET]"' in masked and "[SSN] is my social security number" in masked


def spoken(seed, convs=60):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(2, 5)):
            role = "user" if t % 2 == 0 else "assistant"
            words = [rng.choice(["red", "blue", "river", "old", "why"]) for _ in range(rng.randint(3, 12) if role == "user" else rng.randint(20, 60))]
            rows.append((c, t, role, " ".join(words) + ("?" if role == "user" else ".")))
    return rows


def test_path_is_the_best_of_all(spark):
    model = chat.fit(spark.createDataFrame(spoken(1), "conv_id bigint, turn bigint, role string, text string"))
    rng = random.Random(2)
    for _ in range(30):
        lines = [(i, rng.choice(["User: ", "Assistant: ", "", "", "A: "]) + rng.choice(["why?", "red " * rng.randint(1, 90), "ok"])) for i in sorted(rng.sample(range(12), rng.randint(1, 5)))]
        for style in chat.STYLES:
            best, path = model.path(lines, style)

            def score(states):
                total = model.start[states[0]]
                for k, s in enumerate(states):
                    total = total + model.emission(lines[k][1], k == 0 or lines[k][0] > lines[k - 1][0] + 1, style)[s]
                    if k:
                        total = total + model.step[states[k - 1], s]
                return total

            every = max(score(s) for s in itertools.product(range(6), repeat=len(lines)))
            assert best == every == score(path)


def test_roles_of_conversations_not_learned_from(spark):
    """Learned from some conversations, read from others, which write their markers in ways the first do not."""
    model = chat.fit(spark.createDataFrame(spoken(1), "conv_id bigint, turn bigint, role string, text string"))
    forms = {"User: {}": "Assistant: {}", "**Human:** {}": "**Bot:** {}", "<customer> {}": "<agent> {}", "## Question\n{}": "## Answer\n{}", "[prompter]: {}": "[model]: {}"}
    rows, right = spoken(77, 50), 0
    talks = [[r for r in rows if r[0] == c] for c in range(50)]
    for n, talk in enumerate(talks):
        user, other = list(forms.items())[n % len(forms)]
        text = "\n\n".join((user if role == "user" else other).format(line) for _, _, role, line in talk)
        right += [r for r, _ in model.turns(text)] == [role for _, _, role, _ in talk]
    assert right >= 0.98 * len(talks)
    # without markers
    bare = sum([r for r, _ in model.turns("\n\n".join(x[3] for x in talk))] == [x[2] for x in talk] for talk in talks)
    assert bare >= 0.9 * len(talks)


def test_transcripts_as_rows(spark):
    model = chat.fit(spark.createDataFrame(spoken(1), "conv_id bigint, turn bigint, role string, text string"))
    data = spark.createDataFrame([(1, "User: hi\n\nAssistant: yes", 5), (2, None, 6)], "id bigint, transcript string, more int")
    rows = {r["id"]: r for r in chat.format_transcripts(data, model).collect()}
    assert rows[1]["n_turns"] == 2 and rows[1]["more"] == 5 and [t["role"] for t in rows[1]["turns"]] == ["user", "assistant"]
    assert rows[1]["rendered"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n" and rows[2]["n_turns"] == 0


def test_repeated_turns_are_summed(spark):
    """Many rows of one turn times many of the next are counted, not paired."""
    rows = [(1, 0, "user", "a")] * 3000 + [(1, 1, "assistant", "b")] * 3000
    model = chat.fit(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4))
    assert np.exp(model.step[1, 2]) > 0.99


def test_memory_is_bounded():
    known = Recent(100_000)
    for i in range(300):
        words = {f"word{j}" for j in range(i * 40, i * 40 + 50)}
        known.remember((w, len(w)) for w in known.missing(words))
        assert all(known[w] == len(w) for w in words)
        assert known.held <= 100_000
    known.remember([("x" * 10_000_000, 1)])
    known.missing({"y"})
    assert len(known) == 0 and len(known.older) == 0


def test_small_memories_change_nothing(monkeypatch):
    import public_tokenizers

    texts = [" ".join(random.Random(i).choices(["the", "river", "ran", "é日", "x" * 50], k=80)) for i in range(200)]
    want = [f(texts) for f in (pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model")).encode, bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.json")).counts)]
    for module in (pieces, bpe):
        monkeypatch.setattr(module, "REMEMBERED", 2000)
    monkeypatch.setattr(pieces, "PAIRS", 3)
    for (make, f), all_ in zip(((pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model")), "encode"), (bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.json")), "counts")), want, strict=True):
        assert [x for i in range(0, 200, 20) for x in getattr(make, f)(texts[i:i + 20])] == all_


def test_columns_of_any_name(spark):
    """Names with blanks, backticks and dots, and those of results."""
    import public_tokenizers

    from fleetspark.llm import shards

    data = spark.createDataFrame([(1, "a text", 2, 3, 4, 5)], "doc_id bigint, text string, `a b` int, `c``d` int, piece_ids int, shard int")
    model = public_tokenizers.path("piece_bpe_32k.model")
    out = pieces.encode(data, model)
    assert out.columns == ["doc_id", "text", "a b", "c`d", "shard", "piece_ids"] and out.first()["c`d"] == 3
    assert pieces.decode(out, model, out="back").first()["back"] == "a text"
    dealt = shards.uniform_shards(data, 2)
    assert dealt.columns == ["doc_id", "text", "a b", "c`d", "piece_ids", "shard", "slot"] and dealt.first()["a b"] == 2
    learned = chat.fit(spark.createDataFrame(spoken(1, 5), "conv_id bigint, turn bigint, role string, text string"))
    odd = spark.createDataFrame([("User: hi", 1, 2)], "transcript string, `x``y` int, turns int")
    assert chat.format_transcripts(odd, learned).first()["x`y"] == 1
