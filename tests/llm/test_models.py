"""Toxicity, page text, transcripts and shards: held-out accuracy, exact counts, laws."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspark.llm import chat, shards, toxicity, webtext
from tests.llm.edge import PROSE, documents, empty


def toxic_rows(count, seed):
    rng = random.Random(seed)
    fine, bad = [f"fine{i}" for i in range(200)], ["foul", "vile", "nasty"]
    rows, labels = [], []
    for i in range(count):
        sentences = [" ".join(rng.choices(fine, k=8)) for _ in range(rng.randint(1, 12))]
        toxic = rng.random() < 0.2
        if toxic:
            sentences[rng.randrange(len(sentences))] += " " + rng.choice(bad)
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(toxic) if rng.random() < 0.95 else 1 - int(toxic), int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, truth = toxic_rows(900, 2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, y, _ in truth], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_report(docs, labels).collect()}
    held = [i for i, _, _ in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in got)
    assert np.mean([got[i]["predicted"] == t for i, _, t in truth if i in set(held)]) > 0.98
    for i, text in rows:
        for s in got[i]["sentences"]:
            assert any(w in text[s["start"]:s["end"]] for w in ("foul", "vile", "nasty"))


def test_toxicity_looks_away(spark):
    rows, truth = toxic_rows(400, 3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, y, _ in truth], "doc_id bigint, toxic int")
    turned = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y, _ in truth], "doc_id bigint, toxic int")
    scores = [sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity_report(docs, x).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (77, 1), (None, 1), (6, None)], "doc_id bigint, toxic int")
    rows = toxicity.toxicity_report(documents(spark), labels).collect()
    assert len(rows) == documents(spark).count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity_report(empty(spark), labels).collect() == []
    assert len(toxicity.toxicity_report(documents(spark), labels.where("false")).collect()) == documents(spark).count()


def test_main_text_of_unseen_layouts():
    model = webtext.default_model()
    pages = webtext.labelled_pages(150, seed=77)
    got = model.texts([h for h, _ in pages])
    right = wanted = found = 0
    for text, (_, truth) in zip(got, pages, strict=True):
        a, b = text.split("\n"), truth.split("\n")
        right += sum(len(x) for x in a if x in b)
        wanted += sum(map(len, b))
        found += sum(map(len, a))
    assert right / wanted > 0.97 and right / found > 0.97


def test_page_reading():
    model = webtext.default_model()
    page = ("<html><head><title>No</title></head><body><nav><a href='/'>Home</a> <a href=/x>News</a></nav><article><h1>A  title &amp; more</h1>"
            f"<p>{PROSE}&nbsp;<b>End\n of</b> it<br>now.<script>var x='</p>';</script><p>A second paragraph, which is not very short.<!-- no <p>no</p> -->"
            "</article><div class='cookie-banner'><p>We use cookies.</p></div><footer>&copy; Us. All rights reserved.</footer>")
    assert model.texts([page, "", "<p", "&", "<script>x"]) [0] == f"A title & more\n{PROSE} End of it now.\nA second paragraph, which is not very short."
    assert model.texts([""]) == [""]


@pytest.mark.parametrize("page", [
    "<html><head><title>No</title><article><p>{}</article>", "<html><head><meta charset=utf-8><script>if (a<b) '<p>'</script>{}",
    "<head><noscript><link href=x></noscript><div>{}</div>", "<svg width='1' /><p>{}</p>", "<math/><p>{}</p>", "<svg><path d='M0'><p>{}</p>",
    "<div><button>No</div><p>{}</p><button>no</button>", "<ul><li><select><option>no</ul><p>{}</p>", "<div><object><p>no</p></div><p>{}</p><object></object>",
    "<div><noscript><img src=x></div><p>{}</p><noscript>no</noscript>", "<body><button>No<p>{}</p>", "<select><option>No<h1>{}</h1>",
    "<svg><foreignObject><div>no</div></foreignObject></svg><p>{}</p>", "<object><div>no</div><object>no</object>no</object><p>{}</p>"])
def test_unread_elements_end(page):
    assert [text for _, text in webtext.Page(page.format(PROSE)).blocks] == [PROSE]


def test_messages_are_exact():
    """Marginals of the forest against summing over all states."""
    rng = np.random.default_rng(1)
    page = webtext.Page("<div><p>a b</p><ul><li>x</li><li>y, z.</li></ul></div><p>end</p>")
    weights, pair = rng.normal(size=len(webtext.FEATURES)), rng.normal(size=(2, 2))
    n = len(page.parents)
    alone = [sum(weights[f] for f in page.features[i]) for i in range(n)]
    total, ones = 0.0, np.zeros(n)
    for bits in range(2**n):
        y = [(bits >> i) & 1 for i in range(n)]
        w = np.exp(sum(alone[i] * y[i] for i in range(n)) + sum(pair[y[page.parents[i]], y[i]] for i in range(1, n)))
        total += w
        ones += w * np.array(y)
    assert np.allclose(webtext.Forest([page, page]).marginals(weights, pair)[0], np.tile(ones / total, 2))


def test_pages_operator(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain"), (3, "u", "<p>" * 3000 + "deep"), (None, "v", f"<article><p>{PROSE}</p></article>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, text string")
    got = webtext.main_texts(pages).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] is None] == [PROSE]
    assert webtext.main_texts(pages.where("false")).collect() == []


def talks(spark):
    rng = random.Random(1)
    rows = []
    for c in range(120):
        if rng.random() < 0.3:
            rows.append((c, -1, "system", "Be brief. Stay on the topic."))
        for t in range(0, 2 * rng.randint(1, 4), 2):
            rows.append((c, t, "user", "What is the " + " ".join(rng.choices(["red", "blue", "old"], k=4)) + "?"))
            rows.append((c, t + 1, "assistant", "\n".join(("It is " + "word " * 30).strip() + "." for _ in range(rng.randint(1, 4)))))
    return spark.createDataFrame([(c, t + 1, r, x) for c, t, r, x in rows], "conv_id bigint, turn bigint, role string, text string")


def test_transcripts(spark):
    rows = chat.chat_report(talks(spark)).collect()
    right = sum(r["roles"] == r["true_roles"] for r in rows)
    assert len(rows) == 120 and right > 0.97 * len(rows)
    assert all(r["rendered"].count("<|im_end|>") == r["n_turns"] for r in rows)


def test_transcript_edges(spark):
    model = chat.fit(talks(spark))
    assert model.turns(None) == [] and model.turns(" \n ") == []
    assert model.turns("User: hi\nthere <|im_end|>\n\nAssistant: yes\n\nno") == [("user", "hi\nthere <|im_end|>"), ("assistant", "yes\n\nno")]
    assert chat.render([("user", "a <|im_end|>")]) == "<|im_start|>user\na < |im_end|><|im_end|>\n"
    odd = spark.createDataFrame([(None, 1, "user", "a"), (None, 1, "user", "b"), (1, None, None, "c"), (1, 2, "USER", None), (1, 2, "robot", "d"),
                                 (2, 5000, "user", "e"), (2, 1, "user", "f")], "conv_id bigint, turn bigint, role string, text string")
    assert len(chat.chat_report(odd).collect()) == 6
    assert chat.chat_report(odd.where("false")).collect() == []


def long_talk():
    """Turns of which some texts hold names of speakers, question marks and blank lines."""
    rng = random.Random(5)
    words = ["red", "blue", "old", "yes", "why", "it"]
    texts = [rng.choice(["User:", "A: no", "\n\n".join(" ".join(rng.choices(words, k=rng.randint(1, 40))) + rng.choice("?..") for _ in range(rng.randint(1, 4))),
                         " ".join(rng.choices(words, k=rng.randint(1, 90))) + "?"]) for _ in range(700)]
    return [(t, "assistant" if t % 2 else "user", x) for t, x in enumerate(texts)]


@pytest.mark.parametrize("part_turns,apart,same", [(512, 1, 1), (512, 1000, 1), (7, 1, 1), (3, 1, 700), (1, 1, 1), (64, 1, 3)])
def test_long_conversations_are_decoded_whole(spark, part_turns, apart, same):
    """However they are cut, turns lie apart or numbers repeat: the slices joined are the transcript's result."""
    rows = [(c, t // same * apart, role, x) for c in (3, 4, 5, 6, 7, 8) for t, role, x in long_talk()]
    shape = "conv_id bigint, turn bigint, role string, text string"
    data = spark.createDataFrame(rows, shape).unionByName(talks(spark).selectExpr("conv_id + 1000 as conv_id", "turn", "role", "text"))
    model = chat.fit(data)
    got = {}
    for r in sorted(chat.chat_report(data, part_turns).where("conv_id < 100").collect(), key=lambda r: (r["conv_id"], r["part"])):
        got.setdefault(r["conv_id"], []).append(r)
    wrote = spark.createDataFrame(rows, shape).select("conv_id", "turn", "role", "text", chat.written(F.col("role"), F.col("text")).alias("line")).collect()
    for c, parts in got.items():
        lines = [r["line"] for r in sorted((r for r in wrote if r["conv_id"] == c), key=lambda r: (r["turn"], r["role"], r["text"]))]
        turns = model.turns("\n\n".join(lines))
        assert [r["part"] for r in parts] == list(range(len(parts)))
        assert "".join(r["rendered"] for r in parts) == chat.render(turns)
        assert ",".join(r["roles"] for r in parts if r["roles"]) == ",".join(role for role, _ in turns)
        assert sum(r["n_turns"] for r in parts) == len(turns)
    assert len(got) == 6
    if same == 1:
        assert all(len(parts) == len({t * apart // part_turns for t in range(700)}) for parts in got.values())


@pytest.mark.parametrize("rows,count", [(1000, 16), (5, 16), (0, 16), (333, 7)])
def test_shard_sizes_and_slots(spark, rows, count):
    df = spark.range(rows).selectExpr("id", "id as shard", "id as row").repartition(5)
    got = shards.uniform_shards(df, count, seed=4).toPandas()
    assert sorted(got["id"]) == list(range(rows))
    sizes = got.groupby("shard").size().reindex(range(count), fill_value=0)
    assert sizes.max() - sizes.min() <= 1
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    again = shards.uniform_shards(df, count, seed=4).toPandas()
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, again.values))


def test_shuffle_is_uniform(spark):
    """Each row in each shard equally often, and places without order."""
    total = np.zeros((40, 4))
    for seed in range(60):
        got = shards.uniform_shards(spark.range(40).coalesce(2), 4, seed).toPandas()
        total[got["id"], got["shard"]] += 1
    assert ((total - 15) ** 2 / 15).sum() < 120 + 5 * np.sqrt(2 * 120)


def test_hypergeometric_law():
    rng, plain = np.random.default_rng(1), np.random.default_rng(2)
    for good, bad, drawn in ((3, 5, 4), (50, 1000, 30), (400_000, 600_000, 5000)):
        mine = np.array([shards.hypergeometric(rng, good, bad, drawn) for _ in range(4000)])
        theirs = plain.hypergeometric(good, bad, drawn, 4000)
        assert abs(mine.mean() - theirs.mean()) < 6 * theirs.std() / 4000**0.5 + 1e-9
        assert abs(mine.std() - theirs.std()) < 0.1 * theirs.std() + 0.05
    assert 0 < shards.hypergeometric(rng, 10**13, 10**14, 10**6) < 10**6


def test_sharded_documents(spark):
    docs = documents(spark)
    rows = shards.sharded_documents(docs).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted(
        (len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert {r["law"] for r in rows} == {"rows"} and shards.sharded_documents(empty(spark)).collect() == []
