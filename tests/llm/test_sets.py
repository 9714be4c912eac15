"""Decontamination, the n-gram join and its graph, against plain versions."""

from __future__ import annotations

import random
import re

import pytest

from fleetspark.llm import decontaminate, jaccard
from fleetspark.llm.graph import components
from fleetspark.session import stored
from tests.llm.edge import LONG, PROSE, documents, empty

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_contamination(docs, items):
    windows = {}
    for item, text in items:
        words = item_words(text)
        size = min(10, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i:i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        words, hit, found = item_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if tuple(words[i:i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(words[i:i + size])]
        out.append((doc, len(words), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_contamination(spark):
    rng = random.Random(4)
    vocabulary = ["the", "The", "of", "é", "Ébène", "x1", "日本", "a", "b", "rare"]

    def some(low, high):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--", "　"]) for _ in range(rng.randint(low, high)))

    items = [(i, some(0, 30)) for i in range(20)] + [(20, "one"), (21, "two words"), (22, None), (23, "..."), (5, some(12, 12)), (24, PROSE)]
    docs = [(i, some(0, 60)) for i in range(100)] + [(100 + i, some(0, 20) + items[i % 20][1] + " " + some(0, 9)) for i in range(60)]
    docs += [(500, None), (501, ""), (502, "Two  WORDS."), (503, "and ONE"), (504, LONG + " " + PROSE), (502, "Two  WORDS."), (None, "one"), (505, "a b")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, row_key string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate.contamination(table, bench).collect()]
    want = plain_contamination(docs, items)
    assert sorted(got, key=repr) == want
    clean = decontaminate.clean_documents(table, bench).collect()
    assert sorted((r["doc_id"], r["text"]) for r in clean if r["doc_id"] is not None) == sorted(
        d for d, w in zip(sorted(docs, key=lambda d: repr((d[0], len(item_words(d[1]))))), sorted(want, key=lambda w: repr(w[:2])), strict=True)
        if w[2] == 0 and d[0] is not None) or {r["doc_id"] for r in clean} == {w[0] for w in want if w[2] == 0}


def test_contamination_edges(spark):
    bench = spark.createDataFrame([(1, PROSE)], "item_id bigint, text string")
    assert decontaminate.contamination(empty(spark), bench).collect() == []
    assert all(r["n_hit"] == 0 for r in decontaminate.contamination(documents(spark), bench.where("false")).collect())
    docs = documents(spark)
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and clean.where("doc_id = 1").count() == 0 and clean.count() == docs.count() - 3


def plain_groups(docs, gram=3, similarity=90):
    sets, low = [], []
    for _, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append(frozenset(tuple(words[i:i + gram]) for i in range(max(1, len(words) - gram + 1))) if words else frozenset())
    parent = list(range(len(docs)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if x and sets[j] and 100 * common >= similarity * (len(x) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    for i, (doc, _) in enumerate(docs):
        ids = [d for k, (d, _) in enumerate(docs) if d is not None and find(k) == find(i)]
        low.append((doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc))
    return sorted(low, key=repr)


def families(seed, gram_words=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["The", "the", "É", "x,"] * 20
    docs = []
    common = rng.choices(words, k=25)
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(2, gram_words * 4)) + (common if rng.random() < 0.7 else [])
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy).upper() if rng.random() < 0.1 else rng.choice([" ", "\n", "  "]).join(copy))
    docs += ["one", "One", "one two", "one  two", "", " ", None, None, "a b c", "a b c d", "common " * 50, "common " * 60]
    rng.shuffle(docs)
    return [(i if i % 17 else None, t) for i, t in enumerate(docs)] + [(3, docs[3]), (3, docs[5])]


@pytest.mark.parametrize("seed,gram,similarity,stripe", [(1, 3, 90, 512), (2, 3, 90, 4), (3, 5, 80, 7), (4, 2, 60, 512)])
def test_groups(spark, seed, gram, similarity, stripe):
    docs = families(seed)
    got = jaccard.similar_groups(spark.createDataFrame(docs, "doc_id bigint, text string"), gram, similarity, stripe, count_bits=6)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr) == plain_groups(docs, gram, similarity)


def test_postings_are_made_and_shuffled_once(spark, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df)

    monkeypatch.setattr(jaccard, "stored", seen)
    jaccard.similar_groups(spark.createDataFrame(families(5), "doc_id bigint, text string"), count_bits=6)
    assert [plan.count("Generate posexplode") for plan in plans if "posexplode" in plan] == [1]


@pytest.mark.parametrize("seed,similarity", [(1, 90), (2, 60), (3, 80)])
def test_lists_hold_members_that_can_match(spark, seed, similarity):
    rng = random.Random(seed)
    rows = []
    for token in range(150):
        for _ in range(rng.choice([1, 2, 2, 3, 9])):
            n = rng.randint(1, 60)
            # a prefix is as long as a pair of equal sizes may have it
            rows.append((len(rows), n, rng.randint(1, 4), rng.randint(0, n - -(-similarity * n // 100)), token))
    got = jaccard.with_partners(spark.createDataFrame(rows, "uid bigint, n bigint, c1 bigint, place int, token bigint"), similarity).collect()
    lists = {t: [r for r in rows if r[4] == t] for t in range(150)}

    def match(x, y):
        need = -(-similarity * (x[1] + y[1]) // (100 + similarity))
        return x != y and min(x[1], y[1]) * 100 >= similarity * max(x[1], y[1]) and min(x[1] - x[3], y[1] - y[3]) >= need

    several = [x for x in rows if len({y[2] for y in lists[x[4]]}) > 1]
    needed = {x[0] for x in several if any(match(x, y) for y in lists[x[4]])}
    assert needed <= {r["uid"] for r in got}
    # in lists of two none stays in vain
    assert {r["uid"] for r in got if r["m"] == 2} == {x[0] for x in several if len(lists[x[4]]) == 2} & needed
    assert len(got) < len(several) and all(r["m"] == len(lists[r["token"]]) for r in got)


def test_units_are_found_before_they_move(spark):
    units = spark.createDataFrame([(t, s, r, 10 * t + s) for t in range(300) for s, r in ((0, 0), (0, 1))], "token bigint, s int, r int, uid bigint")
    wanted = units.where("token % 7 = 0 and r = 1").select("token", "s", "r")
    out = jaccard.units_of(units, wanted)
    assert sorted(r["uid"] for r in out.collect()) == [10 * t for t in range(0, 300, 7)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan.split("Join")[1]


def test_one_of_each(spark):
    docs = documents(spark)
    out = jaccard.one_of_each_group(docs)
    rows = sorted((r["doc_id"] if r["doc_id"] is not None else -1 for r in out.collect()))
    assert out.columns == docs.columns
    # of the repeated rows 1, 1 and their near copy without an id one stays; texts without words all stay
    assert rows == [-1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert jaccard.one_of_each_group(empty(spark)).collect() == []
    assert jaccard.similar_groups(empty(spark)).collect() == []


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {a: find(a) for e in edges if e[0] != e[1] for a in e}
