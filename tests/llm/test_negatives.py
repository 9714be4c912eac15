"""Hard negatives against a search of all pairs in whole numbers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from fleetspark.llm import negatives

SHAPE = "vec_id bigint, embedding array<double>, label int, q string, g int, kind int, positives string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "q", 1, 2, "p", "s") for i, v, y in rows], SHAPE)


def plain(rows, every):
    held = {}
    for i, v, y in sorted((r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[2], r[1])):
        held.setdefault(i, ((y + 1) % 10 if i % 7 == 0 else y, [math.floor(x * 256) for x in v]))
    out = []
    for a, (label, q) in held.items():
        if a % every:
            continue
        scores = sorted((-sum(x * z for x, z in zip(q, p)), i, y) for i, (y, p) in held.items() if i != a)  # noqa: B905
        for s, i, _ in [x for x in scores if x[2] == label][:5]:
            fit = [x for x in scores if x[2] != label and -30 * s <= -100 * x[0] <= -90 * s][:10]
            out += [(a, i, n, other, -s, -score) for n, (score, other, _) in enumerate(fit, 1)]
    return sorted(out)


def found(spark, rows, **options):
    out = negatives.hard_negatives(frame(spark, rows), **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("group,labels,spread", [(1000, 10, 1.0), (64, 3, 0.2), (7, 2, 40.0), (128, 10, 0.0)])
def test_all_pairs(spark, group, labels, spread):
    rng = random.Random(group)
    rows = [(i, [rng.gauss(0.2, 1) * spread for _ in range(8)], rng.randrange(labels)) for i in range(400)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(0, 60, 3)]
    got = found(spark, rows, group=group, every=10)
    assert got == plain(rows, 10)
    assert spread == 0.0 or len(got) > 100


def test_edges(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0.5, 1) for _ in range(4)], i % 3) for i in range(200)]
    rows += [
        (None, [1.0] * 4, 1), (300, None, 1), (301, [1.0] * 4, None), (302, [1.0, None, 0.0, 0.0], 1), (303, [float("nan")] * 4, 1),
        (304, [float("inf"), 0.0, 0.0, 0.0], 1), (310, [], 2), (320, [2.0], 1), (-100, [1.0] * 4, 0), (10, [0.1] * 4, 0), (10, [0.1] * 4, 0), (20, [0.5] * 4, 0), (20, [0.25] * 4, 0),
    ]
    assert found(spark, rows, group=50, every=10) == plain(rows, 10)
    assert found(spark, [], every=10) == []
    assert found(spark, [(0, [1.0], 1)], every=1) == []
    assert found(spark, [(100, None, 1)]) == []


def test_wide_numbers(spark):
    """Components whose sums fit no float."""
    rng = random.Random(4)
    rows = [(i, [rng.uniform(0, 1) * 10**5, rng.uniform(0, 1) * 10**7], rng.randrange(3)) for i in range(120)]
    assert found(spark, rows, group=40, every=10) == plain(rows, 10)


@pytest.mark.parametrize("bias,size,width", [(3, 5, None), (256, 64, None), (1 << 20, 16, None), (1 << 40, 3, None), (5, 4, 12)])
def test_fields(bias, size, width):
    rng = np.random.default_rng(bias % 1000)
    kind = object if bias > 1 << 30 else np.int64
    rows, anchors = (rng.integers(-bias, bias + 1, (n, size)).astype(kind) for n in (101, 13))
    rows[0], anchors[0] = bias, bias
    rows[1], anchors[1] = -bias, -bias
    packed = negatives.Packed(rows, bias, width)
    assert packed.fields > 1 or bias == 1 << 20
    want = [[sum(int(x) * int(z) for x, z in zip(a, r, strict=True)) for r in rows] for a in anchors]
    assert packed.scores(anchors).tolist() == want
