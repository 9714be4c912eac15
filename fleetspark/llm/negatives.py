"""Hard negatives: for each anchor and positive, rows of other labels whose score lies in a band below the positive's.

Scores are integer inner products, found by Kronecker-packed products. Components of several candidates, moved up by a bias
so that none is negative, stand in separate fields of one wide number; an anchor's component is multiplied with that number
once, and the sum over components holds each candidate's exact score in its field:

    sum of (a + b)(c + b)  =  score + b * sum of a + b * sum of c + n * b * b,

with a field wide enough for the greatest such sum, n * 4 * b * b. Numbers of up to 53 bits are multiplied in floating point,
where they are exact; if not even one field fits, the numbers are Python's, of any width, with ``WIDE_FIELDS`` fields.

Anchors are a stated hundredth of the rows. Candidates are dealt into groups of about ``GROUP`` rows; the anchors are sent to
each group and stream past it in batches, so that a task holds one group and one batch at any size. A group gives the best few
for each anchor, and these are merged by a ranking that Spark limits before the shuffle. A first pass finds the positives, a
second one, with the positives' bands, the negatives: scores are sorted once, and each band's first rows are read from there.

Defined results: rows with a null vec_id, label or vector, or a component that is null or not finite, take no part; missing
components of shorter vectors are 0; rows that repeat a vec_id count once, the first by label and vector. A score beyond 64 bits
is given as the nearest number that has 64. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.session import cut

POSITIVES = 5
NEGATIVES = 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
#: Candidates of a group, and anchors that stream past it together.
GROUP = 16_384
BATCH = 128
WIDE_FIELDS = 16
SCALE = 256
#: Beyond this a component times another could leave a long, and rows hold components as text.
LARGE = 1 << 31


def scaled_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (moved on for every seventh row) and q, the scaled components."""
    fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows = embeddings.where(fine).select(F.col("vec_id").cast("long"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    first = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return first.select("vec_id", moved.alias("label"), F.transform("x", lambda x: F.floor(x * SCALE).cast("double")).alias("q"))


class Packed:
    """Candidates' components, several to a number."""

    def __init__(self, rows: np.ndarray, bias: int, width: int | None = None):
        n, size = rows.shape
        self.bias, self.n, self.size = bias, n, size
        self.width = width or max((4 * bias * bias * max(size, 1)).bit_length(), 1)
        self.wide = self.width > 53
        self.fields = WIDE_FIELDS if self.wide else 53 // self.width
        kind = object if self.wide else np.float64
        words = -(-n // self.fields)
        self.packed = np.zeros((size, words), kind)
        for f in range(self.fields):
            part = rows[f * words:(f + 1) * words]
            shift = 1 << (self.width * f)
            self.packed[:, :len(part)] += (part.T + bias).astype(kind) * shift
        # of a row that is not there the field is 0, and what is taken off is not read
        self.off = rows.sum(axis=1) * bias
        self.words = words

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact scores, a row for each anchor."""
        kind = object if self.wide else np.float64
        left = (anchors + self.bias).astype(kind) @ self.packed
        out = np.empty((len(anchors), self.n), object if self.wide else np.int64)
        if not self.wide:
            left = left.astype(np.int64)
        mask = (1 << self.width) - 1
        for f in range(self.fields):
            first, end = f * self.words, min((f + 1) * self.words, self.n)
            if first < end:
                out[:, first:end] = ((left >> (self.width * f)) & mask)[:, :end - first]
        return out - self.off - (anchors.sum(axis=1) * self.bias + self.size * self.bias * self.bias)[:, None]


def _matrix(column: pa.Array, size: int, wide: bool) -> np.ndarray:
    values = column.to_pylist() if wide else None
    if wide:
        return np.array([[int(x) for x in v] + [0] * (size - len(v)) for v in values], dtype=object).reshape(len(values), size)
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), size), np.int64)
    lengths = np.diff(ends)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(ends[:-1] - ends[0], lengths)] = flat[ends[0]:ends[-1]]
    return out


class Group:
    """One group of candidates, in order of label and vec_id, packed for each label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, bias: int):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.bias = ids[order], labels[order], bias
        self.q = q[order]
        self.same: dict[int, tuple] = {}
        self.others: dict[int, tuple] = {}

    def part(self, label: int, same: bool) -> tuple[np.ndarray, Packed]:
        kept = self.same if same else self.others
        if label not in kept:
            if not same:
                # the rows of all other labels: one label's are held at a time
                kept.clear()
            low, high = np.searchsorted(self.labels, [label, label + 1])
            picked = np.arange(low, high) if same else np.r_[0:low, high:len(self.ids)]
            # in order of vec_id, so that places break ties
            picked = picked[np.argsort(self.ids[picked], kind="stable")]
            kept[label] = self.ids[picked], Packed(self.q[picked], self.bias)
        return kept[label]


def ordered_keys(scores: np.ndarray) -> np.ndarray:
    """One number for score and place: higher scores first, then smaller places."""
    n = scores.shape[1]
    return scores * n + (n - 1 - np.arange(n))


def best_of(keys: np.ndarray, count: int) -> np.ndarray:
    """The greatest ``count`` keys of each row, in falling order."""
    if keys.shape[1] > count and keys.dtype != object:
        keys = np.partition(keys, keys.shape[1] - count, axis=1)[:, -count:]
    return np.sort(keys, axis=1)[:, ::-1][:, :count]


def _long(value) -> int:
    return int(min(max(value, -(1 << 63)), (1 << 63) - 1))


def _positives(group: Group, label: int, ids: np.ndarray, q: np.ndarray, _) -> Iterator[tuple]:
    found, packed = group.part(label, True)
    if len(found) == 0:
        return
    n = len(found)
    top = best_of(ordered_keys(packed.scores(q)), POSITIVES + 1)
    for anchor, row in zip(ids.tolist(), top, strict=True):
        for key in row.tolist():
            other = int(found[n - 1 - key % n])
            if other != anchor:
                yield anchor, None, other, None, _long(key // n)


def _negatives(group: Group, label: int, ids: np.ndarray, q: np.ndarray, positives: list) -> Iterator[tuple]:
    found, packed = group.part(label, False)
    n = len(found)
    if n == 0:
        return
    keys = np.sort(ordered_keys(packed.scores(q)), axis=1)
    for anchor, row, wanted in zip(ids.tolist(), keys, positives, strict=True):
        for positive, score in wanted:
            # 30 p <= 100 s <= 90 p, as whole numbers
            low, high = -(-LOW_PERCENT * score // 100), HIGH_PERCENT * score // 100
            if low > high:
                continue
            end = int(np.searchsorted(row, (high + 1) * n, "left"))
            start = max(int(np.searchsorted(row, low * n, "left")), end - NEGATIVES)
            for key in row[start:end].tolist():
                yield anchor, positive, int(found[n - 1 - key % n]), score, _long(key // n)


SHAPE = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("found_id", pa.int64()), ("positive_score", pa.int64()), ("score", pa.int64())])


def against_all(rows: DataFrame, anchors: DataFrame, groups: int, size: int, bias: int, find) -> DataFrame:
    """What ``find`` gives for each anchor in each group of candidates. ``anchors`` has vec_id, label, q and positives."""
    spread = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"), "vec_id", "label", "q",
                         F.lit(None).cast("array<struct<id:bigint,score:bigint>>").alias("positives"))
    sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), "vec_id", "label", "q", "positives")
    wide = bias >= LARGE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group = None

        def give(found: list) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, SHAPE, strict=True)], schema=SHAPE)

        for batch in batches:
            g, kind = (batch.column(i).to_numpy() for i in range(2))
            ids, labels = (batch.column(i).to_numpy() for i in (2, 3))
            # runs of one group and kind
            edges = np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1
            for first, end in zip(np.r_[0, edges], np.r_[edges, len(g)], strict=True):
                first, end = int(first), int(end)
                if first == end:
                    continue
                q = _matrix(batch.column(4).slice(first, end - first), size, wide)
                if kind[first] == 0:
                    if held and held[0][0] != g[first]:
                        held = []
                    held.append((g[first], ids[first:end].copy(), labels[first:end].copy(), q))
                    group = None
                    continue
                if held and held[0][0] != g[first]:
                    held, group = [], None
                if group is None and held:
                    group = Group(*(np.concatenate([h[i] for h in held]) for i in (1, 2, 3)), bias)
                if group is None:
                    continue
                wanted = batch.column(5).slice(first, end - first).to_pylist()
                # anchors come in order of label
                turns = np.flatnonzero(np.diff(labels[first:end])) + 1
                for a, b in zip(np.r_[0, turns], np.r_[turns, end - first], strict=True):
                    for start in range(int(a), int(b), BATCH):
                        stop = min(start + BATCH, int(b))
                        positives = [[(p["id"], p["score"]) for p in w or []] for w in wanted[start:stop]]
                        found = list(find(group, int(labels[first + start]), ids[first + start:first + stop], q[start:stop], positives))
                        if found:
                            yield give(found)

    dealt = spread.unionByName(sent).repartition(groups, "g").sortWithinPartitions("g", "kind", "label", "vec_id")
    return dealt.mapInArrow(run, "anchor_id bigint, positive_id bigint, found_id bigint, positive_score bigint, score bigint")


def first_of(found: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The first ``count`` rows of each key, by falling score and rising id, with their rank from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def hard_negatives(embeddings: DataFrame, group: int = GROUP, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score. Anchors: rows whose vec_id ``every`` divides."""
    rows = cut(scaled_rows(embeddings))
    largest = F.max(F.aggregate("q", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x))))
    count, size, largest = rows.agg(F.count(F.lit(1)), F.max(F.size("q")), largest).first()
    groups = max(1, -(-count // group))
    bias, size = int(largest or 0), size or 0
    anchors = rows.where(F.col("vec_id") % every == 0)
    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")
    positives = first_of(against_all(rows, anchors.withColumn("positives", none), groups, size, bias, _positives), ["anchor_id"], POSITIVES)
    # at most POSITIVES for each anchor
    bands = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct(F.col("found_id").alias("id"), "score")).alias("positives"))
    wanted = cut(anchors.join(bands, "vec_id"))
    found = first_of(against_all(rows, wanted, groups, size, bias, _negatives), ["anchor_id", "positive_id"], NEGATIVES)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
