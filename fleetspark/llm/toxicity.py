"""Finds toxic texts and the sentences that make them so, by multiple-instance learning.

Only whole documents are labelled. A sentence has a probability of its own, a logistic function of its words and their beginnings, and
a document is toxic unless all of its sentences are harmless: the probabilities are combined by noisy-or, with a leak for
labels that no sentence explains. Both are fitted together from document labels, by gradient ascent on their likelihood.

Fitting sees a bounded sample: the ``MAX_LABELS`` labelled documents that come first by a hash of their id. Words
and beginnings of words are chosen by how much more often they occur in toxic documents of the sample than in others, as far as chance cannot explain it among
so many words (``MAX_WORDS`` of them at most). Every document is scored, over its whole text, in one pass without a shuffle.

Defined results: a null or wordless text has the score of a text without sentences, the leak; labels that are null or belong
to no document are left out; repeated labels of a document count each; without labels of both kinds every score is 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.cache import Recent
from fleetspark.session import cut

#: Bounds of what fitting sees.
MAX_LABELS = 8000
MAX_WORDS = 300
#: How far the evidence for a word (a log likelihood ratio) must exceed what the best of all words would have by chance.
MARGIN = 1.0
#: Gradient steps, their size, and the weight of the penalty on large weights.
STEPS, RATE, PENALTY = 600, 0.05, 0.002

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


#: Lengths of word beginnings that are features besides whole words; a beginning ends in "*".
BEGINNINGS = range(4, 8)
#: Bytes of words of which a worker remembers the features.
REMEMBERED = 96 << 20


def features_of(word: str, known) -> list[str]:
    """Features of a word that are among ``known``."""
    return [f for f in [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)] if f in known]


@dataclass
class Model:
    """Weights of features; ``bias`` of every sentence that has one; ``leak``, the probability that no sentence explains."""

    weights: dict[str, float]
    bias: float
    leak: float
    seen: Recent = field(default_factory=lambda: Recent(REMEMBERED))

    def _look_up(self, words: set[str]) -> None:
        self.seen.remember((word, features_of(word, self.weights)) for word in self.seen.missing(words))

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """start, end (code points), probability of each sentence that has a feature."""
        seen, out = self.seen, []
        words = set(WORD.findall(text.lower()))
        self._look_up(words)
        telling = {w for w in words if seen[w]}
        if telling:
            for m in SENTENCE.finditer(text):
                found = telling.intersection(WORD.findall(m.group().lower()))
                if found:
                    features = sorted({f for w in found for f in seen.get(w) or features_of(w, self.weights)})
                    out.append((m.start(), m.end(), _logistic(self.bias + sum(self.weights[f] for f in features))))
        return out

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or of leak and sentences, and the sentences."""
        sentences = self.sentences(text or "")
        harmless = 1.0 - self.leak
        for _, _, p in sentences:
            harmless *= 1.0 - p
        return 1.0 - harmless, sentences


def _logistic(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-x)) if x >= 0 else np.exp(x) / (1.0 + np.exp(x))


def training_sample(docs: DataFrame, labels: DataFrame, allowed, limit: int = MAX_LABELS) -> DataFrame:
    """text, toxic of the first ``limit`` allowed labels by a hash of their id, one for each group of copies: those whose
    two least hashes of long words are equal. At most ``limit`` rows are broadcast."""
    usable = labels.where(allowed & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(limit)
    sample = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    long = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{7,}"), F.lit(0)))
    least = F.slice(F.sort_array(F.transform(long, lambda w: F.xxhash64(w))), 1, 2)
    copies = F.when(F.size(long) >= 2, least).otherwise(F.array(F.xxhash64("text")))
    one = F.min(F.struct(F.xxhash64("doc_id"), "doc_id", "toxic", "text")).alias("one")
    return cut(sample.groupBy(copies.alias("copies")).agg(one).select("one.text", "one.toxic"))


def telling_words(sample: DataFrame) -> list[str]:
    """Words that occur in more toxic documents than chance would have it, the clearest first."""
    share = sample.agg(F.avg("toxic")).first()[0]
    if not share or share == 1:
        return []
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    word = F.col("word")
    marked = [F.when(F.length(word) > n, F.concat(F.substring(word, 1, n), F.lit("*"))) for n in BEGINNINGS]
    found = (sample.select(F.monotonically_increasing_id().alias("id"), "toxic", F.explode(words).alias("word"))
             .select("id", "toxic", F.explode(F.array_compact(F.array(word, *marked))).alias("word")).distinct())
    counts = cut(found.groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")))
    part = F.col("toxic") / F.col("n")
    evidence = F.col("toxic") * F.ln(part / share) + F.when(part < 1, (F.col("n") - F.col("toxic")) * F.ln((1 - part) / (1 - share))).otherwise(0.0)
    best = counts.where(part > share).withColumn("evidence", evidence).where(F.col("evidence") >= math.log(counts.count() + 1) + MARGIN)
    return [r["word"] for r in best.orderBy(F.desc("evidence"), "word").limit(MAX_WORDS).select("word").collect()]


def fit(sample: DataFrame) -> Model:
    """The model for a sample of text, toxic. Of its texts only which chosen words each sentence has leaves the tasks."""
    words = telling_words(sample)
    if not words:
        return Model({}, -10.0, 0.0)
    index = {w: i for i, w in enumerate(words)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                rows = (sorted({index[f] for w in WORD.findall(s) for f in features_of(w, index)}) for s in SENTENCE.findall(text.lower()))
                found.append([row for row in rows if row])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.list_(pa.int32())))], ["toxic", "bags"])

    rows = sample.mapInArrow(bags, "toxic int, bags array<array<int>>").collect()
    return train(words, [(r["toxic"], r["bags"]) for r in rows])


def train(words: list[str], documents: list[tuple[int, list[list[int]]]]) -> Model:
    """Fits weights, bias and leak to labelled bags of sentences."""
    label = np.array([y for y, _ in documents], float)
    owner = np.array([d for d, (_, bags) in enumerate(documents) for _ in bags], int)
    flat = [bag for _, bags in documents for bag in bags]
    sentence = np.array([s for s, bag in enumerate(flat) for _ in bag], int)
    word = np.array([w for bag in flat for w in bag], int)
    # weights, bias, logit of the leak
    x = np.concatenate([np.full(len(words), 2.0), [-2.0, -2.5]])
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        z = np.bincount(sentence, x[:-2][word], len(flat)) + x[-2]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        leak = 1 / (1 + np.exp(-x[-1]))
        harmless = np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), len(documents))) * (1 - leak)
        harmless = np.clip(harmless, 1e-9, 1 - 1e-9)
        # of the log likelihood, by the log of the harmless probability
        slope = np.where(label > 0, -harmless / (1 - harmless), 1.0)
        by_z = -slope[owner] * p
        gradient = np.concatenate([np.bincount(word, by_z[sentence], len(words)), [by_z.sum(), -(slope * leak).sum()]]) / len(documents)
        gradient[:-2] -= PENALTY * x[:-2] / len(words)
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        x = x + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return Model(dict(zip(words, x[:-2].tolist(), strict=True)), float(x[-2]), float(1 / (1 + np.exp(-x[-1]))))


def score(docs: DataFrame, model: Model, at_least: float = 0.5) -> DataFrame:
    """doc_id, score, sentences (start, end, score of those from ``at_least`` on) of every row of ``docs``."""
    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(1).to_pylist():
                p, sentences = model.score(text)
                scores.append(p)
                spans.append([{"start": a, "end": b, "score": q} for a, b, q in sentences if q >= at_least])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, shape)], ["doc_id", "score", "sentences"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(rows, "doc_id bigint, score double, sentences array<struct<start:int,end:int,score:double>>"))


def held_out(doc_id: str = "doc_id"):
    """Whether the CRC-32 of the id, as text, is a multiple of five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, sentences of every row of ``docs``; held-out labels are never looked at."""
    model = fit(training_sample(docs, labels, ~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), F.round("score", 9).alias("score"),
                                     (F.round("score", 9) >= 0.5).cast("int").alias("predicted"), "sentences")
