"""Deals rows into shards uniformly at random, with exact shard sizes, by a hypergeometric communication matrix.

How many rows of each input partition go to each shard is drawn first: the rows of the matrix are multivariate
hypergeometric draws from what the shards still have room for, which is the law of a uniform shuffle. Partitions then deal
their rows out in random order by these counts, without seeing each other. After the exchange each shard is permuted again:
every row has a random key, shards are cut into cells by the key's first bits, a cell's first slot is the number of rows in
the cells before it, and rows are ordered inside their cell. No task holds a shard; a cell holds few rows at any size.

Rows and their partitions are kept in the shared folder before the draw, and all random numbers follow from a seed, the
partition and the row's place in it, so a task that runs again does the same.

The driver sees one number of rows for each input partition and one draw for each partition and shard, nothing of the rows.

Defined results: a null text is empty (size 1, checksum 0); repeated rows are rows of their own; with fewer rows than shards
some shards are empty; an empty table gives no rows; columns called shard or slot are replaced, others kept whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetspark.session import cut

SHARDS = 16
SEED = 20_260_101
#: Rows that a cell is meant to hold, and the least number of cells of a shard (two to this power).
CELL_ROWS = 50_000
LEAST_CELL_BITS = 6


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` taken without replacement are good. By inversion over all counts within 15 standard deviations,
    at any size; the rest has a probability below 1e-40."""
    total = good + bad
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    mean = drawn * (good / total)
    spread = math.sqrt(mean * (bad / total) * ((total - drawn) / max(total - 1, 1)))
    low, high = max(low, int(mean - 15 * spread) - 20), min(high, int(mean + 15 * spread) + 20)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) * (drawn - k)) - np.log((k + 1) * (bad - drawn + k + 1))
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    sums = np.cumsum(np.exp(weights - weights.max()))
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], "right"))


def multivariate(rng: np.random.Generator, room: np.ndarray, drawn: int) -> np.ndarray:
    """How many of ``drawn`` fall to each kind, of which there are ``room``."""
    out, left = np.zeros(len(room), np.int64), int(room.sum())
    for i, good in enumerate(room.tolist()):
        left -= good
        out[i] = hypergeometric(rng, good, left, drawn)
        drawn -= int(out[i])
    return out


def communication_matrix(counts: dict[int, int], shards: int, seed: int) -> dict[int, np.ndarray]:
    """Rows of each partition to each shard. Shard sizes differ by one at most."""
    rng = np.random.default_rng([seed, shards])
    total = sum(counts.values())
    room = np.full(shards, total // shards, np.int64)
    room[rng.permutation(shards)[:total % shards]] += 1
    matrix = {}
    for part in sorted(counts):
        matrix[part] = multivariate(rng, room, counts[part])
        room -= matrix[part]
    return matrix


def uniform_shards(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with shard (from 0) and slot (from 0, gapless in each shard): a uniform shuffle with exact sizes."""
    kept = cut(rows.drop("shard", "slot").select(F.struct("*").alias("row"), F.spark_partition_id().alias("part")))
    counts = {r["part"]: r["count"] for r in kept.groupBy("part").count().collect()}
    matrix = rows.sparkSession.sparkContext.broadcast(communication_matrix(counts, shards, seed))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rngs, room, dealt = {}, {}, {}
        for batch in batches:
            parts = batch.column(1).to_numpy()
            shard, key, place = (np.zeros(len(parts), np.int64) for _ in range(3))
            for part in np.unique(parts).tolist():
                here = np.flatnonzero(parts == part)
                if part not in rngs:
                    rngs[part], room[part], dealt[part] = np.random.default_rng([seed, shards, part]), matrix.value[part].copy(), 0
                take = multivariate(rngs[part], room[part], len(here))
                room[part] -= take
                shard[here] = rngs[part].permutation(np.repeat(np.arange(shards), take))
                key[here] = rngs[part].integers(0, 2**62, len(here))
                place[here] = dealt[part] + np.arange(len(here))
                dealt[part] += len(here)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32)), pa.array(key), pa.array(place)],
                                             ["row", "part", "shard", "key", "place"])

    shape = StructType().add("row", kept.schema["row"].dataType).add("part", "integer").add("shard", "integer").add("key", "long").add("place", "long")
    dealt = kept.mapInArrow(deal, shape)
    bits = max(LEAST_CELL_BITS, math.ceil(math.log2(max(1, sum(counts.values()) / shards / CELL_ROWS))))
    dealt = dealt.withColumn("cell", F.shiftright("key", 62 - bits))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (dealt.groupBy("shard", "cell").agg(F.count("*").alias("n"))
             .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    order = Window.partitionBy("shard", "cell").orderBy("key", "part", "place")
    placed = dealt.join(cells, ["shard", "cell"]).withColumn("slot", F.col("first") + F.row_number().over(order) - 1)
    return placed.select("row.*", "shard", F.col("slot").cast("long").alias("slot"))


def sharded_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = uniform_shards(rows, shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
