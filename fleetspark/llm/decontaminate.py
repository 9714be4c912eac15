"""Finds documents that contain passages of benchmark items: a prefix-filtered set join.

An item is covered by windows of ten consecutive words. A window is a set of three-word shingles, and a document holds it
only if it holds all of them, so the window's rarest shingle is all the prefix that the join needs. Shingles are ordered
by how many places of the corpus hold them. A document sends only the places where a prefix shingle stands, with the words
around; place and window meet in a join on the shingle, the position must leave room for the window, and the words of the
window are then compared one by one.

Two passes read the texts: one counts the benchmark's shingles in all documents, one finds the places. What is broadcast
is one bitmap of hashes, of fixed size.

Defined results: a null or wordless text has no words and no hits; an item without words has no window; repeated documents
and items count each for itself, but items of one id count once; an item without an id hits words, but is not among the items
of a document; an empty table gives no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.llm.keys import packed, row_key
from fleetspark.llm.words import LETTER_OR_DIGIT, chunks, marks_of, shingle_hashes, word_hashes
from fleetspark.session import cut

#: Words in a window, and in a shingle. Windows that are shorter than a shingle are one shingle.
WINDOW = 10
SHINGLE = 3
#: The bitmap of hashes that goes to every task has two to this power of bits.
MARK_BITS = 24

#: Bytes as they are compared: separators as blanks, A-Z as a-z.
_PLAIN = bytes(x + 32 if 65 <= x <= 90 else x if LETTER_OR_DIGIT[x] else 32 for x in range(256))


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def window_rows(text: str | None, window: int, shingle: int) -> list[tuple[str, int, int, int]]:
    """(words of the window, their number, offset of the shingle in it, hash of the shingle) for all windows and shingles."""
    words = plain_words(text)
    if not words:
        return []
    joined = b" ".join(words)
    data = np.frombuffer(joined, np.uint8)
    hashes, _, _ = word_hashes(data, np.array([0, len(data)]), LETTER_OR_DIGIT)
    size = min(window, len(words))
    marks = _signed(shingle_hashes(hashes, min(shingle, size)))
    per = size - min(shingle, size) + 1
    return [(b" ".join(words[i:i + size]).decode("utf-8", "surrogatepass"), size, j, int(marks[i + j]))
            for i in range(len(words) - size + 1) for j in range(per)]


def benchmark_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """item_id, words, size, offset, mark of every shingle of every window."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, *row) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                   for row in window_rows(text, window, shingle)]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
                pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["item_id", "words", "size", "offset", "mark"])

    return (items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(rows, "item_id string, words string, size int, offset int, mark bigint"))


def _places(data, offsets, sizes, marks):
    """For each shingle size: numbers of the words where a marked shingle begins within its text, and their hashes."""
    hashes, at, first = word_hashes(data, offsets, LETTER_OR_DIGIT)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(hashes)) if len(hashes) else np.zeros(0, np.int64)
    found = []
    for size in sizes:
        shingles = shingle_hashes(hashes, size)
        hit = np.flatnonzero(marks.has(shingles) & (left[:len(shingles)] >= size)) if len(shingles) else np.zeros(0, np.int64)
        found.append((hit, shingles[hit]))
    return found, at, first


def shingle_counts(documents: DataFrame, marks, sizes: list[int]) -> DataFrame:
    """How many places of all documents hold a marked shingle: mark, places."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                found, _, _ = _places(data, offsets, sizes, marks.value)
                mark, n = np.unique(np.concatenate([h for _, h in found]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(mark)), pa.array(n.astype(np.int64))], ["mark", "places"])

    return (documents.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "mark bigint, places bigint")
            .groupBy("mark").agg(F.sum("places").alias("places")))


def candidate_places(documents: DataFrame, marks, sizes: list[int], window: int) -> DataFrame:
    """One row for each document (mark null) with its words' number and a row key, and one for each place of a prefix
    shingle, with the number of its first word and the up to ``window - 1`` words before it and ``window`` from it on."""
    schema = pa.schema([("row_key", pa.string()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("mark", pa.int64()),
                        ("place", pa.int64()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0), batch.column(1)
            for row, data, offsets in chunks(batch.column(2)):
                found, at, first = _places(data, offsets, sizes, marks.value)
                texts = len(offsets) - 1
                none = pa.nulls(texts, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(row, texts), ids.slice(row, texts), pa.array(np.diff(first).astype(np.int64)), none, none,
                     pa.nulls(texts, pa.list_(pa.string())), pa.nulls(texts, pa.list_(pa.string()))], schema=schema)
                raw, at = data.tobytes(), np.append(at, len(data))
                out = []
                for hit, hashes in found:
                    owner = np.searchsorted(first, hit, "right") - 1
                    for w, h, d in zip(hit.tolist(), _signed(hashes).tolist(), owner.tolist(), strict=True):
                        low, high = max(int(first[d]), w - window + 1), min(int(first[d + 1]), w + window)
                        end = int(offsets[d + 1]) if high == first[d + 1] else int(at[high])
                        words = [x.decode("utf-8", "surrogatepass") for x in raw[at[low]:end].translate(_PLAIN).split()]
                        out.append((keys[row + d].as_py(), ids[row + d].as_py(), None, h, w - int(first[d]), words[:w - low], words[w - low:]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return (documents.select(row_key().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"),
                             F.col("text").cast("string").alias("text"))
            .mapInArrow(rows, "row_key string, doc_id bigint, n_words bigint, mark bigint, place bigint, before array<string>, after array<string>"))


def find_windows(documents: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                 mark_bits: int = MARK_BITS) -> tuple[DataFrame, DataFrame]:
    """(documents with row_key, doc_id, n_words; occurrences with row_key, item_id, begin, size).

    ``documents`` has doc_id and text, ``items`` has item_id and text. An occurrence is a window of the item standing at
    word ``begin`` of the document.
    """
    parts = cut(benchmark_windows(items, window, shingle))

    sizes = sorted(r[0] for r in parts.select(F.least("size", F.lit(shingle)).alias("s")).distinct().collect())
    counts = shingle_counts(documents, marks_of(parts, "mark", mark_bits), sizes or [shingle])
    rarest = Window.partitionBy("item_id", "words").orderBy(F.coalesce("places", F.lit(0)), "mark", "offset")
    prefix = cut(parts.join(counts, "mark", "left").withColumn("rank", F.row_number().over(rarest))
                 .where("rank = 1").select("item_id", "words", "size", "offset", "mark"))
    rows = cut(candidate_places(documents, marks_of(prefix, "mark", mark_bits), sizes or [shingle], window))
    docs = rows.where("mark is null").select("row_key", "doc_id", "n_words")
    around = F.concat_ws(" ", F.slice("before", F.greatest(F.size("before") - F.col("offset") + 1, F.lit(1)), F.col("offset")),
                         F.slice("after", F.lit(1), F.col("size") - F.col("offset")))
    fits = (F.size("before") >= F.col("offset")) & (F.size("after") >= F.col("size") - F.col("offset"))
    found = (rows.where("mark is not null").join(prefix, "mark").where(fits).where(around == F.col("words"))
             .select("row_key", "item_id", (F.col("place") - F.col("offset")).alias("begin"), "size"))
    return docs, found


def contamination(documents: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """row_key, doc_id, n_words, n_hit (words inside an occurrence), item_ids (sorted) of every document."""
    docs, found = find_windows(documents, items, window, shingle)
    found = cut(found)
    words = (found.select("row_key", F.explode(F.expr("sequence(begin, begin + size - 1)")).alias("word")).distinct()
             .groupBy("row_key").agg(F.count("*").alias("n_hit")))
    which = (found.select("row_key", "item_id").distinct().groupBy("row_key")
             .agg(F.sort_array(F.collect_list("item_id")).alias("item_ids")))
    none = F.array().cast("array<string>")
    return (docs.join(words, "row_key", "left").join(which, "row_key", "left")
            .select("row_key", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("item_ids", none).alias("item_ids")))


def clean_documents(documents: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``documents`` that hold no window of any item, as they are."""
    _, found = find_windows(documents, items, window, shingle)
    keyed = packed(documents).withColumn("row_key", row_key())
    return keyed.join(found.select("row_key").distinct(), "row_key", "left_anti").select("row.*")
