"""The language of texts by compression: a text is encoded with each language's dictionary, and the smallest code wins.

A language's dictionary is raw content for zstandard: letters of sampled texts of that language, in lower case, words parted by
one space. Texts are written the same way and encoded in chunks of ``CHUNK`` bytes, so that the dictionary counts for all of a
text and not for its beginning alone; sizes are summed over chunks. Each chunk has ``FILL`` zero bytes behind it: without
them a few words are no longer than their code, are stored as they are, and have equal sizes in all languages.

If the two smallest sizes lie within ``NARROW`` of each other, the text is encoded again with a stronger search, and those
sizes count. If they are still no further apart than ``REJECT``, the prediction is marked as rejected; it stays the language
of the smallest code (the first in order of name where sizes tie).

``score`` takes code lengths for log likelihoods, a factor of two for ``TEMPER`` bytes: 1 over the sum of 2^-(excess / TEMPER).

The sample is bounded: for each language ``SAMPLE_TEXTS`` different texts, those with the least hashes, of each a passage of
``SAMPLE_CHARS`` characters at a place given by its hash. Dictionaries have ``DICTIONARY`` bytes, less if there are so many
languages that all would take more than ``ALL_DICTIONARIES``.

Defined results: null and texts without a letter are ``und`` with score 0, rejected; so are all texts if there is nothing to
learn from. Empty tables give no rows; repeated rows are rows of their own; texts are read whole, at any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetspark.session import cut

SAMPLE_TEXTS = 400
SAMPLE_CHARS = 1000
DICTIONARY = 131_072
ALL_DICTIONARIES = 64 << 20
#: Sampled texts (language and hash, some 30 bytes) up to which they are sent to all tasks; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 100_000
CHUNK = 4096
FILL = bytes(64)
#: Levels of the first and the stronger search.
LEVEL, STRONG_LEVEL = 3, 12
#: Share of the smallest size, and bytes, between which and the next the stronger search decides, and beneath which it rejects.
NARROW = (0.03, 2)
REJECT = (0.005, 1)
TEMPER = 4.0
UNKNOWN = "und"

NO_LETTERS = re.compile(r"[\W\d_]+")


def letters_of(text: str) -> str:
    """Lower-case words with one space between and after; empty if there is no letter."""
    words = NO_LETTERS.sub(" ", text.lower()).strip(" ")
    return f"{words} " if any(c.isalpha() for c in set(words)) else ""


def may_learn() -> Column:
    """Rows that are not held out."""
    return ~held_out()


def held_out() -> Column:
    """Null ids are never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def few(rows: DataFrame) -> DataFrame:
    """Small rows, marked for broadcast if there are few of them."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_ROWS else rows


def learn(docs: DataFrame) -> dict[str, bytes]:
    """The dictionaries, from the bounded sample of rows with a language. ``docs``: text and lang."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.withColumn("hash", F.xxhash64("text"))
    texts = cut(known.select("lang", "hash").distinct())
    # hashes are spread evenly: of n, about four samples' worth lie in the lowest 4 / n, so no ranking sees all of a language
    counts = few(cut(texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))))
    low = (F.col("hash") / 2.0 ** 64 + 0.5) * F.col("n") <= 4 * SAMPLE_TEXTS
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    least = cut(texts.join(counts, "lang").where(low).select("lang", "hash", place.alias("place")).where(F.col("place") <= SAMPLE_TEXTS))
    at = F.pmod("hash", F.greatest(F.length("text") - (SAMPLE_CHARS - 1), F.lit(1))).cast("int") + 1
    passages = known.join(few(least), ["lang", "hash"]).select("lang", "place", F.substring(F.col("text"), at, F.lit(SAMPLE_CHARS)).alias("passage"))
    rows = passages.groupBy("lang", "place").agg(F.min("passage").alias("passage")).collect()
    held: dict[str, list] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        held.setdefault(row["lang"], []).append(letters_of(row["passage"]))
    size = min(DICTIONARY, ALL_DICTIONARIES // max(len(held), 1))
    # what stands last is nearest; the sample's order is that of hashes
    return {lang: (" " + "".join(parts)).encode("utf-8", "surrogatepass")[-size:] for lang, parts in held.items()}


class Languages:
    """Encoders of each language, for both searches."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.first, self.strong = ([self._encoder(dictionaries[n], level) for n in self.names] for level in (LEVEL, STRONG_LEVEL))

    @staticmethod
    def _encoder(content: bytes, level: int) -> zstandard.ZstdCompressor:
        # zstandard takes no dictionary below eight bytes
        known = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made = zstandard.ZstdCompressionParameters.from_level(
            level, dict_size=len(content), source_size=CHUNK, write_content_size=False, write_checksum=False, write_dict_id=False)
        known.precompute_compress(compression_params=made)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=made)

    @staticmethod
    def sizes(encoders: list[zstandard.ZstdCompressor], data: bytes) -> list[int]:
        chunks = [data[i:i + CHUNK] + FILL for i in range(0, len(data), CHUNK)]
        return [sum(len(e.compress(c)) for c in chunks) for e in encoders]

    @staticmethod
    def close(sizes: list[int], limit: tuple[float, int]) -> bool:
        best, *rest = sorted(sizes)
        return bool(rest) and rest[0] - best <= max(best * limit[0], limit[1])

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the margin was too narrow."""
        data = letters_of(text or "").encode("utf-8", "surrogatepass")
        if not data or not self.names:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(self.first, data)
        if self.close(sizes, NARROW):
            sizes = self.sizes(self.strong, data)
        best = min(sizes)
        share = sum(2.0 ** -min((s - best) / TEMPER, 1000.0) for s in sizes)
        return self.names[sizes.index(best)], 1.0 / share, self.close(sizes, REJECT)


@lru_cache(maxsize=2)
def _languages(items: tuple) -> Languages:
    return Languages(dict(items))


def languages(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``row`` (all columns of ``docs``), lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(dictionaries.items())))
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _languages(shared.value)
        for batch in batches:
            found = [machine.predict(t) for t in batch.column(1).to_pylist()]
            kinds = (pa.string(), pa.float64(), pa.bool_())
            columns = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row", "lang_pred", "score", "rejected"])

    shape = StructType().add("row", rows.schema["row"].dataType).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return rows.mapInArrow(run, shape)


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected; learned from the rows that are not held out."""
    known = learn(docs.where(may_learn()).select("text", "lang"))
    found = languages(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out")), known)
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score", "rejected")
