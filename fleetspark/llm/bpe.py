"""Counts the tokens that a byte-level BPE vocabulary makes of a text.

Texts are cut into pre-tokens by the vocabulary's pattern. Pre-tokens not met lately are merged together: their symbols lie
one after another in flat arrays, with the rank of each pair of neighbours. In each round every sequence finds its lowest
rank and merges all pairs of that rank, from the left and without overlap, all sequences at once; ranks are looked up anew
only beside what was merged. A sequence without a pair left is done, and its symbols are counted.

The vocabulary is a ``tokenizers`` file (byte-level BPE, no normaliser). Special strings inside texts are one token each, as
that library has it by default. Nothing is cut off.

Defined results: null is an empty text, of no tokens; repeated rows are rows of their own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.cache import Recent
from fleetspark.llm.keys import chunks

#: Bytes of pre-tokens remembered in a worker, and characters of text taken together.
REMEMBERED = 192 << 20
CHUNK_CHARS = 1_000_000
NO_RANK = np.iinfo(np.int32).max
#: Fixed value: the pattern of byte-level pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in such vocabularies: itself where printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairTable:
    """Rank of a pair of symbols, by open addressing in flat arrays; looks up many pairs at once."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        self.bits = int(len(pairs) * 4).bit_length()
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NO_RANK, np.int32)
        place, left = self._slot(pairs), np.arange(len(pairs))
        self.probes = 0
        while len(left):
            at = (place[left] + self.probes) & ((1 << self.bits) - 1)
            free = self.keys[at] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.ranks[at[put]] = pairs[left[put]], ranks[left[put]]
            left, self.probes = left[~put], self.probes + 1

    def _slot(self, pairs):
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, pairs: np.ndarray) -> np.ndarray:
        out = np.full(len(pairs), NO_RANK, np.int32)
        todo, at = np.arange(len(pairs)), self._slot(pairs)
        for _ in range(self.probes):
            here = self.keys[at]
            same = here == pairs[todo]
            out[todo[same]] = self.ranks[at[same]]
            going = ~same & (here >= 0)
            if not going.any():
                break
            todo, at = todo[going], (at[going] + 1) & ((1 << self.bits) - 1)
        return out


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        letters = byte_letters()
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.size = max(vocab.values()) + 1
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.table = PairTable(left * self.size + right, np.arange(len(merges), dtype=np.int32))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.known = Recent(REMEMBERED)

    def ranks_at(self, symbols: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of each pair that begins at ``at``; none at the last symbol of a sequence."""
        out = np.full(len(at), NO_RANK, np.int32)
        inner = ~ends[at]
        pairs = at[inner]
        out[inner] = self.table.rank(symbols[pairs] * self.size + symbols[pairs + 1])
        return out

    def merged_counts(self, sequences: list[bytes]) -> np.ndarray:
        """How many symbols are left of each sequence of bytes (none of them empty)."""
        counts = np.array([len(s) for s in sequences], np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(sequences), np.uint8)]
        alive, lengths = np.arange(len(sequences)), counts.copy()
        ends = np.zeros(len(symbols), bool)
        ends[np.cumsum(lengths) - 1] = True
        ranks = self.ranks_at(symbols, ends, np.arange(len(symbols)))
        while len(alive):
            starts = np.cumsum(lengths) - lengths
            lowest = np.minimum.reduceat(ranks, starts)
            going = lowest < NO_RANK
            if not going.all():
                counts[alive[~going]] = lengths[~going]
                keep = np.repeat(going, lengths)
                symbols, ends, ranks = symbols[keep], ends[keep], ranks[keep]
                alive, lengths, lowest = alive[going], lengths[going], lowest[going]
                if not len(alive):
                    break
            hit = ranks == np.repeat(lowest, lengths)
            # in a run of neighbouring hits (one symbol again and again) every second one begins a pair
            at = np.flatnonzero(hit)
            new_run = np.append(True, np.diff(at) > 1)
            first = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbols[at] = self.merged[ranks[at]]
            ends[at] |= ends[at + 1]
            owner = np.searchsorted(np.cumsum(lengths), at, "right")
            lengths = lengths - np.bincount(owner, minlength=len(lengths))
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, ends, ranks = symbols[keep], ends[keep], ranks[keep]
            now = at - np.arange(len(at))
            changed = np.concatenate([now, now[now > 0] - 1])
            ranks[changed] = self.ranks_at(symbols, ends, changed)
        return counts

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        pieces, specials = [], []
        for text in texts:
            if self.special is not None and self.special.search(text):
                parts = self.special.split(text)
                specials.append(len(parts) - 1)
                pieces.append([p for part in parts for p in self.pattern.findall(part)])
            else:
                specials.append(0)
                pieces.append(self.pattern.findall(text))
        unknown = [w for w in self.known.missing(set().union(*pieces))]
        if unknown:
            found = self.merged_counts([w.encode("utf-8", "surrogatepass") for w in unknown])
            self.known.remember(zip(unknown, found.tolist(), strict=True))
        known = self.known
        return [n + sum([known[w] for w in words]) for n, words in zip(specials, pieces, strict=True)]


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One vocabulary for each worker, not for each task."""
    return ByteBpe(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text). ``path`` is on every executor."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            out = [n for first, end in chunks(batch.column(2), CHUNK_CHARS) for n in bpe.counts(batch.column(2).slice(first, end - first).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
               .mapInArrow(rows, "doc_id bigint, n_bytes bigint, n_tokens bigint"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
