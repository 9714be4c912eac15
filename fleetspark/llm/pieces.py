"""Encodes texts into the pieces of a SentencePiece model and back, as weighted finite-state transduction.

Three transducers are composed with each input, lazily:

* the normaliser writes spaces as the model's sign for them and puts one in front of the text;
* the piece transducer reads characters and writes pieces; a character that is no piece is read as such and written as the
  pieces of its bytes (byte fallback);
* the pair acceptor says which piece may follow which. For a BPE model a sequence is what merging yields exactly if each two
  neighbours are what merging yields of them alone; such arcs weigh nothing, all others infinitely much. The pairs are found
  when a path first needs them, and kept.

The output is the tropical shortest path. A piece weighs nothing in a BPE model, where the pair acceptor leaves one path; in
a unigram model it weighs its negative log probability and any piece may follow any. No piece holds a space sign after
another character, so the composed machine goes through a single state before each space that follows a character: inputs
are cut there, and stretches met lately are remembered.

Defined results: null is an empty text, of no pieces; decoding gives the text that was encoded, but for the sign itself, of
which the model makes a space; columns that have the name of a result are replaced by it, others kept whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType

from fleetspark.llm.cache import Recent
from fleetspark.llm.keys import chunks, mapped

SPACE = "▁"
#: Bytes of stretches remembered in a worker, pairs remembered (of some 200 bytes), and bytes of text taken together.
REMEMBERED = 192 << 20
PAIRS = 500_000
CHUNK_BYTES = 1_000_000


def _fields(data: bytes) -> dict[int, list]:
    """Field numbers and values of a protocol buffer message, values undecoded."""
    out, i = {}, 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            value, i = data[i:i + size], i + size
        out.setdefault(key >> 3, []).append(value)
    return out


class Pieces:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            spec = _fields(f.read())
        rules = _fields(spec[3][0]) if 3 in spec else {}
        if rules.get(2, [b""])[0] or rules.get(4, [1])[0] or not rules.get(5, [1])[0]:
            raise ValueError(f"{path}: only models that keep texts as they are, but for the sign for spaces")
        self.prefix = bool(rules.get(3, [1])[0])
        self.merging = _fields(spec[2][0]).get(3, [1])[0] == 2
        size = model.vocab_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.text_of = [model.id_to_piece(i) for i in range(size)]
        self.score = [model.get_score(i) for i in range(size)]
        self.arcs = {self.text_of[i]: i for i in plain}
        self.bytes_of = {i: int(self.text_of[i][3:5], 16) for i in range(size) if model.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes_of.items()}
        self.unknown = model.unk_id()
        self.reach: dict[str, int] = {}
        for piece in self.arcs:
            self.reach[piece[-3:]] = max(len(piece), self.reach.get(piece[-3:], 2))
        if any(SPACE in p.lstrip(SPACE) for p in self.arcs):
            raise ValueError(f"{path}: a piece has a space after another character")
        # characters that no piece has among others stand alone as well
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.arcs))
        self.stretch = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known = Recent(REMEMBERED)
        self.pairs: dict[str, bool] = {}

    def merged(self, text: str) -> list[str]:
        """What merging makes of a few characters: again and again the best pair, the first of equals."""
        parts = list(text)
        score, arcs = self.score, self.arcs
        while len(parts) > 1:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                found = arcs.get(parts[i] + parts[i + 1])
                if found is not None and score[found] > best:
                    best, at = score[found], i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: str, right: str) -> bool:
        """Whether the pair acceptor has an arc from ``left`` to ``right`` ("" is the start)."""
        key = f"{left} {right}"
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            parts = self.merged(left + right)
            found = self.pairs[key] = parts == ([left, right] if left else [right])
        return found

    def paths(self, texts: list[str]) -> Iterator[list[str]]:
        """Shortest path through each stretch, as the strings it goes through. What is known of a beginning holds for all
        stretches that begin so; sorted ones share most of it."""
        arcs, reach, score = self.arcs, self.reach, self.score
        pairs, follows = self.pairs, self.follows
        before, last, weight, old = [0], [""], [0.0], ""
        floor = min(score) - 10.0
        for text in texts:
            n = len(text)
            same = 0
            for x, y in zip(old, text):  # noqa: B905
                if x != y:
                    break
                same += 1
            del before[same + 1:], last[same + 1:], weight[same + 1:]
            old = text
            for end in range(same + 1, n + 1):
                # no piece that ends so is longer
                low = end - reach.get(text[end - 3:end], 2) if end > 2 else 0
                if self.merging:
                    for begin in range(low if low > 0 else 0, end):
                        part = text[begin:end]
                        if part in arcs or end - begin == 1:
                            left = last[begin]
                            fits = pairs.get(f"{left} {part}")
                            if fits or fits is None and follows(left, part):
                                break
                    before.append(begin)
                    last.append(part)
                else:
                    best, at = math.inf, end - 1
                    for begin in range(max(low, 0), end):
                        part = text[begin:end]
                        if part in arcs or end - begin == 1:
                            w = weight[begin] - (score[arcs[part]] if part in arcs else floor)
                            if w < best:
                                best, at = w, begin
                    before.append(at)
                    last.append(text[at:end])
                    weight.append(best)
            parts, end = [], n
            while end:
                parts.append(last[end])
                end = before[end]
            yield parts[::-1]

    def ids(self, parts: list[str]) -> list[int]:
        out = []
        for part in parts:
            found = self.arcs.get(part)
            if found is not None:
                out.append(found)
            elif self.byte_id:
                out += [self.byte_id[b] for b in part.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def normalised(self, text: str) -> str:
        return (SPACE + text if self.prefix and text else text).replace(" ", SPACE)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as 32-bit numbers one after another."""
        cut = [self.stretch.findall(self.normalised(t)) for t in texts]
        known = self.known
        unknown = sorted(known.missing(set().union(*cut)))
        known.remember((part, pack(f"<{len(ids)}i", *ids)) for part, ids in zip(unknown, map(self.ids, self.paths(unknown)), strict=True))
        return [b"".join([known[part] for part in parts]) for parts in cut]

    @property
    def output(self) -> list[bytes]:
        """What each id is decoded to."""
        if not hasattr(self, "_output"):
            self._output = [bytes([self.bytes_of[i]]) if i in self.bytes_of else t.replace(SPACE, " ").encode() for i, t in enumerate(self.text_of)]
        return self._output

    def decode(self, ids: bytes) -> str:
        """The text of ids: the inverse transduction, and the space in front taken away."""
        output = self.output
        out = b"".join([output[i] for i in np.frombuffer(ids, "<i4").tolist()]).decode("utf-8", "surrogatepass")
        return out[1:] if self.prefix and out.startswith(" ") else out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One machine for each worker, not for each task."""
    return Pieces(path)


def encode(docs: DataFrame, path: str, out: str = "piece_ids", digest: bool = False) -> DataFrame:
    """``docs`` and the ids of each text; with ``digest`` instead n_pieces, ids_sha256 (of the ids as 32-bit numbers, low
    byte first) and round_trip, whether decoding gives the text back. ``path`` is on every executor."""
    docs = docs.drop(*(["n_pieces", "ids_sha256", "round_trip"] if digest else [out]))
    names = docs.columns
    text_at = names.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = pieces(path)
        for batch in batches:
            column = batch.column(text_at)
            for first, end in chunks(column, CHUNK_BYTES):
                texts = [t or "" for t in column.slice(first, end - first).to_pylist()]
                encoded = machine.encode(texts)
                same = batch.slice(first, end - first)
                if digest:
                    cols = [pa.array([len(e) // 4 for e in encoded], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in encoded]),
                            pa.array([machine.decode(e) == t for e, t in zip(encoded, texts, strict=True)])]
                    kept = [same.column(i) for i in range(len(names)) if i != text_at]
                    yield pa.RecordBatch.from_arrays([*kept, *cols], [*(n for n in names if n != "text"), "n_pieces", "ids_sha256", "round_trip"])
                else:
                    ends = pa.array(np.append(0, np.cumsum([len(e) // 4 for e in encoded])).astype(np.int32))
                    ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(encoded), "<i4")))
                    yield pa.RecordBatch.from_arrays([*same.columns, ids], [*names, out])

    kept = StructType([f for f in docs.schema.fields if not (digest and f.name == "text")])
    added = kept.add("n_pieces", "long").add("ids_sha256", "string").add("round_trip", "boolean") if digest else kept.add(out, ArrayType(IntegerType()))
    return mapped(docs, rows, added.names, added)


def decode(encoded: DataFrame, path: str, ids: str = "piece_ids", out: str = "text") -> DataFrame:
    """``encoded`` and the text of each array of ids; null ids are an empty text."""
    encoded = encoded.drop(out)
    at, names = encoded.columns.index(ids), encoded.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = pieces(path)
        for batch in batches:
            texts = [machine.decode(np.array(x or [], "<i4").tobytes()) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out])

    shape = StructType(list(encoded.schema.fields)).add(out, "string")
    return mapped(encoded, rows, shape.names, shape)
