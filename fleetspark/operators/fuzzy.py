"""Pairs of texts whose similarity may reach a cutoff, without comparing all pairs.

A similarity of c between texts of a and b characters means M >= c (a + b) / 2 characters that match, in order, and at most
E = a + b - 2 M that do not. So

* their lengths differ by a factor of at most (2 - c) / c;
* of the M - q + 1 runs of q characters that match one after the other, at most E have more than q - 2 others between them,
  since each of those stands in q - 1 runs at most. At least 3 M - (a + b) - q + 1 have no more: pairs of neighbours for q = 2,
  and for q = 3 triples with at most one character left out, in one of the texts.

Texts meet by triples if both are long enough to share one for certain, else by pairs, else by characters. Of a text that
shares at least m of them the m - 1 most frequent need not be looked up. Maps of the characters leave few pairs.

Only whole texts are sent: those of a dictionary are dealt into blocks of a fixed number of characters, each of which is
indexed by one task in memory, and the headers stream past. Small dictionaries share a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.operators.ordered import sized
from fleetspark.session import stored

#: Characters of a dictionary that a task indexes at once (some 70 bytes for each at most), and of headers that stream past one index;
#: headers are not dealt further than that to keep all cores busy.
INDEXED = 3_200_000
STREAMED = 16_000_000
LEAST_STREAMED = 50_000
#: Pairs held against their maps at once, and characters of texts that are looked up at once.
PAIRS = 500_000
LOOKED_UP = 500_000
#: Bits of a piece's place in an index, and buckets of characters in a map.
PLACE_BITS = 23
BUCKETS = 256

#: The characters of a piece, contiguous first.
PATTERNS = {1: ((0,),), 2: ((0, 1),), 3: ((0, 1, 2), (0, 2, 3), (0, 1, 3))}
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_MIX = np.uint64(0xA0761D6478BD642F)
_HALF = np.uint64(32)
_EPS = 1e-9


def may_reach(n: Column, m: Column, cutoff: float) -> Column:
    """Whether texts of these lengths can be as similar as that."""
    return 2.0 * F.least(n, m) >= cutoff * (n + m) - _EPS


def least_matching(total: np.ndarray, cutoff: float) -> np.ndarray:
    """Characters that match, of texts of so many in all."""
    return np.maximum(np.ceil(total * cutoff / 2 - _EPS), 1).astype(np.int64)


class Texts:
    """Texts with what is known of each: codes of its characters, size of its pieces, how many of them it shares, its map."""

    def __init__(self, files: np.ndarray, column: pa.Array, cutoff: float):
        strings = column.to_pylist()
        self.column, self.files = column, files
        self.n = np.fromiter(map(len, strings), np.int64, len(strings))
        self.codes = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
        # with the shortest partner a text may have
        total = self.n + np.ceil(self.n * cutoff / (2 - cutoff) - _EPS)
        runs = np.ceil(total * (1.5 * cutoff - 1) - _EPS).astype(np.int64)
        self.size = np.where(runs > 2, 3, np.where(runs > 1, 2, 1))
        #: at least so many pieces are shared with any partner, by their size
        self.shares = {1: least_matching(total, cutoff), 2: runs - 1, 3: runs - 2}
        self.map = np.empty((len(strings), BUCKETS // 64), np.uint64)
        for low, high, codes, owner, _ in self.parts():
            seen = np.zeros((high - low, BUCKETS), bool)
            seen[owner - low, (codes ^ codes >> 8 ^ codes >> 16) & (BUCKETS - 1)] = True
            self.map[low:high] = np.packbits(seen, axis=1).view(np.uint64)
        self.map = np.ascontiguousarray(self.map.T)
        self.folded = np.bitwise_or.reduce(self.map)
        #: characters whose bucket another one has as well
        self.repeated = (self.n - np.bitwise_count(self.map).sum(axis=0, dtype=np.int64)).astype(np.int32)
        self.repeated_folded = (self.n - np.bitwise_count(self.folded)).astype(np.int32)

    def parts(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Texts in turn: first and last, codes, and of each code its text and how many are left in it."""
        ends = np.cumsum(self.n)
        low = 0
        while low < len(ends):
            before = ends[low] - self.n[low]
            high = max(int(np.searchsorted(ends, before + LOOKED_UP, "right")), low + 1)
            n = self.n[low:high]
            owner = np.repeat(np.arange(low, high, dtype=np.int32), n)
            yield low, high, self.codes[before:ends[high - 1]], owner, np.repeat(ends[low:high] - before, n) - np.arange(len(owner))
            low = high

    def pieces(self, size: int, bits: int, chosen: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
        """Pieces of the chosen texts: whether they leave a character out, their places and texts. Characters that repeat are told
        apart by number."""
        for _, _, codes, owners, left in self.parts():
            if size == 1:
                number = _numbers(codes, owners)
            codes = codes.astype(np.uint64)
            for gap, pattern in enumerate(PATTERNS[size]):
                span = pattern[-1]
                at = np.flatnonzero((left > span) & chosen[owners])
                owner = owners[at]
                place = self.files[owner].astype(np.uint64) * _STEPS[3]
                for step, offset in zip(_STEPS, pattern):
                    place += codes[at + offset] * step
                if size == 1:
                    place += number[at] * _STEPS[1]
                place = (place ^ (place >> _HALF)) * _MIX
                yield gap > 0, ((place ^ (place >> _HALF)) * _STEPS[2] >> np.uint64(64 - bits)).astype(np.int64), owner


def _numbers(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How many characters of the same code and text come before each."""
    number = np.zeros(len(codes), np.uint64)
    if len(codes):
        key = owner.astype(np.int64) << 21 | codes
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        number[order] = np.arange(len(codes)) - np.repeat(first, np.diff(np.r_[first, len(codes)]))
    return number


class Index:
    """Texts by their pieces of one size. A place has contiguous pieces first, then those with a character left out."""

    def __init__(self, texts: Texts, size: int, chosen: np.ndarray):
        self.size = size
        n = texts.n[chosen]
        most = sum(int(np.maximum(n - pattern[-1], 0).sum()) for pattern in PATTERNS[size])
        self.bits = min(max(most.bit_length() + 1, 8), PLACE_BITS)
        # place and text in one number, sorted in place: this is what takes the memory
        entries = np.empty(most, np.int64)
        at = 0
        for gap, place, owner in texts.pieces(size, self.bits, chosen):
            entries[at:at + len(place)] = (2 * place + gap) << 32 | owner
            at += len(place)
        entries.sort()
        self.texts = np.empty(most, np.int32)
        self.start = np.zeros((2 << self.bits) + 1, np.int32)
        at, last = 0, -1
        for low in range(0, most, 1 << 20):
            part = entries[low:low + (1 << 20)]
            part = part[np.diff(part, prepend=last) != 0]
            if len(part):
                last = part[-1]
                self.texts[at:at + len(part)] = part & 0xFFFFFFFF
                places = part >> 32
                first = np.flatnonzero(np.r_[True, np.diff(places) != 0])
                self.start[places[first] + 1] += np.diff(np.r_[first, len(places)]).astype(np.int32)
                at += len(part)
        self.texts = self.texts[:at]
        np.cumsum(self.start, out=self.start)

    def lists(self, asked: Texts, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists to look through, as owner, start and length; of each text the longest are left, as far as it shares more."""
        owners, starts, lengths = [], [], []
        for gap, place, owner in asked.pieces(self.size, self.bits, chosen):
            start = self.start[2 * place]
            # at most one of two pieces leaves a character out
            length = self.start[2 * place + (1 if gap else 2)] - start
            some = np.flatnonzero(length)
            owners.append(owner[some]), starts.append(start[some]), lengths.append(length[some])
        owner, start, length = (np.concatenate(x) for x in (owners, starts, lengths))
        spare = asked.shares[self.size] - 1
        if len(owner) and spare.any():
            longest = (1 << 20) - 1
            order = owner.astype(np.int64) << 40 | (longest - np.minimum(length, longest)).astype(np.int64) << 20
            if len(owner) <= 1 << 20:
                order |= np.arange(len(owner))
                order.sort()
                order &= (1 << 20) - 1
            else:
                order = np.argsort(order, kind="stable")
            owner, start, length = owner[order], start[order], length[order]
            first = np.searchsorted(owner, np.arange(len(asked.n)))
            keep = np.arange(len(owner)) - first[owner] >= spare[owner]
            owner, start, length = owner[keep], start[keep], length[keep]
        return owner, start, length


class Block:
    """Texts of dictionaries, to be asked for those that may be as similar as ``cutoff`` to others."""

    def __init__(self, texts: Texts, cutoff: float):
        self.known, self.cutoff, self.made = texts, cutoff, {}
        self.least = np.zeros(0, np.int64)

    def index(self, size: int, own: bool) -> Index | None:
        """Of texts that meet by pieces of this size only, or also of those that share longer ones."""
        if (size, own) not in self.made:
            chosen = self.known.size == size if own else self.known.size >= size
            self.made[size, own] = Index(self.known, size, chosen) if chosen.any() else None
        return self.made[size, own]

    def near(self, asked: Texts, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Places of the pairs that the lengths and characters of the two texts allow."""
        known = self.known
        a, b = asked.n[x], known.n[y]
        total = a + b
        if len(self.least) <= total.max(initial=0):
            self.least = least_matching(np.arange(2 * total.max() + 1), self.cutoff)
        least = self.least[total]
        # what matches has its bucket in both maps; most pairs are told apart by a quarter of the buckets
        in_both = np.minimum(asked.repeated_folded[x], known.repeated_folded[y]) + np.bitwise_count(asked.folded[x] & known.folded[y])
        near = np.flatnonzero((np.minimum(np.minimum(a, b), in_both) >= least) & (asked.files[x] == known.files[y]))
        x, y = x[near], y[near]
        in_both = np.minimum(asked.repeated[x], known.repeated[y])
        for a, b in zip(asked.map, known.map):
            in_both += np.bitwise_count(a[x] & b[y])
        return near[in_both >= least[near]]

    def partners(self, asked: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (asked, known), each at least once."""
        found, held = [], 0
        for size in PATTERNS:
            for own, chosen in ((False, asked.size == size), (True, asked.size > size)):
                index = self.index(size, own) if chosen.any() else None
                if index is None:
                    continue
                owner, start, length = index.lists(asked, chosen)
                ends = np.cumsum(length, dtype=np.int64)
                low = 0
                while low < len(owner):
                    before = ends[low] - length[low]
                    high = max(int(np.searchsorted(ends, before + PAIRS, "right")), low + 1)
                    part = length[low:high]
                    x = np.repeat(owner[low:high], part)
                    y = index.texts[np.repeat(start[low:high] + before - (ends[low:high] - part), part) + np.arange(len(x))]
                    near = self.near(asked, x, y)
                    found.append(np.unique(x[near].astype(np.int64) << 32 | y[near]))
                    held += len(found[-1])
                    if held > PAIRS:
                        both = np.unique(np.concatenate(found))
                        yield both >> 32, both & 0xFFFFFFFF
                        found, held = [], 0
                    low = high
        if held:
            both = np.unique(np.concatenate(found))
            yield both >> 32, both & 0xFFFFFFFF


def _matching(cutoff: float):
    """Rows of (cell, side, file, t) in order of cell, the known texts (side 1) first, to pairs of file, x and y."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, codes, block = None, [], {}, None
        for batch in batches:
            cells, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1
            for low, high in zip(np.r_[0, edges].tolist(), np.r_[edges, len(cells)].tolist()):
                if low == high:
                    continue
                if cells[low] != cell:
                    cell, held, codes, block = cells[low], [], {}, None
                names = batch.column(2).slice(low, high - low).dictionary_encode()
                column = batch.column(3).slice(low, high - low)
                if sides[low]:
                    own = np.array([codes.setdefault(f, len(codes)) for f in names.dictionary.to_pylist()], np.int64)
                    held.append((own[names.indices.to_numpy()], column))
                    continue
                if block is None and held:
                    block = Block(Texts(np.concatenate([f for f, _ in held]), pa.concat_arrays([c for _, c in held]), cutoff), cutoff)
                    held = []
                if block is None:
                    continue
                own = np.array([codes.get(f, -1) for f in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
                parts = np.cumsum(pc.utf8_length(column).to_numpy()) // LOOKED_UP
                turns = np.flatnonzero(np.diff(parts)) + 1
                for a, b in zip(np.r_[0, turns].tolist(), np.r_[turns, len(parts)].tolist()):
                    asked = Texts(own[a:b], column.slice(a, b - a), cutoff)
                    for x, y in block.partners(asked):
                        yield pa.RecordBatch.from_arrays([
                            names.slice(a, b - a).dictionary_decode().take(pa.array(x)), asked.column.take(pa.array(x)),
                            block.known.column.take(pa.array(y))], ["file", "x", "y"])

    return rows


def _blocks(chars: str, most: int) -> Column:
    return F.ceil(F.col(chars) / F.lit(most))


def candidates(texts: DataFrame, cutoff: float) -> DataFrame:
    """All pairs of a file that may be as similar as ``cutoff``, and others: file, x (side 0), y (side 1); a pair may repeat.

    ``texts`` has file, side, t and its length n, distinct. Texts without a partner of a fitting length are left out. Starts jobs.
    """
    texts = stored(texts)
    lengths = sized(texts.groupBy("file", "side", "n").agg(F.count(F.lit(1)).alias("c")))
    others = lengths.select(F.col("file").alias("_file"), (1 - F.col("side")).alias("_side"), F.col("n").alias("_n"))
    fits = sized(lengths.join(others, (F.col("file") == F.col("_file")) & (F.col("side") == F.col("_side")) & may_reach(
        F.col("n"), F.col("_n"), cutoff), "left_semi"))
    chars = F.col("c") * F.col("n")
    files = fits.groupBy("file").agg(F.sum(F.when(F.col("side") == 0, chars)).alias("asked"), F.sum(F.when(F.col("side") == 1, chars)).alias("known"))
    files = files.withColumn("rx", _blocks("asked", STREAMED)).withColumn("ry", _blocks("known", INDEXED)).withColumn(
        "small", (F.col("asked") < STREAMED // 8) & (F.col("known") < INDEXED // 8))
    files = sized(files)
    small, rx = F.col("small"), F.col("rx")
    totals = files.agg(F.sum(F.when(small, F.greatest(F.col("known") / (INDEXED // 4), F.col("asked") / (STREAMED // 4)))).alias("shared"),
                       F.count(F.when(small, True)).alias("files"), F.sum(F.when(~small, rx * F.col("ry"))).alias("own")).first()
    # two blocks for each core, where texts are few
    wanted = 2 * texts.sparkSession.sparkContext.defaultParallelism
    shared = max(int(totals["shared"] or 0) + 1, min(totals["files"], wanted))
    own = totals["own"] or 0
    more = max(wanted // own, 1) if own else 1
    cells = own * more + shared
    files = files.withColumn("rx", F.when(small, rx).otherwise(F.least(rx * more, F.greatest(rx, _blocks("asked", LEAST_STREAMED)))))
    # a block of its own, or one that small dictionaries share where there are many
    own_name = F.xxhash64("file")
    name = F.when(small, F.pmod(own_name, F.lit(shared))).otherwise(own_name) if totals["files"] > shared else own_name
    plan = sized(fits.join(files, "file").select("file", "side", "n", name.alias("block"), "rx", "ry"))
    part = F.xxhash64("t")
    cell = F.when(F.col("side") == 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("ry") - 1), lambda i: F.xxhash64(
        "block", F.pmod(part, F.col("rx")), i))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("rx") - 1), lambda i: F.xxhash64(
            "block", i, F.pmod(part, F.col("ry")))))
    dealt = texts.join(plan, ["file", "side", "n"]).select(F.explode(cell).alias("cell"), "side", "file", "t")
    # more tasks than cells, so that few get two
    ordered = dealt.repartition(min(4 * cells, 4000), "cell").sortWithinPartitions("cell", F.desc("side"))
    return ordered.mapInArrow(_matching(cutoff), "file string, x string, y string")
