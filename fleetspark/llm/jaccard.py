"""Joins documents whose sets of word n-grams have a Jaccard similarity of at least a threshold, and groups them.

Equal sets are one class; one member stands for all. The join is a prefix-filtered set join that makes use of how sets and
lists relate:

* Tokens are ordered by how frequent they are, so that prefixes hold rare ones. Every task counts its tokens in a table of
  fixed size and sends the places that stand out in it; a token that no task has often counts as rare. The order is total
  whatever the counts, and the join is exact under any order.
* Lists of a token are kept in order of set size, and of the token's position in sets of one size. Two sets that have it at
  these positions share at most what stands behind it in either, so a set's position says up to which size others can match:
  the list is left there. In a block of one size, the first member whose position is too far back ends the block, since those
  behind it have it further back still. No pair beyond is formed.
  A 512-bit parity map of each set bounds the number of tokens two sets do not share; pairs of large sets are held against
  maps as large as they are. Long lists are split into stripes, and each pair of stripes is a unit of work of its own.
* Answers are derived from those of similar sets: a set that is linked to another one inherits its group, and pairs inside
  a group are never looked at again. Each round verifies a few partners of each set, exactly and on whole sets, joins
  groups, and goes on with what lies between groups, with more partners each time, until no list has any left.

Defined results: null and wordless texts have no n-grams and are linked with nothing; a text of fewer words than n is one
n-gram; repeated rows are members of one class; a null doc_id takes part, and a group of none but those has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.llm.graph import components
from fleetspark.llm.keys import packed, row_key
from fleetspark.llm.words import NOT_SPACE, chunks, marks_of, mix, shingle_hashes, word_hashes
from fleetspark.session import cut, stored

#: Words in an n-gram; the similarity in hundredths.
GRAM = 3
SIMILARITY = 90
#: The table of token counts has two to this power of places; the bitmap that says which sets are wanted, of bits.
COUNT_BITS = 22
MARK_BITS = 24
#: Members of a list that are compared in one unit of work, and partners tried in the first round and how they grow.
STRIPE = 2048
FIRST_PARTNERS, MORE_PARTNERS = 1, 16

_OTHER = np.uint64(0xA0761D6478BD642F)
MAP_WORDS = 8
_MAPS = [f"b{i}" for i in range(MAP_WORDS)]
#: Pairs that a unit of work holds before it keeps the nearest only.
HELD_PAIRS = 300_000
#: Sets of more tokens than this have a larger map besides.
LARGE = 1024


def _sets(column: pa.Array, gram: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct n-gram hashes of every text."""
    for row, data, offsets in chunks(column):
        hashes, _, first = word_hashes(data, offsets, NOT_SPACE)
        grams, first = shingle_hashes(hashes, gram), first.tolist()
        for d in range(len(first) - 1):
            a, b = first[d], first[d + 1]
            if b - a >= gram:
                yield row + d, np.unique(grams[a:b - gram + 1])
            else:
                yield row + d, shingle_hashes(hashes[a:b], b - a) if b > a else grams[:0]


def parity_map(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of a map that says of each residue whether an odd number of tokens has it. Halves laid over each other are the
    map of half the size."""
    counts = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8))


def map_distance(x: bytes, y: bytes) -> int:
    """At least so many tokens are in one of two sets only, by their maps."""
    short, long = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(long) > len(short):
        long = long[:len(long) // 2] ^ long[len(long) // 2:]
    return int(np.bitwise_count(short ^ long).sum())


def _class(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    n = np.uint64(len(tokens))
    pair = np.array([tokens.sum(), mix(tokens ^ _OTHER).sum() ^ n], np.uint64).view(np.int64)
    return int(pair[0]), int(pair[1])


def token_levels(texts: DataFrame, gram: int, bits: int) -> np.ndarray:
    """For each place of the table of counts: 0 if its tokens are as rare as most, else more the more frequent they are.

    A task counts all its tokens and sends the places that stand out among its own; their sums decide. Few do, and at most
    one number for each place comes to the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                hashes, _, _ = word_hashes(data, offsets, NOT_SPACE)
                total += np.bincount(shingle_hashes(hashes, gram) >> np.uint64(64 - bits), minlength=1 << bits)
        usual = total.sum() / (1 << bits)
        place = np.flatnonzero(total > usual + 3 * usual**0.5 + 2)
        for low in range(0, len(place), 100_000):
            part = place[low:low + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["place", "n"])

    counts = texts.mapInArrow(count, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    high = counts.select("place", F.floor(F.log2("n")).cast("byte").alias("level")).toPandas()
    levels = np.zeros(1 << bits, np.int8)
    levels[high["place"].to_numpy(np.int64)] = high["level"].to_numpy(np.int8)
    return levels


def described(docs: DataFrame, gram: int, similarity: int, bits: int) -> DataFrame:
    """key, doc_id, n, class (c1, c2), parity map (b0 ...), prefix tokens and larger map of every document; of documents
    with one set in one task only the first has the last three."""
    levels = docs.sparkSession.sparkContext.broadcast(token_levels(docs.select("text"), gram, bits))
    names = ["key", "doc_id", "n", "c1", "c2", *_MAPS, "prefix", "large_map"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        shift, level = np.uint64(64 - bits), levels.value
        for batch in batches:
            n, classes, maps, prefixes, large = [], [], np.zeros((batch.num_rows, MAP_WORDS), np.uint64), [], []
            for row, tokens in _sets(batch.column(2), gram):
                own = _class(tokens)
                n.append(len(tokens))
                classes.append(own)
                large.append(None)
                if own in seen or not len(tokens):
                    prefixes.append(None)
                    continue
                seen.add(own)
                maps[row] = parity_map(tokens, 64 * MAP_WORDS).view(np.uint64)
                if len(tokens) > LARGE:
                    large[-1] = parity_map(tokens, 1 << len(tokens).bit_length()).tobytes()
                length = len(tokens) - -(-similarity * len(tokens) // 100) + 1
                prefixes.append(tokens[np.argsort(level[tokens >> shift], kind="stable")[:length]].view(np.int64))
            pairs = np.array(classes, np.int64).reshape(-1, 2)
            lengths = [0 if p is None else len(p) for p in prefixes]
            values = np.concatenate([p for p in prefixes if p is not None] or [np.zeros(0, np.int64)])
            listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]),
                 *(pa.array(maps[:, i].view(np.int64)) for i in range(MAP_WORDS)), listed, pa.array(large, pa.binary())], names)

    schema = "key string, doc_id bigint, n bigint, c1 bigint, c2 bigint, " + ", ".join(f"{b} bigint" for b in _MAPS) + ", prefix array<bigint>, large_map binary"
    out = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, schema)
    return stored(out.withColumn("uid", F.monotonically_increasing_id()))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """uid, text of the rows whose key is in ``wanted`` (key, uid), once each. Only they are shuffled."""
    marks = marks_of(wanted.select(F.xxhash64("key").alias("mark")), "mark", MARK_BITS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = marks.value.has(batch.column(1).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["key", "text"]).filter(pa.array(has))

    keyed = docs.select(row_key().alias("key"), "text")
    found = keyed.select("key", F.xxhash64("key").alias("mark"), "text").mapInArrow(rows, "key string, text string").join(wanted, "key")
    # repeated rows have one key
    rank = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return found.withColumn("rank", rank).where("rank = 1").select("uid", "text")


def nearest(a: np.ndarray, b: np.ndarray, far: np.ndarray, partners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (a, b) the ``partners`` nearest of each b, and which b have more."""
    order = np.lexsort((a, far, b))
    a, b, far = a[order], b[order], far[order]
    begin = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
    few = np.arange(len(b)) - np.repeat(begin, np.diff(np.append(begin, len(b)))) < partners
    return a[few], b[few], far[few], np.unique(b[~few])


def with_partners(postings: DataFrame, similarity: int) -> DataFrame:
    """token, uid, n, place, m (members of the token's list) of ``postings`` (uid, n, c1, place, token), but for members that
    match no other one of their list by size and position, and lists of one class.

    Members match if either has enough behind the token for both sizes. The nearest two behind and the one before are looked at
    as they are, of those farther off only the greatest size in reach, so that few stay in vain and none is lost.
    """
    # postings are what is most: they are shuffled once, as narrow as they can be, and all that is asked of their list is told behind
    at = F.shiftleft("n", 32).bitwiseOR(F.col("place").cast("long")).alias("at")
    moved = postings.select("token", "uid", "c1", at).repartition("token")
    moved = moved.withColumn("n", F.shiftright("at", 32)).withColumn("place", F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    order = Window.partitionBy("token").orderBy("n", "place", "uid")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the greatest sizes that a member's position allows its partner, and that its size does besides
    allowed = F.expr(f"(n - place) * {100 + similarity} div {similarity} - n")
    told = moved.select("token", "uid", "n", "place", "c1", allowed.alias("allowed")).withColumn(
        "reach", F.least(F.expr(f"100 * n div {similarity}"), "allowed"))
    told = told.select(
        "token", "uid", "n", "place", "allowed", "reach",
        F.min("c1").over(whole).alias("first"), F.max("c1").over(whole).alias("last"), F.count("*").over(whole).alias("m"),
        *[F.lead(c).over(order).alias(f"next_{c}") for c in ("n", "allowed")], F.lead("n", 2).over(order).alias("later_n"),
        *[F.lag(c).over(order).alias(f"last_{c}") for c in ("n", "reach")],
        F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, -2)).alias("earlier_reach"))
    near = ((F.col("next_n") <= F.col("reach")) & (F.col("n") <= F.col("next_allowed"))) | ((F.col("n") <= F.col("last_reach")) & (F.col("last_n") <= F.col("allowed")))
    far = (F.col("later_n") <= F.col("reach")) | (F.col("n") <= F.col("earlier_reach"))
    return told.where(F.col("first") < F.col("last")).where(near | far).select("token", "uid", "n", "place", "m")


def units_of(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``units`` whose token, s, r are in ``wanted``. Only they are shuffled."""
    key = F.xxhash64("token", "s", "r")
    marks = marks_of(wanted.select(key.alias("mark")), "mark", MARK_BITS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = marks.value.has(batch.column(batch.num_columns - 1).to_numpy().view(np.uint64))
            yield batch.filter(pa.array(has))

    return units.withColumn("mark", key).mapInArrow(rows, units.withColumn("mark", key).schema).drop("mark").join(wanted, ["token", "s", "r"])


def partner_pairs(units: DataFrame, similarity: int, partners: int) -> DataFrame:
    """Pairs a < b of list members in different groups that may be linked, with how far apart their parity maps are: for
    each member of a unit of work up to ``partners``, the nearest. A unit that had more is named by token, s, r instead of a
    pair. Where units carry large maps, these are looked at as well."""
    names = ["token", "s", "r", "own", "uid", "n", "place", "root"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("apart", pa.int64()), ("token", pa.int64()), ("s", pa.int32()), ("r", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            now = {c: table[c].to_numpy() for c in names}
            now["maps"] = np.stack([table[b].to_numpy() for b in _MAPS], 1).view(np.uint64)
            now["large"] = np.array(table["large_map"].to_pylist() + [None], object)[:-1]
            if held is not None:
                now = {c: np.concatenate([held[c], now[c]]) for c in now}
            # the last unit may go on in the next batch
            same = (now["token"] == now["token"][-1]) & (now["s"] == now["s"][-1]) & (now["r"] == now["r"][-1])
            end = len(same) - int(same.sum())
            held = {c: v[end:] for c, v in now.items()}
            if end:
                yield from pairs({c: v[:end] for c, v in now.items()})
        if held is not None:
            yield from pairs(held)

    def pairs(x):
        # members of a unit follow each other in order of size and position; each is compared with those behind it
        total = len(x["uid"])
        new = np.ones(total, bool)
        new[1:] = (np.diff(x["token"]) != 0) | (np.diff(x["s"]) != 0) | (np.diff(x["r"]) != 0)
        unit = np.cumsum(new)
        none = np.zeros(0, np.int64)
        parts, size, more = [(none, none, none)], 0, none
        # what stands behind the token, the greatest partner it allows, and where the next block of one size begins
        rest = x["n"] - x["place"]
        reach = np.minimum(100 * x["n"] // similarity, rest * (100 + similarity) // similarity - x["n"])
        block = np.flatnonzero(np.append(new[1:] | (np.diff(x["n"]) != 0), True)) + 1
        next_block = block[np.searchsorted(block, np.arange(total), "right")]
        i = np.arange(total)
        j = i + 1
        while True:
            keep = j < total
            i, j = i[keep], j[keep]
            # beyond the end of a unit, or of the sizes in reach, no further member matches either
            keep = (unit[i] == unit[j]) & (x["n"][j] <= reach[i])
            i, j = i[keep], j[keep]
            if not len(i):
                break
            both = x["n"][i] + x["n"][j]
            need = -(-similarity * both // (100 + similarity))
            late = rest[j] < need
            fit = ~late & (x["root"][i] != x["root"][j]) & ((x["s"][i] == x["r"][i]) | (x["own"][i] != x["own"][j]))
            p, q, most = i[fit], j[fit], both[fit] - 2 * need[fit]
            apart = np.bitwise_count(x["maps"][p] ^ x["maps"][q]).sum(1, dtype=np.int64)
            for k in np.flatnonzero(apart <= most):
                if x["large"][p[k]] is not None and x["large"][q[k]] is not None:
                    apart[k] = map_distance(x["large"][p[k]], x["large"][q[k]])
            near = apart <= most
            parts.append((p[near], q[near], apart[near]))
            size += int(near.sum())
            if size > HELD_PAIRS:
                *kept, over = nearest(*map(np.concatenate, zip(*parts, strict=True)), partners)
                parts, size, more = [tuple(kept)], 0, np.union1d(more, over)
            j = np.where(late, next_block[j], j + 1)
        a, b, far, over = nearest(*map(np.concatenate, zip(*parts, strict=True)), partners)
        more = np.unique(np.flatnonzero(new)[unit[np.union1d(more, over)] - 1])
        if len(a):
            ua, ub = x["uid"][a], x["uid"][b]
            out = np.unique(np.stack([np.minimum(ua, ub), np.maximum(ua, ub), far], 1), axis=0)
            blank = [pa.nulls(len(out), f.type) for f in list(schema)[3:]]
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(out[:, 2]), *blank], schema=schema)
        if len(more):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(more), pa.int64()) for _ in range(3)), *(pa.array(x[c][more]) for c in ("token", "s", "r"))], schema=schema)

    return (units.repartition("token", "s", "r").sortWithinPartitions("token", "s", "r", "n", "place", "uid")
            .mapInArrow(rows, "a bigint, b bigint, apart bigint, token bigint, s int, r int").distinct())


def still_near(pairs: DataFrame, large: DataFrame, similarity: int) -> DataFrame:
    """Those of ``pairs`` (a, b, apart) that the larger maps (uid, n, large_map) do not tell apart; ``apart`` by these."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            kept = []
            for a, b, far, n, x, m, y in zip(*cols, strict=True):
                if x is not None and y is not None:
                    far = map_distance(x, y)
                    if far > n + m - 2 * -(-similarity * (n + m) // (100 + similarity)):
                        continue
                kept.append((a, b, far))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*kept, strict=True) if kept else [[]] * 3)], ["a", "b", "apart"])

    both = (pairs.join(large.select(F.col("uid").alias("a"), F.col("n").alias("an"), F.col("large_map").alias("ax")), "a", "left")
            .join(large.select(F.col("uid").alias("b"), F.col("n").alias("bn"), F.col("large_map").alias("bx")), "b", "left"))
    return both.select("a", "b", "apart", "an", "ax", "bn", "bx").mapInArrow(rows, "a bigint, b bigint, apart bigint")


def between_groups(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose ends are not in one group yet."""
    left, right = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    return pairs.join(left, "a", "left").join(right, "b", "left").where(apart).select("a", "b", "apart")


def similar_groups(docs: DataFrame, gram: int = GRAM, similarity: int = SIMILARITY, stripe: int = STRIPE,
                   count_bits: int = COUNT_BITS) -> DataFrame:
    """key, doc_id, n_shingles, grp (null without n-grams), component_id of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = described(docs, gram, similarity, count_bits)
    classes = rows.where("n > 0").groupBy("c1", "c2").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("low"))
    postings = rows.where("prefix is not null").select("uid", "n", "c1", F.posexplode("prefix").alias("place", "token"))
    shared = with_partners(postings, similarity)
    about = rows.where("prefix is not null").join(classes.select("uid"), "uid", "left_semi").select("uid", *_MAPS)
    lists = stored(shared.join(about, "uid"))
    listed = lists.select("uid").distinct()
    keys = stored(rows.select("uid", "key").join(listed, "uid"))
    large = stored(rows.where("large_map is not null").select("uid", "n", "large_map").join(listed, "uid"))
    # a list of m members has ceil(m / stripe) stripes; each pair of stripes is a unit
    stripes = F.ceil(F.col("m") / stripe).cast("int")
    own = F.pmod(F.xxhash64("uid"), stripes).cast("int")
    units = (lists.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), stripes - 1)))
             .select("token", "uid", "n", "place", "own", *_MAPS, F.least("own", "other").alias("s"), F.greatest("own", "other").alias("r")))
    units = units.withColumn("large_map", F.lit(None).cast("binary"))
    links = tried = roots = waiting = None
    partners = FIRST_PARTNERS
    while True:
        grouped = (units.withColumn("root", F.col("uid")) if roots is None else
                   units.join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid")))
        found = cut(partner_pairs(grouped, similarity, partners))
        pairs = found.where("a is not null").select("a", "b", "apart")
        pairs = pairs if waiting is None else pairs.union(waiting).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = still_near(pairs, large, similarity)
        # of all lists together, the nearest partners of each set
        ranked = cut(pairs.withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy("apart", "a"))))
        checked = cut(verified(docs, ranked.where(F.col("rank") <= partners).select("a", "b"), keys, gram, similarity))
        good = checked.where("linked").select("a", "b")
        links = good if links is None else links.union(good)
        tried = checked.select("a", "b") if tried is None else tried.union(checked.select("a", "b"))
        roots = components(links)
        more = found.where("a is null").select("token", "s", "r")
        waiting = cut(between_groups(ranked.where(F.col("rank") > partners).select("a", "b", "apart"), roots))
        if more.isEmpty() and waiting.isEmpty():
            break
        # only units that had more go on, now with the large maps of their members
        units = stored(units_of(units.drop("large_map"), more).join(large.select("uid", "large_map"), "uid", "left"))
        partners *= MORE_PARTNERS
    named = classes.join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "root").select("c1", "c2", F.col("root").alias("grp"), "component_id")
    return (rows.select("key", "doc_id", F.col("n").alias("n_shingles"), "c1", "c2").join(named, ["c1", "c2"], "left")
            .select("key", "doc_id", "n_shingles", "grp", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def one_of_each_group(docs: DataFrame, gram: int = GRAM, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without n-grams, and of each group the one with the smallest doc_id (null ids last), as they are."""
    groups = cut(similar_groups(docs, gram, similarity))
    first = groups.where("grp is not null").groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first"))
    kept = first.select("first.key", F.lit(True).alias("once")).union(groups.where("grp is null").select("key", F.lit(False)).distinct())
    rows = packed(docs).withColumn("key", row_key()).join(kept, "key")
    # repeated rows have one key; the join has put them side by side
    rank = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return rows.withColumn("rank", rank).where(~F.col("once") | (F.col("rank") == 1)).select("row.*")


def verified(docs: DataFrame, pairs: DataFrame, keys: DataFrame, gram: int, similarity: int) -> DataFrame:
    """a, b, linked: the similarity of whole sets, made anew from whole texts, in whole numbers."""
    wanted = keys.join(pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct(), "uid").select("key", "uid")
    texts = stored(texts_of(docs, wanted))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for (_, x), (_, y) in zip(_sets(batch.column(2), gram), _sets(batch.column(3), gram), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    both = pairs.join(texts.toDF("b", "y"), "b").join(texts.toDF("a", "x"), "a").select("a", "b", "x", "y")
    return both.mapInArrow(rows, "a bigint, b bigint, linked boolean")
