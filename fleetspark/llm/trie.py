"""The prefix trie of conversations, by the recursion of van Emde Boas: sequences are cut at half their height, the prefixes
above the cut get names, the tree above and the trees that hang below it are treated alike and at once, and totals of the
lower trees are grafted onto the upper one.

Sequences are held as blocks of ``BLOCK`` turns, a row each, so that a conversation of any length is many small rows.

* **Names.** Two equal neighbours of blocks make one of twice the height, until the tallest conversation is one (``heights``).
  From there the recursion goes down: a tree whose root has a name is cut at half its height, and a prefix that ends at the cut
  is named by the root's name and the name of what lies between. All trees of one height are cut in one job, so there are as
  many jobs as the height has bits. Inside a block, prefixes are named turn by turn. A name is 128 bits of SHA-256.
* **Nodes** are the distinct names. A node belongs to the smallest conversation through it, which has it as the end of its own
  path; so every node's ancestors can be read from that conversation's blocks.
* **Totals.** Sums of leaves and of saved bytes are made inside blocks first. Then, from low trees to the tallest, what hangs
  below a cut is added to all nodes between the cut and the root of the upper tree, and to the root's own sum. A cut node sends
  its total to half a height of nodes, and nodes at cuts are as rare as their height is large.

No task holds a conversation, the members of a node or a node's children: members and children are counted by aggregates that
combine before they shuffle; a parent with more than a ``HEAVY``-th of all nodes as children is looked up from a table of at
most ``HEAVY`` rows, all others by a shuffled join; ids of conversations that end in one node are joined in chunks and hashed
as a stream.

Defined results: rows without conv_id take no part; a null role or text is empty; turns stand in order of turn (null first),
rows of one turn in order of role, then of their text's SHA-256; repeated rows are turns of their own; an empty table has no
nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.session import cut

#: Turns of a block.
BLOCK = 32
#: A parent with more than this part of all nodes as children is a heavy one.
HEAVY = 1000
#: Conversations that share this many low bits' worth of ids are joined to one text before they are hashed.
CHUNK_BITS = 12
NAME_HEX = 32


def named(*parts: Column | str) -> Column:
    """128 bits of the SHA-256 of the parts, each of which has a fixed length or its length before it."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, NAME_HEX))


def root_name() -> Column:
    return F.unhex(F.lit("0" * NAME_HEX))


def prefix_turns() -> Column:
    """How many turns of the group's first conversation a conversation takes over."""
    return F.crc32(F.col("conv").cast("string").cast("binary")) % 9


def in_order(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place ``p`` (from 0) in the conversation, and each conversation's length.

    Rows are sorted by ranges of (conversation, turn, ...), so a long conversation spans many tasks; its places continue from
    range to range.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = (
        conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn"), role.alias("role"), F.sha2(text, 256).alias("text_key"),
                             F.octet_length(text).cast("long").alias("bytes"))
        .where("conv IS NOT NULL")
        .withColumn("key", named(F.octet_length("role").cast("string").cast("binary"), F.encode(F.lit(":"), "utf-8"), F.encode("role", "utf-8"), F.unhex("text_key")))
    )
    # rows that are equal in all else may stand in any order; their own number lets ranges part them
    ranges = rows.withColumn("own", F.monotonically_increasing_id()).repartitionByRange("conv", "turn", "role", "text_key", "own")
    ranges = cut(ranges.drop("own").withColumn("part", F.spark_partition_id()))
    counts = cut(ranges.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")))
    lengths = counts.groupBy("conv").agg(F.sum("n").alias("length")).withColumn("h", prefix_turns())
    lengths = cut(lengths.withColumn("base", F.col("conv") - F.col("conv") % 5))
    bases = lengths.select(F.col("conv").alias("base"), F.col("length").alias("base_length"))
    # ``taken``: turns taken from the first conversation of the group; each conversation is looked up by at most nine others
    lengths = lengths.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_length", F.lit(0)))).drop("base_length")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("before", before).join(lengths.select("conv", "h", "taken"), "conv")
    number = F.row_number().over(Window.partitionBy("conv", "part").orderBy("turn", "role", "text_key"))
    placed = (
        ranges.withColumn("number", number).join(starts.drop("n"), ["conv", "part"])
        .select("conv", (F.col("before") + F.col("number") - 1).alias("p"), "h", "taken", "key", "bytes")
    )
    return placed, lengths


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv, d from 1, key, bytes), and every conversation with its rebuilt ``length``."""
    placed, lengths = in_order(conversations)
    placed, lengths = cut(placed), cut(lengths)
    own = placed.where("p >= h").select("conv", (F.col("taken") + F.col("p") - F.col("h") + 1).alias("d"), "key", "bytes")
    heads = (
        placed.where("p < 8").select(F.col("conv").alias("base"), "p", "key", "bytes")
        .join(lengths.select("conv", "base", "h"), "base").where("p < h").select("conv", (F.col("p") + 1).alias("d"), "key", "bytes")
    )
    length = F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0))
    return own.unionByName(heads), lengths.select("conv", length.alias("length"))


def heights(blocks: DataFrame, levels: int) -> list[DataFrame]:
    """For each level the whole blocks of that height, (conv, i, content): neighbours joined two by two."""
    out = [blocks]
    for _ in range(1, levels):
        half = [F.max(F.when(F.col("i") % 2 == side, F.hex("content"))) for side in (0, 1)]
        pairs = out[-1].groupBy("conv", F.shiftright("i", 1).alias("i")).agg(half[0].alias("left"), half[1].alias("right"))
        out.append(cut(pairs.where("right IS NOT NULL").select("conv", "i", named(F.unhex("left"), F.unhex("right")).alias("content"))))
    return out


def cut_names(blocks: DataFrame, levels: int) -> DataFrame:
    """Names of the prefixes of m whole blocks, (conv, m, name), m from 0 on."""
    content = heights(blocks, levels)
    known = blocks.select("conv").distinct().select("conv", F.lit(0).cast("long").alias("m"), root_name().alias("name"))
    for level in range(levels - 1, -1, -1):
        upper = known.withColumn("i", F.shiftright("m", level))
        below = upper.join(content[level], ["conv", "i"]).select("conv", (F.col("m") + (1 << level)).alias("m"), named("name", "content").alias("name"))
        known = cut(known.unionByName(below))
    return known


def paths(turns: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Rows of blocks: conv, k, start (name of the prefix before it), names and bytes of its prefixes. And the greatest number
    of whole blocks of a conversation."""
    k = ((F.col("d") - 1) / block).cast("long")
    pieces = turns.groupBy("conv", k.alias("k")).agg(F.array_sort(F.collect_list(F.struct("d", "key", "bytes"))).alias("turns"))
    pieces = cut(pieces)
    whole = pieces.where(F.size("turns") == block)
    most = whole.agg(F.max("k")).first()[0]
    most = 0 if most is None else most + 1
    chain = F.expr("aggregate(slice(turns, 2, size(turns)), array(unhex(substring(sha2(concat(start, turns[0].key), 256), 1, 32))), "
                   "(done, t) -> concat(done, array(unhex(substring(sha2(concat(element_at(done, -1), t.key), 256), 1, 32)))))")
    if not most:
        out = pieces.withColumn("start", root_name()).withColumn("names", chain)
    else:
        content = whole.select("conv", F.col("k").alias("i"), named(F.expr("aggregate(turns, binary(''), (a, t) -> concat(a, t.key))")).alias("content"))
        tops = cut_names(cut(content), most.bit_length())
        # a block that is whole ends in a cut, which has its name already
        ends = tops.where("m > 0").select("conv", (F.col("m") - 1).alias("k"), F.col("name").alias("last"))
        out = (
            pieces.join(tops.select("conv", F.col("m").alias("k"), F.col("name").alias("start")), ["conv", "k"], "left").join(ends, ["conv", "k"], "left")
            .withColumn("start", F.coalesce("start", root_name())).withColumn("names", chain)
            .withColumn("names", F.when(F.col("last").isNull(), F.col("names")).otherwise(F.concat(F.slice("names", 1, block - 1), F.array("last"))))
        )
    return cut(out.select("conv", "k", "start", "names", F.expr("transform(turns, t -> t.bytes)").alias("bytes"))), most


def trie_nodes(blocks: DataFrame, lengths: DataFrame, block: int) -> DataFrame:
    """Distinct prefixes: name, parent, depth, bytes, conv (smallest member), n_convs, n_children."""
    step = F.posexplode(F.expr("transform(names, (n, i) -> struct(n AS name, CASE WHEN i = 0 THEN start ELSE names[i - 1] END AS parent, bytes[i] AS bytes))"))
    rows = blocks.select("conv", "k", step.alias("i", "x")).select("conv", (F.col("k") * block + F.col("i") + 1).alias("depth"), "x.*")
    nodes = rows.groupBy("name", "parent", "depth", "bytes").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"))
    root = lengths.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        root_name().alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), "conv", "n_convs")
    nodes = cut(nodes.unionByName(root))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    return cut(nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` and parent_conv, the parent's conv."""
    total = nodes.count()
    parents = nodes.where("n_children > 0").select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv"), "n_children")
    many = F.col("n_children") * HEAVY > total
    heavy = nodes.join(F.broadcast(parents.where(many).drop("n_children")), "parent", "left")
    found = heavy.where("parent_conv IS NOT NULL OR parent IS NULL")
    rest = heavy.where("parent_conv IS NULL AND parent IS NOT NULL").drop("parent_conv")
    return found.unionByName(rest.join(parents.where(~many).drop("n_children"), "parent"))


SUMS = ("leaves", "saved")


def totals(blocks: DataFrame, nodes: DataFrame, block: int, most: int) -> DataFrame:
    """For each name the leaves and saved bytes of the tree below it, itself included."""
    own = nodes.select("name", "conv", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    held = own.where("depth > 0").groupBy("conv", (((F.col("depth") - 1) / block).cast("long")).alias("k")).agg(
        F.collect_list(F.struct("depth", *SUMS)).alias("held"))
    inner = cut(blocks.select("conv", "k", "start", "names").join(held, ["conv", "k"]))

    def below(after: str, what: str) -> str:
        return f"aggregate(held, 0L, (s, o) -> s + CASE WHEN o.depth > {after} THEN o.{what} ELSE 0L END)"

    inside = inner.select(F.explode(F.expr(
        f"transform(names, (n, i) -> struct(n AS name, {', '.join(below(f'k * {block} + i', s) + f' AS {s}' for s in SUMS)}))")).alias("x")).select("x.*")
    sums = [F.sum(s).alias(s) for s in SUMS]
    hanging = inner.select(F.col("start").alias("name"), "k", *[F.expr(below("-1", s)).alias(s) for s in SUMS]).groupBy("name", "k").agg(*sums)
    grafts = [inside, own.where("depth = 0").select("name", *SUMS)]
    hanging = cut(hanging.withColumnRenamed("k", "m"))
    # what hangs below the prefixes of m blocks, in trees of 1, 2, 4, ... blocks
    for level in range(most.bit_length()):
        high = 1 << level
        lower = hanging.where((F.col("m") % (2 * high)) == high).join(own.select("name", "conv"), "name")
        spread = lower.select("conv", "m", *SUMS, F.explode(F.sequence(F.col("m") - high, F.col("m") - 1)).alias("k")).join(
            blocks.select("conv", "k", "start", "names"), ["conv", "k"])
        spread = cut(spread)
        grafts.append(spread.select(F.explode("names").alias("name"), *SUMS))
        roots = spread.where(F.col("k") == F.col("m") - high).select(F.col("start").alias("name"), F.col("k").alias("m"), *SUMS)
        hanging = cut(hanging.where((F.col("m") % (2 * high)) == 0).select("name", "m", *SUMS).unionByName(roots).groupBy("name", "m").agg(*sums))
    grafts.append(hanging.select("name", *SUMS))
    out = grafts[0]
    for more in grafts[1:]:
        out = out.unionByName(more)
    return out.groupBy("name").agg(*sums)


def ends(blocks: DataFrame, lengths: DataFrame, block: int) -> DataFrame:
    """For each name at which conversations end the SHA-256 of their ids, in order, with commas between."""
    last = lengths.select("conv", "length", ((F.col("length") - 1) / block).cast("long").alias("k")).join(
        blocks.select("conv", "k", F.element_at("names", -1).alias("name")), ["conv", "k"])
    stops = last.select("conv", "name").unionByName(lengths.where("length = 0").select("conv", root_name().alias("name")))
    texts = stops.groupBy("name", F.shiftright("conv", CHUNK_BITS).alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, done = None, None, ([], [])
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name == held:
                    state.update(b"," + ids.encode())
                else:
                    if held is not None:
                        done[0].append(held)
                        done[1].append(state.hexdigest())
                    held, state = name, hashlib.sha256(ids.encode())
            if done[0]:
                yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], ["name", "ends_sha256"])
                done = ([], [])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["name", "ends_sha256"])

    ordered = texts.repartition("name").sortWithinPartitions("name", "chunk").select("name", "ids")
    return ordered.mapInArrow(hashed, "name binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of the rebuilt conversations, a row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    turns, lengths = rebuilt(conversations)
    blocks, most = paths(turns, block)
    nodes = trie_nodes(blocks, lengths, block)
    stops = ends(blocks, lengths, block)
    out = with_parents(nodes).join(totals(blocks, nodes, block, most), "name").join(stops, "name", "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children",
                      F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
