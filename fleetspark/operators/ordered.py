"""Row-order primitives that never put a whole series into one task.

A series (one unit's channel) can hold a large share of all rows, so the work is
done in two levels. Rows are cut into chunks of time; inside a chunk an ordinary
window does the job, in a task of its own. One summary row per series and chunk
is then walked in chunk order and joined back. A summary walk handles at most
(time span / chunk width) rows per series, whatever the number of readings.

Every function takes ``keys`` (the series) and ``order`` (columns, the first a
timestamp, together unique within a series). Keys must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions.timefn import duration_us, from_micros, micros
from fleetspark.session import cut

DEFAULT_CHUNK = "1 day"
BLOCK_ROWS = 100_000
SMALL_GROUP = 100_000
#: Probes, of some 30 bytes, up to which they are sent to all tasks; stretches of time of a series that are walked.
MAX_PROBES = 200_000
MAX_WALK = 100_000
#: A key with more than this part of all rows is looked up, not sent anywhere.
HEAVY = 1000


# what a local relation may hold
LOCAL_BYTES = 8_000_000


def sized(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """``df`` as a local relation if it has at most ``max_rows`` rows of ``LOCAL_BYTES`` in all, else ``df`` itself.

    Meant for small decisions that are used several times: the size of a local
    relation is known to Spark, which then broadcasts it, and a larger one stays
    a shuffled join that adaptive execution may split. Starts a job.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows or head.nbytes > LOCAL_BYTES:
        return df
    return df.sparkSession.createDataFrame(head, schema=df.schema)


def chunk_no(ts: str, width: str) -> Column:
    return F.floor(micros(ts) / F.lit(duration_us(width))).cast("long")


# widths a chunk may have, from wide to narrow
CHUNK_WIDTHS = ("30 days", "1 day", "1 hour", "5 minutes", "10 seconds", "1 second", "10 ms")
CHUNK_ROWS = 1_000_000


def fit_chunk(df: DataFrame, keys: Sequence[str], ts: str = "ts", most_rows: int = CHUNK_ROWS) -> str:
    """The widest chunk in which no series has more than ``most_rows`` rows.

    For series whose density is not known. Starts a job: one count per series and hour, which is rolled up to the wider
    chunks; only where hours are too full is the table counted again.
    """
    hour = CHUNK_WIDTHS.index("1 hour")
    hours = df.groupBy(*keys, chunk_no(ts, "1 hour").alias("_hour")).agg(F.count(F.lit(1)).alias("_n"))
    tried = None
    for i, width in enumerate(CHUNK_WIDTHS[:hour + 1]):
        chunk = F.floor(F.col("_hour") * F.lit(duration_us("1 hour")) / F.lit(duration_us(width)))
        most = hours.groupBy(*keys, chunk.alias("_chunk")).agg(F.sum("_n").alias("_n")).agg(F.lit(i).alias("_i"), F.max("_n").alias("_n"))
        tried = most if tried is None else tried.unionAll(most)
    fitting = [r["_i"] for r in tried.collect() if (r["_n"] or 0) <= most_rows]
    if fitting:
        return CHUNK_WIDTHS[min(fitting)]
    for width in CHUNK_WIDTHS[hour + 1:]:
        counts = df.groupBy(*keys, chunk_no(ts, width).alias("_chunk")).agg(F.count(F.lit(1)).alias("_n"))
        if (counts.agg(F.max("_n")).first()[0] or 0) <= most_rows:
            break
    return width


def with_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                    name: str = "row", chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """1-based position of each row in its series."""
    k = [*keys, "_chunk"]
    rows = df.withColumn("_chunk", chunk_no(order[0], chunk))
    walk = Window.partitionBy(*keys).orderBy("_chunk")
    before = (
        rows.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"))
        .select(*k, (F.sum("_n").over(walk) - F.col("_n")).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy(*k).orderBy(*order))
    return (
        rows.withColumn("_inside", inside).join(before, k)
        .withColumn(name, F.col("_inside") + F.col("_before"))
        .drop("_chunk", "_inside", "_before")
    )


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  cols: Sequence[str], name: str = "prev", chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Struct ``name`` with ``cols`` of the row before (null on a series' first row)."""
    k = [*keys, "_chunk"]
    rows = df.withColumn("_chunk", chunk_no(order[0], chunk))
    packed = F.struct(*cols)
    walk = Window.partitionBy(*keys).orderBy("_chunk")
    carried = (
        rows.groupBy(*k).agg(F.max_by(packed, F.struct(*order)).alias("_tail"))
        .select(*k, F.lag("_tail").over(walk).alias("_carried"))
    )
    inside = F.lag(packed).over(Window.partitionBy(*k).orderBy(*order))
    return (
        rows.withColumn("_inside", inside).join(carried, k)
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("_chunk", "_inside", "_carried")
    )


def with_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
              chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Runs of equal neighbours: ``run_id`` (1, 2, ... per series), ``run_len``, ``run_start``.

    A null equals nothing, so each null is a run of its own.
    """
    k = [*keys, "_chunk"]
    inside = Window.partitionBy(*k).orderBy(*order)
    whole = Window.partitionBy(*k)
    same = F.coalesce(F.col(value) == F.lag(value).over(inside), F.lit(False))
    first = F.row_number().over(inside) == 1
    pieces = (
        df.withColumn("_chunk", chunk_no(order[0], chunk))
        .withColumn("_new", F.when(first | same, 0).otherwise(1))
        .withColumn("_first", first)
        .withColumn("_piece", F.sum("_new").over(inside))
        .withColumn("_last", F.max("_piece").over(whole))
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*k, "_piece")))
    )
    # one row per chunk: its first and last piece may go on in the chunks beside it
    chunks = pieces.groupBy(*k).agg(
        F.max("_last").alias("_last"),
        F.count_if(F.col("_piece") == 0).alias("_n_head"),
        F.count_if(F.col("_piece") == F.col("_last")).alias("_n_tail"),
        F.min_by(value, F.struct(*order)).alias("_v_head"),
        F.max_by(value, F.struct(*order)).alias("_v_tail"),
    )
    walk = Window.partitionBy(*keys).orderBy("_chunk")
    chunks = (
        chunks
        .withColumn("_joined", F.coalesce(F.col("_v_head") == F.lag("_v_tail").over(walk), F.lit(False)))
        .withColumn("_new_runs", F.col("_last") + F.when(F.col("_joined"), 0).otherwise(1))
        .withColumn("_tail_id", F.sum("_new_runs").over(walk))
        .withColumn("_head_id", F.col("_tail_id") - F.col("_last"))
    )
    edges = chunks.select(
        *k, "_joined", "_head_id",
        F.explode(F.when(
            F.col("_last") > 0,
            F.array(F.struct(F.lit("head").alias("side"), F.col("_head_id").alias("id"), F.col("_n_head").alias("n")),
                    F.struct(F.lit("tail").alias("side"), F.col("_tail_id").alias("id"), F.col("_n_tail").alias("n"))),
        ).otherwise(
            F.array(F.struct(F.lit("head").alias("side"), F.col("_head_id").alias("id"), F.col("_n_head").alias("n")))
        )).alias("_edge"),
    )
    total = F.sum("_edge.n").over(Window.partitionBy(*keys, "_edge.id"))
    edges = (
        edges.withColumn("_total", total)
        .groupBy(*k, "_joined", "_head_id")
        .agg(F.max(F.when(F.col("_edge.side") == "head", F.col("_total"))).alias("_head_len"),
             F.max(F.when(F.col("_edge.side") == "tail", F.col("_total"))).alias("_tail_len"))
    )
    return (
        pieces.join(edges, k)
        .withColumn("run_id", F.col("_head_id") + F.col("_piece"))
        .withColumn("run_len", F.when(F.col("_piece") == 0, F.col("_head_len"))
                    .when(F.col("_piece") == F.col("_last"), F.col("_tail_len"))
                    .otherwise(F.col("_n")))
        .withColumn("run_start", F.when(F.col("_first"), ~F.col("_joined")).otherwise(F.col("_new") == 1))
        .drop("_chunk", "_new", "_first", "_piece", "_last", "_n", "_joined", "_head_id",
              "_head_len", "_tail_len")
    )


def with_centred_window(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                        window: int, chunk: str = DEFAULT_CHUNK,
                        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``roll_min``, ``roll_max``, ``roll_mean`` over ``window`` rows around each row.

    Null unless the window is full and without nulls. An even window has its odd
    row in the past. Rows go into blocks of equal size by position, with copies of
    the few rows that the neighbouring block needs at its border.
    """
    past, future = window - 1 - (window - 1) // 2, (window - 1) // 2
    block_rows = max(block_rows, window)
    pos = F.col("_pos") - 1
    block = F.floor(pos / block_rows)
    needed = F.array_distinct(F.array(
        block, F.floor(F.greatest(pos - future, F.lit(0)) / block_rows), F.floor((pos + past) / block_rows)))
    blocks = (
        with_row_number(df, keys, order, "_pos", chunk)
        .withColumn("_home", block)
        .withColumn("_block", F.explode(needed))
    )
    around = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(-past, future)
    full = F.count(value).over(around) == window
    return (
        blocks
        .withColumn("roll_min", F.when(full, F.min(value).over(around)))
        .withColumn("roll_max", F.when(full, F.max(value).over(around)))
        .withColumn("roll_mean", F.when(full, F.avg(value).over(around)))
        .where(F.col("_block") == F.col("_home"))
        .drop("_pos", "_home", "_block")
    )


def nearest(probes: DataFrame, samples: DataFrame, keys: Sequence[str], value: str,
            ts: str = "ts", chunk: str | None = None) -> DataFrame:
    """The sample closest in time to each probe; the earlier one on equal distance.

    ``probes`` has ``keys`` and ``ts``; the result adds ``sample_ts`` and ``value``
    (which may be null, as the sample itself may be). Samples are unique by ``ts``.

    Time is cut into stretches of ``chunk``, or so that about one probe falls into
    each. Of a stretch only its first and last sample go on, which a walk over
    stretches carries to those without; samples meet the probes of their own stretch,
    and the nearest on either side are aggregates. Readings are never sorted.
    """
    at = micros(ts)
    probes = sized(probes.select(*keys, at.alias("_p")).distinct(), MAX_PROBES)
    width = duration_us(chunk) if chunk else _probe_spacing(probes, samples, keys, at)
    k = [*keys, "_chunk"]
    timed = samples.where(F.col(ts).isNotNull()).select(*keys, at.alias("_s"), F.col(value).alias("_value"), F.col(ts).alias("_ts"))
    in_chunk = timed.withColumn("_chunk", F.floor(F.col("_s") / width).cast("long"))
    asked = probes.withColumn("_chunk", F.floor(F.col("_p") / width).cast("long"))
    walk = Window.partitionBy(*keys).orderBy("_chunk")
    none = F.lit(None).cast("long")
    edges = (
        in_chunk.groupBy(*k).agg(F.min("_s").alias("_head"), F.max("_s").alias("_tail"))
        .unionByName(asked.select(*k, none.alias("_head"), none.alias("_tail")).distinct())
        .groupBy(*k).agg(F.min("_head").alias("_head"), F.max("_tail").alias("_tail"))
        .select(*k, F.last("_tail", True).over(walk.rowsBetween(Window.unboundedPreceding, -1)).alias("_past"),
                F.first("_head", True).over(walk.rowsBetween(1, Window.unboundedFollowing)).alias("_future"))
    )
    beside = in_chunk.select(*k, "_s").join(asked, k).groupBy(*k, "_p").agg(
        F.max(F.when(F.col("_s") <= F.col("_p"), F.col("_s"))).alias("_behind"), F.min(F.when(F.col("_s") >= F.col("_p"), F.col("_s"))).alias("_ahead"))
    found = asked.join(beside, [*k, "_p"], "left").join(edges, k)
    behind, ahead = F.coalesce("_behind", "_past"), F.coalesce("_ahead", "_future")
    late, early = ahead - F.col("_p"), F.col("_p") - behind
    pick = F.when(behind.isNull(), ahead).when(ahead.isNotNull() & (late < early), ahead).otherwise(behind)
    picked = sized(found.select(*keys, "_p", pick.alias("_s")), MAX_PROBES)
    seen = timed.join(picked.select(*keys, "_s").distinct(), [*keys, "_s"])
    return picked.join(seen, [*keys, "_s"], "left").select(
        *keys, from_micros(F.col("_p")).cast(samples.schema[ts].dataType).alias(ts), F.col("_ts").alias("sample_ts"), F.col("_value").alias(value))


def _probe_spacing(probes: DataFrame, samples: DataFrame, keys: Sequence[str], at: Column) -> int:
    """Microseconds that lie between probes of the series with most of them, not so few that a walk would be long."""
    per_series = probes.groupBy(*keys).agg(((F.max("_p") - F.min("_p")) / F.count(F.lit(1))).alias("_gap"))
    gap = per_series.agg(F.min("_gap")).first()[0] or 0
    ends = samples.select(at.alias("_s")).agg(F.min("_s"), F.max("_s")).first()
    span = (ends[1] - ends[0]) if ends[0] is not None else 0
    return max(int(gap), span // MAX_WALK, 1)


def with_position(df: DataFrame, order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """1-based place of each row in the order of all, which no task sees whole: ranges of the order are numbered by
    themselves, and continue where the ranges before them end."""
    ranges = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    # a row for each range
    walk = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sized(before.select("_range", F.coalesce(F.sum("_n").over(walk), F.lit(0)).alias("_before")))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_inside", inside).join(before, "_range").withColumn(
        name, (F.col("_inside") + F.col("_before")).cast("int")).drop("_range", "_inside", "_before")


def join_known(rows: DataFrame, known: DataFrame, keys: Sequence[str], weight: str, spread: Sequence[str]) -> DataFrame:
    """Left join of ``rows`` with ``known`` (``keys``, unique, and further columns), of which ``weight`` rows each will be met.

    A key of more than a ``HEAVY``-th of all is looked up in every task, of which there are at most ``HEAVY``. The rows of such
    keys, and those with a null key, do not go where the others' keys send them but are dealt out by ``spread``.
    """
    known = cut(known)
    total = known.agg(F.sum(weight)).first()[0] or 0
    others = [c for c in known.columns if c not in (*keys, weight)]
    hot = F.col(weight) * HEAVY > total
    heavy = known.where(hot).select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in others], F.lit(True).alias("_heavy"))
    # 0, but not to the optimizer, which would take a constant out of the join's keys
    light = known.where(~hot).select(*keys, *others, F.pmod(F.col(weight), F.lit(1)).cast("int").alias("_salt"))
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    away = F.coalesce("_heavy", F.lit(False)) | null
    out = rows.join(F.broadcast(heavy), [*keys], "left")
    out = out.withColumn("_salt", F.when(away, 1 + F.pmod(F.xxhash64(*spread), F.lit(1 << 20)).cast("int")).otherwise(0))
    out = out.join(light, [*keys, "_salt"], "left")
    for c in others:
        out = out.withColumn(c, F.coalesce(F.col(f"_hot_{c}"), F.col(c))).drop(f"_hot_{c}")
    return out.drop("_salt", "_heavy")


def _histogram(rows: DataFrame, cuts: DataFrame, level: Sequence[str], bucket: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their bucket between the cuts, and the buckets that hold a wanted place."""
    tagged = rows.join(cuts.select(*level, "_cuts"), [*level]).select(
        *level, F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias(bucket), "_v")
    upto = F.sum("_count").over(Window.partitionBy(*level).orderBy(bucket))
    inside = F.filter("_want", lambda w: (w["place"] >= F.col("_low")) & (w["place"] < F.col("_low") + F.col("_count")))
    targets = (
        tagged.groupBy(*level, bucket).agg(F.count(F.lit(1)).alias("_count"))
        .withColumn("_low", upto - F.col("_count"))
        .join(cuts.select(*level, "n", "_want"), [*level])
        .withColumn("_want", F.transform(inside, lambda w: F.struct(
            w["rank"].alias("rank"), (w["place"] - F.col("_low")).alias("place"))))
        .where(F.size("_want") > 0).select(*level, bucket, "n", "_count", "_want")
    )
    return tagged, sized(targets)


def values_at_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: Sequence[Column],
                    probes: Sequence[float], small_group: int = SMALL_GROUP) -> DataFrame:
    """Exact order statistics per key: ``keys``, ``n`` and ``found`` (rank -> value).

    ``ranks`` are 0-based ascending positions as expressions of ``n`` (the number
    of non-null values). Approximate percentiles only choose where to cut the
    values into buckets; bucket sizes are counted exactly. Buckets that hold a
    wanted rank are cut up again until they are small or cutting no longer helps,
    which means one value repeated; then they are ordered by distinct value.
    ``probes`` are the fractions around which the first cuts are worth having.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    near = (-0.01, -0.001, -0.0002, 0.0, 0.0002, 0.001, 0.01)
    at = sorted({min(1.0, max(0.0, p + d)) for p in probes for d in near})
    want = F.transform(F.array_distinct(F.array(*[r.cast("long") for r in ranks])),
                       lambda r: F.struct(r.alias("rank"), r.alias("place")))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("_v", at, 10_000).alias("_cuts"), F.count("_v").alias("n"))
    cuts = cuts.withColumn("_want", want)
    level, before = list(keys), None
    while True:
        bucket = f"_b{len(level)}"
        rows, targets = _histogram(rows, sized(cuts), level, bucket)
        level.append(bucket)
        largest = targets.agg(F.max("_count")).first()[0] or 0
        if largest <= small_group or (before is not None and largest > before / 2):
            break
        before = largest
        # later rounds read what is left, not the source
        rows = cut(rows.join(targets.select(*level), level, "left_semi"))
        cuts = rows.groupBy(*level).agg(F.percentile_approx("_v", [i / 256 for i in range(257)], 10_000).alias("_cuts"))
        cuts = cuts.join(targets.select(*level, "n", "_want"), level)
    inside = Window.partitionBy(*level).orderBy("_v")
    upto = F.col("_upto")
    hits = (
        rows.join(targets.select(*level), level, "left_semi")
        .groupBy(*level, "_v").agg(F.count(F.lit(1)).alias("_count"))
        .withColumn("_upto", F.sum("_count").over(inside))
        .join(targets.select(*level, "n", "_want"), level)
        .withColumn("_hit", F.explode(F.filter(
            "_want", lambda w: (w["place"] >= upto - F.col("_count")) & (w["place"] < upto))))
    )
    # at most one entry per wanted rank
    return hits.groupBy(*keys, "n").agg(
        F.map_from_entries(F.collect_list(F.struct("_hit.rank", "_v"))).alias("found"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float],
                    name: str = "quantiles", small_group: int = SMALL_GROUP) -> DataFrame:
    """Linear-interpolated quantiles per key as an array in the order of ``qs``.

    Groups are counted first. If the largest fits in a task's memory, the built-in
    aggregate does it in one pass, otherwise the values are cut up and ordered in parts.
    """
    data = df.where(F.col(value).isNotNull())
    sizes = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if largest <= small_group:
        return data.groupBy(*keys).agg(F.percentile(value, [float(q) for q in qs]).alias(name))

    def spot(q):
        return F.lit(q) * (F.col("n") - 1)

    ranks = [r for q in qs for r in (F.floor(spot(q)), F.ceil(spot(q)))]
    found = values_at_ranks(data, keys, value, ranks, qs, small_group)

    def at(q):
        lo, hi = (F.element_at("found", r(spot(q)).cast("long")) for r in (F.floor, F.ceil))
        return lo + (hi - lo) * (spot(q) - F.floor(spot(q)))

    return found.select(*keys, F.array(*[at(q) for q in qs]).alias(name))
