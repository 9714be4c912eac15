"""Declarative rules as predicates on readings, and the flags they raise.

A rule is judged within one file's channel, the series (file, entity, metric).
Rules on single values are plain expressions. The others first get a helper
column: a statistic of the series, its neighbour, its run, or its cutoff.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.operators.ordered import (
    DEFAULT_CHUNK,
    exact_quantiles,
    join_known,
    sized,
    values_at_ranks,
    with_previous,
    with_runs,
)
from fleetspark.params import GRADIENT_KINDS, Rule

SERIES = ("file", "entity", "metric")
ORDER = ("ts", "row_no")
TOP_N_DIRECT = 1000

_COMPARE = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}


def in_scope(rule: Rule, names: Sequence[str] = ("metric",), is_numeric: Column | None = None) -> Column:
    """Whether the rule applies to a channel known under any of the ``names`` columns."""
    numeric = F.col("is_numeric") if is_numeric is None else is_numeric
    if not rule.enabled:
        return F.lit(False)
    if rule.scope == "all":
        return F.lit(True)
    if rule.scope == "numeric":
        return numeric
    if rule.scope == "text":
        return ~numeric
    if rule.scope == "selected":
        hits = [F.col(n).isin(*rule.columns) for n in names] if rule.columns else []
    else:
        try:
            re.compile(rule.pattern)
        except re.error:
            return F.lit(False)
        hits = [F.col(n).rlike(rule.pattern) for n in names] if rule.pattern else []
    out = F.lit(False)
    for hit in hits:
        out = out | F.coalesce(hit, F.lit(False))
    return out


def value_predicate(rule: Rule, value: str = "value", text: str = "text",
                    is_numeric: Column | None = None) -> Column:
    """The rules that look at one cell only. Null counts as no hit."""
    v, t = F.col(value), F.col(text) if text else F.lit(None).cast("string")
    numeric = F.lit(True) if is_numeric is None else is_numeric
    if rule.kind == "blank":
        return F.when(numeric, v.isNull()).otherwise(t.isNull() | (F.trim(t) == ""))
    if rule.kind == "text_contains":
        if not rule.text:
            return F.lit(False)
        shown = F.lower(F.coalesce(t, v.cast("string"), F.lit("")))
        return shown.contains(rule.text.lower())
    if rule.kind == "zero":
        hit = F.abs(v) <= abs(rule.tolerance)
    elif rule.kind == "negative":
        hit = v < 0
    elif rule.kind == "threshold":
        hit = _COMPARE.get(rule.operator, _COMPARE["<"])(v, F.lit(float(rule.value)))
    elif rule.kind == "between":
        lo, hi = sorted((float(rule.value), float(rule.value2)))
        hit = v.between(lo, hi)
    else:
        raise ValueError(f"{rule.kind} does not look at single values")
    return F.coalesce(numeric & hit, F.lit(False))


def with_sigma_hit(df: DataFrame, rule: Rule, name: str, keys: Sequence[str] = SERIES,
                   value: str = "value") -> DataFrame:
    k = float(rule.value2 or 3.0)
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    hit = (F.col("_std") > 0) & (F.abs(F.col(value) - F.col("_mean")) > k * F.col("_std"))
    return (
        df.join(stats, [*keys], "left")
        .withColumn(name, F.coalesce(hit, F.lit(False))).drop("_mean", "_std")
    )


def cutoffs(df: DataFrame, rule: Rule, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """The value that the k-th largest (smallest) reading of each series has."""
    if not rule.percent and max(1, int(rule.rank)) <= TOP_N_DIRECT:
        k = max(1, int(rule.rank))
        # row_number() <= k keeps at most k rows per series in each task before the shuffle
        by = F.col("_v").asc() if rule.bottom else F.col("_v").desc()
        top = (
            df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
            .withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(by)))
            .where(F.col("_rank") <= k)
        )
        edge = F.max("_v") if rule.bottom else F.min("_v")
        return top.groupBy(*keys).agg(edge.alias("_cutoff"))
    if rule.percent:
        share = min(1.0, max(0.0, rule.rank / 100.0))
        k = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(float(rule.rank)) / 100.0).cast("long"))
        probes = [share if rule.bottom else 1.0 - share]
    else:
        k = F.lit(int(rule.rank))
        probes = [0.0, 0.1, 0.5] if rule.bottom else [0.5, 0.9, 1.0]
    k = F.least(k, F.col("n"))
    rank = k - 1 if rule.bottom else F.col("n") - k
    found = values_at_ranks(df, keys, value, [rank], probes)
    return found.select(*keys, F.map_values("found")[0].alias("_cutoff"))


def with_top_hit(df: DataFrame, rule: Rule, name: str, keys: Sequence[str] = SERIES,
                 value: str = "value") -> DataFrame:
    """Ties at the cutoff are hits too."""
    # of known size, so that readings are not sent to the few series that they belong to
    edge = sized(cutoffs(df, rule, keys, value))
    hit = F.col(value) <= F.col("_cutoff") if rule.bottom else F.col(value) >= F.col("_cutoff")
    return (
        df.join(edge, [*keys], "left")
        .withColumn(name, F.coalesce(hit, F.lit(False))).drop("_cutoff")
    )


def with_stuck_hit(df: DataFrame, rule: Rule, name: str, keys: Sequence[str] = SERIES,
                   order: Sequence[str] = ORDER, value: str = "value",
                   chunk: str = DEFAULT_CHUNK) -> DataFrame:
    n = max(2, int(rule.value2 or 10))
    runs = with_runs(df, keys, order, value, chunk)
    hit = F.col(value).isNotNull() & (F.col("run_len") >= n)
    return runs.withColumn(name, hit).drop("run_id", "run_len", "run_start")


def with_jump_hit(df: DataFrame, rule: Rule, name: str, keys: Sequence[str] = SERIES,
                  order: Sequence[str] = ORDER, value: str = "value",
                  chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Against the row before, whatever it holds: a null between hides a jump."""
    limit = abs(float(rule.value2 or rule.value or 0.0))
    if limit == 0:
        return df.withColumn(name, F.lit(False))
    stepped = with_previous(df, keys, order, [value], "_prev", chunk)
    hit = F.abs(F.col(value) - F.col(f"_prev.{value}")) > limit
    return stepped.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_prev")


def with_duplicate_hit(df: DataFrame, name: str, keys: Sequence[str] = SERIES,
                       shown: Column | None = None, value: str = "value") -> DataFrame:
    """Values that occur more than once in their series; counted before they are joined back."""
    content = F.col(value) if shown is None else shown
    rows = df.withColumn("_content", content)
    repeated = (
        rows.where(F.col("_content").isNotNull())
        .groupBy(*keys, "_content").agg(F.count(F.lit(1)).alias("_times"))
        .where(F.col("_times") > 1)
        .withColumn(name, F.lit(True))
    )
    # half of a series may be zeros, and nulls equal nothing: neither goes to one task
    spread = [c for c in ORDER if c in df.columns] or df.columns
    return (
        join_known(rows, repeated, [*keys, "_content"], "_times", spread)
        .withColumn(name, F.coalesce(name, F.lit(False))).drop("_content")
    )


def with_hits(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str] = SERIES,
              order: Sequence[str] = ORDER, chunk: str = DEFAULT_CHUNK) -> tuple[DataFrame, list[Column]]:
    """Adds what the rules need; returns it with one boolean expression per rule.

    ``df`` has value, text and is_numeric. Rules with equal needs share the work.
    """
    numeric = F.col("is_numeric")
    hits, done = [], {}
    for rule in rules:
        if rule.kind in GRADIENT_KINDS:
            hits.append(F.lit(False))
            continue
        if rule.kind in ("zero", "negative", "threshold", "between", "blank", "text_contains"):
            hits.append(value_predicate(rule, is_numeric=numeric))
            continue
        need = {
            "outlier_sigma": (rule.kind, rule.value2),
            "top_bottom": (rule.kind, rule.rank, rule.percent, rule.bottom),
            "stuck": (rule.kind, rule.value2),
            "jump": (rule.kind, rule.value, rule.value2),
            "duplicate": (rule.kind,),
        }[rule.kind]
        if need not in done:
            name = f"_hit{len(done)}"
            done[need] = name
            if rule.kind == "outlier_sigma":
                df = with_sigma_hit(df, rule, name, keys)
            elif rule.kind == "top_bottom":
                df = with_top_hit(df, rule, name, keys)
            elif rule.kind == "stuck":
                df = with_stuck_hit(df, rule, name, keys, order, chunk=chunk)
            elif rule.kind == "jump":
                df = with_jump_hit(df, rule, name, keys, order, chunk=chunk)
            else:
                shown = F.when(numeric, F.col("value").cast("string")).otherwise(F.col("text"))
                df = with_duplicate_hit(df, name, keys, shown)
        hit = F.col(done[need])
        hits.append(hit if rule.kind == "duplicate" else hit & numeric)
    return df, hits


def collect_flags(readings: DataFrame, channels: DataFrame | None, rules: Sequence[Rule],
                  exclude: Sequence[str] = (), cap: int | None = None,
                  order: Sequence[str] = ORDER, chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Every hit of the active rules as a row: file, ts, row_no, entity, name, label, rule, value, text.

    ``channels`` gives name, is_numeric and include; hidden channels raise nothing.
    Nothing is cut unless ``cap`` (hits per file) is given.
    """
    active = [r for r in rules if r.enabled and r.kind not in GRADIENT_KINDS and r.kind not in exclude]
    rows = readings
    if "text" not in rows.columns:
        rows = rows.withColumn("text", F.lit(None).cast("string"))
    if channels is not None:
        rows = rows.join(channels.select("metric", "name", "is_numeric", "include"), "metric", "left")
        rows = rows.where(F.coalesce("include", F.lit(True))).drop("include")
    else:
        rows = rows.withColumn("name", F.col("metric")).withColumn("is_numeric", F.lit(True))
    rows = rows.withColumn("is_numeric", F.coalesce("is_numeric", F.lit(True)))
    rows, hits = with_hits(rows, active, SERIES, order, chunk)
    raised = [
        F.when(in_scope(r) & h, F.struct(F.lit(i).alias("no"), F.lit(r.name).alias("label"), F.lit(r.kind).alias("rule")))
        for i, (r, h) in enumerate(zip(active, hits))
    ]
    if not raised:
        raised = [F.lit(None).cast("struct<no:int,label:string,rule:string>")]
    flags = rows.withColumn("_flag", F.explode(F.array_compact(F.array(*raised)))).select(
        "file", *order, "entity", "metric",
        F.coalesce(F.nullif("name", F.lit("")), "metric").alias("name"),
        F.col("_flag.no").alias("_no"), F.col("_flag.label").alias("label"), F.col("_flag.rule").alias("rule"),
        "value", "text")
    if cap is not None:
        place = F.row_number().over(Window.partitionBy("file").orderBy("metric", "_no", *order))
        flags = flags.withColumn("_place", place).where(F.col("_place") <= cap).drop("_place")
    return flags.drop("_no")


# --- scales ---------------------------------------------------------------- #
N_STOPS = {"2color": 2, "3color": 3, "5color": 5}


def scale_stops(readings: DataFrame, rule: Rule, keys: Sequence[str] = ("metric",),
                value: str = "value") -> DataFrame:
    """Boundaries of a colour scale per key, low to high, as array ``stops``."""
    n = N_STOPS.get(rule.scale_mode, 3)
    if rule.scale_bounds == "numbers" and rule.scale_values:
        fixed = sorted(float(x) for x in rule.scale_values)
        fixed = fixed[:n] if len(fixed) >= n else fixed
        return readings.select(*keys).distinct().withColumn("stops", F.array(*[F.lit(x) for x in fixed]))
    if rule.scale_bounds == "percent":
        qs = [0.05 + 0.9 * i / (n - 1) for i in range(n)]
        found = exact_quantiles(readings, keys, value, qs, "stops")
        every = readings.select(*keys).distinct()
        unit = F.array(*[F.lit(i / (n - 1)) for i in range(n)])
        return every.join(found, [*keys], "left").withColumn("stops", F.coalesce("stops", unit))
    lo, hi = F.min(value), F.max(value)
    ends = readings.groupBy(*keys).agg(lo.alias("_lo"), hi.alias("_hi"))
    lo, hi = F.coalesce("_lo", F.lit(0.0)), F.coalesce("_hi", F.lit(1.0))
    hi = F.when(hi == lo, lo + 1.0).otherwise(hi)
    stops = F.array(*[lo + (hi - lo) * (i / (n - 1)) for i in range(n)])
    return ends.select(*keys, stops.alias("stops"))


def scale_position(value: Column, stops: Column) -> Column:
    """Place of a value between the stops, 0..1, each step an equal share."""
    last = F.size(stops) - 1
    below = F.size(F.filter(stops, lambda s: s < value))
    lo, hi = F.get(stops, below - 1), F.get(stops, below)
    inside = (below - 1 + (value - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo)) / last
    return (
        F.when(value.isNull(), None)
        .when(value <= F.get(stops, F.lit(0)), 0.0)
        .when(value >= F.get(stops, last), 1.0)
        .otherwise(inside)
    )


def band_index(value: Column, stops: Column, bands: int) -> Column:
    """Which band a value falls in: the last stop it reaches, at most ``bands - 1``."""
    reached = F.size(F.filter(stops, lambda s: s <= value)) - 1
    return F.when(value.isNull(), None).otherwise(F.least(F.greatest(reached, F.lit(0)), F.lit(bands - 1)))


def excel_band(value: Column, stops: Column) -> Column:
    """Five bands by the four upper stops; a value on an edge between two bands is in the lower."""
    edges = [F.get(stops, F.lit(i)) for i in range(1, 5)]
    out = F.when(value.isNull(), None).when(value < edges[0], 0)
    for i in range(1, 4):
        out = out.when(value <= edges[i], i)
    return out.otherwise(4)


def with_scale(readings: DataFrame, rule: Rule, keys: Sequence[str] = ("metric",),
               value: str = "value") -> DataFrame:
    """Adds ``position`` (0..1) and ``band`` of each value in its channel's scale."""
    n = N_STOPS.get(rule.scale_mode, 3)
    stops = scale_stops(readings, rule, keys, value)
    return (
        readings.join(stops, [*keys], "left")
        .withColumn("position", scale_position(F.col(value), F.col("stops")))
        .withColumn("band", band_index(F.col(value), F.col("stops"), n))
        .drop("stops")
    )


def with_data_bar(readings: DataFrame, keys: Sequence[str] = ("metric",), value: str = "value") -> DataFrame:
    """Adds ``bar``, the fraction of the channel's range (0 for a constant channel)."""
    ends = readings.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    bar = F.when(width > 0, (F.col(value) - F.col("_lo")) / width).when(F.col(value).isNotNull(), 0.0)
    return readings.join(ends, [*keys], "left").withColumn("bar", bar).drop("_lo", "_hi")


def with_local_scale(readings: DataFrame, keys: Sequence[str] = ("metric",), value: str = "value",
                     diverging: bool = False) -> DataFrame:
    """Adds ``position``: around zero by the largest size, or from minimum to maximum."""
    ends = readings.groupBy(*keys).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.max(F.abs(value)).alias("_size"))
    v = F.col(value)
    if diverging:
        size = F.when(F.col("_size") > 0, F.col("_size")).otherwise(1.0)
        spot = 0.5 + 0.5 * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v / size))
    else:
        width = F.col("_hi") - F.col("_lo")
        spot = F.when(width > 0, (v - F.col("_lo")) / width).otherwise(0.5)
    return (
        readings.join(ends, [*keys], "left")
        .withColumn("position", F.when(v.isNotNull(), spot)).drop("_lo", "_hi", "_size")
    )
