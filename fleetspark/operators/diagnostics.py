"""Why a unit under-performs: DC side or inverter, and what its outages cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fleetspark.functions.timefn import HOUR_US
from fleetspark.operators.align import modal_interval, row_interval
from fleetspark.operators.ordered import (
    DEFAULT_CHUNK,
    exact_quantiles,
    with_centred_window,
    with_row_number,
)
from fleetspark.params import (
    DAYLIGHT_MIN,
    EFFICIENCY_MIN_DC,
    ENERGY_WORD,
    FINDING_AC,
    FINDING_DC,
    FINDING_EFFICIENCY,
    FINDING_LOST,
    FINDING_MORE,
    FINDING_NONE,
    FINDING_VERDICT,
    ROLE_HINTS,
    VERDICT_AC_PCT,
    VERDICT_BOTH,
    VERDICT_DC,
    VERDICT_DC_PCT,
    VERDICT_EFFICIENCY_PT,
    VERDICT_INVERTER,
    VERDICT_OK,
    VERDICT_UNEXPLAINED,
    AnalysisParams,
)
from fleetspark.session import cut

FILE_UNIT = ("file", "entity")


def _fleet() -> WindowSpec:
    """A window over a fleet table, which has one row per unit."""
    return Window.partitionBy(F.lit(1))


def guess_roles(channels: DataFrame, explicit: dict[str, str] | None = None,
                keys: Sequence[str] = ()) -> DataFrame:
    """Which channel is AC power, DC power, irradiance, ...: ``keys``, role, metric.

    A role named in ``explicit`` is taken if the channel exists. The others go, in
    a fixed order, to the free numeric channel whose name and raw header contain
    most of the role's hints. ``channels``: pos, metric, name, raw, is_numeric.
    """
    explicit = explicit or {}
    label = F.lower(F.concat_ws(" ", "name", "raw"))
    energy = F.concat("name", "raw").contains(ENERGY_WORD)

    def score(role):
        hits = sum((label.contains(h.lower()).cast("int") for h in ROLE_HINTS[role]), F.lit(0))
        if role == "ac_power":
            hits = F.when(energy, 0).otherwise(hits)
        if role == "ac_energy":
            hits = F.when(energy, hits).otherwise(0)
        return F.when(F.col("is_numeric"), hits).otherwise(0)

    scored = channels.select(
        *keys, "metric", F.struct(
            F.col("pos").alias("pos"), F.col("metric").alias("metric"),
            *[score(role).alias(role) for role in ROLE_HINTS]).alias("_c"))
    # the channels of one site: as many as a file has columns
    site = scored.groupBy(*keys).agg(F.collect_list("_c").alias("_all"))
    named = {}
    for role, metric in explicit.items():
        if metric:
            exists = F.exists("_all", lambda c: c["metric"] == metric)  # noqa: B023
            named[role] = F.when(exists, F.lit(metric))
    for role in ROLE_HINTS:
        if role not in named:
            named[role] = F.lit(None).cast("string")
        site = site.withColumn(f"_is_{role}", named[role])
    for role in ROLE_HINTS:
        taken = F.array(*[F.col(f"_is_{r}") for r in ROLE_HINTS])
        free = F.filter("_all", lambda c: (c[role] > 0) & ~F.coalesce(  # noqa: B023
            F.array_contains(F.array_compact(taken), c["metric"]), F.lit(False)))  # noqa: B023
        best = F.array_max(F.transform(free, lambda c: F.struct(
            c[role].alias("score"), (-c["pos"]).alias("pos"), c["metric"].alias("metric"))))["metric"]
        site = site.withColumn(f"_is_{role}", F.coalesce(F.col(f"_is_{role}"), best))
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"_is_{r}").alias("metric")) for r in ROLE_HINTS])
    return (
        site.withColumn("_role", F.explode(roles))
        .select(*keys, "_role.role", "_role.metric").where(F.col("metric").isNotNull())
    )


def role_rows(readings: DataFrame, roles: dict[str, str], keys: Sequence[str] = FILE_UNIT) -> DataFrame:
    """The role channels of a row side by side: ``ac``, ``dc``, ``irr`` and whether ``irr`` exists."""
    wanted = {k: roles.get(r) for k, r in (("ac", "ac_power"), ("dc", "dc_power"), ("irr", "irradiance"))}
    order = [c for c in ("ts", "row_no") if c in readings.columns]
    metrics = [m for m in wanted.values() if m]

    def pick(m):
        if not m:
            return F.lit(None).cast("double")
        return F.max(F.when(F.col("metric") == m, F.col("value")))

    seen = {k: F.count_if(F.col("metric") == m) > 0 if m else F.lit(False) for k, m in wanted.items()}
    return (
        readings.where(F.col("metric").isin(*metrics))
        .groupBy(*keys, *order)
        .agg(*[pick(m).alias(k) for k, m in wanted.items()],
             seen["ac"].alias("has_ac"), seen["irr"].alias("has_irr"))
    )


def stable_mask(rows: DataFrame, min_value: float, tolerance_pct: float, window: int,
                value: str = "irr", keys: Sequence[str] = FILE_UNIT,
                order: Sequence[str] = ("ts", "row_no"), name: str = "stable",
                chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Marks rows with enough and steady light over the centred window."""
    bright = F.col(value) >= min_value
    if not window or window <= 1 or tolerance_pct <= 0:
        return rows.withColumn(name, F.coalesce(bright, F.lit(False)))
    rolled = with_centred_window(rows, keys, order, value, window, chunk)
    spread = F.try_divide(F.col("roll_max") - F.col("roll_min"), F.abs("roll_mean")) * 100.0
    return (
        rolled.withColumn(name, F.coalesce(bright & (spread <= tolerance_pct), F.lit(False)))
        .drop("roll_min", "roll_max", "roll_mean")
    )


def _capacity(params: AnalysisParams) -> Column:
    cap = F.lit(float(params.capacity_kw))
    for unit, kw in params.capacity_by_unit.items():
        cap = F.when(F.col("entity") == unit, F.lit(float(kw or 0.0))).otherwise(cap)
    return cap


def unit_table(readings: DataFrame, roles: dict[str, str], params: AnalysisParams,
               chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Per unit: energy, DC and AC per irradiance, efficiency, performance ratio, all against the fleet.

    Figures are made per file and unit; over files energies and counts are summed,
    the rest is averaged.
    """
    rows = role_rows(readings, roles).where("has_ac")
    order = [c for c in ("ts", "row_no") if c in rows.columns]
    light = F.coalesce(F.col("irr") > DAYLIGHT_MIN, F.lit(False))
    daylight = F.when(F.col("has_irr"), light).otherwise(F.col("ac").isNotNull())
    rows = rows.withColumn("daylight", daylight)
    if params.stable_only and roles.get("irradiance"):
        rows = stable_mask(rows, params.stable_min_irradiance, params.stable_tolerance_pct,
                           params.stable_window, order=order, chunk=chunk)
        rows = rows.withColumn("good", F.when(F.col("has_irr"), F.col("stable")).otherwise(F.col("daylight")))
    else:
        rows = rows.withColumn("good", F.col("daylight"))
    # the role channels are a small part of the readings, and four aggregates follow
    rows = cut(rows.select(*FILE_UNIT, *order, "ac", "dc", "irr", "daylight", "good"))

    def lit_sum(c):
        return F.coalesce(F.sum(F.when(F.col("daylight"), F.col(c))), F.lit(0.0))

    per_file = rows.groupBy(*FILE_UNIT).agg(
        lit_sum("ac").alias("_ac"), lit_sum("dc").alias("_dc"), lit_sum("irr").alias("_irr"),
        F.count_if("good").alias("samples_used"), F.count_if("daylight").alias("daylight_samples"))
    # the three ratios become rows, so that one pass finds all their medians
    shone = F.col("good") & (F.col("irr") > 0)
    ratios = rows.select(*FILE_UNIT, F.explode(F.array(
        F.struct(F.lit("eff").alias("what"), F.when(
            F.col("good") & (F.col("dc") > EFFICIENCY_MIN_DC), F.col("ac") / F.col("dc")).alias("x")),
        F.struct(F.lit("dcg").alias("what"), F.when(shone, F.try_divide("dc", "irr")).alias("x")),
        F.struct(F.lit("acg").alias("what"), F.when(shone, F.try_divide("ac", "irr")).alias("x")),
    )).alias("_r")).select(*FILE_UNIT, "_r.what", "_r.x")
    medians = exact_quantiles(ratios, [*FILE_UNIT, "what"], "x", [0.5], "_q").groupBy(*FILE_UNIT).agg(*[
        F.max(F.when(F.col("what") == w, F.col("_q")[0])).alias(w) for w in ("eff", "dcg", "acg")])
    hours = row_interval(rows, FILE_UNIT, chunk).select(
        *FILE_UNIT, (F.col("interval_us") / float(HOUR_US)).alias("_hours"))

    cap = _capacity(params)
    irradiation = F.col("_irr") * F.col("_hours")
    rated = (cap > 0) & (irradiation > 0)
    ac_kwh = F.col("_ac") * F.col("_hours")
    per_file = (
        per_file.join(medians, [*FILE_UNIT], "left").join(hours, [*FILE_UNIT], "left")
        .withColumn("pr", F.when(rated, F.round(F.try_divide(ac_kwh, irradiation * cap), 4)))
        .withColumn("capacity_kw", F.when(rated, cap))
    )
    units = per_file.groupBy("entity").agg(
        F.coalesce(F.sum(F.col("_ac") * F.col("_hours")), F.lit(0.0)).alias("ac_kwh"),
        F.sum("samples_used").alias("samples_used"),
        F.sum("daylight_samples").alias("daylight_samples"),
        F.coalesce(F.sum(F.col("_dc") * F.col("_hours")), F.lit(0.0)).alias("dc_kwh"),
        (F.avg("eff") * 100.0).alias("efficiency_pct"),
        F.avg("dcg").alias("dc_per_irradiance"),
        F.avg("acg").alias("ac_per_irradiance"),
        F.avg("pr").alias("pr"), F.avg("capacity_kw").alias("capacity_kw"))
    return against_fleet(units)


def _signed_round(c: Column, digits: int) -> Column:
    """Rounded half up; what rounds to zero keeps its sign, so that a sentence tells a little below from a little above."""
    out = F.round(c, digits)
    return F.when(c == 0, c).when((out == 0) & (c < 0), F.lit(-0.0)).otherwise(out)


def against_fleet(units: DataFrame) -> DataFrame:
    """Every unit against the fleet median: in percent, the efficiency in points."""
    for source, out in (("ac_kwh", "ac_vs_fleet_pct"), ("dc_per_irradiance", "dc_vs_fleet_pct"),
                        ("ac_per_irradiance", "ac_per_irr_vs_fleet_pct")):
        mid = F.median(source).over(_fleet())
        units = units.withColumn(out, _signed_round(F.try_divide(F.col(source) - mid, mid) * 100.0, 2))
    mid = F.median("efficiency_pct").over(_fleet())
    return units.withColumn("efficiency_vs_fleet_pt", _signed_round(F.col("efficiency_pct") - mid, 2))


def verdict() -> Column:
    """Where the shortfall is. A unit at the fleet's level is no fault, whatever its insides say."""
    ac, dc, eff = (F.col(c) for c in ("ac_vs_fleet_pct", "dc_vs_fleet_pct", "efficiency_vs_fleet_pt"))
    dc_bad = F.coalesce(dc <= -VERDICT_DC_PCT, F.lit(False))
    eff_bad = F.coalesce(eff <= -VERDICT_EFFICIENCY_PT, F.lit(False))
    return (
        F.when(ac.isNull() | (ac > -VERDICT_AC_PCT), VERDICT_OK)
        .when(dc_bad & eff_bad, VERDICT_BOTH)
        .when(dc_bad, VERDICT_DC)
        .when(eff_bad, VERDICT_INVERTER)
        .when(ac <= -VERDICT_DC_PCT, VERDICT_UNEXPLAINED)
        .otherwise(VERDICT_OK)
    )


def attribution(units: DataFrame) -> DataFrame:
    """Adds the verdict and ``rank``, the worst AC shortfall first."""
    place = F.row_number().over(_fleet().orderBy(F.col("ac_vs_fleet_pct").asc_nulls_last(), "entity"))
    return units.withColumn("verdict", verdict()).withColumn("rank", place)


def attribution_headline(attr: DataFrame) -> DataFrame:
    return attr.select("rank", "entity", "ac_kwh", "ac_vs_fleet_pct", "dc_vs_fleet_pct", "efficiency_pct",
                       "efficiency_vs_fleet_pt", "samples_used", "verdict")


def efficiency(units: DataFrame) -> DataFrame:
    return units.select("entity", "efficiency_pct", "efficiency_vs_fleet_pt", "samples_used")


def performance(units: DataFrame) -> DataFrame:
    """Performance ratios; ``note`` where one exceeds 1, which means a wrong capacity."""
    top = F.max("pr").over(_fleet())
    note = F.when(top > 1.0, F.concat(
        F.lit("PR reaches "), F.format_string("%.2f", top),
        F.lit(" - above 1 is not physically possible; enter the DC nameplate capacity")))
    return units.where(F.col("pr").isNotNull()).select("entity", "capacity_kw", "ac_kwh", "pr", note.alias("note"))


def availability(readings: DataFrame, roles: dict[str, str], params: AnalysisParams,
                 chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Instants with usable light but no output per unit, priced at the fleet's median power.

    An instant where a unit has no row counts against it. That needs no grid of
    instants and units: what a unit lacks is what the fleet has less what it has.
    """
    order = F.struct(*[c for c in ("file", "row_no") if c in readings.columns])
    rows = (
        role_rows(readings, roles, FILE_UNIT).where(F.col("has_ac") & F.col("has_irr"))
        .groupBy("entity", "ts")
        .agg(F.min_by(F.struct("ac", "irr"), order).alias("_r")).select("entity", "ts", "_r.ac", "_r.irr")
    )
    rows = cut(rows)
    instant = Window.partitionBy("ts")
    judged = rows.select(
        "entity", "ac",
        (F.avg("irr").over(instant) >= params.stable_min_irradiance).alias("usable"),
        F.median("ac").over(instant).alias("ref"),
        # one row per instant stands for the instant
        (F.row_number().over(instant.orderBy("entity")) == 1).alias("once"))
    usable, on = F.col("usable"), F.col("usable") & (F.col("ac") > 0)

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0.0))

    units = judged.groupBy("entity").agg(
        F.count_if(usable & F.col("once")).alias("_instants"),
        total(F.when(usable & F.col("once"), F.col("ref"))).alias("_ref"),
        F.count_if(on).alias("_on"), total(F.when(on, F.col("ref"))).alias("_ref_on"),
        F.count_if(usable & F.col("ac").isNotNull()).alias("_seen"))
    hours = modal_interval(rows.select("entity", "ts"), ["entity"], ["ts"], chunk).select(
        "entity", (F.col("interval_us") / float(HOUR_US)).alias("_hours"))
    instants = F.sum("_instants").over(_fleet())
    lost = (F.sum("_ref").over(_fleet()) - F.col("_ref_on")) * F.coalesce("_hours", F.lit(0.0))
    return (
        units.join(hours, "entity", "left")
        .select(
            "entity", instants.alias("usable_samples"),
            (instants - F.col("_on")).alias("zero_output"),
            (instants - F.col("_seen")).alias("missing"),
            F.round(100.0 * F.col("_on") / F.greatest(instants, F.lit(1)) + F.when(instants == 0, 100.0).otherwise(0.0), 2)
            .alias("availability_pct"),
            F.round(lost, 1).alias("lost_kwh"))
        .withColumn("rank", F.row_number().over(_fleet().orderBy(F.desc("lost_kwh"), "entity")))
    )


def scatter_points(readings: DataFrame, roles: dict[str, str], max_points: int = 900,
                   chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Power against irradiance, evenly thinned per file and unit."""
    rows = role_rows(readings, roles)
    order = [c for c in ("ts", "row_no") if c in rows.columns]
    lit = rows.where((F.col("irr") > DAYLIGHT_MIN) & F.col("ac").isNotNull())
    count = lit.groupBy(*FILE_UNIT).agg(F.count(F.lit(1)).alias("_total"))
    step = F.greatest(F.lit(1), F.ceil(F.col("_total") / max_points))
    return (
        with_row_number(lit, FILE_UNIT, order, "_pos", chunk).join(count, [*FILE_UNIT])
        .where(F.pmod(F.col("_pos") - 1, step) == 0)
        .select(*FILE_UNIT, "ts", F.round("irr", 4).alias("x"), F.round("ac", 3).alias("y"))
    )


def findings(attr: DataFrame, avail: DataFrame | None = None, most: int = 6, none: str | None = FINDING_NONE) -> DataFrame:
    """A few sentences, one per row: the worst units, how many more, the costliest outage. ``none`` is said of a fleet without
    a bad unit, if not null."""
    bad = attr.where(F.col("verdict") != VERDICT_OK)
    place = F.row_number().over(_fleet().orderBy(F.col("ac_vs_fleet_pct"), "entity"))
    ranked = bad.withColumn("_place", place)

    def part(c, form, digits):
        return F.when(F.col(c).isNotNull(), F.format_string(form, _signed_round(F.col(c), digits))).otherwise("")

    worst = ranked.where(F.col("_place") <= most).select(
        F.col("_place").cast("long").alias("pos"),
        F.concat(
            F.format_string(FINDING_AC, "entity", F.round("ac_vs_fleet_pct", 1)),
            part("dc_vs_fleet_pct", FINDING_DC, 1), part("efficiency_vs_fleet_pt", FINDING_EFFICIENCY, 2),
            F.format_string(FINDING_VERDICT, F.split("verdict", " / ")[0])).alias("finding"))
    counts = attr.groupBy().agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") != VERDICT_OK).alias("bad"))
    rest = counts.select(
        F.lit(1000).cast("long").alias("pos"),
        F.when((F.col("bad") == 0) & (F.col("n") > 0), F.lit(none).cast("string"))
        .when(F.col("bad") > most, F.format_string(FINDING_MORE, F.col("bad") - most))
        .alias("finding")).where(F.col("finding").isNotNull())
    out = worst.unionByName(rest)
    if avail is not None:
        lost = avail.where((F.col("rank") == 1) & (F.col("lost_kwh") > 0)).select(
            F.lit(2000).cast("long").alias("pos"),
            F.format_string(FINDING_LOST, "entity", "zero_output", F.round("lost_kwh", 0)).alias("finding"))
        out = out.unionByName(lost)
    return out
