"""Queries on rules, flags and scales."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.operators import rules
from fleetspark.operators.align import aligned, deviation
from fleetspark.operators.ordered import fit_chunk
from fleetspark.params import Rule
from fleetspark.plans.fleet_queries import DEV_SQL
from fleetspark.plans.registry import query
from fleetspark.plans.views import (
    CHANNELS_SQL,
    EV_SQL,
    channels,
    raw_events,
    readings,
    readings_sql,
    shown,
    table,
)

RD = readings_sql()
TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
LINE = ["l_orderkey", "l_linenumber", "l_partkey"]


def hits(df, rule, value):
    return df.where(rules.value_predicate(rule, value, text=None))


@query("rule_zero", "SELECT l_orderkey, l_linenumber, l_partkey, l_discount FROM lineitem WHERE abs(l_discount) <= 0.005")
def rule_zero(spark, sf):
    rule = Rule("zero", tolerance=-0.005)
    return hits(table(spark, sf, "lineitem"), rule, "l_discount").select(*LINE, "l_discount")


@query("rule_negative", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def rule_negative(spark, sf):
    return hits(table(spark, sf, "customer"), Rule("negative"), "c_acctbal").select("c_custkey", "c_acctbal")


@query("rule_threshold", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 45")
def rule_threshold(spark, sf):
    rule = Rule("threshold", operator=">=", value=45)
    return hits(table(spark, sf, "lineitem"), rule, "l_quantity").select(*LINE, "l_quantity")


@query("rule_between", """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
  WHERE l_extendedprice BETWEEN 20000 AND 21000""")
def rule_between(spark, sf):
    rule = Rule("between", value=21000, value2=20000)
    return hits(table(spark, sf, "lineitem"), rule, "l_extendedprice").select(*LINE, "l_extendedprice")


@query("rule_blank", """SELECT o_orderkey, o_orderstatus FROM orders
  WHERE nullif(o_orderpriority, '4-NOT SPECIFIED') IS NULL""")
def rule_blank(spark, sf):
    text = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "  ").otherwise(F.col("o_orderpriority"))
    rows = table(spark, sf, "orders").withColumn("text", text).withColumn("value", F.lit(None).cast("double"))
    return rows.where(rules.value_predicate(Rule("blank"), is_numeric=F.lit(False))).select("o_orderkey", "o_orderstatus")


@query("rule_text_contains", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'der ')")
def rule_text_contains(spark, sf):
    rows = table(spark, sf, "documents").withColumn("value", F.lit(None).cast("double"))
    return rows.where(rules.value_predicate(Rule("text_contains", text="DER "))).select("doc_id", "lang")


@query("rule_top_n", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
  SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS r FROM lineitem) WHERE r <= 10""")
def rule_top_n(spark, sf):
    li = table(spark, sf, "lineitem")
    out = rules.with_top_hit(li, Rule("top_bottom", rank=10), "hit", ["l_suppkey"], "l_extendedprice")
    return out.where("hit").select(*LINE, "l_suppkey", "l_extendedprice")


@query("rule_bottom_percent", """
  WITH k AS (SELECT l_returnflag, greatest(1, round_even(count(l_extendedprice) * 5 / 100.0, 0))::BIGINT AS k
             FROM lineitem GROUP BY 1),
  r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, r.l_returnflag, l_extendedprice FROM r JOIN k
  ON r.l_returnflag = k.l_returnflag WHERE r <= k""")
def rule_bottom_percent(spark, sf):
    rule = Rule("top_bottom", rank=5, percent=True, bottom=True)
    out = rules.with_top_hit(table(spark, sf, "lineitem"), rule, "hit", ["l_returnflag"], "l_extendedprice")
    return out.where("hit").select(*LINE, "l_returnflag", "l_extendedprice")


@query("rule_sigma", """SELECT event_id, event_type, value FROM (
  SELECT *, avg(value) OVER (PARTITION BY event_type) AS m, stddev_pop(value) OVER (PARTITION BY event_type) AS s
  FROM events) WHERE s > 0 AND abs(value - m) > 3 * s""")
def rule_sigma(spark, sf):
    out = rules.with_sigma_hit(table(spark, sf, "events"), Rule("outlier_sigma"), "hit", ["event_type"])
    return out.where("hit").select("event_id", "event_type", "value")


@query("rule_jump", """SELECT event_id, user_id, value FROM (
  SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE abs(value - p) > 150""")
def rule_jump(spark, sf):
    ev = table(spark, sf, "events")
    chunk = fit_chunk(ev, ["user_id"])
    out = rules.with_jump_hit(ev, Rule("jump", value2=150), "hit", ["user_id"], ["ts", "event_id"], chunk=chunk)
    return out.where("hit").select("event_id", "user_id", "value")


RUNS_SQL = """
  SELECT *, count(*) OVER (PARTITION BY {keys}, run) AS run_len FROM (
    SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY {order}) AS run FROM (
      SELECT *, CASE WHEN {v} = lag({v}) OVER (PARTITION BY {keys} ORDER BY {order}) THEN 0 ELSE 1 END AS new FROM {rows}))
"""


@query("rule_stuck", "SELECT event_id, user_id, flag FROM (" + RUNS_SQL.format(
    keys="user_id", order="ts, event_id", v="flag",
    rows="(SELECT *, CASE WHEN value > 60 THEN 1.0 ELSE 0.0 END AS flag FROM events)") + ") WHERE run_len >= 8")
def rule_stuck(spark, sf):
    ev = table(spark, sf, "events").withColumn("flag", F.when(F.col("value") > 60, 1.0).otherwise(0.0))
    chunk = fit_chunk(ev, ["user_id"])
    out = rules.with_stuck_hit(ev, Rule("stuck", value2=8), "hit", ["user_id"], ["ts", "event_id"], "flag", chunk)
    return out.where("hit").select("event_id", "user_id", "flag")


@query("rule_duplicate", f"""SELECT entity, metric, {TS}, value FROM (
  SELECT *, count(*) OVER (PARTITION BY metric, value) AS n FROM ({RD})) WHERE n > 1 AND value IS NOT NULL""")
def rule_duplicate(spark, sf):
    out = rules.with_duplicate_hit(readings(spark, sf), "hit", ["metric"])
    return shown(out.where("hit").select("entity", "metric", "ts", "value"))


@query("rule_duplicate_text", """SELECT p_partkey, p_brand, p_name FROM (
  SELECT *, count(*) OVER (PARTITION BY p_brand, p_name) AS n FROM part) WHERE n > 1""")
def rule_duplicate_text(spark, sf):
    out = rules.with_duplicate_hit(table(spark, sf, "part"), "hit", ["p_brand"], F.col("p_name"))
    return out.where("hit").select("p_partkey", "p_brand", "p_name")


FLAG_RULES = [
    Rule("threshold", label="high", operator=">", value=70, scope="selected", columns=("click", "view")),
    Rule("between", label="mid", value=49.5, value2=50.5, scope="pattern", pattern="^p|up$"),
    Rule("outlier_sigma", value2=2.0),
    Rule("jump", value2=45.0),
    Rule("top_bottom", label="top", rank=2),
    Rule("zero", label="off", enabled=False),
    Rule("threshold", label="bad pattern", operator=">", value=0, scope="pattern", pattern="(["),
    Rule("color_scale"),
]


@query("flags_all", f"""
  WITH s AS (SELECT r.*, c.name, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd,
                    lag(value) OVER (PARTITION BY entity, r.metric ORDER BY ts) AS p,
                    rank() OVER (PARTITION BY entity, r.metric ORDER BY value DESC NULLS LAST) AS rk
             FROM ({RD}) r JOIN ({CHANNELS_SQL}) c ON r.metric = c.metric WHERE c.include
             WINDOW w AS (PARTITION BY entity, r.metric))
  SELECT entity, name, {TS}, label, rule, value FROM (
    SELECT *, 'high' AS label, 'threshold' AS rule FROM s WHERE value > 70 AND metric IN ('click', 'view')
    UNION ALL SELECT *, 'mid', 'between' FROM s WHERE value BETWEEN 49.5 AND 50.5 AND regexp_matches(metric, '^p|up$')
    UNION ALL SELECT *, 'Outlier (sigma) / 外れ値', 'outlier_sigma' FROM s WHERE sd > 0 AND abs(value - m) > 2 * sd
    UNION ALL SELECT *, 'Sudden jump / 急変', 'jump' FROM s WHERE abs(value - p) > 45
    UNION ALL SELECT *, 'top', 'top_bottom' FROM s WHERE rk <= 2 AND value IS NOT NULL)""")
def flags_all(spark, sf):
    out = rules.collect_flags(readings(spark, sf), channels(spark, sf), FLAG_RULES)
    return shown(out.select("entity", "name", "ts", "label", "rule", "value"))


@query("flags_raw_events", f"""
  WITH r AS (SELECT *, CASE WHEN value < 30 THEN NULL WHEN value < 40 THEN 0.0 ELSE round(value / 20) END AS v FROM ({EV_SQL})),
  run AS ({RUNS_SQL.format(keys='entity, metric', order='ts, row_no', v='v', rows='r')})
  SELECT row_no, 'stuck' AS rule, v AS value FROM run WHERE run_len >= 4 AND v IS NOT NULL
  UNION ALL SELECT row_no, 'negative', v FROM run WHERE v < 0
  UNION ALL SELECT row_no, 'blank', v FROM run WHERE v IS NULL""")
def flags_raw_events(spark, sf):
    v = F.when(F.col("value") < 30, None).when(F.col("value") < 40, 0.0).otherwise(F.round(F.col("value") / 20))
    rows = raw_events(spark, sf).withColumn("value", v)
    active = [Rule("zero"), Rule("blank", scope="all"), Rule("negative"), Rule("stuck", value2=4)]
    chunk = fit_chunk(rows, rules.SERIES)
    return rules.collect_flags(rows, None, active, exclude=("zero",), chunk=chunk).select("row_no", "rule", "value")


# --- scales -------------------------------------------------------------------- #
def five_stops(lo, hi):
    return ", ".join(f"{lo} + ({hi} - {lo}) * {i / 4}" for i in range(5))


POSITION_SQL = """
  CASE WHEN value IS NULL THEN NULL WHEN value <= s[1] THEN 0.0 WHEN value >= s[5] THEN 1.0
       ELSE round((below - 1 + (value - s[below]) / CASE WHEN s[below + 1] = s[below] THEN 1.0
                   ELSE s[below + 1] - s[below] END) / 4, 6) END AS position,
  CASE WHEN value IS NULL THEN NULL ELSE least(greatest(reached, 0), 4) END AS band
"""


def scale_sql(stops):
    return f"""SELECT entity, metric, {TS}, value, {POSITION_SQL} FROM (
      SELECT r.entity, r.metric, ts, value, s, len(list_filter(s, lambda x: x < value)) AS below,
             len(list_filter(s, lambda x: x <= value)) - 1 AS reached
      FROM ({RD}) r JOIN ({stops}) t ON r.metric = t.metric)"""


def with_scale(spark, sf, rule):
    out = rules.with_scale(readings(spark, sf), rule)
    return shown(out.select("entity", "metric", "ts", "value", F.round("position", 6).alias("position"),
                            F.col("band").cast("long").alias("band")))


@query("scale_auto", scale_sql(f"SELECT metric, [{five_stops('min(value)', 'max(value)')}] AS s FROM ({RD}) GROUP BY 1"))
def scale_auto(spark, sf):
    return with_scale(spark, sf, Rule("color_scale", scale_mode="5color"))


@query("scale_percent", scale_sql(
    f"SELECT metric, quantile_cont(value, [0.05, 0.275, 0.5, 0.725, 0.95]) AS s FROM ({RD}) GROUP BY 1"))
def scale_percent(spark, sf):
    return with_scale(spark, sf, Rule("color_scale", scale_mode="5color", scale_bounds="percent"))


@query("scale_numbers", scale_sql(f"SELECT DISTINCT metric, [30.0, 40.0, 50.0, 60.0, 70.0] AS s FROM ({RD})"))
def scale_numbers(spark, sf):
    return with_scale(spark, sf, Rule("color_scale", scale_mode="5color", scale_bounds="numbers",
                                      scale_values=(70, 30, 40, 60, 50)))


@query("scale_quantiles_lineitem", """
  SELECT l_returnflag, round(q[1], 4) AS q05, round(q[2], 4) AS q50, round(q[3], 4) AS q95 FROM (
    SELECT l_returnflag, quantile_cont(l_extendedprice, [0.05, 0.5, 0.95]) AS q FROM lineitem GROUP BY 1)""")
def scale_quantiles_lineitem(spark, sf):
    rule = Rule("color_scale", scale_bounds="percent")
    out = rules.scale_stops(table(spark, sf, "lineitem"), rule, ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", *[F.round(F.col("stops")[i], 4).alias(n) for i, n in enumerate(("q05", "q50", "q95"))])


@query("data_bar", f"""SELECT entity, metric, {TS}, round((value - lo) / (hi - lo), 6) AS bar FROM (
  SELECT *, min(value) OVER (PARTITION BY metric) AS lo, max(value) OVER (PARTITION BY metric) AS hi FROM ({RD}))""")
def data_bar(spark, sf):
    out = rules.with_data_bar(readings(spark, sf))
    return shown(out.select("entity", "metric", "ts", F.round("bar", 6).alias("bar")))


@query("diverging_scale", f"""SELECT metric, entity, {TS}, round(0.5 + 0.5 * greatest(-1, least(1, deviation / size)), 6) AS position
  FROM (SELECT *, max(abs(deviation)) OVER (PARTITION BY metric) AS size FROM {DEV_SQL})""")
def diverging_scale(spark, sf):
    dev = deviation(aligned(readings(spark, sf), grid="1 day"))
    out = rules.with_local_scale(dev, value="deviation", diverging=True)
    return shown(out.select("metric", "entity", "ts", F.round("position", 6).alias("position")))
