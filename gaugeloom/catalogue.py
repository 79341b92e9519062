"""The queries over the driver's tables and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeloom.functions import running, scalar, series
from gaugeloom.operators import desk, episodes, incidents, lookups, outbox, rollup, rules, store, stored, storms, upkeep
from gaugeloom.plans.definitions import Trend, load
from gaugeloom.plans.expression import Names, compile_expression
from gaugeloom.sources import checks, logs, samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SIX_H = 6 * 3600
#: The end of the tables' month; 'now' of the queries that need one.
NOW = 1706659200


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, entity: str = "event_type") -> DataFrame:
    return samples.samples_from_events(table(spark, sf_dir, "events"), entity)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.log_from_events(table(spark, sf_dir, "events"))


def r4(x: Column | str, digits: int = 4) -> Column:
    """Rounded a little off the ties, alike in both engines."""
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(1e-7), digits)


_S = """s AS (SELECT 'events' AS monitor, event_type AS entity_id, 'value' AS metric, CAST(floor(epoch(ts)) AS BIGINT) AS ts, arg_max(value, event_id) AS value
  FROM events WHERE isfinite(value) GROUP BY event_type, floor(epoch(ts)))"""
_SU = _S.replace("event_type AS entity_id", "CAST(user_id AS VARCHAR) AS entity_id").replace("GROUP BY event_type", "GROUP BY user_id")
_R5 = _S + """,
r5 AS (SELECT monitor, entity_id, metric, ts // 300 * 300 AS bucket, avg(value) AS avg, min(value) AS min, max(value) AS max, arg_max(value, ts) AS last, count(*) AS cnt FROM s GROUP BY ALL)"""
_R1 = _R5 + """,
r1 AS (SELECT monitor, entity_id, metric, bucket // 3600 * 3600 AS hour, sum(avg * cnt) / sum(cnt) AS avg, min(min) AS min, max(max) AS max, arg_max(last, bucket) AS last, sum(cnt)::BIGINT AS cnt FROM r5 GROUP BY ALL)"""
_L = """l AS (SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, 'app' AS source, event_type AS provider, CASE WHEN event_type = 'error' THEN 'E1' END AS event_id,
  CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS severity, event_type || ' by user ' || CAST(user_id AS VARCHAR) || ' ' || props AS message FROM events)"""
_W6 = "WINDOW w AS (PARTITION BY monitor, entity_id ORDER BY ts RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW)"
_HASH = "substr(sha256(regexp_replace(regexp_replace(trim(regexp_replace(lower({m}), '\\s+', ' ', 'g')), '[0-9a-f]{{8,}}', '#', 'g'), '[0-9]+', '#', 'g')), 1, 16)"


# ---- rollups and baselines


@query(f"WITH {_R5} SELECT entity_id, bucket, round(avg + 1e-7, 4) AS avg, min, max, last, cnt FROM r5")
def rollup_5m(spark, sf_dir):
    return rollup.rollup_5m(points(spark, sf_dir)).select("entity_id", "bucket", r4("avg").alias("avg"), "min", "max", "last", "cnt")


@query(f"WITH {_R1} SELECT entity_id, hour AS bucket, round(avg + 1e-7, 4) AS avg, min, max, last, cnt FROM r1")
def rollup_1h_weighted(spark, sf_dir):
    return rollup.rollup_1h(rollup.rollup_5m(points(spark, sf_dir))).select("entity_id", "bucket", r4("avg").alias("avg"), "min", "max", "last", "cnt")


@query(f"WITH {_R5} SELECT entity_id, bucket, cnt FROM r5 WHERE bucket < ({NOW} - 86400 - 30) // 300 * 300")
def rollup_5m_complete(spark, sf_dir):
    return rollup.rollup_5m(points(spark, sf_dir), NOW - 86400).select("entity_id", "bucket", "cnt")


_Q = 2.0 ** (-300 / (3 * 86400))
_EWMA = _R5 + f""",
n AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY bucket) AS n FROM r5),
e AS (SELECT entity_id, bucket, n, pow({_Q!r}, n::DOUBLE) * sum(avg * CASE WHEN n = 1 THEN pow({_Q!r}, -1.0::DOUBLE) ELSE {1 - _Q!r} * pow({_Q!r}, -n::DOUBLE) END) OVER (PARTITION BY entity_id ORDER BY bucket) AS level FROM n)"""


@query(f"WITH {_EWMA} SELECT entity_id, bucket, round(level + 1e-7, 4) AS level, n AS updates FROM e")
def baseline_history(spark, sf_dir):
    rows = rollup.baselines(rollup.rollup_5m(points(spark, sf_dir)))
    return rows.select("entity_id", "bucket", r4("level").alias("level"), F.col("updates").cast("long").alias("updates"))


@query(f"WITH {_EWMA} SELECT entity_id, max(bucket) AS bucket, round(arg_max(level, bucket) + 1e-7, 4) AS level, max(n) AS updates FROM e GROUP BY entity_id")
def baseline_ewma(spark, sf_dir):
    rows = rollup.latest_baselines(rollup.baselines(rollup.rollup_5m(points(spark, sf_dir))))
    return rows.select("entity_id", "bucket", r4("level").alias("level"), F.col("updates").cast("long").alias("updates"))


@query(f"WITH {_EWMA} SELECT entity_id, max(n) >= 240 AS ready, round(least(max(n) / 240.0::DOUBLE, 1) + 1e-7, 4) AS coverage FROM e GROUP BY entity_id")
def baseline_ready(spark, sf_dir):
    rows = rollup.latest_baselines(rollup.baselines(rollup.rollup_5m(points(spark, sf_dir))))
    return rows.select("entity_id", "ready", r4("coverage").alias("coverage"))


@query(
    f"WITH {_EWMA}, b AS (SELECT entity_id, bucket + 300 AS at, CASE WHEN n >= 240 THEN level END AS level FROM e) "
    "SELECT s.entity_id, s.ts, round(b.level + 1e-7, 4) AS baseline FROM s ASOF LEFT JOIN b ON s.entity_id = b.entity_id AND s.ts >= b.at"
)
def baseline_as_of(spark, sf_dir):
    p = points(spark, sf_dir)
    return rollup.with_baseline(p, rollup.baselines(rollup.rollup_5m(p))).select("entity_id", "ts", r4("baseline").alias("baseline"))


@query(
    f"WITH {_EWMA}, f AS (SELECT * FROM e WHERE bucket >= {NOW - 12 * 86400} OR entity_id IN ('click', 'view')), "
    "g AS (SELECT entity_id, bucket, level, min(bucket) OVER p AS oldest, count(*) OVER p AS kept, max(n) OVER p AS updates FROM f WINDOW p AS (PARTITION BY entity_id)) "
    f"SELECT entity_id, bucket, round(level + 1e-7, 4) AS level, oldest > {-(-(NOW - 20 * 86400) // 300) * 300} AND kept < updates AS truncated FROM g WHERE bucket BETWEEN {NOW - 20 * 86400} AND {NOW}"
)
def baseline_back(spark, sf_dir):
    fives = rollup.rollup_5m(points(spark, sf_dir))
    now = rollup.latest_baselines(rollup.baselines(fives)).withColumn("half_life", F.lit(rollup.HALF_LIFE))
    kept = fives.where((F.col("bucket") >= NOW - 12 * 86400) | F.col("entity_id").isin("click", "view"))
    return rollup.baselines_back(now, kept, NOW - 20 * 86400, NOW).select("entity_id", "bucket", r4("level").alias("level"), "truncated")


# ---- trailing windows


@query(f"WITH {_SU} SELECT entity_id, ts, round(avg(value) OVER w + 1e-7, 4) AS avg_6h, min(value) OVER w AS min_6h, max(value) OVER w AS max_6h FROM s {_W6}")
def win_avg_min_max(spark, sf_dir):
    w, v = series.trailing(SIX_H), F.col("value")
    return points(spark, sf_dir, "user_id").select("entity_id", "ts", r4(series.avg(v, w)).alias("avg_6h"), series.low(v, w).alias("min_6h"), series.high(v, w).alias("max_6h"))


@query(
    f"WITH {_S} SELECT entity_id, ts, CASE WHEN count(*) OVER w >= 2 THEN round(last(value) OVER w - first(value) OVER w + 1e-7, 4) END AS delta, "
    "CASE WHEN count(*) OVER w >= 2 AND max(ts) OVER w > min(ts) OVER w THEN round(greatest(last(value) OVER w - first(value) OVER w, 0) / (max(ts) OVER w - min(ts) OVER w) + 1e-7, 4) END AS rate "
    f"FROM s {_W6}"
)
def win_delta_rate(spark, sf_dir):
    return running.with_window(points(spark, sf_dir), SIX_H).select("entity_id", "ts", r4(running.delta()).alias("delta"), r4(running.rate()).alias("rate"))


@query(f"WITH {_S} SELECT entity_id, ts, CASE WHEN count(*) OVER w >= 3 THEN round(regr_slope(value, ts - 1704067200) OVER w * 3600 + 1e-7, 4) END AS slope_h FROM s {_W6}")
def win_slope(spark, sf_dir):
    return running.with_window(points(spark, sf_dir), SIX_H).select("entity_id", "ts", r4(running.slope() * 3600).alias("slope_h"))


#: Points of six hours that a series sampled each half hour keeps.
_ROOM = series.capacity(SIX_H, 1800)


@query(
    f"WITH {_S}, k AS (SELECT entity_id, ts, list({{'t': ts, 'v': value}}) OVER (PARTITION BY entity_id ORDER BY ts ROWS BETWEEN {_ROOM - 1} PRECEDING AND CURRENT ROW) AS l FROM s), "
    f"w AS (SELECT entity_id, ts, list_filter(l, lambda x: x.t >= ts - {SIX_H}) AS l FROM k) "
    "SELECT entity_id, ts, len(l) AS points, round(list_avg(list_transform(l, lambda x: x.v)) + 1e-7, 4) AS avg, CASE WHEN len(l) >= 2 THEN round(l[len(l)].v - l[1].v + 1e-7, 4) END AS delta, "
    f"CASE WHEN len(l) >= 2 THEN round((l[len(l)].t - l[1].t) / {SIX_H}::DOUBLE + 1e-7, 4) END AS coverage FROM w"
)
def win_capacity(spark, sf_dir):
    rows = running.with_window(points(spark, sf_dir), SIX_H, capacity=_ROOM)
    return rows.select("entity_id", "ts", running.count().alias("points"), r4(running.avg()).alias("avg"), r4(running.delta()).alias("delta"), r4(running.coverage(SIX_H)).alias("coverage"))


@query(
    f"WITH {_S}, u AS (SELECT *, coalesce(CAST(value > lag(value) OVER (PARTITION BY entity_id ORDER BY ts) AS INT), 0) AS up FROM s) "
    f"SELECT entity_id, ts, CASE WHEN count(*) OVER w >= 2 THEN round((sum(up) OVER w - first(up) OVER w) / (count(*) OVER w - 1)::DOUBLE + 1e-7, 4) END AS monot FROM u {_W6}"
)
def win_monot(spark, sf_dir):
    return running.with_window(points(spark, sf_dir), SIX_H).select("entity_id", "ts", r4(running.monot()).alias("monot"))


@query(f"WITH {_S} SELECT entity_id, ts, CASE WHEN count(*) OVER w >= 2 THEN round(least(greatest((max(ts) OVER w - min(ts) OVER w) / 21600.0::DOUBLE, 0), 1) + 1e-7, 4) END AS coverage FROM s {_W6}")
def win_coverage(spark, sf_dir):
    return running.with_window(points(spark, sf_dir), SIX_H).select("entity_id", "ts", r4(running.coverage(SIX_H)).alias("coverage"))


@query(f"WITH {_S}, g AS (SELECT *, CASE WHEN ts % 3 > 0 THEN value END AS v FROM s) SELECT entity_id, ts, greatest(ts - max(CASE WHEN v IS NOT NULL THEN ts END) OVER w, 0) AS age, last(v IGNORE NULLS) OVER w AS latest FROM g WINDOW w AS (PARTITION BY entity_id ORDER BY ts)")
def metric_age(spark, sf_dir):
    rows = points(spark, sf_dir).withColumn("v", F.when(F.col("ts") % 3 > 0, F.col("value")))
    return rows.select("entity_id", "ts", series.age(F.col("v"), F.col("ts")).alias("age"), series.last(F.col("v")).alias("latest"))


# ---- the rule language

_NAMES = Names(frozenset({"value", "part"}), frozenset({"kind"}), {"limit": 50}, keys=("event_id",))


def _expressions(spark: SparkSession, sf_dir: str, **texts: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", samples.epoch(F.col("ts")).alias("ts"), "value", F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 7 - 3).cast("double")).alias("part"), F.col("event_type").alias("kind"))
    return rows.select("event_id", *(compile_expression(t, _NAMES).column.alias(n) for n, t in texts.items()))


_X = "x AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value, CASE WHEN event_id % 3 > 0 THEN (event_id % 7 - 3)::DOUBLE END AS part, event_type AS kind FROM events)"


@query(
    f"WITH {_X} SELECT event_id, round(100 * value / nullif(part, 0) + 1e-7, 4) AS share, CASE WHEN part IS NOT NULL THEN least(greatest(value, part), 40) END AS clamped, coalesce(part, -1) AS filled, abs(part) AS absolute FROM x"
)
def scalar_pct_clamp_coalesce(spark, sf_dir):
    rows = _expressions(spark, sf_dir, share="pct(value, part)", clamped="clamp(value, part, 40)", filled="coalesce(part, -1)", absolute="abs(part)")
    return rows.withColumn("share", r4("share"))


@query(f"WITH {_X} SELECT event_id, regexp_matches(kind, '^(err|sign)') AS severe, contains(kind, 'chase') AS bought, kind IN ('view', 'click') AS light FROM x")
def scalar_strings_regex(spark, sf_dir):
    return _expressions(spark, sf_dir, severe="matches(kind, '^(err|sign)')", bought="contains(kind, 'chase')", light="kind in ['view', 'click']")


@query(
    f"WITH {_X}, m AS (SELECT event_id, ts % 86400 // 60 AS minute, (ts // 86400 + 3) % 7 AS day FROM x) "
    "SELECT event_id, minute >= 540 AND minute < 1020 AS office, minute >= 1350 OR minute < 375 AS night, (['mon', 'tue', 'wed', 'thu', 'fri', 'sat', 'sun'])[day + 1] AS day FROM m"
)
def time_during_dow(spark, sf_dir):
    return _expressions(spark, sf_dir, office="during('09:00-17:00')", night="during('22:30-06:15')", day="dow()")


@query(f"WITH {_L} SELECT id, {_HASH.format(m='message')} AS hash FROM l")
def msg_hash(spark, sf_dir):
    return log(spark, sf_dir).select("id", scalar.msg_hash(F.col("message")).alias("hash"))


@query(
    f"WITH {_X} SELECT event_id, part > 0 AND value > 50 AS both_hold, part > 0 OR value > 50 AS one_holds, NOT (part > 0) AS not_holds, "
    "CASE WHEN part > 0 AND value > 50 THEN 'true' WHEN (part > 0 AND value > 50) IS NULL THEN 'unknown' ELSE 'false' END AS outcome FROM x"
)
def tribool_rules(spark, sf_dir):
    rows = _expressions(spark, sf_dir, both_hold="part > 0 and value > limit", one_holds="part > 0 or value > limit", not_holds="not part > 0")
    return rows.withColumn("outcome", F.when(F.col("both_hold").isNull(), "unknown").when(F.col("both_hold"), "true").otherwise("false"))


@query(f"WITH {_X} SELECT event_id, CASE WHEN part IS NOT NULL THEN 0 < part AND part < value AND value <= 50 END AS chained FROM x")
def chained_cmp(spark, sf_dir):
    return _expressions(spark, sf_dir, chained="0 < part < value <= limit")


@query(f"WITH {_X} SELECT event_id, CASE WHEN part IS NOT NULL THEN 1 IN (part, 1) END AS inside, CASE WHEN part IS NOT NULL THEN part NOT IN (1, 2) END AS outside, NULL::BOOLEAN AS never FROM x")
def in_list_null(spark, sf_dir):
    return _expressions(spark, sf_dir, inside="1 in [part, 1]", outside="part not in [1, 2]", never="part in [1, None]")


@query(f"WITH {_X} SELECT event_id, round(value - nullif(part, 0) * floor(value / nullif(part, 0)) + 1e-7, 4) AS rest, round(-value - nullif(part, 0) * floor(-value / nullif(part, 0)) + 1e-7, 4) AS negative FROM x")
def floored_mod(spark, sf_dir):
    rows = _expressions(spark, sf_dir, rest="value % part", negative="-value % part")
    return rows.select("event_id", r4("rest").alias("rest"), r4("negative").alias("negative"))


@query(f"WITH {_X} SELECT event_id, CASE WHEN part > 0 THEN value WHEN part IS NOT NULL THEN -part END AS chosen FROM x")
def ifexp(spark, sf_dir):
    return _expressions(spark, sf_dir, chosen="value if part > 0 else -part")


# ---- definitions

_DEFINITION = """
schema = 1
[monitor]
name = "values"
source = "disk"
interval = "60s"
[parameters]
high = 85
[[derived]]
name = "rising"
expr = "monot(used_pct, '6h')"
[[derived]]
name = "mean"
expr = "avg(used_pct, '6h')"
[[derived]]
name = "above"
expr = "used_pct - mean"
[[rule]]
name = "warn"
group = "level"
when = "used_pct >= high"
severity = "warning"
confirm_cycles = 2
clear_cycles = 2
[[rule]]
name = "error"
group = "level"
when = "used_pct >= 95"
severity = "error"
[[rule]]
name = "far"
when = "above > 30 and rising > 0.4"
severity = "notice"
"""


def _evaluated(spark: SparkSession, sf_dir: str, text: str = _DEFINITION) -> tuple[DataFrame, object]:
    definition = load(text)
    ticks = samples.samples_from_events(table(spark, sf_dir, "events"), "user_id", dealt=True)
    return rules.evaluate(ticks.select("monitor", "entity_id", "ts", F.col("value").alias("used_pct")), definition), definition


_U = _SU + """,
d AS (SELECT entity_id, ts, value, avg(value) OVER w AS mean, CASE WHEN count(*) OVER w >= 2 THEN (sum(up) OVER w - first(up) OVER w) / (count(*) OVER w - 1)::DOUBLE END AS rising
  FROM (SELECT *, coalesce(CAST(value > lag(value) OVER (PARTITION BY entity_id ORDER BY ts) AS INT), 0) AS up FROM s)
  WINDOW w AS (PARTITION BY entity_id ORDER BY ts RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_U} SELECT entity_id, ts, round(rising + 1e-7, 4) AS rising, round(mean + 1e-7, 4) AS mean, round(value - mean + 1e-7, 4) AS above FROM d")
def derived_topo(spark, sf_dir):
    rows, _ = _evaluated(spark, sf_dir)
    return rows.select("entity_id", "ts", r4("rising").alias("rising"), r4("mean").alias("mean"), r4("above").alias("above"))


_OUT = _U + """,
o AS (SELECT entity_id, ts, 'warn' AS rule, 'level' AS grp, 2 AS severity, 2 AS confirm, 2 AS clear, CASE WHEN value >= 85 THEN 'true' ELSE 'false' END AS outcome FROM d
  UNION ALL SELECT entity_id, ts, 'error', 'level', 3, 1, 1, CASE WHEN value >= 95 THEN 'true' ELSE 'false' END FROM d
  UNION ALL SELECT entity_id, ts, 'far', 'far', 1, 1, 1, CASE WHEN value - mean > 30 AND rising > 0.4 THEN 'true' WHEN (value - mean > 30 AND rising > 0.4) IS NULL THEN 'unknown' ELSE 'false' END FROM d)"""


@query(f"WITH {_OUT} SELECT entity_id, ts, rule, severity, outcome FROM o")
def rule_outcomes(spark, sf_dir):
    rows, definition = _evaluated(spark, sf_dir)
    return rules.outcomes(rows, definition).select("entity_id", "ts", "rule", "severity", "outcome")


@query(f"WITH {_SU} SELECT entity_id, ts, value AS used_pct FROM s WHERE NOT (value < 20)")
def exempt_filter(spark, sf_dir):
    rows, _ = _evaluated(spark, sf_dir, _DEFINITION.replace("schema = 1\n", 'schema = 1\nexempt = ["used_pct < 20"]\n'))
    return rows.where("not exempt").select("entity_id", "ts", "used_pct")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, definition = _evaluated(spark, sf_dir)
    return incidents.confirmed(rules.outcomes(rows, definition))


_CONF = _OUT + """,
b AS (SELECT *, CASE WHEN outcome <> 'unknown' THEN outcome END AS known, last(CASE WHEN outcome <> 'unknown' THEN outcome END IGNORE NULLS) OVER (PARTITION BY entity_id, rule ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o),
i AS (SELECT *, sum(CASE WHEN known IS NOT NULL AND (before IS NULL OR before <> known) THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, rule ORDER BY ts) AS run FROM b),
m AS (SELECT *, count(known) OVER (PARTITION BY entity_id, rule, run ORDER BY ts) AS nth FROM i),
c AS (SELECT entity_id, ts, rule, grp, severity, outcome, coalesce(last(CASE WHEN known = 'true' AND nth >= confirm THEN TRUE WHEN known = 'false' AND nth >= clear THEN FALSE END IGNORE NULLS) OVER (PARTITION BY entity_id, rule ORDER BY ts), FALSE) AS confirmed FROM m)"""


@query(f"WITH {_CONF} SELECT entity_id, ts, rule, confirmed FROM c")
def confirm_state(spark, sf_dir):
    return _states(spark, sf_dir).select("entity_id", "ts", "rule", "confirmed")


_LADDER = _CONF + """,
v AS (SELECT entity_id, grp, ts, coalesce(max(CASE WHEN confirmed THEN severity END), -1) AS severity FROM c GROUP BY ALL),
w AS (SELECT *, coalesce(lag(severity) OVER (PARTITION BY entity_id, grp ORDER BY ts), -1) AS was FROM v),
k AS (SELECT *, CASE WHEN was < 0 AND severity >= 0 THEN 'open' WHEN was >= 0 AND severity < 0 THEN 'clear' WHEN severity > was THEN 'escalate' WHEN severity < was THEN 'downgrade' END AS kind FROM w),
t AS (SELECT entity_id, grp, ts, severity, kind, sum(CASE WHEN kind = 'open' THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, grp ORDER BY ts)::BIGINT AS incident FROM k WHERE kind IS NOT NULL)"""


@query(f"WITH {_LADDER} SELECT entity_id, grp, ts, kind, severity, incident FROM t")
def ladder_transitions(spark, sf_dir):
    return incidents.ladder(_states(spark, sf_dir)).select("entity_id", "grp", "ts", "kind", "severity", "incident")


@query(
    f"WITH {_LADDER}, f AS (SELECT *, sum(CASE WHEN kind = 'clear' THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, grp ORDER BY ts RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS clears FROM t) "
    "SELECT entity_id, grp, ts, incident, clears >= 3 AS flapping FROM f WHERE kind = 'open'"
)
def flap_opens(spark, sf_dir):
    return incidents.flapping(incidents.ladder(_states(spark, sf_dir))).select("entity_id", "grp", "ts", "incident", "flapping")


@query(
    f"WITH {_LADDER}, q AS (SELECT *, ts // 500 AS fast FROM t), f AS (SELECT *, sum(CASE WHEN kind = 'clear' THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, grp ORDER BY fast RANGE BETWEEN 600 PRECEDING AND CURRENT ROW)::BIGINT AS clears FROM q) "
    "SELECT entity_id, grp, fast AS ts, incident, clears, clears >= 3 AS flapping FROM f WHERE kind = 'open'"
)
def flap_squeezed(spark, sf_dir):
    """Transitions 500 times as fast, so that some groups flap."""
    faster = incidents.ladder(_states(spark, sf_dir)).withColumn("ts", F.floor(F.col("ts") / 500))
    return incidents.flapping(faster).select("entity_id", "grp", "ts", "incident", "clears", "flapping")


@query(
    f"WITH {_LADDER}, h AS (SELECT entity_id, grp, incident, min(ts) AS opened_ts, max(CASE WHEN kind = 'clear' THEN ts END) AS cleared_ts, string_agg(kind, ',' ORDER BY ts) AS kinds FROM t GROUP BY ALL), "
    f"{_L}, near AS (SELECT h.entity_id, h.grp, h.incident, l.id, row_number() OVER (PARTITION BY h.entity_id, h.grp, h.incident ORDER BY l.ts DESC, l.id DESC) AS nth FROM h JOIN l ON abs(l.ts - h.opened_ts) <= 600), "
    "ev AS (SELECT entity_id, grp, incident, count(*) AS events, string_agg(id, ',' ORDER BY nth) AS ids FROM near WHERE nth <= 50 GROUP BY ALL), "
    f"sm AS (SELECT h.entity_id, h.grp, h.incident, count(*) AS points, sum(s.value) AS total FROM h JOIN s ON s.entity_id = h.entity_id AND s.ts BETWEEN h.opened_ts - 1800 AND least({NOW}, coalesce(h.cleared_ts, {NOW}) + 1800) GROUP BY ALL) "
    "SELECT h.entity_id, h.grp, h.incident, kinds, coalesce(events, 0) AS events, coalesce(ids, '') AS ids, least(coalesce(points, 0), 300) AS points, CASE WHEN points <= 300 THEN round(total + 1e-7, 4) END AS total "
    "FROM h LEFT JOIN ev USING (entity_id, grp, incident) LEFT JOIN sm USING (entity_id, grp, incident)"
)
def incident_explained(spark, sf_dir):
    transitions = incidents.ladder(_states(spark, sf_dir)).withColumn("monitor", F.lit("events"))
    rows = desk.explain(incidents.summary(transitions), incidents.histories(transitions), log(spark, sf_dir), points(spark, sf_dir, "user_id"), NOW, details=())
    line = F.flatten(F.transform("series", lambda x: x["points"]))
    total = F.aggregate(line, F.lit(0.0), lambda a, x: a + x["value"])
    return rows.select(
        "entity_id", "grp", "incident", F.array_join(F.transform("history", lambda x: x["kind"]), ",").alias("kinds"), F.size("related_events").alias("events"),
        F.array_join(F.transform("related_events", lambda x: x["id"].cast("string")), ",").alias("ids"), F.size(line).alias("points"), F.when(F.size(line).between(1, 299), r4(total)).alias("total"),
    )


@query(
    f"WITH {_LADDER} SELECT entity_id, grp, incident, min(ts) AS opened_ts, max(CASE WHEN kind = 'clear' THEN ts END) AS cleared_ts, max(severity) AS peak_severity, count(*) AS changes, "
    "CASE WHEN max(CASE WHEN kind = 'clear' THEN ts END) IS NULL THEN 'open' ELSE 'cleared' END AS state FROM t GROUP BY ALL"
)
def incident_summary(spark, sf_dir):
    return incidents.summary(incidents.ladder(_states(spark, sf_dir))).select("entity_id", "grp", "incident", "opened_ts", "cleared_ts", "peak_severity", "changes", "state")


@query(f"WITH {_LADDER} SELECT entity_id, grp, incident, ts, kind, row_number() OVER (PARTITION BY entity_id, grp, incident ORDER BY ts) AS seq FROM t")
def incident_history(spark, sf_dir):
    return incidents.histories(incidents.ladder(_states(spark, sf_dir))).select("entity_id", "grp", "incident", "ts", "kind", F.col("seq").cast("long").alias("seq"))


#: Notifications with backoff, tick by tick; {acks} is a row (entity_id, grp, ts) an acknowledgement.
_FOLD = _CONF.replace("WITH ", "") + """,
tk AS (SELECT entity_id, grp, ts, max(CASE WHEN confirmed THEN severity * 2 + CASE WHEN outcome = 'true' THEN 1 ELSE 0 END END) AS top FROM c GROUP BY ALL),
tn AS (SELECT entity_id, grp, ts, CASE WHEN top IS NULL THEN -1 ELSE top // 2 END AS severity, coalesce(top % 2 = 1, FALSE) AS owner_true, row_number() OVER p AS n, lag(ts) OVER p AS before FROM tk WINDOW p AS (PARTITION BY entity_id, grp ORDER BY ts)),
lv AS MATERIALIZED (SELECT tn.*, EXISTS (SELECT 1 FROM ({acks}) a WHERE a.entity_id = tn.entity_id AND a.grp = tn.grp AND a.ts <= tn.ts AND (before IS NULL OR a.ts > before)) AS acked FROM tn),
fold AS (
  SELECT entity_id, grp, n, ts, severity, ts AS told, 0 AS tier, FALSE AS acked, []::BIGINT[] AS clears, CASE WHEN severity >= 0 THEN 'open' END AS kind FROM lv WHERE n = 1
  UNION ALL
  SELECT entity_id, grp, n, ts, severity, CASE WHEN kind IN ('open', 'escalate', 'renotify') THEN ts ELSE told END,
    CASE kind WHEN 'open' THEN CASE WHEN len(list_filter(clears, lambda x: ts - x <= 600)) >= 3 THEN 3 ELSE 0 END WHEN 'escalate' THEN 0 WHEN 'renotify' THEN tier + 1 ELSE tier END,
    CASE WHEN kind IN ('open', 'escalate') THEN FALSE ELSE now_acked END, CASE WHEN kind = 'recover' THEN list_append(clears, ts)[-5:] ELSE clears END, kind
  FROM (
    SELECT l.entity_id, l.grp, l.n, l.ts, l.severity, f.told, f.tier, f.clears, f.acked OR (f.severity >= 0 AND l.severity >= 0 AND l.acked) AS now_acked,
      CASE WHEN f.severity < 0 AND l.severity >= 0 THEN 'open' WHEN f.severity >= 0 AND l.severity < 0 THEN 'recover' WHEN f.severity >= 0 AND l.severity > f.severity THEN 'escalate'
        WHEN f.severity >= 0 AND l.severity = f.severity AND l.owner_true AND NOT (f.acked OR l.acked) AND greatest(0, l.ts - f.told) >= ([300, 900, 3600, 21600])[least(f.tier, 3) + 1] THEN 'renotify' END AS kind
    FROM fold f JOIN lv l ON l.entity_id = f.entity_id AND l.grp = f.grp AND l.n = f.n + 1))
SELECT 'events' AS monitor, entity_id, grp, ts, kind, CASE WHEN kind = 'recover' THEN 0 ELSE severity END AS severity FROM fold WHERE kind IS NOT NULL"""


@query("WITH RECURSIVE " + _FOLD.replace("{acks}", "SELECT '' AS entity_id, '' AS grp, 0 AS ts WHERE FALSE"))
def incident_fold(spark, sf_dir):
    return incidents.notifications(incidents.levels(_states(spark, sf_dir)))


@query(f"WITH {_SU}, a AS (SELECT entity_id, ts, lead(ts) OVER (PARTITION BY entity_id ORDER BY ts) AS back FROM s) SELECT entity_id, ts AS last_seen, ts + 86401 AS gone_ts, back AS back_ts FROM a WHERE coalesce(back, {NOW}) - ts > 86400")
def entity_gone(spark, sf_dir):
    return incidents.gone(points(spark, sf_dir, "user_id"), NOW, 86400).select("entity_id", "last_seen", "gone_ts", "back_ts")


@query(
    f"WITH RECURSIVE {_SU}, t AS MATERIALIZED (SELECT ts, coalesce(list_sort(list(DISTINCT entity_id) FILTER (value > 80)), []) AS asked, row_number() OVER (ORDER BY ts) AS n FROM (SELECT ts // 3600 * 3600 AS ts, entity_id, value FROM s) GROUP BY ts), "
    "r AS (SELECT 0::BIGINT AS n, 0::BIGINT AS ts, []::STRUCT(e VARCHAR, seen BIGINT)[] AS held, []::VARCHAR[] AS denied, []::VARCHAR[] AS up, []::VARCHAR[] AS down, []::VARCHAR[] AS refused "
    "UNION ALL SELECT n, ts, list_concat(stay, list_transform(up, lambda e: {'e': e, 'seen': ts})), rest, up, down, list_filter(rest, lambda e: NOT list_contains(denied, e)) FROM ("
    "SELECT *, fresh[1:10 - len(stay)] AS up, fresh[11 - len(stay):] AS rest FROM ("
    "SELECT *, list_filter(asked, lambda e: NOT list_contains(list_transform(stay, lambda h: h.e), e)) AS fresh FROM ("
    "SELECT n, ts, asked, denied, list_filter(seen, lambda h: ts - h.seen <= 1800) AS stay, list_sort(list_transform(list_filter(seen, lambda h: ts - h.seen > 1800), lambda h: h.e)) AS down FROM ("
    "SELECT t.n, t.ts, t.asked, r.denied, list_transform(r.held, lambda h: CASE WHEN list_contains(t.asked, h.e) THEN {'e': h.e, 'seen': t.ts} ELSE h END) AS seen FROM r JOIN t ON t.n = r.n + 1))))) "
    "SELECT 'events' AS monitor, ts, unnest(up) AS entity_id, 'promoted' AS kind FROM r UNION ALL SELECT 'events', ts, unnest(down), 'demoted' FROM r UNION ALL SELECT 'events', ts, unnest(refused), 'denied' FROM r"
)
def promotion_slots(spark, sf_dir):
    rows = points(spark, sf_dir, "user_id").select("monitor", (F.floor(F.col("ts") / 3600) * 3600).alias("ts"), "entity_id", "value")
    return rules.promotions(rows.where("value > 80").select("monitor", "ts", "entity_id").distinct(), rows.select("monitor", "ts"))


# ---- log events


@query(f"WITH {_L} SELECT id FROM l WHERE severity >= 2 OR regexp_matches(message, 'user 1[0-9] ')")
def store_filter(spark, sf_dir):
    rows = log(spark, sf_dir)
    return episodes.store_filter(rows, scalar.matches(F.col("message"), "user 1[0-9] "), 2).select("id")


@query(
    f"WITH {_L}, k AS (SELECT *, CASE WHEN lag(id) OVER w IS NOT NULL AND provider = lag(provider) OVER w AND event_id IS NOT DISTINCT FROM lag(event_id) OVER w AND severity = lag(severity) OVER w AND message = lag(message) OVER w THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (ORDER BY id)), "
    "g AS (SELECT *, sum(new) OVER (ORDER BY id) AS run FROM k) SELECT min(id) AS id, any_value(provider) AS provider, count(*) AS repeat_count, min(ts) AS first_ts, max(ts) AS last_ts FROM g GROUP BY run"
)
def adjacent_coalesce(spark, sf_dir):
    return episodes.coalesce_repeats(log(spark, sf_dir)).select("id", "provider", "repeat_count", "first_ts", "last_ts")


@query(
    f"WITH {_L}, k AS (SELECT *, CASE WHEN provider = lag(provider) OVER (ORDER BY id) THEN 0 ELSE 1 END AS new FROM l), g AS (SELECT *, sum(new) OVER (ORDER BY id) AS run FROM k) "
    "SELECT min(id) AS id, any_value(provider) AS provider, count(*) AS repeat_count, min(ts) AS first_ts, max(ts) AS last_ts FROM g GROUP BY run"
)
def repeats_coalesced(spark, sf_dir):
    """Events that say no more than their provider, so that neighbours are alike; ranges of 500 ids."""
    rows = log(spark, sf_dir).withColumns({"event_id": F.lit(None).cast("string"), "message": F.col("provider")})
    return episodes.coalesce_repeats(rows, 500).select("id", "provider", "repeat_count", "first_ts", "last_ts")


@query(f"WITH {_L} SELECT id, ts // 86400 * 86400 AS day, row_number() OVER (PARTITION BY provider, ts // 60 ORDER BY id) <= 1 AS stored FROM l")
def storm_guard(spark, sf_dir):
    return episodes.storm_guard(log(spark, sf_dir), 1).select("id", (F.floor(F.col("ts") / 86400) * 86400).alias("day"), "stored")


@query(
    f"WITH {_L}, p AS (SELECT provider, ts // 60 * 60 AS minute, count(*) AS n FROM l GROUP BY ALL HAVING count(*) > 1), "
    "q AS (SELECT *, CASE WHEN minute - lag(minute) OVER (PARTITION BY provider ORDER BY minute) = 60 THEN 0 ELSE 1 END AS start FROM p), "
    "r AS (SELECT *, sum(start) OVER (PARTITION BY provider ORDER BY minute)::BIGINT AS storm FROM q) SELECT provider, storm, min(minute) AS start_ts, max(minute) + 60 AS end_ts, sum(n - 1)::BIGINT AS collapsed FROM r GROUP BY ALL"
)
def storm_runs(spark, sf_dir):
    return episodes.storms(log(spark, sf_dir), 1).select("provider", "storm", "start_ts", "end_ts", "collapsed")


#: A 'minute' of six hours and a 'tick' of half an hour, so that the tables' events come in storms.
_LONG, _TURN, _FEW = 21600, 1800, 12
_STORM = f"""{_L},
te AS (SELECT *, (ts + {_TURN - 1}) // {_TURN} * {_TURN} AS tick FROM l),
tm AS (SELECT *, tick // {_LONG} * {_LONG} AS minute, row_number() OVER (PARTITION BY provider, tick // {_LONG} ORDER BY tick, id) AS nth FROM te),
pm AS (SELECT provider, minute, count(*) AS n, max(tick = minute) AS turn FROM tm GROUP BY ALL),
pr AS (SELECT *, sum(CASE WHEN turn AND minute - before = {_LONG} THEN 0 ELSE 1 END) OVER (PARTITION BY provider ORDER BY minute) AS run FROM (SELECT *, lag(minute) OVER (PARTITION BY provider ORDER BY minute) AS before FROM pm)),
ph AS (SELECT *, min(CASE WHEN n > {_FEW} THEN minute END) OVER (PARTITION BY provider, run) AS hot, max(minute) OVER (PARTITION BY provider, run) AS last FROM pr),
st AS (SELECT tm.*, run, last, coalesce(tm.minute > hot OR tm.minute = hot AND nth > {_FEW}, FALSE) AS gone FROM tm JOIN ph USING (provider, minute))"""


@query(f"WITH {_STORM} SELECT id, NOT gone AS stored FROM st")
def storm_collapse(spark, sf_dir):
    return storms.guard(log(spark, sf_dir), _FEW, _LONG, _TURN).select("id", "stored")


@query(f"WITH {_STORM} SELECT provider, min(tick) AS start_ts, max(last) + {_LONG} AS end_ts, count(*) AS collapsed FROM st WHERE gone GROUP BY provider, run")
def storm_spans(spark, sf_dir):
    return storms.storms(log(spark, sf_dir), _FEW, _LONG, _TURN).select("provider", "start_ts", "end_ts", "collapsed")


@query(f"WITH {_L} SELECT id, round(count(*) OVER (PARTITION BY provider ORDER BY ts RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) / 60.0::DOUBLE + 1e-7, 4) AS rate_per_s FROM l")
def event_rate_60s(spark, sf_dir):
    return episodes.arrival_rate(log(spark, sf_dir)).select("id", r4("rate_per_s").alias("rate_per_s"))


@query(
    f"WITH {_L}, k AS (SELECT *, provider || ':' || coalesce(event_id, {_HASH.format(m='message')}) AS key FROM l), "
    "g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY key ORDER BY ts, id) <= 1800 THEN 0 ELSE 1 END AS start FROM k), "
    "h AS (SELECT *, sum(start) OVER (PARTITION BY key ORDER BY ts, id)::BIGINT AS episode FROM g) SELECT key, episode, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS occurrences, max(severity) AS severity FROM h GROUP BY ALL"
)
def episodes_sessions(spark, sf_dir):
    return episodes.sessions(log(spark, sf_dir), 1800)


@query(
    f"WITH RECURSIVE {_L}, " + f"k AS (SELECT provider || ':' || coalesce(event_id, {_HASH.format(m='message')}) AS key, ts, count(*) AS n FROM l WHERE severity >= 2 GROUP BY ALL), "
    "m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS i FROM k), "
    # a match of a key: what it closes, whether one is open then, and the matches that wait for confirmation
    "f AS (SELECT key, i, ts, FALSE AS was, NULL::BIGINT AS cleared, CASE WHEN n >= 2 THEN 'open' END AS kind, n >= 2 AS up, ts AS told, 3600 AS cool, CASE WHEN n >= 2 THEN [] ELSE [ts] END AS waits, []::BIGINT[] AS clears FROM m WHERE i = 1 "
    "UNION ALL SELECT key, i, ts, was, cleared, kind, up OR coalesce(kind = 'open', FALSE), CASE WHEN kind IS NULL THEN told ELSE ts END, CASE WHEN kind = 'open' THEN CASE WHEN len(list_filter(clears, lambda t: ts - t <= 600)) >= 3 THEN 14400 ELSE 3600 END ELSE cool END, "
    "CASE WHEN up OR kind = 'open' THEN [] ELSE waits[-2:] END, clears FROM ("
    "SELECT *, CASE WHEN up AND ts - told >= cool THEN 'renotify' WHEN NOT up AND len(waits) >= 2 THEN 'open' END AS kind FROM ("
    "SELECT key, i, ts, was, cleared, up, told, cool, CASE WHEN up THEN [] ELSE list_concat(list_filter(CASE WHEN cleared IS NULL THEN waits ELSE [] END, lambda t: ts - t <= 3600), CASE WHEN n >= 2 THEN [ts, ts] ELSE [ts] END) END AS waits, CASE WHEN cleared IS NULL THEN clears ELSE list_append(clears, cleared)[-5:] END AS clears FROM ("
    "SELECT m.key, m.i, m.ts, m.n, f.up AS was, CASE WHEN f.up AND m.ts - f.ts > 7200 THEN f.ts + 7200 END AS cleared, f.up AND m.ts - f.ts <= 7200 AS up, f.told, f.cool, f.waits, f.clears FROM f JOIN m ON m.key = f.key AND m.i = f.i + 1)))) "
    "SELECT key, kind, ts FROM f WHERE kind IS NOT NULL UNION ALL SELECT key, 'clear', cleared FROM f WHERE cleared IS NOT NULL"
)
def episode_fold(spark, sf_dir):
    rows = log(spark, sf_dir).where("severity >= 2")
    key = scalar.episode_key(F.col("provider"), F.col("event_id"), F.col("message"))
    return episodes.episodes(rows.groupBy(key.alias("key"), "ts").agg(F.count("*").alias("count")), confirm=2, clear_after=7200)


# ---- what is stored


@query(f"WITH {_SU} SELECT entity_id, min(ts) AS first_seen, max(ts) AS last_seen, CASE WHEN {NOW} - max(ts) > 86400 THEN max(ts) + 86401 END AS gone_ts FROM s GROUP BY entity_id")
def entity_lifecycle(spark, sf_dir):
    return upkeep.lifecycle(points(spark, sf_dir, "user_id"), NOW, 86400).select("entity_id", "first_seen", "last_seen", "gone_ts")


_GONE = f"e AS (SELECT entity_id, max(ts) AS last_seen FROM s GROUP BY entity_id HAVING {NOW} - max(ts) > 43200)"


@query(f"WITH {_SU}, {_GONE} SELECT entity_id FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.entity_id = e.entity_id AND s.ts >= {NOW} - 172800) AND NOT EXISTS (SELECT 1 FROM s WHERE s.entity_id = e.entity_id AND s.value > 99.5)")
def reap_anti(spark, sf_dir):
    p = points(spark, sf_dir, "user_id")
    live = p.where("value > 99.5").select("monitor", "entity_id", F.lit("open").alias("state")).distinct()
    return upkeep.reap(upkeep.lifecycle(p, NOW, 43200), upkeep.prune(p, "raw", NOW), live).select("entity_id")


@query(f"WITH {_SU} SELECT DISTINCT entity_id FROM s e WHERE CAST(entity_id AS BIGINT) % 3 > 0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.entity_id = e.entity_id AND s.ts >= {NOW} - 172800 AND s.value < 10) AND NOT EXISTS (SELECT 1 FROM s WHERE s.entity_id = e.entity_id AND s.value > 300)")
def reap_some(spark, sf_dir):
    """Entities of which two in three are gone; of the last two days' observations the low ones are left."""
    p = points(spark, sf_dir, "user_id")
    live = p.where("value > 300").select("monitor", "entity_id", F.lit("open").alias("state")).distinct()
    seen = upkeep.lifecycle(p, NOW, 43200).withColumn("gone_ts", F.when(F.col("entity_id").cast("long") % 3 > 0, F.col("last_seen") + 1))
    return upkeep.reap(seen, upkeep.prune(p.where("value < 10"), "raw", NOW), live).select("entity_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 41 = 0 OR NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)")
def orphans_moved(spark, sf_dir):
    """Orders of which some name a customer that there isn't."""
    moved = F.when(F.col("o_orderkey") % 41 == 0, -1 - F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("c_custkey")
    return upkeep.orphans(table(spark, sf_dir, "orders").select("o_orderkey", moved), table(spark, sf_dir, "customer"), ["c_custkey"]).select("o_orderkey")


@query("SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def orphans(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return upkeep.orphans(table(spark, sf_dir, "customer"), parents, ["c_custkey"]).select("c_custkey")


@query(
    f"WITH {_SU}, m AS (SELECT 'u' || entity_id[1:1] AS monitor, entity_id, max(ts) AS seen FROM s GROUP BY ALL), v AS (SELECT event_type AS monitor, count(DISTINCT user_id) AS series FROM events GROUP BY 1), "
    "n AS (SELECT monitor FROM m UNION SELECT monitor FROM v) "
    f"SELECT n.monitor, coalesce(sum(CASE WHEN seen >= {NOW} - 86400 THEN 1 ELSE 0 END), 0)::BIGINT AS present, coalesce(sum(CASE WHEN seen < {NOW} - 86400 THEN 1 ELSE 0 END), 0)::BIGINT AS gone, coalesce(any_value(series), 0)::BIGINT AS series, (SELECT count(*) FROM n) AS monitors "
    "FROM n LEFT JOIN m ON m.monitor = n.monitor LEFT JOIN v ON v.monitor = n.monitor GROUP BY n.monitor"
)
def monitor_attribution(spark, sf_dir):
    entities = upkeep.lifecycle(points(spark, sf_dir, "user_id"), NOW, 86400).withColumn("monitor", F.concat(F.lit("u"), F.substring("entity_id", 1, 1)))
    kept = table(spark, sf_dir, "events").select(F.col("event_type").alias("monitor"), "user_id").distinct()
    return upkeep.attribution(entities, kept)


@query(f"WITH {_SU} SELECT entity_id, round(avg(value) + 1e-7, 4) AS used FROM s WHERE ts BETWEEN {NOW - 20 * 86400} AND {NOW} GROUP BY entity_id ORDER BY avg(value) DESC, entity_id LIMIT 20")
def top_consumers(spark, sf_dir):
    return store.top_consumers(points(spark, sf_dir, "user_id"), "value", NOW - 20 * 86400, NOW, 20).select("entity_id", r4("used").alias("used"))


@query(f"WITH {_SU} SELECT entity_id, round(max(value) - min(value) + 1e-7, 4) AS used FROM s WHERE ts BETWEEN {NOW - 20 * 86400} AND {NOW} GROUP BY entity_id ORDER BY max(value) - min(value) DESC, entity_id LIMIT 20")
def top_spread(spark, sf_dir):
    return store.top_consumers(points(spark, sf_dir, "user_id"), "value", NOW - 20 * 86400, NOW, 20, spread=True).select("entity_id", r4("used").alias("used"))


_HOURLY = "h AS (SELECT ts // 3600 * 3600 AS ts, entity_id, max(value) AS a, min(value) AS b FROM s GROUP BY ALL)"


@query(f"WITH {_SU}, {_HOURLY}, r AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY a DESC, entity_id) AS ra, row_number() OVER (PARTITION BY ts ORDER BY b DESC, entity_id) AS rb FROM h) SELECT ts, entity_id FROM r WHERE ra <= 5 OR rb <= 5")
def topn_union(spark, sf_dir):
    hourly = points(spark, sf_dir, "user_id").groupBy((F.floor(F.col("ts") / 3600) * 3600).alias("ts"), "entity_id").agg(F.max("value").alias("a"), F.min("value").alias("b"))
    return rules.top_union(hourly, ["a", "b"], 5)


@query(f"WITH {_SU} SELECT entity_id, max(ts) AS ts, arg_max(value, ts) AS value FROM s GROUP BY entity_id")
def latest_per_key(spark, sf_dir):
    return store.latest(points(spark, sf_dir, "user_id")).select("entity_id", "ts", "value")


@query(f"WITH {_SU}, n AS (SELECT entity_id, max(ts) AS ts, arg_max(value, ts) AS value FROM s GROUP BY entity_id) SELECT 'u' || entity_id[1:1] AS monitor, entity_id, ts, value FROM n WHERE ts >= {NOW} - 86400 QUALIFY row_number() OVER (PARTITION BY entity_id[1:1] ORDER BY value DESC, ts DESC, entity_id) = 1")
def glance_latest(spark, sf_dir):
    newest = store.latest(points(spark, sf_dir, "user_id")).withColumn("monitor", F.concat(F.lit("u"), F.substring("entity_id", 1, 1)))
    return store.glance(newest, NOW, 86400).select("monitor", "entity_id", "ts", "value")


@query(f"WITH {_SU} SELECT DISTINCT entity_id, metric FROM s WHERE entity_id > '120' ORDER BY entity_id LIMIT 25")
def keyset_page(spark, sf_dir):
    catalog = samples.series_of(points(spark, sf_dir, "user_id"))
    return store.page(catalog, ("events", "120", "value"), 25).select("entity_id", "metric")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def keep_last_n(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return store.keep_last(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("event_id", "user_id")


@query("SELECT event_type AS entity_id, CAST(floor(epoch(ts)) AS BIGINT) // 60 * 60 AS ts, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def last_write_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.lit("events").alias("monitor"), F.col("event_type").alias("entity_id"), F.lit("value").alias("metric"), (F.floor(samples.epoch(F.col("ts")) / 60) * 60).alias("ts"), "value", "event_id")
    return samples.last_write(rows, "event_id").select("entity_id", "ts", "value")


@query(f"WITH {_R1} SELECT entity_id, bucket AS ts, round(avg + 1e-7, 4) AS value, '5m' AS tier FROM r5 WHERE bucket BETWEEN {NOW - 5 * 86400} AND {NOW}")
def series_tier(spark, sf_dir):
    p = points(spark, sf_dir)
    fives = rollup.rollup_5m(p)
    rows = store.series(p, fives, rollup.rollup_1h(fives), "events", "value", NOW - 5 * 86400, NOW, NOW, False)
    return rows.withColumn("value", r4("value"))


@query(f"WITH {_R1} SELECT entity_id, hour AS ts, max AS value, '1h' AS tier FROM r1 WHERE hour BETWEEN {NOW - 12 * 86400} AND {NOW}")
def series_tier_hours(spark, sf_dir):
    p = points(spark, sf_dir)
    fives = rollup.rollup_5m(p)
    return store.series(p, fives, rollup.rollup_1h(fives), "events", "value", NOW - 12 * 86400, NOW, NOW, False, "max")


@query(f"WITH {_SU} SELECT DISTINCT entity_id FROM s WHERE ts BETWEEN {NOW - 86400} AND {NOW}")
def observed_entities(spark, sf_dir):
    p = points(spark, sf_dir, "user_id")
    return store.observed(p, samples.series_of(p), NOW - 86400, NOW).select("entity_id")


@query(
    f"WITH {_SU}, n AS (SELECT entity_id, count(*) AS points FROM s GROUP BY entity_id ORDER BY entity_id LIMIT 50), w AS (SELECT *, least(points, 60) AS wanted, sum(least(points, 60)) OVER (ORDER BY entity_id) AS upto FROM n) "
    "SELECT entity_id, points, greatest(0, least(wanted, 2000 - (upto - wanted)))::BIGINT AS budget, greatest(0, least(wanted, 2000 - (upto - wanted))) < points AS truncated FROM w"
)
def bounded_response(spark, sf_dir):
    counts = points(spark, sf_dir, "user_id").groupBy("entity_id").agg(F.count("*").alias("points"))
    return store.bounded(counts, 50, 60, 2000)


@query(f"WITH {_SU} SELECT entity_id, arg_max(value, ts) AS current, round(arg_max(value, ts) - arg_min(value, ts) + 1e-7, 4) AS change, min(value) AS min, max(value) AS max, CASE WHEN arg_max(value, ts) > arg_min(value, ts) THEN 'rising' WHEN arg_max(value, ts) < arg_min(value, ts) THEN 'falling' ELSE 'steady' END AS direction FROM s GROUP BY entity_id")
def series_summary(spark, sf_dir):
    return store.summary(points(spark, sf_dir, "user_id")).withColumn("change", r4("change"))


@query(f"WITH {_R1}, g AS (SELECT entity_id, hour AS ts, max AS value, lead(hour) OVER (PARTITION BY entity_id ORDER BY hour) AS next FROM r1) SELECT entity_id, ts, value FROM g UNION ALL SELECT entity_id, ts + 3600, NULL FROM g WHERE next - ts > 5400")
def gap_points(spark, sf_dir):
    hours = rollup.rollup_1h(rollup.rollup_5m(points(spark, sf_dir)))
    return store.gaps(hours.select("entity_id", F.col("bucket").alias("ts"), F.col("max").alias("value")), 3600)


@query(
    f"WITH {_R1}, g AS (SELECT entity_id, hour AS ts, CASE WHEN hour - lag(hour) OVER (PARTITION BY entity_id ORDER BY hour) = 3600 THEN 0 ELSE 1 END AS start FROM r1), "
    "h AS (SELECT *, sum(start) OVER (PARTITION BY entity_id ORDER BY ts)::BIGINT AS run FROM g) SELECT entity_id, run, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS points FROM h GROUP BY ALL"
)
def runs(spark, sf_dir):
    hours = rollup.rollup_1h(rollup.rollup_5m(points(spark, sf_dir)))
    return store.runs(hours.select("entity_id", F.col("bucket").alias("ts")), 3600)


@query(
    f"WITH {_S}, g AS (SELECT entity_id, ts, CASE WHEN count(*) OVER w >= 3 THEN regr_slope(value, ts - 1704067200) OVER w * 3600 END AS rate, 100 - value AS remaining FROM s {_W6}) "
    "SELECT entity_id, ts, round(CASE WHEN rate > 0.5 THEN remaining / rate END + 1e-7, 4) AS hours FROM g WHERE rate IS NOT NULL"
)
def trend_projection(spark, sf_dir):
    p = points(spark, sf_dir)
    rate = running.with_window(p, SIX_H).withColumn("rate", running.slope() * 3600).where("rate is not null")
    rate = rate.select("entity_id", "ts", F.when(F.col("rate") > 0.5, F.col("rate")).otherwise(0.0).alias("value"))
    left = p.select("entity_id", "ts", (100 - F.col("value")).alias("value"))
    return store.projection(rate, left).select("entity_id", "ts", r4("hours").alias("hours"))


@query(
    f"WITH {_R1} SELECT entity_id, '1h' AS tier, hour AS ts, round(avg + 1e-7, 4) AS value, min AS lower, max AS upper, FALSE AS downsampled FROM r1 WHERE hour BETWEEN {NOW - 20 * 86400} AND {NOW}"
)
def series_answer(spark, sf_dir):
    p = points(spark, sf_dir)
    fives = rollup.rollup_5m(p)
    rows = store.answer(p, fives, rollup.rollup_1h(fives), "events", "value", NOW - 20 * 86400, NOW, NOW, False)
    return rows.withColumn("value", r4("value"))


@query(
    f"WITH {_R1}, p AS (SELECT entity_id, hour AS ts, avg, avg - lag(avg) OVER (PARTITION BY entity_id ORDER BY hour) AS rate FROM r1), q AS (SELECT * FROM p WHERE ts BETWEEN {NOW - 20 * 86400} AND {NOW}), "
    "a AS (SELECT entity_id, 'value' AS panel, ts, avg AS value FROM q UNION ALL SELECT entity_id, 'rate', ts, rate FROM q WHERE rate IS NOT NULL UNION ALL SELECT entity_id, 'remaining', ts, 100 - avg FROM q "
    "UNION ALL SELECT entity_id, 'projection', ts, CASE WHEN rate > 0 THEN (100 - avg) / rate END FROM q WHERE rate IS NOT NULL) SELECT entity_id, panel, ts, round(value + 1e-7, 4) AS value FROM a"
)
def trend_panels(spark, sf_dir):
    fives = rollup.rollup_5m(points(spark, sf_dir))
    hours = rollup.rollup_1h(fives)
    rise = F.col("avg") - F.lag("avg").over(W.partitionBy("monitor", "entity_id").orderBy("bucket"))
    as_metric = lambda name, v: hours.select("monitor", "entity_id", F.lit(name).alias("metric"), "bucket", v.alias("avg"), v.alias("min"), v.alias("max"))
    both = as_metric("value", F.col("avg")).unionByName(as_metric("left", 100 - F.col("avg"))).unionByName(as_metric("rate", rise).where("avg is not null"))
    profile = Trend("t", "value", "rate", "left")
    return store.trend(points(spark, sf_dir), fives, both, "events", profile, NOW - 20 * 86400, NOW, NOW, False).select("entity_id", "panel", "ts", r4("value").alias("value"))


@query(f"WITH {_R1} SELECT entity_id, hour AS ts, min, max FROM r1 QUALIFY hour = max(hour) OVER (PARTITION BY entity_id, hour // 86400)")
def envelope(spark, sf_dir):
    hours = rollup.rollup_1h(rollup.rollup_5m(points(spark, sf_dir))).withColumnRenamed("bucket", "ts")
    shown = hours.groupBy("entity_id", F.floor(F.col("ts") / 86400)).agg(F.max("ts").alias("ts"))  # the last point of each day
    return store.envelope(hours.select("entity_id", "ts", "min", "max"), hours.join(shown, ["entity_id", "ts"], "left_semi"))


#: The points that a line of 20 keeps, as CTE q: bucket by bucket the one of the largest triangle with the last kept and the mean of the next bucket.
_SHOWN = _SU + """,
p AS MATERIALIZED (SELECT entity_id, ts, value, row_number() OVER (PARTITION BY entity_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY entity_id) AS size FROM s),
g AS (SELECT entity_id, any_value(size) AS size, (any_value(size) - 2) / 18.0::DOUBLE AS step FROM p GROUP BY entity_id HAVING any_value(size) > 20),
b AS (SELECT entity_id, size, k, floor(k * step)::BIGINT + 1 AS lo, floor((k + 1) * step)::BIGINT + 1 AS hi, least(floor((k + 2) * step)::BIGINT + 1, size) AS nx FROM g, range(18) AS t(k)),
n AS MATERIALIZED (SELECT b.entity_id, k, lo, hi, avg(p.ts) AS mx, avg(p.value) AS my FROM b JOIN p ON p.entity_id = b.entity_id AND p.i >= least(hi, b.size - 1) AND p.i < CASE WHEN hi < b.size - 1 THEN nx ELSE b.size END GROUP BY ALL),
r AS (
  SELECT entity_id, -1::BIGINT AS k, ts, value FROM p WHERE i = 0 AND size > 20
  UNION ALL
  SELECT entity_id, k, best.t, best.v FROM (
    SELECT r.entity_id, n.k, arg_max({'t': p.ts, 'v': p.value}, abs((r.ts - mx) * (p.value - r.value) - (r.ts - p.ts) * (my - r.value))) AS best
    FROM r JOIN n ON n.entity_id = r.entity_id AND n.k = r.k + 1 JOIN p ON p.entity_id = n.entity_id AND p.i >= lo AND p.i < hi GROUP BY r.entity_id, n.k)),
q AS (SELECT entity_id, ts, value FROM r UNION ALL SELECT entity_id, ts, value FROM p WHERE size <= 20 OR i = size - 1)"""


@query(f"WITH RECURSIVE {_SHOWN} SELECT entity_id, ts, value FROM q")
def lttb(spark, sf_dir):
    return store.downsample(points(spark, sf_dir, "user_id"), 20)


_CASES = "i AS (SELECT id, ts AS opened_ts FROM l WHERE provider = 'error')"


@query(f"WITH {_L}, {_CASES} SELECT i.id AS incident, l.id, l.ts - i.opened_ts AS offset_s FROM i JOIN l ON l.ts BETWEEN i.opened_ts - 600 AND i.opened_ts + 600")
def incident_context(spark, sf_dir):
    rows = log(spark, sf_dir)
    cases = rows.where("provider = 'error'").select(F.col("id").alias("incident"), F.col("ts").alias("opened_ts"))
    return store.context(cases, rows.select("id", "ts")).select("incident", "id", (F.col("ts") - F.col("opened_ts")).alias("offset_s"))


@query(
    "WITH t AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) // 86400 AS day FROM events GROUP BY ALL), d AS (SELECT DISTINCT day FROM t), u AS (SELECT DISTINCT user_id FROM events) "
    "SELECT u.user_id, d.day, CASE WHEN t.user_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS present FROM u CROSS JOIN d LEFT JOIN t ON t.user_id = u.user_id AND t.day = d.day"
)
def watchlist_presence(spark, sf_dir):
    seen = table(spark, sf_dir, "events").select("user_id", F.floor(samples.epoch(F.col("ts")) / 86400).alias("day")).distinct()
    days = seen.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    users = seen.groupBy("user_id").agg(F.max("day").alias("_d")).select("user_id", F.lit(1).alias("one"))
    expected = users.join(F.broadcast(days.withColumn("one", F.lit(1))), "one").select("user_id", F.explode(F.sequence("lo", "hi")).alias("day"))  # one row of days
    return samples.watch(expected, seen, ["user_id", "day"])


@query("SELECT user_id, count(*) AS conn_total, count(*) FILTER (WHERE event_type = 'view') AS conn_established, count(*) FILTER (WHERE event_type = 'click') AS conn_time_wait, count(*) FILTER (WHERE event_type = 'error') AS conn_listen FROM events GROUP BY user_id")
def connection_counts(spark, sf_dir):
    names = {"view": "ESTABLISHED", "click": "TIME_WAIT", "error": "LISTEN"}
    rows = table(spark, sf_dir, "events").select("user_id", scalar.from_map(F.col("event_type"), names).alias("status"))
    return samples.connection_counts(rows, ["user_id"])


_CHANNELS = "(VALUES ('file', 4), ('desktop', 2), ('mail', 3)) AS c(channel, min_severity)"


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).where("severity >= 1").select(F.col("id").alias("notification_id"), "ts", "severity", F.col("provider").alias("title"))


def _channels(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM (VALUES ('file', 4), ('desktop', 2), ('mail', 3)) AS c(channel, min_severity)")


@query(f"WITH {_L} SELECT l.id AS notification_id, c.channel FROM l JOIN {_CHANNELS} ON l.severity >= c.min_severity OR c.channel = 'file' WHERE l.severity >= 1")
def fanout(spark, sf_dir):
    return upkeep.fan_out(_notes(spark, sf_dir), _channels(spark)).select("notification_id", "channel")


@query(
    f"WITH {_L}, f AS (SELECT l.id, l.ts, l.severity, l.provider AS title, c.channel FROM l JOIN {_CHANNELS} ON l.severity >= c.min_severity OR c.channel = 'file' WHERE l.severity BETWEEN 1 AND 2 AND (l.ts % 86400 // 60 >= 1320 OR l.ts % 86400 // 60 < 420)) "
    ", n AS (SELECT (ts - 79200) // 86400 AS day, id, ts, severity, any_value(title) AS title FROM f GROUP BY ALL) "
    "SELECT day, count(*) AS n, max(severity) AS severity, count(*) || ' notification(s) held during quiet hours' AS title, "
    "left('worst: ' || (['info', 'notice', 'warning', 'error', 'critical'])[max(severity) + 1] || ' — ' || string_agg(title, '; ' ORDER BY ts, id), 200) AS body, "
    "(SELECT string_agg(DISTINCT channel, ',' ORDER BY channel) FROM f WHERE (f.ts - 79200) // 86400 = n.day) AS channels FROM n GROUP BY day"
)
def quiet_digest(spark, sf_dir):
    made = upkeep.digest(upkeep.fan_out(_notes(spark, sf_dir), _channels(spark)), "22:00-07:00")
    return made.withColumn("channels", F.array_join("channels", ","))


@query(
    f"WITH a AS (SELECT user_id, event_type, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value, row_number() OVER p AS nth, min(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id, event_type) AS created, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events WINDOW p AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)), "
    "b AS (SELECT *, ts + 5 AS finished, CASE WHEN value < 5 THEN NULL WHEN value < 60 THEN 'retryable' WHEN value < 110 THEN 'ok' ELSE 'permanent' END AS result FROM a WHERE nth = n), "
    "c AS (SELECT *, greatest(finished + ([30, 120, 600, 3600, 21600])[least(n, 5)], CASE WHEN event_id % 5 = 0 THEN ts + 900 ELSE 0 END) AS due FROM b), "
    f"d AS (SELECT *, CASE WHEN result IS NULL THEN CASE WHEN ts < {NOW - 5 * 86400} THEN 'pending' ELSE 'sending' END WHEN result = 'ok' THEN 'delivered' WHEN result = 'permanent' OR (event_type <> 'view' AND due > created + 86400 * 25) THEN 'failed' ELSE 'pending' END AS state FROM c) "
    "SELECT user_id AS notification_id, CASE event_type WHEN 'view' THEN 'file' ELSE event_type END AS channel, state, n::INT AS attempts, CASE WHEN state = 'pending' THEN CASE WHEN result IS NULL THEN ts ELSE due END END AS next_ts, CASE WHEN state = 'delivered' THEN finished END AS delivered_ts FROM d"
)
def delivery_standing(spark, sf_dir):
    """Each user's events of a type as attempts of one delivery, created late enough for some to be within the lifetime."""
    nth = F.row_number().over(W.partitionBy("notification_id", "channel").orderBy("ts", "event_id"))
    result = F.when(F.col("value") < 5, None).when(F.col("value") < 60, "retryable").when(F.col("value") < 110, "ok").otherwise("permanent")
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("notification_id"), F.when(F.col("event_type") == "view", "file").otherwise(F.col("event_type")).alias("channel"), "event_id", samples.epoch(F.col("ts")).alias("at"), "ts", "value")
    attempts = ev.select("notification_id", "channel", nth.alias("attempt"), F.col("at").alias("claimed_ts"), result.alias("result"), (F.col("at") + 5).alias("finished_ts"), F.when(F.col("event_id") % 5 == 0, F.col("at") + 900).alias("retry_at"))
    deliveries = ev.groupBy("notification_id", "channel").agg((F.min("at") + 24 * 86400).alias("created_ts"))
    return outbox.standing(deliveries, attempts, NOW - 5 * 86400)


@query(
    "WITH a AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, (event_id % 8)::INT AS attempts, CASE WHEN event_id % 5 = 0 THEN 700 END AS retry_after, CAST(floor(epoch(ts)) AS BIGINT) - event_id % 9 * 10000 AS created FROM events), "
    "b AS (SELECT *, ts + greatest(([30, 120, 600, 3600, 21600])[least(greatest(attempts, 1), 5)], coalesce(retry_after, 0)) AS due FROM a) SELECT event_id, CASE WHEN due - created <= 86400 THEN due END AS next_ts FROM b"
)
def retry_schedule(spark, sf_dir):
    ts, e = samples.epoch(F.col("ts")), F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", upkeep.next_attempt(ts, e % 8, F.when(e % 5 == 0, 700), ts - e % 9 * 10000).alias("next_ts"))


@query(
    f"WITH {_L}, f AS (SELECT l.ts, l.severity, c.channel, CASE l.id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'sent' ELSE 'failed' END AS state, l.ts + 3600 AS next_ts FROM l JOIN {_CHANNELS} ON l.severity >= c.min_severity OR c.channel = 'file' WHERE l.severity >= 1) "
    f"SELECT channel, count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state = 'pending' AND severity > 2 AND next_ts <= {NOW}) AS due, count(*) FILTER (WHERE state = 'pending' AND severity <= 2) AS quiet_held, count(*) FILTER (WHERE state = 'failed') AS failed, max(CASE WHEN state = 'pending' THEN {NOW} - ts END) AS oldest_age FROM f GROUP BY channel"
)
def backlog(spark, sf_dir):
    rows = upkeep.fan_out(_notes(spark, sf_dir), _channels(spark))
    state = F.element_at(F.array(F.lit("pending"), F.lit("sent"), F.lit("failed")), (F.col("notification_id") % 3 + 1).cast("int"))
    return upkeep.backlog(rows.withColumns({"state": state, "next_ts": F.col("ts") + 3600}), NOW, "22:00-07:00")


@query(
    f"WITH {_SU}, b AS (SELECT entity_id, ts AS at, value FROM s), t AS (SELECT DISTINCT entity_id, ts // 3600 * 3600 AS ts FROM s) "
    "SELECT t.entity_id, t.ts, b.value FROM t ASOF LEFT JOIN b ON t.entity_id = b.entity_id AND t.ts >= b.at"
)
def scenario_asof(spark, sf_dir):
    p = points(spark, sf_dir, "user_id")
    lines = p.select("entity_id", F.col("ts").alias("at"), "value")
    ticks = p.select("entity_id", (F.floor(F.col("ts") / 3600) * 3600).alias("ts")).distinct()
    return samples.state_in_force(ticks, lines, ["entity_id"], "value").select("entity_id", "ts", "value")


@query(f"WITH {_R5} SELECT entity_id, bucket FROM r5 WHERE bucket >= {NOW} - CASE WHEN entity_id IN ('error', 'purchase') THEN 2592000 ELSE 604800 END")
def retention_prune(spark, sf_dir):
    fives = rollup.rollup_5m(points(spark, sf_dir))
    return upkeep.prune(fives, "5m", NOW, "bucket", F.col("entity_id").isin("error", "purchase")).select("entity_id", "bucket")


@query(
    f"WITH c AS (SELECT DISTINCT CAST(o_custkey % 50 AS VARCHAR) AS entity_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 3 = 0) "
    f"SELECT r5.entity_id, bucket FROM (SELECT CAST(user_id % 50 AS VARCHAR) AS entity_id, CAST(floor(epoch(ts)) AS BIGINT) // 300 * 300 AS bucket FROM events GROUP BY ALL) r5 LEFT JOIN c USING (entity_id) WHERE bucket >= {NOW} - CASE WHEN c.entity_id IS NOT NULL THEN 2592000 ELSE 604800 END"
)
def retention_classes(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select((F.col("user_id") % 50).cast("string").alias("series_id"), rollup.bucket(samples.epoch(F.col("ts")), 300).alias("bucket")).distinct()
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_custkey % 3 = 0").select((F.col("o_custkey") % 50).cast("string").alias("series_id"), F.lit(True).alias("durable")).distinct()
    return stored.keep_by_class(ev, urgent, "5m", NOW, "bucket").select(F.col("series_id").alias("entity_id"), "bucket")


@query(
    "WITH d AS (SELECT CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN 2 ELSE 3 END AS step, CAST(floor(epoch(ts)) AS BIGINT) // 86400 AS day, count(*) * 35 AS bytes FROM events GROUP BY ALL), "
    "t AS (SELECT *, sum(bytes) OVER () - (SELECT sum(bytes) // 2 FROM d) AS over_by, sum(bytes) OVER (ORDER BY step, day) - bytes AS before FROM d) SELECT step, day, bytes, before < over_by AS dropped FROM t"
)
def budget_degrade(spark, sf_dir):
    step = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    days = table(spark, sf_dir, "events").groupBy(step.alias("step"), F.floor(samples.epoch(F.col("ts")) / 86400).alias("day")).agg((F.count("*") * 35).alias("bytes"))
    return upkeep.degrade(days, days.agg(F.floor(F.sum("bytes") / 2)).first()[0])


@query(
    "WITH d AS (SELECT CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN 2 ELSE 3 END AS step, CAST(floor(epoch(ts)) AS BIGINT) // 86400 AS day, count(*) * 35 AS bytes FROM events GROUP BY ALL), "
    f"m AS (SELECT *, (step = 1 AND (day + 1) * 86400 <= {NOW - 86400}) OR (step = 2 AND (day + 1) * 86400 <= {NOW - 7 * 86400}) OR step = 3 AS may FROM d), "
    "t AS (SELECT *, sum(bytes) OVER () - 1000 AS over_by, sum(CASE WHEN may THEN bytes ELSE 0 END) OVER (ORDER BY step, day ROWS UNBOUNDED PRECEDING) - CASE WHEN may THEN bytes ELSE 0 END AS before FROM m) SELECT step, day, bytes, may AND before < over_by AS dropped FROM t"
)
def budget_guards(spark, sf_dir):
    step = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    days = table(spark, sf_dir, "events").groupBy(step.alias("step"), F.floor(samples.epoch(F.col("ts")) / 86400).alias("day")).agg((F.count("*") * 35).alias("bytes"))
    return upkeep.degrade(days, 1000, NOW)


@query(
    f"WITH {_L}, h AS (SELECT provider, id, ts, severity, row_number() OVER (PARTITION BY provider ORDER BY id) AS seq, count(*) OVER (PARTITION BY provider) AS n FROM l), "
    "k AS (SELECT provider, seq, ts, ts AS last_ts, 1 AS count, 'event' AS kind FROM h WHERE NOT (n > 500 AND seq <= 100) UNION ALL SELECT provider, min(seq), min(ts), max(ts), count(*), 'collapsed' FROM h WHERE n > 500 AND seq <= 100 GROUP BY provider) "
    "SELECT provider, seq, ts, last_ts, count::BIGINT AS count, kind FROM k"
)
def history_cap(spark, sf_dir):
    rows = log(spark, sf_dir).select("provider", "ts", "severity", F.lit("event").alias("kind"), F.row_number().over(W.partitionBy("provider").orderBy("id")).cast("long").alias("seq"))
    return upkeep.fold_history(rows, ["provider"]).select("provider", "seq", "ts", "last_ts", "count", "kind")


@query(
    "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events) "
    "SELECT event_type, max(CASE WHEN place = round_even(0.5::DOUBLE * (n - 1), 0) THEN value END) AS p50, max(CASE WHEN place = round_even(0.95::DOUBLE * (n - 1), 0) THEN value END) AS p95, max(value) AS p100 FROM r GROUP BY event_type"
)
def percentile_nearest_rank(spark, sf_dir):
    return store.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value")


@query(
    "WITH c AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) // 86400 * 86400 AS ts, event_type AS metric, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL), "
    "r AS (SELECT *, sum(n) OVER (PARTITION BY user_id, metric ORDER BY ts) AS value FROM c), b AS (SELECT user_id, ts FROM r GROUP BY ALL HAVING count(*) = 2), "
    "x AS (SELECT r.* FROM r JOIN b USING (user_id, ts)) SELECT user_id::VARCHAR AS entity_id, metric, round(CASE WHEN max(ts) > min(ts) THEN (arg_max(value, ts) - arg_min(value, ts)) * 86400 / (max(ts) - min(ts))::DOUBLE END + 1e-7, 4) AS per_day FROM x GROUP BY ALL"
)
def stage_rates(spark, sf_dir):
    day = (F.floor(samples.epoch(F.col("ts")) / 86400) * 86400).alias("ts")
    daily = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click")).groupBy(F.col("user_id").cast("string").alias("entity_id"), day, F.col("event_type").alias("metric")).agg(F.count("*").alias("n"))
    grown = daily.withColumn("value", F.sum("n").over(W.partitionBy("entity_id", "metric").orderBy("ts")).cast("double"))
    return store.stage_rates(grown, ["view", "click"]).select("entity_id", "metric", r4(F.col("rate") * 86400).alias("per_day"))


@query(
    "WITH p AS (SELECT 'u' || (user_id % 7) AS monitor, max(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 0 END) AS state, count(*) % 5 = 0 AS unknown, count(*) % 3 = 0 AS disabled FROM events GROUP BY 1) "
    "SELECT monitor, CASE WHEN unknown THEN 'unknown' WHEN disabled THEN 'disabled' WHEN state >= 3 THEN 'error' WHEN state IS NOT NULL THEN 'warning' ELSE 'clear' END AS health FROM p"
)
def health_states(spark, sf_dir):
    state = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 0)
    rows = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("monitor")).agg(F.max(state).alias("state"), F.count("*").alias("n"))
    return rows.select("monitor", upkeep.health(F.col("state"), F.lit(False), F.col("n") % 5 == 0, F.col("n") % 3 == 0).alias("health"))


@query("SELECT event_id, 'event ' || event_type || ' at ' || printf('%.2f', value) || ' of ' || CASE WHEN event_id % 4 > 0 THEN printf('%.0f', (event_id % 4)::DOUBLE) ELSE 'n/a' END AS message FROM events")
def render_message(spark, sf_dir):
    part = F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 4)
    return table(spark, sf_dir, "events").select("event_id", scalar.render(["event ", (F.col("event_type"), None), " at ", (F.col("value"), 2), " of ", (part, 0)]).alias("message"))


@query(
    "SELECT event_id, left(event_type || ' ' || lpad(printf('%.1f', value), 8, ' ') || ' {' || CASE WHEN event_id % 4 > 0 THEN printf('%+.3f', value - 50) ELSE 'n/a' END || '} ' || rpad(event_type, 9, '.') || ' ' || printf('%05d', event_id % 1000) || ' n/a', 200) AS message FROM events"
)
def message_template(spark, sf_dir):
    over = F.when(F.col("event_id") % 4 > 0, F.col("value") - 50)
    columns = {"kind": (F.col("event_type"), "text"), "value": (F.col("value"), "number"), "over": (over, "number"), "n": (F.col("event_id") % 1000, "whole")}
    return table(spark, sf_dir, "events").select("event_id", scalar.render_template("{kind} {value:8.1f} {{{over:+.3f}}} {kind:.<9} {n:05d} {none:.2f}", columns).alias("message"))


@query("SELECT event_id, printf('%.2f', value / 8)::DOUBLE AS r2, printf('%.0f', value * 2)::DOUBLE AS r0, printf('%.1f', floor(value) / 4)::DOUBLE AS r1 FROM events")
def round_exact(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", scalar.roundv(v / 8, 2).alias("r2"), scalar.roundv(v * 2, 0).alias("r0"), scalar.roundv(F.floor(v).cast("double") / 4, 1).alias("r1"))


@query("SELECT event_id, CASE WHEN event_id % 4 > 0 THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 4 = 0 THEN 'not json' END AS malformed FROM events")
def attrs_json(spark, sf_dir):
    text = F.when(F.col("event_id") % 4 > 0, F.col("props")).otherwise("not json")
    rows = table(spark, sf_dir, "events").select("event_id", logs.attrs_of(text).alias("m"))
    return rows.select("event_id", F.col("m")["k"].alias("k"), F.col("m")["malformed"].alias("malformed"))


# ---- raw inputs made from the events


@query(
    "SELECT 'c' || event_id AS cursor, CAST(floor(epoch(ts)) AS BIGINT) AS ts, ([4, 4, 4, 3, 2, 1, 0, 0])[event_id % 8 + 1] AS severity, event_type AS provider, 'value ' || value::VARCHAR AS message FROM events WHERE event_id % 11 > 0"
)
def parse_journal(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.to_json(F.struct(
        F.when(F.col("event_id") % 11 > 0, F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("__CURSOR"), (samples.epoch(F.col("ts")) * 1_000_000 + 5).cast("string").alias("__REALTIME_TIMESTAMP"),
        (F.col("event_id") % 8).cast("string").alias("PRIORITY"), F.col("event_type").alias("SYSLOG_IDENTIFIER"), F.concat(F.lit("value "), F.col("value").cast("string")).alias("MESSAGE"),
    ))
    return logs.parse_journal(e.select(line.alias("value"))).select("cursor", "ts", "severity", "provider", "message")


@query("SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts, (([4, 3, 2, 0, 0])[event_id % 5 + 1]) AS severity, event_type AS provider, CAST(event_id AS VARCHAR) AS event_id, 'user=' || user_id || '; kind=' || event_type AS message FROM events")
def parse_xml(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    time = F.date_format(F.timestamp_seconds(samples.epoch(F.col("ts"))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    xml = F.format_string(
        "<Event xmlns='urn:e'><System><Provider Name='%s'/><EventID>%d</EventID><Level>%d</Level><TimeCreated SystemTime='%s'/></System><EventData><Data Name='user'>%d</Data><Data Name='kind'>%s</Data></EventData></Event>",
        F.col("event_type"), F.col("event_id"), F.col("event_id") % 5 + 1, time, F.col("user_id"), F.col("event_type"),
    )
    return logs.parse_event_xml(e.select(xml.alias("value"))).select("ts", "severity", "provider", "event_id", "message")


@query(
    "SELECT event_id, 'load one' AS label, value, '' AS unit, 80.0::DOUBLE AS warn, 90.0::DOUBLE AS crit FROM events UNION ALL SELECT event_id, 'size', user_id::DOUBLE, 'KB', NULL, NULL FROM events WHERE event_id % 2 = 0"
)
def parse_perfdata(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    twice = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit(" size=1KB size="), F.col("user_id").cast("string"), F.lit("KB"))).otherwise(F.concat(F.lit(" size="), F.col("user_id").cast("string"), F.lit("KB")))
    out = F.concat(F.lit("OK fine|'load one'="), F.col("value").cast("string"), F.lit(";80;90;0;100"), twice)
    return logs.parse_perfdata(e.select("event_id", out.alias("output")), keys=("event_id",)).select("event_id", "label", "value", "unit", "warn", "crit")


# ---- lists, searches and summaries


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.lifecycle(points(spark, sf_dir, "user_id"), NOW, 86400)


_ENT = f"en AS (SELECT entity_id, min(ts) AS first_seen, max(ts) AS last_seen, CASE WHEN {NOW} - max(ts) > 86400 THEN max(ts) + 86401 END AS gone_ts FROM s GROUP BY entity_id)"


@query(f"WITH {_SU}, {_ENT} SELECT 'proc:' || entity_id || ':7' AS entity_id, last_seen FROM en WHERE entity_id = '12' UNION ALL (SELECT 'proc:' || entity_id || ':7', last_seen FROM en WHERE contains('proc:' || entity_id || ':7', 'oc:1') ORDER BY last_seen DESC, 'proc:' || entity_id || ':7' LIMIT 20)")
def find_entities(spark, sf_dir):
    rows = _entities(spark, sf_dir).select(F.concat(F.lit("proc:"), F.col("entity_id"), F.lit(":7")).alias("entity_id"), "last_seen")
    return lookups.find_entities(rows, "12").union(lookups.find_entities(rows, "OC:1"))


@query(f"WITH {_L} SELECT id, ts, severity FROM l WHERE ts BETWEEN {NOW - 20 * 86400} AND {NOW} AND severity >= 2 AND provider = 'error' ORDER BY ts DESC, id DESC LIMIT 200")
def list_events(spark, sf_dir):
    return lookups.list_events(log(spark, sf_dir), NOW - 20 * 86400, NOW, 2, "error").select("id", "ts", "severity")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.summary(incidents.ladder(_states(spark, sf_dir)))


_SUM = _LADDER + """,
su AS (SELECT entity_id, grp, incident, min(ts) AS opened_ts, max(ts) AS last_change_ts, max(CASE WHEN kind = 'clear' THEN ts END) AS cleared_ts, max(severity) AS peak_severity FROM t GROUP BY ALL)"""


@query(f"WITH {_SUM} SELECT entity_id, grp, incident FROM su WHERE cleared_ts IS NULL AND last_change_ts >= {NOW - 10 * 86400}")
def list_incidents(spark, sf_dir):
    return lookups.list_incidents(_cases(spark, sf_dir), "open", "events", NOW - 10 * 86400).select("entity_id", "grp", "incident")


@query(f"WITH {_SUM} SELECT entity_id, grp, incident FROM su WHERE (cleared_ts IS NULL OR cleared_ts >= {NOW - 10 * 86400}) AND opened_ts <= {NOW - 9 * 86400}")
def incidents_overlapping(spark, sf_dir):
    return lookups.overlapping(_cases(spark, sf_dir), NOW - 10 * 86400, NOW - 9 * 86400).select("entity_id", "grp", "incident")


@query(f"WITH {_SU}, {_ENT} SELECT entity_id, last_seen FROM en WHERE gone_ts IS NULL AND last_seen >= {NOW} - 43200")
def list_entities(spark, sf_dir):
    return lookups.list_entities(_entities(spark, sf_dir), True, NOW - 43200).select("entity_id", "last_seen")


@query("SELECT count(DISTINCT user_id) AS series, FALSE AS durable FROM events WHERE isfinite(value)")
def cohort_durability(spark, sf_dir):
    return lookups.cohort(samples.series_of(points(spark, sf_dir, "user_id")), "events", "value")


@query(f"WITH {_SU} SELECT entity_id, least(count(*), 40) AS points FROM s WHERE ts BETWEEN {NOW - 20 * 86400} AND {NOW} GROUP BY entity_id")
def point_counts(spark, sf_dir):
    return lookups.point_counts(points(spark, sf_dir, "user_id"), NOW - 20 * 86400, NOW, 40)


@query(f"WITH {_SU} SELECT entity_id, round(min(value) - CASE WHEN max(value) > min(value) THEN (max(value) - min(value)) * 0.05::DOUBLE ELSE 1 END + 1e-7, 4) AS lo, round(max(value) + CASE WHEN max(value) > min(value) THEN (max(value) - min(value)) * 0.05::DOUBLE ELSE 1 END + 1e-7, 4) AS hi FROM s GROUP BY entity_id")
def y_domain(spark, sf_dir):
    return lookups.y_domain(points(spark, sf_dir, "user_id"), ["entity_id"]).select("entity_id", r4("lo").alias("lo"), r4("hi").alias("hi"))


@query(f"WITH {_SUM} SELECT (SELECT {NOW} - max(ts) FROM s) AS tick_age, (SELECT count(*) FROM s) AS samples, count(*) AS open_incidents, CASE WHEN max(peak_severity) >= 3 THEN 2 WHEN max(peak_severity) >= 0 THEN 1 ELSE 0 END AS exit_code FROM su WHERE cleared_ts IS NULL")
def status(spark, sf_dir):
    return lookups.status(points(spark, sf_dir, "user_id"), _cases(spark, sf_dir), NOW)


_HEALTH = SQL["health_states"]


@query(f"WITH h AS ({_HEALTH}) SELECT count(*) FILTER (WHERE health IN ('error', 'warning', 'unknown', 'config-error')) AS attention, count(*) FILTER (WHERE health = 'clear') AS clear, count(*) FILTER (WHERE health = 'disabled') AS disabled FROM h")
def dashboard_summary(spark, sf_dir):
    return lookups.dashboard(health_states(spark, sf_dir))


@query(f"WITH h AS ({_HEALTH}) SELECT monitor, health, row_number() OVER (ORDER BY list_position(['error', 'warning', 'unknown', 'config-error', 'disabled', 'clear'], health), monitor) AS place FROM h")
def tile_order(spark, sf_dir):
    return lookups.tiles(health_states(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@query(
    f"WITH {_SU}, g AS (SELECT entity_id, ts, CASE WHEN ts % 5 > 0 THEN value END AS value FROM s), k AS (SELECT *, row_number() OVER w - 1 AS nth, value IS NULL AS gap, lag(value IS NULL) OVER w AS before, lead(value IS NULL) OVER w AS after FROM g WINDOW w AS (PARTITION BY entity_id ORDER BY ts)) "
    "SELECT entity_id, ts, value FROM k WHERE nth % 10 = 0 OR gap IS DISTINCT FROM before OR gap IS DISTINCT FROM after"
)
def projection_cap(spark, sf_dir):
    rows = points(spark, sf_dir, "user_id").select("entity_id", "ts", F.when(F.col("ts") % 5 > 0, F.col("value")).alias("value"))
    return lookups.thin(rows, 10, ["entity_id"])


@query(f"WITH {_SU} SELECT entity_id, ts // 86400 AS day, count(*) AS points FROM s GROUP BY ALL HAVING count(*) < 3")
def sparse_days(spark, sf_dir):
    return lookups.sparse(points(spark, sf_dir, "user_id").withColumn("day", F.floor(F.col("ts") / 86400)), ["entity_id", "day"], 3)


@query(f"WITH {_R1.replace('event_type', 'user_id::VARCHAR')}, v AS (SELECT entity_id FROM s GROUP BY entity_id HAVING {NOW} - max(ts) > 86400 AND max(ts) + 86401 < {NOW} - 172800) SELECT entity_id, hour AS bucket FROM r1 WHERE entity_id NOT IN (SELECT entity_id FROM v)")
def expire_gone(spark, sf_dir):
    hours = rollup.rollup_1h(rollup.rollup_5m(points(spark, sf_dir, "user_id")))
    return lookups.expire_gone(hours, _entities(spark, sf_dir), NOW, 172800).select("entity_id", "bucket")


@query(
    "WITH c AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) // 7200 * 7200 AS ts, sum(CASE WHEN value > 90 THEN 1 ELSE 0 END)::BIGINT AS more FROM events GROUP BY ALL), g AS (SELECT event_type, ts, more, sum(CASE WHEN more <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts) AS calm FROM c) "
    "SELECT event_type, min(ts) AS start_ts, max(ts) AS end_ts, sum(more)::BIGINT AS lost FROM g WHERE more > 0 GROUP BY event_type, calm"
)
def overflow_episodes(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("event_type", (F.floor(samples.epoch(F.col("ts")) / 7200) * 7200).alias("ts")).agg(F.count_if(F.col("value") > 90).alias("more"))
    grown = per.withColumn("dropped", F.sum("more").over(W.partitionBy("event_type").orderBy("ts")))
    return lookups.overflow_episodes(grown.select("event_type", "ts", "dropped"), ["event_type"])


@query("SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'unknown_metric' WHEN count(*) FILTER (WHERE value > 97) = 0 THEN 'no_data_in_range' WHEN count(*) FILTER (WHERE value > 97 AND event_type = 'view') = 0 THEN 'filtered_out' END AS reason FROM events GROUP BY user_id")
def empty_reasons(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 97).alias("n"), F.count_if((F.col("value") > 97) & (F.col("event_type") == "view")).alias("k"))
    return rows.select("user_id", lookups.empty_reason(F.col("user_id") % 7 != 0, F.col("n") > 0, F.col("k") > 0).alias("reason"))


@query(f"WITH {_L} SELECT id, '{{\"kind\":\"open\",\"monitor\":\"events\",\"entity\":\"' || provider || '\",\"severity\":' || severity || ',\"title\":\"t' || id || '\",\"ts\":' || ts || '}}' AS body FROM l WHERE severity >= 2")
def webhook_payload(spark, sf_dir):
    rows = log(spark, sf_dir).where("severity >= 2")
    return rows.select("id", lookups.payload(F.lit("open"), F.lit("events"), F.col("provider"), F.col("severity"), F.concat(F.lit("t"), F.col("id").cast("string")), F.col("ts")).alias("body"))


@query(f"WITH {_S}, {_L} SELECT (SELECT min(ts) FROM s) AS oldest, max(ts) AS last_degraded, count(*) AS degradations FROM l WHERE id % 100 = 0")
def retention_recovery(spark, sf_dir):
    told = log(spark, sf_dir).withColumn("message", F.when(F.col("id") % 100 == 0, F.concat(F.lit("degraded: "), F.col("message"))).otherwise(F.col("message")))
    return lookups.recovery(told, points(spark, sf_dir))


@query(f"WITH {_S} SELECT DISTINCT monitor, metric, entity_id FROM s")
def metric_catalog(spark, sf_dir):
    return samples.series_of(points(spark, sf_dir)).select("monitor", "metric", "entity_id")


@query("SELECT count(DISTINCT user_id) AS live FROM events WHERE isfinite(value)")
def live_series(spark, sf_dir):
    return samples.series_of(points(spark, sf_dir, "user_id")).agg(F.count_distinct("series_id").alias("live"))


@query(
    f"WITH RECURSIVE {_L}, r AS (SELECT provider, min(ts) AS ts FROM l GROUP BY provider UNION ALL SELECT provider, ts FROM (SELECT r.provider, min(l.ts) AS ts FROM r JOIN l ON l.provider = r.provider AND l.ts >= r.ts + 7200 GROUP BY r.provider, r.ts)) "
    "SELECT l.provider AS action, l.ts, r.ts IS NOT NULL AND row_number() OVER (PARTITION BY l.provider, l.ts) = 1 AS ran FROM l LEFT JOIN r ON r.provider = l.provider AND r.ts = l.ts"
)
def action_rate_limit(spark, sf_dir):
    return lookups.action_runs(log(spark, sf_dir).select(F.col("provider").alias("action"), "ts"), 7200)


# ---- acknowledgements, ends of lives, and what an operator asks


_ACKS = "SELECT DISTINCT CAST(user_id AS VARCHAR) AS entity_id, 'level' AS grp, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events WHERE event_type = 'purchase'"


def _acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).where("provider = 'purchase'")
    user = F.regexp_extract("message", r" by user (\d+) ", 1)
    return rows.select(F.lit("events").alias("monitor"), user.alias("entity_id"), F.lit("level").alias("grp"), "ts", F.lit("desk").alias("by")).distinct()


@query(
    f"WITH {_LADDER}, a AS ({_ACKS}), st AS (SELECT *, lead(ts) OVER (PARTITION BY entity_id, grp ORDER BY ts) AS til FROM t WHERE kind <> 'downgrade') "
    "SELECT entity_id, grp, incident, ts, kind FROM t UNION ALL SELECT st.entity_id, st.grp, st.incident, min(a.ts), 'acked' FROM st JOIN a ON a.entity_id = st.entity_id AND a.grp = st.grp AND a.ts >= st.ts AND (til IS NULL OR a.ts < til) "
    "WHERE st.kind <> 'clear' GROUP BY st.entity_id, st.grp, st.incident, st.ts"
)
def incident_acks(spark, sf_dir):
    rows = incidents.acknowledged(incidents.ladder(_states(spark, sf_dir)), _acks(spark, sf_dir))
    return rows.select("entity_id", "grp", "incident", "ts", "kind")


@query("WITH RECURSIVE " + _FOLD.replace("{acks}", _ACKS))
def acked_fold(spark, sf_dir):
    return incidents.notifications(incidents.levels(_states(spark, sf_dir)), _acks(spark, sf_dir))


def _ended_sql(ends: str) -> str:
    """SQL of the transitions of rules whose counts the rows (entity_id, ts, reason) of ``ends`` reset."""
    lives = """,
oo AS (SELECT *, NULL AS reason FROM o UNION ALL SELECT e.entity_id, e.ts, rule, grp, severity, confirm, clear, 'unknown', e.reason FROM e JOIN (SELECT DISTINCT entity_id, rule, grp, severity, confirm, clear FROM o) USING (entity_id)),
ol AS (SELECT *, count(reason) OVER (PARTITION BY entity_id, rule ORDER BY ts, CASE WHEN reason IS NULL THEN 1 ELSE 0 END ROWS UNBOUNDED PRECEDING) AS life FROM oo)"""
    rest = _LADDER[len(_OUT) :].replace("PARTITION BY entity_id, rule", "PARTITION BY entity_id, rule, life").replace("FROM o)", "FROM ol)")
    shown = "SELECT t.entity_id, t.grp, t.ts, t.kind, t.severity, t.incident, CASE WHEN t.kind = 'clear' THEN coalesce(e.reason, 'recovered') END AS reason FROM t LEFT JOIN e ON e.entity_id = t.entity_id AND e.ts = t.ts"
    return f"WITH {_OUT}, e AS ({ends}){lives}{rest} {shown}"


def _ended(spark: SparkSession, sf_dir: str, ends: DataFrame) -> DataFrame:
    rows, definition = _evaluated(spark, sf_dir)
    found = incidents.ladder(incidents.with_ends(rules.outcomes(rows, definition), ends))
    return incidents.cleared_by(found, ends).select("entity_id", "grp", "ts", "kind", "severity", "incident", "reason")


@query(_ended_sql(f"SELECT entity_id, ts + 86401 AS ts, 'entity_gone' AS reason FROM (SELECT entity_id, ts, lead(ts) OVER (PARTITION BY entity_id ORDER BY ts) AS back FROM s) WHERE coalesce(back, {NOW}) - ts > 86400 AND ts + 86401 <= {NOW}"))
def gone_clears(spark, sf_dir):
    return _ended(spark, sf_dir, incidents.gone_ends(points(spark, sf_dir, "user_id"), NOW, 86400))


@query(_ended_sql(f"SELECT DISTINCT entity_id, c.ts, 'superseded' AS reason FROM s CROSS JOIN (VALUES ({NOW - 10 * 86400}::BIGINT), ({NOW - 5 * 86400}::BIGINT)) AS c(ts)"))
def superseded_clears(spark, sf_dir):
    versions = [("events", NOW - 20 * 86400, "a"), ("events", NOW - 12 * 86400, "a"), ("events", NOW - 10 * 86400, "b"), ("events", NOW - 5 * 86400, None)]
    loaded = spark.createDataFrame(versions, "monitor string, ts long, content_hash string")
    return _ended(spark, sf_dir, incidents.superseded_ends(points(spark, sf_dir, "user_id"), loaded))


_ENDS = [("events", NOW - 20 * 86400, "a"), ("events", NOW - 12 * 86400, "b"), ("events", NOW - 11 * 86400, "c")]


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications of incidents that absences and replaced definitions end, but those that only repeat."""
    rows, definition = _evaluated(spark, sf_dir)
    loaded = spark.createDataFrame(_ENDS, "monitor string, ts long, content_hash string")
    ends = incidents.superseded_ends(points(spark, sf_dir, "user_id"), loaded)
    states = incidents.with_ends(rules.outcomes(rows, definition), ends)
    return incidents.notifications(incidents.levels(states)).where("kind <> 'renotify'")


@query(
    _ended_sql(f"SELECT DISTINCT entity_id, c.ts, 'superseded' AS reason FROM s CROSS JOIN (VALUES ({NOW - 12 * 86400}::BIGINT), ({NOW - 11 * 86400}::BIGINT)) AS c(ts)").replace(
        "SELECT t.entity_id, t.grp, t.ts, t.kind", "SELECT entity_id, grp, ts, CASE WHEN kind = 'clear' THEN 'recover' ELSE kind END AS kind, CASE WHEN kind = 'clear' THEN 0 ELSE severity END AS severity FROM (SELECT t.entity_id, t.grp, t.ts, t.kind"
    )
    + ") WHERE kind <> 'downgrade' AND reason IS DISTINCT FROM 'superseded'"
)
def superseded_notes(spark, sf_dir):
    return _told(spark, sf_dir).select("entity_id", "grp", "ts", "kind", "severity")


_ABOVE = """
schema = 1
[monitor]
name = "events"
source = "disk"
[[rule]]
name = "above"
when = "used_pct > baseline(used_pct) * 1.5"
severity = "warning"
"""


@query(
    f"WITH {_EWMA}, b AS (SELECT entity_id, bucket + 300 AS at, CASE WHEN n >= 240 THEN level END AS level FROM e) "
    "SELECT s.entity_id, s.ts, CASE WHEN b.level IS NULL THEN 'unknown' WHEN s.value > b.level * 1.5 THEN 'true' ELSE 'false' END AS outcome FROM s ASOF LEFT JOIN b ON s.entity_id = b.entity_id AND s.ts >= b.at"
)
def baseline_rules(spark, sf_dir):
    definition = load(_ABOVE)
    p = points(spark, sf_dir).withColumn("metric", F.lit("used_pct"))
    ticks = p.select("monitor", "entity_id", "ts", F.col("value").alias("used_pct"))
    return rules.outcomes(rules.evaluate(ticks, definition, rollup.baselines(rollup.rollup_5m(p))), definition).select("entity_id", "ts", "outcome")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entities; tier is a number for most and a text for each seventh, active is there for the even ones."""
    c = table(spark, sf_dir, "customer")
    tier = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit('"'), (F.col("c_custkey") % 10).cast("string"), F.lit('"'))).otherwise((F.col("c_custkey") % 10).cast("string"))
    active = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(',"active":'), (F.col("c_custkey") % 3 == 0).cast("string"))).otherwise("")
    texts = F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("plugin_message"), F.col("c_acctbal").cast("double").alias("balance")))
    attrs = F.concat(F.regexp_replace(texts, r"\}$", ""), F.lit(',"tier":'), tier, active, F.lit("}"))
    return c.select(F.lit("events").alias("monitor"), F.col("c_custkey").cast("string").alias("entity_id"), attrs.alias("attrs"))


@query(
    "SELECT CAST(c_custkey AS VARCHAR) AS entity_id FROM customer WHERE c_acctbal > 2500 AND CASE WHEN c_custkey % 7 = 0 THEN (c_custkey % 10)::VARCHAR = '4' "
    "ELSE c_custkey % 10 >= 5 AND c_custkey % 2 = 0 AND c_custkey % 3 = 0 END"
)
def filter_typed(spark, sf_dir):
    return desk.entities_where(_customers(spark, sf_dir), "balance > 2500 and (tier == '4' or (tier >= 5 and tier < 100 and active == True))").select("entity_id")


@query("SELECT CAST(c_custkey AS VARCHAR) AS entity_id FROM customer WHERE c_mktsegment = 'BUILDING' AND NOT contains(c_name, '7')")
def filter_expr(spark, sf_dir):
    return desk.entities_where(_customers(spark, sf_dir), "segment == 'BUILDING' and not contains(plugin_message, '7')").select("entity_id")


@query(f"WITH {_L}, n AS (SELECT * FROM l WHERE ts BETWEEN {NOW - 20 * 86400} AND {NOW} ORDER BY ts DESC, id DESC LIMIT 200) SELECT id, ts, provider FROM n WHERE provider = 'view' AND contains(message, '1')")
def match_expr(spark, sf_dir):
    start, end = desk.time_range("20d", NOW)
    listed = lookups.list_events(log(spark, sf_dir), int(start), int(end))
    return desk.events_where(listed, "provider == 'view' and contains(message, '1')").select("id", "ts", "provider")


@query(f"WITH {_SUM} SELECT su.entity_id, su.grp, su.incident, s.ts, s.value FROM su JOIN s ON s.entity_id = su.entity_id AND s.ts BETWEEN su.opened_ts - 1800 AND least({NOW}, coalesce(su.cleared_ts, {NOW}) + 1800)")
def incident_samples(spark, sf_dir):
    return desk.incident_samples(_cases(spark, sf_dir), points(spark, sf_dir, "user_id"), NOW).select("entity_id", "grp", "incident", "ts", "value")


@query(
    f"WITH {_SU}, n AS (SELECT entity_id, max(ts) AS ts, CAST(floor(arg_max(value, ts)) AS BIGINT) AS v FROM s GROUP BY entity_id) "
    f"SELECT n.entity_id, (v % 4)::INT AS plugin_state, v % 4 = 0 AS plugin_ok, coalesce(c_name, '') AS plugin_message, (v / 10.0::DOUBLE) AS duration_s, {NOW} - ts AS sample_age_s FROM n LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = n.entity_id WHERE v % 3 <> 0"
)
def plugin_results(spark, sf_dir):
    v = F.floor("value")
    parts = F.array(
        F.struct(F.lit("plugin_state").alias("metric"), (v % 4).cast("double").alias("value")),
        F.struct(F.lit("duration_s").alias("metric"), (v / 10.0).alias("value")),
        F.struct(F.when(v % 3 != 0, "plugin_ok").otherwise("other").alias("metric"), (v % 4 == 0).cast("double").alias("value")),
    )
    runs = points(spark, sf_dir, "user_id").select("monitor", "entity_id", "ts", F.explode(parts).alias("p")).select("monitor", "entity_id", "ts", "p.*")
    return desk.plugin_results(runs, _customers(spark, sf_dir), NOW).drop("monitor")


@query(
    f"WITH {_SU}, x AS (SELECT DISTINCT entity_id FROM s WHERE value > 150) SELECT 'entities' AS \"table\", count(DISTINCT entity_id) AS \"rows\" FROM s WHERE entity_id NOT IN (SELECT entity_id FROM x) "
    "UNION ALL SELECT 'samples', count(*) FROM s WHERE entity_id NOT IN (SELECT entity_id FROM x)"
)
def forget_entities(spark, sf_dir):
    p = points(spark, sf_dir, "user_id")
    return desk.row_counts(desk.forget({"samples": p, "entities": upkeep.lifecycle(p, NOW)}, p.where("value > 150")))


@query(f"WITH {_EWMA} SELECT entity_id, bucket, n AS updates FROM e WHERE entity_id <> 'error'")
def baseline_reset(spark, sf_dir):
    history = rollup.baselines(rollup.rollup_5m(points(spark, sf_dir)))
    return desk.reset_baselines(history, "events", "error").select("entity_id", "bucket", F.col("updates").cast("long").alias("updates"))


@query(f"WITH {_EWMA} SELECT entity_id, max(n) AS updates FROM e WHERE entity_id > 'click' GROUP BY entity_id ORDER BY entity_id LIMIT 3")
def baseline_page(spark, sf_dir):
    newest = rollup.latest_baselines(rollup.baselines(rollup.rollup_5m(points(spark, sf_dir))))
    wanted = {"monitor": "events"}
    after = desk.cursor(("events", "click", "value"), wanted)
    return desk.baseline_page(newest, wanted, after, 3).select("entity_id", F.col("updates").cast("long").alias("updates"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS \"rows\" FROM {t}" for t in ("customer", "events", "orders")))
def table_rows(spark, sf_dir):
    return desk.row_counts({t: table(spark, sf_dir, t) for t in ("customer", "events", "orders")})


@query(
    "SELECT 'orders' AS \"table\", count(*) AS orphans FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey) "
    "UNION ALL SELECT 'events', count(*) FROM events WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id) UNION ALL SELECT 'customer', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)"
)
def integrity(spark, sf_dir):
    links = [("orders", "o_custkey", "customer", "c_custkey"), ("events", "user_id", "customer", "c_custkey"), ("customer", "c_custkey", "orders", "o_custkey")]
    return desk.orphan_counts({t: table(spark, sf_dir, t) for t in ("customer", "events", "orders")}, links)


@query(
    "SELECT 'orders' AS \"table\", count(*) FILTER (WHERE o_custkey % 10 = 0) AS orphans FROM orders UNION ALL SELECT 'events', count(*) FILTER (WHERE user_id % 10 = 0 OR user_id NOT IN (SELECT c_custkey FROM customer)) FROM events "
    "UNION ALL SELECT 'customer', 0"
)
def integrity_broken(spark, sf_dir):
    """Every tenth customer is lost; the customers that are left know no parent but themselves."""
    left = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0")
    tables = {"customer": left, "orders": table(spark, sf_dir, "orders"), "events": table(spark, sf_dir, "events")}
    return desk.orphan_counts(tables, [("orders", "o_custkey", "customer", "c_custkey"), ("events", "user_id", "customer", "c_custkey"), ("customer", "c_custkey", "customer", "c_custkey")])


_DECLARED = ", ".join(f"('events', '{m}')" for m in sorted(samples.SOURCES["disk"].metrics))


@query(f"SELECT * FROM (VALUES {_DECLARED}) AS d(monitor, metric) UNION SELECT 'events', event_type FROM events WHERE isfinite(value)")
def metric_names(spark, sf_dir):
    declared = spark.createDataFrame([("events", m) for m in sorted(load(_ABOVE).metrics)], "monitor string, metric string")
    return desk.metric_names(declared, points(spark, sf_dir).select("monitor", F.col("entity_id").alias("metric")))


@query(
    "WITH a AS (SELECT o_custkey AS path, nullif(o_orderstatus, 'P') AS query, o_orderkey AS nth FROM orders), w AS (SELECT path, min(nth) FILTER (WHERE query IS NULL) AS whole FROM a GROUP BY path) "
    "SELECT path, CASE WHEN any_value(whole) IS NULL THEN arg_min(query, nth) END AS query, count(DISTINCT query) FILTER (WHERE whole IS NULL OR nth < whole) > 1 AS conflict FROM a JOIN w USING (path) GROUP BY path"
)
def event_channels(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.nullif("o_orderstatus", F.lit("P")).alias("query"), F.col("o_orderkey").alias("nth"))
    return desk.channels(asked)


@query(
    f"WITH {_SU}, n AS (SELECT entity_id, entity_id[-1:] AS last, max(ts) AS ts, arg_max(value, ts) AS value FROM s GROUP BY entity_id), "
    f"g AS (SELECT 'u' || last AS monitor, entity_id, ts, value FROM n WHERE ts >= {NOW} - 86400 AND NOT contains(entity_id, '7') QUALIFY row_number() OVER (PARTITION BY last ORDER BY CASE WHEN last < '5' THEN value ELSE -value END, ts DESC, entity_id) = 1) "
    "SELECT *, count(*) OVER () AS matched FROM g ORDER BY monitor LIMIT 64"
)
def glances(spark, sf_dir):
    last = F.substring("entity_id", -1, 1)
    newest = store.latest(points(spark, sf_dir, "user_id")).withColumns({"monitor": F.concat(F.lit("u"), last), "interval": F.lit(43200), "aggregate": F.when(last < "5", "min").otherwise("max")})
    return desk.glances(newest, NOW, newest.where(F.contains("entity_id", F.lit("7"))))


@query(
    f"WITH {_SUM} SELECT entity_id, grp, incident, '/trends/events/' || CASE grp WHEN 'level' THEN 'used' ELSE 'all' END || '?entity=' || entity_id || '&range=24h&group=' || grp AS href, "
    "'View ' || CASE grp WHEN 'level' THEN 'Used space' ELSE 'Everything' END || ' around this incident' AS label FROM su"
)
def evidence_links(spark, sf_dir):
    trends = spark.createDataFrame([("events", "used", "Used space", "level", 1), ("events", "all", "Everything", None, 2)], "monitor string, trend string, title string, grp string, nth int")
    return desk.evidence_links(_cases(spark, sf_dir).select("monitor", "entity_id", "grp", "incident"), trends).drop("monitor")


@query(
    "WITH d AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN props WHEN 1 THEN '[' || user_id || ']' WHEN 2 THEN 'bad ' || props END AS detail FROM events) "
    "SELECT event_id, CASE WHEN detail IS NULL THEN '{}' WHEN NOT json_valid(detail) THEN CAST(to_json({'malformed': detail[1:200]}) AS VARCHAR) WHEN json_type(detail) = 'OBJECT' THEN detail ELSE '{\"value\":' || detail || '}' END AS detail FROM d"
)
def history_details(spark, sf_dir):
    kind, user, props = F.col("user_id") % 4, F.col("user_id").cast("string"), F.col("props")
    detail = F.when(kind == 0, props).when(kind == 1, F.concat(F.lit("["), user, F.lit("]"))).when(kind == 2, F.concat(F.lit("bad "), props))
    return desk.details(table(spark, sf_dir, "events").select("event_id", detail.alias("detail")))


@query(f"WITH RECURSIVE {_SHOWN} SELECT entity_id, round(avg(value) + 1e-7, 4) AS avg, min(value) AS min, max(value) AS max, arg_max(value, ts) AS last FROM q GROUP BY entity_id")
def shown_summary(spark, sf_dir):
    return desk.shown_summary(store.downsample(points(spark, sf_dir, "user_id"), 20)).withColumn("avg", r4("avg"))


# ---- raw inputs


_UNIFIED = " ".join(f"WHEN '{t}' THEN {n}" for t, n in scalar.UNIFIED_LOG_TYPE.items())


@query(
    "WITH e AS (SELECT *, ['Fault', 'Error', 'Default', 'Info', 'Debug'][event_id % 5 + 1] AS kind, 'event ' || event_id || ' ' || props AS message FROM events WHERE event_id % 7 > 0) "
    f"SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts, CASE kind {_UNIFIED} END AS severity, 'shop.' || event_type || '/' || user_id % 3 AS provider, message, "
    "sha256(concat_ws(chr(31), 'boot', (event_id // 2)::VARCHAR, '', '', '', message)) AS identity FROM e"
)
def unified_log(spark, sf_dir):
    """Events as lines of a unified log, each seventh of another type."""
    kind = F.element_at(F.array(*map(F.lit, scalar.UNIFIED_LOG_TYPE)), (F.col("event_id") % 5 + 1).cast("int"))
    line = F.struct(
        F.when(F.col("event_id") % 7 > 0, "logEvent").otherwise("activityCreateEvent").alias("eventType"), F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+0000")).alias("timestamp"),
        kind.alias("messageType"), F.concat(F.lit("shop."), "event_type").alias("subsystem"), (F.col("user_id") % 3).cast("string").alias("category"),
        F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" "), "props").alias("eventMessage"), F.lit("boot").alias("bootUUID"), F.floor(F.col("event_id") / 2).alias("machTimestamp"),
    )
    return logs.parse_unified_log(table(spark, sf_dir, "events").select(F.to_json(line).alias("value")))


@query(
    "SELECT event_id, CASE WHEN event_id % 5 < 2 THEN 3 ELSE event_id % 3 END::INT AS state, CASE WHEN event_id % 5 >= 2 THEN user_id::DOUBLE END AS value, CASE WHEN event_id % 5 >= 2 THEN 's' END AS uom FROM events"
)
def strict_checks(spark, sf_dir):
    """Check outputs, of which one in five has a wrong state and one in five a key twice."""
    n = lambda c: F.col(c).cast("string")
    state = F.when(F.col("event_id") % 5 == 0, "7").otherwise((F.col("event_id") % 3).cast("string"))
    twice = F.when(F.col("event_id") % 5 == 1, ',"message":"again"').otherwise("")
    text = F.concat(F.lit('{"schema":1,"state":'), state, F.lit(',"message":"m"'), twice, F.lit(',"metrics":{"users":{"value":'), n("user_id"), F.lit(',"uom":"s"}}}'))
    rows = checks.parse_checks(table(spark, sf_dir, "events").select("event_id", text.alias("output")), "event_id")
    return rows.select("event_id", "state", F.col("metrics")["users"]["value"].alias("value"), F.col("metrics")["users"]["uom"].alias("uom"))


@query(
    "SELECT event_id, 'size_bytes' AS metric, (event_id % 100 * 1024)::DOUBLE AS value FROM events WHERE event_id % 4 > 0 UNION ALL SELECT event_id, 'users', (user_id)::DOUBLE FROM events"
)
def check_projection(spark, sf_dir):
    """Plugin output as metrics; a size in another unit than the mapping's gives no sample."""
    unit = F.when(F.col("event_id") % 4 == 0, "MB").otherwise("KB")
    output = F.concat(F.lit("OK|'disk size'="), (F.col("event_id") % 100).cast("string"), unit, F.lit(";80;90 users="), F.col("user_id").cast("string"), F.lit(";;;0;"))
    perf = logs.parse_perfdata(table(spark, sf_dir, "events").select("event_id", output.alias("output")), keys=("event_id",))
    mapping = spark.sql("SELECT * FROM VALUES ('disk size', 'size_bytes', 'KB', 1024D), ('users', 'users', '', 1D) AS m(label, metric, unit, scale)")
    return logs.project_checks(perf, mapping).select("event_id", "metric", "value")


@query("SELECT event_id, left(regexp_replace(event_type || chr(7) || chr(10) || repeat(props || chr(127) || 'é', 1 + (event_id % 400)::INT), '[\\x00-\\x1f\\x7f]', '', 'g'), 2048) AS message FROM events")
def message_cleaned(spark, sf_dir):
    """Messages with control characters, some longer than what is kept."""
    raw = F.concat("event_type", F.lit("\x07\n"), F.expr("repeat(concat(props, char(127), 'é'), cast(1 + event_id % 400 as int))"))
    return table(spark, sf_dir, "events").select("event_id", scalar.clean_message(raw).alias("message"))


@query("SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'unknown' WHEN value >= 100 THEN 'error' WHEN value >= 80 THEN 'warn' ELSE 'ok' END AS tone FROM events")
def budget_tones(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.tone(F.when(F.col("event_id") % 6 > 0, F.col("value"))).alias("tone"))
