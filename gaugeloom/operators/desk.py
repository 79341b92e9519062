"""What an operator asks of the store: filters by attributes, evidence, plugin results, integrity, removals."""

from __future__ import annotations

import ast
import base64
import json
from collections.abc import Sequence
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeloom.operators.store import SERIES, downsample
from gaugeloom.plans.definitions import Definition
from gaugeloom.plans.expression import ExpressionError, Names, compile_expression, duration

DAY = 86400
#: Seconds before the opening and behind the clear of an incident whose samples explain it.
BEFORE, BEHIND = 1800, 1800
MAX_GLANCES = 64
EVENT_ATTRS = frozenset({"provider", "event_id", "message", "source"})


def time_range(given: str | Sequence[str], now: float) -> tuple[float, float]:
    """Start and end of '90m', which ends now, or of two ISO times; those without a zone are UTC."""
    if isinstance(given, str):
        return now - duration(given), now
    if len(given) != 2:
        raise ExpressionError(f"not a range: {given!r}")
    try:
        ends = [datetime.fromisoformat(str(x)) for x in given]
    except ValueError as e:
        raise ExpressionError(f"not a range: {given!r}") from e
    start, end = (t.replace(tzinfo=t.tzinfo or UTC).timestamp() for t in ends)
    return start, end


def names_in(text: str) -> set[str]:
    """Names that an expression reads; none where it is no expression."""
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except (SyntaxError, ValueError):
        return set()
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called}


#: The types of the rule language and how a JSON value of each is read; other JSON values are null.
_JSON_KINDS = {"number": "double", "text": "string", "bool": "boolean"}


def _json_kind(value: Column) -> Column:
    """number, text, bool, or null of a variant."""
    kind = F.schema_of_variant(value)
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    return F.when(value.isNull(), "null").when(number, "number").when(kind == "STRING", "text").when(kind == "BOOLEAN", "bool").otherwise("null")


def entities_where(entities: DataFrame, text: str) -> DataFrame:
    """Entities whose attributes (column attrs: a JSON object) make an attribute-only expression true.

    Values keep their JSON types: 443 is a number and "443" a text, and the two never compare. An attribute that no
    entity has is an error, one that only some have, or that is an object or a list, is null there. Where an
    attribute's type differs between entities, the expression is compiled once for each combination of types that occurs.
    """
    wanted = sorted(names_in(text))
    rows = entities.withColumn("_attrs", F.try_parse_json(F.coalesce(F.when(F.col("attrs") != "", F.col("attrs")), F.lit("{}"))))
    held = {n: F.try_variant_get("_attrs", f"$.{n}", "variant") for n in wanted}
    kinds = F.array(*(_json_kind(v) for v in held.values())) if wanted else F.array().cast("array<string>")
    has = F.array(*(v.isNotNull() for v in held.values())) if wanted else F.array().cast("array<boolean>")
    rows = rows.withColumns({"_kinds": kinds, "_has": has})
    found = rows.select("_kinds", "_has").distinct().collect()  # a row a combination of types, of few names
    known = frozenset(n for i, n in enumerate(wanted) if any(r["_has"][i] for r in found))
    # each attribute stands in a column of its own for each type, whatever characters its name has
    of_kind = lambda n, k: F.try_variant_get("_attrs", f"$.{n}", _JSON_KINDS[k]) if k in _JSON_KINDS else F.lit(None).cast("string")
    rows = rows.withColumns({f"_attr{i}_{k}": of_kind(n, k) for i, n in enumerate(wanted) for k in sorted({r["_kinds"][i] for r in found} | {"null"})})
    true = F.lit(False)
    for combination in sorted({tuple(r["_kinds"]) for r in found} or {("null",) * len(wanted)}):
        own = dict(zip(wanted, combination, strict=True))
        names = Names(attrs=known, kinds=own, columns={n: f"_attr{i}_{own[n]}" for i, n in enumerate(wanted)})
        made = compile_expression(text, names)
        true = F.when(F.col("_kinds") == F.array(*map(F.lit, combination)) if wanted else F.lit(True), made.outcome() == "true").otherwise(true)
    return rows.where(true).select(*entities.columns)


def events_where(listed: DataFrame, text: str) -> DataFrame:
    """Of listed events, after their limit, those that make an expression of provider, event_id, message and source true."""
    made = compile_expression(text, Names(attrs=EVENT_ATTRS))
    return listed.where(made.outcome() == "true")


def incident_samples(incidents: DataFrame, samples: DataFrame, now: int) -> DataFrame:
    """Samples of an incident's entity from half an hour before it opened to half an hour after it cleared (or now).

    An equi-join on the entity and the day, then the exact times: a long history meets only the days that it shares.
    """
    end = F.least(F.lit(now), F.coalesce("cleared_ts", F.lit(now)) + BEHIND)
    spans = incidents.withColumns({"_from": F.col("opened_ts") - BEFORE, "_to": end}).where("_from <= _to")
    days = spans.withColumn("_day", F.explode(F.sequence(F.floor(F.col("_from") / DAY), F.floor(F.col("_to") / DAY))))
    rows = days.join(samples.withColumn("_day", F.floor(F.col("ts") / DAY)), ["monitor", "entity_id", "_day"])
    return rows.where(F.col("ts").between(F.col("_from"), F.col("_to"))).drop("_day", "_from", "_to")


#: Seconds around an opening whose events belong to it, and how many are shown; metrics of an entity and points of each.
AROUND, SHOWN_EVENTS, SHOWN_METRICS, SHOWN_POINTS = 600, 50, 8, 300
EVENT_DETAILS = ("provider", "severity", "message")


def with_newest(rows: DataFrame, log: DataFrame, at: str, details: Sequence[str] = EVENT_DETAILS, span: int = AROUND, most: int = SHOWN_EVENTS) -> DataFrame:
    """``rows`` with ``related_events``: of the events within ``span`` seconds of ``at`` the newest ``most`` (ts, id, details), newest first.

    Time is cut into blocks of a window's width and events are numbered in a block and the one before, so a row knows the number of the
    newest event of its window. Events lie in chunks of ``most`` numbers, each with the chunk before it: a row meets one chunk,
    however many events are near.
    """
    width = 2 * span
    row, event = F.struct(*(F.col(f"`{c}`") for c in rows.columns)), F.struct("ts", "id", *details)
    events = log.where("ts is not null").select("ts", "id", *details).select(event.alias("e"))
    asks = rows.select(row.alias("row"), (F.col(f"`{at}`") + span).alias("end"))
    none = F.lit(None)
    block = F.floor(F.col("e.ts") / width)
    both = events.select(F.explode(F.array(block, block + 1)).alias("block"), F.col("e.ts").alias("end"), "e", none.cast(asks.schema["row"].dataType).alias("row"))
    both = both.unionByName(asks.select(F.floor(F.col("end") / width).alias("block"), "end", none.cast(events.schema["e"].dataType).alias("e"), "row"))
    order = W.partitionBy("block").orderBy("end", F.col("row").isNotNull(), "e.id").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("n", F.count("e").over(order)).withColumn("chunk", F.floor((F.col("n") - 1) / most))
    held = both.where("e is not null").select("block", F.explode(F.array("chunk", F.col("chunk") + 1)).alias("chunk"), F.struct("n", "e").alias("e"))
    chunks = held.groupBy("block", "chunk").agg(F.collect_list("e").alias("events"))
    met = both.where("row is not null").select("block", "chunk", "n", "end", "row").join(chunks, ["block", "chunk"], "left")
    own = F.filter("events", lambda x: (x["n"] > F.col("n") - most) & (x["n"] <= F.col("n")) & (x["e"]["ts"] >= F.col("end") - width))
    found = F.transform(F.sort_array(own, asc=False), lambda x: x["e"])
    return met.select("row.*", F.coalesce(found, F.array().cast(held.select(F.array("e.e").alias("a")).schema["a"].dataType)).alias("related_events"))


def explain(chosen: DataFrame, history: DataFrame, log: DataFrame, samples: DataFrame, now: int, details: Sequence[str] = EVENT_DETAILS) -> DataFrame:
    """All that explains each chosen incident in one row: its columns, and
    history: array of (seq, ts, kind) in order; related_events: the newest events around its opening; series: the
    first metrics of its entity by name, each with its points (ts, value) from half an hour before it to half an hour behind it.

    chosen and history share monitor, entity_id, grp and incident; chosen has opened_ts and cleared_ts. Lists that are longer than
    what is shown are cut as a page is; a longer series is downsampled. Events come with their ``details``.
    """
    key = ["monitor", "entity_id", "grp", "incident"]
    own = history.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "ts", "kind"))).alias("history"))
    points = incident_samples(chosen.select(*key, "opened_ts", "cleared_ts"), samples, now)
    counted = points.withColumn("_n", F.count("*").over(W.partitionBy(*key, "metric")))
    kept = counted.withColumn("_nth", F.dense_rank().over(W.partitionBy(*key).orderBy("metric"))).where(F.col("_nth") <= SHOWN_METRICS)
    long = downsample(kept.where(F.col("_n") > SHOWN_POINTS).select(*key, "metric", "ts", "value"), SHOWN_POINTS, [*key, "metric"])
    shown = kept.where(F.col("_n") <= SHOWN_POINTS).select(*key, "metric", "ts", "value").unionByName(long)
    lines = shown.groupBy(*key, "metric").agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("points"))
    lines = lines.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("metric", "points"))).alias("series"))
    rows = chosen.join(own, key, "left").join(lines, key, "left")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)) for c in ("history", "series")})
    return with_newest(rows, log, "opened_ts", details).select(*chosen.columns, "history", "related_events", "series")


def plugin_results(samples: DataFrame, entities: DataFrame, now: int) -> DataFrame:
    """The last result of each check: plugin_state, with plugin_ok and duration_s of the same second and the message among
    the entity's attributes. Checks whose newest state lacks one of them have no row."""
    parts = samples.where(F.col("metric").isin("plugin_state", "plugin_ok", "duration_s"))
    value = lambda m: F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m)
    ticks = parts.groupBy("monitor", "entity_id", "ts").agg(value("plugin_state"), value("plugin_ok"), value("duration_s")).where("plugin_state is not null")
    newest = ticks.groupBy("monitor", "entity_id").agg(F.max_by(F.struct("ts", "plugin_state", "plugin_ok", "duration_s"), "ts").alias("r")).select("monitor", "entity_id", "r.*")
    whole = newest.where("plugin_ok is not null and duration_s is not null")
    message = F.coalesce(F.get_json_object("attrs", "$.plugin_message"), F.lit(""))
    said = entities.select("monitor", "entity_id", message.alias("plugin_message"))
    rows = whole.join(said, ["monitor", "entity_id"], "left").na.fill("", ["plugin_message"])
    return rows.select("monitor", "entity_id", F.col("plugin_state").cast("int").alias("plugin_state"), (F.col("plugin_ok") != 0).alias("plugin_ok"), "plugin_message", "duration_s", (F.lit(now) - F.col("ts")).alias("sample_age_s"))


def forget(tables: dict[str, DataFrame], excluded: DataFrame) -> dict[str, DataFrame]:
    """The tables without all rows of entities (monitor, entity_id) that a definition excludes."""
    keys = excluded.select("monitor", "entity_id").distinct()
    return {name: rows.join(keys, ["monitor", "entity_id"], "left_anti") for name, rows in tables.items()}


def reset_baselines(history: DataFrame, monitor: str, entity_id: str | None = None) -> DataFrame:
    """Baselines without those of a monitor, or of one entity of it: they are learned anew from there."""
    gone = F.col("monitor") == monitor
    return history.where(~(gone if entity_id is None else gone & (F.col("entity_id") == entity_id)))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of each table."""
    each = [rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, rows in sorted(tables.items())]
    return reduce(DataFrame.unionByName, each)


def orphan_counts(tables: dict[str, DataFrame], links: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """links: (child, its column, parent, its column). (table, orphans): rows of the child that have no parent."""
    each = []
    for child, own, parent, key in links:
        keys = tables[parent].select(F.col(key).alias("_key")).distinct()
        lost = tables[child].select(F.col(own).alias("_key")).join(keys, "_key", "left_anti")
        each.append(lost.agg(F.count("*").alias("orphans")).select(F.lit(child).alias("table"), "orphans"))
    return reduce(DataFrame.unionByName, each)


def metric_names(declared: DataFrame, kept: DataFrame) -> DataFrame:
    """(monitor, metric): declared by a definition or held in the store, each once."""
    return declared.select("monitor", "metric").union(kept.select("monitor", "metric")).distinct()


def channels(asked: DataFrame) -> DataFrame:
    """asked: (path, query, nth), event channels that definitions ask for, in the order of loading. One row a path: its
    query and whether definitions conflict. Null, the whole channel, wins; of different queries the first stays."""
    order = W.partitionBy("path").orderBy("nth")
    whole = F.count_if(F.col("query").isNull()).over(order.rowsBetween(W.unboundedPreceding, 0)) > 0
    rows = asked.withColumn("_before", F.when(~whole, F.col("query")))  # asked for before the whole channel was
    return rows.groupBy("path").agg(
        F.when(F.count("query") == F.count("*"), F.min_by("query", "nth")).alias("query"), (F.count_distinct("_before") > 1).alias("conflict")
    )


def glances(newest: DataFrame, now: int, excluded: DataFrame | None = None, most: int = MAX_GLANCES) -> DataFrame:
    """newest: (monitor, interval, aggregate: 'max' or 'min', entity_id, ts, value). One reading a monitor: its greatest or
    least value of the last two intervals; of ties the newest, then the lesser entity_id. ``excluded`` (monitor,
    entity_id) are gone or exempt. The first ``most`` monitors by name, with ``matched``, how many there were."""
    rows = newest.where(F.col("ts") >= F.lit(now) - 2 * F.col("interval"))
    if excluded is not None:
        rows = rows.join(excluded.select("monitor", "entity_id").distinct(), ["monitor", "entity_id"], "left_anti")
    # least first: negated values make one order of both aggregates
    worst = F.when(F.col("aggregate") == "min", F.col("value")).otherwise(-F.col("value"))
    best = F.min(F.struct(worst.alias("w"), (-F.col("ts")).alias("t"), "entity_id", "value", "ts")).alias("b")
    one = rows.groupBy("monitor").agg(best).select("monitor", "b.entity_id", "b.ts", "b.value")
    return one.withColumn("matched", F.count("*").over(W.partitionBy())).orderBy("monitor").limit(most)  # a row a monitor


def shown_summary(shown: DataFrame, keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    """Mean, least, greatest and last value of the points that a downsampled line still shows."""
    return shown.groupBy(*keys).agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.max_by("value", "ts").alias("last"))


def evidence_links(incidents: DataFrame, trends: DataFrame) -> DataFrame:
    """trends: (monitor, trend, title, grp, nth), in the order of the definitions. Adds href and label of the first trend of an
    incident's monitor that is of its group or of any (null); null where there is none."""
    fits = F.col("t.grp").isNull() | (F.col("t.grp") == F.col("i.grp"))
    both = incidents.alias("i").join(trends.alias("t"), (F.col("i.monitor") == F.col("t.monitor")) & fits, "left")
    first = F.min(F.struct("t.nth", "t.trend", "t.title")).alias("t")
    rows = both.groupBy(*(F.col(f"i.{c}") for c in incidents.columns)).agg(first)
    url = F.concat(F.lit("/trends/"), F.col("monitor"), F.lit("/"), F.col("t.trend"), F.lit("?entity="), F.url_encode("entity_id"), F.lit("&range=24h&group="), F.url_encode("grp"))
    return rows.select(*incidents.columns, url.alias("href"), F.concat(F.lit("View "), F.col("t.title"), F.lit(" around this incident")).alias("label"))


def details(history: DataFrame) -> DataFrame:
    """History rows with ``detail`` (JSON text) as a JSON object: null as {}, other JSON as {"value": ...}, what is no JSON as
    {"malformed": its first 200 characters}."""
    raw = F.coalesce(F.when(F.col("detail") != "", F.col("detail")), F.lit("{}"))
    parsed = F.try_parse_json(raw)
    malformed = F.to_json(F.struct(F.substring(raw, 1, 200).alias("malformed")))
    whole = F.when(parsed.isNull(), malformed).when(F.schema_of_variant(parsed).startswith("OBJECT"), raw)
    return history.withColumn("detail", whole.otherwise(F.concat(F.lit('{"value":'), F.trim(raw), F.lit("}"))))


def cursor(after: tuple[str, str, str], wanted: dict) -> str:
    """The place behind which a page goes on, bound to its filter, as text."""
    return base64.urlsafe_b64encode(json.dumps([list(after), wanted], sort_keys=True).encode()).decode()


def from_cursor(text: str, wanted: dict) -> tuple[str, str, str]:
    """The place of a cursor; an error where it was given for another filter."""
    try:
        after, given = json.loads(base64.urlsafe_b64decode(text.encode()))
        monitor, entity_id, metric = after
    except ValueError as e:
        raise ValueError("not a cursor") from e
    if given != wanted:
        raise ValueError("the cursor belongs to another filter")
    return monitor, entity_id, metric


def baseline_page(baselines: DataFrame, wanted: dict, after: str | None, limit: int) -> DataFrame:
    """The next rows by (monitor, entity_id, metric) of those with the wanted column values."""
    from gaugeloom.operators.store import page

    rows = reduce(lambda df, c: df.where(F.col(c) == wanted[c]), sorted(set(wanted) & set(SERIES)), baselines)
    return page(rows, None if after is None else from_cursor(after, wanted), limit)


#: Metrics that rules should no longer hold against a budget, and those that answer the question.
STALE_METRICS = {"db_bytes": "db_used_bytes"}


def stale_rules(definition: Definition) -> list[tuple[str, str, str]]:
    """(rule, metric, better metric) for rules that compare a stale metric itself with a limit; arithmetic on it is no fault."""

    def plain(node: ast.expr) -> bool:
        if isinstance(node, ast.BinOp):
            return isinstance(node.op, ast.Mult) and plain(node.left) and plain(node.right)
        return isinstance(node, ast.Constant | ast.Name)

    found = []
    for rule in definition.rules:
        for node in ast.walk(ast.parse(rule.when.strip(), mode="eval")):
            if isinstance(node, ast.Compare) and isinstance(node.ops[0], ast.Lt | ast.LtE | ast.Gt | ast.GtE) and isinstance(node.left, ast.Name) and plain(node.comparators[0]) and node.left.id in STALE_METRICS:
                found.append((rule.name, node.left.id, STALE_METRICS[node.left.id]))
    return found


def unit_and_panels(definition: Definition, metric: str) -> tuple[str, list[tuple[str, str]]]:
    """A metric's unit, 'value' where neither its source nor a trend tells, and the (trend, panel) that show it."""
    from gaugeloom.sources.samples import SOURCES

    declared = SOURCES[definition.source].metrics.get(metric)
    unit, panels = declared[1] if declared else "value", []
    for t in definition.trends:
        for panel, name, own in (("value", t.value, t.value_unit), ("rate", t.rate, t.rate_unit), ("confidence", t.confidence, "fraction"), ("remaining", t.remaining, None)):
            if name == metric:
                unit = own or unit
                panels.append((t.name, panel))
                break
    return unit, panels
