"""Raw event inputs as columns: journal and unified-log JSON lines, event XML, plugin output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeloom.functions import scalar


def parse_journal(lines: DataFrame, value: str = "value") -> DataFrame:
    """Journal JSON lines: (cursor, ts, severity, provider, message); lines that aren't objects or lack a cursor are left out.

    A message may be a text or an array of byte values. It is cut at 2048 characters.
    """
    v = F.col(value)
    field = lambda name: F.get_json_object(v, f"$.{name}")
    raw = field("MESSAGE")
    codes = F.from_json(raw, "array<int>")
    from_bytes = F.decode(F.unhex(F.array_join(F.transform(codes, lambda b: F.lpad(F.hex(b), 2, "0")), "")), "UTF-8")
    message = F.when(raw.rlike(r"^\[[0-9, ]*\]$"), from_bytes).otherwise(raw)
    rows = lines.where(v.rlike(r"^\s*\{")).select(
        field("__CURSOR").alias("cursor"),
        F.floor(field("__REALTIME_TIMESTAMP").cast("double") / 1_000_000).alias("ts"),
        F.coalesce(scalar.from_map(field("PRIORITY").try_cast("int"), scalar.JOURNAL_PRIORITY), F.lit(0)).alias("severity"),
        F.coalesce(field("SYSLOG_IDENTIFIER"), field("_SYSTEMD_UNIT"), F.lit("unknown")).alias("provider"),
        F.substring(F.coalesce(message, F.lit("")), 1, 2048).alias("message"),
    )
    return rows.where(F.col("cursor").isNotNull())


def parse_unified_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Unified-log JSON lines: (ts, severity, provider, message, identity); identity is the same for a replayed line."""
    v = F.col(value)
    field = lambda name: F.get_json_object(v, f"$.{name}")
    identity = F.sha2(F.concat_ws("\x1f", *(F.coalesce(field(n), F.lit("")) for n in ("bootUUID", "machTimestamp", "traceID", "processID", "senderProgramCounter", "eventMessage"))), 256)
    return lines.where(field("eventType") == "logEvent").select(
        F.unix_seconds(F.to_timestamp(field("timestamp"))).alias("ts"), F.coalesce(scalar.from_map(field("messageType"), scalar.UNIFIED_LOG_TYPE), F.lit(0)).alias("severity"),
        F.concat_ws("/", field("subsystem"), field("category")).alias("provider"), F.substring(field("eventMessage"), 1, 2048).alias("message"), identity.alias("identity"),
    )


_XML = "System struct<Provider: array<struct<_Name: string>>, EventID: array<struct<_VALUE: string>>, Level: array<struct<_VALUE: string>>, TimeCreated: array<struct<_SystemTime: string>>>, EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>"


def parse_event_xml(rows: DataFrame, value: str = "value") -> DataFrame:
    """Event XML: (ts, severity, provider, event_id, message); the message joins the data fields as name=value.

    A text is parsed once. One that is no XML has no ts, severity 0 and empty texts.
    """
    made = F.from_xml(F.col(value), _XML, {"ignoreSurroundingSpaces": "false"})
    text = lambda element, field: F.coalesce(F.get(F.col(f"_e.System.{element}"), F.lit(0))[field], F.lit(""))
    fields = F.filter("_e.EventData.Data", lambda d: d["_Name"].isNotNull())
    joined = F.array_join(F.transform(fields, lambda d: F.concat(d["_Name"], F.lit("="), F.coalesce(d["_VALUE"], F.lit("")))), "; ")
    return rows.select(made.alias("_e")).select(
        F.unix_seconds(F.try_to_timestamp(text("TimeCreated", "_SystemTime"))).alias("ts"), F.coalesce(scalar.from_map(text("Level", "_VALUE").try_cast("int"), scalar.EVENT_LEVEL), F.lit(0)).alias("severity"),
        text("Provider", "_Name").alias("provider"), text("EventID", "_VALUE").alias("event_id"), F.substring(F.coalesce(joined, F.lit("")), 1, 2048).alias("message"),
    )


_PERF = r"(?:^|\s)('(?:[^']|'')+'|[^\s='][^\s=]*)=(-?\d+(?:\.\d+)?)([A-Za-z%]*)((?:;[^\s;]*){0,4})"


def parse_perfdata(rows: DataFrame, output: str = "output", keys: tuple[str, ...] = ()) -> DataFrame:
    """Plugin output 'summary|'label'=value[unit];warn;crit;min;max ...': a row a metric (label, value, unit, warn, crit).

    A label that comes twice is left out; so is a metric whose least is above its greatest.
    """
    perf = F.regexp_extract(F.col(output), r"\|(.*)", 1)
    parts = [F.regexp_extract_all(perf, F.lit(_PERF), F.lit(i)) for i in range(1, 5)]
    each = rows.select(*keys, F.explode(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("label", "value", "unit", "rest"), strict=True)))).alias("m")).select(*keys, "m.*")
    rest = F.split("rest", ";")
    number = lambda i: F.get(rest, F.lit(i)).try_cast("double")
    out = each.select(*keys, F.trim(F.col("label"), F.lit("'")).alias("label"), F.col("value").cast("double").alias("value"), "unit", number(1).alias("warn"), number(2).alias("crit"), number(3).alias("_min"), number(4).alias("_max"))
    good = out.where(F.coalesce(F.col("_min") <= F.col("_max"), F.lit(True)))
    from pyspark.sql import Window as W

    times = F.count("*").over(W.partitionBy(*keys, "label"))
    return good.withColumn("_n", times).where("_n = 1").drop("_n", "_min", "_max")


def project_checks(perf: DataFrame, mapping: DataFrame) -> DataFrame:
    """Perfdata to metrics: mapping (label, metric, unit, scale); a unit that differs gives no sample."""
    return perf.join(mapping, ["label", "unit"]).withColumn("value", F.col("value") * F.col("scale")).drop("scale", "label", "unit")


def attrs_of(json: Column) -> Column:
    """A JSON object of texts as a map; anything else as {'malformed': it}."""
    return F.coalesce(F.from_json(json, "map<string,string>"), F.create_map(F.lit("malformed"), json))
