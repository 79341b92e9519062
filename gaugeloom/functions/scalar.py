"""Scalar functions of the rule language and of event handling, as columns."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SEVERITIES = ["info", "notice", "warning", "error", "critical"]
UNITS = {"KB": 1024.0, "MB": 1024.0**2, "GB": 1024.0**3, "TB": 1024.0**4}
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
JOURNAL_PRIORITY = {0: 4, 1: 4, 2: 4, 3: 3, 4: 2, 5: 1, 6: 0, 7: 0}
EVENT_LEVEL = {1: 4, 2: 3, 3: 2, 4: 0, 5: 0}
UNIFIED_LOG_TYPE = {"Fault": 4, "Error": 3, "Default": 1, "Info": 0, "Debug": 0}


def clean(x: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def pct(a: Column, b: Column) -> Column:
    """100 * a / b; null where b is zero."""
    return clean(F.try_divide(a * 100.0, b))


def floored_mod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign; null where b is zero."""
    return clean(a - b * F.floor(F.try_divide(a, b)))


def _product_error(a: Column, b: float, p: Column) -> Column:
    """What rounding took from the product p = a * b, exact: the factors are split into halves whose products are doubles."""
    split = 134217729.0  # 2 ** 27 + 1
    c = a * split
    high = c - (c - a)
    low = a - high
    b_high = b * split - (b * split - b)
    b_low = b - b_high
    return ((high * b_high - p) + high * b_low + low * b_high) + low * b_low


def roundv(x: Column, digits: int) -> Column:
    """x to ``digits`` decimal places (up to 22), half-even on the exact binary value: 2.675 lies below the half and gives 2.67.

    x * 10 ** digits is a double and an error that is known exactly; only where the double ends in .5 the error decides,
    and without one the even neighbour is taken. From 2 ** 53 on x has no further digits. Nulls, NaN and infinities stay.
    """
    if not 0 <= digits <= 22:
        return F.bround(x, digits)
    scale = 10.0**digits

    def nearest(v: Column) -> Column:
        x, p, whole = v["x"], v["p"], v["whole"]
        over, error = p - whole, _product_error(x, scale, p)
        up = (over > 0.5) | ((over == 0.5) & (error > 0))
        n = F.when(up, whole + 1).when((over < 0.5) | (error < 0), whole).otherwise(whole + F.abs(whole % 2))
        # zero keeps its sign
        return F.when(F.isnan(x) | (F.abs(p) >= 2.0**53), x).otherwise(F.when(n == 0, x * 0.0).otherwise(n / scale))

    # bound as a lambda's variable, so that the parts stand in the plan once
    x = x.cast("double")
    parts = F.struct(x.alias("x"), (x * scale).alias("p"), F.floor(x * scale).cast("double").alias("whole"))
    return F.transform(F.array(parts), nearest)[0]


def clamp(x: Column, low: Column, high: Column) -> Column:
    """x between low and high; high where low is above it; null where any of the three is."""
    return F.when(x.isNotNull() & low.isNotNull() & high.isNotNull(), F.least(F.greatest(x, low), high))


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern is found anywhere in the text."""
    return text.rlike(pattern.replace("(?P<", "(?<"))


def minute_of_day(ts: Column, zone: str = "UTC") -> Column:
    local = F.from_utc_timestamp(F.timestamp_seconds(ts), zone)
    return F.hour(local) * 60 + F.minute(local)


def during(ts: Column, window: str, zone: str = "UTC") -> Column:
    """Local time within 'HH:MM-HH:MM', the start included, the end not; may wrap midnight."""
    start, end = (int(t[:2]) * 60 + int(t[3:5]) for t in window.split("-"))
    at = minute_of_day(ts, zone)
    return (at >= start) & (at < end) if start <= end else (at >= start) | (at < end)


def dow(ts: Column, zone: str = "UTC") -> Column:
    """'mon' to 'sun' in local time."""
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(F.from_utc_timestamp(F.timestamp_seconds(ts), zone)) + 1)


def msg_hash(message: Column) -> Column:
    """16 hex digits that messages differing only in case, blanks and numbers share."""
    plain = F.trim(F.regexp_replace(F.lower(message), r"\s+", " "))
    plain = F.regexp_replace(F.regexp_replace(plain, "[0-9a-f]{8,}", "#"), "[0-9]+", "#")
    return F.substring(F.sha2(plain.cast("binary"), 256), 1, 16)


def episode_key(provider: Column, event_id: Column, message: Column) -> Column:
    return F.concat(provider, F.lit(":"), F.coalesce(event_id, msg_hash(message)))


def severity_name(severity: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), severity + 1)


def from_map(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def clean_message(message: Column, limit: int = 2048) -> Column:
    """Without ASCII control characters, cut to ``limit`` characters."""
    return F.substring(F.regexp_replace(message, r"[\x00-\x1f\x7f]", ""), 1, limit)


#: A format spec: [[fill]align][sign][0][width][,][.precision][type].
_SPEC = re.compile(r"(?:(.)?([<>^=]))?([-+ ])?(0)?(\d+)?(,)?(?:\.(\d+))?([a-zA-Z%])?")


class TemplateError(ValueError):
    """The template isn't one."""


def template_parts(text: str) -> list[str | tuple[str, str]]:
    """Literal texts and (name, spec) fields of a template such as '{entity} at {used_pct:.1f}%'."""
    try:
        parsed = list(string.Formatter().parse(text))
    except ValueError as e:
        raise TemplateError(f"not a template: {text!r}") from e
    out: list[str | tuple[str, str]] = []
    for literal, name, spec, conversion in parsed:
        if literal:
            out.append(literal)
        if name is not None:
            if not name.isidentifier() or conversion or "{" in (spec or ""):
                raise TemplateError(f"not a field: {name!r}")
            out.append((name, spec or ""))
    return out


def _fixed(x: Column, digits: int, comma: bool) -> Column:
    return F.format_string(f"%{',' if comma else ''}.{digits}f", roundv(x, digits))


def formatted(value: Column, spec: str, kind: str = "number") -> Column:
    """A value by a format spec; by its plain text where the spec doesn't suit the value's kind ('number', 'whole' or 'text').

    Types f, F, % and d, and texts by s or none, with fill, align, sign, zeros, width, thousands and precision.
    """
    plain = value.cast("string")
    found = _SPEC.fullmatch(spec)
    if not spec or not found:
        return plain
    fill, align, sign, zero, width, comma, precision, type_ = found.groups()
    if kind == "text":
        if type_ not in (None, "s") or sign or comma or align == "=" or zero:
            return plain
        shown = F.substring(value, 1, int(precision)) if precision is not None else value
        minus = F.lit("")
    else:
        if type_ not in ("f", "F", "%", "d") or (type_ == "d" and (kind != "whole" or precision is not None)):
            return plain
        x = value.cast("double")
        digits = 0 if type_ == "d" else int(precision or 6)
        shown = _fixed(F.abs(x) * (100.0 if type_ == "%" else 1.0), digits, bool(comma))
        shown = F.concat(shown, F.lit("%")) if type_ == "%" else shown
        minus = F.when(x < 0, "-").otherwise({"+": "+", " ": " "}.get(sign, ""))
    align = align or ("=" if zero else "<" if kind == "text" else ">")
    fill = fill or ("0" if zero else " ")
    if not width:
        return F.concat(minus, shown)
    room = F.lit(int(width)) - F.length(minus) - F.length(shown)
    pad = lambda n: F.repeat(F.lit(fill), F.greatest(n, F.lit(0)).cast("int"))
    if align == "=":
        return F.concat(minus, pad(room), shown)
    left = F.lit(0) if align == "<" else room if align == ">" else F.floor(F.greatest(room, F.lit(0)) / 2)
    return F.concat(pad(left), minus, shown, pad(room - F.greatest(left, F.lit(0))))


def render_template(text: str, columns: dict[str, tuple[Column, str]], limit: int = 200) -> Column:
    """A message from template text. columns: each name's column and kind ('number', 'whole' or 'text'); names without one,
    and nulls, give 'n/a' whatever their spec."""
    parts = []
    for part in template_parts(text):
        if isinstance(part, str):
            parts.append(F.lit(part))
        elif part[0] not in columns:
            parts.append(F.lit("n/a"))
        else:
            column, kind = columns[part[0]]
            parts.append(F.when(column.isNull(), "n/a").otherwise(formatted(column, part[1], kind)))
    return F.substring(F.concat(*parts), 1, limit) if parts else F.lit("")


def render(template: list, limit: int = 200) -> Column:
    """A message of literal texts and (column, digits or None) fields; 'n/a' where a field is null."""
    parts = []
    for part in template:
        if isinstance(part, str):
            parts.append(F.lit(part))
        else:
            column, digits = part
            shown = column.cast("string") if digits is None else _fixed(column, digits, False)
            parts.append(F.when(column.isNull(), "n/a").otherwise(shown))
    return F.substring(F.concat(*parts), 1, limit)


def tone(percent: Column, warn: float = 80.0, error: float = 100.0) -> Column:
    """'ok', 'warn' or 'error' of a budget's used share."""
    return F.when(percent.isNull(), "unknown").when(percent >= error, "error").when(percent >= warn, "warn").otherwise("ok")
