"""The rule language: a safe subset of Python expressions, compiled to columns with three-valued logic."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeloom.functions import scalar
from gaugeloom.functions import series

LONGEST_WINDOW = 6 * 3600
LONGEST_PATTERN = 512
#: Functions of a metric and a duration; of a metric.
WINDOWED = ("avg", "min", "max", "delta", "rate", "slope", "monot", "coverage")
POINT = ("last", "age", "baseline")
#: Names that every expression may use.
CONSTANTS = scalar.UNITS | {name: float(i) for i, name in enumerate(scalar.SEVERITIES)}
_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


class ExpressionError(ValueError):
    """The expression isn't in the language, or names something unknown."""


def duration(text: str) -> float:
    """Seconds of a duration such as '90s', '1.5h'."""
    found = re.fullmatch(r"(\d+(?:\.\d+)?)([smhd])", text) if isinstance(text, str) else None
    if not found:
        raise ExpressionError(f"not a duration: {text!r}")
    return float(found[1]) * _SECONDS[found[2]]


@dataclass(frozen=True)
class Names:
    """What an expression may refer to: metrics (numbers in columns), attributes (in columns; texts, if ``kinds`` doesn't
    name another type), parameters (values)."""

    metrics: frozenset[str] = frozenset()
    attrs: frozenset[str] = frozenset()
    params: dict[str, object] = field(default_factory=dict)
    zone: str = "UTC"
    keys: tuple[str, ...] = series.KEYS
    #: The columns of metrics and attributes; by default their own names.
    columns: dict[str, str] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)

    def column(self, name: str) -> Column:
        return F.col(self.columns.get(name, f"`{name}`"))


@dataclass(frozen=True)
class Typed:
    """A column and its static type: number, text, bool or null."""

    column: Column
    kind: str


@dataclass
class Compiled:
    """An expression's value, and the metrics whose rises or baselines must stand as columns before it is used."""

    value: Typed
    windows: set[tuple[str, int]]
    rises: set[str]
    baselines: set[str]
    metrics: set[str]

    @property
    def column(self) -> Column:
        return self.value.column

    def outcome(self) -> Column:
        """'true' where the value is exactly true, 'unknown' where it is null, else 'false'."""
        c = self.value.column
        if self.value.kind != "bool":
            return F.when(c.isNull(), "unknown").otherwise("false")
        return F.when(c.isNull(), "unknown").when(c, "true").otherwise("false")



def truthy(x: Typed) -> Column:
    if x.kind == "number":
        return x.column != 0
    if x.kind == "text":
        return F.length(x.column) > 0
    return x.column.cast("boolean")


def compile_expression(source: str, names: Names) -> Compiled:
    """Compile ``source``; raises :class:`ExpressionError` with the reason where it can't be."""
    try:
        tree = ast.parse(source.strip(), mode="eval")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise ExpressionError(f"not an expression: {source!r}") from e
    builder = _Builder(names)
    value = builder.build(tree.body)
    return Compiled(value, builder.windows, builder.rises, builder.baselines, builder.metrics)


class _Builder:
    def __init__(self, names: Names):
        self.names = names
        self.windows: set[tuple[str, int]] = set()
        self.rises: set[str] = set()
        self.baselines: set[str] = set()
        self.metrics: set[str] = set()

    def build(self, node: ast.AST) -> Typed:
        found = getattr(self, f"_{type(node).__name__.lower()}", None)
        if found is None:
            raise ExpressionError(f"{type(node).__name__} is not in the language")
        return found(node)

    def _literal(self, value: object) -> Typed:
        if value is None:
            return Typed(F.lit(None).cast("double"), "null")
        if isinstance(value, bool):
            return Typed(F.lit(value), "bool")
        if isinstance(value, int | float):
            return Typed(F.lit(float(value)), "number")
        if isinstance(value, str):
            return Typed(F.lit(value), "text")
        raise ExpressionError(f"not a value of the language: {value!r}")

    def _constant(self, node: ast.Constant) -> Typed:
        return self._literal(node.value)

    def _name(self, node: ast.Name) -> Typed:
        n = self.names
        if node.id in n.metrics:
            self.metrics.add(node.id)
            return Typed(series.last(n.column(node.id), n.keys), "number")
        if node.id in n.attrs:
            return Typed(n.column(node.id), n.kinds.get(node.id, "text"))
        if node.id in n.params:
            return self._literal(n.params[node.id])
        if node.id in CONSTANTS:
            return self._literal(CONSTANTS[node.id])
        raise ExpressionError(f"unknown name {node.id!r}")

    def _unaryop(self, node: ast.UnaryOp) -> Typed:
        x = self.build(node.operand)
        if isinstance(node.op, ast.Not):
            return Typed(~truthy(x), "bool")
        if isinstance(node.op, ast.USub):
            return Typed(-x.column, "number") if x.kind == "number" else self._literal(None)
        raise ExpressionError("only 'not' and '-' stand before a value")

    def _boolop(self, node: ast.BoolOp) -> Typed:
        parts = [truthy(self.build(v)) for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return Typed(out, "bool")

    def _binop(self, node: ast.BinOp) -> Typed:
        a, b = self.build(node.left), self.build(node.right)
        ops = {ast.Add: lambda x, y: x + y, ast.Sub: lambda x, y: x - y, ast.Mult: lambda x, y: x * y, ast.Div: F.try_divide, ast.Mod: scalar.floored_mod}
        if type(node.op) not in ops:
            raise ExpressionError(f"{type(node.op).__name__} is not in the language")
        if a.kind != "number" or b.kind != "number":
            return self._literal(None)
        return Typed(scalar.clean(ops[type(node.op)](a.column, b.column)), "number")

    def _compare(self, node: ast.Compare) -> Typed:
        if len(node.ops) == 1 and isinstance(node.ops[0], ast.In | ast.NotIn):
            return self._membership(node)
        values = [self.build(v) for v in (node.left, *node.comparators)]
        links = [self._link(op, a, b) for op, a, b in zip(node.ops, values[:-1], values[1:], strict=True)]
        missing = F.lit(False)
        for v in values:
            missing = missing | v.column.isNull()
        out = links[0]
        for link in links[1:]:
            out = out & link
        # a null among the operands makes the whole chain null, even after a link that is false
        return Typed(F.when(missing, None).otherwise(out), "bool")

    def _link(self, op: ast.cmpop, a: Typed, b: Typed) -> Column:
        numeric = ("number", "bool")
        x, y = (v.column.cast("double") if v.kind == "bool" else v.column for v in (a, b))
        comparable = a.kind == b.kind or a.kind in numeric and b.kind in numeric
        if isinstance(op, ast.Eq | ast.NotEq):
            same = x == y if comparable else F.lit(False)
            return same if isinstance(op, ast.Eq) else ~same
        ordered = a.kind == b.kind and a.kind in ("number", "text")
        if not ordered:
            return F.lit(None).cast("boolean")
        ops = {ast.Lt: x < y, ast.LtE: x <= y, ast.Gt: x > y, ast.GtE: x >= y}
        if type(op) not in ops:
            raise ExpressionError(f"{type(op).__name__} stands alone or is not in the language")
        return ops[type(op)]

    def _membership(self, node: ast.Compare) -> Typed:
        x = self.build(node.left)
        right = node.comparators[0]
        if not isinstance(right, ast.List | ast.Tuple):
            return self._literal(None) if not isinstance(right, ast.Name) else self._name_list(x, right)
        items = [self.build(v) for v in right.elts]
        missing = x.column.isNull()
        found = F.lit(False)
        for item in items:
            missing = missing | item.column.isNull()
            if item.kind == x.kind:
                found = found | (x.column == item.column)
        if isinstance(node.ops[0], ast.NotIn):
            found = ~found
        return Typed(F.when(missing, None).otherwise(found), "bool")

    def _name_list(self, x: Typed, node: ast.Name) -> Typed:
        if isinstance(self.names.params.get(node.id), list | tuple):
            values = self.names.params[node.id]
            return Typed(F.when(x.column.isNull(), None).otherwise(x.column.isin(list(values)) if values else F.lit(False)), "bool")
        return self._literal(None)

    def _ifexp(self, node: ast.IfExp) -> Typed:
        c, a, b = (self.build(v) for v in (node.test, node.body, node.orelse))
        kinds = {v.kind for v in (a, b)} - {"null"}
        if len(kinds) > 1:
            raise ExpressionError("both values of an 'if' must be of one type")
        test = truthy(c)
        return Typed(F.when(test.isNull(), None).when(test, a.column).otherwise(b.column), kinds.pop() if kinds else "null")

    def _call(self, node: ast.Call) -> Typed:
        if not isinstance(node.func, ast.Name) or node.keywords:
            raise ExpressionError("only plain calls of known functions are in the language")
        name, args = node.func.id, node.args
        if name in WINDOWED:
            return self._windowed(name, args)
        if name in POINT:
            return self._point(name, args)
        known = {"pct": 2, "abs": 1, "roundv": 2, "clamp": 3, "coalesce": 2, "matches": 2, "contains": 2, "during": 1, "dow": 0}
        if name not in known:
            raise ExpressionError(f"unknown function {name!r}")
        if len(args) != known[name]:
            raise ExpressionError(f"{name} takes {known[name]} arguments")
        return getattr(self, f"_fn_{name}")(args)

    def _metric(self, args: list[ast.expr]) -> str:
        if not args or not isinstance(args[0], ast.Name) or args[0].id not in self.names.metrics:
            raise ExpressionError("the first argument must name a metric")
        self.metrics.add(args[0].id)
        return args[0].id

    def _windowed(self, name: str, args: list[ast.expr]) -> Typed:
        metric = self._metric(args)
        if len(args) != 2 or not isinstance(args[1], ast.Constant):
            raise ExpressionError(f"{name} takes a metric and a duration")
        width = duration(args[1].value)
        if not 0 < width <= LONGEST_WINDOW:
            raise ExpressionError(f"a window is at most {LONGEST_WINDOW} seconds")
        self.windows.add((metric, int(width)))
        v, w, ts = self.names.column(metric), series.trailing(int(width), self.names.keys), F.col("ts")
        if name == "monot":
            self.rises.add(metric)
            return Typed(series.monot(F.col(f"`_rises_{metric}`"), v, w), "number")
        if name == "coverage":
            return Typed(series.coverage(v, w, ts, width), "number")
        if name in ("rate", "slope"):
            return Typed(getattr(series, name)(v, w, ts), "number")
        return Typed({"avg": series.avg, "min": series.low, "max": series.high, "delta": series.delta}[name](v, w), "number")

    def _point(self, name: str, args: list[ast.expr]) -> Typed:
        metric = self._metric(args)
        if len(args) != 1:
            raise ExpressionError(f"{name} takes a metric")
        v = self.names.column(metric)
        if name == "baseline":
            self.baselines.add(metric)
            return Typed(F.col(f"`_baseline_{metric}`"), "number")
        return Typed(series.last(v, self.names.keys) if name == "last" else series.age(v, F.col("ts"), self.names.keys).cast("double"), "number")

    def _numbers(self, args: list[ast.expr]) -> list[Column]:
        return [v.column if v.kind == "number" else F.lit(None).cast("double") for v in map(self.build, args)]

    def _fn_pct(self, args: list[ast.expr]) -> Typed:
        return Typed(scalar.pct(*self._numbers(args)), "number")

    def _fn_abs(self, args: list[ast.expr]) -> Typed:
        return Typed(F.abs(*self._numbers(args)), "number")

    def _fn_roundv(self, args: list[ast.expr]) -> Typed:
        if not isinstance(args[1], ast.Constant) or not isinstance(args[1].value, int):
            raise ExpressionError("roundv takes a number of digits")
        return Typed(scalar.roundv(self._numbers(args[:1])[0], args[1].value), "number")

    def _fn_clamp(self, args: list[ast.expr]) -> Typed:
        return Typed(scalar.clamp(*self._numbers(args)), "number")

    def _fn_coalesce(self, args: list[ast.expr]) -> Typed:
        a, b = map(self.build, args)
        kinds = {a.kind, b.kind} - {"null"}
        if len(kinds) > 1:
            raise ExpressionError("both values of coalesce must be of one type")
        return Typed(F.coalesce(a.column, b.column), kinds.pop() if kinds else "null")

    def _text(self, node: ast.expr) -> str:
        value = node.value if isinstance(node, ast.Constant) else self.names.params.get(node.id) if isinstance(node, ast.Name) else None
        if not isinstance(value, str):
            raise ExpressionError("a text is needed here")
        return value

    def _fn_matches(self, args: list[ast.expr]) -> Typed:
        x, pattern = self.build(args[0]), self._text(args[1])
        if len(pattern) > LONGEST_PATTERN:
            raise ExpressionError(f"a pattern has at most {LONGEST_PATTERN} characters")
        try:
            re.compile(pattern)
        except re.error as e:
            raise ExpressionError(f"not a pattern: {pattern!r}") from e
        return Typed(scalar.matches(x.column, pattern) if x.kind == "text" else F.lit(None).cast("boolean"), "bool")

    def _fn_contains(self, args: list[ast.expr]) -> Typed:
        x, y = map(self.build, args)
        return Typed(F.contains(x.column, y.column) if x.kind == y.kind == "text" else F.lit(None).cast("boolean"), "bool")

    def _fn_during(self, args: list[ast.expr]) -> Typed:
        window = self._text(args[0])
        if not re.fullmatch(r"([01]\d|2[0-3]):[0-5]\d-([01]\d|2[0-3]):[0-5]\d", window):
            raise ExpressionError(f"not a time of day: {window!r}")
        return Typed(scalar.during(F.col("ts"), window, self.names.zone), "bool")

    def _fn_dow(self, args: list[ast.expr]) -> Typed:
        return Typed(scalar.dow(F.col("ts"), self.names.zone), "text")
