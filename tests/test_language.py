import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeloom.plans.expression import ExpressionError, Names, compile_expression, duration

NAMES = Names(frozenset({"a", "b", "c"}), frozenset({"name"}), {"limit": 5, "zones": ["x", "y"]})
ROWS = [(1.0, 2.0, None, "abc"), (None, 0.0, 3.0, ""), (-7.0, 3.0, 7.0, None), (5.0, -3.0, 0.5, "Out of memory"), (0.0, None, None, "x")]


pytestmark = pytest.mark.usefixtures("spark")

def frame(spark, rows=ROWS):
    data = [("m", f"e{i}", 1000 + i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "monitor string, entity_id string, ts long, a double, b double, c double, name string")


def values(spark, text, rows=ROWS):
    made = compile_expression(text, NAMES)
    return [r.v for r in frame(spark, rows).select("entity_id", made.column.alias("v")).orderBy("entity_id").collect()]


TABLE = [
    ("a < b", [True, None, True, False, None]),
    ("1 < 0 < c", [None, False, False, False, None]),
    ("3 < 2 < a", [False, None, False, False, False]),
    ("a in [1, 5]", [True, None, False, True, False]),
    ("1 in [a, 1]", [True, None, True, True, True]),
    ("a not in [1]", [False, None, True, True, True]),
    ("1 in [c, 1]", [None, True, True, True, None]),
    ("a in []", [False, None, False, False, False]),
    ("name in zones", [False, False, None, False, True]),
    ("a > 0 and b > 0", [True, False, False, False, False]),
    ("a > 0 or b > 0", [True, None, True, True, None]),
    ("not a", [False, None, False, False, True]),
    ("a and name", [True, False, None, True, False]),
    ("a / b", [0.5, None, -7 / 3, 5 / -3, None]),
    ("a % b", [1.0, None, 2.0, -1.0, None]),
    ("-a + limit", [4.0, None, 12.0, 0.0, 5.0]),
    ("a * 1e308 * 10", [None, None, None, None, 0.0]),
    ("a if c > 1 else b", [None, 0.0 if False else None, -7.0, -3.0, None]),
    ("clamp(a, 0, 2)", [1.0, None, 0.0, 2.0, 0.0]),
    ("clamp(a, b, 9)", [2.0, None, 3.0, 5.0, None]),
    ("coalesce(a, 9)", [1.0, 9.0, -7.0, 5.0, 0.0]),
    ("pct(a, b)", [50.0, None, -700 / 3, -500 / 3, None]),
    ("abs(a)", [1.0, None, 7.0, 5.0, 0.0]),
    ("roundv(a / 2, 0)", [0.0, None, -4.0, 2.0, 0.0]),
    ("contains(name, 'memory')", [False, False, None, True, False]),
    ("matches(name, '(?P<x>b)c')", [True, False, None, False, False]),
    ("name == 'x'", [False, False, None, False, True]),
    ("name == 1", [False, False, None, False, False]),
    ("name < 1", [None] * 5),
    ("name + 1", [None] * 5),
    ("2 * MB", [2097152.0] * 5),
    ("critical", [4.0] * 5),
    ("None == 1", [None] * 5),
]


@pytest.mark.parametrize("text,want", [t for t in TABLE if t[1] is not None])
def test_table(spark, text, want):
    got = values(spark, text)
    assert [None if x is None else pytest.approx(x) if isinstance(x, float) else x for x in want] == got


def test_outcome_is_true_only_where_exactly_true(spark):
    made = compile_expression("a", NAMES)
    assert [r.v for r in frame(spark).select("entity_id", made.outcome().alias("v")).orderBy("entity_id").collect()] == ["false", "unknown", "false", "false", "false"]


@pytest.mark.parametrize(
    "text",
    ["", "a +", "import os", "x", "a.b", "a[0]", "lambda: 1", "open('f')", "avg(a)", "avg(b, '7h')", "avg(zz, '5m')", "avg(a, 5)", "matches(name, '(')", "during('25:00-26:00')", "a ** 2", "a if b else name", "roundv(a, b)", "f(a)", "[x for x in a]", "a is b", "'x' * " + "9" * 3 + ".real"],
)
def test_rejected(text):
    with pytest.raises(ExpressionError):
        compile_expression(text, NAMES)


def test_durations():
    assert [duration(t) for t in ("90s", "1.5h", "2m", "1d")] == [90, 5400, 120, 86400]
    for t in ("5", "m", "-1s", "1w", 5, "1 m"):
        with pytest.raises(ExpressionError):
            duration(t)


def truth(x):
    return None if x is None else bool(x)


def model(tree, row):
    """What an expression tree means, in plain Python."""
    op = tree[0]
    if op == "lit":
        return tree[1]
    if op == "ref":
        return row[tree[1]]
    args = [model(t, row) for t in tree[1:]]
    if op == "not":
        return None if args[0] is None else not args[0]
    if op in ("and", "or"):
        x, y = map(truth, args)
        stop = op == "or"
        return stop if stop in (x, y) else None if None in (x, y) else not stop
    if None in args:
        return None
    x, y = args
    if op in ("<", "=="):
        return x < y if op == "<" else x == y
    if op in ("/", "%") and y == 0:
        return None
    r = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: x - y * math.floor(x / y)}[op]()
    return r if math.isfinite(r) else None


def show(tree):
    if tree[0] == "lit":
        return repr(tree[1])
    if tree[0] == "ref":
        return "abc"[tree[1]]
    return f"(not {show(tree[1])})" if tree[0] == "not" else f"({show(tree[1])} {tree[0]} {show(tree[2])})"


numbers = st.recursive(
    st.one_of(st.integers(-4, 9).map(lambda n: ("lit", float(n))), st.integers(0, 2).map(lambda i: ("ref", i))), lambda s: st.tuples(st.sampled_from("+-*/%"), s, s), max_leaves=5
)
booleans = st.recursive(st.tuples(st.sampled_from(["<", "=="]), numbers, numbers), lambda s: st.one_of(st.tuples(st.just("not"), s), st.tuples(st.sampled_from(["and", "or"]), s, s)), max_leaves=5)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(trees=st.lists(booleans, min_size=6, max_size=6))
def test_columns_agree_with_plain_python(spark, trees):
    made = [compile_expression(show(t), NAMES).column.alias(f"v{i}") for i, t in enumerate(trees)]
    got = frame(spark).select("entity_id", *made).orderBy("entity_id").collect()
    for r, row in zip(got, ROWS, strict=True):
        for i, t in enumerate(trees):
            assert r[f"v{i}"] == model(t, row), show(t)


def test_time_functions(spark):
    df = spark.range(1).select(F.lit("m").alias("monitor"), F.lit("e").alias("entity_id"), F.lit(1704067200 + 23 * 3600).alias("ts"))
    names = Names(zone="UTC")
    texts = ["during('22:30-06:00')", "during('09:00-17:00')", "dow()"]
    assert list(df.select(*(compile_expression(t, names).column for t in texts)).first()) == [True, False, "mon"]
