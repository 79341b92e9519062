import random
import struct

import pytest
from pyspark.sql import functions as F

from gaugeloom.functions import scalar


def test_rounding_is_that_of_the_exact_binary_value(spark):
    rng = random.Random(7)
    values = [2.675, 1.005, 0.5, 1.5, 2.5, -2.5, -0.125, 0.125, 0.375, 1e15 + 0.3, 9007199254740993.0, 4503599627370497.5, -0.0, 0.0, 5e-324, 1e300, -1e300, None]
    values += [rng.randrange(-(10**7), 10**7) / 1000 for _ in range(30_000)]
    values += [rng.randrange(10**6) / 8 for _ in range(10_000)] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-12, 18) for _ in range(40_000)]
    values += [x for x in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(21_000)) if abs(x) < 1e280]
    assert len(values) > 100_000
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", *(scalar.roundv(F.col("x"), n).alias(f"r{n}") for n in (0, 1, 2, 3, 6)))
    for r in df.collect():
        for n in (0, 1, 2, 3, 6):
            assert r[f"r{n}"] == (None if r["x"] is None else round(r["x"], n)), (r["x"], n)


def test_rounding_keeps_what_is_no_number(spark):
    r = spark.sql("SELECT double('NaN') AS a, double('Infinity') AS b").select(scalar.roundv(F.col("a"), 2).alias("a"), scalar.roundv(F.col("b"), 2).alias("b")).first()
    assert r["a"] != r["a"] and r["b"] == float("inf")


SPECS = ["", ".0f", ".1f", ".2f", "f", "8.2f", "<8.1f", "^9.1f", "*>10.3f", "+.1f", " .1f", "08.2f", ",.2f", "12,.1f", ".1%", ".0%", "+09.1f", "=9.2f"]


def test_templates_format_as_python_does(spark):
    values = [0.0, 1.0, 2.675, -2.5, 1234567.891, 0.5, 99.95, -0.04]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", *(scalar.formatted(F.col("x"), s).alias(f"s{i}") for i, s in enumerate(SPECS)))
    for r in df.collect():
        for i, s in enumerate(SPECS):
            if s:
                assert r[f"s{i}"] == format(r["x"], s), (r["x"], s)


def test_templates_of_texts_and_whole_numbers(spark):
    df = spark.createDataFrame([("abc", 1234567)], "t string, n long")
    specs = [("t", "text", s) for s in ("", "s", ">6", "<6s", "^7", "*^8s", ".2s", "6.1")] + [("n", "whole", s) for s in ("d", ",d", "010d", "+d", "<12d", ".1f")]
    row = df.select(*(scalar.formatted(F.col(c), s, k) for c, k, s in specs)).first()
    assert list(row) == [format({"t": "abc", "n": 1234567}[c], s) for c, _, s in specs]


def test_specs_that_do_not_suit_fall_back_to_the_value(spark):
    df = spark.createDataFrame([("abc", 1.5)], "t string, x double")
    row = df.select(scalar.formatted(F.col("t"), ".1f", "text"), scalar.formatted(F.col("x"), "d"), scalar.formatted(F.col("x"), "s"), scalar.formatted(F.col("x"), "!!")).first()
    assert list(row) == ["abc", "1.5", "1.5", "1.5"]


def test_messages_from_template_text(spark):
    df = spark.createDataFrame([("web", 91.256, None)], "entity string, used double, left double")
    columns = {"entity": (F.col("entity"), "text"), "used": (F.col("used"), "number"), "left": (F.col("left"), "number")}
    row = df.select(scalar.render_template("{entity}: {{full}} {used:.1f}% of {left:.0f} by {who:>9}", columns), scalar.render_template("x" * 300, columns), scalar.render_template("", columns)).first()
    assert list(row) == ["web: {full} 91.3% of n/a by n/a", "x" * 200, ""]
    for bad in ("{", "{a b}", "{x!r}", "{0}", "{x:{y}}"):
        with pytest.raises(scalar.TemplateError):
            scalar.template_parts(bad)
