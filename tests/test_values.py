"""Column expressions against a plain evaluator of the same rules, on every pair of awkward values."""

from __future__ import annotations

import itertools
import math

import pytest
from pyspark.sql import functions as F

from ruzi.functions import values as V

SAMPLES = [
    None, True, False, 0.0, -0.0, 1.0, -5.0, 16.0, 1e308, "", " ", "1", "1.0", " 1\t", " 1﻿", "0x10", "0X1f", "0b1", "0o17", "-0", "1e0",
    "1e400", "1d", "1f", "NaN", "inf", "Infinity", "+1", ".5", "5.", ".", "1_0", "--1", "-0x1", "0x", "é", "true", {"a": 1}, [1, 2], [],
]


def kind_of(value):
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, float) else "string" if isinstance(value, str) else "json"


def spelt(value):
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, float):
        return value
    return V.number_in(value) if isinstance(value, str) else None


def loose(a, b):
    if a is None or b is None or "json" in (kind_of(a), kind_of(b)):
        return False
    if kind_of(a) == kind_of(b):
        return a == b
    return {kind_of(a), kind_of(b)} == {"number", "string"} and spelt(a) is not None and spelt(a) == spelt(b)


def strict(a, b):
    return a is not None and b is not None and kind_of(a) == kind_of(b) != "json" and a == b


def below(a, b):
    left = spelt(a)
    return left is not None and kind_of(b) == "number" and b is not None and left < b


def operands(frame, kinds):
    return [V.Operand(frame[name], kind) for name, kind in kinds]


def test_spelt_numbers(spark):
    texts = [v for v in SAMPLES if isinstance(v, str)] + ["0x" + "f" * 40, "0b" + "1" * 70, "00012", "1e-400"]
    frame = spark.createDataFrame([(t,) for t in texts], "s string").select("s", V.number(F.col("s")).alias("n"))
    for row in frame.collect():
        assert row.n == V.number_in(row.s), row
    assert [V.number_in(t) for t in ("0x10", " 1\t", "1e400", "1d", "")] == [16.0, 1.0, None, None, None]


def test_pairs_of_any(spark):
    pairs = list(itertools.product(range(len(SAMPLES)), repeat=2))
    rows = [(i, j, V.tagged(SAMPLES[i]), V.tagged(SAMPLES[j])) for i, j in pairs]
    frame = spark.createDataFrame(rows, V.T.StructType([V.T.StructField("i", V.T.IntegerType()), V.T.StructField("j", V.T.IntegerType()), V.T.StructField("a", V.TAGGED), V.T.StructField("b", V.TAGGED)]))
    a, b = operands(frame, (("a", "any"), ("b", "any")))
    found = frame.select(
        "i", "j", V.loosely_equal(a, b).alias("loose"), V.strictly_equal(a, b, False).alias("strict"), V.strictly_equal(a, b, True).alias("numbers"),
        V.compare_columns("lt", a, b).alias("below"), (V.loose_bucket(a) == V.loose_bucket(b)).alias("bucket"),
    )
    for row in found.collect():
        x, y = SAMPLES[row.i], SAMPLES[row.j]
        assert bool(row.loose) == loose(x, y), (x, y)
        assert bool(row.strict) == strict(x, y), (x, y)
        assert bool(row.numbers) == (strict(x, y) and kind_of(x) == "number"), (x, y)
        assert bool(row.below) == below(x, y), (x, y)
        assert row.bucket or not row.loose, (x, y)


def test_literals_and_typed_columns(spark):
    typed = {"number": [v for v in SAMPLES if isinstance(v, float)], "string": [v for v in SAMPLES if isinstance(v, str)], "boolean": [True, False]}
    literals = [v for v in SAMPLES if not isinstance(v, (dict, list))]
    for kind, values in [*typed.items(), ("any", SAMPLES)]:
        stored = [V.tagged(v) if kind == "any" else v for v in [*values, None]]
        schema = V.T.StructType([V.T.StructField("i", V.T.IntegerType()), V.T.StructField("v", V.SPARK_TYPES[kind])])
        frame = spark.createDataFrame(list(enumerate(stored)), schema)
        operand = V.Operand(frame["v"], kind)
        checks = [V.equals_literal(operand, v).alias(f"e{n}") for n, v in enumerate(literals)]
        numbers = [v for v in literals if isinstance(v, float)]
        checks += [V.compare_literal("strict", operand, v).alias(f"s{n}") for n, v in enumerate(numbers)]
        checks += [V.compare_literal("lt", operand, v).alias(f"l{n}") for n, v in enumerate(numbers)]
        for row in frame.select("i", *checks).collect():
            value = [*values, None][row.i]
            for n, literal in enumerate(literals):
                want = value is None if literal is None else loose(value, literal)
                assert bool(row[f"e{n}"]) == want, (kind, value, literal)
            for n, literal in enumerate(numbers):
                assert bool(row[f"s{n}"]) == strict(value, literal), (kind, value, literal)
                assert bool(row[f"l{n}"]) == below(value, literal), (kind, value, literal)


def test_order_of_any(spark):
    frame = spark.createDataFrame([(i, V.tagged(v)) for i, v in enumerate(SAMPLES)], V.T.StructType([V.T.StructField("i", V.T.IntegerType()), V.T.StructField("v", V.TAGGED)]))
    for descending in (False, True):
        order = frame.v.desc_nulls_last() if descending else frame.v.asc_nulls_last()
        ranks = [{"boolean": 1, "number": 2, "string": 3, "json": 4}[kind_of(v)] if v is not None else 9 for v in (SAMPLES[r.i] for r in frame.orderBy(order).collect())]
        assert ranks[-1] == 9 and ranks[:-1] == sorted(ranks[:-1], reverse=descending)


@pytest.mark.parametrize(("value", "seen"), [(2.0, "2"), (2.5, "2.5"), (-0.0, "-0.0"), (1e300, "1e+300")])
def test_plain_numbers(value, seen):
    assert str(V.plain(value)) == seen and math.isclose(V.plain(value), value)
