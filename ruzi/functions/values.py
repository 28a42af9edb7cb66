"""The dialect's value rules as Column expressions.

A column has a kind: number, string, boolean, other (a native type that passes
through), or any.  An ``any`` value is a struct whose first field ranks its type,
so that Spark's own struct order is the dialect's order: booleans, numbers,
strings, then JSON by its text; a null struct is null.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

BOOLEAN, NUMBER, STRING, JSON = 1, 2, 3, 4
TAGGED = T.StructType([
    T.StructField("t", T.ByteType()), T.StructField("b", T.BooleanType()), T.StructField("n", T.DoubleType()),
    T.StructField("s", T.StringType()), T.StructField("j", T.StringType()),
])
SPARK_TYPES = {"number": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "any": TAGGED}

#: White space that surrounds a number in a string without hurting it.
BLANK = "\t\n\x0b\x0c\r    -     　﻿"
DECIMAL = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
BASES = {"x": (16, "[0-9a-fA-F]"), "o": (8, "[0-7]"), "b": (2, "[01]")}


@dataclass(frozen=True)
class Operand:
    """A column with its kind; ``present`` is where a row has the column at all (None: everywhere), ``whole`` if its native type is an integer."""

    column: Column
    kind: str
    present: Column | None = None
    whole: bool = False


# Python values


def tagged(value: Any) -> tuple | None:
    """A value as an ``any`` column stores it."""
    if value is None:
        return None
    if isinstance(value, bool):
        return (BOOLEAN, value, None, None, None)
    if isinstance(value, (int, float)):
        return (NUMBER, None, float(value), None, None)
    if isinstance(value, str):
        return (STRING, None, None, value, None)
    return (JSON, None, None, None, json.dumps(plain(value), separators=(",", ":"), ensure_ascii=False))


def plain(value: Any) -> Any:
    """A stored value as callers see it: whole doubles as integers, tagged structs as what they hold."""
    if isinstance(value, T.Row) and tuple(value.__fields__) == ("t", "b", "n", "s", "j"):
        return json.loads(value.j) if value.t == JSON else plain(next((v for v in value[1:4] if v is not None), None))
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53 and str(value) != "-0.0":
        return int(value)
    if isinstance(value, dict):
        return {key: plain(item) for key, item in value.items()}
    if isinstance(value, (list, tuple)) and not isinstance(value, T.Row):
        return [plain(item) for item in value]
    return value


def number_in(text: str) -> float | None:
    """The finite number that a string spells, as the reference language of the dialect reads it."""
    body = re.sub(f"^[{BLANK}]+|[{BLANK}]+$", "", text)
    if re.fullmatch(DECIMAL, body):
        value = float(body)
        return value if math.isfinite(value) else None
    for letter, (base, digit) in BASES.items():
        if re.fullmatch(f"0[{letter}{letter.upper()}]{digit}+", body):
            return float(int(body[2:], base))
    return None


# Columns


def number(text: Column) -> Column:
    """The same for a column; null where the string spells no finite number."""
    body = F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")
    value = F.when(body.rlike(f"^{DECIMAL}$"), body.try_cast("double"))
    for letter, (base, digit) in BASES.items():
        based = body.rlike(f"^0[{letter}{letter.upper()}]{digit}+$")
        # Each digit adds to what stands before it; any length is exact up to the double's precision.
        digits = F.split(F.lower(F.substring(body, 3, 1 << 30)), "")
        places = F.transform(F.filter(digits, lambda d: d != ""), lambda d: F.conv(d, 16, 10).cast("double"))
        value = value.when(based, _fold(places, base))
    finite = F.abs(value) < float("inf")
    return F.when(finite, value)


def _fold(places: Column, base: int) -> Column:
    return F.aggregate(places, F.lit(0.0), lambda total, digit: total * F.lit(float(base)) + digit)


def any_of(all_of: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, all_of)


def lifted(operand: Operand) -> Column:
    """A typed column as an ``any`` struct."""
    if operand.kind == "any":
        return operand.column
    place = {"boolean": ("b", BOOLEAN), "number": ("n", NUMBER), "string": ("s", STRING)}.get(operand.kind)
    if place is None:
        name, tag, value = "j", JSON, operand.column.cast("string")
    else:
        (name, tag), value = place, operand.column
    fields = [F.lit(tag).cast("byte").alias("t")]
    for field in TAGGED.fields[1:]:
        held = value if field.name == name else F.lit(None)
        fields.append(held.cast(field.dataType).alias(field.name))
    return F.when(operand.column.isNotNull(), F.struct(*fields))


def as_number(operand: Operand, from_text: bool = True) -> Column:
    """The number that a value is or, if wanted, spells; null for the rest."""
    column = operand.column
    if operand.kind == "number":
        return column
    if operand.kind == "string" and from_text:
        return number(column)
    if operand.kind == "any":
        found = F.when(column["t"] == NUMBER, column["n"])
        return found.when(column["t"] == STRING, number(column["s"])) if from_text else found
    return F.lit(None).cast("double")


def unsigned(zero: float) -> float:
    """-0.0 as 0.0, which compares alike; both as literals of one projection give Spark 4.1 wrong code."""
    return zero + 0.0


def number_literal(operand: Operand, value: float) -> float | int:
    """A number to compare a column with: a whole one where the column is, which a scan can check against its files.

    Below 2**53 no integer is taken for another as a double.
    """
    value = unsigned(value)
    return int(value) if operand.whole and value.is_integer() and abs(value) < 2**53 else value


def equals_literal(operand: Operand, value: Any) -> Column:
    """Loose equality with a literal: a number also equals a string that spells it."""
    column, kind = operand.column, operand.kind
    if value is None:
        null = column.isNull()
        return null & operand.present if operand.present is not None else null
    if isinstance(value, bool):
        return {"boolean": lambda: column == value, "any": lambda: (column["t"] == BOOLEAN) & (column["b"] == value)}.get(kind, lambda: F.lit(False))()
    if isinstance(value, float):
        return as_number(operand) == number_literal(operand, value) if kind != "boolean" and kind != "other" else F.lit(False)
    if isinstance(value, str):
        spelt = number_in(value)
        same = {"string": lambda: column == value, "any": lambda: (column["t"] == STRING) & (column["s"] == value)}.get(kind)
        parts = [same()] if same else []
        if spelt is not None and kind in ("number", "any"):
            parts.append(as_number(operand, False) == number_literal(operand, spelt))
        return any_of([F.coalesce(part, F.lit(False)) if len(parts) > 1 else part for part in parts]) if parts else F.lit(False)
    return F.lit(False)


def compare_literal(op: str, operand: Operand, value: float) -> Column:
    """Strict equality or a range against a number."""
    value = number_literal(operand, value)
    if op == "strict":
        return as_number(operand, False) == value if operand.kind in ("number", "any") else F.lit(False)
    if operand.kind in ("boolean", "other"):
        return F.lit(False)
    found = as_number(operand)
    return {"lt": lambda: found < value, "lte": lambda: found <= value, "gt": lambda: found > value, "gte": lambda: found >= value}[op]()


def loosely_equal(left: Operand, right: Operand) -> Column:
    """Loose equality of two columns; null or missing on either side is no match."""
    kinds = {left.kind, right.kind}
    if "other" in kinds:
        return F.lit(False)
    if len(kinds) == 1 and "any" not in kinds:
        return left.column == right.column
    if kinds == {"number", "string"}:
        return as_number(left) == as_number(right)
    if "any" not in kinds:
        return F.lit(False)
    a, b = lifted(left), lifted(right)
    same = (a["t"] == b["t"]) & (a["t"] != JSON) & (a == b)
    mixed = (a["t"] != b["t"]) & a["t"].isin(NUMBER, STRING) & b["t"].isin(NUMBER, STRING) & (as_number(left) == as_number(right))
    return F.coalesce(same, F.lit(False)) | F.coalesce(mixed, F.lit(False))


def loose_bucket(operand: Operand) -> Column:
    """Equal for any two loosely equal values, so that a join can hash on it; null where nothing is equal."""
    a = lifted(operand)
    spelt = as_number(operand)
    return F.when(a["t"] != JSON, F.struct(
        F.when(spelt.isNotNull(), NUMBER).otherwise(a["t"]).alias("k"), F.coalesce(spelt + 0.0, F.lit(0.0)).alias("n"),
        F.when(spelt.isNull(), F.coalesce(a["s"], a["b"].cast("string"))).alias("s"),
    ))


def strictly_equal(left: Operand, right: Operand, numbers_only: bool) -> Column:
    """Equality of kind and value of two columns; JSON never equals."""
    kinds = {left.kind, right.kind}
    if numbers_only:
        return as_number(left, False) == as_number(right, False) if kinds <= {"number", "any"} else F.lit(False)
    if "other" in kinds or "any" not in kinds and len(kinds) > 1:
        return F.lit(False)
    if "any" not in kinds:
        return left.column == right.column
    a, b = lifted(left), lifted(right)
    return (a == b) & (a["t"] != JSON)


def compare_columns(op: str, left: Operand, right: Operand) -> Column:
    """A range between two columns: the right value has to be a number, the left may spell one."""
    if right.kind not in ("number", "any") or left.kind in ("boolean", "other"):
        return F.lit(False)
    a, b = as_number(left), as_number(right, False)
    return {"lt": lambda: a < b, "lte": lambda: a <= b, "gt": lambda: a > b, "gte": lambda: a >= b}[op]()
