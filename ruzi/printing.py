"""Rows as a text table, and values and names as statement text."""

from __future__ import annotations

import json
import re
from decimal import Decimal
from typing import Any

from ruzi.catalog import check_name
from ruzi.errors import EngineError


def number_text(value: float) -> str:
    """Whole numbers without a point, as the statements write them."""
    return str(int(value)) if float(value).is_integer() and abs(value) < 1e21 else repr(float(value))


def cell(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, str):
        return re.sub(r"\r\n|\n|\r", r"\\n", value).replace("\t", "\\t")
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False, default=str)


def table_text(rows: list[dict[str, Any]]) -> str:
    """Box drawing; columns of numbers to the right, null for what is absent."""
    count = f"({len(rows)} row{'' if len(rows) == 1 else 's'})\n"
    names = list(dict.fromkeys(name for row in rows for name in row))
    if not names:
        return count
    columns = []
    for name in names:
        values = [row.get(name) for row in rows]
        held = [v for v in values if v is not None]
        right = bool(held) and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in held)
        lines = [name, *map(cell, values)]
        width = max(map(len, lines))
        columns.append((width, [line.rjust(width) if right else line.ljust(width) for line in lines]))

    def rule(left: str, middle: str, right: str) -> str:
        return left + middle.join("─" * (width + 2) for width, _ in columns) + right

    body = ["│" + "│".join(f" {lines[i]} " for _, lines in columns) + "│" for i in range(len(rows) + 1)]
    return "\n".join([rule("┌", "┬", "┐"), body[0], rule("├", "┼", "┤"), *body[1:], rule("└", "┴", "┘"), count])


def sql_literal(value: Any) -> str:
    """A value as statement text: quoted strings, numbers without exponents."""
    if value is None:
        return "ubusa"
    if isinstance(value, bool):
        return "nibyo" if value else "sibyo"
    if isinstance(value, (int, float)):
        number = float(value)
        if number != number or abs(number) == float("inf"):
            raise EngineError("E_TYPE", "a literal's number is finite")
        text = format(Decimal(repr(number)), "f")
        return re.sub(r"\.0+$", "", text)
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")
        return f'"{escaped}"'
    raise EngineError("E_TYPE", "only null, booleans, numbers and strings have a literal; pass the rest as $name")


def sql_name(name: str) -> str:
    """The name itself, if a table or column may have it."""
    return check_name(name, "name")
