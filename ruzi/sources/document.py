"""JSON documents: an object whose key ``db`` holds ``{table: [row, ...]}``; its other keys don't matter."""

from __future__ import annotations

import json
from dataclasses import replace
from pathlib import Path
from typing import Any

from ruzi.catalog import Buffer, Catalog
from ruzi.errors import EngineError
from ruzi.plans.parser import check_json


def read_document(path: str) -> Catalog:
    """A document's tables, every column of kind any."""
    try:
        found: Any = json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError) as error:
        raise EngineError("E_IO", f"{path} isn't a JSON document: {error}") from error
    if not isinstance(found, dict) or not isinstance(found.get("db"), dict):
        raise EngineError("E_IO", f"{path} has no object 'db'")
    catalog = Catalog()
    for name, rows in found["db"].items():
        if not isinstance(rows, list) or any(not isinstance(row, dict) for row in rows):
            raise EngineError("E_IO", f"table '{name}' of {path} isn't a list of objects")
        catalog = catalog.created(name)
        table, stored = catalog.table(name), []
        for number, row in enumerate(rows, 1):
            row = check_json(row, name)
            table = replace(table, columns=table.checked(row))
            stored.append((number, row))
        catalog = catalog.with_table(replace(table, pending=Buffer(stored, len(stored)), next_row=len(stored) + 1))
    return catalog
