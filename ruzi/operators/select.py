"""SELECT as one DataFrame: scans, joins, grouping, sorting, projection, limit.

Nothing is sorted that the caller can't see: stored order is kept only where
``ordered`` asks for it or a limit without a sort depends on it, and then as a sort
key of the final rows, which Spark plans as a top-k.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruzi.catalog import Catalog
from ruzi.errors import EngineError
from ruzi.functions import values as V
from ruzi.plans import ast
from ruzi.plans.binder import Binder, Bound, Input, Output, impossible

#: Marks errors that a running query raises for its data.
RAISED = "E_TYPE: "
RESULT_PREFIX = {"count": "bara", "sum": "teranya", "min": "nto", "max": "nini"}


@dataclass(frozen=True)
class Plan:
    """``frame`` has the result's columns by ``names``; after them, for ``*``, the names present in each input's row."""

    frame: DataFrame
    names: list[str]
    sources: list[tuple[str, str] | None]


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def joined(binder: Binder, frames: list[DataFrame], bound: list[Bound]) -> DataFrame:
    """Tables in their written order, each comparison as early as its columns are there."""
    waiting = list(bound)

    def ready(have: set[str]) -> list[Bound]:
        found = [b for b in waiting if b.inputs <= have]
        waiting[:] = [b for b in waiting if not b.inputs <= have]
        return found

    def filtered(frame: DataFrame, own: Input) -> DataFrame:
        conditions = [b.condition for b in ready({own.prefix})]
        return frame.where(every(conditions)) if conditions else frame

    sides = [filtered(frame, own) for frame, own in zip(frames, binder.inputs)]
    result, have = sides[0], {binder.inputs[0].prefix}
    for side, own in zip(sides[1:], binder.inputs[1:]):
        have.add(own.prefix)
        conditions = [part for b in ready(have) for part in (b.hashed, b.condition) if part is not None]
        result = result.join(side, every(conditions)) if conditions else result.crossJoin(side)
    return result


def stored_order(binder: Binder, catalog: Catalog, select: ast.Select) -> list[Column]:
    """Row positions, left table first; a limited join with an index on the left alone is walked from the right."""
    rows = [F.col(f"{i.prefix}_row") for i in binder.inputs]
    if select.limit is not None and len(rows) == 2 and all(i.table.owned for i in binder.inputs):
        for p in select.where:
            if p.right is None or p.op not in ("loose", "strict"):
                continue
            ends = {binder.find(ref).prefix: ref.name for ref in (p.left, p.right)}
            if len(ends) == 2:
                left, right = (catalog.has_index(i.table.name, ends[i.prefix]) for i in binder.inputs)
                if left and not right:
                    return rows[::-1]
    return rows


def direction(column: Column, descending: bool) -> Column:
    """Nulls come last both ways."""
    return column.desc_nulls_last() if descending else column.asc_nulls_last()


def result_name(item: ast.ColumnRef | ast.Aggregate) -> str:
    if isinstance(item, ast.ColumnRef):
        return item.name
    prefix = RESULT_PREFIX[item.function]
    return f"{prefix}_{item.column.name}" if item.column else prefix


def refuse(message: str) -> Column:
    return F.raise_error(F.lit(RAISED + message))


def aggregate(binder: Binder, item: ast.Aggregate) -> Column:
    """Count, sum, least or greatest; values that have no sum or order end the query when they are met."""
    if item.column is None:
        return F.count(F.lit(1))
    operand, name = binder.operand(item.column), item.column.name
    column, kind = operand.column, operand.kind
    if item.function == "count":
        return F.count(column)
    if item.function == "sum":
        if kind == "number":
            return F.sum(column)
        number = F.when(column["t"] == V.NUMBER, column["n"]) if kind == "any" else F.when(F.lit(False), F.lit(0.0))
        return F.sum(number.when(column.isNotNull(), refuse(f"column '{name}' has a value that isn't a number").cast("double")))
    if kind == "any":
        single = F.when(column["t"] != V.JSON, column)
        column = single.when(column.isNotNull(), refuse(f"column '{name}' has an object").cast(V.TAGGED))
    return F.min(column) if item.function == "min" else F.max(column)


def grouped(binder: Binder, select: ast.Select, frame: DataFrame, order: list[Column]) -> tuple[DataFrame, list[Output], list[Column]]:
    """Groups in first-seen order, which is the least position of each, unless the sort tells all groups apart."""
    keys = select.group or ()
    for item in select.columns:
        if isinstance(item, ast.ColumnRef) and item not in keys:
            raise EngineError("E_TYPE", f"column '{item}' isn't in koranya, nor inside bara, teranya, nto or nini")
    names = [result_name(item) for item in select.columns]
    if len(set(names)) < len(names):
        raise EngineError("E_TYPE", f"result column '{next(n for n in names if names.count(n) > 1)}' is used twice")
    measures = {item: f"a{i}" for i, item in enumerate(dict.fromkeys(
        item for item in (*select.columns, *(k.item for k in select.order)) if isinstance(item, ast.Aggregate)
    ))}
    held = {key: f"g{i}" for i, key in enumerate(dict.fromkeys(keys))}
    aggregates = [aggregate(binder, item).alias(name) for item, name in measures.items()]
    if order:
        aggregates.append(F.min(F.struct(*order)).alias("first_seen"))
    by = [binder.operand(key).column.alias(name) for key, name in held.items()]
    if keys:
        result = frame.groupBy(*by).agg(*(aggregates or [F.count(F.lit(1)).alias("a0")]))
    else:
        result = frame.agg(*aggregates)

    def place(item: ast.ColumnRef | ast.Aggregate) -> Column | None:
        if item in measures or item in held:
            return F.col(measures.get(item) or held.get(item))
        same = [c for c in select.columns if result_name(c) == result_name(item)]
        same = same or [k for k in held if k.name == getattr(item, "name", None)]
        return place(same[0]) if same else None

    outputs = [Output(name, None, None, place(item)) for name, item in zip(names, select.columns)]
    sorts = [direction(found, key.descending) for key in select.order if (found := place(key.item)) is not None]
    return result, outputs, sorts + ([F.col("first_seen")] if order and keys else [])


def sorts_groups_apart(binder: Binder, select: ast.Select) -> bool:
    """Whether the sort names every grouping column, so that no two groups tie."""
    place = lambda ref: (binder.find(ref).prefix, ref.name)
    sorted_by = {place(key.item) for key in select.order if isinstance(key.item, ast.ColumnRef)}
    return bool(select.group) and {place(key) for key in select.group} <= sorted_by


def planned(spark: SparkSession, catalog: Catalog, select: ast.Select, ordered: bool = False) -> Plan:
    """The DataFrame of a SELECT; ``ordered`` asks for stored order where the statement names none."""
    binder = Binder(catalog, select.tables)
    shaped = select.columns is not None and (bool(select.group) or any(isinstance(c, ast.Aggregate) for c in select.columns))
    bound = [binder.predicate(p) for p in select.where]
    mentioned = [*(select.columns or ()), *(select.group or ()), *(key.item for key in select.order)]
    for item in mentioned:
        ref = item.column if isinstance(item, ast.Aggregate) else item
        if ref is not None:
            binder.find(ref)
    if select.columns is None and select.group:
        raise EngineError("E_TYPE", "koranya needs named columns, not *")
    if not shaped and any(isinstance(key.item, ast.Aggregate) for key in select.order):
        raise EngineError("E_TYPE", "tondeka can sort by bara, teranya, nto or nini only after koranya")
    positions = ordered or select.limit is not None and not (shaped and not select.group)
    positions = positions and not (shaped and sorts_groups_apart(binder, select))
    frames = [i.table.scan(spark, i.prefix, positions) for i in binder.inputs]
    frame = joined(binder, frames, bound)
    if impossible(select.where):
        frame = frame.where(F.lit(False))
    order = stored_order(binder, catalog, select) if positions else []
    if shaped:
        frame, outputs, sorts = grouped(binder, select, frame, order)
    else:
        outputs = binder.star() if select.columns is None else binder.listed(select.columns)
        sorts = [direction(binder.operand(key.item).column, key.descending) for key in select.order] + order
    if sorts:
        frame = frame.orderBy(*sorts)
    if select.limit is not None:
        frame = frame.limit(select.limit)
    hidden = []
    if select.columns is None:
        hidden = [F.col(f"{i.prefix}_present").alias(f"__present_{i.prefix}") for i in binder.inputs if i.table.owned]
    sources = [(o.input.prefix, o.column) if o.input is not None and o.input.table.owned else None for o in outputs]
    return Plan(frame.select(*[o.value.alias(o.name) for o in outputs], *hidden), [o.name for o in outputs], sources)
