"""Updates and deletions as new frames of a table."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruzi.catalog import PRESENT, ROW, Catalog, Table
from ruzi.errors import EngineError
from ruzi.functions.values import plain
from ruzi.plans import ast
from ruzi.plans.binder import Binder
from ruzi.sources.store import settled

#: Rewrites of a table after which its lineage is cut, and rows that a deletion logs one by one at most.
REWRITES, LOGGED = 16, 1000


def matching(catalog: Catalog, table: Table, where: tuple[ast.Predicate, ...]) -> Column:
    """Where a scan of the table meets all comparisons."""
    binder = Binder(catalog, (ast.TableRef(table.name),))
    conditions = [F.coalesce(binder.lenient(p), F.lit(False)) for p in where]
    return reduce(lambda a, b: a & b, conditions)


def rewritten(table: Table, scan: DataFrame) -> Table:
    """A table whose frame is a changed scan of it."""
    names = {"t0_row": ROW, "t0_present": PRESENT} | {f"t0_{i}": f"c{i}" for i in range(len(table.columns))}
    return short(table.with_frame(scan.select(*[F.col(old).alias(new) for old, new in names.items()])))


def short(table: Table) -> Table:
    """The table, its rows written once if its plan has been rewritten often."""
    # Not zero rewrites then: the frame isn't what a store holds.
    return table if table.rewrites < REWRITES else replace(table, frame=settled(table.frame), rewrites=1)


def updated(spark: SparkSession, catalog: Catalog, statement: ast.Update) -> Table:
    """The table with exactly one row changed: read, and logged as it is then."""
    table = catalog.table(statement.table)
    table.writable()
    grown = replace(table, columns=table.checked(statement.changes))
    found = table.scan(spark, "t0", True).where(matching(catalog, table, statement.where)).limit(2).collect()
    if len(found) != 1:
        code, what = ("E_DUPLICATE", "more than one row matches") if found else ("E_NOT_FOUND", "no row matches")
        raise EngineError(code, f"hindura changes exactly one row of '{table.name}', but {what}")
    row = {name: plain(found[0][f"t0_{table.names.index(name)}"]) for name in found[0]["t0_present"]}
    return short(grown.logged(spark, [(found[0]["t0_row"], row | statement.changes)]))


def deleted(spark: SparkSession, catalog: Catalog, statement: ast.Delete) -> tuple[Table, int]:
    """The table without the rows that match, and how many there were; few of them are logged, many need a new frame."""
    table = catalog.table(statement.table)
    table.writable()
    match, scan = matching(catalog, table, statement.where), table.scan(spark, "t0", True)
    few = scan.where(match).select("t0_row").limit(LOGGED + 1).collect()
    if not few:
        raise EngineError("E_NOT_FOUND", f"no row of '{table.name}' matches")
    if len(few) <= LOGGED:
        return short(table.logged(spark, [(row[0], None) for row in few])), len(few)
    return rewritten(table, scan.where(~match)), scan.where(match).count()
