"""Statements as frozen records."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class ColumnRef:
    name: str
    qualifier: str | None = None

    def __str__(self) -> str:
        return f"{self.qualifier}.{self.name}" if self.qualifier else self.name


@dataclass(frozen=True)
class Aggregate:
    """``function`` is count, sum, min or max; no column means all rows."""

    function: str
    column: ColumnRef | None = None


@dataclass(frozen=True)
class Predicate:
    """``op`` is loose, strict, lt, lte, gt or gte; the right side is a column or a literal."""

    op: str
    left: ColumnRef
    right: ColumnRef | None = None
    value: Any = None


@dataclass(frozen=True)
class OrderKey:
    item: ColumnRef | Aggregate
    descending: bool = False


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None = None

    @property
    def label(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: str


@dataclass(frozen=True)
class Select:
    """No columns means all; no group means none was written."""

    columns: tuple[ColumnRef | Aggregate, ...] | None
    tables: tuple[TableRef, ...]
    where: tuple[Predicate, ...] = ()
    group: tuple[ColumnRef, ...] | None = None
    order: tuple[OrderKey, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...] = ()


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str


@dataclass(frozen=True)
class DropTable:
    name: str


@dataclass(frozen=True)
class DropIndex:
    name: str


@dataclass(frozen=True)
class DropAll:
    pass


@dataclass(frozen=True)
class Insert:
    table: str
    row: dict[str, Any] = field(hash=False)


@dataclass(frozen=True)
class Update:
    table: str
    changes: dict[str, Any] = field(hash=False)
    where: tuple[Predicate, ...] = ()


@dataclass(frozen=True)
class Delete:
    table: str
    where: tuple[Predicate, ...] = ()


Statement = Select | CreateTable | CreateIndex | DropTable | DropIndex | DropAll | Insert | Update | Delete
