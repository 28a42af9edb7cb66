"""Names to columns: inputs, references, predicates and output names, with every refusal that needs no data."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruzi.catalog import Catalog, Table
from ruzi.errors import EngineError
from ruzi.functions import values as V
from ruzi.plans import ast


@dataclass(frozen=True)
class Input:
    """One table of a statement; its frame's columns begin with ``prefix``."""

    table: Table
    label: str
    prefix: str

    def operand(self, name: str) -> V.Operand:
        place = self.table.names.index(name)
        present = None
        if self.table.owned:
            present = F.array_contains(F.col(f"{self.prefix}_present"), name)
        whole = not self.table.owned and isinstance(self.table.frame.schema.fields[place].dataType, T.IntegralType)
        return V.Operand(F.col(f"{self.prefix}_{place}"), self.table.columns[place].kind, present, whole)


@dataclass(frozen=True)
class Bound:
    """A predicate as a condition, the inputs it needs, and an equality to hash a join on, if it has one."""

    condition: Column
    inputs: frozenset[str]
    hashed: Column | None = None
    equal: bool = False


@dataclass(frozen=True)
class Output:
    """A result column: where it comes from and what it is called."""

    name: str
    input: Input | None
    column: str | None
    value: Column


def unknown(name: str, names: list[str]) -> EngineError:
    return EngineError("E_TYPE", f"there is no column '{name}'; the columns are: {', '.join(names) or 'none yet'}")


class Binder:
    """The names of one statement's inputs."""

    def __init__(self, catalog: Catalog, tables: tuple[ast.TableRef, ...]):
        self.inputs = [Input(catalog.table(ref.name), ref.label, f"t{i}") for i, ref in enumerate(tables)]
        twice = [label for label, times in Counter(i.label for i in self.inputs).items() if times > 1]
        if twice:
            raise EngineError("E_TYPE", f"'{twice[0]}' names two tables of this statement; give one an alias")

    def find(self, ref: ast.ColumnRef) -> Input:
        """The input that a reference means."""
        if ref.qualifier is not None:
            owner = next((i for i in self.inputs if i.label == ref.qualifier), None)
            if owner is None:
                raise EngineError("E_TYPE", f"no table here is called '{ref.qualifier}'")
            if ref.name not in owner.table.names:
                raise unknown(str(ref), owner.table.names)
            return owner
        owners = [i for i in self.inputs if ref.name in i.table.names]
        if len(owners) > 1:
            raise EngineError("E_TYPE", f"column '{ref.name}' is ambiguous")
        if not owners:
            raise unknown(ref.name, list(dict.fromkeys(name for i in self.inputs for name in i.table.names)))
        return owners[0]

    def operand(self, ref: ast.ColumnRef) -> V.Operand:
        return self.find(ref).operand(ref.name)

    def predicate(self, predicate: ast.Predicate) -> Bound:
        """A comparison of a SELECT."""
        owner = self.find(predicate.left)
        left = owner.operand(predicate.left.name)
        if predicate.right is None:
            if predicate.op == "loose":
                return Bound(V.equals_literal(left, predicate.value), frozenset([owner.prefix]))
            return Bound(V.compare_literal(predicate.op, left, predicate.value), frozenset([owner.prefix]))
        other = self.find(predicate.right)
        right = other.operand(predicate.right.name)
        inputs = frozenset([owner.prefix, other.prefix])
        if predicate.op == "loose":
            condition, hashed = V.loosely_equal(left, right), None
            if left.kind != right.kind or left.kind == "any":
                hashed = V.loose_bucket(left) == V.loose_bucket(right)
            return Bound(condition, inputs, hashed, True)
        if predicate.op == "strict":
            return Bound(V.strictly_equal(left, right, owner is other), inputs, None, True)
        return Bound(V.compare_columns(predicate.op, left, right), inputs)

    def lenient(self, predicate: ast.Predicate) -> Column:
        """A comparison of an update, a deletion or an object filter: qualifiers don't matter, an unknown column matches nothing."""
        owner = self.inputs[0]
        names = owner.table.names
        if predicate.left.name not in names or predicate.right is not None and predicate.right.name not in names:
            return F.lit(False)
        left = owner.operand(predicate.left.name)
        if predicate.right is None:
            if predicate.op == "loose":
                return V.equals_literal(left, predicate.value)
            return V.compare_literal(predicate.op, left, predicate.value)
        right = owner.operand(predicate.right.name)
        if predicate.op == "loose":
            nulls = left.column.isNull() & right.column.isNull()
            return V.loosely_equal(left, right) | (nulls & left.present if left.present is not None else nulls)
        if predicate.op == "strict":
            return V.strictly_equal(left, right, True)
        return V.compare_columns(predicate.op, left, right)

    def star(self) -> list[Output]:
        """All columns; names that two tables share get their table's label before them."""
        merged = [(name, self.inputs[0], name) for name in self.inputs[0].table.names]
        first = self.inputs[0].label
        for owner in self.inputs[1:]:
            left = {name for name, _, _ in merged}
            right = set(owner.table.names)
            merged = [(f"{first}.{name}" if name in right else name, i, column) for name, i, column in merged]
            merged += [(f"{owner.label}.{name}" if name in left else name, owner, name) for name in owner.table.names]
        latest = {name: (i, column) for name, i, column in merged}
        return [Output(name, i, column, i.operand(column).column) for name, (i, column) in latest.items()]

    def listed(self, columns: tuple[ast.ColumnRef, ...]) -> list[Output]:
        """Named columns; a name that is listed more than once keeps its qualifier, and equal keys are one column."""
        times = Counter(ref.name for ref in columns)
        found = {}
        for ref in columns:
            key = str(ref) if ref.qualifier and times[ref.name] > 1 else ref.name
            found[key] = Output(key, None, None, self.operand(ref).column)
        return list(found.values())


def impossible(predicates: tuple[ast.Predicate, ...]) -> bool:
    """Whether number comparisons of one column exclude each other; Catalyst finds this for equalities only."""
    bounds: dict[str, list] = {}
    for p in predicates:
        if p.right is not None or not isinstance(p.value, float) or isinstance(p.value, bool):
            continue
        low = bounds.setdefault(str(p.left), [(float("-inf"), False), (float("inf"), False)])
        if p.op in ("gt", "gte", "loose", "strict"):
            low[0] = max(low[0], (p.value, p.op == "gt"))
        if p.op in ("lt", "lte", "loose", "strict"):
            low[1] = min(low[1], (p.value, p.op != "lt"))
    for (least, open_low), (most, closed_high) in bounds.values():
        if least > most or least == most and (open_low or not closed_high):
            return not (least == float("-inf") or most == float("inf"))
    return False
