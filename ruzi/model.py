"""A model describes one table and binds to a database or a transaction."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from ruzi.catalog import check_name, fits
from ruzi.database import Row, Session
from ruzi.errors import EngineError
from ruzi.plans.parser import column_kind


@dataclass(frozen=True)
class Model:
    collection: str
    fields: Mapping[str, str]

    def on(self, session: Session) -> Repository:
        return Repository(self, session)


def model(collection: str, fields: Mapping[str, str]) -> Model:
    """Field types are number, string, boolean and any, or umubare, ijambo, ukuri and ikintu."""
    check_name(collection, "collection")
    if not isinstance(fields, Mapping):
        raise EngineError("E_TYPE", "a model's fields are an object of types")
    kinds = {}
    for name, kind in fields.items():
        check_name(name, "field")
        if not isinstance(kind, str):
            raise EngineError("E_TYPE", f"field '{name}' needs a type's name")
        kinds[name] = column_kind(kind)
    return Model(collection, kinds)


class Repository:
    """The statements of one model on one session."""

    def __init__(self, of: Model, session: Session):
        self.model, self.session = of, session

    def _checked(self, data: Any) -> Row:
        if not isinstance(data, Mapping):
            raise EngineError("E_TYPE", "data is an object")
        for name, value in data.items():
            self._known(name)
            if not fits(self.model.fields[name], value):
                raise EngineError("E_TYPE", f"field '{name}' is a {self.model.fields[name]}, not {value!r}")
        return dict(data)

    def _known(self, name: str) -> None:
        if name not in self.model.fields:
            raise EngineError("E_TYPE", f"field '{name}' isn't on the model of '{self.model.collection}'")

    def _filter(self, where: Any) -> Mapping[str, Any]:
        if not isinstance(where, Mapping):
            raise EngineError("E_TYPE", "where is an object")
        for name in where:
            self._known(name)
        return where

    def kora(self) -> None:
        self.session.create_collection(self.model.collection, self.model.fields.items())

    def shira(self, data: Mapping[str, Any]) -> Row:
        return self.session.add(self.model.collection, self._checked(data))

    def hitamo(self, where: Mapping[str, Any] | None = None, limit: int | None = None) -> list[Row]:
        return self.session.get(self.model.collection, None if where is None else self._filter(where), limit)

    def hindura(self, where: Mapping[str, Any], data: Mapping[str, Any]) -> None:
        self.session.set(self.model.collection, self._filter(where), self._checked(data))

    def siba(self, where: Mapping[str, Any]) -> int:
        return self.session.delete(self.model.collection, self._filter(where))
