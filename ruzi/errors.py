"""The one error that users of the engine see."""

from __future__ import annotations

#: The codes that callers tell failures apart by.
CODES = (
    "E_SYNTAX", "E_COLLECTION_MISSING", "E_COLLECTION_EXISTS", "E_INDEX_EXISTS", "E_INDEX_MISSING", "E_MISSING_PARAM",
    "E_NOT_FOUND", "E_DUPLICATE", "E_OPERATOR", "E_TYPE", "E_IO", "E_TRANSACTION",
)


class EngineError(Exception):
    """``code`` is one of CODES; ``incomplete`` says that the text stopped inside a statement."""

    def __init__(self, code: str, message: str, incomplete: bool = False):
        if code not in CODES:
            raise ValueError(code)
        super().__init__(message)
        self.code, self.message, self.incomplete = code, message, incomplete

    def __str__(self) -> str:
        return f"{self.code}: {self.message}"


def is_engine_error(value: object, code: str | None = None) -> bool:
    return isinstance(value, EngineError) and code in (None, value.code)
