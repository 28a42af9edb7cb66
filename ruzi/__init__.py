"""A Spark-native analytics engine for a small keyword SQL dialect."""

from ruzi.database import Database, Outcome, Transaction
from ruzi.errors import EngineError, is_engine_error
from ruzi.model import Model, model
from ruzi.plans.lexer import tokenize
from ruzi.plans.parser import parse
from ruzi.printing import sql_literal, sql_name, table_text

__all__ = [
    "Database", "EngineError", "Model", "Outcome", "Transaction", "is_engine_error", "model", "parse", "sql_literal",
    "sql_name", "table_text", "tokenize",
]
