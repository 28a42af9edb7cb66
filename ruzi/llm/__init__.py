"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the thin queries over them are in :mod:`ruzi.llm.registry`.
"""
