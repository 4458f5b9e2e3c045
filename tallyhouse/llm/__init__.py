"""Operators of a training-data pipeline: filtering, deduplication, encoding, formats.

Nothing else in the library imports this package. Each module has one operator
with an interface of its own; :mod:`tallyhouse.llm.queries` applies them to the
test tables.
"""
