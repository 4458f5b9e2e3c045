"""Inventory analytics over semi-structured configuration records, on Spark."""

from tallyhouse.plans.inventory import BuildReport, BuildSettings, Inventory
from tallyhouse.plans.query import Query
from tallyhouse.schemas import KEY, SPINE, table_name
from tallyhouse.sources.contract import Semantics, Source

__all__ = [
    "BuildReport",
    "BuildSettings",
    "Inventory",
    "KEY",
    "Query",
    "SPINE",
    "Semantics",
    "Source",
    "table_name",
]
