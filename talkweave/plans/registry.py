"""All queries over the fixture tables with their SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import annotations, examples, intervals, numeric, sessions, times

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for module in (intervals, times, examples, numeric, annotations, sessions):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
