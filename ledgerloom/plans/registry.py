"""Every query of the order engine by name, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..streaming.queries import Q as STREAMS
from .queries_mixed import Q as MIXED
from .queries_orders import Q as ORDERS
from .queries_rules import Q as RULES

ALL = ORDERS | RULES | MIXED | STREAMS


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in ALL.items() if sql}
