"""Registered queries and their SQL, gathered from the modules of tempora.plans."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tempora import plans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for _found in pkgutil.iter_modules(plans.__path__):
    _module = importlib.import_module(f"tempora.plans.{_found.name}")
    QUERIES.update(getattr(_module, "QUERIES", {}))
    ORACLE_SQL.update(getattr(_module, "ORACLE_SQL", {}))
