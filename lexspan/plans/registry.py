"""The library's registered queries and the SQL that says the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import compared, judged, marked, more, placed, versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**judged.QUERIES, **compared.QUERIES, **marked.QUERIES, **placed.QUERIES, **versions.QUERIES, **more.QUERIES}
ORACLES: dict[str, str] = {**judged.ORACLES, **compared.ORACLES, **marked.ORACLES, **placed.ORACLES, **versions.ORACLES, **more.ORACLES}
