"""All queries of the library and the SQL that they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analytic, clinical, encodings, genomic, graphs, monitoring, policies, private, records, statistical, tabular


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return tabular.QUERIES | analytic.QUERIES | records.QUERIES | genomic.QUERIES | statistical.QUERIES | encodings.QUERIES | private.QUERIES | clinical.QUERIES | graphs.QUERIES | monitoring.QUERIES | policies.QUERIES


def oracle_sql() -> dict[str, str]:
    return tabular.SQL | analytic.SQL | records.SQL | genomic.SQL | statistical.SQL | encodings.SQL | private.SQL | clinical.SQL | graphs.SQL | monitoring.SQL | policies.SQL
