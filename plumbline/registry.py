"""Queries for the reference's operators over the test tables and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import checks, corpus, depths, distances, gates, histories, lookup, reports, search, streams, study, sweeps

FLAGSHIP = "exact_topk"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _module in (search, study, corpus, depths, histories, checks, sweeps, reports, lookup, distances, gates, streams):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
