"""Registered queries over the reference's operators, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["confidence_tiers"](spark, sf_dir)


# The modules add their queries as they are imported.
from spliceflow.plans import calibration, commands, conformal, events, evaluation, evidence, extras, gating, graphs, intervals, parsing, reads, scores, sequences, stochastic, structures, transcripts  # noqa: E402, F401
