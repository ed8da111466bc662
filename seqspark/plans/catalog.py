"""All registered queries and their SQL, and the flagship query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.functions import properties
from seqspark.operators import acquire, filters, select
from seqspark.plans import core, files, logs, models, more, structures
from seqspark.plans.fixtures import fixture, render

SPECS = {**core.SPECS, **structures.SPECS, **logs.SPECS, **models.SPECS, **more.SPECS, **files.SPECS}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in SPECS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: render(sql, "duckdb") for name, (_, sql) in SPECS.items() if sql}


def search_step(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    """One step of a search: filter tiles, add properties, drop what is evaluated, predict, acquire and rank."""
    tiles = filters.quality_filter(fixture(spark, sf_dir, "peptides")).groupBy("sequence").agg(F.min("protein_id").alias("seq_id"))
    known = fixture(spark, sf_dir, "scores").where("in_binding_site")
    rows = filters.not_evaluated(tiles, known, "seq_id").join(fixture(spark, sf_dir, "predictions"), "seq_id")
    rows = rows.withColumn("gravy", properties.gravy(F.col("sequence"))).withColumn("objective", acquire.expected_improvement(20.0) - 0.1 * F.abs("gravy"))
    return select.leaderboard(rows, n)
