"""Tables and frames that several plans begin with, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from suitelens.functions import scoring

POPULATION = 10


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of each (class, generation, suite), as conditional sums over facts."""
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    facts = lines.join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    branch = (F.col("l_tax") >= 0.08) & (F.col("l_discount") >= 0.09)
    test = [(F.col("l_suppkey") % 5).alias("class_id"), (F.year("o_orderdate") - 1994).alias("gen"), F.col("l_suppkey").alias("test")]
    keys = ["class_id", "gen", "test"]
    # Facts to one row a part, and to one row an order, before anything is counted: no row is copied for a distinct count.
    parts = facts.groupBy(*test, "l_partkey").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("l_linestatus") == "F").alias("lines_covered"),
        F.count_if(branch).alias("branches"),
        F.count_if(branch & (F.col("l_returnflag") == "A")).alias("branches_covered"),
        F.max((F.col("l_discount") >= 0.02).cast("int")).alias("covered"),
        F.count_if(F.col("l_tax") >= 0.08).alias("failures"),
        F.sum("l_quantity").alias("quantity"),
    ).groupBy(*keys).agg(
        F.sum("lines").alias("lines_total"),
        F.sum("lines_covered").alias("lines_covered"),
        F.sum("branches").alias("branches_total"),
        F.sum("branches_covered").alias("branches_covered"),
        F.count("l_partkey").alias("methods_total"),
        F.count_if(F.col("covered") == 1).alias("methods_covered"),
        F.sum("failures").alias("failures"),
        F.round(F.sum("quantity") / 1000.0, 6).alias("time_seconds"),
    )
    tests = facts.groupBy(*test, "l_orderkey").agg(F.lit(1).alias("_")).groupBy(*keys).agg(F.count("l_orderkey").alias("total_tests"))
    columns = [*keys, "lines_total", "lines_covered", "branches_total", "branches_covered", "methods_total", "methods_covered", "total_tests", "failures", "time_seconds"]
    return parts.join(tests, keys).select(*columns)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    c = counters(spark, sf)
    for part in ("line", "branch", "method"):
        plural = {"line": "lines", "branch": "branches", "method": "methods"}[part]
        c = c.withColumn(f"{part}_coverage", scoring.percent(F.col(f"{plural}_covered"), F.col(f"{plural}_total")))
    return c.withColumn(
        "fitness",
        scoring.fitness(
            *(scoring.ratio(F.col(f"{x}_covered"), F.col(f"{x}_total")) for x in ("lines", "branches", "methods")),
            scoring.failure_penalty(F.col("failures"), F.col("total_tests"), F.lit(False)), scoring.time_penalty(F.col("time_seconds")),
        ),
    )


COUNTERS_SQL = """
counters AS (
  SELECT l_suppkey % 5 AS class_id, year(o_orderdate) - 1994 AS gen, l_suppkey AS test, count(*) AS lines_total,
    count(*) FILTER (WHERE l_linestatus = 'F') AS lines_covered,
    count(*) FILTER (WHERE l_tax >= 0.08 AND l_discount >= 0.09) AS branches_total,
    count(*) FILTER (WHERE l_tax >= 0.08 AND l_discount >= 0.09 AND l_returnflag = 'A') AS branches_covered,
    count(DISTINCT l_partkey) AS methods_total, count(DISTINCT l_partkey) FILTER (WHERE l_discount >= 0.02) AS methods_covered,
    count(DISTINCT l_orderkey) AS total_tests, count(*) FILTER (WHERE l_tax >= 0.08) AS failures,
    round(sum(l_quantity) / 1000.0, 6) AS time_seconds
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"""
PERCENT_SQL = COUNTERS_SQL + """,
covered AS (
  SELECT *, CASE WHEN lines_total > 0 THEN round(lines_covered / lines_total * 100, 2) ELSE 0.0 END AS line_coverage,
    CASE WHEN branches_total > 0 THEN round(branches_covered / branches_total * 100, 2) ELSE 0.0 END AS branch_coverage,
    CASE WHEN methods_total > 0 THEN round(methods_covered / methods_total * 100, 2) ELSE 0.0 END AS method_coverage
  FROM counters)"""
SCORED_SQL = PERCENT_SQL + """,
weighed AS (SELECT *, 0.5::DOUBLE * coalesce(lines_covered::DOUBLE / nullif(lines_total, 0), 0.0) + 0.4::DOUBLE * coalesce(branches_covered::DOUBLE / nullif(branches_total, 0), 0.0)
    + 0.1::DOUBLE * coalesce(methods_covered::DOUBLE / nullif(methods_total, 0), 0.0) AS base FROM covered),
scored AS (
  SELECT * EXCLUDE (base), greatest(round(base
    + CASE WHEN base >= 0.95 THEN 0.3 WHEN base >= 0.9 THEN 0.2 WHEN base >= 0.8 THEN 0.15 WHEN base >= 0.7 THEN 0.1 WHEN base >= 0.6 THEN 0.05 ELSE 0.0 END::DOUBLE
    - CASE WHEN total_tests > 0 THEN least(0.05::DOUBLE, failures / total_tests * 0.05::DOUBLE) ELSE 0.0 END
    - least(0.02::DOUBLE, time_seconds / 30.0::DOUBLE) + 1e-9::DOUBLE, 4), 0.0) AS fitness
  FROM weighed)"""


def newest_reports(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """One row per run, the newest; ``columns`` may name fields inside metrics. Runs without id stand for themselves."""
    reports = table(spark, sf, "coverage_report")
    picked = F.struct(F.col("report_id"), *(F.col(c).alias(c.split(".")[-1]) for c in columns if c != "report_id"))
    return (
        reports.groupBy("run_id", F.when(F.col("run_id").isNull(), F.col("report_id")).alias("_own"))
        .agg(F.max_by(picked, F.struct("ingested_at", "report_id")).alias("_row"))
        .select("_row.*")
    )


def survivors(spark: SparkSession, sf: str, *columns: str, n: int = POPULATION) -> DataFrame:
    """The ``n`` fittest reports of each class and generation, with their ``rank``."""
    needed = dict.fromkeys(["target_class", "gen", "fitness", "metrics.line_coverage", "metrics.branch_coverage", *columns])
    fit = newest_reports(spark, sf, *needed).filter(F.col("target_class").isNotNull() & F.col("fitness").isNotNull() & ~F.isnan("fitness"))
    order = [F.col(c).desc_nulls_last() for c in ("fitness", "line_coverage", "branch_coverage")]
    w = Window.partitionBy("target_class", "gen").orderBy(*order, F.col("report_id"))
    return fit.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


NEWEST_SQL = """
newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ingested_at DESC NULLS LAST, report_id DESC) AS recent FROM coverage_report)
  WHERE recent = 1 OR run_id IS NULL)"""
SURVIVORS_SQL = NEWEST_SQL + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY target_class, gen ORDER BY fitness DESC NULLS LAST, metrics.line_coverage DESC NULLS LAST,
    metrics.branch_coverage DESC NULLS LAST, report_id) AS rank
  FROM newest WHERE target_class IS NOT NULL AND fitness IS NOT NULL AND NOT isnan(fitness)),
survivors AS (SELECT * FROM ranked WHERE rank <= 10)"""
