"""Which reports name a test file that is not, no longer or not yet registered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from suitelens.operators.orphans import orphan_references


def test_class_name(c: Column) -> Column:
    """Outer blanks and one ending .java or .class go; what follows the last '.' or '/' stays."""
    bare = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\.(java|class)$", "")
    return F.regexp_replace(bare, r"(?s)^.*[./]", "")


def test_file_name(c: Column) -> Column:
    """The last segment of a path, up to its first '.'."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)^.*[/\\]", ""), r"(?s)\..*$", "")


def orphan_reports(spark: SparkSession, sf: str) -> DataFrame:
    reports = spark.read.parquet(f"{sf}/coverage_report.parquet").filter(F.col("test_class").rlike(r"\S"))
    files = spark.read.parquet(f"{sf}/test_file_stats.parquet")
    return orphan_references(
        reports.select("report_id", "project", "test_class", "run_at"),
        files.select("project", "test_file_path", "registered_at", "deleted_at"),
        key=[(F.col("project"), F.col("project")), (test_class_name(F.col("test_class")), test_file_name(F.col("test_file_path")))],
        at=F.col("run_at"),
        valid_from=F.col("registered_at"),
        valid_to=F.col("deleted_at"),
        ref_id="report_id",
        keep=["project"],
    )


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_reports(spark, sf).select("report_id")


def p4_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_reports(spark, sf).select("report_id", "kind")


def p4_months(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans of each kind per project and month, beside all reports that name a test class."""
    month = lambda c: F.date_format(F.date_trunc("month", F.col(c)), "yyyy-MM")
    orphans = orphan_reports(spark, sf)
    counted = orphans.groupBy("project", month("at").alias("month")).agg(
        F.count(F.lit(1)).alias("orphans"),
        *(F.count_if(F.col("kind") == k).alias(k) for k in ("missing", "deleted", "late", "undated")),
    )
    reports = spark.read.parquet(f"{sf}/coverage_report.parquet").filter(F.col("test_class").rlike(r"\S"))
    everything = reports.groupBy("project", month("run_at").alias("month")).agg(F.count(F.lit(1)).alias("reports"))
    same = F.expr("e.project <=> o.project AND e.month <=> o.month")
    return everything.alias("e").join(counted.alias("o"), same, "left").select(
        F.col("e.project"), F.col("e.month"), "reports",
        *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("orphans", "missing", "deleted", "late", "undated")),
    )


_REFERENCES = r"""
WITH refs AS (
  SELECT report_id, project, run_at, regexp_replace(regexp_replace(regexp_replace(test_class, '^\s+|\s+$', '', 'g'),
    '\.(java|class)$', ''), '(?s)^.*[./]', '') AS name
  FROM coverage_report WHERE regexp_matches(test_class, '\S')),
parents AS (
  SELECT project, registered_at, deleted_at,
    regexp_replace(regexp_replace(test_file_path, '(?s)^.*[/\\]', ''), '(?s)\..*$', '') AS name
  FROM test_file_stats),
judged AS (
  SELECT r.report_id, r.project, r.run_at, count(p.name) AS known,
    count(*) FILTER (WHERE p.registered_at <= r.run_at) AS begun,
    count(*) FILTER (WHERE p.registered_at <= r.run_at AND (p.deleted_at IS NULL OR p.deleted_at > r.run_at)) AS valid
  FROM refs r LEFT JOIN parents p ON p.project = r.project AND p.name = r.name GROUP BY 1, 2, 3),
orphans AS (
  SELECT *, CASE WHEN known = 0 THEN 'missing' WHEN run_at IS NULL THEN 'undated' WHEN begun > 0 THEN 'deleted' ELSE 'late' END AS kind
  FROM judged WHERE valid = 0)
"""

QUERIES = {"p4_found": p4_found, "p4_kinds": p4_kinds, "p4_months": p4_months}
SQL = {
    "p4_found": _REFERENCES + "SELECT report_id FROM orphans",
    "p4_kinds": _REFERENCES + "SELECT report_id, kind FROM orphans",
    "p4_months": _REFERENCES
    + """
SELECT r.project, strftime(r.run_at, '%Y-%m') AS month, count(*) AS reports, count(o.report_id) AS orphans,
  count(*) FILTER (WHERE o.kind = 'missing') AS missing, count(*) FILTER (WHERE o.kind = 'deleted') AS deleted, count(*) FILTER (WHERE o.kind = 'late') AS late,
  count(*) FILTER (WHERE o.kind = 'undated') AS undated
FROM refs r LEFT JOIN orphans o ON o.report_id = r.report_id GROUP BY 1, 2
""",
}
