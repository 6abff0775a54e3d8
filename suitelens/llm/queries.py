"""The queries of this subpackage over the given tables, and their SQL where SQL can say the same at full size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suitelens.llm.mixing import ALL, draw, shares, source_name
from suitelens.llm.packing import contexts
from suitelens.llm.secrets.find import find_credentials
from suitelens.llm.setjoin import similar_pairs
from suitelens.llm.syntax.files import LANGUAGES, syntax_errors
from suitelens.llm.topn import newest_of, top_n_per_group
from suitelens.llm.toxic.nearest import harm_scores

Query = Callable[[SparkSession, str], DataFrame]


def _best_reports(spark: SparkSession, sf: str, n: int = 10) -> DataFrame:
    reports = spark.read.parquet(f"{sf}/coverage_report.parquet")
    newest = newest_of(
        reports,
        "run_id",
        ["ingested_at", "report_id"],
        [
            F.col("target_class"),
            F.col("report_id"),
            F.col("fitness"),
            F.col("metrics.line_coverage").alias("line_coverage"),
            F.col("metrics.branch_coverage").alias("branch_coverage"),
        ],
    ).filter(F.col("target_class").isNotNull() & F.col("fitness").isNotNull() & ~F.isnan("fitness"))
    order = [
        F.col("fitness").desc_nulls_last(),
        F.col("line_coverage").desc_nulls_last(),
        F.col("branch_coverage").desc_nulls_last(),
        F.col("report_id").asc(),
    ]
    return top_n_per_group(newest, ["target_class"], order, n)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _best_reports(spark, sf).select("target_class", "report_id")


def p1_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return _best_reports(spark, sf).select("target_class", "position", "report_id", F.round("fitness", 4).alias("fitness"))


_BEST_SQL = """
WITH newest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ingested_at DESC NULLS LAST, report_id DESC) AS recent
    FROM coverage_report) WHERE recent = 1 OR run_id IS NULL),
ranked AS (
  SELECT target_class, report_id, fitness, row_number() OVER (
    PARTITION BY target_class ORDER BY fitness DESC NULLS LAST, metrics.line_coverage DESC NULLS LAST,
    metrics.branch_coverage DESC NULLS LAST, report_id) AS position
  FROM newest WHERE target_class IS NOT NULL AND fitness IS NOT NULL AND NOT isnan(fitness))
"""


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    files = spark.read.parquet(f"{sf}/source_file.parquet")
    clients = spark.read.parquet(f"{sf}/llm_client.parquet")
    columns = [F.col("record_id"), F.col("line_no")]
    code = find_credentials(files, "file_id", "code").withColumnRenamed("file_id", "record_id")
    keys = find_credentials(clients, "client_id", "key", field="key").withColumnRenamed("client_id", "record_id")
    return code.select(F.lit("source_file").alias("place"), *columns).unionAll(keys.select(F.lit("llm_client").alias("place"), *columns))


def p2_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every text with only its credentials replaced, and how many there were."""
    files = spark.read.parquet(f"{sf}/source_file.parquet")
    clients = spark.read.parquet(f"{sf}/llm_client.parquet")
    code = find_credentials(files, "file_id", "code", redact=True)
    keys = find_credentials(clients, "client_id", "key", field="key", redact=True)
    return code.select(F.lit("source_file").alias("place"), F.col("file_id").alias("record_id"), F.col("code").alias("text"), "credentials").unionAll(
        keys.select(F.lit("llm_client").alias("place"), F.col("client_id").alias("record_id"), F.col("key").alias("text"), "credentials")
    )


def _broken(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    files = spark.read.parquet(f"{sf}/source_file.parquet")
    return syntax_errors(files, "file_id", "path", "code", list(keep))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _broken(spark, sf).select("file_id")


def p3_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The first wrong token of each broken file, and what the answers its test was written from hint at.

    ``lost`` says that a call of a registered test file of this path ended with fewer characters than the file has.
    """
    broken = _broken(spark, sf, "project", "path", "size")
    calls = spark.read.parquet(f"{sf}/llm_call_stats.parquet").filter(F.col("test_file_id").isNotNull())
    longest = calls.groupBy("test_file_id").agg(F.max("response_length").alias("longest_response"))
    tests = spark.read.parquet(f"{sf}/test_file_stats.parquet").select("test_file_id", "project", F.col("test_file_path").alias("path"))
    answered = tests.join(longest, "test_file_id").groupBy("project", "path").agg(F.max("longest_response").alias("longest_response"))
    return broken.join(answered, ["project", "path"], "left").withColumn("lost", F.col("longest_response") < F.col("size"))


def p3_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Per project and language how many files there are and what share of them does not parse."""
    ending = F.lower(F.regexp_extract(F.col("path"), r"\.([A-Za-z]+)\s*$", 1))
    named = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    files = spark.read.parquet(f"{sf}/source_file.parquet").filter(F.col("code").isNotNull() & ending.isin(*LANGUAGES))
    every = files.select("project", named[ending].alias("language")).groupBy("project", "language").agg(F.count(F.lit(1)).alias("files"))
    broken = _broken(spark, sf, "project").groupBy("project", "language").agg(F.count(F.lit(1)).alias("broken"))
    both = every.alias("e").join(broken.alias("b"), F.expr("e.project <=> b.project AND e.language = b.language"), "left")
    n = F.coalesce(F.col("broken"), F.lit(0))
    return both.select("e.project", "e.language", "files", n.alias("broken"), F.round(n / F.col("files"), 4).alias("rate"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    reports = spark.read.parquet(f"{sf}/coverage_report.parquet")
    pairs = similar_pairs(reports, "report_id", ["covered_methods", "uncovered_methods"], 0.7, 5)
    return pairs.select("field_name", F.col("id_a").alias("report_id_a"), F.col("id_b").alias("report_id_b"))


# The SQL meets all sets that share a value; DuckDB needs minutes for it beyond sf0.01.
_PAIRS_SQL = """
WITH s AS (
  SELECT 'covered_methods' AS field_name, report_id AS id, list_distinct(covered_methods) AS v FROM coverage_report
  UNION ALL SELECT 'uncovered_methods', report_id, list_distinct(uncovered_methods) FROM coverage_report),
big AS (SELECT * FROM s WHERE len(v) >= 5),
items AS (SELECT field_name, id, len(v) AS n, unnest(v) AS item FROM big),
met AS (
  SELECT a.field_name, a.id AS x, b.id AS y, a.n AS na, b.n AS nb, count(*) AS shared
  FROM items a JOIN items b ON a.field_name = b.field_name AND a.item = b.item AND a.id < b.id
    AND 10 * a.n >= 7 * b.n AND 10 * b.n >= 7 * a.n
  GROUP BY 1, 2, 3, 4, 5)
SELECT field_name, x AS report_id_a, y AS report_id_b FROM met WHERE 10 * shared >= 7 * (na + nb - shared)
"""

def p6_contexts(spark: SparkSession, sf: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    specs = spark.read.parquet(f"{sf}/container_spec.parquet")
    return contexts(documents, specs, "doc_id", "text", "spec_id", "capacity_tokens")


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Per context what lies in it; the room left over is what the packing is to keep small."""
    by = ["spec_id", "context_id", "capacity"]
    filled = p6_contexts(spark, sf).groupBy(*by).agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
    return filled.withColumn("fill", F.round(F.col("tokens") / F.col("capacity"), 4))


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    return documents, spark.read.parquet(f"{sf}/mix_target.parquet")


def p7_draw(spark: SparkSession, sf: str) -> DataFrame:
    return draw(*_mix(spark, sf))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return shares(*_mix(spark, sf))


def p7_tempered(spark: SparkSession, sf: str) -> DataFrame:
    """The shares of a draw of as many tokens as the listed sources have: the limits bend the targets, as little as can be."""
    return shares(*_mix(spark, sf), ALL)


HARMFUL_FROM = 0.5


def _harm(spark: SparkSession, sf: str, evidence: bool) -> DataFrame:
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    return harm_scores(documents, "doc_id", "text", ["source"], evidence)


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _harm(spark, sf, True)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _harm(spark, sf, False).filter(F.col("score") >= HARMFUL_FROM).select("doc_id")


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Per source, in one spelling, how many of its documents are harmful; documents without source are one group."""
    harmful = F.count_if(F.col("score") >= HARMFUL_FROM)
    by = _harm(spark, sf, False).groupBy(source_name(F.col("source")).alias("source"))
    return by.agg(F.count(F.lit(1)).alias("documents"), harmful.alias("harmful"), F.round(harmful / F.count(F.lit(1)), 4).alias("rate"))


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_ranked": p1_ranked, "p5_found": p5_found}
QUERIES |= {"p2_found": p2_found, "p2_redacted": p2_redacted}
QUERIES |= {"p3_found": p3_found, "p3_errors": p3_errors, "p3_rates": p3_rates}
QUERIES |= {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
QUERIES |= {"p6_contexts": p6_contexts, "p6_fill": p6_fill, "p7_draw": p7_draw, "p7_shares": p7_shares, "p7_tempered": p7_tempered}
SQL: dict[str, str] = {
    "p1_found": _BEST_SQL + "SELECT target_class, report_id FROM ranked WHERE position <= 10",
    "p1_ranked": _BEST_SQL + "SELECT target_class, position, report_id, round(fitness, 4) AS fitness FROM ranked WHERE position <= 10",
    "p5_found": _PAIRS_SQL,
}
