"""Statistics of model calls, test files, classes and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from suitelens.plans.base import table

SQL = {}


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls that belong to a file; a call delivered again under a new id counts once."""
    c = table(spark, sf, "llm_call_stats").filter("test_file_id IS NOT NULL")
    same = ["test_file_id", "start_time", "model_name", "attempt_number", "call_type"]
    return c.groupBy(*same).agg(F.min_by(F.struct("call_id", "duration", "success", "prompt_tokens", "response_tokens", "total_tokens", "estimated_cost"), "call_id").alias("_c")).select(*same, "_c.*")


_CALLS_SQL = """
calls AS (
  SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY test_file_id, start_time, model_name, attempt_number, call_type ORDER BY call_id) AS r
    FROM llm_call_stats WHERE test_file_id IS NOT NULL) WHERE r = 1)"""


def _totals():
    return [
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("call_type") == "generation").alias("generation_calls"), F.count_if(F.col("call_type") == "repair").alias("repair_calls"),
        F.count_if("success").alias("successes"), F.sum(F.col("total_tokens").cast("long")).alias("tokens"), F.round(F.sum("duration"), 3).alias("seconds"),
        F.round(F.sum(F.when(F.col("call_type") == "repair", F.col("duration")).otherwise(0.0)), 3).alias("repair_seconds"),
    ]


_TOTALS_SQL = """count(*) AS calls, count(*) FILTER (WHERE call_type = 'generation') AS generation_calls, count(*) FILTER (WHERE call_type = 'repair') AS repair_calls,
  count(*) FILTER (WHERE success) AS successes, sum(total_tokens) AS tokens, round(sum(duration), 3) AS seconds,
  round(sum(CASE WHEN call_type = 'repair' THEN duration ELSE 0.0 END), 3) AS repair_seconds"""


def suite_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _calls(spark, sf).groupBy("test_file_id").agg(*_totals())


SQL["suite_stats"] = f"WITH {_CALLS_SQL} SELECT test_file_id, {_TOTALS_SQL} FROM calls GROUP BY 1"


def _with_class(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "test_file_stats").select("test_file_id", "project", "class_name")
    return _calls(spark, sf).join(files, "test_file_id")


_CLASS_SQL = _CALLS_SQL + ", classed AS (SELECT c.*, f.project, f.class_name FROM calls c JOIN test_file_stats f USING (test_file_id))"


def class_stats(spark: SparkSession, sf: str) -> DataFrame:
    by = _with_class(spark, sf).groupBy("project", "class_name").agg(F.countDistinct("test_file_id").alias("files"), *_totals())
    return by.withColumn("success_percent", F.round(F.try_divide(F.col("successes") * 100, F.col("calls")), 2)).withColumn("tokens_per_file", F.round(F.try_divide(F.col("tokens"), F.col("files")), 2))


SQL["class_stats"] = f"""WITH {_CLASS_SQL}, g AS (SELECT project, class_name, count(DISTINCT test_file_id) AS files, {_TOTALS_SQL} FROM classed GROUP BY 1, 2)
SELECT *, round(successes * 100 / calls, 2) AS success_percent, round(tokens / files, 2) AS tokens_per_file FROM g"""


def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    """One row over all files: totals, and which shares of the time went where."""
    f = table(spark, sf, "test_file_stats").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("final_success").alias("successes"), F.sum("total_duration").alias("t"), F.sum("llm_response_time").alias("l"),
        F.sum("maven_compile_time").alias("m"), F.sum(F.col("total_tokens").cast("long")).alias("tokens"),
    )
    share = lambda c: F.round(F.try_divide(F.col(c) * 100, F.col("t")), 3)
    return f.select(
        "files", "successes", "tokens", F.round("t", 2).alias("seconds"), share("l").alias("llm_percent"), share("m").alias("compile_percent"),
        F.round(100 - F.try_divide((F.col("l") + F.col("m")) * 100, F.col("t")), 3).alias("other_percent"),
    )


SQL["session_summary"] = """WITH s AS (SELECT count(*) AS files, count(*) FILTER (WHERE final_success) AS successes, sum(total_duration) AS t, sum(llm_response_time) AS l, sum(maven_compile_time) AS m, sum(total_tokens) AS tokens FROM test_file_stats)
SELECT files, successes, tokens, round(t, 2) AS seconds, round(l * 100 / t, 3) AS llm_percent, round(m * 100 / t, 3) AS compile_percent, round(100 - (l + m) * 100 / t, 3) AS other_percent FROM s"""


def stats_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """File, class, project and all in one pass."""
    c = _with_class(spark, sf)
    return c.rollup("project", "class_name", "test_file_id").agg(F.grouping_id().alias("level"), *_totals())


SQL["stats_rollup"] = f"WITH {_CLASS_SQL} SELECT project, class_name, test_file_id, grouping(project, class_name, test_file_id) AS level, {_TOTALS_SQL} FROM classed GROUP BY ROLLUP (project, class_name, test_file_id)"


def call_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """The position of each call among those of its file, and the pause since the one before."""
    w = Window.partitionBy("test_file_id").orderBy(F.col("start_time").asc_nulls_first(), "call_id")
    return _calls(spark, sf).select("test_file_id", "call_id", F.row_number().over(w).alias("position"), F.round(F.col("start_time") - F.lag("start_time").over(w), 3).alias("pause"))


SQL["call_sequence"] = f"""WITH {_CALLS_SQL} SELECT test_file_id, call_id, row_number() OVER w AS position, round(start_time - lag(start_time) OVER w, 3) AS pause
FROM calls WINDOW w AS (PARTITION BY test_file_id ORDER BY start_time ASC NULLS FIRST, call_id)"""


def imputed_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Rows for calls that a file counts but that were not recorded, with the file's mean duration, else 30 seconds."""
    files = table(spark, sf, "test_file_stats").select("test_file_id", "total_llm_calls")
    have = _calls(spark, sf).groupBy("test_file_id").agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("mean"))
    lacking = files.join(have, "test_file_id", "left").withColumn("lack", F.col("total_llm_calls") - F.coalesce("n", F.lit(0)))
    return lacking.filter("lack > 0").select(
        "test_file_id", F.explode(F.sequence(F.lit(1), F.col("lack").cast("int"))).alias("number"), F.round(F.coalesce("mean", F.lit(30.0)), 6).alias("duration"), F.lit(500).alias("prompt_tokens"), F.lit(300).alias("response_tokens")
    )


SQL["imputed_calls"] = f"""WITH {_CALLS_SQL}, have AS (SELECT test_file_id, count(*) AS n, avg(duration) AS mean FROM calls GROUP BY 1)
SELECT f.test_file_id, unnest(range(1, total_llm_calls - coalesce(n, 0) + 1)) AS number, round(coalesce(mean, 30.0), 6) AS duration, 500 AS prompt_tokens, 300 AS response_tokens
FROM test_file_stats f LEFT JOIN have h USING (test_file_id) WHERE total_llm_calls > coalesce(n, 0)"""


def call_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Calls and tokens per day and model, by the time a call began."""
    day = F.to_date(F.timestamp_seconds("start_time"))
    c = _calls(spark, sf).filter("start_time IS NOT NULL")
    return c.groupBy(F.date_format(day, "yyyy-MM-dd").alias("day"), "model_name").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("total_tokens").cast("long")).alias("tokens"))


SQL["call_windows"] = f"WITH {_CALLS_SQL} SELECT strftime(make_timestamp(floor(start_time * 1000000)::BIGINT), '%Y-%m-%d') AS day, model_name, count(*) AS calls, sum(total_tokens) AS tokens FROM calls WHERE start_time IS NOT NULL GROUP BY 1, 2"


def props_json(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of JSON text, absent ones as 0, per type of event."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


SQL["props_json"] = "SELECT event_type, count(*) AS n, sum(coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0)) AS k_sum, max(coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0)) AS k_max FROM events GROUP BY 1"


def repair_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """For each file the first repair attempt that succeeded, and how many were made."""
    r = _calls(spark, sf).filter("call_type = 'repair'")
    return r.groupBy("test_file_id").agg(F.count(F.lit(1)).alias("attempts"), F.min(F.when(F.col("success"), F.struct("start_time", "call_id"))).getField("call_id").alias("repaired_by"))


SQL["repair_outcomes"] = f"WITH {_CALLS_SQL} SELECT test_file_id, count(*) AS attempts, arg_min(call_id, (start_time, call_id)) FILTER (WHERE success) AS repaired_by FROM calls WHERE call_type = 'repair' GROUP BY 1"

QUERIES = {name: globals()[name] for name in SQL}
