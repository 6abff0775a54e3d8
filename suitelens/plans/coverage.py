"""Counters, percentages, fitness and selection per class and generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from suitelens.functions import scoring
from suitelens.plans.base import COUNTERS_SQL, PERCENT_SQL, POPULATION, SCORED_SQL, counters, scored

# The coverage in percent at which a class is done, and how many generations it has at most.
LIMIT, GENERATIONS = 98.0, 10
KEYS = ["class_id", "gen", "test"]

def _best() -> list:
    return [F.col("fitness").desc(), F.col("line_coverage").desc(), F.col("branch_coverage").desc(), F.col("test")]


_BEST_SQL = "row_number() OVER (PARTITION BY class_id, gen ORDER BY fitness DESC, line_coverage DESC, branch_coverage DESC, test)"
SQL = {}


def coverage_counters(spark: SparkSession, sf: str) -> DataFrame:
    return counters(spark, sf)


SQL["coverage_counters"] = f"WITH {COUNTERS_SQL} SELECT * FROM counters"


def coverage_percent(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select(*KEYS, "line_coverage", "branch_coverage", "method_coverage")


SQL["coverage_percent"] = f"WITH {PERCENT_SQL} SELECT class_id, gen, test, line_coverage, branch_coverage, method_coverage FROM covered"


def fitness_score(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select(*KEYS, "fitness")


SQL["fitness_score"] = f"WITH {SCORED_SQL} SELECT class_id, gen, test, fitness FROM scored"


def _ranked(spark: SparkSession, sf: str, order=None) -> DataFrame:
    w = Window.partitionBy("class_id", "gen").orderBy(*(order or _best()))
    return scored(spark, sf).withColumn("rank", F.row_number().over(w))


def _renamed() -> list:
    return [*KEYS, "rank", "fitness", F.concat(F.lit("C"), F.col("class_id"), F.lit("TestV"), F.col("rank")).alias("new_name")]


def survivor_selection(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf).filter(F.col("rank") <= POPULATION).select(*_renamed())


SQL["survivor_selection"] = f"""WITH {SCORED_SQL}, ranked AS (SELECT *, {_BEST_SQL} AS rank FROM scored)
SELECT class_id, gen, test, rank, fitness, concat('C', class_id, 'TestV', rank) AS new_name FROM ranked WHERE rank <= 10"""


def survivor_selection_single_key(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf, [F.col("fitness").desc(), F.col("test")]).filter(F.col("rank") <= POPULATION).select(*_renamed())


SQL["survivor_selection_single_key"] = SQL["survivor_selection"].replace(", line_coverage DESC, branch_coverage DESC", "")


def best_and_second(spark: SparkSession, sf: str) -> DataFrame:
    """The two fittest suites of each class and generation; nulls where there are fewer than two."""
    two = _ranked(spark, sf).filter("rank <= 2").groupBy("class_id", "gen").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("rank") == 1, F.col("test"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("test"))).alias("b")
    )
    both = F.col("n") == 2
    return two.select("class_id", "gen", F.when(both, F.col("a")).alias("best"), F.when(both, F.col("b")).alias("second"))


SQL["best_and_second"] = f"""WITH {SCORED_SQL}, ranked AS (SELECT *, {_BEST_SQL} AS rank FROM scored)
SELECT class_id, gen, CASE WHEN max(rank) >= 2 THEN max(test) FILTER (WHERE rank = 1) END AS best,
  CASE WHEN max(rank) >= 2 THEN max(test) FILTER (WHERE rank = 2) END AS second FROM ranked GROUP BY 1, 2"""


def eliminated_suites(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf).filter(F.col("rank") > POPULATION).select(*KEYS, "rank")


SQL["eliminated_suites"] = f"WITH {SCORED_SQL}, ranked AS (SELECT *, {_BEST_SQL} AS rank FROM scored) SELECT class_id, gen, test, rank FROM ranked WHERE rank > 10"


def _means(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).groupBy("class_id", "gen").agg(F.round(F.avg("fitness"), 8).alias("mean_fitness"), F.max("fitness").alias("best_fitness"))


_MEANS_SQL = SCORED_SQL + ", means AS (SELECT class_id, gen, round(avg(fitness), 8) AS mean_fitness, max(fitness) AS best_fitness FROM scored GROUP BY 1, 2)"


def generation_mean_fitness(spark: SparkSession, sf: str) -> DataFrame:
    return _means(spark, sf).select("class_id", "gen", "mean_fitness")


SQL["generation_mean_fitness"] = f"WITH {_MEANS_SQL} SELECT class_id, gen, mean_fitness FROM means"


def fitness_history(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of each generation in order, one row per class; a class has few generations."""
    ordered = F.array_sort(F.collect_list(F.struct("gen", F.col("mean_fitness").alias("f"))))
    return _means(spark, sf).groupBy("class_id").agg(F.array_join(F.transform(ordered, lambda x: F.format_number(x["f"], 8)), ";").alias("history"))


SQL["fitness_history"] = f"WITH {_MEANS_SQL} SELECT class_id, string_agg(printf('%.8f', mean_fitness), ';' ORDER BY gen) AS history FROM means GROUP BY 1"


def fitness_improvement(spark: SparkSession, sf: str) -> DataFrame:
    by = _means(spark, sf).groupBy("class_id").agg(
        F.min_by("best_fitness", "gen").alias("first"), F.max_by("best_fitness", "gen").alias("last"), F.max("best_fitness").alias("best")
    )
    return by.withColumn("improvement", F.round(F.try_divide((F.col("last") - F.col("first")) * 100, F.col("first")), 4))


SQL["fitness_improvement"] = f"""WITH {_MEANS_SQL}, ends AS (SELECT class_id, arg_min(best_fitness, gen) AS first, arg_max(best_fitness, gen) AS last, max(best_fitness) AS best FROM means GROUP BY 1)
SELECT *, round((last - first) * 100 / nullif(first, 0), 4) AS improvement FROM ends"""


def termination_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Whether any suite of a class and generation covers branches and methods to ``LIMIT`` or the generations are used up, and whether it is the last one."""
    w = Window.partitionBy("class_id")
    reached = (F.bool_or((F.col("branch_coverage") >= LIMIT) & (F.col("method_coverage") >= LIMIT)) | (F.col("gen") > GENERATIONS)).alias("reached")
    return scored(spark, sf).groupBy("class_id", "gen").agg(reached).withColumn("last", F.col("gen") == F.max("gen").over(w))


SQL["termination_flags"] = f"""WITH {PERCENT_SQL}, flags AS (SELECT class_id, gen, bool_or(branch_coverage >= 98.0 AND method_coverage >= 98.0) OR gen > 10 AS reached FROM covered GROUP BY 1, 2)
SELECT *, gen = max(gen) OVER (PARTITION BY class_id) AS last FROM flags"""


def mutation_rate(spark: SparkSession, sf: str) -> DataFrame:
    """The rate at which a suite is to be mutated, and a draw that is the same on every run."""
    s = scored(spark, sf)
    drawn = F.conv(F.substring(F.md5(F.concat_ws("-", "class_id", "gen", "test")), 1, 6), 16, 10).cast("long") / F.lit(16777216.0)
    rate = scoring.fitness_rate(F.col("gen"), F.col("fitness"))
    return s.select(*KEYS, F.round(rate, 6).alias("rate"), (drawn < rate).alias("mutate"))


SQL["mutation_rate"] = f"""WITH {SCORED_SQL}, rated AS (SELECT *, greatest(0.1, least((0.1::DOUBLE + 0.2::DOUBLE * exp(-0.1::DOUBLE * (gen - 1))) * CASE WHEN fitness >= 0.8 THEN 0.5 WHEN fitness <= 0.3 THEN 1.2 ELSE 1.0 END::DOUBLE, 0.36::DOUBLE)) AS r FROM scored)
SELECT class_id, gen, test, round(r, 6) AS rate, ('0x' || substr(md5(concat_ws('-', class_id, gen, test)), 1, 6))::BIGINT / 16777216.0 < r AS mutate FROM rated"""


def stats_of_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Failures as a fraction of tests, successes in percent of tests; 0 without tests."""
    c = counters(spark, sf)
    failed = F.least(F.col("failures"), F.col("total_tests"))
    return c.select(
        *KEYS, F.round(F.coalesce(F.try_divide(failed, F.col("total_tests")), F.lit(0.0)), 4).alias("failure_rate"),
        F.round(F.coalesce(F.try_divide((F.col("total_tests") - failed) * 100, F.col("total_tests")), F.lit(0.0)), 2).alias("success_percent"),
    )


SQL["stats_of_rates"] = f"""WITH {COUNTERS_SQL}
SELECT class_id, gen, test, round(least(failures, total_tests) / total_tests, 4) AS failure_rate, round((total_tests - least(failures, total_tests)) * 100 / total_tests, 2) AS success_percent FROM counters"""

QUERIES = {name: globals()[name] for name in SQL}
