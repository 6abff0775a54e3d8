"""More tasks for work that costs far more than reading its input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """``df`` in ``per_core`` partitions for each core, dealt in turn, if its scan has fewer than two for each.

    File splits are made for reading: a few megabytes of text can be minutes of parsing. Frames that shuffle already
    are returned as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName().startswith("AdaptiveSparkPlan"):
        return df
    return df if plan.execute().getNumPartitions() >= 2 * cores else df.repartition(per_core * cores)
