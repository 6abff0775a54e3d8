"""Writing reports by partition, snapshots of generations, and states that are merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_partitions(df: DataFrame, path: str, by: list[str], form: str = "parquet") -> None:
    """Replace only those partitions that ``df`` has rows of."""
    df.write.format(form).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).save(path)


def next_generation(df: DataFrame, gen: str = "gen") -> DataFrame:
    """A snapshot is the same rows one generation later."""
    return df.withColumn(gen, F.col(gen) + 1)


def renamed(df: DataFrame, names: DataFrame, column: str, old: str = "old", new: str = "new") -> DataFrame:
    """``column`` by the pairs in ``names``; names that aren't in it stay."""
    pairs = names.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    return df.join(pairs, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", F.col(column))).drop("_old", "_new")


def merged_states(stored: DataFrame, fresh: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key: the one with the largest ``order``, of ``fresh`` if both are equal."""
    both = stored.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
    row = F.struct(*(F.col(c) for c in stored.columns))
    return both.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key))).agg(F.max_by(row, F.struct(F.col(order), F.col("_fresh"))).alias("_r")).select("_r.*")
