"""The first N rows of every group, however large the groups are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suitelens.operators.ordered_scan import POSITION, ordered_scan


def newest_of(df: DataFrame, key: str, newest: list[str], columns: list[Column]) -> DataFrame:
    """``columns`` of the row with the largest ``newest`` of each ``key``; a row without key stands for itself.

    Aggregated before it moves, so a key with any share of the rows is no burden. Nulls in ``newest`` count as least.
    """
    last = newest[-1]
    return (
        df.groupBy(F.col(key).alias("_key"), F.when(F.col(key).isNull(), F.col(last)).alias("_own"))
        .agg(F.max_by(F.struct(*columns), F.struct(*newest)).alias("_row"))
        .select("_row.*")
    )


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, with their ``position``.

    The rows are sorted over the whole cluster by (group, order), range-partitioned, so a group of millions of rows is
    many sorted pieces. Each piece counts its groups and drops what lies beyond ``n`` within it; the counts are
    prefix-summed into exact positions. ``order`` should end in a unique key; rows equal in all of it are
    interchangeable. Null group values form one group. An empty table gives no rows, n = 0 none either.
    """
    kept = ordered_scan(df, group, order, keep=lambda batch, position, running, still: position <= n)
    return kept.filter(F.col(POSITION) <= n).withColumnRenamed(POSITION, "position")
