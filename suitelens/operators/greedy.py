"""Greedy choices within small populations, as folds that stay in the JVM.

Each takes groups that selection has bounded (a population per class and generation); they are no way to treat whole
classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(pairs: DataFrame, group: list[str], score: str, a: str, b: str, limit: Column) -> DataFrame:
    """Pairs taken from the highest ``score`` on (ties: smaller a, then b) if neither end is in a pair taken before.

    ``limit`` says, from the group's columns and ``pairs_in_group``, how many at most. Adds ``pick``, from 1.
    """
    one = F.struct((-F.col(score)).alias("s"), F.col(a).alias("a"), F.col(b).alias("b"))
    kind = pairs.schema[a].dataType.simpleString()
    grouped = pairs.groupBy(*group).agg(F.array_sort(F.collect_list(one)).alias("_all"), F.count(F.lit(1)).alias("pairs_in_group"), limit.alias("_k"))
    start = F.expr(f"named_struct('used', cast(array() as array<{kind}>), 'sel', cast(array() as array<struct<s:double,a:{kind},b:{kind}>>))")

    def step(state: Column, x: Column) -> Column:
        used, sel = state["used"], state["sel"]
        free = ~F.array_contains(used, x["a"]) & ~F.array_contains(used, x["b"]) & (F.size(sel) < F.col("_k"))
        taken = F.struct(F.concat(used, F.array(x["a"], x["b"])).alias("used"), F.array_append(sel, x).alias("sel"))
        return F.when(free, taken).otherwise(state)

    folded = grouped.withColumn("_all", F.transform("_all", lambda x: F.struct(x["s"].cast("double").alias("s"), x["a"].alias("a"), x["b"].alias("b"))))
    folded = folded.select(*group, F.aggregate("_all", start, step)["sel"].alias("_sel"))
    return folded.select(*group, F.posexplode("_sel").alias("_at", "_x")).select(
        *group, (F.col("_at") + 1).alias("pick"), F.col("_x.a").alias(a), F.col("_x.b").alias(b), (-F.col("_x.s")).alias(score)
    )


def set_cover(suites: DataFrame, group: list[str], rank: str, items: str) -> DataFrame:
    """The suite of rank 1, then again and again the one that adds most items (ties: lower rank), until none adds any.

    Adds ``pick``, from 1, and ``covered``, how many items the suites up to it have together.
    """
    grouped = suites.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.coalesce(F.col(items), F.expr("array()")).alias("v")))).alias("_all")
    )
    first = F.col("_all")[0]
    start = F.struct(first["v"].alias("have"), F.array(F.struct(first["r"].alias("r"), F.size(first["v"]).alias("c"))).alias("sel"))

    def step(state: Column, _: Column) -> Column:
        gains = F.transform(
            "_all", lambda s: F.struct(F.size(F.array_except(s["v"], state["have"])).alias("g"), (-s["r"]).alias("r"), s["v"].alias("v"))
        )
        best = F.array_max(gains)
        more = F.array_union(state["have"], best["v"])
        taken = F.struct(more.alias("have"), F.array_append(state["sel"], F.struct((-best["r"]).alias("r"), F.size(more).alias("c"))).alias("sel"))
        return F.when(best["g"] > 0, taken).otherwise(state)

    steps = F.when(F.size("_all") > 1, F.sequence(F.lit(2), F.size("_all"))).otherwise(F.expr("cast(array() as array<int>)"))
    folded = grouped.select(*group, F.aggregate(steps, start, step)["sel"].alias("_sel"))
    return folded.select(*group, F.posexplode("_sel").alias("_at", "_x")).select(
        *group, (F.col("_at") + 1).alias("pick"), F.col("_x.r").alias(rank), F.col("_x.c").alias("covered")
    )


def first_to_add(suites: DataFrame, group: list[str], rank: str, items: str) -> DataFrame:
    """The suites that hold an item which none of lower rank holds, with how many: what a redundancy filter keeps.

    Works on items, so groups may be of any size.
    """
    each = suites.select(*group, rank, F.explode(F.array_distinct(items)).alias("_item"))
    firsts = each.groupBy(*group, "_item").agg(F.min(rank).alias(rank))
    return firsts.groupBy(*group, rank).agg(F.count(F.lit(1)).alias("adds"))
