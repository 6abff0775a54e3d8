"""Exact running positions and sums over globally sorted groups of any size.

The rows are range-partitioned by (group, order) and sorted, so a group of any size spreads over many partitions. One
pass over each partition computes positions and sums within the partition; the totals of the last group of each
partition are prefix-summed and added where a group goes on in the next partition. Besides the rows only one total per
partition moves, whatever the groups look like.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from suitelens.storage import staged

POSITION, OPEN, PART, TAIL = "_position", "_open", "_part", "_tail"
Keep = Callable[[pa.RecordBatch, np.ndarray, dict[str, np.ndarray], np.ndarray], np.ndarray]


def _starts(columns: list[pa.Array], last: tuple | None, rows: int) -> np.ndarray:
    """True where a row's group differs from the row before; nulls equal nulls."""
    out = np.zeros(rows, bool)
    for column in columns:
        a, b = column[1:], column[:-1]
        unequal = pc.fill_null(pc.not_equal(a, b), False)
        out[1:] |= np.asarray(pc.or_(unequal, pc.xor(pc.is_null(a), pc.is_null(b))))
    out[0] = last is None or tuple(c[0].as_py() for c in columns) != last
    return out


def _running(values: np.ndarray, starts: np.ndarray, carry) -> np.ndarray:
    total = np.cumsum(values)
    before = total - values
    first = np.flatnonzero(starts)
    base = np.zeros(len(values), total.dtype)
    if len(first):
        which = np.cumsum(starts) - 1
        base = np.where(which >= 0, before[first][np.maximum(which, 0)], -carry)
    else:
        base[:] = -carry
    return total - base


def _scanner(groups: list[str], sums: list[str], schema: pa.Schema, keep: Keep | None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, is_open = None, True
        count, carry = 0, {s: 0 for s in sums}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(batch.schema.get_field_index(g)) for g in groups]
            starts = _starts(columns, last, n)
            opened = starts.copy()
            if last is None:
                opened[0] = False  # the first group of a partition may have begun in an earlier one
            position = _running(np.ones(n, np.int64), starts, count)
            running = {
                s: _running(np.asarray(pc.fill_null(batch.column(batch.schema.get_field_index(s)), 0)), starts, carry[s])
                for s in sums
            }
            still = is_open & (np.cumsum(opened) == 0)
            is_open = bool(still[-1])
            last = tuple(c[n - 1].as_py() for c in columns)
            count, carry = int(position[-1]), {s: running[s][-1] for s in sums}
            extra = [pa.array(position), *(pa.array(running[s]) for s in sums), pa.array(still)]
            extra += [pa.array(np.full(n, part, np.int32)), pa.array(np.zeros(n, bool))]
            out = pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip([*batch.columns, *extra], schema)], schema=schema
            )
            yield out if keep is None else out.filter(pa.array(keep(batch, position, running, still)))
        if last is not None:
            values = dict(zip(groups, last)) | {POSITION: count, OPEN: is_open, PART: part, TAIL: True}
            values |= {f"_sum_{s}": carry[s] for s in sums}
            yield pa.RecordBatch.from_arrays(
                [pa.array([values.get(f.name)], f.type, from_pandas=False) for f in schema], schema=schema
            )

    return scan


def ordered_scan(
    df: DataFrame,
    groups: list[str],
    order: list[Column],
    sums: list[str] = (),
    keep: Keep | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``_position`` (from 1) and, for each name in ``sums``, ``_sum_<name>`` (inclusive) to the rows of ``df``.

    ``order`` should end in a unique key, else equal rows are interchangeable. Null group values form a group of their
    own; nulls in ``sums`` count as 0. ``keep`` may drop rows while they are scanned: it gets the batch, the positions
    and sums so far and whether the row's group may have begun in an earlier partition, in which case position and
    sums are still lower bounds by what that partition holds. No column may be named like the added ones.
    """
    spark = df.sparkSession
    clash = {POSITION, OPEN, PART, TAIL, *(f"_sum_{s}" for s in sums)} & set(df.columns)
    if clash:
        raise ValueError(f"columns with names kept for results: {sorted(clash)}")
    groups, sums = list(groups), list(sums)
    number = lambda s: T.DoubleType() if isinstance(df.schema[s].dataType, (T.DoubleType, T.FloatType)) else T.LongType()
    added = [T.StructField(POSITION, T.LongType()), *(T.StructField(f"_sum_{s}", number(s)) for s in sums)]
    added += [T.StructField(OPEN, T.BooleanType()), T.StructField(PART, T.IntegerType()), T.StructField(TAIL, T.BooleanType())]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema), *added])
    from pyspark.sql.pandas.types import to_arrow_schema

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*(F.col(g).asc_nulls_first() for g in groups), *order]
    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    scanned = staged(ordered.mapInArrow(_scanner(groups, sums, to_arrow_schema(schema), keep), schema), "scan")

    # One row per partition that is not empty.
    along, same = Window.orderBy(PART), Window.partitionBy(*groups).orderBy(PART)
    tails = scanned.filter(F.col(TAIL)).select(
        *(F.col(g).alias(f"_of_{i}") for i, g in enumerate(groups)), PART, POSITION, *(f"_sum_{s}" for s in sums)
    )
    same = Window.partitionBy(*(f"_of_{i}" for i in range(len(groups)))).orderBy(PART)
    carry = tails.select(
        *(f"_of_{i}" for i in range(len(groups))),
        F.lead(PART).over(along).alias("_next"),
        F.sum(POSITION).over(same).alias("_carry_n"),
        *(F.sum(f"_sum_{s}").over(same).alias(f"_carry_{s}") for s in sums),
    ).filter(F.col("_next").isNotNull())
    rows = scanned.filter(~F.col(TAIL))
    on = F.col(OPEN) & (F.col(PART) == F.col("_next"))
    for i, g in enumerate(groups):
        on &= F.col(g).eqNullSafe(F.col(f"_of_{i}"))
    joined = rows.join(F.broadcast(carry), on, "left")
    plus = lambda c, k: (F.col(c) + F.coalesce(F.col(k), F.lit(0))).alias(c)
    return joined.select(*df.columns, plus(POSITION, "_carry_n"), *(plus(f"_sum_{s}", f"_carry_{s}") for s in sums))
