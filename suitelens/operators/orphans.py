"""References to records that do not exist, no longer exist or do not exist yet.

References and the starts and ends of their parents' validity intervals are sorted together by key and time and merged
in one linear pass: a reference is whole if at its time more intervals of its key have begun than ended. The sort is
range-partitioned over (key, time), so a key with any share of the rows is merged by many tasks; what is open at the
border of two partitions is carried over (see ordered_scan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suitelens.operators.ordered_scan import ordered_scan


def orphan_references(
    references: DataFrame,
    parents: DataFrame,
    *,
    key: list[tuple[Column, Column]],
    at: Column,
    valid_from: Column,
    valid_to: Column,
    ref_id: str,
    keep: list[str] = (),
) -> DataFrame:
    """Rows of ``references`` for which no parent of the same key is valid at their time.

    ``key`` lists pairs (of a reference, of a parent). A parent is valid from ``valid_from`` on and before
    ``valid_to`` (null: for ever); without ``valid_from`` it never is. Returns ``ref_id``, the columns in ``keep``, ``at`` and ``kind``:
    'missing' (no parent has the key, or a part of the key is null), 'late' (the first begins later), 'deleted' (all
    that began have ended) or 'undated' (parents exist, but the reference has no time or they have no beginning).
    Repeated references are judged one by one; repeated parents count once each. Empty tables are allowed.
    """
    names = [f"_k{i}" for i in range(len(key))]
    refs = references.select(
        *(r.alias(n) for n, (r, _) in zip(names, key)),
        at.alias("_at"),
        F.col(ref_id).alias("_id"),
        F.struct(F.col(ref_id), *(F.col(c) for c in keep)).alias("_row"),
    )
    row_type = refs.schema["_row"].dataType
    # All parts of the key as one string that sorts and compares as a whole.
    whole = F.to_json(F.array(*(F.col(n).cast("string") for n in names)))
    some_null = F.lit(False)
    for n in names:
        some_null |= F.col(n).isNull()
    ends = parents.select(
        *(p.alias(n) for n, (_, p) in zip(names, key)), valid_from.alias("_from"), valid_to.alias("_to")
    ).filter(~some_null).select(whole.alias("_key"), "_from", "_to")
    nothing = F.lit(None).cast(row_type)
    # That a key has parents at all is known before its first reference: one row per key, at the head of its times.
    heads = ends.groupBy("_key").agg(F.max(F.col("_from")).alias("_last")).select(
        "_key", F.lit(None).cast("timestamp_ntz").alias("_at"), F.lit(0).alias("_kind"), F.lit(0).alias("_delta"),
        F.lit(1).alias("_head"), F.lit(0).alias("_begun"), F.lit(None).cast("string").alias("_tie"), nothing.alias("_row"),
    )
    lasting = ends.filter(F.col("_from").isNotNull() & (F.col("_to").isNull() | (F.col("_to") > F.col("_from"))))
    never = ends.filter(F.col("_from").isNotNull() & (F.col("_to") <= F.col("_from")))

    def marks(df: DataFrame, time: str, delta: int, begun: int) -> DataFrame:
        # Equal marks are added up before they move.
        return df.groupBy("_key", F.col(time).cast("timestamp_ntz").alias("_at")).agg(F.count(F.lit(1)).alias("_n")).select(
            "_key", "_at", F.lit(1).alias("_kind"), (F.col("_n") * delta).alias("_delta"), F.lit(0).alias("_head"),
            (F.col("_n") * begun).alias("_begun"), F.lit(None).cast("string").alias("_tie"), nothing.alias("_row"),
        )

    asked = refs.select(
        F.when(~some_null, whole).alias("_key"), F.col("_at").cast("timestamp_ntz").alias("_at"), F.lit(2).alias("_kind"),
        F.lit(0).alias("_delta"), F.lit(0).alias("_head"), F.lit(0).alias("_begun"),
        F.col("_id").cast("string").alias("_tie"), "_row",
    )
    stream = asked
    for part in (heads, marks(lasting, "_from", 1, 1), marks(lasting.filter(F.col("_to").isNotNull()), "_to", -1, 0), marks(never, "_from", 0, 1)):
        stream = stream.unionAll(part.select(*asked.columns))
    stream = stream.withColumns({c: F.col(c).cast("long") for c in ("_delta", "_head", "_begun")})

    def undecided(batch, position, running, still):
        import numpy as np

        is_ref = np.asarray(batch.column(batch.schema.get_field_index("_kind"))) == 2
        return is_ref & (still | (running["_delta"] <= 0))

    order = [F.col("_at").asc_nulls_first(), F.col("_kind"), F.col("_tie")]
    merged = ordered_scan(stream, ["_key"], order, ["_delta", "_head", "_begun"], undecided)
    kind = (
        F.when(F.col("_key").isNull() | (F.col("_sum__head") == 0), "missing")
        .when(F.col("_at").isNull(), "undated")
        .when(F.col("_sum__begun") > 0, "deleted")
        .otherwise("late")
    )
    return merged.filter(F.col("_key").isNull() | (F.col("_sum__delta") <= 0)).select(
        "_row.*", F.col("_at").alias("at"), kind.alias("kind")
    )
