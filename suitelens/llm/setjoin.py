"""All pairs of set-valued records whose Jaccard similarity reaches a threshold, exactly.

Equal sets are put together first, so copies cost nothing. Values are ordered: those in few sets first, then the
crowded ones by how often they occur. Two sets of similarity t share a value among the first |x| - ceil(t |x|) + 1 of
both. Sets are filed under their first values that aren't crowded; two sets that share no such value both have crowded
ones among their first, and only those sets are filed once more, as follows. Two sets of similarity t differ in at most
(|x| + |y|) (1 - t) / (1 + t) values. For each range of sizes the values are dealt by their hash into just enough parts
that two such sets must agree on some part but for one value; each set is filed under the sums of the hashes of its
parts, and of its parts less one value. Sets meet where at least one of both has its whole part, so no crowd meets.
What meets is thinned by sizes and 64-bit sketches inside the join, then checked on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitelens.storage import staged

# key; name of the set; f2, size and flags in one number; sketch.
_KEYS = "key long, f1 long, meta long, sketch long"
_WHOLE, _OWN = 2, 1
#: A value is crowded if more sets than this have it. The list of frequent values that is sent to all tasks, for their
#: order and to tell which are crowded, holds no more than the MOST most frequent ones; the others come first in every
#: order and are treated like any value, which costs time but no pair.
CROWD, MOST = 1000, 1 << 16
_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def size_levels(least: int, t: Fraction, up_to: int) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, parts): sets that can be similar are of one level or of neighbouring ones."""
    out, low = [], least
    while not out or out[-1][1] < up_to:
        high = max(low, int((low if not out else low - 1) / t))
        differ = int(2 * high * (1 - t) / (1 + t))
        out.append((low, high, (differ + 2) // 2))
        low = high + 1
    return out


def _out(key, who, f1, f2, n, sketch, whole, own) -> pa.RecordBatch:
    meta = (f2[who].astype(np.int64) << 32) | (n[who] << 2) | np.where(whole, _WHOLE, 0) | (_OWN if own else 0)
    columns = [key.view(np.int64), f1[who], meta, sketch[who].view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "f1", "meta", "sketch"])


def _mixed(key: np.ndarray) -> np.ndarray:
    key = key * _ODD2
    return key ^ (key >> np.uint64(29))


def _signer(least: int, t: Fraction, frequent: np.ndarray, crowded: int, whole_only: bool):
    """Files each set; ``frequent`` has the hashes of frequent values, the most frequent last, the last ``crowded`` of them crowded."""
    by_hash = np.argsort(frequent)
    in_order = frequent[by_hash]
    calm = len(frequent) - crowded

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            n = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            values = np.asarray(lists.flatten()).view(np.uint64)
            f1, f2 = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            row = np.repeat(np.arange(len(n)), n)
            begin = np.concatenate([[0], np.cumsum(n)[:-1]])
            sketch = np.bitwise_or.reduceat(np.uint64(1) << ((values * _ODD2) >> np.uint64(58)), begin)
            # Prefixes: values that aren't frequent by their hash, then frequent ones from the rarest on.
            rank = np.zeros(len(values), np.int64)
            if len(in_order):
                at = np.minimum(np.searchsorted(in_order, values), len(in_order) - 1)
                rank = np.where(in_order[at] == values, by_hash[at] + 1, 0)
            order = np.lexsort((values, rank, row))
            length = n - -(-n * t.numerator // t.denominator) + 1
            first = (np.arange(len(values)) - begin[row]) < length[row]
            chosen = order[first]
            plain = chosen[rank[chosen] <= calm]
            yield _out(_mixed(values[plain]), row[plain], f1, f2, n, sketch, True, True)
            hot = np.zeros(len(n), bool)
            hot[row[chosen[rank[chosen] > calm]]] = True
            if not hot.any():
                continue
            levels = size_levels(least, t, int(n.max()))
            following = size_levels(least, t, levels[-1][1] + 1)[-1]
            level_of = np.searchsorted([high for _, high, _ in levels], n)
            for i, (_, _, parts) in enumerate([*levels, following]):
                for own in (True, False):
                    mine = hot & (level_of == (i if own else i - 1))
                    if not mine.any():
                        continue
                    at = np.flatnonzero(mine)
                    v, r = values[mine[row]], np.repeat(np.arange(len(at)), n[at])
                    part = (((v * _ODD) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
                    slot = r * parts + part
                    turn = np.argsort(slot, kind="stable")
                    v, slot = v[turn], slot[turn]
                    sums = np.zeros(len(at) * parts, np.uint64)
                    heads = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
                    sums[slot[heads]] = np.add.reduceat(v, heads)
                    salt = (np.arange(parts, dtype=np.uint64) + np.uint64((i + 1) << 20)) * _ODD
                    whole = (sums.reshape(-1, parts) + salt).ravel()
                    yield _out(_mixed(whole), at[np.repeat(np.arange(len(at)), parts)], f1, f2, n, sketch, True, own)
                    if not whole_only:
                        yield _out(_mixed(whole[slot] - v), at[slot // parts], f1, f2, n, sketch, False, own)

    return sign


def value_sets(df: DataFrame, id_column: str, values: str, field: str, least: int) -> DataFrame:
    """(id, field, f1, f2, tokens): the sorted distinct hashes of the values that are not null, and a 96-bit name of the set."""
    hashed = F.transform(F.filter(F.col(values), lambda x: x.isNotNull()), lambda x: F.xxhash64(F.lit(field), x))
    tokens = F.array_sort(F.array_distinct(hashed))
    return (
        df.filter(F.size(values) >= least)
        .select(F.col(id_column).alias("id"), F.lit(field).alias("field"), tokens.alias("tokens"))
        .filter(F.size("tokens") >= least)
        .select("id", "field", F.xxhash64("field", "tokens").alias("f1"), F.hash("tokens", "field").alias("f2"), "tokens")
    )


def similar_classes(sets: DataFrame, threshold: float, least: int, crowd: int = CROWD) -> DataFrame:
    """(a1, a2, b1, b2): names of different sets of one field whose similarity is at least ``threshold``.

    ``sets`` has (f1, f2, tokens), repeated or not. Fields don't mix: equal values of two fields have different hashes.
    """
    t = Fraction(str(threshold))
    classes = sets.groupBy("f1", "f2").agg(F.first("tokens").alias("tokens"))
    often = classes.select(F.explode("tokens").alias("value")).groupBy("value").count().filter("count > 1")
    top = often.orderBy(F.col("count").desc(), "value").limit(MOST).collect()
    frequent = np.array([r[0] for r in reversed(top)], np.int64).view(np.uint64)
    crowded = sum(r[1] > crowd for r in top)

    def side(whole_only: bool) -> DataFrame:
        return classes.mapInArrow(_signer(least, t, frequent, crowded, whole_only), _KEYS)

    a, b = side(True).alias("a"), side(False).alias("b")
    size = lambda x: F.shiftright(F.col(f"{x}.meta"), 2).bitwiseAND(F.lit((1 << 30) - 1))
    flag = lambda x, bit: F.col(f"{x}.meta").bitwiseAND(F.lit(bit)) != 0
    name = lambda x: F.struct(F.col(f"{x}.f1").alias("f1"), F.shiftright(F.col(f"{x}.meta"), 32).cast("int").alias("f2"))
    many, few, both = F.greatest(size("a"), size("b")), F.least(size("a"), size("b")), size("a") + size("b")
    may = (
        (F.col("a.key") == F.col("b.key"))
        & (flag("a", _OWN) | flag("b", _OWN))
        & (few * t.denominator >= many * t.numerator)
        & (
            F.bit_count(F.col("a.sketch").bitwiseXOR(F.col("b.sketch"))) * (t.denominator + t.numerator)
            <= both * (t.denominator - t.numerator)
        )
        & (F.when(flag("b", _WHOLE), name("a") < name("b")).otherwise(name("a") != name("b")))
    )
    met = (
        a.join(b, may)
        .select(F.least(name("a"), name("b")).alias("x"), F.greatest(name("a"), name("b")).alias("y"))
        .distinct()
        .select(F.col("x.f1").alias("a1"), F.col("x.f2").alias("a2"), F.col("y.f1").alias("b1"), F.col("y.f2").alias("b2"))
    )
    left = classes.select(F.col("f1").alias("a1"), F.col("f2").alias("a2"), F.col("tokens").alias("ta"))
    right = classes.select(F.col("f1").alias("b1"), F.col("f2").alias("b2"), F.col("tokens").alias("tb"))
    shared = F.size(F.array_intersect("ta", "tb"))
    return (
        met.join(left, ["a1", "a2"])
        .join(right, ["b1", "b2"])
        .withColumn("shared", shared)
        .filter(F.col("shared") * t.denominator >= (F.size("ta") + F.size("tb") - F.col("shared")) * t.numerator)
        .select("a1", "a2", "b1", "b2")
    )


def similar_pairs(
    df: DataFrame, id_column: str, fields: list[str], threshold: float, least: int = 1, crowd: int = CROWD
) -> DataFrame:
    """(field_name, id_a, id_b), id_a < id_b: rows whose sets in a field have a Jaccard similarity of ``threshold`` or more.

    Null arrays and sets with fewer than ``least`` distinct values (nulls inside are none) take no part; order and
    repetitions in an array don't matter. Rows with equal sets are pairs as well. A row repeated with its id counts
    once. An empty table gives no pairs.
    """
    parts = None
    for field in fields:
        part = value_sets(df, id_column, field, field, max(least, 1))
        parts = part if parts is None else parts.unionAll(part)
    sets = staged(parts, "sets")
    pairs = staged(similar_classes(sets, threshold, max(least, 1), crowd), "set-pairs")
    members = sets.select("id", "field", "f1", "f2")
    a = members.select(F.col("id").alias("ia"), F.col("field").alias("field_name"), F.col("f1").alias("a1"), F.col("f2").alias("a2"))
    b = members.select(F.col("id").alias("ib"), F.col("f1").alias("b1"), F.col("f2").alias("b2"))
    linked = pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select("field_name", "ia", "ib")
    repeated = members.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("f1", "f2")
    copied = members.join(repeated, ["f1", "f2"])
    equal = copied.select("f1", "f2", F.col("field").alias("field_name"), F.col("id").alias("ia")).join(
        copied.select("f1", "f2", F.col("id").alias("ib")), ["f1", "f2"]
    )
    return (
        linked.unionAll(equal.select("field_name", "ia", "ib"))
        .filter(F.col("ia") != F.col("ib"))
        .select("field_name", F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
        .distinct()
    )
