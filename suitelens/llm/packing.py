"""Filling containers of fixed capacity with texts, leaving little room and splitting only what no container holds.

Sizes are whole numbers up to the capacity, so an instance of any number of texts is a table of how often each size
occurs. The table is reduced by Martello and Toth's dominance: sets of up to three items that some best filling
contains are fixed for good. What remains is filled best-fit, the largest first. Both work on whole runs of equal sizes and
say which ranks of a size go to which containers; each text then finds its container by its rank among its size.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitelens.llm.tokens import VOCABULARY, with_token_counts
from suitelens.operators.ordered_scan import POSITION, ordered_scan
from suitelens.storage import staged

Run = tuple[int, int, int, int, int]  # size, first rank, end of ranks, first container, items of it per container


class _Instance:
    """How many items of each size are left, and the runs that were given away."""

    def __init__(self, counts: dict[int, int]):
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.left)
        self.used = dict.fromkeys(counts, 0)
        self.runs: list[Run] = []
        self.containers = 0

    def give(self, size: int, base: int, containers: int, each: int) -> None:
        n = containers * each
        self.runs.append((size, self.used[size], self.used[size] + n, base, each))
        self.used[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def fix(self, items: tuple[int, ...]) -> None:
        """As many containers of just these items as there are."""
        need = {s: items.count(s) for s in items}
        k = min(self.left[s] // m for s, m in need.items())
        for s, m in need.items():
            self.give(s, self.containers, k, m)
        self.containers += k

    def largest(self, room: int, but: dict[int, int]) -> int | None:
        """The largest size of at most ``room`` of which there is more than ``but`` says."""
        at = bisect_right(self.sizes, room) - 1
        while at >= 0 and self.left[self.sizes[at]] <= but.get(self.sizes[at], 0):
            at -= 1
        return self.sizes[at] if at >= 0 else None

    def smallest(self, many: int, but: dict[int, int]) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(many - len(out), self.left[s] - but.get(s, 0))
            if len(out) >= many:
                break
        return out


def _dominating(x: _Instance, big: int, capacity: int) -> tuple[int, ...] | None:
    """Items that may share a container with one of ``big`` in some best filling, if that can be told."""
    room, taken = capacity - big, {big: 1}
    one = x.largest(room, taken)
    if one is None:
        return (big,)
    few = x.smallest(3, taken)
    if one == room or len(few) < 2 or few[0] + few[1] > room:
        return (big, one)  # it fills up, or no two others fit: any single one can be exchanged for it
    if len(few) == 3 and sum(few) <= room:
        return None
    # Two others fit, three don't. A pair dominates if its first is the largest that fits and its second the largest
    # that can be the smaller of any pair.
    second = x.largest(room - one, taken | {one: taken.get(one, 0) + 1})
    half = x.largest(room // 2, taken)
    if second is not None and half is not None and second >= half:
        return (big, one, second)
    best = 0
    for s in x.sizes:
        other = x.largest(room - s, taken | {s: taken.get(s, 0) + 1})
        if x.left[s] > taken.get(s, 0) and other is not None:
            best = max(best, s + other)
    return (big, one) if one >= best else None


def fill(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs that put ``counts`` (size: how many) into containers, and the number of containers."""
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("sizes must be from 1 to the capacity")
    x = _Instance(counts)
    changed = True
    while changed:
        changed = False
        for big in reversed(x.sizes.copy()):
            if big * 2 < capacity and big != capacity:
                break
            while big in x.left and (found := _dominating(x, big, capacity)):
                x.fix(found)
                changed = True
    open_at: dict[int, list[tuple[int, int]]] = {}  # room: (first container, containers)
    rooms: list[int] = []

    def put(room: int, base: int, n: int) -> None:
        if room not in open_at:
            open_at[room] = []
            insort(rooms, room)
        open_at[room].append((base, n))

    for size in reversed(x.sizes.copy()):
        while size in x.left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                base, n = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
                    rooms.pop(at)
            else:
                room, base = capacity, x.containers
                n = -(-x.left[size] // (capacity // size))
                x.containers += n
            each = min(room // size, x.left[size])
            k = min(n, x.left[size] // each)
            x.give(size, base, k, each)
            if k < n:
                put(room, base + k, n - k)
            if room > each * size:
                put(room - each * size, base, k)
    return x.runs, x.containers


def contexts(
    documents: DataFrame, specs: DataFrame, id_column: str, text: str, spec_id: str, capacity: str, vocabulary: str = VOCABULARY
) -> DataFrame:
    """(spec_id, context_id, id, piece_no, token_begin, n_tokens, capacity): where every text lies, for each spec.

    A text longer than the capacity is cut into pieces of the capacity and a rest; others are whole (piece 0). Texts
    that are null or have no token lie nowhere. Specs without a positive capacity are left out. ``specs`` and the table of
    sizes, which has at most as many rows as all capacities together, go through the driver.
    """
    spark = documents.sparkSession
    sizes = staged(with_token_counts(documents.select(F.col(id_column).alias("_id"), text), text, "_n", vocabulary), "sizes")
    wanted = specs.select(F.col(spec_id).cast("int"), F.col(capacity).cast("long")).filter(F.col(capacity) > 0).distinct().collect()
    each = F.array(*(F.struct(F.lit(s).cast("int").alias("s"), F.lit(c).cast("long").alias("c")) for s, c in wanted))
    if not wanted:
        each = F.expr("cast(array() as array<struct<s:int,c:bigint>>)")
    pieces = (
        sizes.filter("_n > 0")
        .withColumn("_spec", F.explode(each))
        .select("_id", "_n", F.col("_spec.s").alias(spec_id), F.col("_spec.c").alias("capacity"))
        .withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(_n - 1) div capacity"))))
        .select(
            spec_id, "capacity", "_id", F.col("_piece").alias("piece_no"),
            (F.col("_piece") * F.col("capacity")).alias("token_begin"),
            F.least("capacity", F.col("_n") - F.col("_piece") * F.col("capacity")).alias("n_tokens"),
        )
    )
    counted: dict[tuple[int, int], dict[int, int]] = {}
    for r in pieces.groupBy(spec_id, "capacity", "n_tokens").count().collect():
        counted.setdefault((r[0], r[1]), {})[r[2]] = r[3]
    runs = [(spec, *run) for (spec, room), counts in counted.items() for run in fill(counts, room)[0]]
    table = spark.createDataFrame(runs, "_spec int, _size long, _lo long, _hi long, _base long, _each long")
    ranked = ordered_scan(pieces, [spec_id, "n_tokens"], [F.col("_id"), F.col("piece_no")])
    rank = F.col(POSITION) - 1
    on = (F.col(spec_id) == F.col("_spec")) & (F.col("n_tokens") == F.col("_size")) & (rank >= F.col("_lo")) & (rank < F.col("_hi"))
    return ranked.join(F.broadcast(table), on).select(
        spec_id, (F.col("_base") + F.expr(f"({POSITION} - 1 - _lo) div _each")).alias("context_id"),
        F.col("_id").alias(id_column), "piece_no", "token_begin", "n_tokens", "capacity",
    )
