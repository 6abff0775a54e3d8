"""Top rows, similar sets, packing and mixing against brute force, and their defined results for awkward rows."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from suitelens.llm.mixing import ALL, Source, draw, entropy, exponent_for_entropy, plan, shares, weights
from suitelens.llm.packing import contexts, fill
from suitelens.llm.setjoin import similar_pairs, size_levels
from suitelens.llm.tokens import with_token_counts
from suitelens.llm.topn import newest_of, top_n_per_group


@pytest.mark.parametrize("partitions", ["1", "4", "9"])
def test_top_n(spark, partitions):
    r = random.Random(int(partitions))
    rows = [(r.choice(["hot"] * 9 + ["a", "b", None]), r.choice([None, 0.5, 0.25, float("nan"), r.random()]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, position_of double, id int")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        order = [F.col("position_of").desc_nulls_last(), F.col("id")]
        got = {(x.g, x.position): x.id for x in top_n_per_group(df, ["g"], order, 10).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rank = lambda v: (2, 0) if v is None else (0, 0) if math.isnan(v) else (1, -v)
    want = {}
    for g in {x[0] for x in rows}:
        for k, x in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (rank(x[1]), x[2]))[:10], 1):
            want[g, k] = x[2]
    assert got == want


def test_top_n_cases(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "g string, v int")
    assert len(top_n_per_group(df, ["g"], [F.col("v")], 5).collect()) == 3
    assert top_n_per_group(df, ["g"], [F.col("v")], 0).count() == 0
    assert top_n_per_group(df.limit(0), ["g"], [F.col("v")], 3).count() == 0
    runs = spark.createDataFrame([(1, 10, 5), (1, 11, 5), (1, 9, 7), (None, 3, 1), (None, 4, None)], "run int, id int, at int")
    assert sorted(x.id for x in newest_of(runs, "run", ["at", "id"], [F.col("id")]).collect()) == [3, 4, 9]


def _brute(rows, t, least):
    out = set()
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if a != b and x is not None and y is not None:
                u, v = set(x) - {None}, set(y) - {None}
                if len(u) >= least and len(v) >= least and 10 * len(u & v) >= 10 * t * len(u | v) - 1e-9:
                    out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("crowd", [3, 40, 10_000])
@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_similar_sets(spark, crowd, threshold):
    r = random.Random(crowd)
    common, rows = [f"c{i}" for i in range(4)], []
    for i in range(160):
        if i > 20 and r.random() < 0.5:
            x = [v for v in rows[r.randrange(len(rows))][1] or [] if r.random() < 0.9] + r.sample(common, 1)
        else:
            x = [f"m{r.randint(0, 25 if i % 3 else 4000)}" for _ in range(r.randint(0, 30))] + common[: r.randint(0, 4)]
        r.shuffle(x)
        rows.append((i, None if r.random() < 0.04 else x + x[:1] + ([None] if r.random() < 0.1 else [])))
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "id long, v array<string>").withColumn("f1", F.lit("clash"))
    got = {(x.id_a, x.id_b) for x in similar_pairs(df, "id", ["v"], threshold, 5, crowd).collect()}
    assert got == _brute(rows, threshold, 5)


def test_fields_do_not_mix(spark):
    df = spark.createDataFrame([(1, list("abcdef"), list("uvwxyz")), (2, list("abcdef"), None), (3, [], list("abcdef"))], "id long, a array<string>, b array<string>")
    assert [tuple(x) for x in similar_pairs(df, "id", ["a", "b"], 0.7, 5).collect()] == [("a", 1, 2)]
    assert similar_pairs(df.limit(0), "id", ["a", "b"], 0.7, 5).count() == 0


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 20), st.sampled_from([0.5, 0.7, 0.8, 0.9]))
def test_levels_hold_all_partners(least, t):
    from fractions import Fraction

    q = Fraction(str(t))
    levels = size_levels(least, q, 300)
    level = {n: i for i, (low, high, _) in enumerate(levels) for n in range(low, high + 1)}
    for n in range(least, 300):
        for m in range(n, min(300, int(n / q)) + 1):
            assert 0 <= level[m] - level[n] <= 1
            assert int((n + m) * (1 - q) / (1 + q)) // 2 + 1 <= levels[level[m]][2]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.dictionaries(st.integers(1, 60), st.integers(1, 5), max_size=25))
def test_filling(capacity, counts):
    counts = {s: n for s, n in counts.items() if s <= capacity}
    runs, n = fill(counts, capacity)
    load, got = {}, {}
    for s, lo, hi, base, each in runs:
        got[s] = got.get(s, 0) + hi - lo
        for k in range(hi - lo):
            load[base + k // each] = load.get(base + k // each, 0) + s
    assert got == counts and set(load) == set(range(n)) and max(load.values(), default=0) <= capacity
    lower = -(-sum(s * k for s, k in counts.items()) // capacity)
    assert lower <= n <= max(lower, math.ceil(lower * 1.7))


def test_filling_is_best_on_small_instances():
    r = random.Random(2)

    def best(items, capacity):
        items = sorted(items, reverse=True)
        low = [len(items)]

        def go(i, rooms):
            if len(rooms) >= low[0]:
                return
            if i == len(items):
                low[0] = len(rooms)
                return
            for k in {room: k for k, room in enumerate(rooms) if room >= items[i]}.values():
                go(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
            go(i + 1, [*rooms, capacity - items[i]])

        go(0, [])
        return low[0]

    off = 0
    for _ in range(60):
        items = [r.randint(3, 20) for _ in range(9)]
        off += fill({s: items.count(s) for s in items}, 20)[1] - best(items, 20)
    assert off <= 3


def test_contexts(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["word"] * r.choice([0, 1, 3, 8, 20, 33, 200]))) for i in range(120)] + [(500, None), (501, ""), (3, "word word")]
    docs = spark.createDataFrame([(*x, "x") for x in rows], "doc_id long, text string, capacity string").drop("capacity")
    specs = spark.createDataFrame([(1, "a", 16), (2, "b", 64), (3, "none", None), (4, "zero", 0)], "spec_id int, purpose string, capacity_tokens int")
    out = contexts(docs, specs, "doc_id", "text", "spec_id", "capacity_tokens").collect()
    sizes = sorted((x.doc_id, x.n) for x in with_token_counts(docs, "text", "n").collect() if x.n)
    for spec, capacity in ((1, 16), (2, 64)):
        mine = [x for x in out if x.spec_id == spec]
        assert sum(x.n_tokens for x in mine) == sum(n for _, n in sizes)
        load = {}
        for x in mine:
            load[x.context_id] = load.get(x.context_id, 0) + x.n_tokens
            assert x.token_begin == x.piece_no * capacity and (x.piece_no == 0 or any(n > capacity for d, n in sizes if d == x.doc_id))
        assert max(load.values()) <= capacity and set(load) == set(range(len(load)))
    assert {x.spec_id for x in out} == {1, 2} and not {500, 501} & {x.doc_id for x in out}
    assert contexts(docs.limit(0), specs, "doc_id", "text", "spec_id", "capacity_tokens").count() == 0


def test_plan_meets_targets_or_tempers_least():
    s = [Source("a", 0.6, 1000, 2), Source("b", 0.3, 5000, 1), Source("c", 0.1, 50, None), Source("d", 0.2, 0, 3)]
    amounts, exponent, total = plan(s, None)
    assert exponent == 0 and amounts["a"] == 2000 and abs(amounts["b"] - 1000) <= 1 and abs(amounts["c"] - 333) <= 1
    amounts, exponent, _ = plan(s, 5000)
    assert 0 < exponent < 1 and amounts["a"] <= 2000 and abs(sum(amounts.values()) - 5000) <= 3
    assert abs(sum(weights(s[:3], 0.4)) - 1) < 1e-9 and plan([], None)[0] == {} and plan(s, 10**9)[0]["a"] == 2000


def test_draw(spark):
    r = random.Random(3)
    docs = [(i, r.choice(["A-b", "a_B ", "c", "unlisted", None]), " ".join(["word"] * r.randint(1, 9))) for i in range(300)] + [(900, "c", None), (901, "c", "")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a-b", 0.9, 3), ("c", 0.05, None), ("gone", 0.05, 2)], "source string, target_share double, max_repeats int")
    out = draw(df, targets).collect()
    assert {x.source for x in out} == {"a-b", "c"} and not {900, 901} & {x.doc_id for x in out}
    times = {}
    for x in out:
        times[x.doc_id] = times.get(x.doc_id, 0) + 1
    known = {d: s for d, s, _ in docs}
    assert max(n for d, n in times.items() if known[d] != "c") <= 3
    assert len({(x.source, x.doc_id, x.repeat_no) for x in out}) == len(out)
    total = sum(x.n_tokens for x in out)
    assert abs(sum(x.n_tokens for x in out if x.source == "c") / total - 0.05 / 0.95) < 0.01
    said = {x.source: x for x in shares(df, targets).collect()}
    assert said["gone"].drawn_tokens == 0 and abs(said["a-b"].actual_share - 0.9 / 0.95) < 0.01
    assert sorted(map(tuple, out)) == sorted(map(tuple, draw(df, targets).collect()))
    assert draw(df.limit(0), targets).count() == 0 and draw(df, targets.limit(0)).count() == 0


def test_exponent_for_entropy():
    tokens = [900.0, 90.0, 9.0, 0.0]
    for e in (0.1, 0.5, 1.0, 2.5):
        assert abs(exponent_for_entropy(tokens, entropy([t**e for t in tokens if t])) - e) < 1e-6
    assert exponent_for_entropy(tokens, 0.0) > 60 and exponent_for_entropy([], 1.0) >= 0


def test_tempered_draw(spark):
    """A budget beyond what the limits allow at the targets bends the shares between the targets and what there is."""
    rows = [(i, "small" if i < 10 else "large", "one two three " * 5) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("small", 0.5, 2), ("large", 0.5, 1)], "source string, target_share double, max_repeats int")
    said = {x.source: x for x in shares(df, targets, ALL).collect()}
    assert 0 < said["small"].exponent < 1 and 0.1 < said["small"].actual_share < 0.5 and said["small"].repeats <= 2
    out = draw(df, targets, ALL).collect()
    blocks = {}
    for x in out:
        blocks.setdefault((x.source, x.repeat_no), []).append((x.position, x.doc_id))
    for b in blocks.values():
        assert sorted(p for p, _ in b) == list(range(1, len(b) + 1)) and len({d for _, d in b}) == len(b)
    first, second = ([d for _, d in sorted(blocks["small", k])] for k in (1, 2))
    assert first[: len(second)] != second
