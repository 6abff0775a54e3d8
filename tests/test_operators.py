"""Operators against brute force, and their defined results for awkward rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from suitelens.functions import names, rules, scoring
from suitelens.operators import greedy
from suitelens.operators.ordered_scan import ordered_scan
from suitelens.operators.orphans import orphan_references


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_ordered_scan(spark, partitions):
    r = random.Random(partitions)
    rows = [(r.choice([None, "a", "a", "a", "a", "b", "c", "rare" + str(i)]), i, r.choice([None, 1, 2, -3])) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    out = ordered_scan(df, ["g"], [F.col("i")], ["v"], partitions=partitions).collect()
    seen, total = {}, {}
    want = {}
    for g, i, v in sorted(rows, key=lambda x: x[1]):
        seen[g], total[g] = seen.get(g, 0) + 1, total.get(g, 0) + (v or 0)
        want[i] = (seen[g], total[g])
    assert {x.i: (x._position, x._sum_v) for x in out} == want


def test_ordered_scan_cases(spark):
    df = spark.createDataFrame([], "g string, i int")
    assert ordered_scan(df, ["g"], [F.col("i")]).count() == 0
    with pytest.raises(ValueError):
        ordered_scan(df.withColumn("_position", F.lit(1)), ["g"], [F.col("i")])
    same = spark.createDataFrame([("a", 1)] * 50, "g string, i int")
    assert sorted(x._position for x in ordered_scan(same, ["g"], [F.col("i")]).collect()) == list(range(1, 51))


def _orphans(spark, refs, parents):
    r = spark.createDataFrame(refs, "id long, p string, k string, t timestamp_ntz, kind string")
    q = spark.createDataFrame(parents, "p string, k string, a timestamp_ntz, b timestamp_ntz, kind string")
    out = orphan_references(r, q, key=[(F.col("p"), F.col("p")), (F.col("k"), F.col("k"))], at=F.col("t"), valid_from=F.col("a"), valid_to=F.col("b"), ref_id="id", keep=["p"])
    return sorted((x.id, x.kind) for x in out.collect())


def test_orphans_against_brute_force(spark):
    r = random.Random(4)
    day = lambda n: None if n is None else datetime(2024, 1, 1) + timedelta(days=n)
    keys = [("x", "hot")] * 6 + [("x", "k1"), ("y", "hot"), ("y", "k2"), (None, "k1"), ("x", None), ("z", "gone")]
    refs = [(i, *r.choice(keys), day(r.choice([None, *range(12)])), "extra") for i in range(800)]
    parents = [(*r.choice(keys[:-1]), day(r.choice([None, *range(12)])), day(r.choice([None, None, *range(12)])), "extra") for _ in range(25)]
    want = []
    for i, p, k, t, _ in refs:
        same = [x for x in parents if p is not None and k is not None and x[0] == p and x[1] == k]
        if any(a is not None and t is not None and a <= t and (b is None or b > t) for _, _, a, b, _ in same):
            continue
        begun = [1 for _, _, a, _, _ in same if a is not None and t is not None and a <= t]
        want.append((i, "missing" if not same else "undated" if t is None else "deleted" if begun else "late"))
    assert _orphans(spark, refs, parents) == sorted(want)


def test_orphans_of_empty_tables(spark):
    t = datetime(2024, 1, 1)
    assert _orphans(spark, [], []) == []
    assert _orphans(spark, [(1, "x", "k", t, ""), (1, "x", "k", t, "")], []) == [(1, "missing"), (1, "missing")]
    assert _orphans(spark, [(1, "x", "k", t, "")], [("x", "k", t, t + timedelta(1), "")] * 3) == []
    assert _orphans(spark, [(1, "x", "k", t, "")], [("x", "k", t - timedelta(1), t, "")]) == [(1, "deleted")]
    assert _orphans(spark, [(1, "x", "k", t, "")], [("x", "k", None, None, "")]) == [(1, "late")]


def test_greedy_against_loops(spark):
    r = random.Random(6)
    pairs = [(g, a, b, round(r.random(), 2)) for g in range(4) for a in range(8) for b in range(a + 1, 8)]
    df = spark.createDataFrame(pairs, "g int, a long, b long, d double")
    got = {(x.g, x.pick): (x.a, x.b) for x in greedy.matching(df, ["g"], "d", "a", "b", F.lit(3)).collect()}
    want = {}
    for g in range(4):
        used, n = set(), 0
        for _, a, b, _ in sorted((p for p in pairs if p[0] == g), key=lambda p: (-p[3], p[1], p[2])):
            if n < 3 and not {a, b} & used:
                n += 1
                used |= {a, b}
                want[g, n] = (a, b)
    assert got == want
    suites = [(g, k, r.sample(range(30), r.randint(0, 9))) for g in range(5) for k in range(1, 9)]
    out = greedy.set_cover(spark.createDataFrame(suites, "g int, rank int, items array<int>"), ["g"], "rank", "items").orderBy("g", "pick").collect()
    for g in range(5):
        have = set(suites[g * 8][2])
        order = [1]
        while True:
            gain, k = max((len(set(s) - have), -k) for q, k, s in suites if q == g)
            if not gain:
                break
            order.append(-k)
            have |= set(next(s for q, kk, s in suites if q == g and kk == -k))
        assert [x.rank for x in out if x.g == g] == order


def test_rules(spark):
    df = spark.createDataFrame([("b a",), ("b",), ("",), (None,)], "t string")
    table = [("one", ["a"]), ("two", ["b", "zz"])]
    assert [r.x for r in df.select(rules.first_match(F.col("t"), table, "none").alias("x")).collect()] == ["one", "two", "none", "none"]
    scored = [("x", ["a"], 0), ("y", ["b"], 0), ("z", ["b"], 0)]
    assert [r.x for r in df.select(rules.best_scored(F.col("t"), scored, "none").alias("x")).collect()] == ["x", "y", "none", "none"]


def test_names_and_scores(spark):
    rows = [("FooTestV12",), ("FooTest_Crossover_Gen2_8x4",), ("FooTest_Mutation_Gen3_V7",), ("FooTest",), ("Foo",), (None,)]
    df = spark.createDataFrame(rows, "n string")
    c = F.col("n")
    i, j = names.pair(c)
    out = [tuple(r) for r in df.select(names.class_under_test(c), names.kind(c), names.version(c), names.generation(c), i, j).collect()]
    assert out[:5] == [("Foo", "base", 12, None, None, None), ("Foo", "crossover", None, 2, 4, 8), ("Foo", "mutation", 7, 3, None, None), ("Foo", "other", None, None, None, None), (None, "other", None, None, None, None)]
    s = spark.createDataFrame([("f([[IJLjava/util/List;)[Z",)], "s string")
    assert s.select(F.transform(names.parameter_types(F.col("s")), names.readable_type), names.readable_type(names.return_type(F.col("s")))).collect()[0][:] == (["int[][]", "long", "List"], "boolean[]")
    d = spark.createDataFrame([([1, 2], [2, 3]), ([], []), (None, [1])], "a array<int>, b array<int>")
    assert [round(r[0], 4) for r in d.select(scoring.jaccard_distance(F.col("a"), F.col("b"))).collect()] == [0.6667, 0.0, 1.0]


def test_staged_tables_are_cleared(spark):
    from suitelens.storage import clear_staged, staged

    first = staged(spark.range(5), "numbers")
    assert first.count() == 5 and len(first.inputFiles()) > 0
    clear_staged(spark)
    assert staged(spark.range(2), "numbers").count() == 2
