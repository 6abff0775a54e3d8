"""Native inputs on small literals."""

import json

from pyspark.sql import functions as F

from suitelens.sources import logs, reports, sinks
from suitelens.sources.java_source import blanked, facts, java_facts, split_parameters

COVERAGE = """<?xml version="1.0"?><!DOCTYPE report PUBLIC "-//X//DTD Report 1.0//EN" "report.dtd">
<report name="r"><package name="p"><class name="p/A" sourcefilename="A.java">
<method name="f" desc="()V"><counter type="METHOD" missed="0" covered="1"/><counter type="LINE" missed="1" covered="2"/></method>
<method name="g" desc="(I)V"><counter type="INSTRUCTION" missed="4" covered="0"/></method>
<method name="h" desc="()I"/>
<counter type="LINE" missed="3" covered="7"/><counter type="BRANCH" missed="1" covered="1"/></class>
<class name="p/A$B" sourcefilename="A.java"><method name="f" desc="()V"><counter type="METHOD" missed="1" covered="0"/></method>
<counter type="LINE" missed="2" covered="0"/></class></package><counter type="LINE" missed="5" covered="7"/></report>"""

SUITE = """<testsuite name="ATest" tests="4" failures="1" errors="1" skipped="1" time="0.5">
<testcase name="a" classname="ATest" time="0.1"/><testcase name="b" classname="ATest" time="0.1"><failure message="expected" type="org.opentest4j.AssertionFailedError">x</failure></testcase>
<testcase name="c" classname="ATest" time="0.1"><error message="m" type="java.lang.NullPointerException">y</error></testcase><testcase name="d" classname="ATest"/></testsuite>"""

LOG = """[INFO] Running org.a.ATest
\x1b[31m[ERROR]\x1b[0m /w/A.java:[10,5] cannot find symbol
[ERROR]   symbol:   class Foo
[ERROR]   location: class A
[ERROR] /w/A.java:[10,5] cannot find symbol
[ERROR] /w/B.java:[3,1] incompatible types: int cannot be converted to String
[ERROR] Re-run with the -X switch
[ERROR] B.testIt:42 expected: <1> but was: <2>
[ERROR] Tests run: 3, Failures: 1, Errors: 0
BUILD FAILURE
"""


def test_coverage_xml(spark, tmp_path):
    (tmp_path / "c.xml").write_text(COVERAGE)
    r = reports.coverage_xml(spark, str(tmp_path / "c.xml")).collect()[0]
    assert (r.lines_covered, r.lines_total, r.branches_covered, r.branches_total) == (7, 12, 1, 2)
    assert (r.methods_covered, r.methods_total) == (1, 3)
    assert r.covered_methods == ["f()V"] and r.uncovered_methods == ["f()V", "g(I)V", "h()I"]
    assert r.line_coverage == 58.33


def test_test_run_xml(spark, tmp_path):
    (tmp_path / "t.xml").write_text(SUITE)
    r = reports.test_run_xml(spark, str(tmp_path / "t.xml")).collect()[0]
    assert (r.total_tests, r.failed_tests, r.passed_tests, r.skipped_tests) == (4, 2, 1, 1)
    assert [(c.name, c.reason) for c in r.failed_cases] == [("b", "assertion"), ("c", "null pointer")]
    assert (r.failure_rate, r.success_rate, r.assertion_failure_rate, r.runtime_failure_rate) == (0.6667, 25.0, 50.0, 33.33)


def test_empty_suite(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<testsuite name="A" tests="0"></testsuite>')
    r = reports.test_run_xml(spark, str(tmp_path / "t.xml")).collect()[0]
    assert (r.total_tests, r.failure_rate, r.success_rate, r.failed) == (0, 0.0, 0.0, False)


def test_control_flow(spark, tmp_path):
    long = "x" * 60
    new = {"methods": [{"methodSignature": "<p.A: void m()>", "nodes": [{"id": 1, "statements": [long], "successors": [2]}, {"id": 2, "statements": ["return"], "successors": []}, {"id": 3, "statements": [], "successors": [1]}]}]}
    (tmp_path / "new.json").write_text(json.dumps(new))
    paths = sorted(r.path for r in reports.control_flow_paths(spark, str(tmp_path / "new.json")).collect())
    assert paths == [["<p.A: void m()>", f"node_1:{'x' * 50}...", "node_2"], ["<p.A: void m()>", "node_2:return"]]
    old = {"methods": {"<p.A: void m()>": {"blocks": {"B0": {"head": "if a"}, "B1": {"head": "b"}}, "edges": [{"from": "B0", "to": "B1"}, {"from": "B1", "to": "B9"}]}}}
    (tmp_path / "old.json").write_text(json.dumps(old))
    assert [r.path for r in reports.control_flow_paths(spark, str(tmp_path / "old.json")).collect()] == [["<p.A: void m()>", "B0:if a", "B1:b"]]


def test_states_and_reports(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"A": {"status": "active", "last_generation": 3, "fitness_history": [0.1, 0.2]}, "B": {"status": "terminated"}}))
    rows = {r.class_name: r for r in reports.class_states(spark, str(tmp_path / "s.json")).collect()}
    assert rows["A"].fitness_history == [0.1, 0.2] and rows["B"].last_generation is None
    for name, text in (("Gen2/a.json", '{"test_class": "ATest", "fitness": 0.5}'), ("Gen2/b.json", "{broken"), ("Gen3/c.json", "")):
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(text)
    out = reports.stored_reports(spark, f"{tmp_path}/r/*/*.json").collect()
    assert [(r.test_class, r.gen) for r in out] == [("ATest", 2)]


def test_catalogue_roots(spark, tmp_path):
    one = {"className": "A", "package": "p"}
    for i, root in enumerate([[one], {"classes": [{"class_name": "B"}]}, one, json.dumps([one])]):
        (tmp_path / f"{i}.json").write_text(json.dumps(root))
    assert sorted(r.className for r in reports.catalogue(spark, f"{tmp_path}/*.json").collect()) == ["A", "A", "A", "B"]


def test_build_log(spark):
    df = spark.createDataFrame([("r", LOG), ("ok", "BUILD SUCCESS"), ("none", "")], "run_id string, log string")
    status = {r.run_id: r.s for r in df.select("run_id", logs.status(F.col("log")).alias("s")).collect()}
    assert status == {"r": "test_failure", "ok": "success", "none": "failure"}
    e = logs.error_records(df).orderBy("line_no").collect()
    assert [(x.path, x.line, x.col, x.category) for x in e] == [("/w/A.java", 10, 5, "missing_class_or_package"), ("/w/B.java", 3, 1, "type_mismatch")]
    assert e[0].details == ["symbol:   class Foo", "location: class A"] and e[0].test_before == "org.a.ATest"
    assert logs.failed_methods(df).filter("run_id = 'r'").collect()[0].methods == ["testIt"]


def test_java_facts(spark):
    code = 'package p;\npublic class A {\n  // void no() {\n  public int f(Map<String, Integer> m, int n) {\n    g("}");\n    return m.size();\n  }\n  private void g(String s) { }\n}\n'
    assert len(blanked(code)) == len(code) and split_parameters("Map<A, B> m, int n") == ["Map<A, B> m", "int n"]
    rows = facts(code)
    assert [(r[2], r[3], r[5], r[6], r[7]) for r in rows if r[0] == "method"] == [("f", "public", 2, 4, 7), ("g", "private", 1, 8, 8)]
    assert [(r[2], r[4], r[9]) for r in rows if r[0] == "call"] == [("g", "f", None), ("size", "f", "m")]
    df = spark.createDataFrame([(1, code), (2, None), (3, ""), (4, "class {")], "id long, code string")
    assert {r.id for r in java_facts(df, "id", "code").collect()} == {1}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", 1, 0.5), ("B", 2, 0.6)], "test_class string, gen int, fitness double")
    path = str(tmp_path / "out")
    sinks.write_partitions(df, path, ["gen"])
    sinks.write_partitions(df.filter("gen = 1").withColumn("fitness", F.lit(0.9)), path, ["gen"])
    assert sorted((r.test_class, r.fitness) for r in spark.read.parquet(path).collect()) == [("A", 0.9), ("B", 0.6)]
    names = spark.createDataFrame([("A", "ATestV1")], "old string, new string")
    assert sorted(r.test_class for r in sinks.renamed(df, names, "test_class").collect()) == ["ATestV1", "B"]
    assert sorted(r.gen for r in sinks.next_generation(df).collect()) == [2, 3]
    merged = sinks.merged_states(df, spark.createDataFrame([("A", 1, 0.7), ("B", 1, 0.1)], df.schema), ["test_class"], "gen")
    assert sorted((r.test_class, r.fitness) for r in merged.collect()) == [("A", 0.7), ("B", 0.6)]
