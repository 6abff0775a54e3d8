"""Which paths reports cover: by the names of methods and the share of branches."""

from pyspark.sql import functions as F

from suitelens.plans.suites import covered_calls, path_verdicts

REPORTS = "report_id long, run_id long, project string, test_class string, target_class string, covered_methods array<string>, metrics struct<branches_covered:long,branches_total:long>, ingested_at timestamp_ntz"
CODE = "class A {\n  int load(int n) { return save(n) + save(1); }\n  int save(int n) { return n; }\n}\n"


def test_rule_on_paths(spark):
    r = spark.createDataFrame(
        [("half", ["loadAll(I)V"], 5, 10), ("more", ["loadAll(I)V"], 6, 10), ("none", ["loadAll(I)V"], 0, 0), ("other", ["save()V", None], 9, 10), ("null", None, None, None)],
        "c string, covered_methods array<string>, branches_covered long, branches_total long",
    )
    p = spark.createDataFrame([("<a.B: void load(int)>", False), ("<a.B: void load(int)>", True), ("load", False), ("bad signature", True), ("", True), (None, True)], "method string, is_exit boolean").crossJoin(r.select("c"))
    got = {(x.c, x.method, x.is_exit) for x in path_verdicts(p, r, ["c"]).filter("covered").collect()}
    sig = "<a.B: void load(int)>"
    assert got == {("half", sig, True), *((c, m, e) for c in ("more", "none") for m, e in ((sig, False), (sig, True), ("load", False)))}


def test_calls_of_files_meet_the_reports_of_their_class(spark, tmp_path):
    files = [(1, "p", "src/A.java", CODE), (2, "p", "src/B.java", CODE), (3, "q", "src/A.java", CODE), (4, "p", "A.py", CODE), (5, "p", "src/A.java", None)]
    spark.createDataFrame(files, "file_id long, project string, path string, code string").write.parquet(f"{tmp_path}/source_file.parquet")
    rows = [(1, 1, "p", "ATest", "A", ["save()V"], (6, 10)), (2, 1, "p", "ATest", "A", ["save()V"], (5, 10)), (3, 2, "p", "B", "A", ["load(I)I", "save(I)I"], (0, 0)), (4, 3, "p", "CTest", "C", ["save()V"], (1, 1))]
    spark.createDataFrame([(*x, None) for x in rows], REPORTS).withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/coverage_report.parquet")
    got = {tuple(x) for x in covered_calls(spark, str(tmp_path)).select("file_id", "report_id", "covered", "uncovered").collect()}
    assert got == {(1, 2, 1, 3), (1, 3, 4, 0), (2, 3, 4, 0)}
