"""Coverage and test-run XML, control-flow and state JSON, stored reports, as typed frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from suitelens import schemas
from suitelens.functions import rules, scoring

# Reasons by what the exception's type holds, the first that matches.
FAILURE_TYPES = [("assertion", ["AssertionFailedError", "AssertionError"]), ("comparison", ["ComparisonFailure"]), ("mock", ["MockitoException"]), ("null pointer", ["NullPointerException"]), ("illegal argument", ["IllegalArgumentException"]), ("class cast", ["ClassCastException"])]


def _file() -> Column:
    return F.col("_metadata.file_path").alias("file")


def coverage_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: counters summed over its classes, percentages, and covered and uncovered methods.

    A method counts by its METHOD counter, else by INSTRUCTION; without either it is uncovered and in no total. The
    same signature may be covered in one class and not in another, and is then in both lists. Missing counters are 0.
    """
    classes = spark.read.format("xml").option("rowTag", "class").schema(schemas.COVERAGE_CLASS).load(path).select("*", _file())
    of = lambda c, kind: F.filter(c, lambda x: x["_type"] == kind)
    total = lambda kind, part: F.aggregate(F.coalesce(of(F.col("counter"), kind), F.expr("array()")), F.lit(0).cast("long"), lambda a, x: a + x[part])

    def state(m: Column) -> Column:
        own = F.coalesce(m["counter"], F.expr("array()"))
        by_method, by_instruction = of(own, "METHOD"), of(own, "INSTRUCTION")
        chosen = F.when(F.size(by_method) > 0, by_method).otherwise(by_instruction)
        return F.struct(F.concat(m["_name"], m["_desc"]).alias("s"), (F.size(chosen) > 0).alias("counts"), F.exists(chosen, lambda x: x["_covered"] > 0).alias("yes"))

    methods = F.transform(F.coalesce("method", F.expr("array()")), state)
    per_class = classes.select(
        "file", methods.alias("m"), total("LINE", "_covered").alias("lc"), total("LINE", "_missed").alias("lm"), total("BRANCH", "_covered").alias("bc"), total("BRANCH", "_missed").alias("bm")
    )
    names = lambda yes: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(F.filter("m", lambda x: x["yes"] == yes), lambda x: x["s"])))))
    n = per_class.groupBy("file").agg(
        F.sum("lc").alias("lines_covered"), F.sum(F.col("lc") + F.col("lm")).alias("lines_total"), F.sum("bc").alias("branches_covered"), F.sum(F.col("bc") + F.col("bm")).alias("branches_total"),
        F.sum(F.size(F.filter("m", lambda x: x["counts"] & x["yes"]))).alias("methods_covered"), F.sum(F.size(F.filter("m", lambda x: x["counts"]))).alias("methods_total"),
        names(F.lit(True)).alias("covered_methods"), names(F.lit(False)).alias("uncovered_methods"),
    )
    for one, many in (("line", "lines"), ("branch", "branches"), ("method", "methods")):
        n = n.withColumn(f"{one}_coverage", scoring.percent(F.col(f"{many}_covered"), F.col(f"{many}_total")))
    return n


def test_run_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per suite: counts, rates and its failed cases; ``failure`` is taken before ``error``.

    ``failure_rate`` is a fraction, the other rates are percent; assertion counts only assertions and comparisons.
    """
    s = spark.read.format("xml").option("rowTag", "testsuite").schema(schemas.TEST_SUITE).load(path).select("*", _file())
    case = lambda c: F.struct(
        c["_name"].alias("name"), c["_classname"].alias("class"), c["_time"].alias("time"), F.coalesce(c["failure"]["_type"], c["error"]["_type"]).alias("type"),
        F.coalesce(c["failure"]["_message"], c["error"]["_message"]).alias("message"), (c["failure"].isNotNull() | c["error"].isNotNull()).alias("failed"),
    )
    cases = F.filter(F.transform(F.coalesce("testcase", F.expr("array()")), case), lambda c: c["failed"])
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    d = s.select("file", F.col("_name").alias("suite"), number("_tests").alias("total_tests"), (number("_failures") + number("_errors")).alias("failed_tests"), number("_skipped").alias("skipped_tests"), F.coalesce("_time", F.lit(0.0)).alias("time_seconds"), cases.alias("cases"))
    reason = lambda c: failure_reason(c["type"])
    d = d.withColumn("failed_cases", F.transform("cases", lambda c: F.struct(c["name"].alias("name"), c["class"].alias("class"), c["type"].alias("type"), c["message"].alias("message"), reason(c).alias("reason")))).drop("cases")
    asserted = F.size(F.filter("failed_cases", lambda c: c["reason"].isin("assertion", "comparison")))
    d = d.withColumn("assertion_failed", asserted).withColumn("runtime_failed", F.size("failed_cases") - asserted)
    ran = F.col("total_tests") - F.col("skipped_tests")
    rate = lambda a, b, factor, places: F.round(F.coalesce(F.try_divide(a * factor, b), F.lit(0.0)), places)
    return d.withColumn("passed_tests", F.greatest(ran - F.col("failed_tests"), F.lit(0))).withColumns({
        "failure_rate": rate(F.col("failed_tests"), ran, 1.0, 4), "success_rate": rate(F.col("passed_tests"), F.col("total_tests"), 100.0, 2),
        "assertion_failure_rate": rate(F.col("assertion_failed"), ran - F.col("runtime_failed"), 100.0, 2), "runtime_failure_rate": rate(F.col("runtime_failed"), ran, 100.0, 2),
        "failed": F.col("failed_tests") > 0,
    })


def failure_reason(kind: Column) -> Column:
    text = F.coalesce(kind, F.lit(""))
    return F.when(text == "", "unknown").otherwise(F.coalesce(F.nullif(rules.first_match(text, FAILURE_TYPES, ""), F.lit("")), F.concat(F.lit("exception: "), text)))


def control_flow_paths(spark: SparkSession, path: str) -> DataFrame:
    """(file, method, path): one path per step from a node; an exit has a path of two. Labels hold 50 signs of a statement.

    Both formats are read: lists of nodes with successors, and maps of blocks with edges, whose loose ends are dropped.
    Nodes without statements are left out.
    """
    text = spark.read.option("wholetext", True).text(path).select("value", _file())
    label = lambda i, s: F.concat(F.lit("node_"), i.cast("string"), F.lit(":"), F.when(F.length(s) > 50, F.concat(F.substring(s, 1, 50), F.lit("..."))).otherwise(s))
    new = text.select("file", F.explode(F.from_json("value", schemas.CONTROL_FLOW)["methods"]).alias("m")).filter("m.nodes IS NOT NULL")
    nodes = new.select("file", F.col("m.methodSignature").alias("method"), F.explode("m.nodes").alias("n")).filter("size(n.statements) > 0")
    steps = nodes.select("file", "method", label(F.col("n.id"), F.col("n.statements")[0]).alias("at"), F.explode_outer("n.successors").alias("to"))
    step = F.when(F.col("to").isNull(), F.array("method", "at")).otherwise(F.array(F.col("method"), F.col("at"), F.concat(F.lit("node_"), F.col("to").cast("string"))))
    old = text.select("file", F.explode(F.from_json("value", schemas.CONTROL_FLOW_OLD)["methods"]).alias("method", "m"))
    edges = old.select("file", "method", F.col("m.blocks").alias("b"), F.explode("m.edges").alias("e")).filter("b[e.`from`] IS NOT NULL AND b[e.`to`] IS NOT NULL")
    hop = F.array(F.col("method"), F.concat(F.col("e.from"), F.lit(":"), F.substring(F.expr("b[e.`from`].head"), 1, 50)), F.concat(F.col("e.to"), F.lit(":"), F.substring(F.expr("b[e.`to`].head"), 1, 50)))
    return steps.select("file", "method", step.alias("path")).unionAll(edges.select("file", "method", hop.alias("path")))


def class_states(spark: SparkSession, path: str) -> DataFrame:
    """States of classes, one row each; files that don't hold a map give no rows."""
    text = spark.read.option("wholetext", True).text(path).select("value", _file())
    return text.select("file", F.explode(F.from_json("value", schemas.CLASS_STATE)).alias("class_name", "s")).select("file", "class_name", "s.*")


def stored_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports stored as JSON, with generation and suite from the path; what can't be read is left out."""
    r = spark.read.schema(schemas.REPORT).option("multiLine", True).option("mode", "PERMISSIVE").json(path).select("*", _file())
    fine = r.filter("_corrupt_record IS NULL AND (test_class IS NOT NULL OR target_class IS NOT NULL OR fitness IS NOT NULL)").drop("_corrupt_record")
    return fine.withColumn("gen", F.nullif(F.regexp_extract("file", r"/Gen([0-9]+)/", 1), F.lit("")).cast("int"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Classes of a catalogue, whatever its root: a list, an object with ``classes``, one class, or any of these as a string."""
    text = spark.read.option("wholetext", True).text(path).select(F.trim("value").alias("v"), _file())
    inner = F.when(F.col("v").startswith('"'), F.from_json(F.concat(F.lit('{"s":'), F.col("v"), F.lit("}")), "s string")["s"]).otherwise(F.col("v"))
    row = schemas.CATALOGUE_ROW
    t = text.select("file", F.trim(inner).alias("v"))
    many = F.when(F.col("v").startswith("["), F.from_json("v", f"array<{row}>")).otherwise(
        F.coalesce(F.from_json("v", f"classes array<{row}>")["classes"], F.array(F.from_json("v", row)))
    )
    return t.select("file", F.posexplode(many).alias("pos", "c")).select("file", "pos", "c.*").withColumn("className", F.coalesce("className", "class_name")).drop("class_name").filter("className IS NOT NULL")
