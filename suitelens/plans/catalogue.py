"""Methods, signatures, names, dependencies and spans of a class catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from suitelens.functions import names, rules
from suitelens.plans.base import table
from suitelens.plans.references import test_class_name, test_file_name
from suitelens.sources import java_source

SQL = {}


def _methods(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as methods of the class that is their brand."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_brand").alias("class_name"), F.col("p_name").alias("method"), F.col("p_partkey").alias("method_id"), (F.col("p_size") % 6).alias("params"),
        F.col("p_size").alias("line_count"), (F.col("p_partkey") % 3 != 0).alias("is_public"), (F.col("p_size") % 7 == 0).alias("is_accessor"), F.col("p_type").alias("dependency"),
        F.element_at(F.array(*(F.lit(x) for x in RETURNED)), (F.col("p_partkey") % 4 + 1).cast("int")).alias("returned"),
    )


RETURNED = ["void", "int", "java.lang.String", "java.util.List"]  # results of the methods this table stands for
_METHODS_SQL = """methods AS (SELECT p_brand AS class_name, p_name AS method, p_partkey AS method_id, p_size % 6 AS params, p_size AS line_count,
  p_partkey % 3 <> 0 AS is_public, p_size % 7 = 0 AS is_accessor, p_type AS dependency,
  list_extract(['void', 'int', 'java.lang.String', 'java.util.List'], (p_partkey % 4 + 1)::INT) AS returned FROM part)"""


def method_priority(spark: SparkSession, sf: str) -> DataFrame:
    """Public methods that aren't accessors first, then by parameters, lines and name, all descending."""
    w = Window.partitionBy("class_name").orderBy(F.col("is_public").desc(), (~F.col("is_accessor")).desc(), F.col("params").desc(), F.col("line_count").desc(), F.col("method").desc(), "method_id")
    return _methods(spark, sf).select("class_name", "method_id", F.row_number().over(w).alias("priority"))


SQL["method_priority"] = f"""WITH {_METHODS_SQL} SELECT class_name, method_id, row_number() OVER (PARTITION BY class_name ORDER BY is_public DESC, (NOT is_accessor) DESC, params DESC, line_count DESC, method DESC, method_id) AS priority FROM methods"""

# The least and most tests a method of each complexity gets.
TESTS = {"SIMPLE": (1, 2), "CONDITIONAL": (2, 4), "EXCEPTION": (3, 5), "DEPENDENT": (2, 3)}


# What names of methods speak of, and types that depend on nothing.
EXCEPTIONAL = ["exception", "error", "throw", "catch", "try", "validate", "check", "assert"]
CONDITIONS = ["if", "is", "has", "should", "can", "contains", "equals", "compare", "validate", "verify"]
PRIMITIVES = ["void", "boolean", "int", "long", "float", "double", "char", "byte", "short"]
COMMON = ["equals", "hashcode", "tostring"]


def complexity(name: Column, accessor: Column, lines: Column, params: Column, returned: Column) -> Column:
    """SIMPLE, CONDITIONAL, EXCEPTION or DEPENDENT, by the first rule that fires: kind, length, parameters, result, name."""
    low = F.lower(name)
    return (
        F.when(accessor, "SIMPLE").when(name.startswith("new"), "DEPENDENT")
        .when(lines > 30, "EXCEPTION").when(lines > 15, "CONDITIONAL").when(lines > 5, "DEPENDENT").when(params > 3, "CONDITIONAL")
        .when((returned != "") & ~returned.isin(PRIMITIVES) & ~returned.startswith("java.lang."), "DEPENDENT")
        .when(rules.contains_any(low, EXCEPTIONAL), "EXCEPTION").when(rules.contains_any(low, CONDITIONS), "CONDITIONAL")
        .when(low.rlike("^(get|is|has|set).") & (F.length(low) > 3) | low.isin(COMMON), "SIMPLE").otherwise("CONDITIONAL")
    )


def method_complexity(spark: SparkSession, sf: str) -> DataFrame:
    """How many tests the methods of a class should get, by the first rule that says how complex each is."""
    c = complexity(F.col("method"), F.col("is_accessor"), F.col("line_count"), F.col("params"), F.col("returned"))
    look = lambda i: F.create_map(*(F.lit(x) for k, v in TESTS.items() for x in (k, v[i])))[F.col("complexity")]
    m = _methods(spark, sf).withColumn("complexity", c).withColumns({"low": look(0), "high": look(1)})
    return m.groupBy("class_name", "complexity").agg(F.count(F.lit(1)).alias("methods"), F.sum("low").alias("least_tests"), F.sum("high").alias("most_tests"))


SQL["method_complexity"] = f"""WITH {_METHODS_SQL}, c AS (SELECT *, CASE WHEN is_accessor THEN 'SIMPLE' WHEN starts_with(method, 'new') THEN 'DEPENDENT' WHEN line_count > 30 THEN 'EXCEPTION' WHEN line_count > 15 THEN 'CONDITIONAL'
  WHEN line_count > 5 THEN 'DEPENDENT' WHEN params > 3 THEN 'CONDITIONAL' WHEN returned <> '' AND NOT list_contains([{', '.join(map(rules.quoted, PRIMITIVES))}], returned) AND NOT starts_with(returned, 'java.lang.') THEN 'DEPENDENT'
  WHEN regexp_matches(lower(method), '{'|'.join(EXCEPTIONAL)}') THEN 'EXCEPTION' WHEN regexp_matches(lower(method), '{'|'.join(CONDITIONS)}') THEN 'CONDITIONAL'
  WHEN regexp_matches(lower(method), '^(get|is|has|set).') AND length(method) > 3 OR lower(method) IN ('equals', 'hashcode', 'tostring') THEN 'SIMPLE' ELSE 'CONDITIONAL' END AS complexity FROM methods)
SELECT class_name, complexity, count(*) AS methods, sum(CASE complexity WHEN 'SIMPLE' THEN 1 WHEN 'CONDITIONAL' THEN 2 WHEN 'EXCEPTION' THEN 3 ELSE 2 END) AS least_tests,
  sum(CASE complexity WHEN 'SIMPLE' THEN 2 WHEN 'CONDITIONAL' THEN 4 WHEN 'EXCEPTION' THEN 5 ELSE 3 END) AS most_tests FROM c GROUP BY 1, 2"""


def catalogue_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a class is worth tests: complex methods, enough long ones, few accessors, and something it depends on."""
    m = _methods(spark, sf).groupBy("class_name").agg(
        F.count_if(F.col("line_count") >= 8).alias("complex"), F.count_if(F.col("line_count") >= 3).alias("long"), F.round(F.avg(F.col("is_accessor").cast("int")), 4).alias("accessor_share"), F.countDistinct("dependency").alias("dependencies")
    )
    ok = (F.col("complex") >= 2) & (F.col("long") >= 3) & (F.col("accessor_share") <= 0.5) & (F.col("dependencies") > 0) & ~F.col("class_name").rlike("Test$")
    return m.withColumn("valid", ok)


SQL["catalogue_validity"] = f"""WITH {_METHODS_SQL}, m AS (SELECT class_name, count(*) FILTER (WHERE line_count >= 8) AS complex, count(*) FILTER (WHERE line_count >= 3) AS long, round(avg(is_accessor::INT), 4) AS accessor_share, count(DISTINCT dependency) AS dependencies FROM methods GROUP BY 1)
SELECT *, complex >= 2 AND long >= 3 AND accessor_share <= 0.5 AND dependencies > 0 AND NOT regexp_matches(class_name, 'Test$') AS valid FROM m"""


def dependency_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Per class one column of each kind of dependency, with how many methods have it and the first of them."""
    kinds = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    m = _methods(spark, sf).withColumn("kind", F.upper(F.regexp_extract("dependency", "^([A-Za-z]+)", 1)))
    p = m.groupBy("class_name").pivot("kind", kinds).agg(F.count(F.lit(1)).alias("n"), F.min("method").alias("first"))
    cols = [F.coalesce(f"{k}_n", F.lit(0)).alias(f"{k.lower()}_n") for k in kinds] + [F.coalesce(f"{k}_first", F.lit("None")).alias(f"{k.lower()}_first") for k in kinds]
    return p.select("class_name", *cols)


_KINDS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
SQL["dependency_pivot"] = f"""WITH {_METHODS_SQL}, k AS (SELECT *, upper(regexp_extract(dependency, '^([A-Za-z]+)', 1)) AS kind FROM methods)
SELECT class_name, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS {k.lower()}_n, coalesce(min(method) FILTER (WHERE kind = '{k}'), 'None') AS {k.lower()}_first" for k in _KINDS)} FROM k GROUP BY 1"""


def name_parsing(spark: SparkSession, sf: str) -> DataFrame:
    """What the name in each report says: class by three ways, kind, version, generation and parents."""
    n = test_class_name(F.col("test_class"))
    r = table(spark, sf, "coverage_report").filter("test_class IS NOT NULL").select(n.alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("reports"))
    i, j = names.pair(F.col("n"))
    c = F.col("n")
    return r.select(
        c.alias("name"), "reports", names.class_under_test(c).alias("by_form"), names.class_before_test(c).alias("by_first"), names.class_without_test(c).alias("by_removal"),
        names.kind(c).alias("kind"), names.version(c).alias("version"), names.generation(c).alias("made_in"), i.alias("parent_low"), j.alias("parent_high"),
    )


_NAME = r"regexp_replace(regexp_replace(regexp_replace(test_class, '^\s+|\s+$', '', 'g'), '\.(java|class)$', ''), '(?s)^.*[./]', '')"
SQL["name_parsing"] = rf"""WITH n AS (SELECT {_NAME} AS n, count(*) AS reports FROM coverage_report WHERE test_class IS NOT NULL GROUP BY 1),
p AS (SELECT *, try_cast(nullif(regexp_extract(n, '_([0-9]+)x[0-9]+$', 1), '') AS INT) AS x, try_cast(nullif(regexp_extract(n, '_[0-9]+x([0-9]+)$', 1), '') AS INT) AS y FROM n)
SELECT n AS name, reports, nullif(regexp_extract(n, '^([A-Za-z0-9_]+?)Test(?:V[0-9]+|_Crossover_Gen[0-9]+_[0-9]+x[0-9]+|_Mutation_Gen[0-9]+_V[0-9]+)?$', 1), '') AS by_form,
  nullif(regexp_extract(n, '^([A-Za-z0-9_]+?)Test', 1), '') AS by_first, replace(n, 'Test', '') AS by_removal,
  CASE WHEN contains(n, '_Crossover_') THEN 'crossover' WHEN contains(n, '_Mutation_') THEN 'mutation' WHEN regexp_matches(n, 'TestV[0-9]+$') THEN 'base' ELSE 'other' END AS kind,
  try_cast(nullif(regexp_extract(n, 'V([0-9]+)$', 1), '') AS INT) AS version, try_cast(nullif(regexp_extract(n, '_Gen([0-9]+)_', 1), '') AS INT) AS made_in, least(x, y) AS parent_low, greatest(x, y) AS parent_high FROM p"""


def signature_types(spark: SparkSession, sf: str) -> DataFrame:
    """How often covered signatures take and return each type, taken apart from their descriptors."""
    s = table(spark, sf, "coverage_report").select(F.explode("covered_methods").alias("s")).filter("s IS NOT NULL").groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    takes = s.select(F.explode(names.parameter_types(F.col("s"))).alias("d"), "n", F.lit("takes").alias("role"))
    gives = s.select(names.return_type(F.col("s")).alias("d"), "n", F.lit("returns").alias("role"))
    return takes.unionAll(gives).groupBy("role", names.readable_type(F.col("d")).alias("type")).agg(F.sum("n").alias("n"))


_TYPE_SQL = r"""concat(CASE WHEN starts_with(ltrim(d, '['), 'L') THEN regexp_replace(regexp_replace(ltrim(d, '['), '^L(?:.*/)?', ''), ';$', '')
  ELSE CASE ltrim(d, '[') WHEN 'B' THEN 'byte' WHEN 'C' THEN 'char' WHEN 'D' THEN 'double' WHEN 'F' THEN 'float' WHEN 'I' THEN 'int' WHEN 'J' THEN 'long' WHEN 'S' THEN 'short' WHEN 'Z' THEN 'boolean' WHEN 'V' THEN 'void' END END,
  repeat('[]', length(d) - length(ltrim(d, '['))))"""
SQL["signature_types"] = rf"""WITH e AS (SELECT unnest(covered_methods) AS s FROM coverage_report), c AS (SELECT s, count(*) AS n FROM e WHERE s IS NOT NULL GROUP BY 1),
t AS (SELECT 'takes' AS role, unnest(regexp_extract_all(regexp_extract(s, '\(([^)]*)\)', 1), '(\[*(?:L[^;]+;|[BCDFIJSZ]))', 1)) AS d, n FROM c UNION ALL SELECT 'returns', regexp_extract(s, '\)([^)]*)$', 1), n FROM c)
SELECT role, {_TYPE_SQL} AS type, sum(n) AS n FROM t GROUP BY 1, 2"""


def mode_with_ties(spark: SparkSession, sf: str) -> DataFrame:
    """The value that occurs most per group; of equally frequent ones the one seen first."""
    n = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_quantity").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("l_orderkey", "l_linenumber")).alias("first"))
    by = n.groupBy("l_suppkey").agg(F.max("n").alias("n"), F.min_by("l_quantity", F.struct(-F.col("n"), F.col("first"), F.col("l_quantity"))).alias("mode"))
    return by.select("l_suppkey", "mode", "n")


SQL["mode_with_ties"] = """WITH n AS (SELECT l_suppkey, l_quantity, count(*) AS n, min((l_orderkey, l_linenumber)) AS first FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, first, l_quantity) AS i FROM n) SELECT l_suppkey, l_quantity AS mode, n FROM r WHERE i = 1"""


def keyword_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """How relevant each file is to the words of container purposes: 1 for a name hit, 2 for a hit in the code."""
    words = table(spark, sf, "container_spec").select(F.explode(F.split(F.lower("purpose"), "[^a-z]+")).alias("w")).filter("length(w) > 3").distinct()
    f = table(spark, sf, "source_file").select("file_id", F.lower("path").alias("p"), F.lower(F.coalesce("code", F.lit(""))).alias("c"))
    x = f.crossJoin(F.broadcast(words))  # a few words
    hit = lambda c: F.when(F.contains(F.col(c), F.col("w")), 1).otherwise(0)
    return x.groupBy("file_id").agg(F.sum(hit("p") + hit("c") * 2).alias("relevance"))


SQL["keyword_relevance"] = """WITH w AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(lower(purpose), '[^a-z]+')) AS w FROM container_spec) WHERE length(w) > 3)
SELECT file_id, sum(CASE WHEN contains(lower(path), w) THEN 1 ELSE 0 END + CASE WHEN contains(lower(coalesce(code, '')), w) THEN 2 ELSE 0 END) AS relevance FROM source_file, w GROUP BY 1"""


def interval_owner(spark: SparkSession, sf: str) -> DataFrame:
    """The call during which each file was last being made: files inside the span of calls of their own."""
    calls = table(spark, sf, "llm_call_stats").filter("test_file_id IS NOT NULL AND start_time IS NOT NULL AND end_time IS NOT NULL").select("test_file_id", "call_id", F.col("start_time").alias("s"), F.col("end_time").alias("e"))
    files = table(spark, sf, "test_file_stats").filter("start_time IS NOT NULL").select("test_file_id", (F.col("start_time") + 1).alias("t"))
    inside = files.join(calls, "test_file_id").withColumn("far", F.when(F.col("t").between(F.col("s"), F.col("e")), 0.0).otherwise(F.least(F.abs(F.col("t") - F.col("s")), F.abs(F.col("t") - F.col("e")))))
    return inside.groupBy("test_file_id").agg(F.min_by("call_id", F.struct("far", "call_id")).alias("call_id"), F.round(F.min("far"), 3).alias("distance"))


SQL["interval_owner"] = """WITH x AS (SELECT f.test_file_id, c.call_id, CASE WHEN f.start_time + 1 BETWEEN c.start_time AND c.end_time THEN 0.0 ELSE least(abs(f.start_time + 1 - c.start_time), abs(f.start_time + 1 - c.end_time)) END AS far
  FROM test_file_stats f JOIN llm_call_stats c USING (test_file_id) WHERE f.start_time IS NOT NULL AND c.start_time IS NOT NULL AND c.end_time IS NOT NULL)
SELECT test_file_id, arg_min(call_id, (far, call_id)) AS call_id, round(min(far), 3) AS distance FROM x GROUP BY 1"""


def substring_theta_join(spark: SparkSession, sf: str) -> DataFrame:
    """Nations whose name, or the beginning of it, stands in a part's name or type."""
    n = table(spark, sf, "nation").select("n_name", F.lower(F.substring("n_name", 1, 3)).alias("k"))
    p = table(spark, sf, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("t"))
    return p.join(F.broadcast(n), F.contains("t", "k")).groupBy("n_name").agg(F.count(F.lit(1)).alias("parts"), F.min("p_partkey").alias("first_part"))  # 25 nations


SQL["substring_theta_join"] = "SELECT n_name, count(*) AS parts, min(p_partkey) AS first_part FROM part JOIN nation ON contains(lower(concat_ws(' ', p_name, p_type)), lower(substr(n_name, 1, 3))) GROUP BY 1"


def idempotent_skip(spark: SparkSession, sf: str) -> DataFrame:
    """Classes with reports but no registered test file of their project: what is still to be generated."""
    r = table(spark, sf, "coverage_report").filter("target_class IS NOT NULL AND project IS NOT NULL").groupBy("project", "target_class").agg(F.count(F.lit(1)).alias("reports"))
    done = table(spark, sf, "test_file_stats").select("project", F.col("class_name").alias("target_class")).distinct()
    return r.join(done, ["project", "target_class"], "left_anti")


SQL["idempotent_skip"] = """SELECT project, target_class, count(*) AS reports FROM coverage_report r WHERE target_class IS NOT NULL AND project IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM test_file_stats t WHERE t.project = r.project AND t.class_name = r.target_class) GROUP BY 1, 2"""


def latest_source(spark: SparkSession, sf: str) -> DataFrame:
    """One file per project and class name, from tests before main before the rest, the longest path last."""
    f = table(spark, sf, "source_file").filter("path IS NOT NULL")
    root = F.when(F.contains("path", F.lit("/src/test/")), 1).when(F.contains("path", F.lit("evolution_process")), 2).otherwise(3)
    by = f.groupBy("project", test_file_name(F.col("path")).alias("name"))
    return by.agg(F.count(F.lit(1)).alias("versions"), F.min_by("file_id", F.struct(root, F.length("path"), F.col("path"), F.col("file_id"))).alias("file_id"))


SQL["latest_source"] = r"""SELECT project, regexp_replace(regexp_replace(path, '(?s)^.*[/\\]', ''), '(?s)\..*$', '') AS name, count(*) AS versions,
  arg_min(file_id, (CASE WHEN contains(path, '/src/test/') THEN 1 WHEN contains(path, 'evolution_process') THEN 2 ELSE 3 END, length(path), path, file_id)) AS file_id
FROM source_file WHERE path IS NOT NULL GROUP BY 1, 2"""

FOCUS = ["normal", "boundary", "null", "exception", "state", "collection", "concurrency", "performance", "integration", "regression"]


def round_robin_focus(spark: SparkSession, sf: str) -> DataFrame:
    """What the tests of each suite are to look at, in turn over ten foci."""
    focus = F.element_at(F.array(*(F.lit(x) for x in FOCUS)), F.pmod(F.col("suite_index") - 1, F.lit(10)) + 1)
    return table(spark, sf, "test_file_stats").filter("suite_index IS NOT NULL").groupBy(focus.alias("focus")).agg(F.count(F.lit(1)).alias("files"), F.count_if("final_success").alias("successes"))


SQL["round_robin_focus"] = f"SELECT list_extract([{', '.join(rules.quoted(x) for x in FOCUS)}], (((suite_index - 1) % 10 + 10) % 10 + 1)::INT) AS focus, count(*) AS files, count(*) FILTER (WHERE final_success) AS successes FROM test_file_stats WHERE suite_index IS NOT NULL GROUP BY 1"


# What a report must have to be complete. Paths are not in the table; their key stands in every report read from files.
REQUIRED = ["metrics", "covered_methods", "uncovered_methods", "fitness"]
REQUIRED_METRICS = ["line_coverage", "branch_coverage", "method_coverage"]


def lacking_fields(fields: list[str], metrics: list[str]) -> Column:
    """The names of the required fields that are null, joined by commas; those of metrics only if there are metrics."""
    tests = [F.when(F.col(f).isNull(), F.lit(f)) for f in fields]
    tests += [F.when(F.col("metrics").isNotNull() & F.col(f"metrics.{m}").isNull(), F.lit(m)) for m in metrics]
    return F.array_join(F.array_compact(F.array(*tests)), ",")


def incomplete_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports that lack a field which completeness asks for, with the fields."""
    reports = table(spark, sf, "coverage_report")
    return reports.select("report_id", lacking_fields(REQUIRED, REQUIRED_METRICS).alias("lacking")).filter("lacking <> ''")


SQL["incomplete_reports"] = """WITH x AS (SELECT report_id, concat_ws(',', CASE WHEN metrics IS NULL THEN 'metrics' END, CASE WHEN covered_methods IS NULL THEN 'covered_methods' END,
  CASE WHEN uncovered_methods IS NULL THEN 'uncovered_methods' END, CASE WHEN fitness IS NULL THEN 'fitness' END, CASE WHEN metrics IS NOT NULL AND metrics.line_coverage IS NULL THEN 'line_coverage' END,
  CASE WHEN metrics IS NOT NULL AND metrics.branch_coverage IS NULL THEN 'branch_coverage' END, CASE WHEN metrics IS NOT NULL AND metrics.method_coverage IS NULL THEN 'method_coverage' END) AS lacking FROM coverage_report)
SELECT * FROM x WHERE lacking <> ''"""


def next_version(spark: SparkSession, sf: str) -> DataFrame:
    """Per class one more than the highest version any name has, by either form."""
    n = test_class_name(F.col("test_class"))
    r = table(spark, sf, "coverage_report").filter("target_class IS NOT NULL AND test_class IS NOT NULL")
    return r.groupBy("target_class").agg((F.coalesce(F.max(names.version(n)), F.lit(0)) + 1).alias("next_version"))


SQL["next_version"] = rf"SELECT target_class, coalesce(max(try_cast(nullif(regexp_extract({_NAME}, 'V([0-9]+)$', 1), '') AS INT)), 0) + 1 AS next_version FROM coverage_report WHERE target_class IS NOT NULL AND test_class IS NOT NULL GROUP BY 1"


def java_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Types, methods and calls of all Java files, by a scanner that SQL has no counterpart of."""
    files = table(spark, sf, "source_file").filter("path LIKE '%.java'")
    return java_source.java_facts(files, "file_id", "code")


QUERIES = {name: globals()[name] for name in [*SQL, "java_facts"]}
