"""Candidates, look-ups and texts of suites: joins of generations, tests inside sources, what descriptors speak of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from suitelens.functions import names, rules
from suitelens.plans.base import NEWEST_SQL, newest_reports, table
from suitelens.plans.references import test_class_name, test_file_name
from suitelens.sources.java_source import java_facts

SQL = {}


def counter_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of each kind of counter over a class and its inner ones; kinds that don't occur give 0."""
    kinds = spark.createDataFrame([(k,) for k in ("LINE", "BRANCH", "METHOD", "CLASS")], "kind string")  # a fixed list
    m = newest_reports(spark, sf, "target_class", "metrics.lines_covered", "metrics.lines_total", "metrics.branches_covered", "metrics.branches_total", "metrics.methods_covered", "metrics.methods_total")
    each = m.filter("target_class IS NOT NULL").select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{p}_covered").alias("c"), F.col(f"{p}_total").alias("t")) for k, p in (("LINE", "lines"), ("BRANCH", "branches"), ("METHOD", "methods"))))).alias("x"))
    sums = each.groupBy(F.col("x.kind").alias("kind")).agg(F.sum("x.c").alias("covered"), F.sum("x.t").alias("total"))
    return kinds.join(sums, "kind", "left").select("kind", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("covered", "total")))


SQL["counter_totals"] = f"""WITH {NEWEST_SQL}, n AS (SELECT metrics AS m FROM newest WHERE target_class IS NOT NULL),
s AS (SELECT 'LINE' AS kind, sum(m.lines_covered) AS covered, sum(m.lines_total) AS total FROM n UNION ALL SELECT 'BRANCH', sum(m.branches_covered), sum(m.branches_total) FROM n
  UNION ALL SELECT 'METHOD', sum(m.methods_covered), sum(m.methods_total) FROM n UNION ALL SELECT 'CLASS', 0, 0) SELECT kind, coalesce(covered, 0) AS covered, coalesce(total, 0) AS total FROM s"""


def candidate_suites(spark: SparkSession, sf: str) -> DataFrame:
    """For each class and generation: base suites of the generation before and offspring of this one, whose file is registered.

    A name in both counts once, as offspring.
    """
    n = test_class_name(F.col("test_class"))
    r = newest_reports(spark, sf, "project", "target_class", "gen", "test_class").filter("project IS NOT NULL AND target_class IS NOT NULL AND gen IS NOT NULL")
    r = r.withColumn("test", n).filter("test IS NOT NULL").withColumn("kind", names.kind(F.col("test")))
    old = r.filter("kind = 'base'").select("project", "target_class", (F.col("gen") + 1).alias("gen"), "test", F.lit(0).alias("offspring"))
    new = r.filter("kind IN ('crossover', 'mutation')").select("project", "target_class", "gen", "test", F.lit(1).alias("offspring"))
    both = old.unionByName(new).groupBy("project", "target_class", "gen", "test").agg(F.max("offspring").alias("offspring"))
    files = table(spark, sf, "test_file_stats").select("project", test_file_name(F.col("test_file_path")).alias("test"))
    return both.join(files, ["project", "test"], "left_semi").groupBy("project", "target_class", "gen").agg(F.count(F.lit(1)).alias("candidates"), F.sum("offspring").alias("offspring"))


_NAME = r"regexp_replace(regexp_replace(regexp_replace(test_class, '^\s+|\s+$', '', 'g'), '\.(java|class)$', ''), '(?s)^.*[./]', '')"
SQL["candidate_suites"] = rf"""WITH {NEWEST_SQL}, n AS (SELECT project, target_class, gen, {_NAME} AS test FROM newest WHERE project IS NOT NULL AND target_class IS NOT NULL AND gen IS NOT NULL AND test_class IS NOT NULL),
k AS (SELECT *, CASE WHEN contains(test, '_Crossover_') OR contains(test, '_Mutation_') THEN 1 WHEN regexp_matches(test, 'TestV[0-9]+$') THEN 0 END AS o FROM n),
b AS (SELECT project, target_class, gen, test, max(o) AS offspring FROM (SELECT project, target_class, gen + 1 AS gen, test, 0 AS o FROM k WHERE o = 0 UNION ALL SELECT project, target_class, gen, test, 1 FROM k WHERE o = 1) GROUP BY 1, 2, 3, 4),
f AS (SELECT DISTINCT project, regexp_replace(regexp_replace(test_file_path, '(?s)^.*[/\\]', ''), '(?s)\..*$', '') AS test FROM test_file_stats)
SELECT target_class, gen, b.project, count(*) AS candidates, sum(offspring) AS offspring FROM b WHERE EXISTS (SELECT 1 FROM f WHERE f.project = b.project AND f.test = b.test) GROUP BY 1, 2, 3"""


def fuzzy_class_match(spark: SparkSession, sf: str) -> DataFrame:
    """Each class of test files against known classes of its project: the same name, else without its version, else none."""
    f = table(spark, sf, "test_file_stats").filter("project IS NOT NULL AND class_name IS NOT NULL").select("project", "class_name").distinct()
    k = table(spark, sf, "class_state").filter("project IS NOT NULL AND class_name IS NOT NULL").select("project", F.col("class_name").alias("known")).distinct()
    tries = f.select("project", "class_name", F.posexplode(F.array(F.col("class_name"), F.trim("class_name"), F.regexp_replace("class_name", "V[0-9]+$", ""), F.regexp_replace("class_name", "Test.*$", ""))).alias("way", "name"))
    hit = tries.join(k, (tries.project == k.project) & (tries.name == k.known), "left").select(tries.project, "class_name", "way", "known")
    return hit.groupBy("project", "class_name").agg(F.min(F.when(F.col("known").isNotNull(), F.struct("way", "known"))).alias("_b")).select("project", "class_name", F.col("_b.known").alias("known"), F.col("_b.way").alias("way"))


SQL["fuzzy_class_match"] = """WITH f AS (SELECT DISTINCT project, class_name FROM test_file_stats WHERE project IS NOT NULL AND class_name IS NOT NULL), k AS (SELECT DISTINCT project, class_name AS known FROM class_state WHERE class_name IS NOT NULL),
t AS (SELECT project, class_name, 0 AS way, class_name AS name FROM f UNION ALL SELECT project, class_name, 1, trim(class_name) FROM f UNION ALL SELECT project, class_name, 2, regexp_replace(class_name, 'V[0-9]+$', '') FROM f UNION ALL SELECT project, class_name, 3, regexp_replace(class_name, 'Test.*$', '') FROM f)
SELECT t.project, t.class_name, arg_min(k.known, t.way) FILTER (WHERE k.known IS NOT NULL) AS known, min(t.way) FILTER (WHERE k.known IS NOT NULL) AS way FROM t LEFT JOIN k ON k.project = t.project AND k.known = t.name GROUP BY 1, 2"""


def contiguous_best(spark: SparkSession, sf: str) -> DataFrame:
    """The best report of each class over its generations from the first on, up to the first that is missing."""
    r = newest_reports(spark, sf, "project", "target_class", "gen", "fitness").filter("project IS NOT NULL AND target_class IS NOT NULL AND gen >= 1 AND fitness IS NOT NULL AND NOT isnan(fitness)")
    best = r.groupBy("project", "target_class", "gen").agg(F.max(F.struct("fitness", "report_id")).alias("b"))
    w = Window.partitionBy("project", "target_class").orderBy("gen")
    run = best.withColumn("n", F.row_number().over(w)).filter("n = gen")
    return run.groupBy("project", "target_class").agg(F.max("gen").alias("generations"), F.max("b").alias("b")).select("project", "target_class", "generations", F.col("b.report_id").alias("report_id"), F.round("b.fitness", 4).alias("fitness"))


SQL["contiguous_best"] = f"""WITH {NEWEST_SQL}, b AS (SELECT project, target_class, gen, max((fitness, report_id)) AS b FROM newest WHERE project IS NOT NULL AND target_class IS NOT NULL AND gen >= 1 AND fitness IS NOT NULL AND NOT isnan(fitness) GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY project, target_class ORDER BY gen) AS n FROM b), g AS (SELECT project, target_class, max(gen) AS generations, max(b) AS b FROM n WHERE n = gen GROUP BY 1, 2)
SELECT project, target_class, generations, struct_extract_at(b, 2) AS report_id, round(struct_extract_at(b, 1), 4) AS fitness FROM g"""


def _java(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_file").filter("code IS NOT NULL AND path LIKE '%.java'")


_TEST_METHOD = r"@(?:Test|ParameterizedTest)[^;{}]*?void ([A-Za-z0-9_]+)\("


def test_methods(spark: SparkSession, sf: str) -> DataFrame:
    """How many tests a file has, how many have a name to be shown, and how many assertions there are."""
    c = F.col("code")
    found = F.regexp_extract_all(c, F.lit(_TEST_METHOD), F.lit(1))
    return _java(spark, sf).select(
        "file_id", F.size(found).alias("tests"), F.size(F.array_distinct(found)).alias("names"), F.regexp_count(c, F.lit(r"@DisplayName\(")).alias("shown"), F.regexp_count(c, F.lit(r"assert[A-Z][A-Za-z]*\(")).alias("assertions"),
    )


SQL["test_methods"] = rf"""SELECT file_id, len(regexp_extract_all(code, '{_TEST_METHOD}', 1)) AS tests, len(list_distinct(regexp_extract_all(code, '{_TEST_METHOD}', 1))) AS names,
  len(regexp_extract_all(code, '@DisplayName\(')) AS shown, len(regexp_extract_all(code, 'assert[A-Z][A-Za-z]*\(')) AS assertions FROM source_file WHERE code IS NOT NULL AND path LIKE '%.java'"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return _java(spark, sf).select("file_id", F.posexplode(F.split("code", "\n", -1)).alias("pos", "line"))


_LINES_SQL = "lines AS (SELECT file_id, unnest(range(0, len(string_split(code, chr(10))))) AS pos, unnest(string_split(code, chr(10))) AS line FROM source_file WHERE code IS NOT NULL AND path LIKE '%.java')"


def enclosing_test(spark: SparkSession, sf: str) -> DataFrame:
    """The test method each failing assertion would be in: the nearest ``void`` line before it."""
    w = Window.partitionBy("file_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    name = F.nullif(F.regexp_extract("line", r"void ([A-Za-z0-9_]+)\(", 1), F.lit(""))
    x = _lines(spark, sf).withColumn("test", F.last(name, ignorenulls=True).over(w)).filter(F.contains("line", F.lit("assertEquals(")) & F.col("test").isNotNull())
    return x.groupBy("file_id", "test").agg(F.count(F.lit(1)).alias("assertions"), F.min("pos").alias("first_line"))


SQL["enclosing_test"] = rf"""WITH {_LINES_SQL}, n AS (SELECT *, nullif(regexp_extract(line, 'void ([A-Za-z0-9_]+)\(', 1), '') AS name FROM lines),
t AS (SELECT *, last_value(name IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS test FROM n)
SELECT file_id, test, count(*) AS assertions, min(pos) AS first_line FROM t WHERE contains(line, 'assertEquals(') AND test IS NOT NULL GROUP BY 1, 2"""


def merged_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Imports of all files of a project's package, each once and sorted, as text."""
    package = F.regexp_extract("code", r"package ([a-z0-9_.]+);", 1)
    e = _java(spark, sf).select("project", package.alias("package"), F.explode(F.regexp_extract_all("code", F.lit(r"import ((?:static )?[A-Za-z0-9_.*]+);"), F.lit(1))).alias("i")).filter("package <> ''")
    return e.groupBy("project", "package").agg(F.array_join(F.array_sort(F.collect_set("i")), ";").alias("imports"), F.count(F.lit(1)).alias("n"))


SQL["merged_imports"] = r"""WITH e AS (SELECT project, regexp_extract(code, 'package ([a-z0-9_.]+);', 1) AS package, unnest(regexp_extract_all(code, 'import ((?:static )?[A-Za-z0-9_.*]+);', 1)) AS i FROM source_file WHERE code IS NOT NULL AND path LIKE '%.java')
SELECT project, package, string_agg(DISTINCT i, ';' ORDER BY i) AS imports, count(*) AS n FROM e WHERE package <> '' GROUP BY 1, 2"""



def fix_strategy(spark: SparkSession, sf: str) -> DataFrame:
    """How much of a file a repair should see, by its tests and the share of its calls that failed; with a token estimate."""
    calls = table(spark, sf, "llm_call_stats").filter("test_file_id IS NOT NULL").groupBy("test_file_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("bad"), F.max("response_length").alias("chars"))
    ratio = F.coalesce(F.try_divide(F.col("bad"), F.col("n")), F.lit(0.0))
    label = F.when((F.col("n") <= 8) | (F.col("bad") >= 10), "full").when((F.col("n") <= 20) | (ratio > 0.3), "smart").otherwise("minimal")
    return calls.select("test_file_id", label.alias("strategy"), F.floor(F.col("chars") / 4).alias("tokens"))


SQL["fix_strategy"] = """WITH c AS (SELECT test_file_id, count(*) AS n, count(*) FILTER (WHERE NOT success) AS bad, max(response_length) AS chars FROM llm_call_stats WHERE test_file_id IS NOT NULL GROUP BY 1)
SELECT test_file_id, CASE WHEN n <= 8 OR bad >= 10 THEN 'full' WHEN n <= 20 OR bad::DOUBLE / n > 0.3 THEN 'smart' ELSE 'minimal' END AS strategy, floor(chars / 4)::BIGINT AS tokens FROM c"""


def descriptor_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Classes that signatures speak of: 1 for each parameter, a half for each result, and in how many reports."""
    s = table(spark, sf, "coverage_report").select("report_id", F.explode("covered_methods").alias("s")).filter("s IS NOT NULL")
    n = s.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    inside = F.regexp_extract_all(F.regexp_extract("s", r"\(([^)]*)\)", 1), F.lit("L([^;]+);"), F.lit(1))
    result = F.regexp_extract_all(F.substring_index("s", ")", -1), F.lit("L([^;]+);"), F.lit(1))
    takes = n.select(F.explode(inside).alias("c"), F.lit(1.0).alias("w"), "n")
    gives = n.select(F.explode(result).alias("c"), F.lit(0.5).alias("w"), "n")
    return takes.unionAll(gives).groupBy(F.substring_index("c", "/", -1).alias("class_name")).agg(F.round(F.sum(F.col("w") * F.col("n")), 1).alias("score"))


SQL["descriptor_classes"] = r"""WITH e AS (SELECT unnest(covered_methods) AS s FROM coverage_report), n AS (SELECT s, count(*) AS n FROM e WHERE s IS NOT NULL GROUP BY 1),
t AS (SELECT unnest(regexp_extract_all(regexp_extract(s, '\(([^)]*)\)', 1), 'L([^;]+);', 1)) AS c, 1.0::DOUBLE AS w, n FROM n UNION ALL SELECT unnest(regexp_extract_all(regexp_extract(s, '\)([^)]*)$', 1), 'L([^;]+);', 1)), 0.5, n FROM n)
SELECT regexp_replace(c, '^.*/', '') AS class_name, round(sum(w * n), 1) AS score FROM t GROUP BY 1"""

# Roles of fields by parts of their names, then of their types, in order.
ROLES = [("counter", ["count", "size", "length", "num"]), ("flag", ["flag", "is", "has", "should", "can"]), ("buffer", ["buffer", "cache", "temp"]), ("configuration", ["config", "setting", "option"])]
TYPE_ROLES = [("collection", ["list", "array"]), ("mapping", ["map", "dict"])]


def field_role(name: Column, kind: Column, reads: Column, writes: Column) -> Column:
    """What a field is for, by its name, else its type; read only or mutable by the balance of its uses."""
    role = F.coalesce(rules.first_match(F.lower(name), ROLES, None), rules.first_match(F.lower(kind), TYPE_ROLES, "data"))
    return F.concat(role, F.when((writes == 0) & (reads > 0), "_readonly").when(writes > reads, "_mutable").otherwise(""))


_FIELD = r"^\s+(?:private|protected|public) (?:static )?(?:final )?([A-Za-z0-9_<>\[\], ?]+) ([A-Za-z0-9_]+)(?: =|;)"


def field_roles(spark: SparkSession, sf: str) -> DataFrame:
    """What the fields of files are for, by their names, types and uses: a use is a line of the file with the name, a write one that assigns it."""
    lines = _lines(spark, sf)
    f = lines.select("file_id", F.regexp_extract("line", _FIELD, 1).alias("kind"), F.regexp_extract("line", _FIELD, 2).alias("field")).filter("field <> ''").groupBy("file_id", "field").agg(F.min("kind").alias("kind"))
    words = lines.filter(F.regexp_extract("line", _FIELD, 2) == "").select("file_id", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"([A-Za-z0-9_]+)"), F.lit(1)))).alias("field"), F.regexp_extract("line", r"^\s*(?:this\.)?([A-Za-z0-9_]+) *[-+*/]?= ", 1).alias("assigned"))
    uses = words.groupBy("file_id", "field").agg(F.count_if(F.col("assigned") == F.col("field")).alias("writes"), F.count_if(F.col("assigned") != F.col("field")).alias("reads"))
    both = f.join(uses, ["file_id", "field"], "left").na.fill(0, ["writes", "reads"])
    return both.groupBy(field_role(F.col("field"), F.col("kind"), F.col("reads"), F.col("writes")).alias("role")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_id").alias("files"))


SQL["field_roles"] = rf"""WITH {_LINES_SQL}, p AS (SELECT file_id, line, regexp_extract(line, '{_FIELD}', 1) AS kind, regexp_extract(line, '{_FIELD}', 2) AS field FROM lines),
f AS (SELECT file_id, field, min(kind) AS kind FROM p WHERE field <> '' GROUP BY 1, 2),
w AS (SELECT file_id, unnest(list_distinct(regexp_extract_all(line, '([A-Za-z0-9_]+)', 1))) AS field, regexp_extract(line, '^\s*(?:this\.)?([A-Za-z0-9_]+) *[-+*/]?= ', 1) AS assigned FROM p WHERE field = ''),
u AS (SELECT file_id, field, count(*) FILTER (WHERE assigned = field) AS writes, count(*) FILTER (WHERE assigned <> field) AS reads FROM w GROUP BY 1, 2),
b AS (SELECT f.*, coalesce(writes, 0) AS writes, coalesce(reads, 0) AS reads FROM f LEFT JOIN u USING (file_id, field))
SELECT concat(coalesce({rules.sql_first_match('lower(field)', ROLES, None)}, {rules.sql_first_match('lower(kind)', TYPE_ROLES, 'data')}), CASE WHEN writes = 0 AND reads > 0 THEN '_readonly' WHEN writes > reads THEN '_mutable' ELSE '' END) AS role,
  count(*) AS n, count(DISTINCT file_id) AS files FROM b GROUP BY 1"""


def _cut(text: Column, most: int) -> Column:
    """``text`` up to the last stop, comma or blank beyond six tenths of ``most``, else just ``most`` signs."""
    head = F.substring(text, 1, most)
    end = lambda sign: F.length(head) - F.locate(sign, F.reverse(head)) + 1
    least = int(most * 0.6)
    out = head
    for sign in (" ", ",", "."):
        out = F.when((F.locate(sign, F.reverse(head)) > 0) & (end(sign) > least), F.substring(head, F.lit(1), end(sign))).otherwise(out)
    return F.when(F.length(text) <= most, text).otherwise(out)


def short_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """The first line of each text, cut to a hundred signs where a sentence, a part or a word ends."""
    line = F.trim(F.substring_index("text", "\n", 1))
    d = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", line.alias("line"))
    return d.select("doc_id", F.md5(_cut(F.col("line"), 100)).alias("short_md5"), F.length(_cut(F.col("line"), 100)).alias("n"))


SQL["short_descriptions"] = """WITH d AS (SELECT doc_id, trim(split_part(text, chr(10), 1)) AS line FROM documents WHERE text IS NOT NULL), h AS (SELECT *, substr(line, 1, 100) AS head, reverse(substr(line, 1, 100)) AS r FROM d),
p AS (SELECT *, CASE WHEN strpos(r, '.') > 0 THEN length(head) - strpos(r, '.') + 1 ELSE 0 END AS a, CASE WHEN strpos(r, ',') > 0 THEN length(head) - strpos(r, ',') + 1 ELSE 0 END AS b, CASE WHEN strpos(r, ' ') > 0 THEN length(head) - strpos(r, ' ') + 1 ELSE 0 END AS c FROM h),
s AS (SELECT doc_id, CASE WHEN length(line) <= 100 THEN line WHEN a > 60 THEN substr(head, 1, a) WHEN b > 60 THEN substr(head, 1, b) WHEN c > 60 THEN substr(head, 1, c) ELSE head END AS short FROM p)
SELECT doc_id, md5(short) AS short_md5, length(short) AS n FROM s"""


def covered_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Per newest report the methods its uncovered signatures begin paths in, and how many of these paths count as covered all the same:
    the name is part of a covered signature, and more than half of the branches are covered, if there are any."""
    r = newest_reports(spark, sf, "covered_methods", "uncovered_methods", "metrics.branches_covered", "metrics.branches_total")
    names = F.array_distinct(F.filter(F.transform(F.coalesce("uncovered_methods", F.array()), lambda s: F.substring_index(s, "(", 1)), lambda n: n.isNotNull() & (n != "")))
    hits = F.size(F.filter(names, lambda n: F.coalesce(F.exists("covered_methods", lambda m: F.contains(m, n)), F.lit(False))))
    return r.select("report_id", F.size(names).alias("paths"), F.when(branches_enough(), hits).otherwise(0).alias("covered"), hits.alias("covered_exits"))


SQL["covered_paths"] = f"""WITH {NEWEST_SQL}, x AS (SELECT report_id, coalesce(covered_methods, []) AS covered_methods, coalesce(metrics.branches_total, 0) = 0 OR coalesce(metrics.branches_covered::DOUBLE / nullif(metrics.branches_total, 0) > 0.5, false) AS enough,
  list_distinct(list_filter(list_transform(coalesce(uncovered_methods, []), lambda s: split_part(s, '(', 1)), lambda n: n IS NOT NULL AND n <> '')) AS names FROM newest),
h AS (SELECT *, len(list_filter(names, lambda n: len(list_filter(covered_methods, lambda m: contains(m, n))) > 0)) AS hits FROM x)
SELECT report_id, len(names) AS paths, CASE WHEN enough THEN hits ELSE 0 END AS covered, hits AS covered_exits FROM h"""


def branches_enough() -> Column:
    return (F.coalesce("branches_total", F.lit(0)) == 0) | F.coalesce(F.try_divide("branches_covered", "branches_total") > 0.5, F.lit(False))


def path_verdicts(paths: DataFrame, reports: DataFrame, on: list[str]) -> DataFrame:
    """``paths`` (with method, is_exit) of the reports of their class, and whether each is covered.

    The method's name must be part of any covered method and, but for exits, more than half of the branches be covered,
    if there are any. ``method`` is a name or <class: result name(parameters)>; one without a name is not covered.
    """
    name = F.when(F.contains("method", F.lit("<")) & F.contains("method", F.lit(":")), F.regexp_extract("method", r"^[^:]*:\s*[^ :]+ ([^ (:]*)", 1)).when(F.rlike("method", F.lit(r"^[\w$]+$")), F.col("method"))
    joined = paths.withColumn("_name", F.coalesce(name, F.lit(""))).join(reports, on)
    hit = (F.col("_name") != "") & F.coalesce(F.exists("covered_methods", lambda m: F.contains(m, F.col("_name"))), F.lit(False))
    return joined.withColumn("covered", hit & (F.col("is_exit") | branches_enough())).drop("_name", "covered_methods", "branches_covered", "branches_total")


def covered_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of files that the newest reports of their class cover or don't: the calls, and the exit of each method.

    A file belongs to the reports of its project whose test or target class it is named after.
    """
    f = _java(spark, sf).select("file_id", "project", F.regexp_extract("path", r"([^/]+)\.java$", 1).alias("class_name"), "code")
    facts = java_facts(f, "file_id", "code").filter("kind IN ('call', 'method')").groupBy("file_id", F.col("name").alias("method"), (F.col("kind") == "method").alias("is_exit")).agg(F.count(F.lit(1)).alias("n"))
    paths = facts.join(f.drop("code"), "file_id")
    r = newest_reports(spark, sf, "project", "test_class", "target_class", "covered_methods", "metrics.branches_covered", "metrics.branches_total")
    of = r.withColumn("class_name", F.explode(F.array_distinct(F.array("test_class", "target_class")))).drop("test_class", "target_class")
    v = path_verdicts(paths, of, ["project", "class_name"])
    return v.groupBy("file_id", "report_id").agg(F.sum(F.when(F.col("covered"), F.col("n")).otherwise(0)).alias("covered"), F.sum(F.when(F.col("covered"), 0).otherwise(F.col("n"))).alias("uncovered"))


QUERIES = {name: globals()[name] for name in [*SQL, "covered_calls"]}
