"""Filters, look-ups and small catalogues over files, suites and methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from suitelens.functions import names
from suitelens.plans.base import NEWEST_SQL, PERCENT_SQL, newest_reports, scored, table
from suitelens.plans.catalogue import _METHODS_SQL, _methods, complexity
from suitelens.plans.references import test_class_name
from suitelens.plans.suites import _FIELD
from suitelens.plans.texts import meaningful

SQL = {}

# The sizes in bytes of files worth a look, and folders that aren't.
SMALLEST, LARGEST = 1024, 50 * 1024
SKIPPED = r"(?i)(^|/)(utils|enums)/"


def worth_a_look(path: Column, size: Column) -> Column:
    """Java files of 1 to 50 KB outside of folders of helpers."""
    return F.coalesce(F.endswith(path, F.lit(".java")) & ~path.rlike(SKIPPED) & size.between(SMALLEST, LARGEST), F.lit(False))


def file_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Per project the files that are worth a look, and the others; the size is that of the text where it is not stated."""
    f = table(spark, sf, "source_file").select("project", F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), F.coalesce("size", F.length("code").cast("long")).alias("size"))
    ok = worth_a_look(F.col("path"), F.col("size"))
    return f.groupBy("project").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped"))


SQL["file_filter"] = rf"""WITH f AS (SELECT project, replace(path, '\', '/') AS path, coalesce(size, length(code)) AS size FROM source_file),
o AS (SELECT project, coalesce(ends_with(path, '.java') AND NOT regexp_matches(path, '{SKIPPED}') AND size BETWEEN 1024 AND 51200, false) AS ok FROM f)
SELECT project, count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE NOT ok) AS skipped FROM o GROUP BY 1"""


def is_helper(name: Column) -> Column:
    """Names of tests, doubles, abstract and inner classes."""
    return name.rlike(r"Test|Mock|Stub|Abstract|\$")


def helper_names(spark: SparkSession, sf: str) -> DataFrame:
    """Files by whether their class is one that only helps tests."""
    f = table(spark, sf, "test_file_stats").filter("class_name IS NOT NULL")
    return f.groupBy("project").agg(F.count_if(is_helper(F.col("class_name"))).alias("helpers"), F.count_if(~is_helper(F.col("class_name"))).alias("others"))


SQL["helper_names"] = r"""SELECT project, count(*) FILTER (WHERE regexp_matches(class_name, 'Test|Mock|Stub|Abstract|\$')) AS helpers, count(*) FILTER (WHERE NOT regexp_matches(class_name, 'Test|Mock|Stub|Abstract|\$')) AS others
FROM test_file_stats WHERE class_name IS NOT NULL GROUP BY 1"""


def is_of_class(name: Column, simple: Column) -> Column:
    """Whether a class of a report (a/b/X or a/b/X$Y) is the class ``simple`` or one inside it."""
    last = F.substring_index(name, "/", -1)
    return (last == simple) | F.startswith(last, F.concat(simple, F.lit("$")))


def reports_of_class(spark: SparkSession, sf: str) -> DataFrame:
    """Per class with a state how many newest reports are of it or of a class inside it."""
    r = newest_reports(spark, sf, "project", "target_class").filter("target_class IS NOT NULL")
    outer = F.substring_index(F.substring_index("target_class", "/", -1), "$", 1)
    c = table(spark, sf, "class_state").filter("class_name IS NOT NULL").select("project", "class_name").distinct()
    both = c.join(r.withColumn("class_name", outer), ["project", "class_name"], "left")
    return both.groupBy("project", "class_name").agg(F.count_if(is_of_class(F.col("target_class"), F.col("class_name"))).alias("reports"))


SQL["reports_of_class"] = f"""WITH {NEWEST_SQL}, n AS (SELECT project, split_part(regexp_replace(target_class, '^.*/', ''), '$', 1) AS class_name, count(*) AS reports FROM newest WHERE target_class IS NOT NULL GROUP BY 1, 2),
c AS (SELECT DISTINCT project, class_name FROM class_state WHERE class_name IS NOT NULL)
SELECT c.project, c.class_name, coalesce(reports, 0) AS reports FROM c LEFT JOIN n USING (project, class_name)"""


def generated_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a test file has what it needs: its class, a test, and an end."""
    f = table(spark, sf, "source_file").filter("code IS NOT NULL AND path LIKE '%Test%.java'")
    name = F.regexp_extract("path", r"([A-Za-z0-9_$]+)\.java$", 1)
    has = [F.contains("code", F.concat(F.lit("class "), name)), F.contains("code", F.lit("@Test")), F.endswith(F.rtrim(F.regexp_replace("code", r"\s+$", "")), F.lit("}"))]
    return f.select("file_id", has[0].alias("has_class"), has[1].alias("has_test"), has[2].alias("has_end"), (has[0] & has[1] & has[2]).alias("valid"))


SQL["generated_validity"] = r"""WITH f AS (SELECT file_id, code, regexp_extract(path, '([A-Za-z0-9_$]+)\.java$', 1) AS name FROM source_file WHERE code IS NOT NULL AND path LIKE '%Test%.java'),
h AS (SELECT file_id, contains(code, 'class ' || name) AS has_class, contains(code, '@Test') AS has_test, ends_with(regexp_replace(code, '\s+$', ''), '}') AS has_end FROM f)
SELECT *, has_class AND has_test AND has_end AS valid FROM h"""


def method_visibility(spark: SparkSession, sf: str) -> DataFrame:
    """The visibility of each method of a class by its details; without any, names with an underscore in front are private. The last of equal names counts."""
    m = _methods(spark, sf)
    plain = m.select("class_name", "method").distinct()
    details = m.filter("NOT is_accessor").groupBy("class_name", "method").agg(F.max_by(F.when(F.col("is_public"), "public").otherwise("protected"), "method_id").alias("known"))
    own = F.when(F.startswith("method", F.lit("_")), "private").otherwise("public")
    return plain.join(details, ["class_name", "method"], "left").select("class_name", "method", F.coalesce("known", own).alias("visibility"))


SQL["method_visibility"] = f"""WITH {_METHODS_SQL}, d AS (SELECT class_name, method, arg_max(CASE WHEN is_public THEN 'public' ELSE 'protected' END, method_id) AS known FROM methods WHERE NOT is_accessor GROUP BY 1, 2)
SELECT p.class_name, p.method, coalesce(known, CASE WHEN starts_with(p.method, '_') THEN 'private' ELSE 'public' END) AS visibility FROM (SELECT DISTINCT class_name, method FROM methods) p LEFT JOIN d USING (class_name, method)"""


def class_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Classes, and how many methods they have on average and at most."""
    n = _methods(spark, sf).groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("classes"), F.round(F.avg("n"), 4).alias("mean_methods"), F.max("n").alias("most_methods"))


SQL["class_sizes"] = f"WITH {_METHODS_SQL}, n AS (SELECT class_name, count(*) AS n FROM methods GROUP BY 1) SELECT count(*) AS classes, round(avg(n), 4) AS mean_methods, max(n) AS most_methods FROM n"

# How complex methods are listed, the most complex first.
RANKS = {"EXCEPTION": 4, "DEPENDENT": 3, "CONDITIONAL": 2, "SIMPLE": 1}


def method_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each method in the list of its class, by complexity and name, public and other methods numbered apart."""
    c = complexity(F.col("method"), F.col("is_accessor"), F.col("line_count"), F.col("params"), F.col("returned"))
    rank = F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))[F.col("complexity")]
    m = _methods(spark, sf).withColumn("complexity", c).withColumn("rank", rank)
    w = Window.partitionBy("class_name", "is_public").orderBy(F.col("rank").desc(), "method", "method_id")
    return m.select("class_name", "method_id", "is_public", "complexity", F.row_number().over(w).alias("number"))


SQL["method_listing"] = f"""WITH {_METHODS_SQL}, c AS (SELECT *, CASE WHEN is_accessor THEN 'SIMPLE' WHEN starts_with(method, 'new') THEN 'DEPENDENT' WHEN line_count > 30 THEN 'EXCEPTION' WHEN line_count > 15 THEN 'CONDITIONAL' WHEN line_count > 5 THEN 'DEPENDENT'
  WHEN params > 3 THEN 'CONDITIONAL' WHEN returned IN ('java.util.List') THEN 'DEPENDENT' WHEN regexp_matches(lower(method), 'exception|error|throw|catch|try|validate|check|assert') THEN 'EXCEPTION'
  WHEN regexp_matches(lower(method), 'if|is|has|should|can|contains|equals|compare|validate|verify') THEN 'CONDITIONAL' WHEN regexp_matches(lower(method), '^(get|is|has|set).') AND length(method) > 3 OR lower(method) IN ('hashcode', 'tostring') THEN 'SIMPLE' ELSE 'CONDITIONAL' END AS complexity FROM methods)
SELECT class_name, method_id, is_public, complexity, row_number() OVER (PARTITION BY class_name, is_public ORDER BY CASE complexity WHEN 'EXCEPTION' THEN 4 WHEN 'DEPENDENT' THEN 3 WHEN 'CONDITIONAL' THEN 2 ELSE 1 END DESC, method, method_id) AS number FROM c"""


def calls_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Per file its calls by kind as text, generation first and the others in order; calls of unknown kind are dropped."""
    n = table(spark, sf, "llm_call_stats").filter("test_file_id IS NOT NULL AND call_type IS NOT NULL").groupBy("test_file_id", "call_type").agg(F.count(F.lit(1)).alias("n"))
    part = F.struct((F.col("call_type") != "generation").alias("later"), "call_type", F.concat_ws(": ", "call_type", F.col("n").cast("string")).alias("text"))
    return n.groupBy("test_file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "; ").alias("calls"))


SQL["calls_by_kind"] = """WITH n AS (SELECT test_file_id, call_type, count(*) AS n FROM llm_call_stats WHERE test_file_id IS NOT NULL AND call_type IS NOT NULL GROUP BY 1, 2)
SELECT test_file_id, string_agg(call_type || ': ' || n, '; ' ORDER BY call_type <> 'generation', call_type) AS calls FROM n GROUP BY 1"""


def first_failures(spark: SparkSession, sf: str, most: int = 5) -> DataFrame:
    """The first five failed calls of each file."""
    w = Window.partitionBy("test_file_id").orderBy(F.col("start_time").asc_nulls_last(), "call_id")
    c = table(spark, sf, "llm_call_stats").filter("test_file_id IS NOT NULL AND NOT success").select("test_file_id", "call_id", "start_time")
    return c.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= most).select("test_file_id", "i", "call_id")


SQL["first_failures"] = "WITH r AS (SELECT test_file_id, call_id, row_number() OVER (PARTITION BY test_file_id ORDER BY start_time NULLS LAST, call_id) AS i FROM llm_call_stats WHERE test_file_id IS NOT NULL AND NOT success) SELECT test_file_id, i, call_id FROM r WHERE i <= 5"


def weighted_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """0.5 line, 0.4 branch and 0.1 method coverage, in percent."""
    s = scored(spark, sf)
    return s.select("class_id", "gen", "test", F.round(0.5 * F.col("line_coverage") + 0.4 * F.col("branch_coverage") + 0.1 * F.col("method_coverage"), 4).alias("coverage"))


SQL["weighted_coverage"] = f"WITH {PERCENT_SQL} SELECT class_id, gen, test, round(0.5::DOUBLE * line_coverage + 0.4::DOUBLE * branch_coverage + 0.1::DOUBLE * method_coverage, 4) AS coverage FROM covered"


def uncovered_records(spark: SparkSession, sf: str) -> DataFrame:
    """Per newest report the uncovered methods worth a test, as records in order of the report."""
    r = newest_reports(spark, sf, "uncovered_methods")
    kept = F.filter(F.coalesce("uncovered_methods", F.array()), lambda s: s.isNotNull() & meaningful(s))
    return r.select("report_id", F.size(kept).alias("records"), F.md5(F.array_join(kept, "|")).alias("md5"))


def _uncovered_sql() -> str:
    from suitelens.plans.texts import _DROP, _KEEP, _any

    keep = f"CASE WHEN contains(s, '<init>') THEN NOT ends_with(s, '<init>()V') WHEN {_any('lower(s)', _KEEP)} THEN true WHEN {_any('lower(s)', _DROP)} THEN false ELSE true END"
    return f"""WITH {NEWEST_SQL}, k AS (SELECT report_id, list_filter(coalesce(uncovered_methods, []), lambda s: s IS NOT NULL AND {keep}) AS kept FROM newest)
SELECT report_id, len(kept) AS records, md5(coalesce(array_to_string(kept, '|'), '')) AS md5 FROM k"""


SQL["uncovered_records"] = _uncovered_sql()


def merged_methods(spark: SparkSession, sf: str) -> DataFrame:
    """Methods of a class after a repair: the repaired form (the last of a name) where there is one, else the original, in the original's order; new ones after."""
    m = _methods(spark, sf)
    fixed = m.filter("NOT is_public").groupBy("class_name", "method").agg(F.max("method_id").alias("fixed"))
    first = m.filter("is_public").groupBy("class_name", "method").agg(F.min("method_id").alias("place"), F.max("method_id").alias("original"))
    both = first.join(fixed, ["class_name", "method"], "full")
    w = Window.partitionBy("class_name").orderBy(F.col("place").asc_nulls_last(), "method")
    return both.select("class_name", "method", F.coalesce("fixed", "original").alias("method_id"), F.row_number().over(w).alias("position"))


SQL["merged_methods"] = f"""WITH {_METHODS_SQL}, x AS (SELECT class_name, method, max(method_id) AS fixed FROM methods WHERE NOT is_public GROUP BY 1, 2), o AS (SELECT class_name, method, min(method_id) AS place, max(method_id) AS original FROM methods WHERE is_public GROUP BY 1, 2),
b AS (SELECT * FROM o FULL JOIN x USING (class_name, method)) SELECT class_name, method, coalesce(fixed, original) AS method_id, row_number() OVER (PARTITION BY class_name ORDER BY place NULLS LAST, method) AS position FROM b"""


def method_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """How many set-up, tear-down and test methods a file has, and which set-up is to be kept: one with a folder, a modern one, or any."""
    f = table(spark, sf, "source_file").filter("code IS NOT NULL AND path LIKE '%.java'")
    n = lambda p: F.regexp_count("code", F.lit(p))
    setup, down, tests = n(r"@Before(Each|All|Class)?\b"), n(r"@After(Each|All|Class)?\b"), n(r"@(Parameterized|Repeated)?Test\b")
    kept = F.when(setup == 0, "none").when(F.contains("code", F.lit("@TempDir")), "folder").when(F.contains("code", F.lit("@BeforeEach")), "each").otherwise("longest")
    return f.select("file_id", setup.alias("setups"), down.alias("teardowns"), tests.alias("tests"), kept.alias("kept"))


SQL["method_buckets"] = r"""WITH f AS (SELECT file_id, code, len(regexp_extract_all(code, '@Before(Each|All|Class)?\b')) AS setups, len(regexp_extract_all(code, '@After(Each|All|Class)?\b')) AS teardowns, len(regexp_extract_all(code, '@(Parameterized|Repeated)?Test\b')) AS tests FROM source_file WHERE code IS NOT NULL AND path LIKE '%.java')
SELECT file_id, setups, teardowns, tests, CASE WHEN setups = 0 THEN 'none' WHEN contains(code, '@TempDir') THEN 'folder' WHEN contains(code, '@BeforeEach') THEN 'each' ELSE 'longest' END AS kept FROM f"""

# Kinds of types by their base.
PRIMITIVE = ["boolean", "byte", "char", "short", "int", "long", "float", "double", "void"]
WRAPPERS = ["Boolean", "Byte", "Character", "Short", "Integer", "Long", "Float", "Double", "String"]
COLLECTIONS = ["List", "ArrayList", "LinkedList", "Set", "HashSet", "TreeSet", "Collection", "Queue", "Deque"]
MAPS = ["Map", "HashMap", "TreeMap", "LinkedHashMap"]


def type_arguments(text: Column) -> Column:
    """The arguments between the outer < and > of a type, cut at commas that stand in no further < >."""
    inside = F.regexp_extract(text, r"^[^<]*<(.*)>[^>]*$", 1)

    def step(s, c):
        depth = s["depth"] + F.when(c == "<", 1).when(c == ">", -1).otherwise(0)
        ends = (c == ",") & (s["depth"] == 0)
        return F.struct(depth.alias("depth"), F.when(ends, F.concat(s["done"], F.array(F.trim(s["open"])))).otherwise(s["done"]).alias("done"), F.when(ends, F.lit("")).otherwise(F.concat(s["open"], c)).alias("open"))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    folded = F.aggregate(F.split(inside, ""), start, step)
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(F.concat(folded["done"], F.array(F.trim(folded["open"]))))


def parsed_type(text: Column) -> Column:
    """(base, dimensions, arguments, kind) of the text of a Java type."""
    base = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(text, r"(\[\])+$", ""), r"<.*$", "")), r"^.*\.", "")
    dims = (F.length(text) - F.length(F.regexp_replace(text, r"\[\]", ""))) / 2
    kind = (
        F.when(dims > 0, "array").when(base.isin(PRIMITIVE), "primitive").when(base.isin(WRAPPERS), "wrapper")
        .when(base.isin(COLLECTIONS), "collection").when(base.isin(MAPS), "map").otherwise("object")
    )
    return F.struct(base.alias("base"), dims.cast("int").alias("dimensions"), type_arguments(text).alias("arguments"), kind.alias("kind"))


def field_types(spark: SparkSession, sf: str) -> DataFrame:
    """The types of fields of all files, taken apart, and how often each occurs."""
    f = table(spark, sf, "source_file").filter("code IS NOT NULL AND path LIKE '%.java'").select(F.explode(F.split("code", "\n", -1)).alias("line"))
    n = f.select(F.regexp_extract("line", _FIELD, 1).alias("type")).filter("type <> ''").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    t = n.withColumn("t", parsed_type(F.col("type")))
    return t.select("type", "n", "t.base", "t.dimensions", "t.kind", F.size("t.arguments").alias("arguments"))


SQL["field_types"] = rf"""WITH l AS (SELECT unnest(string_split(code, chr(10))) AS line FROM source_file WHERE code IS NOT NULL AND path LIKE '%.java'),
n AS (SELECT regexp_extract(line, '{_FIELD}', 1) AS type, count(*) AS n FROM l GROUP BY 1 HAVING regexp_extract(line, '{_FIELD}', 1) <> ''),
b AS (SELECT *, regexp_replace(trim(regexp_replace(regexp_replace(type, '(\[\])+$', ''), '<.*$', '')), '^.*\.', '') AS base, ((length(type) - length(replace(type, '[]', ''))) / 2)::INT AS dimensions, regexp_extract(type, '^[^<]*<(.*)>[^>]*$', 1) AS inside FROM n)
SELECT type, n, base, dimensions, CASE WHEN dimensions > 0 THEN 'array' WHEN base IN ({", ".join(f"'{x}'" for x in PRIMITIVE)}) THEN 'primitive' WHEN base IN ({", ".join(f"'{x}'" for x in WRAPPERS)}) THEN 'wrapper'
  WHEN base IN ({", ".join(f"'{x}'" for x in COLLECTIONS)}) THEN 'collection' WHEN base IN ({", ".join(f"'{x}'" for x in MAPS)}) THEN 'map' ELSE 'object' END AS kind,
  CASE WHEN inside = '' THEN 0 ELSE 1 + length(regexp_replace(regexp_replace(inside, '<[^<>]*(<[^<>]*>[^<>]*)*>', '', 'g'), '[^,]', '', 'g')) END AS arguments FROM b"""


def signature_sources(spark: SparkSession, sf: str, most: int = 10) -> DataFrame:
    """Per file and uncovered signature of its class the line that declares a method of this name and number of parameters; the first ten of a file."""
    r = newest_reports(spark, sf, "project", "target_class", "uncovered_methods").filter("target_class IS NOT NULL")
    s = r.select("project", F.col("target_class").alias("class_name"), F.explode("uncovered_methods").alias("s")).filter("s IS NOT NULL")
    wanted = s.select("project", "class_name", names.method_name(F.col("s")).alias("name"), F.size(names.parameter_types(F.col("s"))).alias("arity")).distinct()
    f = table(spark, sf, "source_file").filter("code IS NOT NULL AND path LIKE '%.java'")
    lines = f.select("file_id", "project", F.regexp_extract("path", r"([A-Za-z0-9_]+)\.java$", 1).alias("class_name"), F.posexplode(F.split("code", "\n", -1)).alias("pos", "line"))
    parts = F.regexp_extract("line", _DECLARED, 2)
    found = lines.select("file_id", "project", "class_name", "pos", F.regexp_extract("line", _DECLARED, 1).alias("name"), F.when(F.trim(parts) == "", 0).otherwise(F.size(F.split(F.regexp_replace(parts, "<[^<>]*>", ""), ","))).alias("arity")).filter("name <> ''")
    w = Window.partitionBy("file_id").orderBy("pos")
    return found.join(wanted, ["project", "class_name", "name", "arity"]).withColumn("i", F.row_number().over(w)).filter(F.col("i") <= most).select("file_id", "i", "pos", "name", "arity")


_DECLARED = r"^\s+(?:public|protected|private)? ?(?:static )?(?:final )?[A-Za-z0-9_<>\[\], ?]+ ([A-Za-z0-9_]+)\(([^()]*)\)[^;]*\{\s*$"
SQL["signature_sources"] = rf"""WITH {NEWEST_SQL}, s AS (SELECT project, target_class AS class_name, unnest(uncovered_methods) AS s FROM newest WHERE target_class IS NOT NULL),
w AS (SELECT DISTINCT project, class_name, split_part(s, '(', 1) AS name, len(regexp_extract_all(regexp_extract(s, '\(([^)]*)\)', 1), '(\[*(?:L[^;]+;|[BCDFIJSZ]))', 1)) AS arity FROM s WHERE s IS NOT NULL),
l AS (SELECT file_id, project, regexp_extract(path, '([A-Za-z0-9_]+)\.java$', 1) AS class_name, unnest(string_split(code, chr(10))) AS line, generate_subscripts(string_split(code, chr(10)), 1) - 1 AS pos FROM source_file WHERE code IS NOT NULL AND path LIKE '%.java'),
p AS (SELECT *, regexp_extract(line, '{_DECLARED}', 1) AS name, regexp_extract(line, '{_DECLARED}', 2) AS parts FROM l),
f AS (SELECT *, CASE WHEN trim(parts) = '' THEN 0 ELSE len(string_split(regexp_replace(parts, '<[^<>]*>', '', 'g'), ',')) END AS arity FROM p WHERE name <> ''),
r AS (SELECT f.file_id, f.pos, f.name, f.arity, row_number() OVER (PARTITION BY f.file_id ORDER BY f.pos) AS i FROM f JOIN w USING (project, class_name, name, arity)) SELECT file_id, i, pos, name, arity FROM r WHERE i <= 10"""


def class_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Files that may hold the class of a state: named after it and declaring it, in its project."""
    c = table(spark, sf, "class_state").filter("class_name IS NOT NULL").select("project", "class_name").distinct()
    f = table(spark, sf, "source_file").filter("code IS NOT NULL").select("project", "file_id", "code", F.regexp_extract("path", r"([A-Za-z0-9_]+)\.java$", 1).alias("class_name"))
    both = f.join(c, ["project", "class_name"])
    return both.filter(F.contains("code", F.concat(F.lit("class "), F.col("class_name")))).select("project", "class_name", "file_id")


SQL["class_sources"] = r"""WITH c AS (SELECT DISTINCT project, class_name FROM class_state WHERE class_name IS NOT NULL), f AS (SELECT project, file_id, code, regexp_extract(path, '([A-Za-z0-9_]+)\.java$', 1) AS class_name FROM source_file WHERE code IS NOT NULL)
SELECT project, class_name, file_id FROM f JOIN c USING (project, class_name) WHERE contains(code, 'class ' || class_name)"""


def pom_facts(text: Column) -> dict[str, Column]:
    """What a build file tells: Java and JUnit version ('' if it doesn't), whether there are mocks, and how many dependencies."""
    return {
        "java_version": F.regexp_extract(text, r"<(?:maven\.compiler\.(?:source|release)|java\.version|source|release)>([0-9.]+)<", 1),
        "junit_version": F.regexp_extract(text, r"<artifactId>junit[a-z-]*</artifactId>\s*<version>([^<]+)<", 1),
        "mocks": F.contains(F.lower(text), F.lit("mockito")),
        "dependencies": F.regexp_count(text, F.lit(r"<dependency>")),
    }


def build_files(spark: SparkSession, sf: str) -> DataFrame:
    """Build and other XML files with the folder they make a project of, and what they tell."""
    f = table(spark, sf, "source_file").filter("code IS NOT NULL AND path LIKE '%.xml'")
    return f.select("file_id", F.regexp_extract(F.replace("path", F.lit("\\"), F.lit("/")), "^(.*)/[^/]*$", 1).alias("folder"), *(c.alias(n) for n, c in pom_facts(F.col("code")).items()))


SQL["build_files"] = r"""SELECT file_id, regexp_extract(replace(path, '\', '/'), '^(.*)/[^/]*$', 1) AS folder, regexp_extract(code, '<(?:maven\.compiler\.(?:source|release)|java\.version|source|release)>([0-9.]+)<', 1) AS java_version,
  regexp_extract(code, '<artifactId>junit[a-z-]*</artifactId>\s*<version>([^<]+)<', 1) AS junit_version, contains(lower(code), 'mockito') AS mocks, len(regexp_extract_all(code, '<dependency>')) AS dependencies
FROM source_file WHERE code IS NOT NULL AND path LIKE '%.xml'"""

# What a suite of the first generation counts as until it has been measured.
UNSCORED_FITNESS, UNSCORED_COVERAGE = 0.5, 50.0


def suites_to_evolve(spark: SparkSession, sf: str) -> DataFrame:
    """Suites of the first generation of classes with more than one version; those without a fitness count as middling."""
    r = newest_reports(spark, sf, "target_class", "test_class", "gen", "fitness", "metrics.line_coverage").filter("gen = 1 AND target_class IS NOT NULL AND test_class IS NOT NULL")
    known = F.col("fitness").isNotNull() & ~F.isnan("fitness")
    many = r.groupBy("target_class").agg(F.countDistinct(names.version(test_class_name(F.col("test_class")))).alias("versions")).filter("versions > 1")
    return r.join(many, "target_class").select("report_id", "versions", F.when(known, F.round("fitness", 4)).otherwise(UNSCORED_FITNESS).alias("fitness"), F.when(known, F.col("line_coverage")).otherwise(UNSCORED_COVERAGE).alias("line_coverage"))


def _suites_sql() -> str:
    from suitelens.plans.catalogue import _NAME

    return rf"""WITH {NEWEST_SQL}, r AS (SELECT * FROM newest WHERE gen = 1 AND target_class IS NOT NULL AND test_class IS NOT NULL),
m AS (SELECT target_class, count(DISTINCT try_cast(nullif(regexp_extract({_NAME}, 'V([0-9]+)$', 1), '') AS INT)) AS versions FROM r GROUP BY 1 HAVING versions > 1)
SELECT report_id, versions, CASE WHEN fitness IS NULL OR isnan(fitness) THEN 0.5::DOUBLE ELSE round(fitness, 4) END AS fitness, CASE WHEN fitness IS NULL OR isnan(fitness) THEN 50.0::DOUBLE ELSE metrics.line_coverage END AS line_coverage FROM r JOIN m USING (target_class)"""


SQL["suites_to_evolve"] = _suites_sql()


def imports_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """The imports of each file, each once, where it stood first; and how many were repeated."""
    f = table(spark, sf, "source_file").filter("code IS NOT NULL AND path LIKE '%.java'")
    found = F.regexp_extract_all("code", F.lit(r"import (?:static )?([A-Za-z0-9_.*]+);"), F.lit(1))
    once = F.array_distinct(found)
    return f.select("file_id", F.array_join(once, ";").alias("imports"), (F.size(found) - F.size(once)).alias("repeated"))


SQL["imports_in_order"] = r"""WITH f AS (SELECT file_id, regexp_extract_all(code, 'import (?:static )?([A-Za-z0-9_.*]+);', 1) AS l FROM source_file WHERE code IS NOT NULL AND path LIKE '%.java'),
o AS (SELECT file_id, l, list_filter(l, lambda x, i: list_position(l, x) = i) AS once FROM f) SELECT file_id, coalesce(array_to_string(once, ';'), '') AS imports, len(l) - len(once) AS repeated FROM o"""


def context_slices(spark: SparkSession, sf: str, around: int = 30) -> DataFrame:
    """What stands around the first assertion of each file: up to thirty signs on either side."""
    f = table(spark, sf, "source_file").filter("contains(code, 'assert')")
    at = F.locate("assert", F.col("code"))
    begin = F.greatest(F.lit(1), at - around)
    return f.select("file_id", F.substring(F.col("code"), begin, at + 6 + around - begin).alias("context"))


SQL["context_slices"] = "SELECT file_id, substr(code, greatest(1, strpos(code, 'assert') - 30), strpos(code, 'assert') + 36 - greatest(1, strpos(code, 'assert') - 30)) AS context FROM source_file WHERE contains(code, 'assert')"

QUERIES = {name: globals()[name] for name in SQL}
