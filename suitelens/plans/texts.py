"""Rules, lines, duplicates and budgets over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from suitelens.functions import rules
from suitelens.plans.base import table

SQL = {}

# Labels in order, with what must occur in the lower-cased text. The first that matches decides.
REASONS = [
    ("assertion", ["assert", "expected", "but was"]), ("timeout", ["timeout", "timed out", "until the timeout"]), ("null", ["nullpointer", "returns null", " null"]),
    ("memory", ["outofmemory", "garbage collector", "stack overflow"]), ("compilation", ["compiler", "compile", "cannot find symbol", "syntax"]), ("exception", ["exception", "error"]),
]
CATEGORIES = [
    ("missing_method", ["cannot find symbol", "no such method", "missing method"]), ("missing_class", ["cannot find the symbol", "does not exist", "missing"]), ("access", ["private", "protected", "not visible"]),
    ("duplicate", ["duplicate", "already defined", "repeated"]), ("type_mismatch", ["incompatible", "cannot be converted", "type mismatch"]), ("test_failure", ["fails", "failed", "garbage", "asserts"]), ("syntax", ["';' expected", "illegal start", "syntax"]),
]
SCORED = [("import", ["import", "unused"], 5), ("duplicate", ["duplicate", "repeated"], 3), ("access", ["modifier", "repeated", "private"], 3), ("constructor", ["constructor", "argument"], 0), ("resource", ["resource", "close", "stream"], 0)]


_ERROR = "error|exception|failed|failure"  # what makes a line one of an error


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", F.lower(F.coalesce("text", F.lit(""))).alias("low"))


_DOCUMENTS_SQL = "docs AS (SELECT doc_id, text, lower(coalesce(text, '')) AS low FROM documents)"


def failure_reason(spark: SparkSession, sf: str) -> DataFrame:
    """How many texts speak of which reason, each counted under the first that applies."""
    reason = rules.first_match(F.col("low"), REASONS, "unknown").alias("reason")
    return _documents(spark, sf).groupBy(reason).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


SQL["failure_reason"] = f"WITH {_DOCUMENTS_SQL} SELECT {rules.sql_first_match('low', REASONS, 'unknown')} AS reason, count(*) AS n, min(doc_id) AS first_doc FROM docs GROUP BY 1"


def error_category_first_match(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", rules.first_match(F.col("low"), CATEGORIES, "unclassified").alias("category"))


SQL["error_category_first_match"] = f"WITH {_DOCUMENTS_SQL} SELECT doc_id, {rules.sql_first_match('low', CATEGORIES, 'unclassified')} AS category FROM docs"


def error_category_scored(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", rules.best_scored(F.col("low"), SCORED, "none").alias("category"))


def _scored_sql() -> str:
    parts = []
    for i, (label, words, extra) in enumerate(SCORED):
        hits = " + ".join(f"contains(low, {rules.quoted(w)})::INT" for w in words)
        parts.append(f"SELECT doc_id, {rules.quoted(label)} AS category, {hits} AS hits, {hits} + {extra} AS score, {i} AS o FROM docs")
    return " UNION ALL ".join(parts)


SQL["error_category_scored"] = f"""WITH {_DOCUMENTS_SQL}, scores AS ({_scored_sql()}),
best AS (SELECT doc_id, arg_max(category, (score, -o)) AS category FROM scores WHERE hits > 0 GROUP BY 1)
SELECT d.doc_id, coalesce(b.category, 'none') AS category FROM docs d LEFT JOIN best b USING (doc_id)"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    d = _documents(spark, sf).filter("text IS NOT NULL")
    return d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


_LINES_SQL = "lines AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"


def error_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that speak of an error, each once: the key is file and line if the text names them, else its first 100 signs."""
    e = _lines(spark, sf).filter(F.lower("line").rlike("error|exception|failed|failure"))
    place = F.regexp_extract("line", r"([A-Za-z0-9_]+\.java:[0-9]+)", 1)
    key = F.when(place != "", place).otherwise(F.substring(F.trim(F.regexp_replace("line", "[0-9]+", "#")), 1, 100))
    return e.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("_f")).select("key", "n", F.col("_f.doc_id").alias("doc_id"), F.col("_f.pos").alias("pos"))


SQL["error_dedup"] = f"""WITH {_LINES_SQL}, e AS (SELECT *, regexp_extract(line, '([A-Za-z0-9_]+\\.java:[0-9]+)', 1) AS place FROM lines WHERE regexp_matches(lower(line), 'error|exception|failed|failure')),
k AS (SELECT *, CASE WHEN place <> '' THEN place ELSE substr(trim(regexp_replace(line, '[0-9]+', '#', 'g')), 1, 100) END AS key FROM e)
SELECT key, count(*) AS n, arg_min(doc_id, (doc_id, pos)) AS doc_id, arg_min(pos, (doc_id, pos)) AS pos FROM k GROUP BY 1"""


def error_lookahead(spark: SparkSession, sf: str) -> DataFrame:
    """With each line that begins an error what the next four lines say, up to the next error, and the last name before it."""
    begins = F.col("line").startswith("[ERROR]")
    w = Window.partitionBy("doc_id").orderBy("pos")
    ahead = F.collect_list(F.struct(begins.alias("stop"), F.col("line"))).over(w.rowsBetween(1, 4))
    name = F.nullif(F.regexp_extract("line", r"([a-z][A-Za-z0-9]+)\(", 1), F.lit(""))
    before = F.last(name, ignorenulls=True).over(w.rowsBetween(-10, -1))
    x = _lines(spark, sf).withColumns({"ahead": ahead, "name_before": before}).filter(begins)
    until = F.coalesce(F.array_position(F.transform("ahead", lambda a: a["stop"]), True), F.lit(0))
    kept = F.when(until > 0, F.slice("ahead", F.lit(1), until.cast("int") - 1)).otherwise(F.col("ahead"))
    return x.select("doc_id", "pos", F.size(kept).alias("details"), F.md5(F.array_join(F.transform(kept, lambda a: a["line"]), "|")).alias("details_md5"), "name_before")


SQL["error_lookahead"] = f"""WITH {_LINES_SQL}, marked AS (SELECT *, starts_with(line, '[ERROR]') AS e, nullif(regexp_extract(line, '([a-z][A-Za-z0-9]+)\\(', 1), '') AS name FROM lines),
seen AS (SELECT *, lag(name, 1) OVER w AS n1, last_value(name IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS name_before,
  lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2, lead(line, 3) OVER w AS l3, lead(line, 4) OVER w AS l4 FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
errors AS (SELECT *, CASE WHEN l1 IS NULL OR starts_with(l1, '[ERROR]') THEN 0 WHEN l2 IS NULL OR starts_with(l2, '[ERROR]') THEN 1 WHEN l3 IS NULL OR starts_with(l3, '[ERROR]') THEN 2 WHEN l4 IS NULL OR starts_with(l4, '[ERROR]') THEN 3 ELSE 4 END AS details FROM seen WHERE e)
SELECT doc_id, pos, details, md5(coalesce(array_to_string(list_value(l1, l2, l3, l4)[:details], '|'), '')) AS details_md5, name_before FROM errors"""


# Symbols whose import is known to lack, in order.
IMPORTS = [("missing_import_zipentry", ["zipentry"]), ("missing_import_charset", ["charset"]), ("missing_import_standardcharsets", ["standardcharsets"]), ("missing_import_paths", ["path"])]


def root_cause(line: Column) -> Column:
    """What an error comes from, by ordered rules; lines of no rule are alike if they differ in places and generated names only."""
    low = F.lower(line)
    symbol = F.lower(F.regexp_extract(line, r"symbol:\s*\w+\s+(\w+)", 1))
    missing = F.coalesce(rules.first_match(low, IMPORTS, None), F.when(symbol != "", F.concat(F.lit("missing_symbol_"), symbol)).otherwise("missing_symbol_generic"))
    package = F.regexp_extract(low, r"package (.+) does not exist", 1)
    alike = F.regexp_replace(F.regexp_replace(line, r"/[^\s]*\.java:\[\d+,\d+\]", "FILE:LINE"), r"\b\w+Test_\w+", "TestClass")
    return (
        F.when(F.contains(low, F.lit("cannot find symbol")), missing)
        .when(F.contains(low, F.lit("resource specification not allowed here")), "try_with_resources_syntax")
        .when(rules.contains_any(low, ["has private access", "has protected access"]), "access_violation")
        .when(F.contains(low, F.lit("package")) & F.contains(low, F.lit("does not exist")), F.when(package != "", F.concat(F.lit("missing_package_"), F.replace(package, F.lit("."), F.lit("_")))).otherwise("missing_package_generic"))
        .when(rules.contains_any(low, ["expected", "illegal", "unexpected"]), "syntax_error")
        .otherwise(F.concat(F.lit("generic_"), F.md5(alike)))
    )


def root_cause_representative(spark: SparkSession, sf: str) -> DataFrame:
    """Per cause the line that says most: a symbol, a place, short, not of a generated variant; the first of equals."""
    line = F.col("line")
    e = _lines(spark, sf).filter(F.lower("line").rlike(_ERROR))
    score = (
        F.when(F.contains(line, F.lit("symbol:")), 3).otherwise(0) + F.when(F.contains(line, F.lit("location:")), 2).otherwise(0)
        + F.when(F.length(line) < 200, 1).otherwise(0) + F.when(line.rlike(r"Test_\w+_\w+"), 0).otherwise(2)
    )
    by = e.groupBy(root_cause(line).alias("cause")).agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("doc_id", "pos", score.alias("score")), F.struct(score, -F.col("doc_id"), -F.col("pos"))).alias("_b"))
    return by.select("cause", "n", "_b.doc_id", "_b.pos", "_b.score")


_CAUSE_SQL = r"""CASE WHEN contains(lower(line), 'cannot find symbol') THEN CASE WHEN contains(lower(line), 'zipentry') THEN 'missing_import_zipentry' WHEN contains(lower(line), 'charset') THEN 'missing_import_charset'
    WHEN contains(lower(line), 'path') THEN 'missing_import_paths' WHEN regexp_extract(line, 'symbol:\s*\w+\s+(\w+)', 1) <> '' THEN 'missing_symbol_' || lower(regexp_extract(line, 'symbol:\s*\w+\s+(\w+)', 1)) ELSE 'missing_symbol_generic' END
  WHEN contains(lower(line), 'resource specification not allowed here') THEN 'try_with_resources_syntax' WHEN contains(lower(line), 'has private access') OR contains(lower(line), 'has protected access') THEN 'access_violation'
  WHEN contains(lower(line), 'package') AND contains(lower(line), 'does not exist') THEN CASE WHEN regexp_extract(lower(line), 'package (.+) does not exist', 1) <> '' THEN 'missing_package_' || replace(regexp_extract(lower(line), 'package (.+) does not exist', 1), '.', '_') ELSE 'missing_package_generic' END
  WHEN regexp_matches(lower(line), 'expected|illegal|unexpected') THEN 'syntax_error'
  ELSE 'generic_' || md5(regexp_replace(regexp_replace(line, '/[^\s]*\.java:\[\d+,\d+\]', 'FILE:LINE', 'g'), '\b\w+Test_\w+', 'TestClass', 'g')) END"""
SQL["root_cause_representative"] = rf"""WITH {_LINES_SQL}, e AS (SELECT *, {_CAUSE_SQL} AS cause,
  CASE WHEN contains(line, 'symbol:') THEN 3 ELSE 0 END + CASE WHEN contains(line, 'location:') THEN 2 ELSE 0 END + CASE WHEN length(line) < 200 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(line, 'Test_\w+_\w+') THEN 0 ELSE 2 END AS score
  FROM lines WHERE regexp_matches(lower(line), '{_ERROR}')),
r AS (SELECT *, row_number() OVER (PARTITION BY cause ORDER BY score DESC, doc_id, pos) AS i, count(*) OVER (PARTITION BY cause) AS n FROM e)
SELECT cause, n, doc_id, pos, score FROM r WHERE i = 1"""


# Kinds of errors by their words, in order, and the bucket of each kind: 1 critical, 2 important, 3 other.
KINDS = [
    ("type_mismatch", ["incompatible types", "cannot be converted", "autocloseable"]), ("syntax_error", ["not a statement", "try without catch", "expected", "illegal start"]),
    ("missing_method", ["cannot find symbol", "no suitable method"]), ("missing_class_or_package", ["does not exist", "class not found"]), ("compilation_error", ["compil"]),
]
BUCKETS = {"type_mismatch": 1, "syntax_error": 1, "missing_method": 2, "missing_class_or_package": 2, "compilation_error": 2}
QUOTA = {1: 5, 2: 15, 3: 3}


def prioritized_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Per document with more than five error lines: 5 critical, 15 important, 3 others, in that order; else all.

    Of lines on missing methods only the first for each method counts among the important ones, and none that names no method.
    """
    low = F.lower("line")
    kind = rules.first_match(low, KINDS, "other")
    e = _lines(spark, sf).filter(low.rlike(_ERROR)).select("doc_id", "pos", kind.alias("kind"), F.regexp_extract("line", r"(?:method|symbol) (\w+)", 1).alias("name"))
    bucket = F.coalesce(F.create_map(*(F.lit(x) for kv in BUCKETS.items() for x in kv))[F.col("kind")], F.lit(3))
    missing = F.col("kind") == "missing_method"
    first = F.when(missing & (F.col("name") != ""), F.row_number().over(Window.partitionBy("doc_id", "kind", "name").orderBy("pos")) == 1).otherwise(~missing)
    e = e.withColumns({"bucket": bucket, "counts": first, "all": F.count(F.lit(1)).over(Window.partitionBy("doc_id"))})
    few = F.col("all") <= 5
    r = e.filter(few | F.col("counts")).withColumn("i", F.row_number().over(Window.partitionBy("doc_id", "bucket").orderBy("pos")))
    quota = F.create_map(*(F.lit(x) for kv in QUOTA.items() for x in kv))[F.col("bucket")]
    return r.filter(few | (F.col("i") <= quota)).select("doc_id", "pos", "bucket", "i")


SQL["prioritized_errors"] = rf"""WITH {_LINES_SQL}, k AS (SELECT doc_id, pos, {rules.sql_first_match('lower(line)', KINDS, 'other')} AS kind, regexp_extract(line, '(?:method|symbol) (\w+)', 1) AS name FROM lines WHERE regexp_matches(lower(line), '{_ERROR}')),
e AS (SELECT *, CASE kind WHEN 'type_mismatch' THEN 1 WHEN 'syntax_error' THEN 1 WHEN 'other' THEN 3 ELSE 2 END AS bucket, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id, kind, name ORDER BY pos) AS k FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, bucket ORDER BY pos) AS i FROM e WHERE n <= 5 OR kind <> 'missing_method' OR (name <> '' AND k = 1))
SELECT doc_id, pos, bucket, i FROM r WHERE n <= 5 OR i <= CASE bucket WHEN 1 THEN 5 WHEN 2 THEN 15 ELSE 3 END"""

# What must be mended first, and next.
FIRST = ["missing_import_", "missing_package_", "cannot find symbol"]
NEXT = ["try_with_resources", "syntax_error", "access_violation"]


def fundamental_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Per document with more than five error lines 8 of the first kind, the next kind up to 10 in all, others up to 12 in all; else all."""
    low = F.lower("line")
    kind = F.when(rules.contains_any(low, FIRST), 1).when(rules.contains_any(low, NEXT), 2).otherwise(3)
    e = _lines(spark, sf).filter(low.rlike(_ERROR)).select("doc_id", "pos", kind.alias("priority"))
    n = lambda k: F.count_if(F.col("priority") == k).over(Window.partitionBy("doc_id"))
    e = e.withColumns({"first": F.least(n(1), F.lit(8)), "next": n(2), "all": F.count(F.lit(1)).over(Window.partitionBy("doc_id")), "i": F.row_number().over(Window.partitionBy("doc_id", "priority").orderBy("pos"))})
    two = F.least(F.col("next"), F.greatest(F.lit(0), 10 - F.col("first")))
    room = F.when(F.col("priority") == 1, F.lit(8)).when(F.col("priority") == 2, two).otherwise(12 - F.col("first") - two)
    return e.filter((F.col("all") <= 5) | (F.col("i") <= room)).select("doc_id", "pos", "priority")


SQL["fundamental_errors"] = f"""WITH {_LINES_SQL}, e AS (SELECT doc_id, pos, CASE WHEN regexp_matches(lower(line), 'missing_import_|missing_package_|cannot find symbol') THEN 1 WHEN regexp_matches(lower(line), 'try_with_resources|syntax_error|access_violation') THEN 2 ELSE 3 END AS priority
  FROM lines WHERE regexp_matches(lower(line), '{_ERROR}')),
c AS (SELECT doc_id, least(count(*) FILTER (WHERE priority = 1), 8) AS a, count(*) FILTER (WHERE priority = 2) AS b, count(*) AS n FROM e GROUP BY 1),
r AS (SELECT e.*, n, a, least(b, greatest(0, 10 - a)) AS two, row_number() OVER (PARTITION BY e.doc_id, priority ORDER BY pos) AS i FROM e JOIN c USING (doc_id))
SELECT doc_id, pos, priority FROM r WHERE n <= 5 OR i <= CASE priority WHEN 1 THEN 8 WHEN 2 THEN two ELSE 12 - a - two END"""


# Parts of signatures that keep or drop them, in order.
_KEEP = [
    "public", "process", "execute", "handle", "create", "build", "parse", "validate", "convert", "transform", "calculate",
    "write", "read", "open", "close", "flush", "reset", "add", "remove", "update", "delete", "find", "search", "start", "stop", "run", "finish",
]
_DROP = [
    "get", "set", "is", "has", "tostring", "hashcode", "equals", "clone", "notify", "wait", "finalize",
    "private", "internal", "helper", "util", "$", "lambda$", "test", "mock", "stub", "fake", "assert",
]


def meaningful(signature: Column) -> Column:
    """Whether a method is worth a test; the first rule that fires decides."""
    low = F.lower(signature)
    return (
        F.when(F.contains(signature, F.lit("<init>")), ~F.endswith(signature, F.lit("<init>()V")))
        .when(rules.contains_any(low, _KEEP), True).when(rules.contains_any(low, _DROP), False).otherwise(True)
    )


def meaningful_filter(spark: SparkSession, sf: str) -> DataFrame:
    """How often signatures are uncovered that are worth a test."""
    r = table(spark, sf, "coverage_report").select(F.explode("uncovered_methods").alias("s"))
    n = r.filter("s IS NOT NULL").groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    return n.filter(meaningful(F.col("s"))).select(F.col("s").alias("signature"), "n")


def _any(text: str, parts: list[str]) -> str:
    return " OR ".join(f"contains({text}, {rules.quoted(p)})" for p in parts)


SQL["meaningful_filter"] = f"""WITH s AS (SELECT unnest(uncovered_methods) AS signature FROM coverage_report), n AS (SELECT signature, count(*) AS n, lower(signature) AS low FROM s WHERE signature IS NOT NULL GROUP BY 1)
SELECT signature, n FROM n WHERE CASE WHEN contains(signature, '<init>') THEN NOT ends_with(signature, '<init>()V') WHEN {_any('low', _KEEP)} THEN true WHEN {_any('low', _DROP)} THEN false ELSE true END"""


def semantic_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of each document's words from the purpose of each container, by Jaccard; 1 if either has none."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))
    d = table(spark, sf, "documents").select("doc_id", words(F.col("text")).alias("a"))
    s = table(spark, sf, "container_spec").select("spec_id", words(F.col("purpose")).alias("b"))  # four rows
    x = d.crossJoin(F.broadcast(s))
    both = F.size(F.array_intersect("a", "b"))
    value = F.when((F.size("a") == 0) | (F.size("b") == 0), F.lit(1.0)).otherwise(1.0 - both / (F.size("a") + F.size("b") - both))
    return x.select("doc_id", "spec_id", F.round(value, 6).alias("distance"))


SQL["semantic_distance"] = """WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '')) AS a FROM documents),
s AS (SELECT spec_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(purpose, '')), '[^a-z0-9]+'), lambda w: w <> '')) AS b FROM container_spec),
x AS (SELECT doc_id, spec_id, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS i FROM d, s)
SELECT doc_id, spec_id, round(CASE WHEN na = 0 OR nb = 0 THEN 1.0 ELSE 1.0 - i::DOUBLE / (na + nb - i) END, 6) AS distance FROM x"""


def _code_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_file").filter("code IS NOT NULL").select("file_id", F.explode(F.split("code", "\n", -1)).alias("line"))


_CODE_SQL = "lines AS (SELECT file_id, unnest(string_split(code, chr(10))) AS line FROM source_file WHERE code IS NOT NULL)"


def useful_context(spark: SparkSession, sf: str) -> DataFrame:
    """Files with at least two lines that tell of an interface, where these are over a fifth of them and the bare structure together."""
    s = F.trim(F.col("line"))
    basic = s.rlike(r"^(package |import |public class |public interface |/\*|\*|//)") | (s == "}")
    shown = s.rlike("private |public |protected ")
    useful = ~basic & (
        (F.endswith(s, F.lit(";")) & F.contains(s, F.lit("(")) & s.rlike("public |protected ")) | s.rlike("^(public|protected) static final")
        | (shown & F.contains(s, F.lit(";")) & ~F.contains(s, F.lit("final")))
    )
    long = table(spark, sf, "source_file").filter(F.length(F.trim("code")) >= 50).select("file_id")
    by = _code_lines(spark, sf).groupBy("file_id").agg(F.count_if(useful).alias("useful"), F.count_if(basic).alias("basic"))
    share = F.coalesce(F.try_divide(F.col("useful"), F.col("useful") + F.col("basic")), F.lit(0.0))
    return by.join(long, "file_id").withColumn("is_useful", (F.col("useful") >= 2) & (share > 0.2))


SQL["useful_context"] = rf"""WITH {_CODE_SQL}, t AS (SELECT file_id, trim(line) AS s FROM lines WHERE file_id IN (SELECT file_id FROM source_file WHERE length(trim(code)) >= 50)), b AS (SELECT *, regexp_matches(s, '^(package |import |public class |public interface |/\*|\*|//)') OR s = chr(125) AS basic FROM t),
u AS (SELECT *, NOT basic AND ((ends_with(s, ';') AND contains(s, '(') AND regexp_matches(s, 'public |protected ')) OR regexp_matches(s, '^(public|protected) static final') OR (regexp_matches(s, 'private |public |protected ') AND contains(s, ';') AND NOT contains(s, 'final'))) AS us FROM b),
c AS (SELECT file_id, count(*) FILTER (WHERE us) AS useful, count(*) FILTER (WHERE basic) AS basic FROM u GROUP BY 1)
SELECT *, useful >= 2 AND coalesce(useful::DOUBLE / nullif(useful + basic, 0), 0.0) > 0.2 AS is_useful FROM c"""


# How long the chosen texts may be together, and how many there are at least.
BUDGET, LEAST = 12_000, 8


def text_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Per project and day all prompts, then the shortest other texts (of equal ones those with more tests) while all stay below the budget, or until there are eight."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL AND created_at IS NOT NULL")
    tests = F.regexp_count("text", F.lit("@Test"))
    d = d.select("project", F.date_format("created_at", "yyyy-MM-dd").alias("day"), "doc_id", F.length("text").alias("n"), (F.coalesce("doc_kind", F.lit("")) == "prompt").alias("priority"), tests.alias("tests"))
    order = [F.col("priority").desc(), F.when(~F.col("priority"), F.col("n")), F.when(~F.col("priority"), -F.col("tests")), F.col("doc_id")]
    w = Window.partitionBy("project", "day").orderBy(*order)
    r = d.withColumns({"total": F.sum("n").over(w), "i": F.row_number().over(w)})
    return r.filter(F.col("priority") | (F.col("total") < BUDGET) | (F.col("i") <= LEAST)).select("project", "day", "doc_id", "total")


SQL["text_budget"] = """WITH d AS (SELECT project, strftime(created_at, '%Y-%m-%d') AS day, doc_id, length(text) AS n, coalesce(doc_kind, '') = 'prompt' AS p, len(regexp_extract_all(text, '@Test')) AS tests FROM documents WHERE text IS NOT NULL AND created_at IS NOT NULL),
s AS (SELECT *, sum(n) OVER w AS total, row_number() OVER w AS i FROM d WINDOW w AS (PARTITION BY project, day ORDER BY p DESC, CASE WHEN NOT p THEN n END, CASE WHEN NOT p THEN -tests END, doc_id ROWS UNBOUNDED PRECEDING)) SELECT project, day, doc_id, total FROM s WHERE p OR total < 12000 OR i <= 8"""


def code_line_count(code: Column) -> Column:
    """Lines that hold code: not blank, not in a block comment (lines with its begin or end are part of it), not after //."""

    def step(state, line):
        s = F.trim(line)
        opens, closes = F.contains(s, F.lit("/*")), F.contains(s, F.lit("*/"))
        comment = opens | closes | state["inside"] | (s == "") | F.startswith(s, F.lit("//"))
        inside = F.when(opens, ~closes).when(closes, False).otherwise(state["inside"])
        return F.struct(inside.alias("inside"), (state["n"] + F.when(comment, 0).otherwise(1)).alias("n"))

    return F.aggregate(F.split(code, "\n", -1), F.struct(F.lit(False).alias("inside"), F.lit(0).alias("n")), step)["n"]


def line_count(spark: SparkSession, sf: str) -> DataFrame:
    """Lines, lines that aren't blank, and lines that hold code, per file."""
    f = table(spark, sf, "source_file").filter("code IS NOT NULL")
    lines = F.split("code", "\n", -1)
    return f.select("file_id", F.size(lines).alias("lines"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).alias("filled"), code_line_count(F.col("code")).alias("code_lines"))


SQL["line_count"] = r"""WITH l AS (SELECT file_id, unnest(string_split(code, chr(10))) AS line, generate_subscripts(string_split(code, chr(10)), 1) AS pos FROM source_file WHERE code IS NOT NULL),
m AS (SELECT *, trim(line) AS s, CASE WHEN contains(line, '/*') THEN NOT contains(line, '*/') WHEN contains(line, '*/') THEN false END AS mark FROM l),
b AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside FROM m)
SELECT file_id, count(*) AS lines, count(*) FILTER (WHERE s <> '') AS filled, count(*) FILTER (WHERE s <> '' AND mark IS NULL AND NOT inside AND NOT starts_with(s, '//')) AS code_lines FROM b GROUP BY 1"""


def code_block_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The longest fenced block of a text, else the text itself; and how many blocks there are."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    blocks = F.regexp_extract_all("text", F.lit(r"```[a-z]*\n([^`]*)```"), F.lit(1))
    longest = F.array_max(F.transform(blocks, lambda b, i: F.struct(F.length(b).alias("n"), (-i).alias("i"), b.alias("b"))))["b"]
    return d.select("doc_id", F.size(blocks).alias("blocks"), F.length(F.coalesce(longest, F.col("text"))).alias("chars"))


SQL["code_block_extract"] = r"""WITH b AS (SELECT doc_id, text, regexp_extract_all(text, '```[a-z]*\n([^`]*)```', 1) AS blocks FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(blocks) AS blocks, CASE WHEN len(blocks) > 0 THEN list_max(list_transform(blocks, lambda x: length(x))) ELSE length(text) END AS chars FROM b"""


def html_regex_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of texts and how often they open, over all texts."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    return d.select(F.explode(F.regexp_extract_all("text", F.lit("<([a-z]+[0-9]?)[ >]"), F.lit(1))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


SQL["html_regex_extract"] = "WITH t AS (SELECT unnest(regexp_extract_all(text, '<([a-z]+[0-9]?)[ >]', 1)) AS tag FROM documents WHERE text IS NOT NULL) SELECT tag, count(*) AS n FROM t GROUP BY 1"


def header_strip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of Java files without the comment they may begin with: its length, and the package that follows."""
    f = table(spark, sf, "source_file").filter("code IS NOT NULL AND path LIKE '%.java'")
    bare = F.regexp_replace("code", r"^\s*/\*[^*]*\*+(?:[^/*][^*]*\*+)*/\s*", "")
    return f.select("file_id", (F.length("code") - F.length(bare)).alias("header"), F.nullif(F.regexp_extract(bare, r"package ([a-z0-9_.]+);", 1), F.lit("")).alias("package"))


SQL["header_strip"] = r"""WITH b AS (SELECT file_id, code, regexp_replace(code, '^\s*/\*[^*]*\*+(?:[^/*][^*]*\*+)*/\s*', '') AS bare FROM source_file WHERE code IS NOT NULL AND path LIKE '%.java')
SELECT file_id, length(code) - length(bare) AS header, nullif(regexp_extract(bare, 'package ([a-z0-9_.]+);', 1), '') AS package FROM b"""

QUERIES = {name: globals()[name] for name in SQL}
