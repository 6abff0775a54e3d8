"""Build logs: status, error records with their details, and what is wrong by an ordered table of patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Categories in order; the first whose pattern is found (whatever the case) is the line's.
CATEGORIES = [
    ("missing_method", r"cannot find symbol.*method|method .* cannot be applied|no suitable method"), ("missing_constructor", r"constructor .* cannot be applied|no suitable constructor"),
    ("missing_class_or_package", r"package .* does not exist|cannot find symbol|class .* not found"), ("api_compatibility", r"is deprecated|api .* changed|incompatible api"),
    ("access_violation", r"has (private|protected) access|is not public|not visible"), ("duplicate_definition", r"already defined|duplicate"), ("interface_implementation", r"is not abstract and does not override|must implement"),
    ("type_mismatch", r"incompatible types|cannot be converted"), ("test_failure", r"tests? (are )?fail|expected: ?<|assertion"), ("syntax_error", r"';' expected|illegal start|unexpected token|reached end of file|class, interface"),
    ("compilation_error", r"compilation (error|failure)|\.java:\[[0-9]+,[0-9]+\]"),
]
_ANSI = r"\x1b\[[0-9;]*[A-Za-z]"
_PLACE = r"([^\s\[\]:]+\.java):\[?([0-9]+)(?:,([0-9]+))?\]?"


def logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("run_id"), F.col("value").alias("log"))


def clean(text: Column) -> Column:
    """Without colours and signs that can't be printed."""
    return F.regexp_replace(F.regexp_replace(text, _ANSI, ""), r"[^\x09\x0a\x20-\x7e\x80-￿]", "")


def status(log: Column) -> Column:
    text = clean(log)
    failed = text.rlike(r"Tests run: [0-9]+, Failures: [1-9]|Tests run: [0-9]+, Failures: [0-9]+, Errors: [1-9]|There are test failures")
    return F.when(failed, "test_failure").when(F.contains(text, F.lit("BUILD SUCCESS")), "success").otherwise("failure")


def category(line: Column) -> Column:
    out = F.lit("unclassified")
    for label, pattern in reversed(CATEGORIES):
        out = F.when(line.rlike(f"(?i){pattern}"), F.lit(label)).otherwise(out)
    return out


def lines(log_frame: DataFrame) -> DataFrame:
    return log_frame.select("run_id", F.posexplode(F.split(clean(F.col("log")), r"\r?\n", -1)).alias("line_no", "line"))


def error_records(log_frame: DataFrame) -> DataFrame:
    """One record per error: where, what kind, the details that follow it and the test that was named before it.

    An error begins at a line with [ERROR] and a place in a file; up to four lines that follow belong to it if they
    give a symbol, a location or a reason, and end at the next error. Of errors at one place the first counts. Noise
    (help, re-run hints, stack switches) is no error.
    """
    all_lines = lines(log_frame)
    noise = F.col("line").rlike(r"(?i)\[help|re-run|to see the full stack|for more information|-> \[|^\[ERROR\]\s*$")
    begins = F.col("line").startswith("[ERROR]") & F.col("line").rlike(_PLACE) & ~noise
    w = Window.partitionBy("run_id").orderBy("line_no")
    test = F.nullif(F.regexp_extract("line", r"(?:Running|Tests run:.* in|test)\s+([A-Za-z_][\w.]+)", 1), F.lit(""))
    marked = all_lines.withColumns({
        "ahead": F.collect_list(F.struct(begins.alias("stop"), F.col("line"))).over(w.rowsBetween(1, 4)), "test_before": F.last(test, ignorenulls=True).over(w.rowsBetween(-10, -1)),
    }).filter(begins)
    until = F.coalesce(F.array_position(F.transform("ahead", lambda a: a["stop"]), True), F.lit(0)).cast("int")
    kept = F.transform(F.when(until > 0, F.slice("ahead", F.lit(1), until - 1)).otherwise(F.col("ahead")), lambda a: F.trim(F.regexp_replace(a["line"], r"^\[ERROR\]\s*", "")))
    detail = F.filter(kept, lambda x: x.rlike("^(symbol|location|reason|required|found)"))
    whole = F.concat_ws(" ", F.col("line"), F.array_join(detail, " "))
    records = marked.select(
        "run_id", "line_no", F.regexp_extract("line", _PLACE, 1).alias("path"), F.regexp_extract("line", _PLACE, 2).cast("int").alias("line"), F.nullif(F.regexp_extract("line", _PLACE, 3), F.lit("")).cast("int").alias("col"),
        category(whole).alias("category"), detail.alias("details"), "test_before", F.trim(F.regexp_replace(F.regexp_replace("line", r"^\[ERROR\]\s*", ""), _PLACE, "")).alias("message"),
    )
    first = Window.partitionBy("run_id", "path", "line", "col").orderBy("line_no")
    return records.withColumn("_i", F.row_number().over(first)).filter("_i = 1").drop("_i")


def failed_methods(log_frame: DataFrame) -> DataFrame:
    """Methods that a log says failed, each once and in the order they come."""
    found = F.concat(
        F.regexp_extract_all("log", F.lit(r"\[ERROR\]\s+(?:[\w.]+\.)?(\w+)(?:\(\))?:\d+"), F.lit(1)), F.regexp_extract_all("log", F.lit(r"(\w+)\([\w.]+\)\s+Time elapsed"), F.lit(1)),
        F.regexp_extract_all("log", F.lit(r"[\w.]+\.(\w+)\s+Time elapsed.*<<< (?:FAILURE|ERROR)"), F.lit(1)),
    )
    return log_frame.select("run_id", F.filter(F.array_distinct(found), lambda m: F.length(m) > 1).alias("methods"))
