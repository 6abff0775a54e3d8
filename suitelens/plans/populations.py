"""Diversity, matching, covering and completeness over the reports of a population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from suitelens.functions import names, scoring
from suitelens.operators import greedy
from suitelens.plans.base import NEWEST_SQL, SURVIVORS_SQL, newest_reports, survivors, table
from suitelens.plans.references import test_class_name

SQL = {}
GROUP = ["target_class", "gen"]


def _sets(spark: SparkSession, sf: str) -> DataFrame:
    s = survivors(spark, sf, "test_class", "covered_methods", "uncovered_methods")
    distinct = lambda c: F.array_sort(F.array_distinct(F.filter(F.col(c), lambda x: x.isNotNull())))
    return s.select(*GROUP, "report_id", "rank", "test_class", distinct("covered_methods").alias("covered"), distinct("uncovered_methods").alias("uncovered"))


_SETS_SQL = SURVIVORS_SQL + """,
sets AS (
  SELECT target_class, gen, report_id, rank, test_class, list_sort(list_distinct(covered_methods)) AS covered, list_sort(list_distinct(uncovered_methods)) AS uncovered
  FROM survivors)"""


def item_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The sorted distinct signatures of each survivor, as text."""
    s = _sets(spark, sf)
    return s.select(*GROUP, "report_id", F.coalesce(F.size("covered"), F.lit(0)).alias("n_covered"), F.md5(F.array_join(F.coalesce("covered", F.expr("array()")), "|")).alias("covered_md5"))


SQL["item_sets"] = f"WITH {_SETS_SQL} SELECT target_class, gen, report_id, coalesce(len(covered), 0) AS n_covered, md5(coalesce(array_to_string(covered, '|'), '')) AS covered_md5 FROM sets"


def _words(c: str) -> Column:
    """The words a name of a suite is made of: what is known of its meaning where its text is not at hand."""
    parts = F.split(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def _names(c: str) -> Column:
    """First elements of paths: the method each begins in, whatever its parameters."""
    return F.array_distinct(F.transform(F.coalesce(c, F.array()), lambda s: F.substring_index(s, "(", 1)))


_WORDS_SQL = "list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(coalesce({c}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> ''))"
_NAMES_SQL = "list_distinct(list_transform(coalesce({c}, []), lambda s: split_part(s, '(', 1)))"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    s = _sets(spark, sf)
    a, b = s.alias("a"), s.alias("b")
    same = F.expr("a.target_class = b.target_class AND a.gen <=> b.gen AND a.rank < b.rank")  # at most 45 of a population of 10
    distance = scoring.diversity(
        scoring.token_distance(_words("a.test_class"), _words("b.test_class")),
        scoring.jaccard_distance(F.col("a.covered"), F.col("b.covered")),
        scoring.jaccard_distance(_names("a.covered"), _names("b.covered")),
    )
    return a.join(b, same).select("a.target_class", "a.gen", F.col("a.report_id").alias("a"), F.col("b.report_id").alias("b"), F.round(distance, 6).alias("diversity"))


_DISTANCE = "CASE WHEN {u} = 0 THEN 0.0 ELSE 1.0 - {i} / {u} END"


def _distance_sql(c: str) -> str:
    x, y = f"coalesce(a.{c}, [])", f"coalesce(b.{c}, [])"
    i = f"len(list_intersect({x}, {y}))::DOUBLE"
    return _DISTANCE.format(i=i, u=f"(len({x}) + len({y}) - {i})")


_PAIRS_SQL = _SETS_SQL + f""",
pairs AS (
  SELECT a.target_class, a.gen, a.report_id AS a, b.report_id AS b, round(0.4::DOUBLE * (CASE WHEN len(a.words) = 0 OR len(b.words) = 0 THEN 1.0 ELSE {_distance_sql('words')} END) + 0.3::DOUBLE * ({_distance_sql('covered')}) + 0.3::DOUBLE * ({_distance_sql('names')}), 6) AS diversity
  FROM (SELECT *, {_WORDS_SQL.format(c='test_class')} AS words, {_NAMES_SQL.format(c='covered')} AS names FROM sets) a
  JOIN (SELECT *, {_WORDS_SQL.format(c='test_class')} AS words, {_NAMES_SQL.format(c='covered')} AS names FROM sets) b ON a.target_class = b.target_class AND a.gen IS NOT DISTINCT FROM b.gen AND a.rank < b.rank)"""


def pair_diversity(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf)


SQL["pair_diversity"] = f"WITH {_PAIRS_SQL} SELECT * FROM pairs"


def _limit():
    """Five pairs of a full population, else a third choice at most: n (n - 1) / 2 pairs tell how many n are."""
    n = F.floor((1 + F.sqrt(1 + 8 * F.count(F.lit(1)))) / 2)
    return F.when(n >= 10, F.lit(5)).otherwise(F.least(F.floor(n / 2), F.lit(3)))


def diverse_pairs_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return greedy.matching(_pairs(spark, sf), GROUP, "diversity", "a", "b", _limit())


def _fold_sql(pairs: str, out: str) -> str:
    return f""",
ordered AS (SELECT *, row_number() OVER (PARTITION BY target_class, gen ORDER BY diversity DESC, a, b) AS i, count(*) OVER (PARTITION BY target_class, gen) AS m FROM {pairs}),
limited AS (SELECT *, floor((1 + sqrt(1 + 8 * m)) / 2) AS n FROM ordered),
fold AS (
  SELECT target_class, gen, 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS diversity, 0 AS pick, false AS taken FROM limited WHERE i = 1
  UNION ALL
  SELECT f.target_class, f.gen, o.i, CASE WHEN t.free THEN list_concat(f.used, [o.a, o.b]) ELSE f.used END, o.a, o.b, o.diversity, f.pick + t.free::INT, t.free
  FROM fold f JOIN limited o ON o.target_class = f.target_class AND o.gen IS NOT DISTINCT FROM f.gen AND o.i = f.i + 1,
  LATERAL (SELECT NOT list_contains(f.used, o.a) AND NOT list_contains(f.used, o.b) AND f.pick < CASE WHEN o.n >= 10 THEN 5 ELSE least(floor(o.n / 2), 3) END AS free) t)
SELECT target_class, gen, pick, a, b, diversity FROM fold WHERE taken"""


SQL["diverse_pairs_greedy"] = f"WITH RECURSIVE {_PAIRS_SQL} {_fold_sql('pairs', '')}"


def repair_pairs_remaining(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of the population that no crossover of the next generation has joined yet, matched again.

    The parents of a crossover are told by their versions, so pairs are of the survivors' versions.
    """
    done = _crossovers(spark, sf)
    p = _versioned(spark, sf)
    left = p.join(done, (p.target_class == done.c) & p.gen.eqNullSafe(done.g) & (F.least("va", "vb") == done.i) & (F.greatest("va", "vb") == done.j), "left_anti")
    return greedy.matching(left.select(*GROUP, "a", "b", "diversity"), GROUP, "diversity", "a", "b", _limit())


def _crossovers(spark: SparkSession, sf: str) -> DataFrame:
    name = test_class_name(F.col("test_class"))
    i, j = names.pair(name)
    r = newest_reports(spark, sf, "target_class", "gen", "test_class")
    return r.filter(i.isNotNull()).select(F.col("target_class").alias("c"), (F.col("gen") - 1).alias("g"), i.alias("i"), j.alias("j")).distinct()


def _versioned(spark: SparkSession, sf: str) -> DataFrame:
    v = survivors(spark, sf, "test_class").select("report_id", F.coalesce(names.version(test_class_name(F.col("test_class"))), F.col("rank")).alias("v"))
    p = _pairs(spark, sf)
    return p.join(v.select(F.col("report_id").alias("a"), F.col("v").alias("va")), "a").join(v.select(F.col("report_id").alias("b"), F.col("v").alias("vb")), "b")


_NAME_SQL = r"regexp_replace(regexp_replace(regexp_replace(test_class, '^\s+|\s+$', '', 'g'), '\.(java|class)$', ''), '(?s)^.*[./]', '')"
SQL["repair_pairs_remaining"] = rf"""WITH RECURSIVE {_PAIRS_SQL},
named AS (SELECT target_class AS c, gen, {_NAME_SQL} AS name FROM newest),
crossed AS (SELECT c, gen - 1 AS g, regexp_extract(name, '_([0-9]+)x[0-9]+$', 1)::INT AS x, regexp_extract(name, '_[0-9]+x([0-9]+)$', 1)::INT AS y FROM named WHERE regexp_matches(name, '_[0-9]+x[0-9]+$')),
done AS (SELECT DISTINCT c, g, least(x, y) AS i, greatest(x, y) AS j FROM crossed),
versions AS (SELECT report_id, coalesce(try_cast(nullif(regexp_extract({_NAME_SQL}, 'V([0-9]+)$', 1), '') AS INT), rank) AS v FROM survivors),
free AS (
  SELECT p.* FROM pairs p JOIN versions va ON va.report_id = p.a JOIN versions vb ON vb.report_id = p.b
  WHERE NOT EXISTS (SELECT 1 FROM done WHERE c = p.target_class AND g IS NOT DISTINCT FROM p.gen AND i = least(va.v, vb.v) AND j = greatest(va.v, vb.v)))
{_fold_sql('free', '')}"""


def set_cover_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return greedy.set_cover(_sets(spark, sf), GROUP, "rank", "covered")


SQL["set_cover_greedy"] = f"""WITH RECURSIVE {_SETS_SQL},
grouped AS (SELECT target_class, gen, list({{'r': rank, 'v': coalesce(covered, [])}} ORDER BY rank) AS suites FROM sets GROUP BY 1, 2),
fold AS (
  SELECT target_class, gen, suites, 1 AS pick, suites[1].r AS rank, suites[1].v AS have, true AS more FROM grouped
  UNION ALL
  SELECT target_class, gen, suites, pick + 1, -best.r, list_distinct(list_concat(have, best.v)), true
  FROM (SELECT *, list_sort(list_transform(suites, lambda s: {{'g': len(list_filter(s.v, lambda x: NOT list_contains(have, x))), 'r': -s.r, 'v': s.v}}), 'DESC')[1] AS best FROM fold)
  WHERE best.g > 0)
SELECT target_class, gen, pick, rank, len(have) AS covered FROM fold"""


def redundancy_filter(spark: SparkSession, sf: str) -> DataFrame:
    return greedy.first_to_add(_sets(spark, sf), GROUP, "rank", "covered")


SQL["redundancy_filter"] = f"""WITH {_SETS_SQL}, each AS (SELECT target_class, gen, rank, unnest(covered) AS item FROM sets)
SELECT target_class, gen, rank, count(*) AS adds FROM each e
WHERE NOT EXISTS (SELECT 1 FROM each o WHERE o.target_class = e.target_class AND o.gen IS NOT DISTINCT FROM e.gen AND o.item = e.item AND o.rank < e.rank) GROUP BY 1, 2, 3"""


def combined_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """What a population covers together, and what none of it covers."""
    s = _sets(spark, sf)
    each = s.select(*GROUP, F.explode("covered").alias("item"), F.lit(1).alias("yes")).unionAll(s.select(*GROUP, F.explode("uncovered").alias("item"), F.lit(0).alias("yes")))
    per = each.groupBy(*GROUP, "item").agg(F.max("yes").alias("yes"))
    return per.groupBy(*GROUP).agg(F.sum("yes").alias("covered"), F.count_if(F.col("yes") == 0).alias("never_covered"), F.round(F.avg("yes"), 4).alias("completeness"))


SQL["combined_coverage"] = f"""WITH {_SETS_SQL},
each AS (SELECT target_class, gen, unnest(covered) AS item, 1 AS yes FROM sets UNION ALL SELECT target_class, gen, unnest(uncovered), 0 FROM sets),
per AS (SELECT target_class, gen, item, max(yes) AS yes FROM each GROUP BY 1, 2, 3)
SELECT target_class, gen, sum(yes) AS covered, count(*) FILTER (WHERE yes = 0) AS never_covered, round(avg(yes), 4) AS completeness FROM per GROUP BY 1, 2"""


def common_uncovered(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures that neither of the two fittest suites covers."""
    s = _sets(spark, sf).filter("rank <= 2")
    two = s.groupBy(*GROUP).agg(F.max(F.when(F.col("rank") == 1, F.col("uncovered"))).alias("x"), F.max(F.when(F.col("rank") == 2, F.col("uncovered"))).alias("y"))
    return two.select(*GROUP, F.explode(F.array_intersect("x", "y")).alias("item"))


SQL["common_uncovered"] = f"""WITH {_SETS_SQL}, each AS (SELECT target_class, gen, rank, unnest(uncovered) AS item FROM sets WHERE rank <= 2)
SELECT target_class, gen, item FROM each GROUP BY 1, 2, 3 HAVING count(*) = 2"""


def _best_of_generation(spark: SparkSession, sf: str) -> DataFrame:
    r = newest_reports(spark, sf, "project", "target_class", "gen", "fitness").filter("target_class IS NOT NULL AND gen IS NOT NULL AND project IS NOT NULL")
    value = F.when(F.isnan("fitness"), None).otherwise(F.col("fitness"))
    return r.groupBy("project", "target_class", "gen").agg(F.max_by("report_id", F.struct(F.coalesce(value, F.lit(-1.0)), "report_id")).alias("report_id"), F.count(F.lit(1)).alias("reports"))


_BEST_OF_SQL = NEWEST_SQL + """,
best_of AS (
  SELECT project, target_class, gen, arg_max(report_id, (CASE WHEN fitness IS NULL OR isnan(fitness) THEN -1.0 ELSE fitness END, report_id)) AS report_id, count(*) AS reports
  FROM newest WHERE target_class IS NOT NULL AND gen IS NOT NULL AND project IS NOT NULL GROUP BY 1, 2, 3)"""


def _known_classes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "class_state").filter("project IS NOT NULL AND class_name IS NOT NULL").groupBy("project", F.col("class_name").alias("target_class")).agg(F.max("last_generation").alias("last_generation"))


def missing_classes_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """For each known class and each generation up to its last, the best report of it or of the nearest earlier one."""
    best = _best_of_generation(spark, sf)
    grid = _known_classes(spark, sf).filter("last_generation >= 1").select("project", "target_class", F.explode(F.sequence(F.lit(1), "last_generation")).alias("gen"))
    w = Window.partitionBy("project", "target_class").orderBy("gen")
    filled = grid.join(best.select("project", "target_class", "gen", "report_id"), ["project", "target_class", "gen"], "left")
    seen = F.last(F.when(F.col("report_id").isNotNull(), F.struct("gen", "report_id")), ignorenulls=True).over(w)
    return filled.withColumn("_s", seen).select("project", "target_class", "gen", F.col("_s.report_id").alias("report_id"), F.col("_s.gen").alias("taken_from"))


_KNOWN_SQL = "known AS (SELECT DISTINCT project, class_name AS target_class, last_generation FROM class_state WHERE project IS NOT NULL AND class_name IS NOT NULL)"
SQL["missing_classes_backfill"] = f"""WITH {_BEST_OF_SQL}, {_KNOWN_SQL},
grid AS (SELECT project, target_class, unnest(range(1, last_generation + 1)) AS gen FROM known WHERE last_generation >= 1)
SELECT g.project, g.target_class, g.gen, arg_max(b.report_id, b.gen) AS report_id, max(b.gen) AS taken_from
FROM grid g LEFT JOIN best_of b ON b.project = g.project AND b.target_class = g.target_class AND b.gen <= g.gen AND b.gen >= 1 GROUP BY 1, 2, 3"""


def latest_report_asof(spark: SparkSession, sf: str) -> DataFrame:
    """The best report of the latest generation of a class that is not after its state's last generation."""
    best = _best_of_generation(spark, sf)
    k = _known_classes(spark, sf)
    on = (k.project == best.project) & (k.target_class == best.target_class) & (best.gen <= k.last_generation)
    return k.join(best, on).groupBy(k.project, k.target_class).agg(F.max("gen").alias("gen"), F.max_by("report_id", "gen").alias("report_id"))


SQL["latest_report_asof"] = f"""WITH {_BEST_OF_SQL}, {_KNOWN_SQL}
SELECT k.project, k.target_class, max(b.gen) AS gen, arg_max(b.report_id, b.gen) AS report_id
FROM known k JOIN best_of b ON b.project = k.project AND b.target_class = k.target_class AND b.gen <= k.last_generation GROUP BY 1, 2"""


def _completeness(spark: SparkSession, sf: str) -> DataFrame:
    k = _known_classes(spark, sf).filter("last_generation >= 1")
    expected = k.select("project", "target_class", F.explode(F.sequence(F.lit(1), "last_generation")).alias("gen"))
    have = _best_of_generation(spark, sf).select("project", "target_class", "gen", F.lit(True).alias("have"))
    both = expected.join(have, ["project", "target_class", "gen"], "left")
    return both.groupBy("project", "gen").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("have").isNull()).alias("missing")).withColumn("complete", F.col("missing") == 0)


_COMPLETE_SQL = f"""{_BEST_OF_SQL}, {_KNOWN_SQL},
expected AS (SELECT project, target_class, unnest(range(1, last_generation + 1)) AS gen FROM known WHERE last_generation >= 1),
complete AS (
  SELECT e.project, e.gen, count(*) AS expected, count(*) FILTER (WHERE b.report_id IS NULL) AS missing, count(*) FILTER (WHERE b.report_id IS NULL) = 0 AS complete
  FROM expected e LEFT JOIN best_of b ON b.project = e.project AND b.target_class = e.target_class AND b.gen = e.gen GROUP BY 1, 2)"""


def generation_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return _completeness(spark, sf)


SQL["generation_completeness"] = f"WITH {_COMPLETE_SQL} SELECT * FROM complete"


def latest_complete_generation(spark: SparkSession, sf: str) -> DataFrame:
    """Per project the last generation of which nothing is missing (null: none), and the one that misses least."""
    return _completeness(spark, sf).groupBy("project").agg(
        F.max(F.when(F.col("complete"), F.col("gen"))).alias("complete_gen"), F.min_by("gen", F.struct("missing", "gen")).alias("fullest_gen")
    )


SQL["latest_complete_generation"] = f"WITH {_COMPLETE_SQL} SELECT project, max(gen) FILTER (WHERE complete) AS complete_gen, arg_min(gen, (missing, gen)) AS fullest_gen FROM complete GROUP BY 1"


def _by_kind(spark: SparkSession, sf: str) -> DataFrame:
    r = newest_reports(spark, sf, "project", "target_class", "gen", "test_class").filter("project IS NOT NULL AND target_class IS NOT NULL AND gen IS NOT NULL")
    k = names.kind(test_class_name(F.col("test_class")))
    return r.groupBy("project", "target_class", "gen").agg(
        F.count_if(k == "base").alias("base"), F.count_if(k == "crossover").alias("crossovers"), F.count_if(k == "mutation").alias("mutations"), F.count(F.lit(1)).alias("suites")
    )


_KIND_SQL = NEWEST_SQL + rf""",
kinds AS (SELECT project, target_class, gen, CASE WHEN contains(name, '_Crossover_') THEN 'crossover' WHEN contains(name, '_Mutation_') THEN 'mutation' WHEN regexp_matches(name, 'TestV[0-9]+$') THEN 'base' ELSE 'other' END AS k
  FROM (SELECT *, {_NAME_SQL} AS name FROM newest) WHERE project IS NOT NULL AND target_class IS NOT NULL AND gen IS NOT NULL),
by_kind AS (SELECT project, target_class, gen, count(*) FILTER (WHERE k = 'base') AS base, count(*) FILTER (WHERE k = 'crossover') AS crossovers, count(*) FILTER (WHERE k = 'mutation') AS mutations, count(*) AS suites FROM kinds GROUP BY 1, 2, 3)"""


def resume_step(spark: SparkSession, sf: str) -> DataFrame:
    """How many pairs a class and generation should have joined by what it has, and what is left to be done."""
    expected = F.when(F.col("base") >= 10, F.lit(5)).otherwise(F.least(F.floor(F.col("base") / 2), F.lit(3))).cast("long")
    step = (
        F.when(F.col("crossovers") == 0, "join pairs").when(F.col("crossovers") < F.col("expected_pairs"), "join more pairs")
        .when(F.col("mutations") == 0, "mutate").otherwise("select")
    )
    return _by_kind(spark, sf).withColumn("expected_pairs", expected).withColumn("step", step)


SQL["resume_step"] = f"""WITH {_KIND_SQL}, pairs AS (SELECT *, (CASE WHEN base >= 10 THEN 5 ELSE least(floor(base / 2), 3) END)::BIGINT AS expected_pairs FROM by_kind)
SELECT *, CASE WHEN crossovers = 0 THEN 'join pairs' WHEN crossovers < expected_pairs THEN 'join more pairs' WHEN mutations = 0 THEN 'mutate' ELSE 'select' END AS step FROM pairs"""


def state_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Stored and observed states of classes side by side; what is observed wins."""
    seen = _by_kind(spark, sf).groupBy("project", "target_class").agg(F.max("gen").alias("seen_gen"), F.sum("suites").alias("suites"))
    s = _known_classes(spark, sf).withColumnRenamed("last_generation", "stored_gen")
    both = s.join(seen, ["project", "target_class"], "full_outer")
    source = F.when(F.col("seen_gen").isNull(), "stored only").when(F.col("stored_gen").isNull(), "seen only").when(F.col("seen_gen") == F.col("stored_gen"), "same").otherwise("differs")
    return both.select("project", "target_class", F.coalesce("seen_gen", "stored_gen").alias("gen"), "stored_gen", "suites", source.alias("source"))


SQL["state_reconcile"] = f"""WITH {_KIND_SQL}, {_KNOWN_SQL}, seen AS (SELECT project, target_class, max(gen) AS seen_gen, sum(suites) AS suites FROM by_kind GROUP BY 1, 2)
SELECT coalesce(k.project, s.project) AS project, coalesce(k.target_class, s.target_class) AS target_class, coalesce(seen_gen, last_generation) AS gen, last_generation AS stored_gen, suites,
  CASE WHEN s.project IS NULL THEN 'stored only' WHEN k.project IS NULL OR last_generation IS NULL THEN 'seen only' WHEN seen_gen = last_generation THEN 'same' ELSE 'differs' END AS source
FROM known k FULL JOIN seen s ON k.project = s.project AND k.target_class = s.target_class"""


def class_status(spark: SparkSession, sf: str) -> DataFrame:
    """How many suites the last generation of each class has: too few, usual or many."""
    by = _by_kind(spark, sf).groupBy("project", "target_class").agg(F.max_by("suites", "gen").alias("suites"), F.max("gen").alias("gen"))
    return by.withColumn("status", F.when(F.col("suites") < 2, "few").when(F.col("suites") > 15, "many").otherwise("usual"))


SQL["class_status"] = f"""WITH {_KIND_SQL}, last AS (SELECT project, target_class, arg_max(suites, gen) AS suites, max(gen) AS gen FROM by_kind GROUP BY 1, 2)
SELECT *, CASE WHEN suites < 2 THEN 'few' WHEN suites > 15 THEN 'many' ELSE 'usual' END AS status FROM last"""

QUERIES = {name: globals()[name] for name in SQL}
