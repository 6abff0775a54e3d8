"""Column expressions of scores: percentages, fitness, penalties, rates, similarity of sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(covered: Column, total: Column) -> Column:
    """covered / total * 100 to two places; 0 where there is nothing to cover."""
    return F.when(total > 0, F.round(covered / total * 100, 2)).otherwise(F.lit(0.0))


# Steps of the bonus for the coverage score, highest first.
BONUS = ((0.95, 0.3), (0.9, 0.2), (0.8, 0.15), (0.7, 0.1), (0.6, 0.05))


def bonus(score: Column) -> Column:
    out = F.lit(0.0)
    for least, value in reversed(BONUS):
        out = F.when(score >= least, F.lit(value)).otherwise(out)
    return out


def failure_penalty(failures: Column, tests: Column, failed: Column) -> Column:
    """A twentieth of the share of failures; a twentieth for a failed run without tests."""
    return F.when(tests > 0, F.least(F.lit(0.05), failures / tests * 0.05)).when(failed, F.lit(0.05)).otherwise(F.lit(0.0))


def time_penalty(seconds: Column) -> Column:
    return F.least(F.lit(0.02), seconds / 30.0)


def ratio(covered: Column, total: Column) -> Column:
    """covered / total; 0 where there is nothing to cover."""
    return F.when(total > 0, covered / total).otherwise(F.lit(0.0))


def fitness(line: Column, branch: Column, method: Column, failure: Column, time: Column) -> Column:
    """0.5 line + 0.4 branch + 0.1 method coverage (as fractions), plus the bonus, less the penalties, never negative; halves go up."""
    base = 0.5 * line + 0.4 * branch + 0.1 * method
    return F.greatest(F.round(base + bonus(base) - failure - time + 1e-9, 4), F.lit(0.0))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |a and b| / |a or b|; 0 if both are empty or null, 1 if one is."""
    a, b = F.coalesce(a, F.array()), F.coalesce(b, F.array())
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(1.0 - F.size(F.array_intersect(a, b)) / both)


def token_distance(a: Column, b: Column) -> Column:
    """``jaccard_distance`` of words; 1 as soon as either has none."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(1.0)).otherwise(jaccard_distance(a, b))


def diversity(meaning: Column, methods: Column, paths: Column) -> Column:
    """0.4 of the distance in meaning, 0.3 of that of covered methods and 0.3 of that of covered paths."""
    return 0.4 * meaning + 0.3 * methods + 0.3 * paths


def decayed_rate(generation: Column, low: float = 0.1, high: float = 0.3, decay: float = 0.1) -> Column:
    """A rate that falls from ``high`` in the first generation towards ``low``."""
    return F.lit(low) + F.lit(high - low) * F.exp(-F.lit(decay) * (generation - 1))


def fitness_rate(generation: Column, value: Column, low: float = 0.1, high: float = 0.3) -> Column:
    """The decayed rate, halved from a fitness of 0.8 and raised by a fifth up to 0.3, between ``low`` and 1.2 ``high``."""
    base = decayed_rate(generation, low, high)
    own = F.when(value >= 0.8, 0.5 * base).when(value <= 0.3, 1.2 * base).otherwise(base)
    return F.greatest(F.lit(low), F.least(own, F.lit(high * 1.2)))
