"""Ordered and scored rule tables, compiled to expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, Sequence[str]]  # label, parts of which one must occur


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit |= F.contains(text, F.lit(p))
    return hit


def first_match(text: Column, rules: Sequence[Rule], default: str | None) -> Column:
    """The label of the first rule of which a part occurs in ``text``; ``default`` for none and for null."""
    out = F.lit(default)
    for label, parts in reversed(rules):
        out = F.when(contains_any(text, parts), F.lit(label)).otherwise(out)
    return out


def best_scored(text: Column, rules: Sequence[tuple[str, Sequence[str], float]], default: str) -> Column:
    """The label with the highest score: parts that occur, plus the rule's bonus; the earlier rule wins ties."""
    scored = []
    for i, (label, parts, extra) in enumerate(rules):
        hits = sum((F.contains(text, F.lit(p)).cast("int") for p in parts), F.lit(0))
        scored.append(F.when(hits > 0, F.struct((hits + F.lit(float(extra))).alias("s"), F.lit(-i).alias("o"), F.lit(label).alias("l"))))
    return F.coalesce(F.greatest(*scored).getField("l"), F.lit(default))


def sql_first_match(text: str, rules: Sequence[Rule], default: str | None) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains({text}, {quoted(p)})' for p in parts)} THEN {quoted(label)}" for label, parts in rules)
    return f"CASE {cases} ELSE {'NULL' if default is None else quoted(default)} END"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
