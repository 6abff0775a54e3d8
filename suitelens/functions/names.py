"""What names of suites, methods and signatures say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def class_under_test(name: Column) -> Column:
    """AbcTestV3, AbcTest_Crossover_Gen2_4x8, AbcTest_Mutation_Gen2_V11, AbcTest: Abc; null for other names."""
    return _or_null(F.regexp_extract(name, r"^([A-Za-z0-9_]+?)Test(?:V[0-9]+|_Crossover_Gen[0-9]+_[0-9]+x[0-9]+|_Mutation_Gen[0-9]+_V[0-9]+)?$", 1))


def class_before_test(name: Column) -> Column:
    """What stands before the first 'Test'."""
    return _or_null(F.regexp_extract(name, r"^([A-Za-z0-9_]+?)Test", 1))


def class_without_test(name: Column) -> Column:
    return F.replace(name, F.lit("Test"), F.lit(""))


def kind(name: Column) -> Column:
    return (
        F.when(F.contains(name, F.lit("_Crossover_")), "crossover")
        .when(F.contains(name, F.lit("_Mutation_")), "mutation")
        .when(name.rlike(r"TestV[0-9]+$"), "base")
        .otherwise("other")
    )


def version(name: Column) -> Column:
    return _or_null(F.regexp_extract(name, r"V([0-9]+)$", 1)).cast("int")


def generation(name: Column) -> Column:
    return _or_null(F.regexp_extract(name, r"_Gen([0-9]+)_", 1)).cast("int")


def pair(name: Column) -> tuple[Column, Column]:
    """The two parents of a crossover, the smaller number first."""
    a = _or_null(F.regexp_extract(name, r"_([0-9]+)x[0-9]+$", 1)).cast("int")
    b = _or_null(F.regexp_extract(name, r"_[0-9]+x([0-9]+)$", 1)).cast("int")
    return F.least(a, b), F.greatest(a, b)


def method_name(signature: Column) -> Column:
    """The name of ``name(descriptor)returned``."""
    return F.substring_index(signature, "(", 1)


def parameter_types(signature: Column) -> Column:
    """The parameters of a JVM descriptor, each as it stands there."""
    inside = F.regexp_extract(signature, r"\(([^)]*)\)", 1)
    return F.regexp_extract_all(inside, F.lit(r"(\[*(?:L[^;]+;|[BCDFIJSZ]))"), F.lit(1))


def return_type(signature: Column) -> Column:
    return F.substring_index(signature, ")", -1)


# Primitive types of JVM descriptors.
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}


def readable_type(descriptor: Column) -> Column:
    """[[I as int[][], Ljava/util/List; as List."""
    base = F.regexp_replace(descriptor, r"^\[+", "")
    named = F.create_map(*(F.lit(x) for kv in PRIMITIVES.items() for x in kv))
    simple = F.when(base.startswith("L"), F.regexp_replace(F.regexp_replace(base, r"^L(?:.*/)?", ""), ";$", "")).otherwise(named[base])
    return F.concat(simple, F.repeat(F.lit("[]"), F.length(descriptor) - F.length(base)))
