"""Similarity of two field values as column expressions, with a registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Similarity = Callable[..., Column]
REGISTRY: dict[str, Similarity] = {}


def register(name: str) -> Callable[[Similarity], Similarity]:
    """Add a similarity under ``name``; a second one of the same name is an error."""

    def add(fn: Similarity) -> Similarity:
        if name in REGISTRY:
            raise ValueError(f"similarity {name} exists")
        REGISTRY[name] = fn
        return fn

    return add


def similarity(name: str) -> Similarity:
    if name not in REGISTRY:
        raise ValueError(f"unknown similarity {name}; known: {sorted(REGISTRY)}")
    return REGISTRY[name]


@register("set_intersection")
def set_intersection(f: Column, g: Column) -> Column:
    """Number of distinct values that two sets share."""
    return F.size(F.array_intersect(f, g)).cast("double")


@register("boolean")
def boolean(f: Column, g: Column, any_value: bool = False) -> Column:
    """1 if the sets are equal (``any_value``: if they share a value), else 0."""
    same = F.arrays_overlap(f, g) if any_value else F.array_sort(F.array_distinct(f)) == F.array_sort(F.array_distinct(g))
    return F.coalesce(same, F.lit(False)).cast("double")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_pair(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one of them is a zero vector."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, _dot(a, b) / norm).otherwise(0.0)


@register("cosine")
def cosine(f: Column, g: Column, thresh: float = 0.0) -> Column:
    """Largest cosine between a vector of one set and one of the other, 0 unless above ``thresh``."""
    best = F.array_max(F.flatten(F.transform(f, lambda a: F.transform(g, lambda b: cosine_pair(a, b)))))
    return F.when(best > thresh, best).otherwise(0.0)


def mean_of(f: Column) -> Column:
    return F.aggregate(f, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(f)


@register("gaussian")
def gaussian(f: Column, g: Column, thresh: float = 0.0) -> Column:
    """exp(-(difference of the means) squared), 0 unless above ``thresh``; empty sets are similar to nothing."""
    some = (F.size(f) > 0) & (F.size(g) > 0)
    v = F.when(some, F.exp(-F.pow(mean_of(f) - mean_of(g), F.lit(2.0)))).otherwise(0.0)
    return F.when(v > thresh, v).otherwise(0.0)


@register("levenshtein")
def levenshtein(f: Column, g: Column, thresh: float = 0.0) -> Column:
    """Largest 1 - edit distance / longer length between a text of one set and one of the other, 0 unless above ``thresh``."""

    def one(a: Column, b: Column) -> Column:
        longest = F.greatest(F.length(a), F.length(b))
        return F.when(longest > 0, 1.0 - F.levenshtein(a, b) / longest).otherwise(1.0)

    best = F.array_max(F.flatten(F.transform(f, lambda a: F.transform(g, lambda b: one(a, b)))))
    return F.when(best > thresh, best).otherwise(0.0)
