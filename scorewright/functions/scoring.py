"""Points of one answer under a fixed-answer rule, as column expressions.

``selected`` and ``correct`` are arrays of option ids (repeats count once); points
are doubles; ``low`` is the question's least score, at most 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def set_counts(selected: Column, correct: Column) -> tuple[Column, Column, Column]:
    """Hits, wrong picks and missed options."""
    picked, key = F.array_distinct(selected), F.array_distinct(correct)
    return (
        F.size(F.array_intersect(picked, key)),
        F.size(F.array_except(picked, key)),
        F.size(F.array_except(key, picked)),
    )


def choice_points(
    selected: Column,
    correct: Column,
    high: Column,
    low: Column,
    single: Column,
    partial: Column,
    wrong_penalty: Column,
    negative: Column,
) -> Column:
    """Choice rule.

    With one pick allowed the key lists acceptable options; otherwise the sets must be
    equal.  Without a hit a negative mark, if any, is given as it is (an empty pick
    included); partial credit pays hits and charges wrong picks.
    """
    hits, wrong, missed = set_counts(selected, correct)
    full = ((wrong == 0) & (missed == 0)) | (single & (hits > 0))
    shared = F.coalesce(F.try_divide(high * hits, F.size(F.array_distinct(correct)).cast("double")), F.lit(0.0))
    return (
        F.when(full, high)
        .when((hits == 0) & negative.isNotNull(), F.least(negative, high))
        .when(partial, clamp(shared - wrong_penalty * wrong, low, high))
        .otherwise(clamp(F.lit(0.0), low, high))
    )


def per_option_points(selected: Column, correct: Column, ratios: Column, high: Column, low: Column) -> Column:
    """Table rule: the share of the points by number of options decided wrongly; a blank pays nothing."""
    _, wrong, missed = set_counts(selected, correct)
    share = F.coalesce(F.get(ratios, wrong + missed), F.lit(0.0))
    return clamp(F.when(F.size(selected) == 0, F.lit(0.0)).otherwise(share * high), low, high)


def true_false_points(value: Column, correct: Column, high: Column, low: Column, negative: Column) -> Column:
    return (
        F.when(value == correct, high)
        .when(negative.isNotNull(), F.least(negative, high))
        .otherwise(clamp(F.lit(0.0), low, high))
    )


def blanks_points(matched: Column, high: Column, low: Column, all_or_nothing: Column) -> Column:
    """Fill-in rule over array<struct<matched boolean, weight double>>.

    All-or-nothing compares counts of blanks, not sums of weights, so rounding cannot
    fail a fully right answer.
    """
    total = F.aggregate(matched, F.lit(0.0), lambda s, b: s + b["weight"])
    got = F.aggregate(matched, F.lit(0.0), lambda s, b: s + F.when(b["matched"], b["weight"]).otherwise(0.0))
    every = F.forall(matched, lambda b: b["matched"])
    share = F.coalesce(F.try_divide(high * got, total), F.lit(0.0))
    return clamp(F.when(all_or_nothing, F.when(every, high).otherwise(0.0)).otherwise(share), low, high)


def matching_points(given: Column, expected: Column, high: Column, low: Column, wrong_penalty: Column, all_or_nothing: Column) -> Column:
    """Pair rule over maps left -> right: only the key's left ids count, and an absent pair is not wrong."""
    pairs = F.map_entries(expected)
    right = F.size(F.filter(pairs, lambda p: F.coalesce(F.try_element_at(given, p["key"]) == p["value"], F.lit(False))))
    wrong = F.size(F.filter(pairs, lambda p: F.coalesce(F.try_element_at(given, p["key"]) != p["value"], F.lit(False))))
    total = F.size(pairs)
    share = F.coalesce(F.try_divide(high * right, total.cast("double")), F.lit(0.0)) - wrong_penalty * wrong
    return clamp(F.when(all_or_nothing, F.when(right == total, high).otherwise(0.0)).otherwise(share), low, high)


def nearest_level(levels: Column, given: Column) -> Column:
    """The level nearest to ``given``; the higher one of two equally near."""
    best = F.array_min(F.transform(levels, lambda p: F.struct(F.abs(p - given).alias("far"), (-p).alias("down"))))
    return -best["down"]


def percent_or_null(awarded: Column, most: Column) -> Column:
    return F.when(most > 0, F.try_divide(100.0 * awarded, most))


def percent_or_zero(awarded: Column, most: Column) -> Column:
    return F.coalesce(percent_or_null(awarded, most), F.lit(0.0))
