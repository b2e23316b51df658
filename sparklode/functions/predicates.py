"""Conditions of a request as columns. All are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, SparkSession, functions as F

from ..plans.request import Matcher, QueryRequest
from .regex import checked


def ascii_lower(column: Column) -> Column:
    """A to Z only: case is folded for ASCII, and other letters keep theirs."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def lowered(keyword: str) -> str:
    return keyword.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def matches(spark: SparkSession, matcher: Matcher, labels: Column) -> Column | None:
    """= never holds for a missing label, != always does; to patterns a missing label is empty; patterns aren't anchored."""
    value = labels[F.lit(matcher.name)]
    if matcher.type in ("", "="):
        return value == matcher.value
    if matcher.type == "!=":
        return ~value.eqNullSafe(F.lit(matcher.value))
    if matcher.type in ("=~", "!~"):
        found = F.coalesce(value, F.lit("")).rlike(checked(spark, matcher.value))
        return found if matcher.type == "=~" else ~found
    return None


def condition(spark: SparkSession, request: QueryRequest) -> Column:
    """All conditions of a request on timestamp, line and labels; true without any."""
    found = []
    if request.start:
        found.append(F.col("timestamp") >= request.start)
    if request.end:
        found.append(F.col("timestamp") <= request.end)
    found += [c for m in request.matchers if (c := matches(spark, m, F.col("labels"))) is not None]
    if request.line:
        found.append(F.contains(ascii_lower(F.col("line")), F.lit(lowered(request.line))))
    return reduce(Column.__and__, found) if found else F.lit(True)
