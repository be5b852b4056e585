"""Tag matchers as predicates over a metric's searchable tags.

A matcher holds if some intrinsic or meta tag with its key fits; external tags are never searched. That
goes for the negative kinds too: a metric without the key matches neither a matcher nor its negation.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidestore.model import Match, TagMatcher

_OUTSIDE_RE2 = (
    (re.compile(r"\\[1-9]"), "a backreference"),
    (re.compile(r"\\k<"), "a backreference"),
    (re.compile(r"\(\?(=|!|<=|<!|>)"), "a look-around or atomic group"),
    (re.compile(r"[*+?}]\+"), "a possessive quantifier"),
)
_CLASS_OR_ESCAPE = re.compile(r"\\Q.*?(\\E|$)|\\[^1-9k]|\[\^?\]?(?:\\.|[^\]\\])*\]", re.S)


def anchored(pattern: str) -> str:
    """``pattern`` for ``rlike`` so that it must match a whole value and its dot excludes newlines only.

    Constructs that a linear-time engine lacks are refused, and malformed patterns fail here rather than
    on an executor.
    """
    bare = _CLASS_OR_ESCAPE.sub("x", pattern)
    for construct, what in _OUTSIDE_RE2:
        if construct.search(bare):
            raise ValueError(f"pattern {pattern!r} holds {what}")
    try:
        re.compile(re.sub(r"\\[zQEpPC]|\(\?[a-zA-Z-]+[:)]|\[:\^?\w+:\]", "x", pattern))
    except re.error as e:
        raise ValueError(f"pattern {pattern!r}: {e}") from None
    return f"(?d)\\A(?:{pattern})\\z"


def _fits(matcher: TagMatcher, value: Column) -> Column:
    match matcher.type:
        case Match.EQUALS:
            return value == matcher.value
        case Match.NOT_EQUALS:
            return value != matcher.value
        case Match.EQUALS_REGEX:
            return value.rlike(anchored(matcher.value))
        case Match.NOT_EQUALS_REGEX:
            return ~value.rlike(anchored(matcher.value))
    raise ValueError(f"unknown kind of match: {matcher.type}")


def _checked(matchers: Sequence[TagMatcher] | None) -> Sequence[TagMatcher]:
    if matchers is None:
        raise TypeError("matchers are missing")
    if not matchers:
        raise ValueError("at least one matcher is needed")
    return matchers


def matches(matchers: Sequence[TagMatcher], intrinsic: str = "intrinsic", meta: str = "meta") -> Column:
    """Whether all matchers hold, each on any of a metric's searchable tags."""
    tags = F.concat(F.col(intrinsic), F.col(meta))
    return reduce(and_, (_any_tag(tags, m) for m in _checked(matchers)))


def _any_tag(tags: Column, matcher: TagMatcher) -> Column:
    return F.exists(tags, lambda t: t["key"].eqNullSafe(F.lit(matcher.key)) & _fits(matcher, t["value"]))


def find_metrics(metrics: DataFrame, matchers: Sequence[TagMatcher]) -> DataFrame:
    """The metrics (one row each, with tag arrays) that all matchers select."""
    return metrics.where(matches(matchers))


def find_keys(tags: DataFrame, matchers: Sequence[TagMatcher]) -> DataFrame:
    """Keys of the metrics that all matchers select, from tag rows, in one aggregation."""
    _checked(matchers)
    searchable = tags.where(F.col("tag_type").isin("intrinsic", "meta"))
    tests = [F.bool_or(F.col("tag_key").eqNullSafe(F.lit(m.key)) & _fits(m, F.col("tag_value"))).alias(f"_m{i}") for i, m in enumerate(matchers)]
    found = searchable.groupBy("metric_key").agg(*tests)
    return found.where(reduce(and_, (F.col(f"_m{i}") for i in range(len(matchers))))).select("metric_key")
