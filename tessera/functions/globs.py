"""Globs as regular expressions: '**/' any directories, '**' anything, '*' and '?' within a name."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKENS = re.compile(r"\*\*/|\*\*|\*|\?|.", re.S)
_MEANING = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def glob_to_regex(pattern: str) -> str:
    """Brackets pass through, so [ab] is a class."""
    parts = [_MEANING.get(t) or (t if t in "[]" else re.sub(r"([.+^$(){}|\\])", r"\\\1", t)) for t in _TOKENS.findall(pattern)]
    return f"^{''.join(parts)}$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Literal patterns, so each is compiled once a task."""
    return reduce(lambda a, b: a | b, [path.rlike(glob_to_regex(p)) for p in patterns], F.lit(False))


def triggered(paths: DataFrame, patterns: list[str], *keys: str) -> DataFrame:
    """keys, position, glob: those of the patterns that match a path at all, in the order of the list.

    One scan; a flag for each pattern, combined before the shuffle. A null path matches nothing."""
    at = F.element_at(F.array(*map(F.lit, patterns)), F.col("position") + 1) if patterns else F.lit("")
    if not patterns:
        return paths.select(*keys, F.lit(0).alias("position"), at.alias("glob")).where("false")
    flags = [F.coalesce(F.bool_or(F.col("path").rlike(glob_to_regex(p))), F.lit(False)) for p in patterns]
    hit = paths.groupBy(*keys).agg(F.array(*flags).alias("hits")).select(*keys, F.posexplode("hits").alias("position", "hit")).where("hit")
    return hit.select(*keys, "position", at.alias("glob"))
