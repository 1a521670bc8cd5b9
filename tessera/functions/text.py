"""Text clean-up as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .patterns import BACKTICKS
from .paths import _col


def strip_ts_comments(body) -> Column:
    """Whichever of // and /* comes first decides; an open /* takes the rest."""
    return F.regexp_replace(_col(body), r"(?s)/\*.*?\*/|//[^\n]*|/\*.*$", "")


def strip_python_comments(body) -> Column:
    """Triple-quoted spans become their line ends; then # to the end of each line."""

    def quoted(text: Column, mark: str) -> Column:
        # the pieces at odd places are inside; a last open one takes the rest
        parts = F.split(text, mark, -1)
        return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, p).when(i == F.size(parts) - 1, F.lit("")).otherwise(F.regexp_replace(p, r"[^\n]", ""))), "")

    return F.regexp_replace(quoted(quoted(_col(body), '"""'), "'''"), r"#[^\n]*", "")


def strip_backticks(text) -> Column:
    return F.regexp_replace(_col(text), BACKTICKS, "")


@F.pandas_udf(StringType())
def _blank_quoted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import re

    line = re.compile(r'[^"\n]+|"((?:\\[^\n]|[^"\\\n])*)("?)|\n')
    ticks = re.compile(r"`[^`]*`", re.S)
    hide = lambda m: m.group(0) if m.group(1) is None else '"' + re.sub(r'[^\\\n]|(?<=\\)\\', " ", m.group(1)) + m.group(2)
    for s in batches:
        yield s.map(lambda t: ticks.sub(lambda m: re.sub(r"[^\n]", " ", m.group(0)), line.sub(hide, t)), na_action="ignore")


def hide_quoted(text) -> Column:
    """Blanks for what stands in double quotes (within a line, \\ escapes) and in backticks (across lines)."""
    return _blank_quoted(_col(text))


def lines(body) -> Column:
    """Lines without their ends, blank ones dropped."""
    return F.filter(F.split(F.regexp_replace(_col(body), "\r\n", "\n"), "\n", -1), lambda x: x != "")


def added_lines(hunk) -> Column:
    """What a unified diff adds."""
    plus = F.filter(F.split(_col(hunk), "\n", -1), lambda x: x.startswith("+") & ~x.startswith("+++"))
    return F.array_join(F.transform(plus, lambda x: F.substring(x, 2, 1 << 30)), "\n")
