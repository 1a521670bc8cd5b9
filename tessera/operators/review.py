"""What a language-model review is given: the documents that a change cites, within a budget of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.patterns import LINK, SCHEME

# Fixed values.
CITED_BYTES, HUNK_BYTES, LEAST_BYTES, MOST_CITED = 4096, 2048, 512, 2
LEFT_OUT = "\n... [truncated] ...\n"
FROM_ROOT = ["agents/", "design/", "docs/", "frontend/", "rill/", "rill-clickhouse/", "tools/"]


def trim_bytes(text, most) -> Column:
    """A text of more than ``most`` bytes loses its middle: the first and last half of ``most`` bytes stay.
    A letter that a cut would split goes whole."""
    text, most = (F.col(text) if isinstance(text, str) else text), (F.lit(most) if isinstance(most, int) else most)
    b = F.encode(text, "UTF-8")
    size, half = F.octet_length(b), F.floor(most / 2).cast("int")
    within = lambda at: F.hex(F.substring(b, at, F.lit(1))).rlike("^[89AB]")  # noqa: E731  a letter goes on here
    end = F.coalesce(*[F.when(~within(half - i + 1), half - i) for i in range(4)], half)
    begin = F.coalesce(*[F.when(~within(size - half + 1 + i), size - half + 1 + i) for i in range(4)], size - half + 1)
    # a begin past the end (no half at all) gives an empty tail
    head, tail = F.substring(b, F.lit(1), end), F.substring(b, begin, half)
    return F.when(size <= most, text).otherwise(F.concat(F.decode(head, "UTF-8"), F.lit(LEFT_OUT), F.decode(tail, "UTF-8")))


def cited_targets(source, hunk) -> Column:
    """The first two Markdown files that the added lines of a hunk link to, as paths of the repository."""
    source = F.col(source) if isinstance(source, str) else source
    hunk = F.col(hunk) if isinstance(hunk, str) else hunk
    lines = F.filter(F.split(F.regexp_replace(hunk, "\r\n", "\n"), "\n", -1), lambda x: x.startswith("+") & ~x.startswith("+++"))
    added = F.array_join(F.transform(lines, lambda x: F.substring(x, 2, 1 << 30)), "\n")
    links = F.filter(F.regexp_extract_all(added, F.lit(LINK), 1), lambda x: (x != "") & ~x.rlike(SCHEME))
    rooted = lambda x: F.lit(False) if not FROM_ROOT else x.rlike("^(?:" + "|".join(p.replace("-", r"\-") for p in FROM_ROOT) + ")")
    paths = F.transform(links, lambda x: F.when(rooted(x), x).otherwise(P.clean(F.concat(P.dirname(source), F.lit("/"), x))))
    return F.slice(F.array_distinct(F.filter(paths, lambda x: x.endswith(".md"))), 1, MOST_CITED)


def context(changes: DataFrame, files: DataFrame) -> DataFrame:
    """path, hunk, cited, context of changes (path, hunk), one row to a path: the trimmed hunk, what it cites,
    and the cited files that are there (path, body), the budget shared among them.

    The second gets what the first has left, halved as well, but never less than the least share;
    nothing once the budget is used up."""
    rows = changes.select("path", trim_bytes("hunk", HUNK_BYTES).alias("hunk")).withColumn("cited", cited_targets("path", "hunk"))
    at = rows.select("path", F.size("cited").alias("n"), F.posexplode("cited").alias("place", "target"))
    bodies = at.join(files.select(F.col("path").alias("target"), "body").where("body IS NOT NULL"), "target")
    both = bodies.groupBy("path", "n").agg(*[F.max(F.when(F.col("place") == i, F.struct("target", "body"))).alias(f"f{i}") for i in range(MOST_CITED)])
    left, parts = F.lit(CITED_BYTES), []
    out = both
    for i in range(MOST_CITED):
        share = F.greatest(F.floor(left / F.col("n")).cast("int"), F.lit(LEAST_BYTES))
        out = out.withColumn(f"s{i}", F.when(left > 0, trim_bytes(F.col(f"f{i}.body"), share)))
        left = left - F.coalesce(F.octet_length(f"s{i}"), F.lit(0))
        parts.append(F.concat(F.lit("# "), F.col(f"f{i}.target"), F.lit("\n"), F.col(f"s{i}")))
    text = out.select("path", F.concat_ws("\n\n", *parts).alias("context"))
    return rows.join(text, "path", "left").select("path", "hunk", "cited", F.coalesce("context", F.lit("")).alias("context"))
