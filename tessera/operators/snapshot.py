"""Snapshots: hashes of files, a Merkle tree of directories, and what changed between two."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.patterns import C_STYLE, CODE_KINDS, HASH_STYLE, MARKDOWN
from .storage import keep

_BODY = {"inline": r"\[[^\]]*\]\(([^) \t\n\f\r]+)", "ref": r"^\[[^\]]+\]:[ \t\n\f\r]*([^ \t\n\f\r]+)"}

NOTHING = hashlib.sha256(b"").hexdigest()  # the root of no files


def kind_of(path) -> Column:
    e = P.lower_ext(path)
    return F.when(e.isin(MARKDOWN), "markdown").when(e.isin(".yml", ".yaml"), "yaml").when(e.isin(CODE_KINDS), "code").otherwise("other")


def code_hash(body: Column, comments: list[str]) -> Column:
    """SHA-256 without comments, with runs of blanks as one and blank lines dropped."""
    for pattern in comments:
        body = F.regexp_replace(body, pattern, "")
    body = F.regexp_replace(F.regexp_replace(body, r"[ \t]+", " "), r"\n[ \t\n\f\r]*\n", "\n")
    return F.sha2(F.regexp_replace(body, r"^[\s\x85\xa0]+|[\s\x85\xa0]+$", ""), 256)


def c_style_hash(body: Column) -> Column:
    return code_hash(body, [r"(?s)/\*.*?\*/", r"//[^\n]*"])


def hash_style_hash(body: Column) -> Column:
    return code_hash(body, [r"(?s)\"\"\".*?\"\"\"|'''.*?'''", r"#[^\n]*"])


def markdown_hash(body: Column) -> Column:
    """SHA-256 of what readers follow: front matter, headings, link targets, fences and their
    content. Prose drops out.

    The text is split before each fence line, so a part is code or prose by its number and the
    work is linear in the text."""
    front = F.regexp_extract(body, r"(?s)^---\r?\n(.*?)\n\r?---(?=\r|\n|$)", 1)
    has_front = body.rlike(r"(?s)^---\r?\n.*?\n\r?---(?=\r|\n|$)")
    rest = F.when(has_front, F.regexp_replace(body, r"(?s)^---\r?\n.*?\n\r?---(?:\r\n|\n)?", "")).otherwise(body)
    head = F.when(has_front & (front != ""), F.concat(F.lit("frontmatter:\n"), F.array_join(F.transform(F.split(front, "\n", -1), lambda x: F.concat(F.rtrim(x, F.lit(" \t")), F.lit("\n"))), ""))).otherwise("")
    # a last line end opens no line; the first line has a line end before it, as every other
    rest = F.concat(F.lit("\n"), F.regexp_replace(F.regexp_replace(rest, r"\r(?=\n|\z)", ""), r"\n\z", ""))
    parts = F.split(rest, r"\n(?=[ \t\x0B\f\r]*(?:```|~~~))", -1)

    def trimmed(x: Column) -> Column:
        return F.regexp_replace(x, r"^\s+|\s+$", "")

    def links(x: Column, pattern: str, label: str) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(pattern), 1), lambda t: F.concat(F.lit(label), t, F.lit("\n"))), "")

    def line(x: Column, inside: Column) -> Column:
        t = trimmed(x)
        heading = F.when(t.startswith("#"), F.concat(F.lit("heading:"), F.trim(F.regexp_replace(t, "^#+", "")), F.lit("\n"))).otherwise("")
        prose = F.concat(heading, links(x, _BODY["inline"], "link:"), links(x, _BODY["ref"], "reflink:"))
        return F.when(inside, F.concat(F.lit("code:"), F.rtrim(x, F.lit(" \t")), F.lit("\n"))).otherwise(prose)

    def part(x: Column, k: Column) -> Column:
        rows = F.split(x, "\n", -1)
        fence = F.when(k > 0, F.concat(F.lit("fence:"), F.trim(F.regexp_replace(trimmed(rows[0]), "^[`~]+", "")), F.lit("\n"))).otherwise("")
        return F.concat(fence, F.array_join(F.transform(F.slice(rows, F.lit(2), F.size(rows)), lambda y: line(y, k % 2 == 1)), ""))

    return F.sha2(F.concat(head, F.array_join(F.transform(parts, part), "")), 256)


def take(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys`` (columns that stay as they are), path, size, kind, content_hash, semantic_hash of files (path, body).

    Go files have no canonical formatter here: comments and blanks are left out instead."""
    e, body = P.lower_ext("path"), F.col("body")
    content = F.sha2(body, 256)
    semantic = (
        F.when(e.isin(MARKDOWN), markdown_hash(body))
        .when(e.isin([*C_STYLE, ".go"]), c_style_hash(body))
        .when(e.isin(HASH_STYLE), hash_style_hash(body))
        .otherwise(content)
    )
    return files.select(*keys, "path", F.octet_length("body").cast("long").alias("size"), kind_of("path").alias("kind"), content.alias("content_hash"), semantic.alias("semantic_hash"))


def _depth(path) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def merkle(files: DataFrame) -> DataFrame:
    """path ('.' for the root), hash, children: deepest directories first, one round a level.

    A directory's hash is over the sorted lines name:hash of what it holds."""
    spark = files.sparkSession
    own = files.select(F.when(P.dirname("path") == ".", "").otherwise(P.dirname("path")).alias("dir"), P.basename("path").alias("name"), F.col("content_hash").alias("hash"))
    dirs = files.select(F.explode(P.ancestors("path")).alias("dir")).distinct().withColumn("depth", _depth(F.col("dir")))
    deepest = dirs.agg(F.max("depth")).first()[0]
    if deepest is None:
        return spark.createDataFrame([], "path string, hash string, children array<string>")
    own = keep(own, "entries")
    dirs = keep(dirs, "dirs")
    above, done = None, []
    for depth in range(deepest, -1, -1):
        here = dirs.where(F.col("depth") == depth).join(own, "dir", "left").select("dir", "name", "hash")
        here = here if above is None else here.unionByName(above)
        entries = F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "hash"))))
        level = here.groupBy("dir").agg(entries.alias("kids")).select(
            "dir",
            F.sha2(F.array_join(F.transform("kids", lambda k: F.concat(k["name"], F.lit(":"), k["hash"], F.lit("\n"))), ""), 256).alias("hash"),
            F.transform("kids", lambda k: k["name"]).alias("children"),
        )
        level = keep(level, f"level{depth}")
        done.append(level)
        above = level.select(F.when(P.dirname("dir") == ".", "").otherwise(P.dirname("dir")).alias("dir"), P.basename("dir").alias("name"), "hash")
    out = done[0]
    for level in done[1:]:
        out = out.unionByName(level)
    return out.select(F.when(F.col("dir") == "", ".").otherwise(F.col("dir")).alias("path"), "hash", "children")


def _up(level: DataFrame) -> DataFrame:
    return level.select(F.when(P.dirname("dir") == ".", "").otherwise(P.dirname("dir")).alias("dir"), F.when(F.col("dir") == "", ".").otherwise(P.basename("dir")).alias("name"), F.lit(True).alias("is_dir"), "hash")


def merkle_update(known: DataFrame | None, changes: DataFrame) -> DataFrame:
    """dir, name, is_dir, hash: the entries of the tree that change with ``changes`` (path, hash; null: gone).

    ``known`` holds all entries before, in the same columns. Only directories above a changed path
    are hashed again; the hashes of all others come from ``known``. A directory that holds nothing
    any more has a null hash; the root is ('', '.'), and its hash is that of nothing if it is empty."""
    spark = changes.sparkSession
    moved = keep(changes.select(F.when(P.dirname("path") == ".", "").otherwise(P.dirname("path")).alias("dir"), P.basename("path").alias("name"), F.lit(False).alias("is_dir"), "hash"), "moved")
    touched = keep(changes.select(F.explode(P.ancestors("path")).alias("dir")).distinct().withColumn("depth", _depth(F.col("dir"))), "touched")
    deepest = touched.agg(F.max("depth")).first()[0]
    if deepest is None:
        return spark.createDataFrame([], "dir string, name string, is_dir boolean, hash string")
    own = moved
    if known is not None:
        full = F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat("dir", F.lit("/"), "name"))
        held = known.where("name <> '.' AND hash IS NOT NULL").join(touched, "dir", "left_semi").join(moved, ["dir", "name", "is_dir"], "left_anti")
        again = touched.select(F.col("dir").alias("full"), F.lit(True).alias("is_dir"))
        own = held.withColumn("full", full).join(again, ["full", "is_dir"], "left_anti").select("dir", "name", "is_dir", "hash").unionByName(moved)
    own = keep(own.where("hash IS NOT NULL").select("dir", "name", "hash"), "own")
    done, above = moved, None
    for depth in range(deepest, -1, -1):
        here = own if above is None else own.unionByName(above)
        rows = touched.where(F.col("depth") == depth).join(here, "dir", "left")
        kids = F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "hash"))))
        lines = F.transform("kids", lambda k: F.concat(k["name"], F.lit(":"), k["hash"], F.lit("\n")))
        hashed = F.when((F.size("kids") > 0) | (F.col("dir") == ""), F.sha2(F.array_join(lines, ""), 256))
        level = keep(_up(rows.groupBy("dir").agg(kids.alias("kids")).select("dir", hashed.alias("hash"))), f"up{depth}")
        done = done.unionByName(level)
        above = level.where("hash IS NOT NULL").select("dir", "name", "hash")
    return done


def root_hash(tree: DataFrame) -> DataFrame:
    """One row: the hash of '.', or that of nothing."""
    return tree.where("path = '.'").agg(F.coalesce(F.max("hash"), F.sha2(F.lit(""), 256)).alias("root"))


def diff(base: DataFrame, current: DataFrame) -> DataFrame:
    """path and change_type of what differs."""
    b = base.select("path", F.col("content_hash").alias("b_content"), F.col("semantic_hash").alias("b_semantic"))
    c = current.select("path", F.col("content_hash").alias("c_content"), F.col("semantic_hash").alias("c_semantic"))
    change = (
        F.when(F.col("b_content").isNull(), "added")
        .when(F.col("c_content").isNull(), "removed")
        .when(F.col("b_semantic") != F.col("c_semantic"), "semantic_changed")
        .when(F.col("b_content") != F.col("c_content"), "semantic_noop")
    )
    return b.join(c, "path", "full_outer").select("path", change.alias("change_type")).where("change_type IS NOT NULL")


def tally(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


def latest(commits: DataFrame) -> DataFrame:
    return commits.groupBy("path").agg(F.max("ts").alias("ts"))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
