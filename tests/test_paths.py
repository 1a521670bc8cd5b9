"""Column functions on small cases."""

import posixpath

from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions import text as T
from tessera.functions.globs import glob_to_regex, matches_any


def one(spark, values, column):
    rows = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in rows.select(column("x")).collect()]


def test_clean_and_parts(spark):
    paths = ["a/b.md", "a/../b", "./a//b/", "../a", "a/../../b", "", ".", "a.tar.gz", "x/.env", "a/./b/../c.ts"]
    assert one(spark, paths, P.clean) == [posixpath.normpath(p) if p else "." for p in paths]
    assert one(spark, paths, P.basename) == [p.rsplit("/", 1)[-1] for p in paths]
    assert one(spark, ["a/b.md", "b", "x/.env", "a.b/c"], P.ext) == [".md", "", ".env", ""]
    assert one(spark, ["a/b/c", "c"], P.dirname) == ["a/b", "."]


def test_slug_and_cut(spark):
    assert one(spark, ["  Big Plan! 2 ", "--", "Élan x"], P.slugify) == ["big-plan-2", "", "lan-x"]
    assert one(spark, ["abcdef", "ab"], lambda c: P.cut_bytes(c, 4)) == ["abc…", "ab"]


def test_globs(spark):
    import re

    def hit(pattern, path):
        return bool(re.search(glob_to_regex(pattern), path))

    assert hit("**/x.go", "x.go") and hit("**/x.go", "a/b/x.go") and not hit("*/x.go", "a/b/x.go")
    assert hit("a/**", "a/b/c") and hit("a.?", "a.b") and not hit("a.?", "a./") and hit("[ab]c", "bc")
    rows = spark.createDataFrame([("a/x.go",), ("b",)], "path string")
    assert [r[0] for r in rows.select(matches_any(F.col("path"), ["a/*", "zz"])).collect()] == [True, False]


def test_comments(spark):
    code = ["a /* b\nc */ d // e\nf", "// x /* y\nz /* open", "keep"]
    assert one(spark, code, T.strip_ts_comments) == ["a  d \nf", "\nz ", "keep"]
    python = ['a = """x\ny""" # c\nb', "c # d\ne '''f\n", "k"]
    assert one(spark, python, T.strip_python_comments) == ["a = \n \nb", "c \ne ", "k"]


def test_hide_quoted(spark):
    got = one(spark, ['see "US-001" and US-002', '"a \\" US-003" ADR-001', "`US-004\nx` IDR-005", 'open "US-006\nUS-007'], T.hide_quoted)
    assert ["US-001" in got[0], "US-002" in got[0]] == [False, True]
    assert ["US-003" in got[1], "ADR-001" in got[1]] == [False, True]
    assert ["US-004" in got[2], "IDR-005" in got[2]] == [False, True]
    assert ["US-006" in got[3], "US-007" in got[3]] == [False, True]


def test_added_lines(spark):
    hunk = "+++ b/x\n@@ -1 +1 @@\n-old\n+new\n+\n+x y"
    assert one(spark, [hunk], T.added_lines) == ["new\n\nx y"]
