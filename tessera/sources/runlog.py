"""The log of evaluation runs: a point for each run and key, and the last points of each series.

Runs are appended as JSON lines, a folder for each run, so appending a run again replaces it.
``compact`` writes the points that are still wanted to a new archive and only then deletes what
it has read; if it stops in between, points are there twice, and reading takes each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINT = "series string, key string, run_id string, generated_at timestamp, total long, hits long, false_negatives long, false_positives long, skipped long, errored long"
LAST = 200


def last_points(points: DataFrame, most: int = LAST) -> DataFrame:
    """The last points of each series and key, by time and run. Each series has its own last ones:
    a key that occurs in few runs goes further back."""
    ranks = F.row_number().over(Window.partitionBy("series", "key").orderBy(F.desc("generated_at"), F.desc("run_id")))
    return points.withColumn("_n", ranks).where(F.col("_n") <= most).drop("_n")


def rates(points: DataFrame) -> DataFrame:
    """hit_rate, false_negative_rate, false_positive_rate over what was run."""
    ran = F.col("total") - F.col("skipped") - F.col("errored")
    rate = lambda c: F.coalesce(F.col(c).cast("double") / F.nullif(ran, F.lit(0)), F.lit(0.0))
    return points.withColumns({"hit_rate": rate("hits"), "false_negative_rate": rate("false_negatives"), "false_positive_rate": rate("false_positives")})


def points_of(results: DataFrame, run_id: str, generated_at) -> DataFrame:
    """Points of one run's results (mutation_id, expected, missing, unexpected, classification): the run, its
    mutations, the meters they expect, and all meters that they name."""
    rows = results.select(
        "classification",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("run").alias("series"), F.lit("").alias("key")), F.struct(F.lit("mutation").alias("series"), F.col("mutation_id").alias("key"))),
                F.transform(F.array_distinct("expected"), lambda m: F.struct(F.lit("expected_meter").alias("series"), m.alias("key"))),
                F.transform(F.array_distinct(F.concat("expected", "unexpected")), lambda m: F.struct(F.lit("meter").alias("series"), m.alias("key"))),
            )
        ).alias("at"),
        F.size("missing").alias("fn"),
        F.size("unexpected").alias("fp"),
        F.col("missing").alias("missed"),
        F.col("unexpected").alias("extra"),
    )
    ran = ~F.col("classification").isin("skipped", "errored")
    meter = F.col("at.series") == "meter"
    missed = F.when(meter, F.expr("array_contains(missed, at.key)")).otherwise(F.col("fn") > 0)
    extra = F.when(meter, F.expr("array_contains(extra, at.key)")).otherwise(F.col("fp") > 0) & ~(meter & missed)
    return rows.groupBy("at.series", "at.key").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ran & ~missed & ~extra).alias("hits"), F.count_if(ran & missed).alias("false_negatives"), F.count_if(ran & extra).alias("false_positives"),
        F.count_if(F.col("classification") == "skipped").alias("skipped"), F.count_if(F.col("classification") == "errored").alias("errored"),
    ).select("series", "key", F.lit(run_id).alias("run_id"), F.lit(generated_at).cast("timestamp").alias("generated_at"), "total", "hits", "false_negatives", "false_positives", "skipped", "errored")


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _whole(spark: SparkSession, path: str) -> list[str]:
    """Folders that were written to their end."""
    where, fs = _fs(spark, path)
    if not fs.exists(where):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    return [n for n in names if fs.exists(_fs(spark, f"{path}/{n}/_SUCCESS")[0])]


def append(points: DataFrame, path: str, name: str) -> None:
    """Add the points of a run, or of several under one name; the same name again replaces them."""
    if not name or "/" in name:
        raise ValueError(f"no name for a folder: {name!r}")
    points.write.mode("overwrite").json(f"{path}/runs/{name}")


def read(spark: SparkSession, path: str, most: int = LAST) -> DataFrame:
    """The last points of each series. A run that is in the archive and was appended again counts once, as appended."""
    parts = [(f"{path}/{kind}/{n}", order) for kind, order in (("archive", 0), ("runs", 1)) for n in _whole(spark, f"{path}/{kind}")]
    if not parts:
        return spark.createDataFrame([], POINT)
    names = POINT.replace(",", "").split()[::2]
    out = None
    for order in (0, 1):
        folders = [p for p, o in parts if o == order]
        if folders:
            rows = spark.read.schema(POINT).json(folders).withColumn("order", F.lit(order))
            out = rows if out is None else out.unionByName(rows)
    values = [n for n in names if n not in ("series", "key", "run_id")]
    once = out.groupBy("series", "key", "run_id").agg(F.max(F.struct("order", *values)).alias("top")).select("series", "key", "run_id", *[F.col(f"top.{v}") for v in values])
    return last_points(once, most).select(*names)


def compact(spark: SparkSession, path: str, most: int = LAST, before_delete=lambda: None) -> None:
    """One archive instead of many folders. ``before_delete`` is called once the archive is written."""
    old = [f"{path}/{kind}/{n}" for kind in ("archive", "runs") for n in _whole(spark, f"{path}/{kind}")]
    if not old:
        return
    last = max([int(n) for n in _whole(spark, f"{path}/archive")], default=0)
    read(spark, path, most).write.mode("overwrite").json(f"{path}/archive/{last + 1}")
    before_delete()
    for folder in old:
        where, fs = _fs(spark, folder)
        fs.delete(where, True)
