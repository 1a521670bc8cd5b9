"""Written tables that cut the lineage of iterative plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Only on one machine (tests), where that is unset,
    a temporary folder is made, and removed when Python exits."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if (spark.sparkContext.master or "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        where = "file://" + _OWN[app]
    return f"{where.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a new folder and read it back.

    The copy outlives executors, and no plan grows from round to round."""
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
