"""Change detection on Structured Streaming.

A source of file versions (path, body, version) is kept as the newest version of each path. Each
micro-batch hashes its own rows, looks up what was known of their paths, hashes the directories
above those that differ, and appends both to the state; if the root differs from the last,
``emit`` is called.

The state is a list of segments, each the rows of one batch or of several merged ones. A segment is
merged with the ones after it once they hold half as many rows as it does, so there are about as
many segments as the state's size has binary digits, a large state isn't rewritten for a small
change, and each row is rewritten a logarithmic number of times. The list of a batch is written
last, with the root; segments that the last two lists don't name are deleted. A batch that is
repeated after a failure therefore finds what it began with, and a restart goes on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshot as S
from ..operators.storage import keep


def root_of(files: DataFrame) -> str:
    return S.root_hash(S.merkle(S.take(files))).first()["root"]


class Poller:
    """The last root; tick says whether the files differ from it."""

    def __init__(self, files: DataFrame):
        self.root = root_of(files)

    def tick(self, files: DataFrame) -> bool:
        new = root_of(files)
        changed, self.root = new != self.root, new
        return changed


FILE = "path string, version long, content_hash string, body string"
ENTRY = "dir string, name string, is_dir boolean, hash string, batch long"
STATE = "root string, segments array<struct<name string, rows long, files string>>"  # files: whose texts; null: its own


def newest(rows: DataFrame) -> DataFrame:
    """The newest version of each path; of equal versions, the one of the greatest hash. Deletions
    (null bodies) stay, or an older version would come back. Rows without path or version are left out."""
    top = rows.where("path <> '' AND version IS NOT NULL").groupBy("path").agg(F.max(F.struct("version", "content_hash", "body")).alias("top"))
    return top.select("path", "top.version", "top.content_hash", "top.body")


def hashed(rows: DataFrame) -> DataFrame:
    return rows.select("path", "version", F.sha2("body", 256).alias("content_hash"), "body")


def latest_versions(rows: DataFrame) -> DataFrame:
    """path, body of the newest version; a null body is a deletion."""
    return newest(hashed(rows)).where("body IS NOT NULL").select("path", "body")


def latest_entries(rows: DataFrame) -> DataFrame:
    """dir, name, is_dir, hash as the last batch left them; gone entries have a null hash."""
    top = rows.groupBy("dir", "name", "is_dir").agg(F.max(F.struct("batch", "hash")).alias("top"))
    return top.select("dir", "name", "is_dir", "top.hash", "top.batch")


def directories(spark: SparkSession, table: str) -> DataFrame:
    """path ('.' for the root), hash of each directory as the last batch left it."""
    lists = [name for name in _names(spark, f"{table}/lists")]
    last = max(lists, key=lambda name: int(name.split("=")[1]))
    names = [s["name"] for s in spark.read.schema(STATE).parquet(f"{table}/lists/{last}").first()["segments"]]
    rows = latest_entries(_read(spark, f"{table}/entries", names, ENTRY)).where("is_dir AND hash IS NOT NULL")
    return rows.select(F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat("dir", F.lit("/"), "name")).alias("path"), "hash")


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    where, fs = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []


def _only(spark: SparkSession, path: str, stay: set[str]) -> None:
    for name in set(_names(spark, path)) - stay:
        where, fs = _fs(spark, f"{path}/{name}")
        fs.delete(where, True)


def _read(spark: SparkSession, path: str, names: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path}/{name}" for name in names]) if names else spark.createDataFrame([], schema)


def _texts(segments: list[tuple]) -> list[str]:
    return [s[2] for s in segments]


def _keys(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return _read(spark, path, names, FILE).select("path", "version", "content_hash")


def _top(keys: DataFrame) -> DataFrame:
    """The newest version of each path, as ``newest`` has it, without texts."""
    return keys.groupBy("path").agg(F.max(F.struct("version", "content_hash")).alias("top")).select("path", "top.version", "top.content_hash")


def _whole(spark: SparkSession, path: str, parts: list[tuple]) -> str | None:
    """The one segment whose rows are all newest, if the others hold none that are."""
    rows = None
    for _, _, texts in parts:
        own = _keys(spark, path, [texts]).withColumn("texts", F.lit(texts))
        rows = own if rows is None else rows.unionByName(own)
    top = rows.groupBy("path").agg(F.max(F.struct("version", "content_hash", "texts")).alias("top"))
    newest_of = {r["texts"]: r["n"] for r in top.groupBy("top.texts").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(newest_of) != 1:
        return None
    texts, n = newest_of.popitem()
    return texts if n == spark.read.parquet(f"{path}/{texts}").count() else None


def to_merge(segments: list[tuple]) -> int:
    """How many of the last segments become one: 1 if none has to be merged."""
    count, rows = 1, segments[-1][1]
    while count < len(segments) and segments[-count - 1][1] <= 2 * rows:
        count, rows = count + 1, rows + segments[-count - 1][1]
    return count


def step(spark: SparkSession, batch: DataFrame, number: int, table: str) -> tuple[str | None, str, list[str]]:
    """Take one batch into the state: the root before (None at the start), the root after, the segments."""
    files, entries, lists = f"{table}/files", f"{table}/entries", f"{table}/lists"
    last = f"batch={number - 1}"
    before = spark.read.schema(STATE).parquet(f"{lists}/{last}").first() if last in _names(spark, lists) else None
    old = [(s["name"], s["rows"], s["files"] or s["name"]) for s in before["segments"]] if before else []
    names = [s[0] for s in old]

    own = f"batch={number}"
    hashed(batch).where("path <> '' AND version IS NOT NULL").write.mode("overwrite").parquet(f"{files}/{own}")
    fresh = _top(_keys(spark, files, [own]))
    was = _keys(spark, files, _texts(old)).join(fresh.select("path"), "path", "left_semi")
    was = _top(was).select("path", F.col("version").alias("old_version"), F.col("content_hash").alias("old_hash"))
    later = (F.col("version") > F.col("old_version")) | ((F.col("version") == F.col("old_version")) & (F.coalesce("content_hash", F.lit("")) > F.coalesce("old_hash", F.lit(""))))
    fresh = keep(fresh.join(was, "path", "left").where(F.col("old_version").isNull() | later), "fresh")
    # a batch of which nothing is new leaves no segment
    rows = 0 if fresh.isEmpty() else spark.read.parquet(f"{files}/{own}").count()
    changes = fresh.where("NOT content_hash <=> old_hash").select("path", F.col("content_hash").alias("hash"))
    known = latest_entries(_read(spark, entries, names, ENTRY)) if names else None
    S.merkle_update(known, changes).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{entries}/{own}")
    found = _read(spark, entries, [own], ENTRY).where("dir = '' AND name = '.'").first()
    root = found["hash"] if found else before["root"] if before else S.NOTHING

    segments = [*old, (own, rows, own)] if rows else old
    many = to_merge(segments) if rows else 1
    if many > 1:
        parts, one = segments[-many:], f"merged={number}"
        latest_entries(_read(spark, entries, [s[0] for s in parts], ENTRY)).write.mode("overwrite").parquet(f"{entries}/{one}")
        texts = _whole(spark, files, parts)
        if texts is None:
            texts = one
            newest(_read(spark, files, _texts(parts), FILE)).write.mode("overwrite").parquet(f"{files}/{one}")
        segments = [*segments[:-many], (one, spark.read.parquet(f"{files}/{texts}").count(), texts)]
    spark.createDataFrame([(root, segments)], STATE).coalesce(1).write.mode("overwrite").parquet(f"{lists}/{own}")
    _only(spark, entries, {s[0] for s in [*old, *segments]})
    _only(spark, files, set(_texts([*old, *segments])))
    _only(spark, lists, {last, own})
    return before["root"] if before else None, root, _texts(segments)


def logged(evaluate: Callable[[DataFrame, str], None], log: Callable[[str], None] = print) -> Callable[[DataFrame, str], None]:
    """An ``emit`` for ``watch`` under which a failing evaluation is logged and the watch goes on."""

    def emit(files: DataFrame, root: str) -> None:
        try:
            evaluate(files, root)
        except Exception as e:  # one bad evaluation must not end the watch
            log(f"evaluation failed: {e}")

    return emit


def watch(spark: SparkSession, versions: DataFrame, table: str, checkpoint: str, emit: Callable[[DataFrame, str], None], interval: str | None = "1 second", initial: bool = False):
    """Start watching. ``versions``: a streaming DataFrame (path, body, version).

    With ``interval`` None what is there is taken once (availableNow). The first root ever is
    emitted only if ``initial`` is set. ``emit`` gets the files (path, body), which are read only
    if it uses them, and the root; an error in it ends the stream, and a restart repeats the batch.
    ``logged`` makes an emit that goes on."""

    def each(batch: DataFrame, number: int) -> None:
        before, root, names = step(spark, batch.select("path", "body", "version"), number, table)
        if root != before and (before is not None or initial):
            emit(newest(_read(spark, f"{table}/files", names, FILE)).where("body IS NOT NULL").select("path", "body"), root)

    writer = versions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type, for streams and tables alike (an addition, not part of watching)."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
