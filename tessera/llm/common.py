"""What the operators share: the folder all executors see, written intermediate tables, byte helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only on one machine (tests), where that is
    unset, a temporary folder is made, and removed when Python exits."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not (spark.sparkContext.master or "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return "file://" + _OWN[app]


#: Folders of ``materialize`` since the innermost ``passing`` began.
_PASSING: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Results that operators materialize inside are deleted at its end: for a stage whose own
    output has been written by then."""
    _PASSING.append([])
    try:
        yield
    finally:
        for path in _PASSING.pop():
            remove(spark, path)
        release(spark)


def materialize(df: DataFrame, label: str, gather: bool = False) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks it ran, not the plan. ``gather``
    lets a task take several shuffle partitions, one after the other, so that small
    tables become a few files for each core and not a file for each partition."""
    path = new_path(df.sparkSession, label)
    if _PASSING:
        _PASSING[-1].append(path)
    return written(df, path, gather)


def written(df: DataFrame, path: str, gather: bool = False) -> DataFrame:
    spark = df.sparkSession
    if gather:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The intermediate tables of one operator run; those that are still there go at the end.

    What the operator returns must not read them: write it with ``materialize`` before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*self.paths)

    def table(self, df: DataFrame, label: str, gather: bool = False) -> DataFrame:
        path = new_path(self.spark, label)
        self.paths[label] = path
        return written(df, path, gather)

    def drop(self, *labels: str) -> None:
        """Delete tables that are no longer read, and the shuffle files of plans that are over."""
        for label in labels:
            remove(self.spark, self.paths.pop(label))
        release(self.spark)


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver has collected the plans that made them, which it
    otherwise does when its own memory is short, whatever the disks hold."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows from here on, unless the session has fewer:
    whole texts stand in them, once in the executor and once in its Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def trim() -> None:
    """Give freed memory back to the system: a worker lives on, beside others, for other stages."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def put_file(uri: str, data: bytes) -> None:
    """Write a whole file from an executor, visible only when complete.

    Plain paths and ``file:`` go through the operating system, every other
    scheme through the file systems of pyarrow. A repeated attempt replaces the
    file by an equal one."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        path = unquote(parts.path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}.part"
        with open(part, "wb") as out:
            out.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as out:
        out.write(data)


#: Odd multipliers of the polynomial fingerprints, and their inverses modulo 2**64.
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xC2B2AE3D27D4EB4F
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.empty(size, np.uint64)
        out[0] = 1
        done = 1
        while done < size:
            out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _POWERS[base] = have = out
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3, in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_sums(data: np.ndarray, base: int) -> np.ndarray:
    """S with S[i] = sum of (data[j] + 1) * base**j over j < i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=out[1:])
    return out


def fingerprints(sums: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end), the same wherever the bytes stand."""
    n = len(sums)
    back = powers(inverse(base), n)
    out = (sums[end] - sums[start]) * back[start]
    out += (end - start).astype(np.uint64)
    return mix(out)


def utf8_column(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of an Arrow string or binary array without nulls."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]] if len(offs) else raw[:0], offs - (offs[0] if len(offs) else 0)


def slices(offsets: np.ndarray, limit: int):
    """Runs [i, j) of neighbouring rows with at most ``limit`` bytes, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j
