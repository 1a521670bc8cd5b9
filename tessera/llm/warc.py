"""WARC archives in seekable Zstandard bundles (operator 4).

A bundle is a run of independent zstd frames, each with whole WARC records, and a
footer in the seekable format: a skippable frame with each frame's compressed and
plain size, the number of frames, a descriptor byte and a magic number. The index
maps a record's id to bundle, frame and the offset in the plain frame; a reader
opens the footer, decompresses one frame and has the record.

Of records with equal payloads of at least ``least`` bytes the one with the smallest
page_id is a response and the others are revisits that name it; smaller payloads
are always responses.

Defined results: a null payload is empty; a null url leaves the target out; null
page_ids come after all others in the choice of the response; of rows with the
smallest page_id and one payload, repeated, all are responses (they are one page);
an empty table gives no bundle."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, put_file

#: Fixed values of the seekable zstd format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "page_id long, bundle string, frame int, frame_at long, record_at long, record_bytes long"
ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has no block."""
    kind = "response" if payload is not None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if payload is None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = payload or b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[dict]:
    """The records of a plain frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        yield head | {"block": data[end + 4 : end + 4 + size], "at": at, "bytes": end + 8 + size - at}
        at = end + 8 + size


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed, plain) of each frame, from the footer."""
    count, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    out, at = [], 0
    for k in range(count):
        packed, plain = struct.unpack_from("<II", data, len(data) - 9 - 8 * (count - k))
        out.append((at, packed, plain))
        at += packed
    return out


def choose(pages: DataFrame, least: int = 100) -> DataFrame:
    """pages with payload, digest and the page that a revisit refers to.

    Only digests that occur more than once go through the join."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    again = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "first")
    refers = F.when((F.col("payload_bytes") >= least) & (F.col("first").isNotNull()) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return rows.join(again, "payload_digest", "left").withColumn("refers_to", refers).drop("first")


def write_archive(pages: DataFrame, path: str, least: int = 100, frame_bytes: int = 1 << 20, bundle_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Write bundles under ``path``; returns the index, itself a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        task = TaskContext.get().partitionId()
        state = {"bundle": 0, "frames": [], "sizes": [], "at": 0}
        records: list[bytes] = []
        waiting: list[tuple] = []
        plain = 0

        def name() -> str:
            return f"part-{task:06d}-{state['bundle']:04d}.warc.zst"

        def close_frame():
            nonlocal records, waiting, plain
            packed = packer.compress(b"".join(records))
            index = [(p, name(), len(state["frames"]), state["at"], at, size) for p, at, size in waiting]
            state["frames"].append(packed)
            state["sizes"].append((len(packed), plain))
            state["at"] += len(packed)
            records, waiting, plain = [], [], 0
            cols = list(zip(*index))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=[x.split()[0] for x in INDEX.split(", ")])

        def close_bundle():
            put_file(f"{path}/{name()}", b"".join(state["frames"]) + seek_table(state["sizes"]))
            state.update(bundle=state["bundle"] + 1, frames=[], sizes=[], at=0)

        for batch in batches:
            for page, url, payload, size, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to"))):
                one = record(page, url, payload, size, digest, refers)
                waiting.append((page, plain, len(one)))
                records.append(one)
                plain += len(one)
                if plain >= frame_bytes:
                    yield close_frame()
                    if state["at"] >= bundle_bytes:
                        close_bundle()
        if records:
            yield close_frame()
        if state["frames"]:
            close_bundle()

    chosen = choose(pages, least)
    block = F.when(F.col("refers_to").isNull(), F.col("payload"))
    rows = chosen.select("page_id", "url", block.alias("payload"), "payload_bytes", "payload_digest", "refers_to")
    return materialize(rows.mapInArrow(run, INDEX), "warc-index")


def _number(urn: str | None):
    digits = urn[len("<urn:page:") : -1] if urn else ""
    return int(digits) if digits else None


def _row(head: dict, with_payload: bool) -> tuple:
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    if head["WARC-Type"] == "response" and hashlib.sha256(head["block"]).hexdigest() != digest:
        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
    url = head.get("WARC-Target-URI")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return (_number(head["WARC-Record-ID"]), url, int(head["X-Payload-Length"]), digest, head["WARC-Type"], _number(head.get("WARC-Refers-To")), head["block"] if with_payload else None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 7
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in ROWS.split(", ")])


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every record of every bundle, frame by frame; payloads are checked against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                for at, packed, _ in frames(data):
                    yield _batch([_row(x, with_payload) for x in parse(unpack.decompress(data[at : at + packed]))])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content").mapInArrow(run, ROWS)


def read_records(spark: SparkSession, path: str, index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of the page_ids in ``wanted``: only the frames that hold them are decompressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for content, spots in zip(batch.column("content"), batch.column("spots").to_pylist()):
                data, opened, rows = content.as_py(), {}, []
                for s in sorted(spots, key=lambda s: (s["frame"], s["record_at"])):
                    at, packed, _ = frames(data)[s["frame"]]
                    if s["frame"] not in opened:
                        opened = {s["frame"]: unpack.decompress(data[at : at + packed])}
                    rows += [_row(x, True) for x in parse(opened[s["frame"]][s["record_at"] : s["record_at"] + s["record_bytes"]])]
                yield _batch(rows)

    spots = index.join(wanted.select("page_id").distinct(), "page_id", "left_semi").groupBy("bundle").agg(F.collect_list(F.struct("frame", "record_at", "record_bytes")).alias("spots"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).withColumn("bundle", F.element_at(F.split("path", "/"), -1))
    return files.join(spots, "bundle").select("content", "spots").mapInArrow(run, ROWS)


def archive_and_read(pages: DataFrame, least: int = 100) -> DataFrame:
    """Round trip: what the written archives say of each page."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    index = write_archive(pages, path, least)
    if index.isEmpty():
        return spark.createDataFrame([], ROWS)
    return read_archive(spark, path)
