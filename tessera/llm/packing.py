"""Packing: shortest-pack-first over the length histogram (operator 2).

Documents are encoded and cut into pieces of at most ``limit`` ids. Only the
histogram of piece lengths, at most ``limit`` numbers, reaches the driver. There
whole groups of equal lengths are placed, longest first, each into the pack that
is shortest so far; a pack is a pattern with a count, so the work depends on
``limit`` and not on the number of documents. Patterns come back to the pieces by
rank: of the pieces of one length, the r-th takes the r-th place that the patterns
have for that length. Ranks need no sort: a task numbers its own pieces of a
length, and the counts of the tasks, added up, give where each one starts.

Defined results: null text counts as empty, a document of no ids is its end id
alone; repeated rows and null ids are packed like any other row; an empty table
gives no pieces. Extra columns of the input are ignored."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, place long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int, with_ids: bool) -> DataFrame:
    """A row for each piece, numbered by task and, there, among those of its length."""
    schema = PIECES + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        task, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in batches:
            for first, rows, ids, at in enc.encode_column(batch.column("text"), end_id):
                n = np.diff(at)
                pieces = -(-n // limit)
                doc = np.repeat(np.arange(rows), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * limit
                size = np.minimum(n[doc] - start, limit)
                place = np.empty(len(doc), np.int64)
                for k, x in enumerate(size.tolist()):
                    place[k] = seen[x]
                    seen[x] += 1
                raw = memoryview(ids.view(np.uint8))
                blobs = [raw[4 * a : 4 * (a + x)] for a, x in zip((at[doc] + start).tolist(), size.tolist())]
                cols = [batch.column("doc_id").slice(first, rows).take(pa.array(doc)), pa.array(start), pa.array(size), pa.array([zlib.crc32(x) for x in blobs], pa.int64()), pa.array(n[doc]), pa.array(np.full(len(doc), task, np.int64)), pa.array(place)]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array([x.tobytes() for x in blobs], pa.binary())] if with_ids else []), names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def patterns(histogram: dict[int, int], limit: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(count, [(length, times), ...]) by shortest-pack-first.

    open_[free] holds the unfinished patterns with ``free`` ids left. The shortest
    pack is the one with most room; a pattern that is needed fewer times than it
    occurs is split in two."""
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    done = []
    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        left, room = histogram[length], limit
        while left:
            while room >= length and not open_.get(room):
                room -= 1
            if room < length:
                count, pack, free = left, [], limit
            else:
                count, pack = open_[room].pop()
                free = room
                if count > left:
                    open_[room].append((count - left, pack))
            used = min(count, left)
            last = pack[-1] if pack and pack[-1][0] == length else None
            new = [*pack[:-1], (length, last[1] + 1)] if last else [*pack, (length, 1)]
            left -= used
            free -= length
            if free:
                open_[free].append((used, new))
                room = max(room, free)
            else:
                done.append((used, new))
    return done + [x for free in sorted(open_) for x in open_[free]]


def places(packs: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset), sorted by length and rank."""
    at: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for count, pack in packs:
        offset = 0
        for length, times in pack:
            rows.append((length, at[length], count, sequence, offset))
            at[length] += count * times
            offset += length * times
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, limit: int = 4096, with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset; with_ids adds the ids (binary, little-endian unsigned 32-bit)."""
    pieces = materialize(cut_pieces(docs, tokenizer, end_id, limit, with_ids), "pieces")
    counts = materialize(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `limit` rows
    table = places(patterns(histogram, limit))
    key = table[:, 0] << np.int64(44) | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            slot = np.searchsorted(key, length << np.int64(44) | rank, "right") - 1
            _, first, count, sequence, offset = table[slot].T if len(slot) else np.zeros((5, 0), np.int64)
            inside = rank - first
            out = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            out += [pa.array(sequence + inside % np.maximum(count, 1)), pa.array(offset + inside // np.maximum(count, 1) * length)]
            yield pa.RecordBatch.from_arrays(out + ([batch.column("ids")] if with_ids else []), names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    # a row for each task and length: small in bytes on disk, but it grows with the tasks, so no broadcast
    ranked = pieces.hint("merge").join(starts, ["task", "length"]).withColumn("rank", F.col("first") + F.col("place"))
    return ranked.select("rank", *[c for c in names if c not in ("sequence_id", "offset")]).mapInArrow(run, schema)
