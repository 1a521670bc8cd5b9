"""Token-id store addressed by content (operator 7).

A rolling hash over the ids decides where an id stream is cut, so equal passages
give equal chunks wherever they stand. A chunk is known by the SHA-256 of its ids,
and each distinct chunk is written once. On disk:

  segments/seg-*.tcs    of about 64 MB: b"TCS1", then for each chunk, in digest order:
                        digest (32 bytes), number of ids and stored bytes (two
                        little-endian unsigned 32-bit), zstd of the ids
  manifest/             Parquet, ascending doc_id within and across ``part``:
                        doc_id, start, n_tokens, recipe (digest and number of ids,
                        36 bytes a chunk), leaf (SHA-256 of the recipe)
  merkle/               Parquet: part, first, n_tokens, root of the tree over the leaves in order

Reading back parses every segment, checks each chunk against its digest, recomputes leaves
and roots, and puts documents together by their recipes. A document's checksum follows from the
checksums and lengths of its chunks (CRC-32 of a concatenation), so verifying
all documents moves no ids between machines.

Defined results: null text counts as empty; repeated rows and null doc_ids (which
sort first) are documents of their own; an empty table gives an empty store."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, new_path, put_file
from .tokens import encoder

MAGIC = b"TCS1"
_HEAD = "<32sII"
_ENTRY = np.dtype([("digest", "S32"), ("n", "<u4")])
_GEAR = np.random.default_rng(20240607).integers(0, 1 << 63, 65536, dtype=np.uint64)


def cuts(ids: np.ndarray, mean: int, least: int, most: int) -> list[int]:
    """Where the chunks end. A place is eligible if a hash of the 16 ids before it
    is zero modulo ``mean``; chunks hold ``least`` to ``most`` ids."""
    n = len(ids)
    if n <= least:
        return [n]
    g = _GEAR[ids & 0xFFFF] + ids.astype(np.uint64)
    h = g.copy()
    for step in (1, 2, 4, 8):  # h[i] covers 2 * step ids after each turn
        h[step:] = h[step:] + (h[:-step] << np.uint64(step))
    eligible = np.flatnonzero((h >> np.uint64(20)) % np.uint64(mean) == 0) + 1
    out, at = [], 0
    while n - at > least:
        k = np.searchsorted(eligible, at + least)
        end = int(eligible[k]) if k < len(eligible) else n
        at = min(end, at + most, n)
        out.append(at)
    if not out or out[-1] < n:
        out.append(n)
    return out


def _encode(docs: DataFrame, tokenizer: str, end_id: int, mean: int, least: int, most: int) -> DataFrame:
    """Rows of two kinds: a document with its recipe, or a chunk with its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc = encoder(tokenizer)
        kind = np.uint16 if enc.vocabulary <= 65536 else np.uint32
        sent: set[bytes] = set()
        for batch in batches:
            for first, count, ids, at in enc.encode_column(batch.column("text"), end_id):
                narrow, raw, rows = memoryview(ids.astype(kind).view(np.uint8)), memoryview(ids.view(np.uint8)), []
                width, names = narrow.nbytes // max(len(ids), 1), batch.column("doc_id").slice(first, count).to_pylist()
                for doc, lo, hi in zip(names, at[:-1].tolist(), at[1:].tolist()):
                    recipe, begin = [], lo
                    for to in cuts(ids[lo:hi], mean, least, most):
                        to += lo
                        digest = hashlib.sha256(raw[4 * begin : 4 * to]).digest()
                        recipe.append(digest + struct.pack("<I", to - begin))
                        if digest not in sent:
                            if len(sent) >= 200_000:  # only saves sending; the segments hold each once anyway
                                sent.clear()
                            sent.add(digest)
                            rows.append((1, None, to - begin, digest, narrow[width * begin : width * to].tobytes()))
                        begin = to
                    whole = b"".join(recipe)
                    rows.append((0, doc, hi - lo, hashlib.sha256(whole).digest(), whole))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["kind", "doc_id", "n", "digest", "payload"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "kind int, doc_id long, n long, digest binary, payload binary")


class Merkle:
    """The root over leaves that come one after the other: a binary tree that holds, of the
    finished subtrees, one root for each size. Leaves and inner nodes are hashed apart."""

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level, node = 0, hashlib.sha256(b"\0" + leaf).digest()
        while self.peaks and self.peaks[-1][0] == level:
            node = hashlib.sha256(b"\1" + self.peaks.pop()[1] + node).digest()
            level += 1
        self.peaks.append((level, node))

    def root(self) -> bytes:
        node = b""
        for _, peak in reversed(self.peaks):
            node = hashlib.sha256(b"\1" + peak + node).digest() if node else peak
        return node


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, mean: int = 512, least: int = 128, most: int = 4096, segment_bytes: int = 64 << 20) -> DataFrame:
    """Write the store; returns the manifest as read back from it."""
    spark = docs.sparkSession
    segments = f"{path}/segments"

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=1, write_content_size=True)
        parts, last, size, number = [MAGIC], None, 0, 0

        def close():
            put_file(f"{segments}/seg-{TaskContext.get().partitionId():06d}-{number:04d}.tcs", b"".join(parts))

        for batch in batches:
            if batch.num_rows == 0:
                continue
            kinds = batch.column("kind").to_numpy()
            for n, digest, payload in zip(*(batch.column(c).filter(pa.array(kinds == 1)).to_pylist() for c in ("n", "digest", "payload"))):
                if digest != last:  # sorted: equal chunks stand together
                    body = packer.compress(payload)
                    parts += (struct.pack(_HEAD, digest, n, len(body)), body)
                    last = digest
                    size += len(body)
                    if size >= segment_bytes:
                        close()
                        parts, size, number = [MAGIC], 0, number + 1
            docs_only = batch.filter(pa.array(kinds == 0))
            yield pa.RecordBatch.from_arrays([docs_only.column(c) for c in ("doc_id", "n", "digest", "payload")], names=["doc_id", "n_tokens", "leaf", "recipe"])
        if len(parts) > 1:
            close()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, before, tree = TaskContext.get().partitionId(), 0, 0, Merkle()
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            for leaf in batch.column("leaf").to_pylist():
                tree.add(leaf)
            upto = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_tokens", "leaf", "recipe")), pa.array(upto - n), pa.array(np.full(len(n), part, np.int64)), pa.array(row + np.arange(len(n)))],
                names=["doc_id", "n_tokens", "leaf", "recipe", "before", "part", "row"],
            )
            row, before = row + len(n), int(upto[-1]) if len(n) else before
        if row:  # at the end the part's own row: its root and its token count
            yield pa.RecordBatch.from_arrays(
                [pa.array([None], pa.int64()), pa.array([before]), pa.array([tree.root()]), pa.array([None], pa.binary()), pa.array([0]), pa.array([part], pa.int64()), pa.array([-1])],
                names=["doc_id", "n_tokens", "leaf", "recipe", "before", "part", "row"],
            )

    with Scratch(spark) as own:
        rows = _encode(docs, tokenizer, end_id, mean, least, most)
        dealt = rows.repartition("digest", "doc_id").sortWithinPartitions("kind", "digest")  # chunks have no doc_id
        recipes = own.table(dealt.mapInArrow(chunks, "doc_id long, n_tokens long, leaf binary, recipe binary"), "recipes")
        ordered = recipes.repartitionByRange(F.col("doc_id"), F.col("leaf")).sortWithinPartitions("doc_id", "leaf")
        numbered = own.table(ordered.mapInArrow(number, "doc_id long, n_tokens long, leaf binary, recipe binary, before long, part long, row long"), "numbered")
        earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
        parts = numbered.where("row = -1").select("part", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("first"), "n_tokens", F.col("leaf").alias("root"))
        parts.coalesce(1).write.parquet(f"{path}/merkle")
        merkle = spark.read.parquet(f"{path}/merkle")
        manifest = numbered.where("row >= 0").join(F.broadcast(merkle.select("part", "first")), "part")  # bounded by the number of partitions
        manifest.select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "recipe", "leaf", "part", "row").sortWithinPartitions("part", "row").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def _parse(data: bytes) -> Iterator[tuple[bytes, int, np.ndarray]]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    if data[:4] != MAGIC:
        raise ValueError("not a segment of this store")
    at = 4
    while at < len(data):
        digest, n, size = struct.unpack_from(_HEAD, data, at)
        at += struct.calcsize(_HEAD)
        body = unpack.decompress(data[at : at + size])
        at += size
        ids = np.frombuffer(body, "<u2" if len(body) == 2 * n else "<u4").astype("<u4")
        if hashlib.sha256(ids.tobytes()).digest() != digest:
            raise ValueError(f"chunk {digest.hex()} is damaged")
        yield digest, n, ids


def read_chunks(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Every stored chunk, checked: digest, n, crc32, and its ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows = [(d, n, zlib.crc32(i.tobytes()), i.tobytes() if with_ids else None) for d, n, i in _parse(data.as_py())]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names=["digest", "n", "crc32", "ids"])

    schema = "digest binary, n long, crc32 long, ids binary"
    if spark.read.parquet(f"{path}/manifest").isEmpty():
        return spark.createDataFrame([], schema)
    return spark.read.format("binaryFile").load(f"{path}/segments").select("content").mapInArrow(run, schema)


def _shift_tables() -> np.ndarray:
    """T[k][byte][value]: what 2**k bytes of zeros make of a CRC-32 register, by its bytes."""
    poly = 0xEDB88320
    one = [0] * 32  # the matrix of a single zero bit, a column for each bit
    one[0] = poly
    for n in range(1, 32):
        one[n] = 1 << (n - 1)
    apply = lambda m, v: __import__("functools").reduce(lambda a, n: a ^ m[n] if v >> n & 1 else a, range(32), 0)
    square = lambda m: [apply(m, c) for c in m]
    m = square(square(square(one)))  # eight bits
    out = np.zeros((40, 4, 256), np.uint32)
    for k in range(40):
        for b in range(4):
            for bit in range(8):
                col = m[8 * b + bit]
                step = 1 << bit
                out[k, b, step : 2 * step] = out[k, b, :step] ^ np.uint32(col)
        m = square(m)
    return out


_SHIFT: list[np.ndarray] = []


def crc32_concat(first: np.ndarray, second: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of a concatenation, from the parts' and the length of the second."""
    if not _SHIFT:
        _SHIFT.append(_shift_tables())
    out = first.astype(np.uint32)
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        t = _SHIFT[0][k]
        moved = t[0][out & 255] ^ t[1][out >> 8 & 255] ^ t[2][out >> 16 & 255] ^ t[3][out >> 24]
        out = np.where(n_bytes >> k & 1, moved, out)
    return out ^ second.astype(np.uint32)


def _entries(manifest: DataFrame) -> DataFrame:
    """The chunks of documents, each distinct one of a batch once, with the places (start of the
    document, number ``k`` in it) it stands at: a chunk that many documents share is a row a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recipes = batch.column("recipe").to_pylist()
            count = np.array([len(r) // 36 for r in recipes], np.int64)
            blob = b"".join(recipes)
            keys = np.frombuffer(blob, "S36")
            start = np.repeat(batch.column("start").to_numpy(), count)
            k = np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
            order = np.argsort(keys, kind="stable")
            new = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(order) else order
            offs = pa.array(np.append(new, len(order)).astype(np.int32))
            names = [blob[36 * i : 36 * i + 36] for i in order[new].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[:32] for x in names], pa.binary()), pa.array([int.from_bytes(x[32:], "little") for x in names], pa.int64()), *(pa.ListArray.from_arrays(offs, pa.array(c[order])) for c in (start, k))],
                names=["digest", "n_want", "starts", "ks"],
            )

    return manifest.select("start", "recipe").mapInArrow(run, "digest binary, n_want long, starts array<long>, ks array<long>")


def _placed(entries: DataFrame, *more: str) -> DataFrame:
    return entries.select(F.posexplode("starts").alias("i", "start"), "ks", "n_want", *more).select("start", F.get("ks", F.col("i")).alias("k"), "n_want", *more)


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    Raises if a leaf isn't the hash of its recipe, a part's root not that of its leaves, a
    recipe names a chunk that isn't there or has another length, or the sum of a document's
    chunks isn't its token count. ``start`` tells documents apart, as each holds its end id at least."""
    bad = roots(spark, path).where("NOT (root <=> again) OR wrong > 0").select("part").limit(3).collect()
    if bad:
        raise ValueError(f"the manifest is damaged in parts {[r['part'] for r in bad]}")
    manifest = spark.read.parquet(f"{path}/manifest")
    found = _entries(manifest).join(read_chunks(spark, path).select("digest", "n", "crc32"), "digest", "left")
    parts = _placed(found, "n", "crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("parts")
            offs = np.asarray(lists.offsets)
            offs, flat = offs - offs[0], lists.flatten()
            if flat.field("n").null_count:
                raise ValueError("a recipe names a chunk that the store lacks")
            n, want, crc = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("n", "n_want", "crc32"))
            if (n != want).any():
                raise ValueError("a chunk has another length than its recipe says")
            first, last = offs[:-1], offs[1:]
            out = crc[first].astype(np.uint32)
            for k in range(1, int((last - first).max(initial=0))):
                rows = np.flatnonzero(last - first > k)
                at = first[rows] + k
                out[rows] = crc32_concat(out[rows], crc[at], 4 * n[at])
            total = np.add.reduceat(n, first) if len(first) else n
            yield pa.RecordBatch.from_arrays([batch.column("start"), pa.array(total), pa.array(out.astype(np.int64))], names=["start", "made", "ids_crc32"])

    gathered = parts.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("k", "n", "n_want", "crc32"))).alias("parts"))
    made = gathered.mapInArrow(run, "start long, made long, ids_crc32 long")
    whole = F.when(F.col("made") == F.col("n_tokens"), F.col("made")).otherwise(F.raise_error(F.lit("a document's chunks don't add up")).cast("long"))
    return manifest.select("doc_id", "start", "n_tokens").join(made, "start", "left").select("doc_id", "start", whole.alias("n_tokens"), "ids_crc32")


def read_documents(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id and ids (array of int) of all documents or of those in ``wanted`` (doc_id), from the files."""
    manifest = spark.read.parquet(f"{path}/manifest")
    if wanted is not None:
        manifest = manifest.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    parts = _placed(_entries(manifest).join(read_chunks(spark, path, with_ids=True).select("digest", "ids"), "digest"), "ids")
    whole = parts.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in x), "<u4").astype(np.int64) for x in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("start"), pa.array(ids, pa.list_(pa.int64()))], names=["start", "ids"])

    return manifest.select("doc_id", "start").join(whole.mapInArrow(run, "start long, ids array<long>"), "start").select("doc_id", "ids")


def roots(spark: SparkSession, path: str) -> DataFrame:
    """For each part of the manifest: its recorded root, the root over the recipes as they are
    (again), and how many leaves aren't the hash of their recipe (wrong)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(part, tree, wrong):
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([tree.root()]), pa.array([wrong])], names=["part", "again", "wrong"])

        now, tree, wrong = None, Merkle(), 0
        for batch in batches:
            for part, recipe, leaf in zip(*(batch.column(c).to_pylist() for c in ("part", "recipe", "leaf"))):
                if part != now:
                    if now is not None:
                        yield close(now, tree, wrong)
                    now, tree, wrong = part, Merkle(), 0
                own = hashlib.sha256(recipe).digest()
                wrong += own != leaf
                tree.add(own)
        if now is not None:
            yield close(now, tree, wrong)

    rows = spark.read.parquet(f"{path}/manifest").select("part", "row", "recipe", "leaf").repartition("part").sortWithinPartitions("part", "row")
    again = rows.mapInArrow(run, "part long, again binary, wrong long")
    return spark.read.parquet(f"{path}/merkle").select("part", "root").join(again, "part", "full").select("part", "root", "again", "wrong")


def store_root(spark: SparkSession, path: str) -> str:
    """One hash for the whole store: the root over the parts' roots (a row for each part)."""
    tree = Merkle()
    for r in spark.read.parquet(f"{path}/merkle").orderBy("part").select("root").collect():
        tree.add(bytes(r["root"]))
    return tree.root().hex()


def store_and_verify(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    spark = docs.sparkSession
    path = new_path(spark, "token-store")
    write_store(docs, tokenizer, path, end_id)
    return verify(spark, path)
