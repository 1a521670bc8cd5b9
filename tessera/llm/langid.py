"""Language identification by language-bitmask n-gram filters (operator 1).

One Bloom filter for each language, stored sliced: entry p of the table holds bit p
of every filter, a bit for each language. Looking an n-gram up in ``hashes``
entries and and-ing them gives all languages that contain it. Over a whole text
the hits of each language are counted; a filter whose share of set bits is f lets
f ** hashes of foreign n-grams through, so of n grams (hits - n p) / (1 - p) are
taken as real. The language with most wins, ties go to the first in order.

A language contains an n-gram if the gram's share among its training grams is at least
``contrast`` of the largest share in any language and at least ``least``; so grams of all
languages set all bits and don't decide, and what is rare noise in a large corpus doesn't
enter. A language has at most 1 / ``least`` such grams, whatever the corpus. The table has
``room`` entries for each gram of the language with most, up to a power of two: filters
are no fuller at any size, and what goes to the driver and to each task is bounded (2**22
entries by the defaults). N-grams are four bytes of lower-cased UTF-8 text in which all that
isn't a letter is one space. Counts cover all training documents.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if
nothing was learned; repeated rows count as often as they occur; extra columns are ignored."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, mix

N = 4
_NOT_LETTER = re.compile(r"[\W\d_]+")
_HAS_LETTER = re.compile(r"[^\W\d_]")


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts as integers, and where each text's begin (n + 1 offsets)."""
    blobs = [b" " + _NOT_LETTER.sub(" ", t.lower()).encode("utf-8", "replace") + b" " for t in texts]
    data = np.frombuffer(b"".join(blobs) + b"\0\0\0", np.uint8).astype(np.uint32)
    sizes = np.array([len(b) for b in blobs], np.int64)
    grams = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    inside = np.ones(len(grams), bool)
    ends = np.cumsum(sizes)
    for k in range(1, N):
        inside[ends - k] = False
    short = np.maximum(sizes - (N - 1), 0)
    return grams[inside], np.concatenate([[0], np.cumsum(short)])


def _places(grams: np.ndarray, hashes: int, bits: int) -> Iterator[np.ndarray]:
    h = mix(grams.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    for k in range(hashes):
        yield ((a + np.uint64(k) * b) & np.uint64(bits - 1)).astype(np.int64)


@dataclass
class Filters:
    langs: list[str]
    planes: list[np.ndarray]  # a byte for each eight languages and entry
    rates: np.ndarray  # by language: chance that a foreign n-gram hits
    hashes: int
    bits: int


def _count(train: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs, texts = np.array(batch.column("lang").to_pylist(), object), batch.column("text").to_pylist()
            for lang in dict.fromkeys(langs):
                own = np.flatnonzero(langs == lang)
                for lo in range(0, len(own), 500):
                    grams, counts = np.unique(_grams([texts[i] for i in own[lo : lo + 500]])[0], return_counts=True)
                    held.setdefault(lang, []).append((grams, counts))
                    size += len(grams)
            if size > 4_000_000:
                yield from flush()
                size = 0
        yield from flush()

    counted = train.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, contrast: float = 0.1, least: float = 2e-6, hashes: int = 3, room: int = 8) -> Filters:
    """Learn from lang and text of ``train``; rows with a null in either teach nothing."""
    counts = materialize(_count(train.where("lang IS NOT NULL AND text IS NOT NULL")), "grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row for each language
    langs = sorted(totals)
    bits = 1 << 10
    planes = [np.zeros(bits, np.uint8) for _ in range(0, max(len(langs), 1), 8)]
    if langs:
        number = F.create_map(*[F.lit(x) for k, lang in enumerate(langs) for x in (lang, k)])
        total = F.create_map(*[F.lit(x) for lang in langs for x in (lang, float(totals[lang]))])
        share = counts.withColumn("share", F.col("n") / total[F.col("lang")])
        best = F.max("share").over(Window.partitionBy("gram"))
        member = materialize(share.withColumn("best", best).where((F.col("share") >= contrast * F.col("best")) & (F.col("share") >= least)), "members")
        most = max((r["count"] for r in member.groupBy("lang").count().collect()), default=0)
        bits = max(bits, 1 << (room * most - 1).bit_length())
        planes = [np.zeros(bits, np.uint8) for _ in planes]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                grams, lang = batch.column("gram").to_numpy(), batch.column("k").to_numpy()
                place = np.concatenate(list(_places(grams, hashes, bits)))
                k = np.tile(lang, hashes)
                yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (place, k // 8, np.left_shift(1, k % 8)))], names=["place", "plane", "mask"])

        marks = member.select("gram", number[F.col("lang")].cast("long").alias("k")).mapInArrow(run, "place int, plane int, mask int")
        found = marks.groupBy("plane", "place").agg(F.bit_or("mask").alias("mask")).toPandas()  # at most `bits` rows a plane of 12 bytes
        for plane in range(len(planes)):
            own = found[found["plane"] == plane]
            planes[plane][own["place"].to_numpy()] = own["mask"].to_numpy().astype(np.uint8)
    fill = [float(np.count_nonzero(planes[k // 8] >> (k % 8) & 1)) / bits for k in range(len(langs))]
    return Filters(langs, planes, np.array(fill) ** hashes, hashes, bits)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """The input columns with lang_pred, score (the winner's part of all languages'
    corrected hits) and coverage (the winner's corrected hits by all n-grams)."""
    at_work = docs.sparkSession.sparkContext.broadcast(filters)  # bits entries a plane
    docs = docs.drop("lang_pred", "score", "coverage")  # columns of these names are replaced
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("coverage", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Filters = at_work.value
        n_langs = len(f.langs)
        bit = np.arange(256)[:, None] >> np.arange(8) & 1
        for batch in batches:
            for lo in range(0, batch.num_rows, 400):
                part = batch.slice(lo, 400)
                texts = [t or "" for t in part.column("text").to_pylist()]
                grams, offs = _grams(texts)
                hits = np.zeros((len(texts), 8 * len(f.planes)))
                places = list(_places(grams, f.hashes, f.bits))
                row = np.repeat(np.arange(len(texts)), np.diff(offs)) * 256
                for p, plane in enumerate(f.planes):
                    mask = plane[places[0]]
                    for x in places[1:]:
                        mask &= plane[x]
                    hits[:, 8 * p : 8 * p + 8] = np.bincount(row + mask, minlength=256 * len(texts)).reshape(-1, 256) @ bit
                n = np.diff(offs)[:, None]
                rates = np.minimum(f.rates, 0.999)
                real = np.maximum((hits[:, :n_langs] - n * rates) / (1 - rates), 0) if n_langs else np.zeros((len(texts), 1))
                best = real.argmax(1)
                top, total = real[np.arange(len(texts)), best], real.sum(1)
                known = np.array([bool(_HAS_LETTER.search(t)) for t in texts]) & bool(n_langs)
                score = np.where(known & (total > 0), top / np.maximum(total, 1e-300), 0.0)
                lang = [f.langs[b] if k else "und" for b, k in zip(best, known)]
                cover = np.where(known, np.minimum(top / np.maximum(n[:, 0], 1), 1.0), 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(cover, pa.float64())], names=[*names, "lang_pred", "score", "coverage"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))
