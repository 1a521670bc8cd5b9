"""Toxicity by nearest labelled examples (operator 8).

Words are runs of letters of the lower-cased text (any character beyond ASCII counts as a
letter, but for general and Latin-1 punctuation), known by 64-bit fingerprints. Examples
are at most ``examples`` labelled documents of each label, by a hash of the text, equal
texts as one with the votes of all; the bound is on labelled rows alone. The space has every
word of every example: a word that no example has can't bring two texts nearer. Weights are
(1 + ln tf) * ln(1 + docs / df) * relevance, with document frequencies over all documents.
Relevance is the squared distance of the word's share of toxic documents from that of all,
in log-odds, among all labelled training documents; the share is shrunk by ``prior_docs``
documents, so that words seen a few times, or alike in both labels, weigh little. There
is no threshold and no choice of features.

The k nearest by exact cosine come from an inverted index in blocks: a word's postings are
grouped by block of examples, each group with its largest weight. A query's bound for a
block is the sum of those maxima; blocks are scored by falling bounds until the next bound
is below the k-th best similarity, so nothing that could be nearer is left out. The score
is the vote of the neighbours by squared similarity. Examples stand for the labelled
documents of their label, so votes are weighted by the true rates of the labels, and a
pull of ``prior_weight`` towards the rate of toxic documents settles texts that are
near to nothing. ``evidence`` lists the neighbours' ids (of equal texts the smallest).

Defined results: null text counts as empty, and a text without a word of any example gets
the rate of toxic labels; null labels teach nothing; of repeated labels of one doc_id the
largest counts; rows that share a doc_id are taught by its label each; ties in similarity go
to the example with the smaller hash; without labels every score is 0; extra columns are
ignored; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE_A, Scratch, fingerprints, materialize, prefix_sums, slices, utf8_column
from .tokens import Table, _runs

BLOCK = 64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of lower-cased texts, and the text each is in."""
    letter = _LETTER[data]
    for lead, size, first, last in ((0xE2, 3, 0x80, 0x80), (0xC2, 2, 0x80, 0xBF)):  # U+2000 to U+203F, U+0080 to U+00BF
        at = np.flatnonzero(data[: len(data) - 1] == lead)
        at = at[(data[at + 1] >= first) & (data[at + 1] <= last)]
        if lead == 0xC2:
            at = at[~np.isin(data[at + 1], (0xAA, 0xB5, 0xBA))]
        for k in range(size):
            letter[np.minimum(at + k, len(data) - 1)] = False
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    begin, end = letter.copy(), letter.copy()
    begin[1:] &= ~letter[:-1] | edge[1:-1]
    end[:-1] &= ~letter[1:] | edge[1:-1]
    start = np.flatnonzero(begin)
    keys = fingerprints(prefix_sums(data, BASE_A), BASE_A, start, np.flatnonzero(end) + 1) | np.uint64(1)
    return keys, np.searchsorted(offs, start, "right") - 1


def _slices(batch: pa.RecordBatch):
    """(first row, rows, fingerprints, row of each) for runs of rows of about 1 MB."""
    data, offs = utf8_column(batch.column("text"))
    for i, j in slices(offs, 1 << 20):
        part = data[offs[i] : offs[j]]
        keys, row = words(part, offs[i : j + 1] - offs[i]) if len(part) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield i, j - i, keys, row


def _vocabulary(taught: DataFrame) -> np.ndarray:
    """The distinct words of the examples, sorted; as many as a bounded number of texts has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, keys, _ in _slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(keys).view(np.int64))], names=["word"])

    found = taught.select("text").mapInArrow(run, "word long").distinct().toArrow().column("word").to_numpy()
    return np.sort(found.view(np.uint64))


def _vectors(docs: DataFrame, vocabulary, keep: list[str]) -> DataFrame:
    """The columns ``keep``, with f (numbers of words of the vocabulary, ascending) and tf."""
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("f", ints), T.StructField("tf", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        table = Table(max(17, (2 * len(known)).bit_length()))
        if len(known):
            table.add(known, np.arange(len(known), dtype=np.uint32), np.ones(len(known), np.int64))
        for batch in batches:
            for first, rows, keys, row in _slices(batch):
                place = table.find(keys)
                own = place >= 0
                pairs, tf = np.unique(row[own] * len(known) + table.pool[table.at[place[own]]], return_counts=True)
                offs = pa.array(np.searchsorted(pairs, np.arange(rows + 1) * len(known)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offs, pa.array(x.astype(np.int32))) for x in (pairs % max(len(known), 1), tf)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, rows) for c in keep), *lists], names=[*keep, "f", "tf"])

    return docs.mapInArrow(run, schema)


def _counts(vectors: DataFrame, size: int) -> np.ndarray:
    """side x word: documents of each side (0, 1; column ``side``) that have the word, counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, size), np.int64)
        for batch in batches:
            lists = batch.column("f")
            side = np.repeat(batch.column("side").to_numpy(), np.diff(np.asarray(lists.offsets)))
            for k in (0, 1):
                count[k] += np.bincount(np.asarray(lists.flatten(), np.int64)[side == k], minlength=size)
        k, x = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(x), pa.array(count[k, x])], names=["side", "x", "n"])

    out = np.zeros((2, size), np.int64)
    found = vectors.select("side", "f").mapInArrow(run, "side long, x long, n long").groupBy("side", "x").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("side").to_numpy(), found.column("x").to_numpy()] = found.column("n").to_numpy()
    return out


class Index:
    """Examples in blocks, and for each word a list of cells: the block, its largest weight, and its postings."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], n_words: int):
        self.n = len(rows)
        self.blocks = -(-self.n // BLOCK)
        sizes = [len(f) for f, _ in rows]
        word = np.concatenate([f for f, _ in rows]) if rows else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in rows]) if rows else np.zeros(0)
        example = np.repeat(np.arange(self.n), sizes)
        by = np.lexsort((example, word))
        word, self.example, self.weight = word[by], example[by], weight[by]
        cell = word * max(self.blocks, 1) + self.example // BLOCK
        begin = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cell_start = np.append(begin, len(cell))
        self.cell_block = (self.example[begin] // BLOCK).astype(np.int64)
        self.cell_max = np.maximum.reduceat(self.weight, begin) if len(begin) else np.zeros(0)
        self.word_start = np.searchsorted(word[begin], np.arange(n_words + 1))

    def nearest(self, f: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples with a word in common; ties to the first."""
        cells_n = self.word_start[f + 1] - self.word_start[f]
        cells = _runs(self.word_start[f], cells_n)
        by = np.repeat(w, cells_n)
        blocks = self.cell_block[cells]
        bounds = np.bincount(blocks, by * self.cell_max[cells], self.blocks)
        order = np.argsort(-bounds, kind="stable")
        order = order[: np.count_nonzero(bounds > 0)]
        best_s, best_i = np.zeros(0), np.zeros(0, np.int64)
        at, many = 0, 2
        while at < len(order) and not (len(best_s) >= k and bounds[order[at]] < best_s[k - 1]):
            if len(best_s) >= k:
                many = max(1, np.count_nonzero(bounds[order[at:]] >= best_s[k - 1]))
            some = np.zeros(self.blocks, bool)
            some[order[at : at + many]] = True
            own = some[blocks]
            mine = cells[own]
            n = self.cell_start[mine + 1] - self.cell_start[mine]
            post = _runs(self.cell_start[mine], n)
            s = np.bincount(self.example[post], self.weight[post] * np.repeat(by[own], n), self.n)
            i = np.flatnonzero(s > 0)
            best_s, best_i = np.concatenate([best_s, s[i]]), np.concatenate([best_i, i])
            if len(best_s) > k:
                near = best_s >= np.partition(best_s, len(best_s) - k)[len(best_s) - k]
                best_s, best_i = best_s[near], best_i[near]
            top = np.lexsort((best_i, -best_s))[:k]
            best_s, best_i = best_s[top], best_i[top]
            at += many
            many *= 4
        return best_i, best_s


def relevance(toxic: np.ndarray, docs: np.ndarray, rate: float, prior_docs: float) -> np.ndarray:
    share = (toxic + prior_docs * rate) / (docs + prior_docs)
    return (np.log(share / (1 - share)) - np.log(rate / (1 - rate))) ** 2


def score(docs: DataFrame, labels: DataFrame, learn, examples: int = 1000, k: int = 15, prior_docs: float = 5.0, prior_weight: float = 0.05, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted, evidence. ``learn``: the condition on doc_id for rows that may teach."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") != 0).cast("long")).alias("side"))
    with Scratch(spark) as own:
        # labels meet ids and hashes; texts aren't moved. One plan at every size: labels that fit a broadcast today don't in a larger table
        ids = base.where(learn).select("doc_id", F.xxhash64("text").alias("order"))
        taught = own.table(ids.hint("merge").join(known, "doc_id"), "labelled")
        sides = {r["side"]: r["n"] for r in taught.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
        rows, toxic = sum(sides.values()), sides.get(1, 0)
        rate = toxic / rows if rows else 0.0
        grouped = taught.groupBy("order").agg(F.sum((F.col("side") == 0).cast("long")).alias("clean"), F.sum("side").alias("dirty"), F.min("doc_id").alias("first"))
        picked = [r for side in ("dirty > 0", "dirty = 0") for r in grouped.where(side).orderBy("order").limit(examples).collect()]
        if not 0 < rate < 1:
            return materialize(base.select("doc_id", F.lit(rate).alias("score"), F.lit(int(rate >= threshold)).alias("predicted"), F.array().cast("array<bigint>").alias("evidence")), "scores")
        chosen = spark.createDataFrame([(r["first"], r["order"]) for r in picked], "doc_id long, order long")  # 2 * examples rows
        texts = own.table(base.join(F.broadcast(chosen), "doc_id").where(F.xxhash64("text") == F.col("order")).dropDuplicates(["order"]), "examples")
        vocabulary = _vocabulary(texts)
        sent = spark.sparkContext.broadcast(vocabulary)  # the words of the examples
        size = len(vocabulary)
        vectors = own.table(_vectors(base, sent, ["doc_id"]), "vectors")
        held = {r["order"]: (np.array(r["f"], np.int64), np.array(r["tf"])) for r in _vectors(texts, sent, ["order"]).collect()}
        total = vectors.count()
        df = _counts(vectors.withColumn("side", F.lit(0).cast("long")), size)[0]
        seen = _counts(vectors.where(learn).hint("merge").join(known, "doc_id"), size)
        scale = np.log1p(total / np.maximum(df, 1)) * relevance(seen[1], seen.sum(0), rate, prior_docs)

        def unit(f: np.ndarray, tf: np.ndarray) -> np.ndarray:
            w = (1 + np.log(tf)) * scale[f]
            return w / (np.sqrt((w * w).sum()) or 1.0)

        # examples that share their heaviest word share blocks, so that maxima are tight
        found = [(r, held[r["order"]][0], unit(*held[r["order"]])) for r in picked]
        found.sort(key=lambda x: (int(x[1][x[2].argmax()]) if len(x[1]) else -1, x[0]["order"]))
        clean, dirty = (np.array([r[c] for r, _, _ in found], float) for c in ("clean", "dirty"))
        weight = np.array([(rows - toxic) / max(clean.sum(), 1), toxic / max(dirty.sum(), 1)]) * (clean.sum() + dirty.sum()) / rows
        names = np.array([r["first"] for r, _, _ in found], np.int64)
        ready = spark.sparkContext.broadcast((Index([(f, w) for _, f, w in found], size), clean * weight[0], dirty * weight[1], names, scale))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, clean, dirty, names, scale = ready.value
            made: dict[bytes, tuple[float, list[int]]] = {}  # copies of a text
            for batch in batches:
                lists, tfs = batch.column("f"), batch.column("tf")
                offs = np.asarray(lists.offsets)
                flat, tf = (np.asarray(x.flatten(), np.int64) for x in (lists, tfs))
                out_s, out_e = [], []
                for lo, hi in zip((offs - offs[0])[:-1].tolist(), (offs - offs[0])[1:].tolist()):
                    f, n = flat[lo:hi], tf[lo:hi]
                    key = f.tobytes() + n.tobytes()
                    if key not in made:
                        if len(made) > 2_000:
                            made.clear()
                        w = (1 + np.log(n)) * scale[f]
                        live = w > 0
                        f, w = f[live], w[live]
                        at, s = index.nearest(f, w / (np.sqrt((w * w).sum()) or 1.0), k)
                        s = s * s
                        one, all_ = (s * dirty[at]).sum(), (s * (clean[at] + dirty[at])).sum()
                        made[key] = float((one + prior_weight * rate) / (all_ + prior_weight)), names[at][:5].tolist()
                    a, b = made[key]
                    out_s.append(min(max(a, 0.0), 1.0))
                    out_e.append(b)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out_s, pa.float64()), pa.array([int(x >= threshold) for x in out_s], pa.int32()), pa.array(out_e, pa.list_(pa.int64()))], names=["doc_id", "score", "predicted", "evidence"])

        return materialize(vectors.mapInArrow(run, "doc_id long, score double, predicted int, evidence array<long>"), "scores")
