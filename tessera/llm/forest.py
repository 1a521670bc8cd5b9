"""Hash-prefix forest for largest inner products (operator 5).

A vector's hash string in a tree is 64 bits, each the side of a random hyperplane
through the mean. A tree is the sorted array of its strings. A query descends in
every tree to the entries with the longest common prefix; while the trees together
hold too few entries, all of them ascend one bit at once, which widens each run in
its array. The candidates are then ranked by exact double-precision products.

Inner products of vectors of different lengths are made cosines by one more
component, sqrt(max_norm**2 - norm**2), for hashing alone.

Rows are dealt by a hash to shards of about ``shard_rows``, each with its own trees,
and every query visits every shard, so a query's candidates are a fixed part of all
rows and recall does not fall as the table grows. Equal vectors are one entry: a
query needs only the k + 1 smallest ids of each, as ties go to the smaller id.

Defined results: vectors that are null, empty, zero, of another length than most, or
with null or non-finite components take no part; repeated rows count as candidates each;
fewer than k candidates are all returned; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding")
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")), F.lit(False)))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(finite & some)
    return rows.select(F.col("vec_id").cast("long"), v.cast("array<double>").alias("embedding"))


class Trees:
    """The sorted hash strings of one shard."""

    def __init__(self, x: np.ndarray, mean: np.ndarray, top: float, trees: int, seed: int):
        self.mean, self.top, self.trees = mean, top, trees
        self.planes = np.random.default_rng(seed).standard_normal((trees, x.shape[1] + 1, 64))
        strings = self.strings(x, self._lift(x))
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 1)

    def _lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))

    def strings(self, x: np.ndarray, lift: np.ndarray) -> np.ndarray:
        y = np.concatenate([x - self.mean, lift[:, None]], 1)
        bit = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
        return np.stack([((y @ p) > 0) @ bit for p in self.planes]).astype(np.uint64)

    def candidates(self, q: np.ndarray, want: int) -> list[np.ndarray]:
        """For each query the entries of the longest common prefixes, in all trees together ``want`` at least."""
        strings = self.strings(q, np.zeros(len(q)))
        lo, hi = np.zeros(strings.shape, np.int64), np.full(strings.shape, self.order.shape[1])
        waiting = np.arange(len(q))
        for level in range(20, -1, -1):  # 2**20 entries a shard at most: longer prefixes are unique
            drop = np.uint64(64 - level)
            for t in range(self.trees):
                first = strings[t, waiting] >> drop << drop if level else np.zeros(len(waiting), np.uint64)
                last = first | ((np.uint64(1) << drop) - np.uint64(1) if level else np.uint64(0xFFFFFFFFFFFFFFFF))
                lo[t, waiting] = np.searchsorted(self.sorted[t], first, "left")
                hi[t, waiting] = np.searchsorted(self.sorted[t], last, "right")
            found = (hi[:, waiting] - lo[:, waiting]).sum(0)
            waiting = waiting[found < want]
            if not len(waiting):
                break
        out = []
        for k in range(len(q)):
            seen = np.zeros(self.order.shape[1], bool)
            for t in range(self.trees):
                seen[self.order[t, lo[t, k] : hi[t, k]]] = True
            out.append(np.flatnonzero(seen))
        return out


def search(vectors: DataFrame, every: int = 20, k: int = 20, trees: int = 40, part: float = 1.2, shard_rows: int = 8192, seed: int = 5) -> DataFrame:
    """The k nearest found of each query (vec_id divisible by ``every``). ``part``:
    entries a query gathers in all trees together, as a multiple of the shard's rows."""
    spark = vectors.sparkSession
    good = usable(vectors)
    dims = [r["d"] for r in good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()]
    if not dims:
        return spark.createDataFrame([], RESULT)
    good = good.where(F.size("embedding") == dims[0])
    # equal vectors: the k + 1 smallest ids (a window over a hash of the vector; the vector itself decides)
    same = Window.partitionBy("embedding").orderBy("vec_id")
    kept = good.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    entries = materialize(kept.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    square = lambda: F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    total = entries.agg(F.count(F.lit(1)).alias("n"), F.max(square()).alias("top"), *[F.avg(F.get("embedding", d)).alias(f"m{d}") for d in range(dims[0])]).first()
    mean, top = np.array([total[f"m{d}"] for d in range(dims[0])]), total["top"]
    shards = max(1, -(-total["n"] // shard_rows))

    queries = good.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).distinct()
    sent = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "query_id", "q", F.lit(None).cast("array<bigint>").alias("ids"))
    held = entries.select(F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("long").alias("shard"), F.lit(None).cast("long").alias("query_id"), F.col("embedding").alias("q"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(rows, asked):
            x = np.concatenate(rows["x"]) if rows["x"] else np.zeros((0, dims[0]))
            if not len(x):
                return
            ids = [i for part_ in rows["ids"] for i in part_]
            forest = Trees(x, mean, top, trees, seed)
            for q_ids, q in asked:
                out = ([], [], [])
                for qid, v, found in zip(q_ids, q, forest.candidates(q, max(int(part * len(x)), trees * (k + 1)))):
                    score = (x[found] * v).sum(1)
                    if len(found) > k + 1:
                        edge = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                        near = np.flatnonzero(score >= edge)
                        found, score = found[near], score[near]
                    best = sorted((-s, i) for f, s in zip(found.tolist(), score.tolist()) for i in ids[f] if i != qid)[:k]
                    out[0].extend([qid] * len(best))
                    out[1].extend(i for _, i in best)
                    out[2].extend(-s for s, _ in best)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

        # sorted by shard, entries before queries
        now, rows, asked = None, {"x": [], "ids": []}, []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            x = np.asarray(batch.column("q").flatten(), np.float64).reshape(-1, dims[0])
            asks = np.asarray(batch.column("query_id").is_valid())
            q_ids, ids = batch.column("query_id").to_pylist(), batch.column("ids").to_pylist()
            for s in np.unique(shard):
                if s != now:
                    yield from answer(rows, asked)
                    now, rows, asked = s, {"x": [], "ids": []}, []
                here = shard == s
                own = np.flatnonzero(here & ~asks)
                if len(own):
                    rows["x"].append(x[own])
                    rows["ids"].append([ids[i] for i in own])
                own = np.flatnonzero(here & asks)
                if len(own):
                    asked.append(([q_ids[i] for i in own], x[own]))
        yield from answer(rows, asked)

    dealt = held.unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", F.col("query_id").asc_nulls_first())
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
