"""Mixing sources to target weights (operator 6).

Sources are dealt out in blocks. Each source's documents are spread over blocks by
a hash, blocks are put in an order by another, and a prefix of them whose words
come nearest below the source's target is drawn; of the next block the documents
that still fit. A target above the source's size takes every document once and
draws the rest so. The drawn blocks of a source are its quota. A tree splits the
quotas among output shards: at each node the children's quotas are one draw from
the multivariate hypergeometric distribution, so every block goes to exactly one
shard and each shard gets its exact number. In a shard documents have a hash order.

Target: ``total`` of all words by weights 3, 1, 2, 3, ... over the sources in code
point order, null last; no target exceeds ``most`` times the source's size, and what
that cuts off goes to the others by weight: target = min(most * size, level *
weight), with the one level at which the sum is right.

Defined results: null text has size 0; a document without words is never taken;
everything is a function of ids, sizes, sources and ``seed``, so reruns agree;
repeated rows of one doc_id share its block and count as separate documents;
an empty table gives no rows. Sources, not documents, come to the driver: a row of about
100 bytes for each and its quota in each shard. A block holds ``block_docs`` documents, or
as many more as keep all blocks together near ``most_blocks``; so one source's blocks are
put in order by one task, and draws are exact integers, whatever the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

SPACES = " \t\n\x0b\x0c\r"


def words(text: str = "text"):
    spaced = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(spaced, " ", -1), "")).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words().alias("size"))


def targets(source_sizes: list[tuple[str | None, int]], weights=(3, 1, 2), total: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """By source, from (source, size) in any order."""
    order = sorted(source_sizes, key=lambda x: (x[0] is None, x[0] or ""))
    rows = sorted(((most * s / weights[k % len(weights)], weights[k % len(weights)], most * s, name) for k, (name, s) in enumerate(order)), key=lambda r: r[0])
    left, weight = total * sum(s for _, s in order), sum(r[1] for r in rows)
    out = {}
    for ratio, w, full, name in rows:
        level = left / weight
        out[name] = full if ratio <= level else level * w
        left -= out[name]
        weight -= w
    return out


def split(quotas: np.ndarray, shards: int, seed: int, path: int = 1) -> np.ndarray:
    """Shards x sources: the blocks each shard gets. Each node draws from a generator of its own."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    total = int(quotas.sum())
    draw = np.random.default_rng([seed, path])
    half = total * left // shards
    mine = draw.multivariate_hypergeometric(quotas, half, method="marginals") if total else quotas * 0
    return np.concatenate([split(mine, left, seed, 2 * path), split(quotas - mine, shards - left, seed, 2 * path + 1)])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pick: 1 where a row's size fits in what the rows before left of its source's room. Rows of a source follow each other."""
    left: dict = {}
    for batch in batches:
        pick = []
        for source, size, room in zip(*(batch.column(c).to_pylist() for c in ("source", "size", "room"))):
            if source not in left:
                left = {source: room}
            pick.append(int(size <= left[source]))
            left[source] -= size * pick[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pick, pa.int32())], names=[*batch.schema.names, "pick"])


def mix(docs: DataFrame, seed: int = 17, block_docs: int = 256, shards: int = 16, most_blocks: int = 1 << 20) -> DataFrame:
    """doc_id, size, source_size, target, taken, and where the copies go: shard_1, shard_2 (-1: none), position."""
    spark = docs.sparkSession
    h = lambda *c: F.xxhash64(F.lit(seed), *[F.lit(x) if isinstance(x, (int, str)) else x for x in c])
    sized = materialize(sizes(docs), "sizes")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).collect()
    in_block = max(block_docs, -(-sum(r["n"] for r in per) // most_blocks))
    goal = targets([(r["source"], r["source_size"]) for r in per])
    plan = []
    for r in per:
        t = goal[r["source"]]
        whole = t >= r["source_size"] > 0
        plan.append((r["source"], r["source_size"], float(t), whole, float(t) - r["source_size"] * whole, max(1, -(-r["n"] // in_block))))
    plans = spark.createDataFrame(plan, "source string, source_size long, target double, whole boolean, want double, blocks long")

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    joined = sized.join(plans, same(sized, plans))
    joined = joined.select(sized["doc_id"], sized["source"], "size", "source_size", "target", "whole", "want", "blocks")
    spread = joined.withColumn("block", F.pmod(h(F.col("doc_id"), "block"), F.col("blocks")))

    # whole blocks: those whose words, added up in the blocks' order, don't exceed what is wanted
    blocks = spread.groupBy("source", "block", "want", "whole").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy(h(F.col("block"), F.coalesce("source", F.lit("")), "order"), "block")
    ranked = materialize(blocks.select("source", "block", "want", "whole", "words", F.row_number().over(order).alias("rank"), F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto")), "blocks")
    state = F.when(F.col("upto") <= F.col("want"), 2).when(F.col("upto") - F.col("words") < F.col("want"), 1).otherwise(0)
    ranked = ranked.select("source", "block", "rank", "whole", state.alias("state"), F.when(state == 1, F.col("want") - F.col("upto") + F.col("words")).alias("room"))

    # quotas: whole passes and drawn blocks; the tree says which shard has which run of them
    drawn = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("state") > 0).cast("long")).alias("drawn"), F.bool_or("whole").alias("whole")).collect()
    drawn.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    quotas = np.array([r["drawn"] + (r["n"] if r["whole"] else 0) for r in drawn], np.int64)
    dealt = split(quotas, shards, seed) if len(quotas) else np.zeros((shards, 0), np.int64)
    upto = np.cumsum(dealt, axis=0).T.tolist()
    runs = spark.createDataFrame([(r["source"], r["n"] if r["whole"] else 0, u) for r, u in zip(drawn, upto)], "source string, first_drawn long, upto array<long>")

    def shard(k):
        return F.size(F.filter("upto", lambda u: u < k)).cast("int")

    where = ranked.join(runs, same(ranked, runs)).select(
        ranked["source"], "block", "state", "room",
        F.when(F.col("whole"), shard(F.col("rank"))).otherwise(-1).alias("shard_whole"),
        F.when(F.col("state") > 0, shard(F.col("rank") + F.col("first_drawn"))).otherwise(-1).alias("shard_drawn"),
    )
    placed = spread.join(where, same(spread, where) & (spread["block"] == where["block"])).select(spread["source"], "doc_id", "size", "source_size", "target", "whole", "state", "room", "shard_whole", "shard_drawn", spread["block"])

    # of the block at the edge, in their order the documents that still fit (at most one block a source)
    edge = placed.where("state = 1").withColumn("order", h(F.col("doc_id"), "edge"))
    fits = edge.repartition("source").sortWithinPartitions("source", "order", "doc_id", "size").drop("order")
    fits = fits.mapInArrow(_fit, T.StructType([*fits.schema.fields, T.StructField("pick", T.IntegerType())]))
    rest = placed.where("state <> 1").withColumn("pick", (F.col("state") == 2).cast("int"))
    both = rest.unionByName(fits)
    some = F.col("size") > 0
    return both.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * (F.col("whole").cast("int") + F.col("pick"))).cast("long").alias("taken"),
        F.when(some & F.col("whole"), F.col("shard_whole")).otherwise(-1).alias("shard_1"),
        F.when(some & (F.col("pick") == 1), F.col("shard_drawn")).otherwise(-1).alias("shard_2"),
        h(F.col("doc_id"), "local").alias("position"),
        "source",
    )
