"""Ranked lexical search by a hierarchy of maxima (operator 11).

The index. Documents lie in shards of neighbouring rows; in a shard each has a number, in
the order of doc_id. A term has in a shard its postings (numbers and impacts; an impact is
the part of the score that is not the term's weight) and a tree over ranges of FAN,
FAN**2, ... numbers: for each range that holds a posting, the largest impact in it. The
root, ``best``, stands beside the lists, so whole shards are judged without them.

The search. A range can't score more than the sum of weight times largest impact over an
item's terms. For each item and shard, ranges are opened from the highest bound down until
none left reaches the score of the k-th document found; ranges whose bound equals it are
still opened, as a document with the same score and a smaller doc_id may lie there. It goes
in two waves: each item first searches the ``first`` shards of its highest root bounds; the
score of its k-th document there is the threshold for all other shards, and shards whose
root stays below it are never read.

Integer arithmetic throughout (sums stay below 2**53, so sums in doubles are exact too).

Defined results: a null or empty text has no term and counts neither in N nor in the
ranking; repeated rows and repeated ids are ranked as documents of their own, null ids
after all others at equal scores; rows with one item_id are one item with the terms of all
of them; a row without item_id is no item; an item without terms, or whose terms occur
nowhere, has no rows; empty tables give no rows; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize, slices, trim, utf8_column
from .terms import LOWER, UPPER, as_text, byte_class, encode_terms, flat, lists

#: Fixed values of the ranking function.
K1_MILLI, SCALE, LENGTH_PART, HUNDRED, WEIGHT_SCALE = 20, 1_000_000_000, 50, 100, 1000

SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: What lies between terms, for Java.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FAN = 16
_LEVEL = 1 << 32


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """N, the documents with a term, and L, the terms of all of them."""
    n = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), BETWEEN, -1), ""))
    row = docs.select(n.alias("n")).where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def _shard(ids: np.ndarray, null: np.ndarray, codes: np.ndarray, counts: np.ndarray, n_terms: int, size: int, length: int) -> dict:
    """Postings and trees of the documents with terms, sorted by term."""
    some = np.flatnonzero(counts)
    order = some[np.lexsort((ids[some], null[some]))]
    number = np.zeros(len(counts), np.int64)
    number[order] = np.arange(len(order))
    key, tf = np.unique(codes.astype(np.int64) * max(len(order), 1) + np.repeat(number, counts), return_counts=True)
    code, at = np.divmod(key, max(len(order), 1))
    m = HUNDRED - LENGTH_PART + (LENGTH_PART * counts[order].astype(np.int64) * size) // length
    impact = (SCALE * tf) // (1000 * tf + K1_MILLI * m[at])
    levels, node, owner, most = [], at, code, impact
    fan = FAN
    while True:
        parent = owner * _LEVEL + node // FAN
        cut = np.flatnonzero(np.diff(parent, prepend=-1)) if len(parent) else np.zeros(0, np.int64)
        owner, node, most = parent[cut] // _LEVEL, parent[cut] % _LEVEL, np.maximum.reduceat(most, cut) if len(cut) else most[:0]
        levels.append((owner, node, most))
        if fan >= len(order):
            break
        fan *= FAN
    # of each term all levels one after the other, the lowest first
    owners = np.concatenate([x[0] for x in levels])
    turn = np.lexsort((np.concatenate([np.full(len(x[0]), i) for i, x in enumerate(levels)]), owners))
    ranges = np.concatenate([x[1] + (i + 1) * _LEVEL for i, x in enumerate(levels)])[turn]
    bounds = np.concatenate([x[2] for x in levels])[turn]
    best = np.zeros(n_terms, np.int64)
    best[levels[-1][0]] = levels[-1][2]
    return {"order": order, "sizes": np.bincount(code, minlength=n_terms), "at": at.astype(np.int32), "impact": impact, "nodes": np.bincount(owners, minlength=n_terms), "ranges": ranges, "bounds": bounds, "best": best}


def build_index(docs: DataFrame, size: int, length: int, shard_bytes: int = 1 << 23) -> DataFrame:
    """A row for each shard and term (term, size, best, at, impact, ranges, bounds), and for
    each shard one without a term that holds its doc_ids. A shard's name is its number in the
    task and a fingerprint of what it holds, so a task that runs again names it alike."""
    inside = byte_class(SEPARATORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8_column(batch.column("text"))
            for i, j in slices(offs, shard_bytes):
                codes, names, counts = encode_terms(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], inside)
                if not len(codes):
                    continue
                column = batch.column("doc_id").slice(i, j - i)
                null = column.is_null().to_numpy(zero_copy_only=False)
                ids = column.fill_null(0).to_numpy(zero_copy_only=False)
                x = _shard(ids, null, codes, counts, len(names), size, length)
                own = column.take(pa.array(x["order"]))
                name = batch.column("place")[i].as_py()
                n = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(name), n), as_text(names), pa.array(x["sizes"]), pa.array(x["best"]), lists(x["at"], x["sizes"]), lists(x["impact"], x["sizes"]), lists(x["ranges"], x["nodes"]), lists(x["bounds"], x["nodes"]), pa.nulls(n, pa.list_(pa.int64()))],
                    names=_FIELDS,
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([None], pa.string()), pa.array([len(own)], pa.int64()), pa.array([0], pa.int64()), *(pa.nulls(1, pa.list_(t)) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64())), pa.ListArray.from_arrays([0, len(own)], own)],
                    names=_FIELDS,
                )
        trim()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("place"))
    return rows.mapInArrow(run, "shard long, term string, size long, best long, at array<int>, impact array<bigint>, ranges array<bigint>, bounds array<bigint>, ids array<bigint>")


_FIELDS = ["shard", "term", "size", "best", "at", "impact", "ranges", "bounds", "ids"]


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: once each."""
    words = F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), BETWEEN, -1)
    return items.where("item_id IS NOT NULL").select("item_id", F.explode(words).alias("term")).where("term <> ''").distinct()


def _open(weights: np.ndarray, trees: tuple, postings: tuple, levels: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the documents of one item that may be among its k best: all
    with at least ``least`` and at least the k-th best score here."""
    (key, most), (doc_key, impact) = trees, postings
    owner, place = np.divmod(key, 64 * _LEVEL)
    level, node = np.divmod(place, _LEVEL)
    top = level == levels
    roots, back = np.unique(node[top], return_inverse=True)
    front = [np.bincount(back, weights[owner[top]] * most[top], len(roots)).astype(np.int64), np.full(len(roots), levels), roots]
    found_at, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
    terms = np.arange(len(weights), dtype=np.int64)
    while len(front[0]):
        peak = front[0].max()
        if peak < least or peak <= 0:
            break
        # the best node of the highest level that is left among those with the highest bounds
        take = np.argsort(-front[0], kind="stable")[:32]
        take = take[front[0][take] >= least]
        lev = front[1][take[0]]
        take = take[front[1][take] == lev]
        opened = front[2][take]
        front = [np.delete(x, take) for x in front]
        if lev == 1:
            keys, base = doc_key, terms * _LEVEL
        else:
            keys, base = key, terms * (64 * _LEVEL) + (lev - 1) * _LEVEL
        lo = np.searchsorted(keys, (base[:, None] + opened * FAN).ravel())
        hi = np.searchsorted(keys, (base[:, None] + opened * FAN + FAN).ravel())
        n = hi - lo
        if not n.sum():
            continue
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        which = np.repeat(np.arange(len(n)), n)
        term, parent = np.divmod(which, len(opened))
        child = keys[at] - base[term]
        value = weights[term] * (impact if lev == 1 else most)[at]
        slot = parent * FAN + child - opened[parent] * FAN
        total = np.bincount(slot, value, len(opened) * FAN).astype(np.int64)
        name = (opened[:, None] * FAN + np.arange(FAN)).ravel()
        good = (total > 0) & (total >= least)
        if lev == 1:
            found_at, found = np.concatenate([found_at, name[good]]), np.concatenate([found, total[good]])
            if len(found) >= k:
                least = max(least, int(np.partition(found, len(found) - k)[len(found) - k]))
                stay = found >= least
                found_at, found = found_at[stay], found[stay]
        else:
            front = [np.concatenate([x, y]) for x, y in zip(front, (total[good], np.full(good.sum(), lev - 1), name[good]))]
        stay = front[0] >= least
        if not stay.all():
            front = [x[stay] for x in front]
    return found_at, found


def _search(index: DataFrame, wanted: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """item_id, doc_id, score of the documents of ``wanted`` shards (shard, block, item_id,
    least) that may be among the k best of their item."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("ids")[0].values
        pairs = right.column("pairs")[0].as_py()
        n, levels = len(ids), 1
        while FAN**levels < n:
            levels += 1
        left = left.combine_chunks()
        at, at_off = flat(left.column("at"))
        impact, _ = flat(left.column("impact"))
        ranges, range_off = flat(left.column("ranges"))
        bounds, _ = flat(left.column("bounds"))
        weight = left.column("w").to_numpy()
        holders = left.column("items").to_pylist()
        of: dict = {}
        for row, names in enumerate(holders):
            for x in names:
                of.setdefault(x, []).append(row)
        out_item, out_id, out_score = [], [], []
        for pair in pairs:
            item, least = pair["item_id"], pair["least"]
            rows = np.array([r for r in of.get(item, []) if weight[r] > 0], np.int64)
            if not len(rows):
                continue
            gather = lambda values, offs, step: (np.concatenate([values[offs[r] : offs[r + 1]] + i * step for i, r in enumerate(rows)]))
            trees = gather(ranges, range_off, 64 * _LEVEL), gather(bounds, range_off, 0)
            postings = gather(at.astype(np.int64), at_off, _LEVEL), gather(impact, at_off, 0)
            where, score = _open(weight[rows], trees, postings, levels, k, least)
            if len(where) > k:  # equal scores: the smallest numbers, which are the smallest ids
                best = np.lexsort((where, -score))[:k]
                where, score = where[best], score[best]
            out_item += [item] * len(where)
            out_id.append(where)
            out_score.append(score)
        empty = np.zeros(0, np.int64)
        where = pa.array(np.concatenate(out_id) if out_id else empty)
        return pa.table({"item_id": pa.array(out_item, right.schema.field("pairs").type.value_type.field("item_id").type), "doc_id": ids.take(where).cast(pa.int64()), "score": pa.array(np.concatenate(out_score) if out_score else empty)})

    names = index.where("term IS NULL").select("shard", "ids")
    lists_ = index.where("term IS NOT NULL").join(asked, "term").select("shard", "block", "w", "items", "at", "impact", "ranges", "bounds")
    groups = wanted.groupBy("shard", "block").agg(F.collect_list(F.struct("item_id", F.coalesce("least", F.lit(0).cast("long")).alias("least"))).alias("pairs"))
    pairs = groups.join(names, "shard")
    lists_ = lists_.join(groups.select("shard", "block"), ["shard", "block"], "left_semi")
    kind = wanted.schema["item_id"].dataType.simpleString()
    return lists_.groupBy("shard", "block").cogroup(pairs.groupBy("shard", "block")).applyInArrow(run, f"item_id {kind}, doc_id long, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, first: int = 4, items_in_block: int = 1000) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each item."""
    size, length = corpus_size(docs)
    with Scratch(docs.sparkSession) as own:
        terms = own.table(item_terms(items), "item-terms", gather=True)
        blocks = max(1, -(-terms.select("item_id").distinct().count() // items_in_block))
        # of the index only what this search reads is written: the items' terms and the rows without a term
        some = terms.select(F.col("term").alias("asked")).unionByName(terms.select(F.lit(None).cast("string").alias("asked")).limit(1)).distinct()
        index = own.table(build_index(docs, size, max(length, 1)).join(some, F.col("term").eqNullSafe(F.col("asked")), "left_semi"), "index")
        weight = F.floor(WEIGHT_SCALE * F.log((2 * F.lit(size).cast("double") + 2) / (2 * F.sum("size") + 1)))
        weights = index.where("term IS NOT NULL").groupBy("term").agg(weight.alias("w"))
        block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
        asked = own.table(terms.join(weights, "term").groupBy("term", "w", block.alias("block")).agg(F.collect_list("item_id").alias("items")), "asked", gather=True)
        roots = index.where("term IS NOT NULL").select("shard", "term", "best").join(asked, "term").select("shard", "block", F.explode("items").alias("item_id"), (F.col("w") * F.col("best")).alias("bound"))
        bounds = own.table(roots.groupBy("shard", "block", "item_id").agg(F.sum("bound").alias("bound")).where("bound > 0"), "bounds", gather=True)
        turn = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("bound"), "shard"))
        start = own.table(bounds.withColumn("turn", turn).where(F.col("turn") <= first).select("shard", "block", "item_id", F.lit(0).cast("long").alias("least")), "first", gather=True)
        found = own.table(_best(_search(index, start, asked, k), k), "found", gather=True)
        least = found.where(F.col("rank") == k).select("item_id", F.col("score").alias("least"))
        rest = bounds.join(start.select("shard", "item_id"), ["shard", "item_id"], "left_anti").join(least, "item_id", "left").where("least IS NULL OR bound >= least")
        more = _search(index, rest.select("shard", "block", "item_id", "least"), asked, k)
        return materialize(_best(found.drop("rank").unionByName(more), k).select("item_id", "rank", "doc_id", "score"), "ranked")
