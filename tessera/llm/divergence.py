"""How far the sources of a language are from each other: joint count histograms (operator 13).

1. Tasks count terms by language and source, and in how many documents each stands; the
   counts are summed by Spark. A term is kept for a language that has it in enough documents.
2. Buckets of a language's terms tally, for every two of its sources, how often each
   combination (count there, count here) of two counts above zero occurs. What follows from
   the sources' own histograms is not tallied but implied: a count beside zero is what the
   histogram holds beyond the tallied combinations, two zeros are the rest of the V terms.
3. The divergence is evaluated once for each combination of a pair, times its multiplicity.

Sources of a bucket are compared in tiles of ``tile`` by ``tile``, so no matrix is wider. The
result has a row for each ordered pair of a language's sources, as asked for; pairs are never
written out for single terms.

Defined results: null text, language or source count as empty strings; a group without terms
has its pairs; a language without kept terms has pairs of value 0; repeated rows and ids are
documents of their own; an empty table gives no rows; extra columns are ignored. Counts are
exact up to 10**19 occurrences of a term (decimals before the division); a sum that
leaves 64 bits raises an error instead of a wrong value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize, slices, trim, utf8_column
from .terms import as_text, byte_class, encode_terms, lists

#: Fixed value: parts of one that a probability is given in.
PARTS = 1_000_000_000
SEPARATORS = "".join(map(chr, [*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def count_terms(docs: DataFrame, slice_bytes: int = 1 << 23) -> DataFrame:
    """lang, source, term, n (occurrences), docs: sums over slices of a task's documents;
    for each group of a slice also a row without a term."""
    inside = byte_class(SEPARATORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8_column(batch.column("text"))
            lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            for i, j in slices(offs, slice_bytes):
                own, number = np.unique(group[i:j], return_inverse=True)
                codes, names, counts = encode_terms(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], inside)
                # one sort by group, term and document: neighbours that are equal are occurrences
                width = max(len(names), 1)
                key = ((np.repeat(number, counts) * width + codes) * (j - i) + np.repeat(np.arange(j - i), counts)).astype(np.int64)
                key.sort()
                new_doc = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
                cell = key[new_doc] // (j - i)
                at = np.flatnonzero(np.diff(cell, prepend=-1)) if len(cell) else np.zeros(0, np.int64)
                n = np.diff(np.append(new_doc[at], len(key)))
                n_docs = np.diff(np.append(at, len(cell)))
                where, term = np.divmod(cell[at], width)
                of = np.concatenate([own[where], own])
                none = pa.nulls(len(own), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [lang.dictionary.take(pa.array(of // len(source.dictionary))), source.dictionary.take(pa.array(of % len(source.dictionary))), pa.concat_arrays([as_text(names.take(pa.array(term))), none]), pa.array(np.append(n, np.zeros(len(own), np.int64))), pa.array(np.append(n_docs, np.zeros(len(own), np.int64)))],
                    names=["lang", "source", "term", "n", "docs"],
                )
        trim()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _tally(counts: DataFrame, min_docs: int, tile: int) -> DataFrame:
    """Of each bucket the kept terms (source, term, a: its count, b: the language's) and for
    each two sources, the smaller first, their combinations of counts above zero (source,
    other, and lists a, b, m)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        term, source = (table.column(c).combine_chunks().dictionary_encode() for c in ("term", "source"))
        term, source = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (term, source))
        t, s = term.indices.to_numpy(), source.indices.to_numpy()
        n, docs = table.column("n").to_numpy(), table.column("docs").to_numpy()
        order = np.argsort(t, kind="stable")
        t, s, n, docs = t[order], s[order], n[order], docs[order]
        first = np.flatnonzero(np.diff(t, prepend=-1))
        enough = np.add.reduceat(docs, first) >= min_docs
        keep = enough[t]
        whole = np.add.reduceat(n, first)[t][keep]
        t, s, n = t[keep], s[keep], n[keep]
        number = np.cumsum(enough)[t] - 1
        size, names = int(enough.sum()), source.dictionary.to_pylist()
        by_name = sorted(range(len(names)), key=lambda x: names[x].encode())
        turn = np.empty(len(names), np.int64)
        turn[by_name] = np.arange(len(names))
        values, code = np.unique(n, return_inverse=True)
        parts: dict = {c: [] for c in ("source", "other", "a", "b", "m")}
        column = turn[s]
        for x in range(0, len(names), tile):
            for y in range(x, len(names), tile):
                dense = {}
                for z in {x, y}:
                    inside = (column >= z) & (column < z + tile)
                    dense[z] = np.full((min(tile, len(names) - z), size), -1, np.int64)
                    dense[z][column[inside] - z, number[inside]] = code[inside]
                for i in range(len(dense[x])):
                    held = np.flatnonzero(dense[x][i] >= 0)
                    mine = dense[x][i][held] * len(values)
                    for j in range(i + 1 if x == y else 0, len(dense[y])):
                        yours = dense[y][j][held]
                        both = yours >= 0
                        pair, m = np.unique(mine[both] + yours[both], return_counts=True)
                        if len(pair):
                            parts["source"].append(names[by_name[x + i]])
                            parts["other"].append(names[by_name[y + j]])
                            for c, v in (("a", values[pair // len(values)]), ("b", values[pair % len(values)]), ("m", m.astype(np.int64))):
                                parts[c].append(v)
        cells, kept = len(parts["source"]), len(t)
        long = np.append(np.ones(kept, np.int64), [len(v) for v in parts["m"]]).astype(np.int64)
        both = lambda x, c: lists(np.concatenate([x.astype(np.int64), *parts[c]]), long)
        return pa.table({
            "lang": pa.repeat(table.column("lang")[0], kept + cells),
            "source": pa.concat_arrays([source.dictionary.take(pa.array(s)), pa.array(parts["source"], pa.string())]),
            "other": pa.concat_arrays([pa.nulls(kept, pa.string()), pa.array(parts["other"], pa.string())]),
            "term": pa.concat_arrays([term.dictionary.take(pa.array(t)), pa.nulls(cells, pa.string())]),
            "a": both(n, "a"), "b": both(whole, "b"), "m": both(np.ones(kept, np.int64), "m"),
        })

    return counts.groupBy("lang", "bucket").applyInArrow(run, "lang string, source string, other string, term string, a array<bigint>, b array<bigint>, m array<bigint>")


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(PARTS * (count + 1) / (total + terms)), null without terms."""
    return F.expr(f"1 + (CAST({count} + 1 AS DECIMAL(20, 0)) * CAST({PARTS} AS DECIMAL(10, 0))) DIV nullif(CAST({total} + {terms} AS DECIMAL(20, 0)), 0)")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV {q}")


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, bucket_rows: int = 400_000, tile: int = 64) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    with Scratch(docs.sparkSession) as own:
        counts = own.table(count_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
        groups = own.table(counts.where("term IS NULL").select("lang", "source"), "groups", gather=True)
        terms = counts.where("term IS NOT NULL")
        buckets = max(1, -(-terms.count() // bucket_rows))
        tallied = own.table(_tally(terms.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets))), min_docs, tile), "tally")
        own.drop("counts")
        kept = tallied.where("other IS NULL").select("lang", "source", "term", F.col("a")[0].alias("n"), F.col("b")[0].alias("whole"))
        cells = tallied.where("other IS NOT NULL").select("lang", "source", "other", F.explode(F.arrays_zip("a", "b", "m")).alias("x")).select("lang", "source", "other", "x.a", "x.b", "x.m")
        v = kept.select("lang", "term", "whole").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("whole").alias("all"))
        totals = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(v, "lang", "left")
        totals = own.table(totals.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("all", F.lit(0)).alias("all")), "totals", gather=True)
        there = totals.select("lang", F.col("source").alias("other"), F.col("total").alias("other_total"))
        pairs = own.table(totals.join(there, "lang").where("source <> other"), "pairs", gather=True)

        held = own.table(kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m")), "histograms", gather=True)
        mine = pairs.select("lang", "source", "other").join(held, ["lang", "source"])
        yours = pairs.select("lang", "source", "other").join(held.withColumnRenamed("source", "other"), ["lang", "other"])
        whole = pairs.where("v > 0").select("lang", "source", "other", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.col("v").alias("m"))
        zero, cell = F.lit(0).cast("long"), lambda a, b, m: F.struct(a.alias("a"), b.alias("b"), m.alias("m"))
        a, b, m, n = (F.col(c) for c in ("a", "b", "m", "n"))
        spread = lambda rows, *cells: rows.select("lang", "source", "other", F.explode(F.array(*cells)).alias("x")).select("lang", "source", "other", "x.a", "x.b", "x.m")
        summed = own.table(cells.groupBy("lang", "source", "other", "a", "b").agg(F.sum("m").alias("m")), "combinations", gather=True)
        turned = summed.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.col("b").alias("a"), F.col("a").alias("b"), "m")
        implied = [spread(t, cell(a, zero, -m), cell(zero, b, -m), cell(zero, zero, m)) for t in (summed, turned)]
        implied += [spread(mine, cell(n, zero, m), cell(zero, zero, -m)), spread(yours, cell(zero, n, m), cell(zero, zero, -m)), whole]
        beside_zero = implied[0]
        for x in implied[1:]:
            beside_zero = beside_zero.unionByName(x)
        beside_zero = beside_zero.groupBy("lang", "source", "other", "a", "b").agg(F.sum("m").alias("m")).where("m > 0")
        every = summed.unionByName(turned).unionByName(beside_zero).join(pairs, ["lang", "source", "other"])
        every = every.withColumn("p", share("a", "total", "v")).withColumn("q", share("b", "other_total", "v"))
        values = every.groupBy("lang", "source", "other").agg(F.sum(divergence("p", "q") * F.col("m")).alias("value"))
        pair_part = pairs.select("lang", "source", "other").join(values, ["lang", "source", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.coalesce("value", zero).alias("value"))

        judged = kept.join(totals, ["lang", "source"]).withColumn("p", share("n", "total", "v")).withColumn("q", share("whole", "all", "v")).where("p > q")
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        term_part = judged.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence("p", "q").alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        pair_part = pair_part.withColumn("rank", F.row_number().over(order))
        return materialize(pair_part.unionByName(term_part).select("lang", "source", "part", "item", "value", "rank"), "divergence")
