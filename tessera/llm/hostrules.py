"""Host-level quality rules (operator 3), DataFrame functions only.

Each document is measured by itself; a host (``source``) is judged by the share of
its documents that fail, shrunk towards the shares of all hosts by a beta prior
that is fitted to them by moments: (failed + a) / (n + a + b). A document stays if
it passes its own rules and its host's shrunk share is at most ``host_limit``.

Defined results: null text has no words and so fails; a null source is no host and
passes; hosts are not told apart by repeated rows or null ids; with fewer than two
hosts, or equal shares, the prior is worth ``prior_weight`` documents at the mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACES, SYMBOLS, WINDOW = " \t\n\x0b\x0c\r", "#*$%&|<>", 8


def _deleted(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Repeated windows: each window of eight words is hashed (64 bits) with its place;
    after a sort, equal hashes are neighbours. A window with an equal one covers
    eight words, less what the next such window covers already."""
    text = F.coalesce("text", F.lit(""))
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    first = docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        (F.length(text) - _deleted(text, SPACES)).cast("long").alias("word_chars"),
        _deleted(text, SYMBOLS).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(F.array_remove(F.split(spaced, " ", -1), ""), lambda w: F.xxhash64(w)).alias("words"),
    )
    n = F.size("words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    second = first.select(
        "doc_id", "source", "word_chars", "n_symbols",
        n.cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    third = second.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def near(step: int):
        return lambda x, k: F.get("sorted", k + step)["h"].eqNullSafe(x["h"])

    repeated = F.filter("sorted", lambda x, k: near(1)(x, k) | ((k > 0) & near(-1)(x, k)))
    fourth = third.withColumn("at", F.sort_array(F.transform(repeated, lambda x: x["i"]))).drop("sorted", "windows")
    covered = F.aggregate(F.transform("at", lambda p, k: F.least(F.coalesce(F.get("at", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return fourth.select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def host_rates(measured: DataFrame, prior_weight: float = 10.0) -> DataFrame:
    """source, n_docs, n_failed, shrunk: a row for each host."""
    hosts = measured.where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    share = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("mean"), F.var_samp(share).alias("var"))
    weight = F.col("mean") * (1 - F.col("mean")) / F.col("var") - 1
    usable = F.col("var").isNotNull() & (F.col("var") > 0)
    prior = moments.select("mean", F.when(usable, F.greatest(weight, F.lit(1.0))).otherwise(F.lit(prior_weight)).alias("weight"))
    return hosts.join(F.broadcast(prior)).select("source", "n_docs", "n_failed", ((F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))).alias("shrunk"))


def judge(docs: DataFrame, min_words: int = 20, repeat_percent: int = 30, host_limit: float = 0.5) -> DataFrame:
    """The measures with base_failed, kept and the host's shrunk share."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    measured = materialize(measure(docs).withColumn("base_failed", failed), "measures")
    hosts = host_rates(measured).select("source", F.col("shrunk").alias("host_rate"))
    kept = ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= host_limit)
    return measured.join(hosts, "source", "left").withColumn("kept", kept)
