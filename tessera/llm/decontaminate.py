"""Benchmark passages in training documents by a positional inverted index (operator 12),
DataFrame functions only.

1. How often each word of the benchmark stands in the training texts is counted first.
2. Of every window of an item (``width`` consecutive words, or a shorter item whole) the
   ``lists`` rarest places are chosen. The index holds the postings of exactly their words:
   document, word (64-bit hash), position.
3. The posting list of a window's rarest word, moved back by the word's place in the item,
   gives where the item would begin in a document; it is intersected with the list of the
   next rarest word, moved back likewise, and so on. Rows never grow after the first list.
4. What remains is compared word for word with the document: exact phrase matches.
   ``proximity`` returns instead the items of which a window's rarest words stand close
   together, in any order.

Documents go by (doc_id, 64-bit hash of the text): rows equal in both have equal results,
and no copy's text is a join key by itself. A word that fills the corpus is a long list only
where it is among the rarest of some window.

Defined results: null and empty texts have no words, and documents without hits the hash of
no items; rows without doc_id are judged like others; an item without words matches nothing;
rows that share an item_id are texts of one item, named once; a null item_id is named by
an empty string; empty tables give no rows or no hits; extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize
from .terms import LOWER, UPPER

#: What lies between words: ASCII that is neither digit nor letter.
SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
DOC = ["doc_id", "tag"]


def _pieces(text: Column) -> Column:
    """Words as they are written, and perhaps one empty string at the end."""
    return F.split(F.ltrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS)), BETWEEN, -1)


def words(text: Column) -> Column:
    return F.array_remove(_pieces(F.translate(text, UPPER, LOWER)), "")


def _lower(word: Column) -> Column:
    """A-Z only; words of ASCII alone take the short way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tag"), "text")


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, tag, pos, term: every word of every text."""
    rows = docs.select(*DOC, F.posexplode(_pieces(F.col("text"))).alias("pos", "word")).where("word <> ''")
    return rows.select(*DOC, "pos", F.xxhash64(_lower(F.col("word"))).alias("term"))


def item_windows(items: DataFrame, counts: DataFrame, width: int, lists: int) -> DataFrame:
    """item, tag of its words, at (first place), places: the rarest places of the window, the
    rarest first (fewer where it is shorter), and their terms."""
    places = items.select("item", "item_tag", "n_words", F.posexplode("words").alias("pos", "word")).withColumn("term", F.xxhash64("word"))
    places = places.join(counts, "term", "left").select("item", "item_tag", "n_words", "pos", "term", F.coalesce("n", F.lit(0)).alias("n"))
    starts = F.sequence(F.greatest(F.col("pos") - (width - 1), F.lit(0)), F.greatest(F.least("pos", F.col("n_words") - width), F.lit(0)))
    of = places.withColumn("at", F.explode(starts)).groupBy("item", "item_tag", "at")
    rarest = F.slice(F.sort_array(F.collect_list(F.struct("n", "pos", "term"))), 1, lists)
    return of.agg(rarest.alias("rarest")).select("item", "item_tag", "at", F.transform("rarest", lambda x: F.struct(x["pos"].alias("pos"), x["term"].alias("term"))).alias("places"))


def _items(items: DataFrame) -> DataFrame:
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words"))
    return rows.where(F.size("words") > 0).select("item", F.xxhash64("words").alias("item_tag"), F.size("words").alias("n_words"), "words").dropDuplicates(["item", "item_tag"])


class PositionalIndex:
    """Postings of training texts for the rarest words of the items' windows."""

    def __init__(self, docs: DataFrame, items: DataFrame, own: Scratch, width: int = 10, lists: int = 2):
        self.docs, self.width, self.own = _tagged(docs), width, own
        self.items = own.table(_items(items), "items", gather=True)
        vocabulary = own.table(self.items.select(F.explode("words").alias("word")).select(F.xxhash64("word").alias("term")).distinct(), "vocabulary", gather=True)
        counts = own.table(tokens(self.docs).select("term").join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "counts", gather=True)
        self.windows = own.table(item_windows(self.items, counts, width, lists), "windows", gather=True)
        needed = own.table(self.windows.select(F.explode("places").alias("x")).select("x.term").distinct(), "needed", gather=True)
        self.postings = own.table(tokens(self.docs).join(needed, "term"), "postings")
        self.lists = lists

    def candidates(self) -> DataFrame:
        """doc_id, tag, item, item_tag, start: where an item would begin (below zero if its
        first words are missing) by the intersected lists of at least one window."""
        same = ["doc_id", "tag", "term", "pos"]
        left = self.windows.select("item", "item_tag", "places").distinct()
        left = left.withColumn("term", F.col("places")[0]["term"])
        rows = self.postings.join(left, "term").select(*DOC, "item", "item_tag", "places", (F.col("pos") - F.col("places")[0]["pos"]).alias("start"))
        right = self.postings.select(*[F.col(c).alias(f"has_{c}") for c in same])
        for k in range(1, self.lists):
            place = F.get("places", F.lit(k))
            rows = rows.withColumn("term", place["term"]).withColumn("pos", F.col("start") + place["pos"])
            meet = rows["doc_id"].eqNullSafe(right["has_doc_id"]) & (rows["tag"] == right["has_tag"]) & (rows["term"] == right["has_term"]) & (rows["pos"] == right["has_pos"])
            shorter = rows.where(F.size("places") <= k)
            rows = rows.where(F.size("places") > k).join(right, meet, "left_semi").unionByName(shorter).drop("term", "pos")
        return rows.select(*DOC, "item", "item_tag", "start").distinct()

    def phrases(self) -> DataFrame:
        """doc_id, tag, item, pos: every word of a document inside an occurrence of a window of
        the item, compared word for word."""
        found = self.own.table(self.candidates(), "candidates", gather=True)
        which = found.select(*DOC).distinct()
        text = _join_docs(self.docs, which, "left_semi").dropDuplicates(DOC).select(*DOC, words(F.col("text")).alias("text_words"))
        # the text comes last, and only the words beside the item go on from there
        both = _join_docs(found.join(self.items, ["item", "item_tag"]), text, "inner")
        start = F.greatest(F.col("start"), F.lit(0))
        cut = both.select(*DOC, "item", start.alias("from"), F.least(F.col("n_words"), F.lit(self.width)).alias("width"),
            F.slice("text_words", start + 1, F.col("start") + F.col("n_words") - start).alias("there"),
            F.slice("words", start - F.col("start") + 1, F.col("n_words")).alias("here"))
        cut = cut.withColumn("n", F.least(F.size("there"), F.size("here"))).where("n >= width")
        # how many words up to each place differ; a window without a difference is an occurrence
        differ = F.transform(F.arrays_zip("there", "here"), lambda x: F.when(x["there"] == x["here"], 0).otherwise(1))
        runs = cut.select(*DOC, "item", "from", "width", "n", differ.alias("differ"))
        starts = F.filter(F.sequence(F.lit(0), F.col("n") - F.col("width")), lambda i: ~F.array_contains(F.slice("differ", i + 1, F.col("width")), 1))
        hits = runs.select(*DOC, "item", "from", "width", starts.alias("starts")).where(F.size("starts") > 0)
        inside = F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + F.col("width") - 1))))
        return hits.select(*DOC, "item", "from", F.explode(inside).alias("i")).select(*DOC, "item", (F.col("from") + F.col("i")).alias("pos"))

    def proximity(self, slop: int = 5) -> DataFrame:
        """doc_id, tag, item: documents in which all chosen words of a window stand, each off its
        place by at most ``slop`` against the others. Order doesn't matter within that."""
        places = self.windows.select("item", "item_tag", F.explode("places").alias("x")).select("item", "item_tag", F.col("x.pos").alias("place"), F.col("x.term").alias("term")).distinct()
        moved = self.postings.join(places, "term").select(*DOC, "item", "item_tag", "place", (F.col("pos") - F.col("place")).alias("start"))
        near = Window.partitionBy(*DOC, "item", "item_tag").orderBy("start").rangeBetween(-slop, 0)
        sets = moved.withColumn("places", F.collect_set("place").over(near)).where(F.size("places") > 1).select(*DOC, "item", "item_tag", "places").distinct()
        whole = self.windows.groupBy("item", "item_tag").agg(F.collect_set(F.transform("places", lambda x: x["pos"])).alias("windows"))
        met = sets.join(whole, ["item", "item_tag"]).where(F.exists("windows", lambda w: F.size(F.array_except(w, "places")) == 0))
        return met.select(*DOC, "item").distinct()


def _join_docs(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    named = right.select(*[F.col(c).alias(f"_{c}") if c in DOC else F.col(c) for c in right.columns])
    return left.join(named, left["doc_id"].eqNullSafe(named["_doc_id"]) & (left["tag"] == named["_tag"]), how).drop("_doc_id", "_tag")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, lists: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    with Scratch(docs.sparkSession) as own:
        index = PositionalIndex(docs, items, own, width, lists)
        hits = own.table(index.phrases(), "hits", gather=True)
        named = hits.groupBy(*DOC).agg(F.sort_array(F.collect_set("item")).alias("names"))
        places = hits.select(*DOC, "pos").distinct().groupBy(*DOC).agg(F.count(F.lit(1)).alias("hit"))
        met = own.table(_join_docs(named, places, "inner"), "met", gather=True)
        n = F.size(F.array_remove(_pieces(F.col("text")), "")).cast("long")
        rows = _join_docs(index.docs.select(*DOC, n.alias("n_words")), met, "left")
        zero = F.lit(0).cast("long")
        out = rows.select(
            "doc_id", "n_words", F.coalesce("hit", zero).alias("n_hit"), F.coalesce(F.size("names").cast("long"), zero).alias("n_items"),
            F.sha2(F.array_join(F.coalesce("names", F.array().cast("array<string>")), ","), 256).alias("items_sha256"), F.col("hit").isNotNull().alias("contaminated"),
        )
        return materialize(out, "contamination")
