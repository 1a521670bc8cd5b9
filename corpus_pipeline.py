"""From raw documents to packed sequences: five stages, each a written table.

language ID -> near duplicates -> repeated passages -> mix by source -> packing"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, mixing, oddsketch, packing, suffixes
from tessera.llm.common import new_path, passing, remove, small_batches
from tessera.llm.queries import table, tokenizer

#: Least part of a text's n-grams that its language's filter must hold.
MIN_COVERAGE = 0.2


def free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name += "_"
    return name


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, with lang set to it; those without letters or of no
    learned language go. Learns from the labelled rows of what it gets.

    A null or empty text has no letter and goes; a null id or source stays; repeated rows are
    judged alike; a tie goes to the first language in order; extra columns stay as they are,
    whatever their names; an empty table stays empty."""
    small_batches(spark)
    row = free(docs, "row")
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias(row), "text")
    found = langid.predict(rows, langid.fit(docs)).where((F.col("lang_pred") != "und") & (F.col("coverage") >= MIN_COVERAGE))
    return found.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col("text") if c == "text" else F.col(row)[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Texts without words are no duplicates; a row without an id stays if no document with one is
    like it, one for each group; of rows equal in id and text the first by their other
    columns stays; extra columns stay; an empty table stays empty."""
    small_batches(spark)
    mark = free(docs, "key")
    kept = oddsketch.near_duplicates(docs).where("kept").select(F.col("key").alias(mark)).distinct()
    rows = docs.withColumn(mark, oddsketch.key()).join(kept, mark, "left_semi")
    rest = F.struct(*[c for c in docs.columns if c != "text"])
    row = free(docs, "row")
    one = rows.groupBy(mark, "text").agg(F.min_by(rest, F.to_json(rest)).alias(row))
    return one.select(*[F.col("text") if c == "text" else F.col(row)[c].alias(c) for c in docs.columns])


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 bytes that a smaller doc_id has too. At the edges of what
    goes, a letter that loses a byte goes whole; a document that loses nothing stays as it is,
    and one of which nothing is left goes.

    Null and empty texts lose nothing and stay; a null id counts as the smallest; rows with one
    id don't take from each other; n_chars is counted anew where there is one; extra columns
    stay; an empty table stays empty."""
    small_batches(spark)
    own, tag, kept, gone = (free(docs, c) for c in ("own", "tag", "kept", "gone"))
    cut = suffixes.remove_repeats(docs, with_text=True).where("n_removed > 0")
    cut = cut.select(F.col("doc_id").alias(own), F.col("tag").alias(tag), F.col("kept_text").alias(kept), F.lit(True).alias(gone)).dropDuplicates([own, tag])
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(tag))
    rows = docs.join(cut, same, "left").where(F.col(gone).isNull() | (F.col(kept) != ""))
    text = F.when(F.col(gone), F.col(kept)).otherwise(F.col("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(gone), F.length(F.col(kept)).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken.

    Documents without words are never taken; rows that share an id count as one each and
    are taken by themselves if their sizes differ, else alike; a null source is the last
    source; extra columns stay; an empty table stays empty."""
    small_batches(spark)
    own, size, times, copy = (free(docs, c) for c in ("own", "size", "times", "copy"))
    found = mixing.mix(docs).where("taken > 0")
    taken = found.select(F.col("doc_id").alias(own), F.col("size").alias(size), (F.col("taken") / F.col("size")).cast("int").alias(times)).groupBy(own, size).agg(F.max(times).alias(times))
    rows = docs.join(taken, docs["doc_id"].cast("long").eqNullSafe(F.col(own)) & (mixing.words() == F.col(size)))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids with their sequences and offsets.

    A null text is empty and packs its end id; repeated rows and null ids are packed like any
    other row; extra columns are ignored; an empty table gives no pieces."""
    small_batches(spark)
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language_id", identify), ("near_dedup", near_dedup), ("suffix_dedup", remove_passages), ("mixing", mix), ("packing", pack)]

#: A tokenizer and trained filters are not expressed in SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. When a stage is written, what its operator kept and the output
    of the stage before are deleted, so that no more than two stages stand at once."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with passing(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
