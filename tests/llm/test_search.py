"""Lexical search, decontamination and source divergence against plain versions, on odd tables."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, divergence, lexical
from tessera.llm.common import Scratch

from . import brute

WORDS = "the of and alpha beta gamma delta épsilon zeta eta theta iota kappa lambda 42 mu nu xi omikron pi rho sigma".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(WORDS, [10, 8, 6, *[1] * (len(WORDS) - 3)], k=n))


@pytest.fixture(scope="module")
def odd():
    """(doc_id, text, lang, source) with nulls, repeats, ties, empty and very long texts."""
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randrange(1, 60)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "b", "b", None])) for i in range(150)]
    passage = sentence(rng, 25)
    rows += [(200 + i, f"{sentence(rng, 7)}! {passage.title()}; {sentence(rng, 5)}", "en", "a") for i in range(20)]
    rows += [(300, None, "de", "x"), (301, "", "de", "y"), (302, "... --", None, None), (None, passage, "en", "a"), (None, passage, "en", "a"), (303, passage, "en", "b"), (303, passage, "en", "b"), (303, "the", "en", "b")]
    rows += [(304, sentence(rng, 40_000) + " " + passage, "fr", "a"), (305, "\x00the\x1fthe", "it", "only"), (306, passage + " " + passage, "en", "c")]
    return rows, passage


SCHEMA = "doc_id long, text string, lang string, source string, term int, item_id int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(3)


def items_of(spark, rows):
    return spark.createDataFrame([(*r, 7, "y") for r in rows], "item_id long, text string, doc_id int, tag string")


def odd_items(passage: str) -> list[tuple]:
    rng = random.Random(6)
    words = passage.split()
    return [(1, passage), (2, " ".join(words[5:17])), (3, "the of"), (4, "Lambda"), (5, "never seen words here"), (6, None), (7, "?!"), (None, sentence(rng, 12)), (8, sentence(rng, 14)), (8, " ".join(words[:10])), (10, " ".join(words[:9]) + " never"), (9, passage + " " + passage)]


def test_lexical_search(spark, odd):
    rows, passage = odd
    items = odd_items(passage)
    got = lexical.search(frame(spark, rows), items_of(spark, items), k=7, first=1, items_in_block=3)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(brute.lexical([r[:2] for r in rows], items, 7), key=lambda r: r[:2])


def test_lexical_trees(spark, odd):
    """Roots are the largest impacts; with tiny shards the second wave must find what the first missed."""
    rows, passage = odd
    docs = frame(spark, rows)
    size, length = lexical.corpus_size(docs)
    index = lexical.build_index(docs, size, length, shard_bytes=2000).where("term IS NOT NULL")
    bad = index.where((F.col("best") != F.array_max("impact")) | (F.col("best") != F.array_max("bounds")) | (F.size("at") != F.col("size")))
    assert bad.count() == 0 and index.select("shard").distinct().count() > 5


def test_lexical_many_small_shards(spark, odd, monkeypatch):
    rows, passage = odd
    small = lexical.build_index
    monkeypatch.setattr(lexical, "build_index", lambda docs, size, length: small(docs, size, length, 1500))
    items = odd_items(passage)
    got = lexical.search(frame(spark, rows), items_of(spark, items), k=5, first=1)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(brute.lexical([r[:2] for r in rows], items, 5), key=lambda r: r[:2])


@pytest.mark.parametrize("lists", [1, 3])
def test_decontamination(spark, odd, lists):
    rows, passage = odd
    items = odd_items(passage)
    got = decontaminate.contamination(frame(spark, rows), items_of(spark, items), lists=lists)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted(brute.contaminated([r[:2] for r in rows], items), key=key)
    assert sorted(map(tuple, got.collect()), key=key) == want
    assert sum(r[5] for r in want) > 20


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten"
    far = "one two three four five six seven x x x x x x x x x x x x eight nine ten"
    docs = frame(spark, [(1, item, "", ""), (2, "two one x three four six five seven eight ten nine", "", ""), (3, far, "", ""), (4, "one two", "", "")])
    with Scratch(spark) as own:
        index = decontaminate.PositionalIndex(docs, items_of(spark, [(5, item)]), own, lists=10)
        assert sorted((r["doc_id"], r["item"]) for r in index.proximity(3).collect()) == [(1, "5"), (2, "5")]
        assert {r["doc_id"] for r in index.phrases().collect()} == {1}


def test_divergence(spark, odd):
    rows, _ = odd
    got = divergence.audit(frame(spark, rows), top=6, bucket_rows=20, tile=2)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(brute.divergence([(r[2], r[3], r[1]) for r in rows], top=6))


def test_empty_tables(spark, odd):
    rows, passage = odd
    none, items = frame(spark, rows).where("false"), items_of(spark, odd_items(passage))
    assert lexical.search(none, items).count() == 0
    assert lexical.search(frame(spark, rows[:5]), items.where("false")).count() == 0
    assert decontaminate.contamination(none, items).count() == 0
    assert [r["contaminated"] for r in decontaminate.contamination(frame(spark, rows[:5]), items.where("false")).collect()] == [False] * 5
    assert divergence.audit(none).count() == 0
    assert divergence.audit(frame(spark, [(1, None, None, None), (2, "a b", None, "x")])).where("value = 0").count() == 2
