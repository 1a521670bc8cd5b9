"""Nulls, empty and long texts, repeated rows, clashing columns, empty tables, periodic texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chunkstore, forest, hostrules, langid, mixing, oddsketch, packing, queries, suffixes, toxicity, warc
from tessera.llm.packing import patterns, places
from tessera.llm.tokens import Encoder

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, class string, rank int, digest string, size int"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [
    (1, None, "en", "a", None), (2, "", "en", None, 0), (3, "one two three four five six", None, "a", 5), (3, "one two three four five six", None, "a", 5),
    (None, "one two three four five six", "de", "b", 5), (5, LONG, "en", "b", 9), (6, LONG, "en", "b", 9), (7, "12 34 !!", "fr", None, 1), (8, "x", "fr", "é", 1), (4, "ab " * 300, "en", "a", 1), (9, "ab " * 200, "en", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0.5, "k", 1, "d", 3) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_languages(spark, odd, empty):
    rows = langid.predict(odd, langid.fit(odd)).collect()
    assert len(rows) == len(ROWS) and all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 7))
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(empty)).collect()} == {"und"}
    assert langid.predict(empty, langid.fit(empty)).count() == 0


def test_packing(spark, odd, empty):
    tok = queries.tokenizer("word_bpe_49k.json")
    rows = packing.pack(odd, tok, with_ids=True).collect()
    assert len({r["doc_id"] for r in rows}) == 10 and sum(r["length"] for r in rows if r["doc_id"] == 1) == 1
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    spots = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    for a, b in zip(spots, spots[1:]):
        assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0)
    assert packing.pack(empty, tok).count() == 0


def test_patterns_place_every_length():
    draw = random.Random(3)
    for limit in (8, 64, 512):
        histogram = {x: draw.randint(1, 50) for x in draw.sample(range(1, limit + 1), min(limit, 40))}
        packs = patterns(histogram, limit)
        placed: dict[int, int] = {}
        for count, pack in packs:
            assert sum(x * k for x, k in pack) <= limit
            for x, k in pack:
                placed[x] = placed.get(x, 0) + count * k
        assert placed == histogram and len(places(packs))


def test_host_rules(spark, odd, empty):
    rows = hostrules.judge(odd).collect()
    for r in rows:
        text = next(t for d, t, *_ in ROWS if d == r["doc_id"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.host_measures(text)
    assert len(rows) == len(ROWS) and hostrules.judge(empty).count() == 0


def test_host_measures_at_random(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choice(["a ", "b ", "c\t", "a\n", "b b\n\n", "#", "é "]) for _ in range(draw.randint(0, 120))) for _ in range(150)]
    rows = hostrules.measure(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.host_measures(texts[r["doc_id"]])


def test_a_bad_host_goes(spark):
    good = [(i, " ".join(f"w{i}_{k}" for k in range(30)), "good") for i in range(60)]
    bad = [(100 + i, "too few", "bad") for i in range(60)] + [(200, " ".join(f"v{k}" for k in range(30)), "bad")]
    kept = {r["doc_id"]: r["kept"] for r in hostrules.judge(spark.createDataFrame(good + bad, "doc_id long, text string, source string")).collect()}
    assert all(kept[i] for i in range(60)) and not kept[200]


def test_warc(spark, tmp_path):
    body = "<p>" + "x" * 200
    rows = [(1, "http://a/%0A\nb", None, 0), (5, None, body, 0), (4, "u", body, 0), (4, "u", body, 0), (6, "u", "é" * 49, 0), (7, "u", "é" * 49, 0), (8, "u", "é" * 50, 0), (9, "u", "é" * 50, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, first int")
    path = f"file://{tmp_path}/w"
    index = warc.write_archive(pages, path, frame_bytes=300, bundle_bytes=600)
    got = {r["page_id"]: r for r in warc.read_archive(spark, path, True).collect()}
    assert (got[5]["record_type"], got[5]["refers_to"], got[4]["record_type"], got[6]["record_type"], got[7]["record_type"], got[9]["refers_to"]) == ("revisit", 4, "response", "response", "response", 8)
    assert got[1]["url"] == "http://a/%0A\nb" and got[1]["payload_bytes"] == 0 and got[5]["payload_bytes"] == 203
    assert index.count() == len(rows)
    some = warc.read_records(spark, path, index, spark.createDataFrame([(8,), (5,)], "page_id long")).collect()
    assert {r["page_id"]: r["payload"] for r in some} == {8: ("é" * 50).encode(), 5: b""}
    assert warc.archive_and_read(pages.where("false")).count() == 0


def test_forest(spark):
    v = np.random.default_rng(1).standard_normal((300, 8)).tolist()
    rows = [(i, x, 0) for i, x in enumerate(v)] + [(1000 + i, v[0], 0) for i in range(60)] + [(2000, None, 0), (2020, [0.0] * 8, 0), (2040, [float("nan")] * 8, 0), (2060, [1.0, None] * 4, 0), (2080, [1.0], 0), (None, v[1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got: dict = {}
    for r in forest.search(table, shard_rows=100).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = [r[0] for r in rows if r[0] is not None and r[0] < 2000]
    x = np.array([r[1] for r in rows if r[0] is not None and r[0] < 2000])
    assert set(got) == {i for i in ids if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        s = x @ x[ids.index(q)]
        want = [ids[k] for k in np.lexsort((ids, -np.round(s, 12))) if ids[k] != q][:20]
        assert len(found) == 20
        hit += len(set(want) & {f[1] for f in found})
    assert hit / (20 * len(got)) > 0.9
    same = [f[1] for f in sorted(got[0]) if f[1] >= 1000]  # equal vectors: smaller ids first
    assert same and same == list(range(1000, 1000 + len(same)))
    assert forest.search(table.where("false")).count() == 0
    assert forest.search(table.where("vec_id in (0, 1, 2)")).count() == 2


def test_mixing(spark, odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ROWS) and all(r["taken"] <= 2 * r["size"] for r in rows) and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mix(empty).count() == 0
    assert mixing.targets([("a", 100), ("b", 100), (None, 10)]) == {"a": 200.0, "b": 95.0, None: 20.0}
    quotas = np.array([17, 0, 40])
    parts = mixing.split(quotas, 5, 3)
    assert parts.sum(0).tolist() == quotas.tolist() and max(parts.sum(1)) - min(parts.sum(1)) <= 1
    assert (parts == mixing.split(quotas, 5, 3)).all()


def test_mixing_with_few_large_blocks(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 5}") for i in range(3000)], "doc_id long, text string, source string")
    by: dict = {}
    for r in mixing.mix(docs, block_docs=4, most_blocks=20).collect():
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        assert 0 <= own[0]["target"] - sum(r["taken"] for r in own) < 7
    quotas = np.array([10**7, 3 * 10**7, 5], np.int64)
    parts = mixing.split(quotas, 7, 1)
    assert parts.sum(0).tolist() == quotas.tolist() and max(parts.sum(1)) - min(parts.sum(1)) <= 1


def test_token_store(spark, odd, empty):
    tok = queries.tokenizer("byte_bpe_50k.json")
    rows = sorted(chunkstore.store_and_verify(odd, tok).collect(), key=lambda r: r["start"])
    assert len(rows) == len(ROWS) and rows[0]["doc_id"] is None
    for a, b in zip(rows, rows[1:]):
        assert b["start"] == a["start"] + a["n_tokens"]
    assert chunkstore.store_and_verify(empty, tok).count() == 0


def test_crc_of_a_concatenation():
    import zlib

    draw = random.Random(1)
    for _ in range(50):
        a, b = draw.randbytes(draw.randint(0, 90)), draw.randbytes(draw.randint(0, 5000))
        got = chunkstore.crc32_concat(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
        assert got[0] == zlib.crc32(a + b)


def test_mixing_goes_on_after_a_document_that_does_not_fit(spark):
    docs = spark.createDataFrame([(i, "w " * (3000 if i % 10 == 0 else 3 + i % 5), s) for s in ("a", "b", "c") for i in range(60)], "doc_id long, text string, source string")
    for seed in range(4):
        rows = mixing.mix(docs, seed=seed).collect()
        for s in ("b", "c"):
            own = [r for r in rows if r["source"] == s]
            short = own[0]["target"] - sum(r["taken"] for r in own)
            left = [r["size"] for r in own if r["taken"] == r["size"] * (own[0]["target"] >= own[0]["source_size"])]
            assert short >= 0 and all(x > short for x in left), (seed, s)


def test_encoder_equals_the_library():
    draw = random.Random(2)
    parts = ["word", " ", "  ", "\n", "\t", "É", "ß", "it's", "'S", "12", "a1", ",", "...", "日本", "é", " ", "　", "<|endoftext|>", "x,y", "ª", "µ", "İ", "\x01", "\r\n", "ÿ.", "×.", "÷,", ".", " 's", "\n\n"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(600)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        for bits, step in ((4, 40), (4, 600), (21, 600)):  # a table that is too small for a slice, and one that isn't
            enc = Encoder(queries.tokenizer(name), most_bits=bits)
            got = []
            for lo in range(0, len(texts), step):
                for _, rows, ids, at in enc.encode_column(pa.array(texts[lo : lo + step]), 2, 300):
                    got += [ids[at[k] : at[k + 1]].tolist() for k in range(rows)]
            assert got == [[*e.ids, 2] for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_toxicity(spark, odd, empty):
    labels = spark.createDataFrame([(3, 0, 1), (3, 0, 0), (8, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for docs, lab in ((odd, labels), (odd, labels.where("false"))):
        rows = toxicity.score(docs, lab, F.lit(True)).collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(empty, labels, F.lit(True)).count() == 0


def test_block_max_search_is_exact():
    draw = np.random.default_rng(4)
    rows = []
    for _ in range(700):
        f = np.sort(draw.choice(60, draw.integers(1, 9), replace=False))
        w = draw.random(len(f)) + 0.1
        rows.append((f, w / np.sqrt((w * w).sum())))
    index = toxicity.Index(rows, 60)
    dense = np.zeros((700, 60))
    for k, (f, w) in enumerate(rows):
        dense[k, f] = w
    for _ in range(40):
        f = np.sort(draw.choice(60, 5, replace=False))
        w = draw.random(5)
        s = dense[:, f] @ w
        want = [k for k in np.lexsort((np.arange(700), -s)) if s[k] > 0][:15]
        at, got = index.nearest(f, w, 15)
        assert np.allclose(got, s[want]) and len(at) == len(want)


def test_toxicity_ties_and_copies(spark):
    rows = [(i, "good day to you all" if i % 2 else "you awful fool") for i in range(40)] + [(100, "awful fool"), (101, "good day"), (102, ""), (103, "unknown")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels, F.lit(True)).collect()}
    assert got[100]["predicted"] == 1 and got[101]["predicted"] == 0 and got[100]["evidence"][0] == 0
    assert got[102]["score"] == got[103]["score"] == 0.5


def test_near_duplicates(spark, odd, empty):
    rows = oddsketch.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert by[6]["component_id"] == 5 and not by[6]["kept"] and by[None]["component_id"] == 3 and not by[None]["kept"] and by[1]["kept"] and by[1]["n_shingles"] == 0
    assert oddsketch.near_duplicates(empty).count() == 0


def test_chains_of_near_duplicates(spark):
    draw = random.Random(7)
    rows, n = [], 0
    for _ in range(12):
        words = [f"t{draw.randint(0, 10**6)}" for _ in range(60)]
        for _ in range(draw.randint(1, 25)):
            words = list(words)
            for _ in range(draw.randint(0, 2)):
                words[draw.randrange(60)] = f"t{draw.randint(0, 10**6)}"
            rows.append((n, " ".join(words)))
            n += 1
    draw.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (3, 1000):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in oddsketch.near_duplicates(table, block=block).collect()}
        assert got == brute.near(rows)


def test_repeats(spark, odd, empty):
    rows = suffixes.remove_repeats(odd, with_text=True).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert by[6]["n_removed"] == by[6]["n_bytes"] and by[9]["n_removed"] == by[9]["n_bytes"] and by[4]["n_removed"] == 0 and by[1]["n_bytes"] == 0
    assert suffixes.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("letters,depth,core", [("ab", 8, 4), ("abcdefgh", 30, 5), ("aé ", 9, 9)])
def test_repeats_at_random(spark, letters, depth, core):
    draw = random.Random(depth)
    rows = []
    for d in range(40):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 80)))
        if rows and draw.random() < 0.6:
            other = draw.choice(rows)[1]
            at = draw.randint(0, max(len(other) - 1, 0))
            text = text[:20] + other[at : at + draw.randint(0, 60)] + text[20:]
        rows.append((d, text))
    draw.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for more in ({}, {"hot": 1, "hold": 30}):  # nearly every core counts as hot
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(table, depth, core, **more).collect()}
        assert got == brute.repeats(rows, depth)


def test_rows_without_ids_are_compared(spark):
    words = [f"k{i}" for i in range(60)]
    rows = [(None, " ".join(words)), (None, " ".join([*words[:59], "z"])), (None, " ".join(words)), (None, "quite another text of some words here"), (4, " ".join(["y", *words[::-1]])), (None, " ".join(words[::-1]))]
    got = oddsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["component_id"] is None for r in got) == [False, False, True, True, True, True]
    assert len({r["key"] for r in got if r["kept"]}) == 3


def test_every_number_is_an_id(spark):
    """2**62 and above, negative ids, and rows without one that are like them."""
    words = [f"w{i}" for i in range(40)]
    near = lambda k: " ".join(words[:k] + [f"x{k}"] + words[k + 1 :])
    other = " ".join(f"v{i}" for i in range(30))
    rows = [(1 << 62, near(20)), ((1 << 62) + 5, near(39)), ((1 << 63) - 1, near(0)), (-(1 << 63), other), (-7, other), (0, "alone here"), ((1 << 62) + 9, "one more")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in oddsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near(rows)
    got = oddsketch.near_duplicates(spark.createDataFrame([*rows, (None, other), (None, "nobody's text"), (None, "nobody's text")], "doc_id long, text string")).collect()
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None and r["n_shingles"] > 1] == [(-(1 << 63), False)]
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None and r["n_shingles"] == 1] == [(None, True)] * 2


def test_letters_that_lose_a_byte_go_whole(spark):
    same = "é" * 30
    rows = [(1, "a" + same + "b\ufffdc"), (2, "\u00a9" + same[1:] + "\ufffd" + "x")]
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert got[1]["kept_text"] == rows[0][1] and got[2]["kept_text"] == "\ufffdx"


@pytest.mark.parametrize("stage", ["language_id", "near_dedup", "suffix_dedup", "mixing", "packing"])
def test_pipeline_stages_on_odd_tables(spark, odd, empty, stage):
    import corpus_pipeline

    function = dict(corpus_pipeline.STAGES)[stage]
    more = ["own", "tag", "kept", "gone", "row", "key", "times", "copy", "_times", "_text", "lang_pred", "coverage"]
    docs = odd.withColumns({c: F.lit(f"<{c}>") for c in more})
    got = function(spark, docs, "")
    rows = got.collect()
    none = function(spark, docs.where("false"), "")
    assert none.count() == 0
    if stage == "packing":
        assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 1
        return
    assert got.columns == docs.columns == none.columns and got.dtypes == docs.dtypes
    assert all(r[c] == f"<{c}>" for r in rows for c in more) and all(r["score"] == 0.5 for r in rows)
    ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows)
    texts = {r["doc_id"]: r["text"] for r in rows}
    if stage == "language_id":
        assert not {1, 2, 7} & set(ids) and ids.count(3) in (0, 2)
    elif stage == "near_dedup":
        assert ids == [1, 2, 3, 4, 5, 7, 8]  # 4 and 9 have the same shingles
    elif stage == "suffix_dedup":
        assert ids == [-1, 1, 2, 3, 3, 4, 5, 7, 8] and texts[1] is None and texts[5] == LONG
    else:
        assert not {1, 2} & set(ids) and max(ids.count(x) for x in ids) <= 4


def test_near_duplicate_blocks(spark):
    """Copies of copies, compared in small blocks, give what brute force gives."""
    rng = random.Random(5)
    rows = []
    for g in range(3):
        words = [f"g{g}w{i}" for i in range(60)]
        for k in range(25):
            words = [w if rng.random() > 0.03 else f"n{g}.{k}.{i}" for i, w in enumerate(words)]
            rows.append((len(rows) + 1, " ".join(words)))
    got = oddsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()} == brute.near(rows)


def test_runs_hold_every_row_once():
    size = np.array([5, 1, 9, 2, 2, 2])
    runs = oddsketch._runs(np.arange(6), size, 4)
    assert np.concatenate(runs).tolist() == list(range(6))
    assert all(len(r) == 1 or size[r].sum() <= 4 for r in runs)
    assert oddsketch._runs(np.arange(0), size, 4) == []
