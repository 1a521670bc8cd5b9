"""The watch's state: roots against whole trees, what a batch writes, repeated batches."""

import random

import pytest

from tessera.operators import snapshot as S
from tessera.streaming import watch as W

VERSIONS = "path string, body string, version long"


def whole(spark, files):
    return W.root_of(spark.createDataFrame(list(files.items()), "path string, body string"))


def size_of(folder):
    return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())


def test_roots_equal_whole_trees(spark, tmp_path):
    """Random edits, deletions, late versions; files that become directories and back; the end is empty."""
    draw, files, known, root = random.Random(3), {}, {}, None
    places = ["a", "a/b", "a/b/c", "d/e", "d/e/f/g", "h", "d/i"]
    for number in range(5):
        if number == 4:
            rows = [(p, None, 99) for p in files]
        else:
            rows = []
            for path in draw.sample(places, 4):
                if draw.random() < 0.3:
                    rows.append((path, None, number))
                    continue
                clash = [p for p in places if p.startswith(path + "/") or path.startswith(p + "/")]
                rows = [r for r in rows if r[0] not in clash] + [(p, None, number) for p in clash] + [(path, str(draw.random()), number)]
            rows.append((draw.choice(places), "late", number - 3))
            rows.append((None, "x", 1))
        for path, body, version in rows:
            rank = (version, S.hashlib.sha256(body.encode()).hexdigest() if body is not None else "")
            if path and rank > known.get(path, (-99, "")):
                known[path] = rank
                files.pop(path, None)
                if body is not None:
                    files[path] = body
        before, after, names = W.step(spark, spark.createDataFrame(rows, VERSIONS), number, str(tmp_path))
        assert before == root and after == whole(spark, files)
        root = after
        kept = W.newest(W._read(spark, f"{tmp_path}/files", names, W.FILE)).where("body IS NOT NULL")
        assert {r.path: r.body for r in kept.collect()} == files
    assert root == S.NOTHING
    tree = {r.path: r.hash for r in W.directories(spark, str(tmp_path)).collect()}
    assert tree == {".": S.NOTHING}


def test_a_small_change_writes_little(spark, tmp_path):
    draw = random.Random(1)
    files = [(f"d{i % 50}/e{i % 7}/f{i}", "".join(draw.choices("abcdefgh", k=400)), 0) for i in range(3000)]
    _, _, first = W.step(spark, spark.createDataFrame(files, VERSIONS), 0, str(tmp_path))
    large = size_of(tmp_path / "files" / first[0])
    root, names = None, None
    for number in range(1, 3):
        _, root, names = W.step(spark, spark.createDataFrame([(f"d1/e1/f{number}", "new", 1)], VERSIONS), number, str(tmp_path))
        assert names[0] == first[0]  # the large segment stays as it is
        assert size_of(tmp_path / "files" / names[-1]) + size_of(tmp_path / "entries" / names[-1]) < large / 20
    now = {p: b for p, b, _ in files} | {f"d1/e1/f{n}": "new" for n in range(1, 3)}
    assert root == whole(spark, now)
    _, same, still = W.step(spark, spark.createDataFrame([], VERSIONS), 3, str(tmp_path))
    assert same == root and still == names
    assert W.to_merge([("a", 9), ("b", 3), ("c", 1)]) == 1 and W.to_merge([("a", 100), ("b", 4), ("c", 2)]) == 2 and W.to_merge([("a", 8), ("b", 4), ("c", 2)]) == 3


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """A batch that failed after its tables were written, in part or in whole, is taken again."""
    W.step(spark, spark.createDataFrame([("a/x", "1", 0), ("b", "2", 0)], VERSIONS), 0, str(tmp_path))
    again = spark.createDataFrame([("a/x", "3", 1), ("c/d", "4", 1)], VERSIONS)
    once = W.step(spark, again, 1, str(tmp_path))
    assert W.step(spark, again, 1, str(tmp_path)) == once
    assert once[1] == whole(spark, {"a/x": "3", "b": "2", "c/d": "4"})


def test_errors_end_the_watch_unless_logged(spark, tmp_path):
    lines = []
    spark.createDataFrame([("a", "1", 1)], VERSIONS).write.json(str(tmp_path / "in"))

    def fails(files, root):
        raise ValueError("no")

    def run(emit):
        versions = spark.readStream.schema(VERSIONS).json(str(tmp_path / "in"))
        W.watch(spark, versions, str(tmp_path / "state"), str(tmp_path / "ck"), emit, None, initial=True).awaitTermination()

    with pytest.raises(Exception, match="no"):
        run(fails)
    run(W.logged(fails, lines.append))  # the batch is repeated
    assert len(lines) == 1 and "no" in lines[0]


def test_texts_that_stay_the_newest_are_not_written_again(spark, tmp_path):
    """A second batch that replaces all of the first takes its place as it is, and versions in it that lost do no harm."""
    W.step(spark, spark.createDataFrame([("a/x", "1", 0), ("b", "2", 0)], VERSIONS), 0, str(tmp_path))
    _, root, names = W.step(spark, spark.createDataFrame([("a/x", "3", 1), ("b", None, 1), ("c", "4", 1)], VERSIONS), 1, str(tmp_path))
    assert names == ["batch=1"] and {f.name for f in (tmp_path / "files").iterdir()} == {"batch=0", "batch=1"}
    assert root == whole(spark, {"a/x": "3", "c": "4"})
    _, root, names = W.step(spark, spark.createDataFrame([("c", "5", 2), ("c", "6", 0), ("a/x", "7", 0), ("d", "8", 2), ("d", "8", 2)], VERSIONS), 2, str(tmp_path))
    assert root == whole(spark, {"a/x": "3", "c": "5", "d": "8"})
    kept = W.newest(W._read(spark, f"{tmp_path}/files", names, W.FILE)).where("body IS NOT NULL")
    assert {r.path: r.body for r in kept.collect()} == {"a/x": "3", "c": "5", "d": "8"}
