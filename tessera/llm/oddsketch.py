"""MinHash near-duplicates with odd sketches (operator 9).

1. Every document gets its set of shingles (64-bit hashes), MinHash samples, and an
   odd sketch: each sample (k, value) flips one bit of a fixed bitmap. The bitmaps of
   two documents differ by an odd number of samples at each set bit of their XOR,
   so its population count estimates how many samples differ, and precisely so
   where the similarity is high.
2. Documents with equal sets are one class, so copies cost one row each.
3. Classes that share a band of samples meet in a bucket. Each bucket has a centre, and
   its members are compared with it: first the sketches, then the full sets.
4. Links give components. Buckets that still hold more than one component are finished
   exactly: blocks of their members are compared with each other, all pairs of
   different components in turn and without writing pairs out; a block gives at most
   a spanning forest of new links.

A pair is passed over by its sketches only if it lies further below the threshold than
chance allows (``sigmas`` standard deviations of the samples). With 32 bands of 4 a link
at 0.75 is in no common bucket with probability 5e-6.

Defined results: null text, and text without words, has an empty set and is linked with
nothing; repeated rows are copies, and rows that share a doc_id one document; a row with a
null doc_id is compared like any other, comes after all rows with an id, and goes by a number
that follows from its text: the component of such rows alone has no id, and of its texts the
one with the smallest number is kept. Any 64-bit value is an id; extra columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE_A, BASE_B, Scratch, fingerprints, materialize, mix, prefix_sums, release, slices, trim, utf8_column
from .components import components

SAMPLES, ROWS, BITS = 128, 4, 1024
BANDS = SAMPLES // ROWS
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    data = _LOWER[data]
    space = _SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = space[:-1] if len(data) else edge[1:-1]
    edge[offsets] = True
    word = ~space
    start = np.flatnonzero(word & edge[:-1])
    stop = np.ones(len(data), bool)
    stop[:-1] = space[1:]
    stop[offsets[1:][offsets[1:] > 0] - 1] = True
    end = np.flatnonzero(word & stop) + 1
    words = fingerprints(prefix_sums(data, BASE_A), BASE_A, start, end) if len(start) else np.zeros(0, np.uint64)
    first = np.searchsorted(start, offsets)
    count = np.diff(first)
    powers = [np.uint64(pow(BASE_B, k + 1, 1 << 64)) for k in range(width)]
    out = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        out += words[k : k + len(out)] * powers[k]
    mix(out)
    sets = []
    for d in range(len(count)):
        n, at = int(count[d]), int(first[d])
        if n >= width:
            sets.append(np.unique(out[at : at + n - width + 1]))
        elif n:
            few = np.zeros(1, np.uint64)
            for k in range(n):
                few += words[at + k : at + k + 1] * powers[k]
            sets.append(mix(few + np.uint64(n)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


_MULT, _ADD = (np.random.default_rng(s).integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for s in (11, 12))


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """Sets x SAMPLES: the upper halves of the least values of each hash function (sets must not be empty)."""
    out = np.zeros((len(sets), SAMPLES), np.uint32)
    lo = 0
    while lo < len(sets):
        hi, size = lo, 0
        while hi < len(sets) and (hi == lo or size + len(sets[hi]) <= 16384):
            size += len(sets[hi])
            hi += 1
        x = np.concatenate(sets[lo:hi])
        at = np.cumsum([0, *map(len, sets[lo : hi - 1])])
        y = np.empty_like(x)
        for k in range(SAMPLES):
            np.multiply(x, _MULT[k], out=y)
            np.add(y, _ADD[k], out=y)
            out[lo:hi, k] = np.minimum.reduceat(y, at) >> np.uint64(32)
        lo = hi
    return out


def sketches(sample: np.ndarray) -> np.ndarray:
    """Sets x BITS / 64: the parity bitmaps."""
    place = mix(sample.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    odd = np.bincount((np.arange(len(sample))[:, None] * BITS + place.astype(np.int64)).ravel(), minlength=len(sample) * BITS).reshape(len(sample), BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


def sketch_limit(percent: int, sigmas: float = 6.0) -> int:
    """The largest XOR count that a linked pair may show: so many samples may differ
    at the threshold, each difference flips two bits, and what falls on one another is lost."""
    j = percent / 100
    differ = SAMPLES * (1 - j) + sigmas * (SAMPLES * j * (1 - j)) ** 0.5
    return min(BITS, int(np.ceil(2 * differ)))


KEY = "struct<none:boolean,id:bigint>"


def key(doc_id: str = "doc_id", text: str = "text"):
    """What stands for a row: whether it has no id, and its id or a number from its text."""
    own = F.col(doc_id).cast("long")
    return F.struct(own.isNull().alias("none"), F.coalesce(own, F.xxhash64(F.coalesce(F.col(text), F.lit("")))).alias("id"))


def _measure(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8_column(batch.column("text"))
            for i, j in slices(offs, 1 << 20):
                sets = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
                full = [k for k, s in enumerate(sets) if len(s)]
                sample = samples([sets[k] for k in full]) if full else np.zeros((0, SAMPLES), np.uint32)
                sketch = sketches(sample) if full else np.zeros((0, BITS // 64), np.uint64)
                digest, sig, odd = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                for n, k in enumerate(full):
                    digest[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
                    sig[k], odd[k] = sample[n].tobytes(), sketch[n].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("key").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(c, pa.binary()) for c in (digest, sig, odd))],
                    names=["doc_id", "key", "n_shingles", "digest", "sample", "sketch"],
                )
        trim()

    rows = docs.select(F.col("doc_id").cast("long"), key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, key {KEY}, n_shingles long, digest binary, sample binary, sketch binary")


def _bands(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sample").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.zeros(sig.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for k in range(ROWS):
                key = mix(key * np.uint64(BASE_A) + sig[:, :, k])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column("class").to_numpy(), BANDS))], names=["bucket", "class"])

    return classes.select("class", "sample").mapInArrow(run, "bucket long, class long")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes, those whose full sets are similar enough."""

    def side(name: str, what: list[str], table: DataFrame) -> DataFrame:
        return table.select(F.col("class").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in what])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = sketch_limit(percent)
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(f"sketch_{c}").to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in "ab")
            good = np.bitwise_count(x ^ y).sum(1) <= limit
            n, m = (batch.column(f"n_shingles_{c}").to_numpy() for c in "ab")
            good &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    what = ["n_shingles", "sketch"]
    close = pairs.join(side("a", what, classes), "a").join(side("b", what, classes), "b").mapInArrow(near, "a long, b long")
    return close.join(side("a", ["set"], sets), "a").join(side("b", ["set"], sets), "b").select("a", "b", "set_a", "set_b").mapInArrow(exact, "a long, b long")


#: Up to so many classes (17 bytes each) go to all executors instead of the texts to the classes.
MOST_SENT = 1 << 20


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """class, set: the shingles of the documents that stand for the wanted classes (class, head;
    of all rows with that key: they are one document). Texts are shuffled only where the
    classes, counted first, are too many to be sent."""
    if wanted.count() <= MOST_SENT:
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8_column(batch.column("text"))
            for i, j in slices(offs, 1 << 20):
                sets = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
                yield pa.RecordBatch.from_arrays([batch.column("class").slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "set"])

    rows = docs.where("text IS NOT NULL").select(key().alias("head"), "text")
    return rows.join(wanted, "head").select("class", "text").mapInArrow(run, "class long, set binary")


def _runs(rows: np.ndarray, size: np.ndarray, limit: int) -> list[np.ndarray]:
    """``rows`` in runs that hold at most ``limit`` shingles, or one row."""
    out, lo, total = [], 0, 0
    for k, r in enumerate(rows):
        if k > lo and total + size[r] > limit:
            out.append(rows[lo:k])
            lo, total = k, 0
        total += size[r]
    return [*out, rows[lo:]] if len(rows) else out


def _rest(members: DataFrame, known: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between the components that still meet in a bucket, compared in blocks."""
    own = members.join(known, members["class"] == known["node"], "left").select("bucket", "class", F.coalesce("component", "class").alias("component"))
    mixed = own.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("size")).where("x <> y AND size > 2")
    rows = own.join(mixed.select("bucket", "size"), "bucket").withColumn("parts", F.ceil(F.col("size") / block).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = rows.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "class", "component")
    full = tiles.join(classes.select("class", "n_shingles", "sketch"), "class").join(sets, "class")

    def compare(table: pa.Table) -> pa.Table:
        limit = sketch_limit(percent)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        table = table.combine_chunks()
        part, name = table.column("part").to_numpy(), table.column("class").to_numpy()
        comp, n = table.column("component").to_numpy().copy(), table.column("n_shingles").to_numpy()
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        hold = [np.frombuffer(s, np.uint64) for s in table.column("set").to_pylist()]
        long = np.array([len(s) for s in hold], np.int64)
        runs = {c: _runs(np.flatnonzero(part == c), long, 1 << 20) for c in {i, j}}
        a, b = [], []
        for p, left in enumerate(runs[i]):
            for right in runs[j][p if i == j else 0 :]:
                # every shingle of the two runs gets a number; those of x are marked and counted in the others
                names = np.unique(np.concatenate([hold[x] for x in (*left, *right)]))
                number = {int(y): np.searchsorted(names, hold[y]) for y in (*left, *right)}
                mark = np.zeros(len(names), bool)
                for x in left.tolist():
                    after = right[comp[right] != comp[x]]
                    if i == j:
                        after = after[after > x]
                    after = after[100 * np.minimum(n[after], n[x]) >= percent * np.maximum(n[after], n[x])]
                    after = after[np.bitwise_count(sketch[after] ^ sketch[x]).sum(1) <= limit]
                    if not len(after):
                        continue
                    mark[number[x]] = True
                    held = np.concatenate([[0], np.cumsum(mark[np.concatenate([number[y] for y in after.tolist()])])])
                    mark[number[x]] = False
                    ends = np.cumsum(long[after])
                    both = held[ends] - held[ends - long[after]]
                    for y in after[100 * both >= percent * (long[x] + long[after] - both)].tolist():
                        if comp[y] != comp[x]:
                            a.append(int(name[x]))
                            b.append(int(name[y]))
                            comp[comp == comp[y]] = comp[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return full.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, block: int = 1000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id (the smallest doc_id with the same set),
    and ``key``, which tells rows without an id apart."""
    with Scratch(docs.sparkSession) as own:
        measured = own.table(_measure(docs, width), "sketches")
        some = measured.where("digest IS NOT NULL")
        # a class goes by a number of its own from here on, as every number may be an id
        heads = own.table(some.groupBy("digest").agg(F.min("key").alias("head")), "heads", gather=True)
        numbers = own.table(heads.select("head").distinct().withColumn("class", F.monotonically_increasing_id()), "numbers", gather=True)
        firsts = some.groupBy("digest").agg(F.first("n_shingles").alias("n_shingles"), F.first("sample").alias("sample"), F.first("sketch").alias("sketch"))
        classes = own.table(firsts.join(heads.join(numbers, "head"), "digest"), "classes", gather=True)
        # where ids repeat a class may have several sets; it is linked if one of them is
        bands = _bands(classes)
        centre = F.min(F.struct(F.xxhash64(F.col("class"), F.pmod("bucket", F.lit(2))).alias("h"), F.col("class"))).alias("centre")
        shared = bands.groupBy("bucket").agg(centre, F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", F.col("centre.class").alias("centre"))
        members = own.table(bands.join(shared, "bucket"), "buckets", gather=True)
        pairs = members.where("class <> centre").select(F.least("class", "centre").alias("a"), F.greatest("class", "centre").alias("b")).distinct()
        wanted = own.table(numbers.join(members.select("class").distinct(), "class", "left_semi"), "wanted", gather=True)
        sets = own.table(_sets(docs, wanted, width), "sets", gather=True)
        release(docs.sparkSession)
        links = own.table(_confirm(pairs, classes, sets, percent), "links", gather=True)
        known = components(links, own, "first")
        more = own.table(_rest(members.select("bucket", "class").distinct(), known, classes, sets, percent, block), "more-links", gather=True)
        own.drop("sets", "buckets")
        if not more.isEmpty():
            known = components(links.unionByName(more), own, "all")
        of = classes.select("digest", "head", "class").join(known, classes["class"] == known["node"], "left").select("digest", "head", F.coalesce("component", "class").alias("component"))
        of = own.table(of, "components-of-classes", gather=True)
        least = of.groupBy("component").agg(F.min("head").alias("least"))
        found = of.join(least, "component").select("digest", "head", "least")
        out = measured.select("doc_id", "key", "n_shingles", "digest").join(found, "digest", "left").withColumn("least", F.coalesce("least", "key"))
        id_of = lambda c: F.when(~F.col(c)["none"], F.col(c)["id"])
        result = out.select("doc_id", "n_shingles", id_of("least").alias("component_id"), (F.col("key") == F.col("least")).alias("kept"), F.coalesce(id_of("head"), "doc_id").alias("class_id"), "key")
        return materialize(result, "near-duplicates")
