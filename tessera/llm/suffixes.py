"""Repeated windows by a depth-limited radix sort of suffixes (operator 10).

All suffixes need ordering only through ``depth`` bytes: suffixes that are equal so far
start the same window. The sort goes by most significant digits, and a group that holds
one document leaves after each pass. Only one suffix in about 16 enters: of every window
of ``depth`` bytes, the place of its smallest ``core``-byte fingerprint (a choice that
depends on the window alone, so equal windows choose equal places). The windows that
choose one place form its span.

  first digit   the core, as a 64-bit fingerprint: deals the suffixes to buckets and, in a
                bucket, into groups; where all spans of a group are equal (96 bits), the
                smallest doc_id keeps its windows and the others lose them
  later digits  where a group has different spans, the bytes themselves: a place is dealt
                by the core and the bytes to its left, and by the core and those to its
                right, that all windows of that side share. There the shared bytes are
                sorted as 64-bit digits, pass by pass, and for each start the rest of its
                window. What is equal to the end is the same window, byte for byte.

Each task sends one entry for all equal suffixes it holds and settles the others itself,
so a passage that everybody has costs an entry a task. A core that a task finds in more
than ``hot`` different spans isn't gathered by the first digit: its places go to the
later digits at once, and one marked entry makes the other tasks' places follow.

Matches never cross documents: a document's smallest id decides, and rows that share a
doc_id are one document to each other. Defined results: null text counts as empty; texts
shorter than ``depth`` lose nothing; a null doc_id comes before all others; repeated rows
are treated alike; extra columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE_A, BASE_B, Scratch, fingerprints, inverse, materialize, mix, powers, prefix_sums, slices, trim, utf8_column

CORE = 20
#: The place of a marked entry.
MARK = 0xFFFFFFFF
_NULL_ID = np.iinfo(np.int64).min


class Spans:
    """The chosen places of some texts: for each, its text and the first and last of its windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, depth: int, core: int):
        n = len(data)
        self.sums = prefix_sums(data, BASE_A)
        self.sums_b = prefix_sums(data, BASE_B)
        width = depth - core + 1
        if n < depth:
            self.text = self.first = self.last = self.place = np.zeros(0, np.int64)
            self.h = self.s = np.zeros(0, np.uint64)
            return
        m = n - core + 1
        h = mix((self.sums[core:] - self.sums[:m]) * powers(inverse(BASE_A), m))
        key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(m, dtype=np.uint64)
        least, have = key, 1
        while have < width:  # least[i] covers `have` places from i on
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        inside = np.zeros(n + 1, np.int64)
        long = np.diff(offsets) >= depth
        inside[offsets[:-1][long]] += 1
        inside[offsets[1:][long] - depth + 1] -= 1
        windows = np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)
        place = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(windows), bool)
        new[1:] = (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)
        begin = np.flatnonzero(new)
        self.first = windows[begin]
        self.last = windows[np.append(begin[1:], len(windows)) - 1] if len(begin) else begin
        self.text = np.searchsorted(offsets, self.first, "right") - 1
        self.place = place[begin]
        self.h = h[self.place]
        # equal content means equal windows; what remains of the second base makes up 96 bits
        self.s = fingerprints(self.sums_b, BASE_B, self.first, self.last + depth)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers by significance, so that bytes that hardly vary stand together and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _numbers(data: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _write(columns: list[np.ndarray]) -> bytes:
    return b"".join(map(_planes, columns))


def _read(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    data, sizes = np.frombuffer(blob, np.uint8), [np.dtype(k).itemsize for k in kinds]
    cut = np.cumsum([0, *sizes]) * (len(data) // sum(sizes))
    return [_numbers(data[a:b], k) for a, b, k in zip(cut, cut[1:], kinds)]


_KINDS = ["<u8", "<u4", "<u4", "<u4"]  # an entry: core and span fingerprints, row (as steps), place


def _steps(row: np.ndarray) -> np.ndarray:
    return np.diff(row, prepend=0).astype("<u4")


def _deal(both: np.ndarray, key: np.ndarray, row: np.ndarray, buckets: int):
    """By bucket of the key: (bucket, numbers of its entries in order of their rows, the rows'
    (doc_id, tag) as bytes, each entry's row among these)."""
    spread = mix(key + np.uint64(BASE_B))  # chosen fingerprints are small ones
    bucket = ((spread >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((row, bucket))
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)):
        own = order[cut[b] : cut[b + 1]]
        used, local = np.unique(row[own], return_inverse=True)
        yield int(b), own, both[used].tobytes(), local


def _local(ids: np.ndarray, h: np.ndarray, s: np.ndarray, row: np.ndarray, at: np.ndarray, most: int):
    """Of equal (h, s) the smallest id and the first place in each of its rows stay. Three lists:
    entries to send, those that a smaller id covers, and those of cores with more than ``most`` spans."""
    own = ids[row]
    order = np.lexsort((at, row, own, s, h))
    h, s, own, row = h[order], s[order], own[order], row[order]
    new_h = np.ones(len(order), bool)
    new_h[1:] = h[1:] != h[:-1]
    new = new_h.copy()
    new[1:] |= s[1:] != s[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    covered = own > own[head]
    group = np.cumsum(new_h) - 1
    hot = (np.bincount(group, new) > most)[group] if len(order) else new
    new[1:] |= (row[1:] != row[:-1]) & ~covered[1:]
    return order[new & ~hot], order[covered], order[new & hot]


_ROWS = "bucket int, doc_id long, tag long, ids binary, entries binary"
_FOUND = "doc_id long, tag long, kind int, places binary"
#: Kinds of what is found: spans that go, spans to look at by bytes, and first places with masks of windows that go.
GONE, ASKED, MASKED = 1, 2, 3


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), names)], names=[n for n, _ in names])


def _by_row(both: np.ndarray, row: np.ndarray, at: np.ndarray, kind: int) -> Iterator[tuple]:
    """(doc_id, tag, kind, what ``at`` holds for it) of each row."""
    order = np.lexsort((at if at.ndim == 1 else at[:, 0], row))
    cut = np.flatnonzero(np.diff(row[order], prepend=-1))
    for i, j in zip(cut, np.append(cut[1:], len(order))):
        doc, tag = both[row[order[i]]].tolist()
        yield doc, tag, kind, at[order[i:j]].tobytes()


def _tagged(docs: DataFrame) -> DataFrame:
    """Rows are told apart by doc_id and a hash of the text; equal rows are treated alike."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def _held(rows: DataFrame, close) -> DataFrame:
    """Deal rows to tasks by bucket and call close(ids, entries) with all of one bucket, lists of
    bytes. Negative buckets hold what is found already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            known = []
            for bucket, doc, tag, ids, entries in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "tag", "ids", "entries"))):
                if bucket < 0:
                    known.append((doc, tag, -bucket, entries))
                    continue
                if bucket != now:
                    if held and (out := close(*zip(*held))):
                        yield _batch(out, _FOUND)
                    now, held = bucket, []
                held.append((ids, entries))
            if known:
                yield _batch(known, _FOUND)
        if held and (out := close(*zip(*held))):
            yield _batch(out, _FOUND)
        trim()

    dealt = rows.repartition("bucket", F.when(F.col("bucket") < 0, F.col("doc_id"))).sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, _FOUND)


def _joined(ids: tuple[bytes, ...]) -> tuple[np.ndarray, list[int]]:
    """The (doc_id, tag) rows of several parts, and where each part's begin."""
    parts = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in ids]
    return np.concatenate(parts), np.cumsum([0, *map(len, parts)]).tolist()


def _settle(ids: tuple[bytes, ...], blobs: tuple[bytes, ...]) -> list[tuple]:
    """First digit: spans that a smaller document has too, and those to look at by bytes."""
    both, base = _joined(ids)
    h, s, row, at = ([] for _ in range(4))
    for blob, first in zip(blobs, base):
        a, b, c, d = _read(blob, _KINDS)
        h.append(a)
        s.append(b)
        row.append(np.cumsum(c.astype(np.int64)) + first)
        at.append(d)
    h, s, row, at = map(np.concatenate, (h, s, row, at))
    own = both[row, 0]
    order = np.lexsort((own, s, h))
    h, s, row, at, own = h[order], s[order], row[order], at[order], own[order]
    new_h = np.ones(len(h), bool)
    new_h[1:] = h[1:] != h[:-1]
    new_s = new_h.copy()
    new_s[1:] |= s[1:] != s[:-1]
    mark = at == MARK
    # the id of a mark says nothing
    least_s = np.minimum.reduceat(np.where(mark, np.iinfo(np.int64).max, own), np.flatnonzero(new_s))[np.cumsum(new_s) - 1]
    covered = ~mark & (own > least_s)
    group, begin = np.cumsum(new_h) - 1, np.flatnonzero(new_h)
    several = (np.bincount(group, new_s) > 1) & (np.minimum.reduceat(own, begin) != np.maximum.reduceat(own, begin))
    open_ = ~mark & ~covered & (several | (np.bincount(group, mark) > 0))[group]
    return [*_by_row(both, row[covered], at[covered], GONE), *_by_row(both, row[open_], at[open_], ASKED)]


def _spread(docs: DataFrame, depth: int, core: int, buckets: int, most: int, hold: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            both, h, s, row, at = _gathered(held)
            sent, covered, hot = _local(both[:, 0], h, s, row, at, most)
            known = [(-kind, doc, tag, None, places) for own, kind in ((covered, GONE), (hot, ASKED)) for doc, tag, _, places in _by_row(both, row[own], at[own], kind)]
            marks = hot[np.unique(h[hot], return_index=True)[1]]
            at = np.concatenate([at, np.full(len(marks), MARK, "<u4")])
            h, s, row = (np.concatenate([x, x[marks]]) for x in (h, s, row))
            sent = np.concatenate([sent, np.arange(len(at) - len(marks), len(at))])
            out = [(b, None, None, names, _write([h[sent[own]], s[sent[own]], _steps(local), at[sent[own]]])) for b, own, names, local in _deal(both, h[sent], row[sent], buckets)]
            for lo in range(0, len(out), 64):
                yield _batch(out[lo : lo + 64], _ROWS)
            for lo in range(0, len(known), 5000):
                yield _batch(known[lo : lo + 5000], _ROWS)

        for batch in batches:
            data, offs = utf8_column(batch.column("text"))
            both = np.stack([batch.column(c).to_numpy() for c in ("doc_id", "tag")], 1)
            for i, j in slices(offs, 1 << 19):
                spans = Spans(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], depth, core)
                held.append((both[i:j], spans.h, spans.s.astype("<u4"), spans.text, (spans.first - (offs[i:j] - offs[i])[spans.text]).astype("<u4")))
                size += len(spans.h)
                if size >= hold:
                    yield from close()
                    held, size = [], 0
        if size:
            yield from close()
        del held[:]
        trim()

    return _tagged(docs).mapInArrow(run, _ROWS)


def _gathered(held: list[tuple]) -> list[np.ndarray]:
    """Columns of several slices one after the other; the fourth, the row, is counted on."""
    base = np.cumsum([0, *(len(x[0]) for x in held)])
    return [np.concatenate([x[c] + base[k] if c == 3 else x[c] for k, x in enumerate(held)]) for c in range(len(held[0]))]


class Side:
    """Windows around a core that start ``low`` to ``high`` bytes after the leftmost start, and the bytes
    [a, b), counted from there, that all of them share. A row holds the bytes [low, low + width)."""

    def __init__(self, low: int, high: int, depth: int):
        self.low, self.high, self.depth = low, high, depth
        self.a, self.b, self.width = high, low + depth, high - low + depth

    def windows(self, key: np.ndarray, ctx: np.ndarray, lo: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For each row a mask, bit 0 for its first start ``lo``, of those of its n windows that a smaller id has too."""
        mask = np.zeros(len(key), np.uint64)
        live, label = np.arange(len(key)), np.zeros(len(key), np.int64)
        shared = _digits(ctx[:, self.a - self.low : self.b - self.low])
        for digit in (key, *shared.T):
            live, label = _pass(live, label, [digit[live]], own)
        for o in range(self.low, self.high + 1):
            here = np.flatnonzero((lo[live] <= o) & (o < lo[live] + n[live]))
            at = live[here]
            rest = np.concatenate([ctx[at, o - self.low : self.a - self.low], ctx[at, self.b - self.low : o + self.depth - self.low]], 1)
            found, group = _pass(at, label[here], list(_digits(rest).T), own)
            if len(found):
                begin = np.flatnonzero(np.diff(group, prepend=-1))
                gone = found[own[found] > np.minimum.reduceat(own[found], begin)[group]]
                mask[gone] |= np.uint64(1) << (o - lo[gone]).astype(np.uint64)
        return mask


def _digits(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian 64-bit digits."""
    n, width = rows.shape
    out = np.zeros((n, -(-width // 8) * 8), np.uint8)
    out[:, :width] = rows
    return out.view(">u8").astype(np.uint64)


def _pass(live: np.ndarray, label: np.ndarray, digits: list[np.ndarray], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort within groups (labels) by the next digits; groups that hold one document leave."""
    if not len(live):
        return live, label
    order = np.lexsort([*digits[::-1], label])
    live, label = live[order], label[order]
    new = np.ones(len(live), bool)
    new[1:] = label[1:] != label[:-1]
    for x in digits:
        x = x[order]
        new[1:] |= x[1:] != x[:-1]
    group, begin, docs = np.cumsum(new) - 1, np.flatnonzero(new), own[live]
    keep = (np.minimum.reduceat(docs, begin) != np.maximum.reduceat(docs, begin))[group]
    live, group = live[keep], group[keep]
    return live, np.cumsum(np.diff(group, prepend=-1) != 0) - 1


def _sides(depth: int, core: int) -> list[Side]:
    reach = depth - core
    half = reach // 2
    return [Side(0, half, depth), *([Side(half + 1, reach, depth)] if half < reach else [])]


def _around(texts: DataFrame, depth: int, core: int, buckets: int, hold: int) -> DataFrame:
    """The bytes around the asked-for places, an entry for each side with a window there."""
    reach, sides = depth - core, _sides(depth, core)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            both, first, key, row, lo, n, before, ctx = _gathered(held)
            # of equal bytes at equal starts in this task the smallest id is sent, and the larger ones are settled
            own, full = both[row, 0], np.zeros(len(key), bool)
            flat = np.ascontiguousarray(np.concatenate([lo[:, None], n[:, None], ctx], 1)).view(f"V{ctx.shape[1] + 2}").ravel()
            _, same = np.unique(flat, return_inverse=True)
            order = np.lexsort((own, same, key))
            new = np.ones(len(order), bool)
            new[1:] = (same[order][1:] != same[order][:-1]) | (key[order][1:] != key[order][:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            full[order] = own[order] > own[order][head]
            mask = ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)) << before.astype(np.uint64)
            known = [(-kind, doc, tag, None, places) for doc, tag, kind, places in _by_row(both, row[full], np.stack([first[full].astype("<u8"), mask[full].astype("<u8")], 1), MASKED)]
            sent = np.flatnonzero(~full)
            out = []
            for b, mine, names, local in _deal(both, key[sent], row[sent], buckets):
                k = sent[mine]
                out.append((b, None, None, names, _write([key[k], _steps(local), first[k].astype("<u4"), lo[k], n[k], before[k]]) + ctx[k].tobytes()))
            for at in range(0, len(out), 64):
                yield _batch(out[at : at + 64], _ROWS)
            for at in range(0, len(known), 5000):
                yield _batch(known[at : at + 5000], _ROWS)

        for batch in batches:
            data, offs = utf8_column(batch.column("text"))
            both = np.stack([batch.column(c).to_numpy() for c in ("doc_id", "tag")], 1)
            asked = batch.column("asked").to_pylist()
            for i, j in slices(offs, 1 << 19):
                at = offs[i : j + 1] - offs[i]
                part = data[offs[i] : offs[j]]
                spans = Spans(part, at, depth, core)
                want = np.concatenate([np.frombuffer(b"".join(a), "<u4").astype(np.int64) + at[k] for k, a in enumerate(asked[i:j])] or [np.zeros(0, np.int64)])
                pick = np.flatnonzero(np.isin(spans.first, want))
                first, last, place = spans.first[pick], spans.last[pick], spans.place[pick]
                left = place - reach  # where a row begins
                held_rows = np.arange(i, j)
                for side in sides:
                    lo, hi = np.maximum(first - left, side.low), np.minimum(last - left, side.high)
                    has = np.flatnonzero(lo <= hi)
                    byte = left[has][:, None] + np.arange(side.low, side.low + side.width)
                    inside = (byte >= first[has][:, None]) & (byte < last[has][:, None] + depth)
                    ctx = np.where(inside, part[np.clip(byte, 0, len(part) - 1)], 0).astype(np.uint8)
                    if ctx.shape[1] < sides[0].width:
                        ctx = np.pad(ctx, ((0, 0), (0, sides[0].width - ctx.shape[1])))
                    key = fingerprints(spans.sums, BASE_A, left[has] + side.a, left[has] + side.b)
                    key = mix(key + np.uint64(side.low + 1))
                    text = spans.text[pick][has]
                    held.append((both[held_rows], first[has] - at[text], key, text, lo[has].astype(np.uint8), (hi - lo + 1)[has].astype(np.uint8), (lo + left - first)[has].astype(np.uint8), ctx))
                    size += len(has)
                if size >= hold // 4:
                    yield from close()
                    held, size = [], 0
        if size:
            yield from close()
        del held[:]
        trim()

    return texts.mapInArrow(run, _ROWS)


def _compare(depth: int, core: int):
    sides = _sides(depth, core)

    def close(ids: tuple[bytes, ...], blobs: tuple[bytes, ...]) -> list[tuple]:
        both, base = _joined(ids)
        kinds, wide = ["<u8", "<u4", "<u4", "u1", "u1", "u1"], sides[0].width
        one = sum(np.dtype(k).itemsize for k in kinds)
        cols: list[list[np.ndarray]] = [[] for _ in range(7)]
        for blob, start in zip(blobs, base):
            m = len(blob) // (one + wide)
            parts = _read(blob[: m * one], kinds)
            parts[1] = np.cumsum(parts[1].astype(np.int64)) + start
            for c, x in zip(cols, [*parts, np.frombuffer(blob, np.uint8)[m * one :].reshape(m, wide)]):
                c.append(x)
        key, row, first, lo, n, before, ctx = map(np.concatenate, cols)
        lo, n = lo.astype(np.int64), n.astype(np.int64)
        own, out = both[row, 0], []
        for side in sides:
            here = np.flatnonzero((lo >= side.low) & (lo <= side.high))
            mask = side.windows(key[here], ctx[here], lo[here], n[here], own[here])
            gone = here[mask > 0]
            found = np.stack([first[gone].astype("<u8"), (mask[mask > 0] << before[gone].astype(np.uint64)).astype("<u8")], 1)
            out += _by_row(both, row[gone], found, MASKED)
        return out

    return close


def _remove(texts: DataFrame, depth: int, core: int, with_text: bool) -> DataFrame:
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, kept_text string, spans array<struct<start: long, length: long>>, tag long" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8_column(batch.column("text"))
            ids, tags = batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist()
            found = {c: batch.column(c).to_pylist() for c in ("spans", "masks")}
            rows = []
            for i, j in slices(offs, 1 << 19):
                at = offs[i : j + 1] - offs[i]
                part = data[offs[i] : offs[j]]
                gone = np.zeros(len(part) + 1, np.int32)
                hit = [k for k in range(j - i) if found["spans"][i + k] or found["masks"][i + k]]
                if hit:
                    own = [part[at[k] : at[k + 1]] for k in hit]
                    at_ = np.cumsum([0, *map(len, own)])
                    back = at[hit] - at_[:-1]  # from the texts that lose something to all of them
                    spans = Spans(np.concatenate(own), at_, depth, core)
                    want = np.concatenate([np.frombuffer(b"".join(found["spans"][i + k] or ()), "<u4").astype(np.int64) + at_[n] for n, k in enumerate(hit)])
                    pairs = [np.frombuffer(b"".join(found["masks"][i + k] or ()), "<u8").reshape(-1, 2) for k in hit]
                    some = np.concatenate([x[:, 0].astype(np.int64) + at_[n] for n, x in enumerate(pairs)])
                    mask = np.zeros(len(spans.first), np.uint64)
                    np.bitwise_or.at(mask, np.searchsorted(spans.first, some), np.concatenate(pairs)[:, 1])
                    mask[np.isin(spans.first, want)] = np.uint64(0xFFFFFFFFFFFFFFFF)
                    mask = _alike(spans, mask)
                    place, bit = np.nonzero((mask[:, None] >> np.arange(depth - core + 1, dtype=np.uint64)) & np.uint64(1))
                    start = spans.first[place] + bit
                    ok = start <= spans.last[place]
                    start = start[ok] + back[spans.text[place[ok]]]
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + depth, -1)
                gone = np.cumsum(gone[:-1]) > 0
                for k in range(j - i):
                    own, cut = part[at[k] : at[k + 1]], gone[at[k] : at[k + 1]]
                    kept = own[~cut].tobytes() if cut.any() else own.tobytes()
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], cut.astype(np.int8), [0]])))
                    row = (None if ids[i + k] == _NULL_ID else ids[i + k], len(own), int(cut.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest())
                    rows.append(row + ((kept, _letters(own, cut), [{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2])], tags[i + k]) if with_text else ()))
            cols = list(zip(*rows)) if rows else [[]] * (9 if with_text else 5)
            kinds = [pa.int64()] * 4 + [pa.string()] + ([pa.binary(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.int64()] if with_text else [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text", "spans", "tag"][: len(kinds)])
        trim()

    return texts.mapInArrow(run, schema)


def _letters(text: np.ndarray, cut: np.ndarray) -> str:
    """What is left of UTF-8 bytes if a letter that loses a byte goes whole."""
    letter = np.cumsum((text & 0xC0) != 0x80)
    gone = np.bincount(letter, cut) > 0 if len(text) else cut
    return text[~gone[letter]].tobytes().decode("utf-8", "replace") if len(text) else ""


def _alike(spans: Spans, mask: np.ndarray) -> np.ndarray:
    """A task sends one of several equal places of a text: the others get the same mask."""
    some = np.flatnonzero(np.isin(spans.text, spans.text[mask > 0]))
    if not len(some):
        return mask
    order = some[np.lexsort((spans.s[some], spans.h[some], spans.text[some]))]
    new = np.ones(len(order), bool)
    new[1:] = (spans.text[order][1:] != spans.text[order][:-1]) | (spans.h[order][1:] != spans.h[order][:-1]) | (spans.s[order][1:] != spans.s[order][:-1])
    out = mask.copy()
    out[order] = np.bitwise_or.reduceat(mask[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def remove_repeats(docs: DataFrame, depth: int = 50, core: int = CORE, with_text: bool = False, hot: int = 256, hold: int = 400_000) -> DataFrame:
    """Each document without the bytes covered by a ``depth``-byte string that also starts
    in a document with a smaller doc_id. with_text adds what is left (kept, and kept_text
    without letters that lost a byte), what went (spans) and ``tag``, a hash of the input text
    that tells rows of one doc_id apart. ``hold``: entries
    that a task holds before it sends them; ``hot``: different spans of one core among them
    from which the first digit doesn't gather it."""
    spark = docs.sparkSession
    core = min(max(core, depth - 60), depth)  # a mask has a bit for each window of a place
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, 8)
    texts = _tagged(docs)
    with Scratch(spark) as own:
        found = own.table(_held(_spread(docs, depth, core, buckets, hot, hold), _settle), "suffix-groups")
        asked = found.where(F.col("kind") == ASKED).groupBy("doc_id", "tag").agg(F.collect_list("places").alias("asked"))
        around = _around(texts.join(asked, ["doc_id", "tag"]), depth, core, buckets, hold)
        masks = own.table(_held(around, _compare(depth, core)), "windows")
        both = found.where(F.col("kind") == GONE).unionByName(masks)
        lists = [F.collect_list(F.when(F.col("kind") == k, F.col("places"))).alias(name) for k, name in ((GONE, "spans"), (MASKED, "masks"))]
        places = materialize(both.groupBy("doc_id", "tag").agg(*lists), "places")
    return _remove(texts.join(places, ["doc_id", "tag"], "left"), depth, core, with_text)
