"""Token ids by the tokenizers library, with each distinct piece of text encoded once.

Byte-pair encoding never looks across the pieces its pre-tokenizer makes. Texts are
cut, as arrays of bytes, at white space where the tokenizer cuts too, and a stop or
comma at a word's end is a piece of its own. A piece is known by a 64-bit fingerprint of
its bytes; the ids of known pieces come from a table of bounded size that a worker keeps
from task to task, and every new piece is encoded by the library. Where a tokenizer isn't
of a kind known to allow that, or a text holds unusual white space, the library gets the
whole text."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import BASE_A, fingerprints, prefix_sums, slices, utf8_column

#: White space of Unicode (and control characters) beside the six of ASCII, and the bytes that may begin it.
_UNUSUAL = re.compile("[\x00-\x08\x0e-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_MAY_BEGIN = np.zeros(256, bool)
_MAY_BEGIN[[*range(9), *range(14, 32), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord("."), ord(",")]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _byte_letters() -> dict[int, str]:
    """How byte-level models write the Latin letters beyond ASCII: printable bytes
    as the character of that number, the others from 256 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    as_text = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return {c: "".join(as_text[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


_AS_BYTES = _byte_letters()


def _kind(spec: dict) -> str:
    pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and normal is None:
        return "runs"
    steps = pre.get("pretokenizers") or []
    if normal and [x["type"] for x in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"]:
        if steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]:
            return "words"
    return "whole"


class Table:
    """Ids by fingerprint: open addressing, at most 2**``most_bits`` places of 17 bytes, and a pool of ids.

    When it is full, only the entries that were found again since the last time stay."""

    def __init__(self, most_bits: int):
        self.most_bits = most_bits
        self.clear()

    def clear(self, bits: int = 0) -> None:
        self._make(max(bits, min(16, self.most_bits)), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _make(self, bits: int, keys: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        self.bits, self.used, self.size = bits, 0, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.at, self.n = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.again = np.zeros(1 << bits, bool)
        self.pool = np.zeros(max(2 * len(ids), 1 << 16), np.uint32)
        if len(keys):
            self._put(keys, ids, n)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        place = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        have = self.keys[place]
        out = np.where(have == keys, place, -1)
        left = np.flatnonzero((have != keys) & (have != 0))
        while len(left):
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)
            have = self.keys[place[left]]
            hit = have == keys[left]
            out[left[hit]] = place[left[hit]]
            left = left[~hit & (have != 0)]
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """New distinct keys; the ids of all follow each other, n for each."""
        while self.bits < self.most_bits and (self.used + len(keys)) * 5 > 3 << self.bits:
            self._rebuild(self.bits + 1, self.keys != 0)
        if self.used and ((self.used + len(keys)) * 5 > 3 << self.bits or self.size + len(ids) > 4 << self.most_bits):
            keep = self.again.copy()
            if np.count_nonzero(keep) * 10 > 3 << self.bits:
                keep[np.flatnonzero(keep)[(3 << self.bits) // 10 :]] = False
            self._rebuild(self.bits, keep)
        if (self.used + len(keys)) * 5 > 4 << self.bits:  # a single slice that needs more than the bound
            self.clear((len(keys) * 5 // 3).bit_length())
        self._put(keys, ids, n)

    def _rebuild(self, bits: int, keep: np.ndarray) -> None:
        own = np.flatnonzero(keep)
        n = self.n[own].astype(np.int64)
        self._make(bits, self.keys[own], self.pool[_runs(self.at[own].astype(np.int64), n)], n)

    def _put(self, keys: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        if self.size + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.size], np.zeros(self.size + len(ids), np.uint32)])
        self.pool[self.size : self.size + len(ids)] = ids
        at = self.size + np.cumsum(n) - n
        self.size += len(ids)
        self.used += len(keys)
        place, left = (keys >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(keys))
        while len(left):
            spot = place[left]
            free = np.flatnonzero(self.keys[spot] == 0)
            _, first = np.unique(spot[free], return_index=True)
            won = left[free[first]]
            self.keys[place[won]], self.at[place[won]], self.n[place[won]] = keys[won], at[won], n[won]
            rest = np.ones(len(left), bool)
            rest[free[first]] = False
            left = left[rest]
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start[k] .. start[k] + n[k] - 1 of all k, one after the other."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


class Encoder:
    """The strings of special tokens in a text count as ordinary text."""

    def __init__(self, path: str, most_bits: int = 21):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            self.kind = _kind(json.load(f))
        self.table = Table(most_bits)

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _piece(self, piece: str) -> list[int]:
        spaced = piece[0] == " "
        word = piece[1:] if spaced else piece
        if self.kind != "whole" and word.isalpha() and ((ascii := word.isascii()) or _LATIN.fullmatch(word)):
            if self.kind == "words":
                word = word.lower()
            if not ascii:
                word = word.translate(_AS_BYTES)
            return [t.id for t in self.model.tokenize(f"\u0120{word}" if spaced else word)]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _starts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where pieces begin. They cover all bytes; for "words" some are white space."""
        n = len(data)
        first = np.zeros(n + 1, bool)  # of a text
        first[offs] = True
        space = _SPACE[data]
        before = np.zeros(n, bool)  # white space stands before, in the same text
        before[1:] = space[:-1] & ~first[1:-1]
        after = np.zeros(n, bool)  # something other than white space follows, in the same text
        after[:-1] = ~space[1:] & ~first[1:-1]
        begin = first[:-1] | (space & ~before)
        if self.kind == "words":
            begin |= ~space & before
        else:  # the last character of a run of white space goes by itself, or if a space with the word
            begin |= space & after
            begin[1:] |= ~space[1:] & before[1:] & (data[:-1] != 32)
        # a mark at the end of a word that ends in a plain letter or digit
        plain = _PLAIN[data]
        if n > 1:
            plain[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        mark = np.flatnonzero(_MARK[data])
        mark = mark[~first[mark]]
        mark = mark[plain[mark - 1]]
        begin[mark[first[mark + 1] | _SPACE[data[np.minimum(mark + 1, n - 1)]]]] = True
        # texts for the library as a whole
        odd = np.flatnonzero(_MAY_BEGIN[data])
        whole = np.arange(len(offs) - 1) if self.kind == "whole" else np.unique(np.searchsorted(offs, odd, "right") - 1)
        for k in whole:
            if self.kind == "whole" or _UNUSUAL.search(data[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace")):
                begin[offs[k] : offs[k + 1]] = False
                begin[offs[k] : offs[k] + 1] = offs[k + 1] > offs[k]
        return np.flatnonzero(begin)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts as UTF-8 bytes with n + 1 offsets: all ids (uint32), and where each text's begin (n + 1)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        start = self._starts(data, offs)
        end = np.append(start[1:], len(data))
        if self.kind == "words":  # white space has no ids
            solid = np.concatenate([[0], np.cumsum(~_SPACE[data])])
            own = solid[end] > solid[start]
            start, end = start[own], end[own]
        keys = fingerprints(prefix_sums(data, BASE_A), BASE_A, start, end) | np.uint64(1)
        place = self.table.find(keys)
        new = np.flatnonzero(place < 0)
        self.table.again[place[place >= 0]] = True
        if len(new):
            self._learn(data, start, end, keys, new)
            place = self.table.find(keys)
            if (place < 0).any():  # the table had to drop what this slice needs too
                self.table.clear()
                self._learn(data, start, end, keys, np.arange(len(keys)))
                place = self.table.find(keys)
        n = self.table.n[place].astype(np.int64)
        ids = self.table.pool[_runs(self.table.at[place].astype(np.int64), n)]
        upto = np.concatenate([[0], np.cumsum(n)])
        return ids, upto[np.searchsorted(start, offs)]

    def encode_column(self, column, end_id: int, limit: int = 1 << 20):
        """Of an Arrow string column without nulls, in slices of about ``limit`` bytes: (first row,
        rows, ids, n + 1 offsets), with the end id after each text."""
        data, offs = utf8_column(column)
        for i, j in slices(offs, limit):
            ids, at = self.encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            yield i, j - i, np.insert(ids, at[1:], end_id).astype("<u4", copy=False), at + np.arange(j - i + 1)

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray, new: np.ndarray) -> None:
        distinct, first = np.unique(keys[new], return_index=True)
        raw = data.tobytes()
        made = [self._piece(raw[start[k] : end[k]].decode("utf-8", "replace")) for k in new[first]]
        n = np.fromiter(map(len, made), np.int64, len(made))
        self.table.add(distinct, np.fromiter((x for m in made for x in m), np.uint32, int(n.sum())), n)


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and tokenizer."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
