"""Terms of many texts at once: maximal runs of bytes of a class, A-Z lower-cased, as codes
into a dictionary. Bytes of letters beyond ASCII are in every class, so runs never cut one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(separators: str) -> np.ndarray:
    """True for the bytes that may stand in a term: all but those of ``separators`` (ASCII)."""
    inside = np.ones(256, bool)
    inside[list(separators.encode("ascii"))] = False
    return inside


def encode_terms(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """For texts that lie at ``offsets`` in ``data``: each term's code in order, the
    dictionary (binary), and how many terms each text has."""
    data = _LOWER[data]
    member = inside[data]
    first = member.copy()
    first[1:] &= ~member[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    first[inner] = member[inner]
    start = np.flatnonzero(first)
    ends = np.zeros(len(start) + 1, np.int32)
    if len(start):  # lengths without what lies between the terms
        ends[1:] = np.add.reduceat(member, start, dtype=np.int32)
        np.cumsum(ends, out=ends)
    column = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[member])])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.diff(np.searchsorted(start, offsets))


def as_text(terms: pa.Array) -> pa.Array:
    """Binary terms as strings: they were cut from strings at ASCII bytes only."""
    return pa.Array.from_buffers(pa.string(), len(terms), terms.buffers(), terms.null_count, terms.offset)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Neighbouring ``values`` as lists of the given lengths."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the offset of each row's list in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]
