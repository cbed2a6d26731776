"""Sorted hashes of a block of texts, met in partitions as compressed slices.

A block has its distinct hashes sorted; partitions are ranges of hashes, so what a block
sends to a partition is one slice, stored as compressed differences.  It is never more
than a row for each hash and never more than one for each block and partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

_U = np.uint64
KINDS = (np.uint8, np.uint16, np.uint32, np.uint64)


def pack(a: np.ndarray, ordered: bool = False) -> bytes:
    """Non-negative integers, compressed; ordered ones as differences."""
    a = np.asarray(a, _U)
    if ordered and len(a):
        a = np.r_[a[:1], np.diff(a)]
    top = int(a.max(initial=0))
    k = next(i for i, t in enumerate(KINDS) if top <= np.iinfo(t).max)
    planes = a.astype(KINDS[k]).view(np.uint8).reshape(len(a), 1 << k).T  # like bytes together pack better
    return bytes([k]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes, ordered: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(1 << b[0], -1)
    a = np.ascontiguousarray(planes.T).view(KINDS[b[0]]).ravel().astype(_U)
    return np.cumsum(a, dtype=_U) if ordered else a


def ints(b: bytes, ordered: bool = False) -> np.ndarray:
    return unpack(b, ordered).astype(np.int64)


def bundle(*arrays: np.ndarray, ordered: np.ndarray | None = None) -> bytes:
    """Several arrays of non-negative integers in one value; an ordered one comes last."""
    parts = [pack(a) for a in arrays] + ([pack(ordered, True)] if ordered is not None else [])
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def unbundle(b: bytes, ordered: bool = False) -> list[np.ndarray]:
    n = int(np.frombuffer(b[:8], np.int64)[0])
    ends = 8 * (n + 1) + np.r_[0, np.cumsum(np.frombuffer(b[8 : 8 * (n + 1)], np.int64))]
    return [ints(b[x:y], ordered and k == n - 1) for k, (x, y) in enumerate(zip(ends[:-1], ends[1:]))]


def place(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def ask(parts: int, *more: str):
    """One row for each block and partition: the block's own slice of sorted hashes, its counts of them, and ``more`` arrays aligned with them."""

    def run(batches):
        for batch in batches:
            for block, words, *others in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "counts", *more))):
                words, others = unpack(words, True), [unpack(x) for x in others]
                if not len(words):
                    continue
                to = place(words, parts)  # ascending, as the hashes are
                cut = np.r_[0, np.flatnonzero(np.diff(to)) + 1, len(to)]
                cuts = list(zip(cut, cut[1:]))
                cols = [pa.array([pack(words[a:b], True) for a, b in cuts], pa.binary()), *(pa.array([pack(x[a:b]) for a, b in cuts], pa.binary()) for x in others)]
                yield pa.RecordBatch.from_arrays([pa.array(to[cut[:-1]]), pa.array([block] * len(cuts), pa.int64()), *cols], names=["part", "block", "words", "counts", *more])

    return run
