"""Vectorised byte-level text primitives shared by the operators.

All functions work on one contiguous ``uint8`` buffer that holds many texts
back to back, so a whole Arrow batch is tokenised and hashed without a Python
loop over words.  Hashes are polynomial prefix hashes modulo 2**64 (odd base,
so positions can be divided out) followed by a 64-bit finaliser.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
BASE2 = 0xD1B54A32D192ED03
_U = np.uint64
_POW: dict[int, list[np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, kept and grown per process."""
    found = _POW.get(base)
    if found is None or len(found[0]) < n:
        m = max(1 << 16, 1 << (n - 1).bit_length())
        found = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.empty(m, _U)
            a[0] = 1
            k = 1
            while k < m:  # doubling
                with np.errstate(over="ignore"):
                    a[k : 2 * k] = a[: min(k, m - k)] * _U(pow(b, k, 1 << 64))
                k *= 2
            found.append(a)
        _POW[base] = found
    return found[0][:n], found[1][:n]


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if off is not None else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(off[0])
    return raw[first : int(off[-1])], off - first


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)


def prefix_hash(raw: np.ndarray, base: int = BASE) -> np.ndarray:
    """h with h[j] - h[i] = sum of raw[t] * base**t over i <= t < j."""
    p, _ = _powers(max(1, len(raw)), base)
    h = np.zeros(len(raw) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(_U) + _U(1)) * p[: len(raw)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Position-independent hash of the bytes start..end (equal bytes, equal hash)."""
    _, q = _powers(len(h) + 1, base)
    with np.errstate(over="ignore"):
        return mix((h[end] - h[start]) * q[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def word_spans(raw: np.ndarray, off: np.ndarray, is_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal word runs, none across rows, and each word's row.

    A word is ``[^\\x20\\x09-\\x0D]+`` unless ``is_word`` (a bool per byte) says otherwise.
    """
    if is_word is None:
        is_word = (raw != 32) & ((raw < 9) | (raw > 13))
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    before[first] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    after[first[1:] - 1] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def words_of(column, is_word=None, piece: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased word hashes of a string column, the row of each, and words per row.

    The buffer is worked through in pieces of about ``piece`` bytes, cut between words,
    so memory stays near 40 bytes a byte of a piece plus 16 bytes a word.
    """
    raw, off = buffer_of(column)
    hashes, rows = [], []
    a, n = 0, len(raw)
    while a < n:
        b = min(n, a + piece)
        if b < n:  # back to the last gap, or on to the next one
            own = raw[a:b]
            gaps = np.flatnonzero(~is_word(own) if is_word else (own == 32) | ((own >= 9) & (own <= 13)))
            while not len(gaps) and b < n:
                c = min(n, b + piece)
                own = raw[b:c]
                gaps = np.flatnonzero(~is_word(own) if is_word else (own == 32) | ((own >= 9) & (own <= 13)))[:1]
                if len(gaps):
                    b += int(gaps[0]) + 1
                    break
                b = c
            else:
                if len(gaps):
                    b = a + int(gaps[-1]) + 1
        part = lower_ascii(raw[a:b])
        local = np.clip(off - a, 0, b - a)
        s, e, row = word_spans(part, local, is_word(part) if is_word else None)
        if len(s):
            hashes.append(span_hash(prefix_hash(part), s, e))
            rows.append(row)
        a = b
    h = np.concatenate(hashes) if hashes else np.zeros(0, _U)
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return h, row, np.bincount(row, minlength=len(off) - 1)


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several aligned hash arrays, order-sensitive."""
    with np.errstate(over="ignore"):
        x = np.zeros(len(parts[0]), _U)
        for k, part in enumerate(parts):
            x += part * _U(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64) | 1)
    return mix(x)


def slices(batch: pa.RecordBatch, name: str, size: int = 4 << 20):
    """Zero-copy slices of a batch whose texts hold about ``size`` bytes (a longer text is a slice of its own)."""
    _, off = buffer_of(batch.column(name))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
