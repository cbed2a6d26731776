"""Exact removal of repeated byte strings over a sparse, distributed suffix array.

Every byte covered by a string of ``length`` bytes that also starts anywhere else (the same
document included) is found, whatever the overlaps, judged on the input.

Sorting all suffixes would shuffle ``length`` bytes for each byte of text.  Instead, the
suffix array is sparse: of each window of ``length`` bytes, the least hashed ``gram`` bytes
(leftmost of equal ones) are its anchor, so equal windows have their anchor at the same
place, and consecutive windows with one anchor form a segment (about one for every
``(length - gram) / 2`` bytes).

1. Texts are packed into blocks and cut into segments.  Segments that are equal within a piece
   of a block are settled there (repeated lines and periodic texts make no more rows), and
   one of each kind goes on.
2. A suffix at an anchor can only matter if its gram occurs twice.  Blocks send the hashes of
   their grams to partitions and learn which do; a hash shared by chance only costs time.
3. The other suffixes, with the bytes of their segment to the right of the anchor and (backwards)
   to its left, are dealt out by sampled splitters on those bytes and sorted within each bucket
   by multikey quicksort, eight bytes a character.  Neighbours are compared byte by byte; the
   first and last of each bucket are compared across boundaries.  A splitter may fall between
   equal suffixes (their place is the last of the key), so a passage that a third of all
   documents holds is dealt over many buckets.
4. A segment equal to a neighbour is repeated with all its windows.  Segments that share only
   the gram are the edges of passages: the 128-bit fingerprints (two bases) of the windows of
   each different one meet in ranges of fingerprints, sorted and packed, and a window that two
   segments have is repeated.  This is the only place where equality isn't that of bytes.
   Windows that reach further right than the suffix has in common with its neighbours, or further
   left than its segment has in common with any of the same gram, take no part.

Cases.  Null text: empty, nothing removed.  Texts under ``length`` bytes lose nothing.  Rows
that repeat (the same doc_id and text) are copies of each other and lose all that is long
enough; a null doc_id is a document like any other.  Very long texts are worked through
in overlapping pieces.  Empty table: empty result.  Extra columns of any name are carried by
``mark``; its own results are prefixed with an underscore until the caller picks them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from . import common
from .blobs import ask, ints, pack, unpack
from .bytesops import BASE, BASE2, buffer_of, mix, prefix_hash, slices, span_hash, _powers

_U = np.uint64
PIECE = 1 << 19
_IDX = _U((1 << 22) - 1)
NOBODY = -(1 << 63)
SAMPLES = "spark.sql.execution.rangeExchange.sampleSizePerPartition"


def segments(raw: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of one piece (at most 4 MB) with rows at off: start, windows, anchor, gram hash and content hash of each segment."""
    z = np.zeros(0, np.int64)
    size = np.diff(off)
    has = np.flatnonzero(size >= length)
    if not len(has):
        return z, z, z, z.astype(_U), z.astype(_U)
    n = len(raw)
    h = prefix_hash(raw)
    _, q = _powers(n + 1)
    m = n - gram + 1
    with np.errstate(over="ignore"):
        g = mix((h[gram:] - h[:-gram]) * q[:m])
    v = (g & ~_IDX) | np.arange(m, dtype=_U)
    w = length - gram + 1
    p = n - length + 1  # windows
    pad = -m % w
    block = np.concatenate([v, np.full(pad, ~_U(0))]).reshape(-1, w)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(right[:p], left[w - 1 : w - 1 + p]) & _IDX).astype(np.int64)
    step = np.zeros(p + 1, np.int32)
    np.add.at(step, off[has], 1)
    np.add.at(step, off[has + 1] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(step[:p]))
    a = anchor[at]
    new = np.r_[True, (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)]
    first = np.flatnonzero(new)
    start, count, a = at[first], np.diff(np.r_[first, len(at)]), a[first]
    with np.errstate(over="ignore"):
        content = mix(span_hash(h, start, start + count - 1 + length) + (a - start).astype(_U))
    return start, count, a, mix(~g[a]), content  # anchors are the least of g: mixed again, they fall evenly into ranges


def _pieces(off: np.ndarray, length: int):
    """Ranges of rows of about PIECE bytes, and parts of a longer row: (first row, last row, first byte, last byte)."""
    i, n = 0, len(off) - 1
    while i < n:
        if off[i + 1] - off[i] > PIECE:
            for a in range(int(off[i]), max(int(off[i]) + 1, int(off[i + 1]) - length + 1), PIECE):
                yield i, i + 1, a, min(int(off[i + 1]), a + PIECE + length - 1)
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(off, off[i] + PIECE, side="right")) - 1)
        if off[j] - off[i] > PIECE:
            j -= 1
        yield i, j, int(off[i]), int(off[j])
        i = j


def settle(raw: np.ndarray, start: np.ndarray, n: np.ndarray, content: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which segments of a piece equal another one, byte by byte, and which are the first of their kind."""
    copy, first = np.zeros(len(start), bool), np.ones(len(start), bool)
    order = np.argsort(content, kind="stable")
    same = np.flatnonzero(content[order[1:]] == content[order[:-1]])
    if not len(same):
        return copy, first
    data, kinds = raw.tobytes(), {}
    for i in np.unique(np.r_[order[same], order[same + 1]]).tolist():
        key = data[start[i] : start[i] + n[i] - 1 + length]
        other = kinds.setdefault((key, int(n[i])), i)
        if other != i:
            copy[i] = copy[other] = True
            first[i] = False
    return copy, first


BLOCK = {"block": pa.int64(), "k1": pa.list_(pa.int64()), "k2": pa.list_(pa.int64()), **dict.fromkeys("text off s_row s_start s_n r_row r_start r_n r_anchor r_often r_word words counts".split(), pa.binary()), "n_words": pa.int64()}


def _scan(length: int, gram: int, size: int, bits: int):
    """Blocks of texts with what is settled (s_) and the segments that stand for their kind (r_: row, start, windows, anchor)."""

    def describe(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
        settled, found = [], []
        for i, j, a, b in _pieces(off, length):
            start, n, anchor, g, content = segments(raw[a:b], np.clip(off[i : j + 1], a, b) - a, length, gram)
            if not len(start):
                continue
            g, content = (x >> _U(64 - bits) for x in (g, content))
            copy, first = settle(raw[a:b], start, n, content, length)
            row = np.searchsorted(off, start + a, side="right") - 1
            at = start + a - off[row]
            # neighbouring copies as one run
            c = np.flatnonzero(copy)
            if len(c):
                new = np.r_[True, (row[c[1:]] != row[c[:-1]]) | (at[c[1:]] != at[c[:-1]] + n[c[:-1]])]
                settled.append((row[c[new]], at[c[new]], np.add.reduceat(n[c], np.flatnonzero(new))))
            found.append([x[first] for x in (row, at, n, anchor - start, copy, g)])
        z = np.zeros(0, np.int64)
        s = [np.concatenate(x) for x in zip(*settled)] or [z] * 3
        r = [np.concatenate(x) for x in zip(*found)] or [z] * 5 + [z.astype(_U)]
        words, word, counts = np.unique(r[5], return_inverse=True, return_counts=True)
        names = ("s_row", "s_start", "s_n", "r_row", "r_start", "r_n", "r_anchor", "r_often", "r_word", "counts")
        return dict(zip(names, (*s, *r[:5], word, counts))) | {"words": words}

    def run(batches):
        task, k = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        for batch in batches:
            for part in slices(batch, "_text", size):
                raw, off = buffer_of(part.column("_text"))
                cols = describe(raw, off)
                cols = {"text": zstandard.ZstdCompressor(level=1).compress(raw.tobytes()), "off": pack(off, True), **{c: pack(x, c == "words") for c, x in cols.items()}} | {"n_words": len(cols["words"])}
                whole = {"block": task << 32 | k, "k1": part.column("k1").to_pylist(), "k2": part.column("k2").to_pylist(), **cols}
                yield pa.RecordBatch.from_arrays([pa.array([whole[c]], kind) for c, kind in BLOCK.items()], names=list(BLOCK))
                k += 1

    return run


def _twice(key, table):
    """For each block's slice, a bit for each of its keys (a word, or a word and another): does it occur again?"""
    asked = [unpack(x, True) for x in table["words"].to_pylist()]
    count = np.concatenate([ints(x) for x in table["counts"].to_pylist()])
    words = np.concatenate(asked)
    more = np.concatenate([unpack(x) for x in table["more"].to_pylist()]) if "more" in table.column_names else np.zeros(len(words), _U)
    order = np.lexsort((more, words))
    new = np.r_[True, (words[order[1:]] != words[order[:-1]]) | (more[order[1:]] != more[order[:-1]])]
    at = np.empty(len(words), np.int64)
    at[order] = np.cumsum(new) - 1
    often = np.bincount(at, count)[at] > 1
    cut = np.cumsum([0, *(len(x) for x in asked)])
    bits = [np.packbits(often[a:b]).tobytes() for a, b in zip(cut, cut[1:])]
    return pa.table({"block": table["block"], "part": table["part"], "n": pa.array(np.diff(cut)), "bits": pa.array(bits, pa.binary())})


def _answered(table: pa.Table) -> np.ndarray:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    return np.concatenate([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]) for r in rows] or [np.zeros(0, np.uint8)]).astype(bool)


SUFFIX = "right binary, left binary, block long, rep long, often boolean"


def _suffixes(length: int):
    """The segments of a block whose gram occurs twice: bytes from the anchor on, and bytes before it, backwards."""

    def run(key, left, right):
        row = left.to_pylist()[0]
        twice, word = _answered(right), ints(row["r_word"])
        take = np.flatnonzero(twice[word]) if len(word) else np.zeros(0, np.int64)
        data = zstandard.ZstdDecompressor().decompress(row["text"]) if len(take) else b""
        off, at, start, n, anchor, often = (ints(row[c], c == "off") for c in ("off", "r_row", "r_start", "r_n", "r_anchor", "r_often"))
        a = off[at[take]] + start[take]
        m, e = a + anchor[take], a + n[take] - 1 + length
        return pa.table(
            {
                "right": pa.array([data[x:y] for x, y in zip(m.tolist(), e.tolist())], pa.binary()),
                "left": pa.array([data[x:y][::-1] for x, y in zip(a.tolist(), m.tolist())], pa.binary()),
                "block": pa.array(np.full(len(take), row["block"]), pa.int64()),
                "rep": pa.array(take, pa.int64()),
                "often": pa.array(often[take].astype(bool)),
            }
        )

    return run


class Suffixes:
    """Suffixes of a bucket as sequences of characters: words of eight bytes of ``right``, its length, words of ``left``, its length."""

    def __init__(self, right: pa.Array, left: pa.Array):
        self.sides = [buffer_of(x) for x in (right, left)]
        sizes = [np.diff(off) for _, off in self.sides]
        self.words = [-(-int(x.max(initial=0)) // 8) for x in sizes]
        self.sides = [(np.r_[raw, np.zeros(8, np.uint8)], off[:-1], size) for (raw, off), size in zip(self.sides, sizes)]
        self.depth = sum(self.words) + 2

    def character(self, rows: np.ndarray, depth: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), _U)
        for k, (raw, start, size) in enumerate(self.sides):
            base = self.words[0] + 1 if k else 0
            d = depth - base
            here = np.flatnonzero((d >= 0) & (d <= self.words[k]))
            if not len(here):
                continue
            r, d = rows[here], d[here]
            left = size[r] - 8 * d  # bytes from this word on
            at = np.minimum(start[r] + 8 * d, len(raw) - 8)
            x = np.ascontiguousarray(raw[at[:, None] + np.arange(8)]).view(">u8").ravel().astype(_U)
            gone = _U(8) * (8 - np.clip(left, 0, 8)).astype(_U)  # bits past the end
            x = np.where(gone >= 64, _U(0), (x >> np.minimum(gone, _U(63))) << np.minimum(gone, _U(63)))
            out[here] = np.where(d == self.words[k], size[r].astype(_U), x)
        return out


def multikey_quicksort(keys: Suffixes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of n suffixes, and whether each equals the one before.

    All groups that are still open are partitioned at once around a pivot of their own into what
    is less, equal and greater at the group's character; the equal ones go on to the next character.
    """
    order, same = np.arange(n), np.zeros(n, bool)
    lo, hi, depth = np.array([0]), np.array([n]), np.array([0])
    while True:
        done = depth >= keys.depth
        for a, b in zip(lo[done & (hi - lo > 1)], hi[done & (hi - lo > 1)]):
            same[a + 1 : b] = True
        open_ = ~done & (hi - lo > 1)
        lo, hi, depth = lo[open_], hi[open_], depth[open_]
        if not len(lo):
            return order, same
        size = hi - lo
        group = np.repeat(np.arange(len(lo)), size)
        first = np.cumsum(size) - size
        place = np.arange(len(group)) - first[group] + lo[group]
        rows = order[place]
        c = keys.character(rows, depth[group])
        pivot = c[first + size // 2][group]
        side = (c > pivot).astype(np.int64) + (c >= pivot)
        order[place] = rows[np.argsort(group * 3 + side, kind="stable")]
        counts = np.bincount(group * 3 + side, minlength=3 * len(lo)).reshape(-1, 3)
        ends = lo[:, None] + np.cumsum(counts, axis=1)
        lo, hi = (ends - counts).ravel(), ends.ravel()
        depth = (depth[:, None] + np.array([0, 1, 0])).ravel()


#: Kinds of a bucket's rows: repeated whole; a border of a passage; the bucket's first and last row.
WHOLE, BORDER, FIRST, LAST = range(4)
FOUND = "kind int, right binary, left binary, block long, rep long, single boolean, listed boolean, lo int, hi int"


def _in_common(keys: Suffixes, a: np.ndarray, b: np.ndarray, side: int) -> np.ndarray:
    """Leading bytes that suffixes a and b share on one side (0: right, 1: left)."""
    raw, start, size = keys.sides[side]
    out, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
    for d in range(keys.words[side]):
        if not len(open_):
            break
        depth = np.full(len(open_), d + (keys.words[0] + 1 if side else 0))
        x = keys.character(a[open_], depth) ^ keys.character(b[open_], depth)
        out[open_] += sum((x >> _U(64 - 8 * k) == 0 for k in range(1, 9)), np.zeros(len(x), np.int64))
        open_ = open_[x == 0]
    return np.minimum(out, np.minimum(size[a], size[b]))


def _bucket(length: int, gram: int):
    """Sorts a bucket and compares neighbours."""

    def run(batches):
        some = [b for b in batches if b.num_rows]
        if not some:
            return
        t = pa.Table.from_batches(some)
        right, left = (t[c].combine_chunks() for c in ("right", "left"))
        keys, n = Suffixes(right, left), t.num_rows
        order, same = multikey_quicksort(keys, n)
        shared = np.r_[0, _in_common(keys, order[:-1], order[1:], 0)]  # with the one before
        alike = shared >= gram
        after = lambda x: np.r_[x[1:], np.zeros_like(x[:1])]
        whole = same | after(same)
        # of equal rows, the first stands for all; it is a border if its gram goes on with other rows
        head = ~same
        run_of = np.cumsum(head) - 1
        ends = np.r_[np.flatnonzero(head)[1:], n] - 1
        border = head & (alike | after(alike)[ends[run_of]])
        single = ~whole & ~np.asarray(t["often"].combine_chunks().to_numpy(zero_copy_only=False), bool)[order]
        listed = border[np.flatnonzero(head)[run_of]]  # as a border, by the first of the equal rows
        # windows that may occur elsewhere: what is beyond the bucket is unknown, so its first and last rows and grams have all
        at = np.flatnonzero(border)
        rows = order[at]
        sizes = [size[rows] for _, _, size in keys.sides]
        reach = np.maximum(shared[at], after(shared)[ends[run_of[at]]])
        reach = np.where((run_of[at] == 0) | (run_of[at] == run_of[-1]), sizes[0], reach)
        group = np.cumsum(~alike)[at]
        back = np.zeros(len(at), np.int64)
        words = [keys.character(rows, np.full(len(rows), keys.words[0] + 1 + d)) for d in range(keys.words[1] + 1)]
        by = np.lexsort((*words[::-1], group))
        common_ = np.where(group[by[1:]] == group[by[:-1]], _in_common(keys, rows[by[:-1]], rows[by[1:]], 1), 0)
        np.maximum.at(back, by[1:], common_)
        np.maximum.at(back, by[:-1], common_)
        back = np.where((group == np.cumsum(~alike)[0]) | (group == np.cumsum(~alike)[-1]), sizes[1], back)
        lo, hi = np.zeros(n, np.int32), np.zeros(n, np.int32)
        lo[at] = sizes[1] - back
        hi[at] = np.minimum(sizes[1] + reach, sizes[0] + sizes[1]) - length + 1
        t = t.take(pa.array(order))
        kinds = [(WHOLE, whole), (BORDER, border & (lo < hi)), (FIRST, np.arange(n) == 0), (LAST, np.arange(n) == n - 1)]
        for kind, mask in kinds:
            own = t.filter(pa.array(mask))
            blank = pa.array([b""] * own.num_rows, pa.binary())
            cols = [pa.array(np.full(own.num_rows, kind, np.int32)), *([blank, blank] if kind == WHOLE else [own["right"].combine_chunks(), own["left"].combine_chunks()]), own["block"].combine_chunks(), own["rep"].combine_chunks(), *(pa.array(x[mask]) for x in (single, listed, lo, hi))]
            yield from pa.Table.from_arrays(cols, names=["kind", "right", "left", "block", "rep", "single", "listed", "lo", "hi"]).to_batches(max_chunksize=20_000)

    return run


def _across(rows: list, length: int, gram: int) -> list[tuple]:
    """What the first and last rows of all buckets, in order of bucket, share across boundaries: rows of FOUND."""
    rows = sorted(rows, key=lambda r: (r.bucket, r.kind))
    whole, border = set(), set()
    for k in range(len(rows) - 1):
        a, b = rows[k], rows[k + 1]
        if a.bucket == b.bucket:
            continue
        if (bytes(a.right), bytes(a.left)) == (bytes(b.right), bytes(b.left)):
            whole |= {k, k + 1}
        elif bytes(a.right[:gram]) == bytes(b.right[:gram]):
            border |= {k, k + 1}
    out = [(WHOLE, b"", b"", rows[k].block, rows[k].rep, False, False, 0, 0) for k in sorted(whole)]
    more = {(rows[k].block, rows[k].rep): (BORDER, bytes(rows[k].right), bytes(rows[k].left), rows[k].block, rows[k].rep, rows[k].single and k not in whole, True, 0, len(rows[k].left) + len(rows[k].right) - length + 1) for k in sorted(border) if not rows[k].listed}
    return out + list(more.values())


def _windows(length: int, most: int = 1 << 18):
    """Blocks of about ``most`` windows of border segments: their fingerprints, and the places of the single segments in them."""

    def fingerprints(raw: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return [mix(np.zeros(0, _U)) if not len(at) else span_hash(prefix_hash(raw, base), at, at + length, base) for base in (BASE, BASE2)]

    def run(batches):
        task, number = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        for batch in batches:
            lo, hi = (np.asarray(batch.column(c)).astype(np.int64) for c in ("lo", "hi"))
            n = hi - lo
            end, i = np.cumsum(n), 0
            while i < len(n):
                j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + most, side="right")))
                part = batch.slice(i, j - i)
                texts = [x[::-1] + y for x, y in zip(part.column("left").to_pylist(), part.column("right").to_pylist())]
                own, single = n[i:j], np.asarray(part.column("single").to_numpy(zero_copy_only=False), bool)
                start = np.cumsum([0, *map(len, texts)])[:-1] + lo[i:j]
                words, more = fingerprints(np.frombuffer(b"".join(texts), np.uint8), start, own)
                order = np.lexsort((more, words))
                new = np.r_[True, (words[order[1:]] != words[order[:-1]]) | (more[order[1:]] != more[order[:-1]])]
                at = np.empty(len(words), np.int64)
                at[order] = np.cumsum(new) - 1
                blobs = {"words": pack(words[order[new]], True), "more": pack(more[order[new]]), "counts": pack(np.bincount(at)), "at": pack(at[np.repeat(single, own)])}
                lists = {"of": np.asarray(part.column("block"))[single], "rep": np.asarray(part.column("rep"))[single], "first": lo[i:j][single], "n": own[single]}
                yield pa.RecordBatch.from_arrays([pa.array([task << 32 | number]), *(pa.array([x], pa.binary()) for x in blobs.values()), *(pa.array([x], pa.list_(pa.int64())) for x in lists.values()), pa.array([int(new.sum())])], names=["block", *blobs, *lists, "n_words"])
                i, number = j, number + 1

    return run


def _repeated(key, left, right):
    """Runs (block, rep, start, n) of repeated windows in the single segments listed."""
    row = left.to_pylist()[0]
    hit = _answered(right)[ints(row["at"])]
    n = np.array(row["n"], np.int64)
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
    found = np.flatnonzero(hit)
    new = np.r_[True, (np.diff(found) > 1) | (of[found[1:]] != of[found[:-1]])] if len(found) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    seg = of[found[first]]
    return pa.table({"block": np.array(row["of"], np.int64)[seg], "rep": np.array(row["rep"], np.int64)[seg], "start": np.array(row["first"], np.int64)[seg] + place[found[first]], "n": np.diff(np.r_[first, len(found)]).astype(np.int64)})


def _runs(key, left, right):
    """(k1, k2, at) of the texts of a block that have repeated windows."""
    row = left.to_pylist()[0] if left.num_rows else None
    if row is None:
        return pa.table({"k1": pa.array([], pa.int64()), "k2": pa.array([], pa.int64()), "at": pa.array([], AT)})
    s_row, s_start, s_n, r_row, r_start, r_n = (ints(row[c]) for c in ("s_row", "s_start", "s_n", "r_row", "r_start", "r_n"))
    rep, start, n = (np.asarray(right[c]) for c in ("rep", "start", "n"))
    at_row, at, count = np.r_[s_row, r_row[rep]], np.r_[s_start, r_start[rep] + start], np.r_[s_n, np.where(n < 0, r_n[rep], n)]
    order = np.lexsort((at, at_row))
    at_row, at, count = at_row[order], at[order], count[order]
    rows, first = np.unique(at_row, return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(at_row)].astype(np.int32)), pa.StructArray.from_arrays([pa.array(at), pa.array(count)], names=["start", "n"]))
    return pa.table({"k1": pa.array(np.array(row["k1"], np.int64)[rows]), "k2": pa.array(np.array(row["k2"], np.int64)[rows]), "at": lists})


AT = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("_k1", F.coalesce(F.col("doc_id"), F.lit(NOBODY))).withColumn("_k2", F.xxhash64(text))


def repeated(spark: SparkSession, docs: DataFrame, length: int = 200, gram: int = 48, block: int = 1 << 20, bits: int = 64) -> DataFrame:
    """(k1, k2, at): for each text that has any, the sorted runs (start, n) of repeated windows.

    ``bits``: of hashes that only choose what is compared; with few of them more is compared, with the same result.
    """
    texts = _keyed(docs).select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), F.coalesce(F.col("text"), F.lit("")).alias("_text")).filter(F.octet_length("_text") >= length)
    blocks = common.stage(spark, texts.mapInArrow(_scan(length, gram, block, bits), from_arrow_schema(pa.schema(BLOCK))), "suffix-blocks")
    n_words = blocks.agg(F.sum("n_words")).first()[0] or 0
    parts = common.partitions(spark, -(-n_words // 1_500_000))
    answers = blocks.select("block", "words", "counts").mapInArrow(ask(parts), "part long, block long, words binary, counts binary")
    answers = answers.groupBy("part").applyInArrow(_twice, "block long, part long, n long, bits binary")
    whole = blocks.drop("k1", "k2", "s_row", "s_start", "s_n", "words", "counts", "n_words")
    suffixes = whole.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_suffixes(length), SUFFIX)
    buckets = common.partitions(spark, -(-n_words // 75_000))
    dealt = suffixes.repartitionByRange(buckets, "right", "left", "block", "rep")
    with common.setting(spark, SAMPLES, "20"):  # keys of some hundred bytes: fewer of them come to the driver as samples
        found = common.stage(spark, dealt.mapInArrow(_bucket(length, gram), FOUND).withColumn("bucket", F.spark_partition_id()), "suffix-found")
    edges = found.filter(F.col("kind") >= FIRST).collect()  # two rows a bucket
    known = found.filter(F.col("kind") < FIRST).drop("bucket")
    if fixed := _across(edges, length, gram):
        known = known.unionByName(spark.createDataFrame(fixed, FOUND))
    kinds = "block long, words binary, more binary, counts binary, at binary, of array<long>, rep array<long>, first array<long>, n array<long>, n_words long"
    border = known.filter(F.col("kind") == BORDER).select("right", "left", "block", "rep", "single", "lo", "hi")
    windows = common.stage(spark, border.mapInArrow(_windows(length), kinds), "suffix-windows")
    parts = common.partitions(spark, -(-(windows.agg(F.sum("n_words")).first()[0] or 0) // 1_500_000))
    asked = windows.select("block", "words", "counts", "more").mapInArrow(ask(parts, "more"), "part long, block long, words binary, counts binary, more binary")
    answers = asked.groupBy("part").applyInArrow(_twice, "block long, part long, n long, bits binary")
    hit = windows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_repeated, "block long, rep long, start long, n long")
    all_ = known.filter(F.col("kind") == WHOLE).select("block", "rep", F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("n"))
    of = blocks.select("block", "k1", "k2", "s_row", "s_start", "s_n", "r_row", "r_start", "r_n")
    runs = of.groupBy("block").cogroup(all_.unionByName(hit).groupBy("block")).applyInArrow(_runs, "k1 long, k2 long, at array<struct<start:long,n:long>>")
    out = common.stage(spark, runs.groupBy("k1", "k2").agg(F.first("at").alias("at")), "suffix-runs")  # rows of one key have one text
    common.release(blocks, found, windows)
    return out


def spans(at: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that sorted runs of windows cover."""
    out: list[list[int]] = []
    for x in at or ():
        a, b = x["start"], x["start"] + x["n"] - 1 + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in gone:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


RESULTS = ("_n_bytes", "_n_removed", "_n_spans", "_kept_sha256", "_kept")


def mark(spark: SparkSession, docs: DataFrame, length: int = 200, gram: int = 48, with_text: bool = False, block: int = 1 << 20, bits: int = 64) -> DataFrame:
    """All columns of docs (doc_id and text among them), with _n_bytes, _n_removed, _n_spans, _kept_sha256 and, if asked, _kept.

    _kept is what is left as text; a character that lost some of its bytes is left out.
    """
    found = repeated(spark, docs, length, gram, block, bits)
    joined = _keyed(docs).join(found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("at").alias("_at")).hint("merge"), ["_k1", "_k2"], "left").drop("_k1", "_k2")
    plain = docs.schema.names

    def run(batches):
        for batch in batches:
            for k in range(0, max(1, batch.num_rows), 500):
                part = batch.slice(k, 500)
                got: list[list] = [[], [], [], [], []]
                for text, at in zip(part.column("text"), part.column("_at")):
                    raw = (text.as_py() or "").encode()
                    gone = spans(at.as_py(), length)
                    kept = cut(raw, gone) if gone else raw
                    values = (len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None)
                    for x, v in zip(got, values):
                        x.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in plain), *(pa.array(x, t) for x, t in zip(got, kinds))], names=[*plain, *RESULTS])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "_n_bytes long, _n_removed long, _n_spans long, _kept_sha256 string, _kept string"])
    return joined.mapInArrow(run, fields)


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return mark(spark, docs).select("doc_id", *(F.col(f"_{n}").alias(n) for n in names))
