"""Benchmark decontamination: word n-gram seeds, then Smith-Waterman alignment.

Texts and test items are sequences of lower-cased words (letters and digits).  Seeds are
the items' word n-grams (an item of fewer words is one seed).  Every seed found in a document
counts, however frequent it is: which ones an edit destroyed differs from copy to copy, so
no choice made over the corpus can tell which of them a copy still holds.
An item is aligned with the windows of a document around the seeds they share, by local
alignment (match 2, mismatch -1, gap -1); the score is a share of a perfect match.
Items of which the document, and then the window, holds too few words to pass are not
aligned; that loses nothing and is what keeps frequent seeds cheap.

Items are taken in chunks of at most ``chunk`` bytes, one broadcast for each, so what is
broadcast is bounded however large the benchmark is; texts are read once for all chunks.

Cases.  Null or empty texts and items: no words, no leak.  Repeated items are each
reported; of rows that share an item_id each counts.  Null item_id is reported as null.
Repeated documents are each reported.  Long texts are aligned in windows only.  Empty
benchmark: no leaks.  Columns of docs are carried, whatever their names, but for _leaks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bytesops import combine, mix, slices, words_of
from .toxicity import _is_letter

_U = np.uint64


def _words(column) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and the offsets of rows in them."""
    h, _, n = words_of(pc.utf8_lower(column.cast(pa.large_string())), _is_letter)
    return h, np.r_[0, np.cumsum(n)]


def grams(w: np.ndarray, n: int) -> np.ndarray:
    if not len(w):
        return w
    if len(w) < n:
        return mix(combine([w[k : k + 1] for k in range(len(w))]) + _U(len(w)))
    return combine([w[k : len(w) - n + 1 + k] for k in range(n)])


class Items:
    """A chunk of test items: their words, and which item and place each seed is from."""

    def __init__(self, ids: list, words: list[np.ndarray], n: int):
        self.ids, self.words, self.n = ids, words, n
        own = [grams(w, n) for w in words]
        seed = np.concatenate([*own, np.zeros(0, _U)])
        self.seeds, at = np.unique(seed, return_inverse=True)
        item = np.repeat(np.arange(len(own)), [len(x) for x in own])
        place = np.concatenate([*(np.arange(len(x)) for x in own), np.zeros(0, np.int64)])
        order = np.argsort(at, kind="stable")
        self.item, self.place, self.first = item[order], place[order], np.r_[0, np.cumsum(np.bincount(at, minlength=len(self.seeds)))]
        self.short = sorted({len(w) for w in words if 0 < len(w) < n})
        self.size = np.array([len(w) for w in words], np.int64)
        self.begin = np.r_[0, np.cumsum(self.size)]
        self.vocabulary, self.word = np.unique(np.concatenate([*words, np.zeros(0, _U)]), return_inverse=True)

    def may_pass(self, w: np.ndarray, item: np.ndarray, least: float) -> np.ndarray:
        """Those of ``item`` of whose words a text holds enough for an alignment to pass."""
        at = np.minimum(np.searchsorted(self.vocabulary, w), len(self.vocabulary) - 1)
        held = np.zeros(len(self.vocabulary), bool)
        held[at[self.vocabulary[at] == w]] = True
        n = self.size[item]
        first = np.cumsum(n) - n
        word = np.repeat(self.begin[item] - first, n) + np.arange(n.sum())
        return item[np.add.reduceat(held[self.word[word]].astype(np.int64), first) >= least * n]

    def find(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a text's words, and the seed found at each."""
        places, found = [], []
        if not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        for n in [self.n, *self.short]:
            if len(w) < n:
                continue
            g = combine([w[k : len(w) - n + 1 + k] for k in range(n)])
            if n < self.n:
                g = mix(g + _U(n))
            at = np.minimum(np.searchsorted(self.seeds, g), len(self.seeds) - 1)
            hit = np.flatnonzero(self.seeds[at] == g)
            places.append(hit)
            found.append(at[hit])
        return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def align(a: np.ndarray, b: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = 1) -> tuple[int, int, int]:
    """Best local alignment score of a and b, and where in a and in b it ends (exclusive; the first of equal ones)."""
    h, best, end_a, end_b = np.zeros(len(b) + 1, np.int64), 0, 0, 0
    slope = gap * np.arange(len(b) + 1)
    for i, x in enumerate(a):
        new = np.maximum(h - gap, 0)
        new[1:] = np.maximum(new[1:], h[:-1] + np.where(b == x, match, mismatch))
        h = np.maximum.accumulate(new + slope) - slope  # gaps along b
        k = int(h.argmax())
        if h[k] > best:
            best, end_a, end_b = int(h[k]), i + 1, k
    return best, end_a, end_b


def located(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of a and b, and where in b it starts and ends: the start is where it ends when both are read backwards."""
    best, end_a, end_b = align(a, b)
    return best, end_b - align(a[:end_a][::-1], b[:end_b][::-1])[2], end_b


def leaks(w: np.ndarray, items: Items, least: float) -> list[dict]:
    """The best alignment with each item that passes, by item."""
    places, found = items.find(w)
    if not len(places):
        return []
    n = items.first[found + 1] - items.first[found]
    posting = np.repeat(items.first[found] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    at = np.repeat(places, n)
    item, begin = items.item[posting], at - items.place[posting]
    order = np.lexsort((begin, item))
    item, begin = item[order], begin[order]
    out = []
    for i in items.may_pass(w, np.unique(item), least):
        own = items.words[i]
        m, slack = len(own), len(items.words[i]) // 4 + 5
        best = (0, 0, 0)
        mine = begin[np.searchsorted(item, i) : np.searchsorted(item, i, side="right")]
        runs = np.split(mine, np.flatnonzero(np.diff(mine) > m + 2 * slack) + 1)
        for run in runs:
            a, b = max(0, int(run[0]) - slack), min(len(w), int(run[-1]) + m + slack)
            if np.isin(own, w[a:b]).sum() < least * m:
                continue
            score, _, _ = align(own, w[a:b])
            if score > best[0]:
                best = (score, a, b)
        if best[0] >= least * 2 * m:
            score, start, end = located(own, w[best[1] : best[2]])
            out.append({"item_id": items.ids[i], "score": score / (2 * m), "word_start": best[1] + start, "word_end": best[1] + end})
    return out


def _chunks(bench: DataFrame, n: int, chunk: int):
    """Items of at most ``chunk`` bytes at a time (one longer item is a chunk of its own)."""
    ids, texts, size = [], [], 0
    for r in bench.select("item_id", "text").toLocalIterator():
        text = r.text or ""
        if ids and size + len(text) > chunk:
            yield _items(ids, texts, n)
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(text)
        size += len(text)
    if ids:
        yield _items(ids, texts, n)


def _items(ids: list, texts: list[str], n: int) -> Items:
    h, off = _words(pa.array(texts, pa.string()))
    return Items(ids, [h[a:b] for a, b in zip(off, off[1:])], n)


LEAK = "array<struct<item_id:{kind},score:double,word_start:int,word_end:int>>"


def mark(spark: SparkSession, docs: DataFrame, bench: DataFrame, n: int = 3, least: float = 0.5, chunk: int = 8 << 20) -> DataFrame:
    """All columns of docs and _leaks: item_id, score (share of a perfect match), word_start, word_end of each item found."""
    kind = bench.schema["item_id"].dataType.simpleString()
    out = docs.drop("_leaks")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    typed = LEAK.format(kind=kind)
    out = out.withColumn("_leaks", F.lit(None).cast(typed))
    for items in _chunks(bench, n, chunk):
        sent = spark.sparkContext.broadcast(items)

        def find(batches, sent=sent):
            for batch in batches:
                for part in slices(batch, "text"):
                    h, off = _words(part.column("text"))
                    found = [(old or []) + leaks(h[a:b], sent.value, least) for old, a, b in zip(part.column("_leaks").to_pylist(), off, off[1:])]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "_leaks"), pa.array(found, part.schema.field("_leaks").type)], names=[c for c in part.schema.names if c != "_leaks"] + ["_leaks"])

        out = out.mapInArrow(find, f"{fields}, _leaks {typed}")
    return out


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = mark(spark, docs, common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("_leaks").alias("x")).select("doc_id", "x.*")
