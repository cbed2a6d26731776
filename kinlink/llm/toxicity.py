"""Toxicity by multiple-instance learning: sentences are instances, documents are bags.

A sentence's probability is a logistic of its words' weights; a document's is the
noisy-or 1 - prod(1 - p).  Only document labels are seen in training: the gradient of the
noisy-or divides the blame among sentences, so the model can then name the offending
sentence.  Training adds a leak (a document may be labelled without any sentence to blame)
and an L1 penalty, so that noise in labels doesn't settle on common words; weights of words
are not negative, so no neighbour excuses an offending word.

Fitting takes a bounded sample of ``sample`` labelled rows (in hash order of doc_id) and, of
their words (30-bit hashes), at most ``most`` that are in the most documents; scoring covers
whole texts of all rows, and what is broadcast are the words of positive weight, 12 bytes each.

Cases.  Null or empty text: no sentence, score 0.  Null doc_id: scored, not held out.
Several labels of one doc_id: the largest counts.  Null labels are not learned from.
Repeated rows: each is scored.  No usable labels: all weights 0, and the bias gives
scores near 0.  Extra columns are ignored.  Texts of any length are worked through in pieces,
sentences of any length are whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bytesops import buffer_of, lower_ascii, prefix_hash, span_hash, word_spans

BITS = 30
START_BIAS = -7.0


def _is_letter(raw: np.ndarray) -> np.ndarray:
    return ((raw >= 97) & (raw <= 122)) | (raw >= 128) | ((raw >= 65) & (raw <= 90)) | ((raw >= 48) & (raw <= 57))


def _stops(low: np.ndarray) -> np.ndarray:
    return np.flatnonzero((low == 46) | (low == 33) | (low == 63) | (low == 10))


def _pieces(raw: np.ndarray, size: int):
    """Parts of about ``size`` bytes, none of which ends within a word: (first byte, part)."""
    a = 0
    while a < len(raw):
        b = min(len(raw), a + size)
        gaps = np.flatnonzero(~_is_letter(raw[a:b])) if b < len(raw) else []
        if len(gaps):
            b = a + int(gaps[-1]) + 1
        else:
            while b < len(raw):  # a word longer than that: on to its end
                c = min(len(raw), b + size)
                gaps = np.flatnonzero(~_is_letter(raw[b:c]))
                b = b + int(gaps[0]) + 1 if len(gaps) else c
                if len(gaps):
                    break
        yield a, raw[a:b]
        a = b


def sentences(raw: np.ndarray, bits: int = BITS, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (feature, sentence) pairs, by sentence, and starts and ends (bytes) of sentences with words.

    Long texts are worked through in pieces; a sentence goes on from one piece to the next.
    """
    z = np.zeros(0, np.int64)
    pairs, starts, ends = [z], [z], [z]
    count, open_ = 0, False  # sentences so far; whether the last one goes on
    for at, part in _pieces(raw, piece):
        low = lower_ascii(part)
        s, e, _ = word_spans(low, np.array([0, len(low)]), _is_letter(low))
        stops = _stops(low)
        if not len(s):
            open_ = open_ and not len(stops)
            continue
        feature = (span_hash(prefix_hash(low), s, e) >> np.uint64(64 - bits)).astype(np.int64)
        number = np.searchsorted(stops, s)
        new = np.r_[True, number[1:] != number[:-1]]
        first = np.flatnonzero(new)
        goes_on = open_ and number[0] == 0
        pairs.append(np.unique(((np.cumsum(new) - 1 + count - goes_on) << bits) | feature))  # a word repeated in a sentence says no more
        own_ends = e[np.r_[first[1:] - 1, len(s) - 1]] + at
        if goes_on:
            ends[-1][-1] = own_ends[0]
        starts.append(s[first][int(goes_on) :] + at)
        ends.append(own_ends[int(goes_on) :])
        if not len(ends[-1]):
            ends.pop()
        count += len(first) - goes_on
        open_ = not len(stops) or stops[-1] < s[-1]
    found = np.concatenate(pairs)
    if len(pairs) > 2:
        found = np.unique(found)
    return found & ((1 << bits) - 1), found >> bits, np.concatenate(starts), np.concatenate(ends)


def _featurise(batches):
    for batch in batches:
        raw, off = buffer_of(batch.column("text"))
        feats, lens = [], []
        for i in range(batch.num_rows):
            f, n, _, _ = sentences(raw[off[i] : off[i + 1]])
            feats.append(f.astype(np.int32).tobytes())
            lens.append(np.bincount(n).astype(np.int32).tobytes() if len(n) else b"")
        yield pa.RecordBatch.from_arrays([batch.column("y").cast(pa.int32()), pa.array(feats, pa.binary()), pa.array(lens, pa.binary())], names=["y", "f", "n"])


Weights = tuple[np.ndarray, np.ndarray, float]


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], rounds: int = 120, leak: float = 0.03, l1: float = 0.02, least: int = 3, most: int = 1 << 18) -> Weights:
    """Sorted words of positive weight, their weights, and the bias, from (label, words, words in each sentence) of documents."""
    bags = [b for b in bags if len(b[2])]
    if not bags or len({b[0] for b in bags}) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), START_BIAS
    y = np.array([b[0] for b in bags], float)
    feature = np.concatenate([b[1] for b in bags]).astype(np.int64)
    words = np.concatenate([b[2] for b in bags]).astype(np.int64)
    bag_of = np.repeat(np.arange(len(bags)), [len(b[2]) for b in bags])
    sentence_of = np.repeat(np.arange(len(words)), words)
    # words of fewer than `least` documents stay at 0
    vocabulary, feature = np.unique(feature, return_inverse=True)
    pairs = np.unique(bag_of[sentence_of] * len(vocabulary) + feature)
    of_doc, of_word = pairs // len(vocabulary), pairs % len(vocabulary)
    df = np.bincount(of_word, minlength=len(vocabulary))
    known = np.flatnonzero(df >= least)
    known = np.sort(known[np.argsort(-df[known], kind="stable")[:most]])
    local = np.full(len(vocabulary), -1, np.int64)
    local[known] = np.arange(len(known))
    use = local[feature] >= 0
    f, s = local[feature[use]], sentence_of[use]
    # start at the smoothed log-odds of a word's documents where the word speaks clearly
    d1 = np.bincount(of_word[y[of_doc] > 0], minlength=len(vocabulary))[known]
    d0 = df[known] - d1
    odds = np.log((d1 + 0.5) / (y.sum() + 1)) - np.log((d0 + 0.5) / ((1 - y).sum() + 1))
    v = np.where(odds > 2, np.minimum(odds, 8) + 2, 0.0)
    b = START_BIAS
    m, u, mb, ub = np.zeros_like(v), np.zeros_like(v), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.clip(b + np.bincount(s, v[f], minlength=len(words)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        a = np.bincount(bag_of, np.logaddexp(0, z), minlength=len(bags))
        clean = (1 - leak) * np.exp(-a)
        g = np.where(y > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0)[bag_of] * p
        gv, gb = np.bincount(f, g[s], minlength=len(known)), g.sum()
        m, u = 0.9 * m + 0.1 * gv, 0.99 * u + 0.01 * gv * gv
        mb, ub = 0.9 * mb + 0.1 * gb, 0.99 * ub + 0.01 * gb * gb
        rate = 0.15 / (1 + t / 40)
        # gradients are sums over documents, so 1 in the denominator holds still what little speaks for
        v = v - rate * (m / (1 - 0.9**t)) / (np.sqrt(u / (1 - 0.99**t)) + 1)
        v = np.maximum(v - rate * l1, 0)  # words accuse or say nothing: none excuses its neighbours
        b = float(np.clip(b - rate * (mb / (1 - 0.9**t)) / (np.sqrt(ub / (1 - 0.99**t)) + 1), -10, -5))
    keep = v > 0
    return vocabulary[known[keep]], v[keep].astype(np.float32), b


def score_text(raw: np.ndarray, w: Weights) -> tuple[float, int, float, int, int]:
    """Noisy-or of all sentences, their number, and the worst one's probability, start and end (bytes)."""
    words, weight, bias = w
    f, n, s, e = sentences(raw)
    if not len(s):
        return 0.0, 0, 0.0, 0, 0
    z = np.full(len(s), bias)
    if len(words):
        at_word = np.minimum(np.searchsorted(words, f), len(words) - 1)
        z += np.bincount(n, np.where(words[at_word] == f, weight[at_word], 0), minlength=len(s))
    z = np.clip(z, -30, 30)
    k = int(z.argmax())
    return float(-np.expm1(-np.logaddexp(0, z).sum())), len(s), float(1 / (1 + np.exp(-z[k]))), int(s[k]), int(e[k])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, may_learn: Column, sample: int = 8000, seed: int = 11) -> Weights:
    """Weights from at most ``sample`` rows of labels that ``may_learn`` (a column of doc_id) allows."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & may_learn).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    chosen = own.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).collect()
    if not chosen:
        return train([])
    few = F.broadcast(spark.createDataFrame([(r.doc_id, int(r.y)) for r in chosen], "doc_id long, y int"))  # bounded by `sample`
    bags = docs.select("doc_id", "text").join(few, "doc_id").select("y", "text").mapInArrow(_featurise, "y int, f binary, n binary")
    # one task trains on the bounded sample, so that the driver holds weights only
    got = bags.groupBy(F.lit(1).alias("all")).applyInArrow(_train_table, "words binary, weights binary, bias double").first()
    return (np.frombuffer(got.words, np.int64), np.frombuffer(got.weights, np.float32), got.bias) if got else train([])


def _train_table(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table["y"].to_pylist(), table["f"].to_pylist(), table["n"].to_pylist()))
    words, weights, bias = train([(y, np.frombuffer(f, np.int32), np.frombuffer(n, np.int32)) for y, f, n in rows])
    return pa.table({"words": [words.astype(np.int64).tobytes()], "weights": [weights.tobytes()], "bias": [float(bias)]})


def score(spark: SparkSession, docs: DataFrame, weights: Weights, threshold: float = 0.7) -> DataFrame:
    """All columns of docs, with score, predicted, n_sentences, worst_score, worst_start, worst_end (bytes)."""
    w = spark.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            raw, off = buffer_of(batch.column("text"))
            got = [score_text(raw[off[i] : off[i + 1]], w.value) for i in range(batch.num_rows)]
            new = list(zip(*got)) if got else [[]] * 5
            p = np.array(new[0], float)
            kinds = (pa.float64(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32)), *(pa.array(x, k) for x, k in zip(new[1:], kinds[1:]))], names=[*batch.schema.names, *NEW])

    plain = docs.drop(*NEW)
    return plain.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), "score double, predicted int, n_sentences int, worst_score double, worst_start long, worst_end long"]))


NEW = ("score", "predicted", "n_sentences", "worst_score", "worst_start", "worst_end")


def fold(mod: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    weights = fit(spark, docs, labels, fold(3) != 1)
    rows = score(spark, docs.select("doc_id", "text"), weights)
    return rows.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "n_sentences", "worst_score", "worst_start", "worst_end")
