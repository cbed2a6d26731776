"""Quality by hierarchical empirical Bayes.

A logistic model of a document's own features (repetition, shouting, symbols, length, ...)
gives its evidence.  Hosts, and ever longer prefixes of paths on them, have posteriors of their
own: the mean of their documents' evidence, shrunk to that of the prefix one shorter, which
for the host is the global mean.  How much a level is shrunk is estimated from the data: the
pseudo-count is the ratio of the variance within groups to the variance between them (method
of moments).  A document's log-odds and those of its longest prefix are added, less the global
log-odds counted twice.

The query scores every page, by its main text and its address, and every document; documents
have no address, so their source stands for the host and their language for the path.

Fitting takes a bounded sample of ``sample`` labelled rows; group statistics cover all rows
and are made by pre-aggregated sums.

Cases.  Null or empty text: features 0, scored like any other.  Null or malformed address: no
host and no path, a group of its own at each level.  Null doc_id: scored.  Several labels of a
doc_id: the largest counts.  No usable labels: evidence 1/2 for all.  Repeated rows count and
are scored each.  Empty table: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import operator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bytesops import buffer_of, combine, lower_ascii, prefix_hash, span_hash, slices, word_spans

N_FEATURES = 14


def distinct_share(w: np.ndarray, window: int = 200) -> float:
    """Mean share of distinct words over all runs of ``window`` words (fewer words: over all of them)."""
    k, m = len(w), min(len(w), window)
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    before = np.full(k, -1)  # where each word was last
    before[order[1:][same]] = order[:-1][same]
    at = np.arange(k)
    # a place counts in the runs that hold it but not the one before
    runs = np.minimum(at, k - m) - np.maximum(np.maximum(0, at - m + 1), before + 1) + 1
    return float(np.maximum(runs, 0).sum() / ((k - m + 1) * m))


def features(raw: np.ndarray) -> np.ndarray:
    """Shape of one text, from its bytes."""
    out = np.zeros(N_FEATURES)
    n = len(raw)
    if not n:
        return out
    low = lower_ascii(raw)
    s, e, _ = word_spans(low, np.array([0, n]))
    k = len(s)
    if not k:
        return out
    w = span_hash(prefix_hash(low), s, e)
    _, count = np.unique(w, return_counts=True)
    upper, digit = (raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57)
    letter = ((low >= 97) & (low <= 122)) | (raw >= 128)
    mark = ~letter & ~digit & (raw > 32)
    lines = np.flatnonzero(raw == 10)
    spans = np.r_[0, lines + 1], np.r_[lines, n]
    full = spans[1] > spans[0]
    line = span_hash(prefix_hash(raw), spans[0][full], spans[1][full])
    pairs = combine([w[:-1], w[1:]]) if k > 1 else w
    out[:] = (
        np.log1p(k), n / k, upper.sum() / n, mark.sum() / n, digit.sum() / n, distinct_share(w), count.max() / k, 1 - len(np.unique(line)) / max(1, len(line)),
        (raw == 33).sum() / k, (w[1:] == w[:-1]).mean() if k > 1 else 0, 1 - len(np.unique(pairs)) / len(pairs), ((raw == 124) | (raw == 123) | (raw == 60) | (raw == 35) | (raw == 95) | (raw == 61)).sum() / n, np.log1p(n / max(1, len(line))), (count == 1).sum() / k,
    )
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> dict:
    """Logistic regression on standardised features, their squares and products (iterated weighted least squares)."""
    if len(y) < 2 or len(np.unique(y)) < 2:
        return {"w": None, "base": 0.5}
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = expand((x - mean) / sd)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        r = np.maximum(p * (1 - p), 1e-4)
        step = np.linalg.solve((z * r[:, None]).T @ z + ridge * np.eye(z.shape[1]), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return {"w": w, "mean": mean, "sd": sd, "base": float(y.mean())}


def expand(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    i, j = np.triu_indices(z.shape[1])
    return np.hstack([np.ones((len(z), 1)), z, z[:, i] * z[:, j]])


def evidence(x: np.ndarray, model: dict) -> np.ndarray:
    if model["w"] is None:
        return np.full(len(x), model["base"])
    p = 1 / (1 + np.exp(-np.clip(expand((x - model["mean"]) / model["sd"]) @ model["w"], -30, 30)))
    return np.clip(p, 1e-4, 1 - 1e-4)


def _matrix(part: pa.RecordBatch) -> np.ndarray:
    raw, off = buffer_of(part.column("text"))
    return np.stack([features(raw[a:b]) for a, b in zip(off, off[1:])]) if part.num_rows else np.zeros((0, N_FEATURES))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, may_learn: Column, sample: int = 8000, seed: int = 13) -> dict:
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & may_learn).groupBy("doc_id").agg(F.max("quality").alias("y"))
    chosen = own.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).collect()
    if not chosen:
        return train(np.zeros((0, N_FEATURES)), np.zeros(0))
    few = F.broadcast(spark.createDataFrame([(r.doc_id, int(r.y)) for r in chosen], "doc_id long, y int"))  # bounded by `sample`

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(_matrix(batch)), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = sorted(docs.select("doc_id", "text").join(few, "doc_id").mapInArrow(run, "doc_id long, y int, x array<double>").collect(), key=lambda r: (r.doc_id, r.x))
    return train(np.array([r.x for r in got]).reshape(-1, N_FEATURES), np.array([r.y for r in got], float))


def shrink(sums: DataFrame, keys: list[str], parent: Column, most: float = 1e4) -> DataFrame:
    """Adds ``mean`` of groups (n, s, ss), shrunk to ``parent`` by a pseudo-count estimated from all groups."""
    mean = F.col("s") / F.col("n")
    within = F.sum(F.col("ss") - F.col("s") * mean) / F.greatest(F.sum("n") - F.count(F.lit(1)), F.lit(1))
    between = F.sum(F.col("n") * (mean - parent) * (mean - parent)) / F.sum("n")
    k = sums.agg(within.alias("w"), between.alias("b")).select(F.least(F.lit(most), F.greatest(F.lit(1.0), F.coalesce(F.col("w") / F.when(F.col("b") > 0, F.col("b")), F.lit(most)))).alias("k"))
    return sums.join(F.broadcast(k), how="cross").withColumn("mean", (F.col("s") + F.col("k") * parent) / (F.col("n") + F.col("k"))).drop("k")  # k is one row


def posterior(spark: SparkSession, docs: DataFrame, model: dict, *levels: str, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """``keep``, evidence, means (of each level, the widest first), score, kept of every row; ``levels`` are columns, each a part of the one before."""
    sent = spark.sparkContext.broadcast(model)
    own = [f"_l{i}" for i in range(len(levels))]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*keep, *own)), pa.array(evidence(_matrix(part), sent.value))], names=[*keep, *own, "evidence"])

    rows = docs.select(*keep, *(F.col(c).cast("string").alias(x) for c, x in zip(levels, own)), "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    rows = common.stage(spark, rows.mapInArrow(run, f"{kinds}, evidence double"), "quality-rows")
    total = rows.agg(F.avg("evidence")).first()[0]
    base = float(total) if total is not None else 0.5
    sums = (F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") * F.col("evidence")).alias("ss"))
    above, out = None, rows
    for i in range(len(own)):
        keys = own[: i + 1]
        same = lambda names: reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names))
        groups = rows.groupBy(*keys).agg(*sums)
        parent = F.lit(base)
        if above is not None:
            groups, parent = groups.join(above, same(keys[:-1])).drop(*(f"_{c}" for c in keys[:-1])), F.element_at("means", -1)
        groups = shrink(groups, keys, parent)
        means = F.array("mean") if above is None else F.concat("means", F.array("mean"))
        above = groups.select(*(F.col(c).alias(f"_{c}") for c in keys), means.alias("means"))
    out = rows.join(above, same(own))
    logit = lambda p: F.log(p / (1 - p))
    z = logit(F.col("evidence")) + logit(F.element_at("means", -1)) - F.log(F.lit(base) / (1 - F.lit(base)))
    return out.withColumn("score", 1 / (1 + F.exp(-z))).select(*keep, "evidence", "means", "score", (F.col("score") >= threshold).alias("kept"))


def address(url: Column) -> list[Column]:
    """Host, and its paths of one and of two parts (null where there are none)."""
    some = lambda c: F.when(c != "", c)
    host = some(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)))
    path = F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1), "/"), lambda x: x != "")
    return [host, *(F.when(F.size(path) >= n, F.array_join(F.slice(path, 1, n), "/")) for n in (1, 2))]


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_extract
    from .toxicity import fold

    docs, labels, pages = (common.table(spark, sf_dir, t) for t in ("documents", "labels", "pages"))
    model = fit(spark, docs, labels, fold(3) != 1)
    pages = pages.select("page_id", "url", "html")
    texts = html_extract.extract_pages(spark, pages, html_extract.fit(pages))
    null = lambda kind: F.lit(None).cast(kind)
    host, one, two = address(F.col("url"))
    rows = docs.select("doc_id", null("long").alias("page_id"), "text", F.col("source").cast("string").alias("host"), F.col("lang").cast("string").alias("one"), null("string").alias("two"))
    rows = rows.unionByName(texts.select(null("long").alias("doc_id"), "page_id", "text", host.alias("host"), one.alias("one"), two.alias("two")))
    rows = rows.withColumn("site", F.concat(F.when(F.col("page_id").isNull(), "source ").otherwise("host "), F.coalesce("host", F.lit(""))))
    return posterior(spark, rows, model, "site", "one", "two", keep=("doc_id", "page_id"))
