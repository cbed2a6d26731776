"""Exact top-k inner-product search over a bit-sliced index.

Every vector becomes integers floor(scale * x).  The index keeps, per block of rows
and per dimension, the bit slices of (value - block minimum): bitmap b holds bit b of
every row.  A query's scores are built as bit slices too: the slices of a dimension are
added once for each set bit of the query's component, with carry-save full adders on
whole bitmaps (negative components take the complement).  Rows are then selected from
the most significant score slice downward; rows that tie at the boundary are resolved
by vec_id, and scores are read back exactly from the slices.

Queries meet the index in blocks: (chunk of queries) x (block of rows), laid in a grid of
groups of chunks x groups of blocks, one task for each cell.  A task keeps the best k of a query
over the blocks of its cell, so k rows a query and group of blocks are merged; both sides are
copied about as often as the square root of the number of tasks.

Cases.  A vector that is null, or holds a null or non-finite component, takes no part as
query or candidate.  Null vec_id takes no part.  Repeated vec_id: every row takes part, as a
query and as a candidate of all rows but itself.  Empty vectors score 0.  Shorter vectors count
as padded with zeros.  Components of any size count in full; one that, or a chosen score that,
does not fit a long is an error.  Ties go to the smaller vec_id.  Fewer
than k candidates: all are returned.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

_U = np.uint64
_FULL = _U(0xFFFFFFFFFFFFFFFF)


def quantise(vectors: DataFrame, scale: float) -> DataFrame:
    """(row, vec_id, q array<long>) of the vectors that take part; row tells them apart once staged."""
    x = F.col("embedding")
    good = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))

    def level(v):
        y = F.lit(float(scale)) * v.cast("double")
        wide = (y >= F.lit(2.0**63)) | (y < F.lit(-(2.0**63)))
        return F.when(wide, F.raise_error(F.lit("top-k: a quantised component does not fit a long")).cast("long")).otherwise(F.floor(y).cast("long"))

    rows = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).select("vec_id", F.transform(x, level).alias("q"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "q")


def _dense(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    off = np.asarray(column.offsets)
    off, values = off - off[0], np.asarray(column.values)[off[0] : off[-1]]
    n = np.diff(off)
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None] < n[:, None]] = values
    return out


def pack_block(t: pa.Table) -> pa.Table:
    """One row: the bit-sliced index of a block's rows, in order of vec_id."""
    t = t.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    x = _dense(t["q"])
    n, d = x.shape
    lo = x.min(axis=0) if n else np.zeros(d, np.int64)
    y = x.view(_U) - lo.view(_U)  # exact: a difference of longs is below 2**64
    bits = int(y.max(initial=0)).bit_length()
    pad = -n % 64
    slices = np.zeros((d, bits, (n + pad) // 64), _U)
    for b in range(bits):
        one = np.zeros((d, n + pad), np.uint8)
        one[:, :n] = ((y >> _U(b)) & _U(1)).T
        slices[:, b] = np.packbits(one, axis=1, bitorder="little").view(_U)
    return pa.table({"block": t["block"][:1], "n": pa.array([n], pa.int32()), "d": pa.array([d], pa.int32()), "bits": pa.array([bits], pa.int32()), "ids": [np.asarray(t["vec_id"]).astype(np.int64).tobytes()], "own": [np.asarray(t["row"]).astype(np.int64).tobytes()], "lo": [lo.tobytes()], "slices": [slices.tobytes()]})


def pack_queries(t: pa.Table) -> pa.Table:
    x = _dense(t["q"])
    return pa.table({"chunk": t["chunk"][:1], "qd": pa.array([x.shape[1]], pa.int32()), "qids": [np.asarray(t["vec_id"]).astype(np.int64).tobytes()], "qrows": [np.asarray(t["row"]).astype(np.int64).tobytes()], "qs": [np.ascontiguousarray(x).tobytes()]})


def magnitude(q: np.ndarray) -> np.ndarray:
    return np.where(q < 0, _U(0) - q.view(_U), q.view(_U))


def score_slices(slices: np.ndarray, q: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit slices (each queries x words) of non-negative scores, and each query's offset to the true score less q.lo, modulo 2**64."""
    d, bits, words = slices.shape
    neg = q < 0
    size = magnitude(q)
    pending: list[list[np.ndarray]] = []

    def add(x, w):
        while True:
            while len(pending) <= w:
                pending.append([])
            p = pending[w]
            p.append(x)
            if len(p) < 3:
                return
            a, b, c = p
            ab = a ^ b
            pending[w] = [ab ^ c]
            x, w = (a & b) | (c & ab), w + 1

    for k in range(d):
        flip = np.where(neg[:, k], _FULL, _U(0))[:, None]
        own = [slices[k, b][None] ^ flip for b in range(bits)]
        for t in range(int(size[:, k].max(initial=0)).bit_length()):
            has = np.where((size[:, k] >> _U(t)) & _U(1), _FULL, _U(0))[:, None]
            if has.any():
                for b in range(bits):
                    add(own[b] & has, t + b)
    w = 0
    while w < len(pending):
        while len(pending[w]) > 1:
            a, b = pending[w].pop(), pending[w].pop()
            pending[w].append(a ^ b)
            add(a & b, w + 1)
        w += 1
    zero = np.zeros((len(q), words), _U)
    return [p[0] if p else zero for p in pending], (_U(0) - (size * neg).sum(axis=1, dtype=_U) * _U((1 << bits) - 1)).view(np.int64)


def select_top(score: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """Bitmaps of the k best rows of each query, boundary ties to the lower rows."""
    sure, edge = np.zeros_like(valid), valid.copy()
    for s in reversed(score):
        x = sure | (edge & s)
        n = np.bitwise_count(x).sum(axis=1)[:, None]
        sure = np.where(n > k, sure, x)
        edge = np.where(n > k, edge & s, np.where(n < k, edge & ~s, _U(0)))
    tied = np.unpackbits(edge.view(np.uint8), axis=1, bitorder="little").astype(np.int32)
    want = k - np.bitwise_count(sure).sum(axis=1)[:, None]
    tied &= np.cumsum(tied, axis=1) <= want
    return sure | np.packbits(tied.astype(np.uint8), axis=1, bitorder="little").view(_U)


def check_scores(score: list[np.ndarray], q: np.ndarray, lo: np.ndarray, bits: int, qi: np.ndarray, ri: np.ndarray) -> None:
    """An error if a chosen score does not fit a long; exact sums are made only for queries where that may be."""
    bound = magnitude(q).astype(float) @ (magnitude(lo).astype(float) + 2.0**bits)
    risky = np.flatnonzero(bound >= 2.0**62)
    at = np.isin(qi, risky)
    qi, ri = qi[at], ri[at]
    if not len(qi):
        return
    base = {i: sum(a * b for a, b in zip(q[i].tolist(), lo.tolist())) + ((1 << bits) - 1) * sum(min(a, 0) for a in q[i].tolist()) for i in risky.tolist()}
    value = np.array([base[i] for i in qi.tolist()], object)
    for w, s in enumerate(score):
        value = value + ((s[qi, ri // 64] >> (ri % 64).astype(_U)) & _U(1)).astype(object) * (1 << w)
    if value.max() >= 1 << 63 or value.min() < -(1 << 63):
        raise OverflowError("top-k: a score does not fit a long")


def top_of_block(row: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, vec_id, score) of the k best of one block for each query of a chunk."""
    n, d, bits, qd = row["n"], row["d"], row["bits"], row["qd"]
    ids, own_rows, qrows = (np.frombuffer(row[c], np.int64) for c in ("ids", "own", "qrows"))
    lo = np.frombuffer(row["lo"], np.int64)
    q = np.frombuffer(row["qs"], np.int64).reshape(len(qrows), qd)
    both = min(d, qd)
    words = (n + 63) // 64
    slices = np.frombuffer(row["slices"], _U).reshape(d, bits, words)[:both]
    q, lo = np.ascontiguousarray(q[:, :both]), lo[:both]
    score, base = score_slices(slices, q)
    base = base + q @ lo
    valid = np.zeros(words * 64, np.uint8)
    valid[:n] = 1
    valid = np.repeat(np.packbits(valid, bitorder="little").view(_U)[None], len(qrows), axis=0)
    if n:
        order = np.argsort(own_rows)
        at = order[np.minimum(np.searchsorted(own_rows, qrows, sorter=order), n - 1)]
        own = np.flatnonzero(own_rows[at] == qrows)
        valid[own, at[own] // 64] &= ~(_U(1) << (at[own] % 64).astype(_U))
    best = select_top(score, valid, k)
    qi, ri = np.nonzero(np.unpackbits(best.view(np.uint8), axis=1, bitorder="little"))
    check_scores(score, q, lo, bits, qi, ri)
    value = base[qi]
    for w, s in enumerate(score[:64]):  # higher slices are 0 modulo 2**64
        value = value + (((s[qi, ri // 64] >> (ri % 64).astype(_U)) & _U(1)) << _U(w)).view(np.int64)
    return qi, ids[ri], value


def _search(k: int):
    def run(batches):
        held = None  # chunk, its query rows and ids, best so far

        def out():
            (qrows, qids), (qi, vid, sc) = held[1], held[2]
            return pa.RecordBatch.from_arrays([pa.array(qrows[qi]), pa.array(qids[qi]), pa.array(vid), pa.array(sc)], names=["query_row", "query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                found = top_of_block(row, k)
                if held is None or held[0] != row["chunk"]:
                    if held is not None:
                        yield out()
                    held = (row["chunk"], [np.frombuffer(row[c], np.int64) for c in ("qrows", "qids")], found)
                    continue
                qi, vid, sc = (np.concatenate(x) for x in zip(held[2], found))
                order = np.lexsort((vid, ~sc, qi))
                qi, vid, sc = qi[order], vid[order], sc[order]
                first = np.r_[0, np.flatnonzero(np.diff(qi)) + 1] if len(qi) else np.zeros(0, np.int64)
                rank = np.arange(len(qi)) - np.repeat(first, np.diff(np.r_[first, len(qi)]))
                held = (held[0], held[1], (qi[rank < k], vid[rank < k], sc[rank < k]))
        if held is not None:
            yield out()

    return run


def search(spark: SparkSession, vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, block_rows: int = 1024, chunk_queries: int = 128) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of every query row."""
    rows = common.stage(spark, quantise(vectors, scale), "topk-rows")
    n, nq = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    blocks, chunks = -(-n // block_rows) or 1, -(-nq // chunk_queries) or 1
    tasks = min(max(common.partitions(spark), min(blocks, 1024)), blocks * chunks)
    across = min(blocks, math.ceil(math.sqrt(tasks)))  # groups of blocks; a query's results are merged over them
    down = min(chunks, -(-tasks // across))
    place = lambda salt, m: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(m)).cast("long")
    copies = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    index = rows.withColumn("block", place(1, blocks)).groupBy("block").applyInArrow(pack_block, "block long, n int, d int, bits int, ids binary, own binary, lo binary, slices binary")
    index = common.stage(spark, index, "topk-index").withColumn("gb", F.col("block") % across).withColumn("gc", copies(down))
    queries = rows.filter(is_query).withColumn("chunk", place(2, chunks)).groupBy("chunk").applyInArrow(pack_queries, "chunk long, qd int, qids binary, qrows binary, qs binary")
    queries = queries.withColumn("gc", F.col("chunk") % down).withColumn("gb", copies(across))
    met = queries.repartition(tasks, "gc", "gb").join(index.repartition(tasks, "gc", "gb").hint("merge"), ["gc", "gb"]).sortWithinPartitions("gb", "chunk", "block")
    best = met.mapInArrow(_search(k), "query_row long, query_id long, vec_id long, score long")
    by_query = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return best.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(q) AS x, unnest(range(len(q))) AS i FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score FROM e a JOIN e b ON a.i = b.i AND a.vec_id <> b.vec_id
      WHERE a.vec_id % 20 = 0 GROUP BY a.vec_id, b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
