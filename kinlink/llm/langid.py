"""Language identification by Bayesian evidence fusion.

For each language: log prior of the host + tempered log likelihood of the text + log
likelihoods of the declared markup language, of the address suffix and of a language code in
the address path.  The text model is naive Bayes on hashed byte trigrams of words, learned
from a bounded sample of ``sample`` documents of known language.  The other tables are
learned from what the text alone says, by grouped aggregation over all rows: P(declared |
language), P(suffix | language), P(path code | language), smoothed, and the host's
distribution of languages, shrunk to its suffix's, which is shrunk to the global one.

Cases.  Null or empty text: the other evidence decides; without any, the global prior.
Missing evidence of a kind is neutral (its likelihood is left out).  Null or malformed
addresses: no host (one group), no suffix, no code.  Nothing to learn from: language null.
Ties go to the first language in code-point order.  Repeated rows count and are scored each.
Empty tables: empty result.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bytesops import buffer_of, lower_ascii, mix, slices
from .toxicity import _is_letter

_U = np.uint64
BITS = 16
MARKUP = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Buckets of byte trigrams of words, with blanks around words."""
    if not len(raw):
        return np.zeros(0, np.int64)
    low = lower_ascii(raw)
    b = np.where(_is_letter(low) & ~((low >= 48) & (low <= 57)), low, 32).astype(_U)
    b = np.r_[_U(32), b, _U(32)]
    b = b[np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]]
    if len(b) < 3:
        return np.zeros(0, np.int64)
    return (mix(b[:-2] << _U(16) | b[1:-1] << _U(8) | b[2:]) >> _U(64 - BITS)).astype(np.int64)


def fit(spark: SparkSession, docs: DataFrame, may_learn: Column, sample: int = 4000, seed: int = 17) -> tuple[list[str], np.ndarray]:
    """Languages, and log P(bucket | language), from at most ``sample`` rows of (doc_id, text, lang)."""
    own = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & may_learn)
    few = own.select("doc_id", F.col("lang").cast("string").alias("lang")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).select("doc_id").distinct()
    chosen = F.broadcast(few)  # bounded by `sample`

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            raw, off = buffer_of(batch.column("text"))
            for lang, a, b in zip(batch.column("lang").to_pylist(), off, off[1:]):
                total.setdefault(lang, np.zeros(1 << BITS, np.int64))
                total[lang] += np.bincount(trigrams(raw[a:b]), minlength=1 << BITS)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["lang", "c"])

    found: dict[str, np.ndarray] = {}
    for r in own.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").join(chosen, "doc_id").select("lang", "text").mapInArrow(count, "lang string, c binary").toLocalIterator():
        found[r.lang] = found.get(r.lang, 0) + np.frombuffer(r.c, np.int64)
    langs = sorted(found)
    if not langs:
        return [], np.zeros((0, 1 << BITS), np.float32)
    counts = np.stack([found[x] for x in langs]) + 0.5
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def likelihood(raw: np.ndarray, table: np.ndarray, temper: float) -> np.ndarray:
    """Tempered log likelihood of a text: neighbouring trigrams overlap, so each counts as ``temper`` of one, and no text as more than 300."""
    t = trigrams(raw)
    if not len(t):
        return np.zeros(len(table))
    return table[:, t].sum(axis=1, dtype=np.float64) * (temper * min(1.0, 300 / len(t)))


def identify(spark: SparkSession, rows: DataFrame, langs: list[str], table: np.ndarray, keep: list[str], temper: float = 0.3, pseudo: float = 20.0) -> DataFrame:
    """keep columns, lang, prob, text_lang of rows (text or html, declared, host, suffix, code)."""
    n = len(langs)
    if not n:
        return rows.select(*keep, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("prob"), F.lit(None).cast("string").alias("text_lang"))
    sent = spark.sparkContext.broadcast(table)
    facts = [*keep, "declared", "host", "suffix", "code"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                raw, off = buffer_of(part.column("text"))
                for markup, a, b in zip(part.column("is_html").to_pylist(), off, off[1:]):
                    own = raw[a:b]
                    if markup:
                        own = np.frombuffer(html.unescape(MARKUP.sub(" ", own.tobytes().decode())).encode(), np.uint8)
                    out.append(likelihood(own, sent.value, temper))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in facts), pa.array(out, pa.list_(pa.float64()))], names=[*facts, "ll"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    scored = rows.select(*facts, "text", "is_html").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in facts), "ll array<double>"]))
    best = lambda c: F.array_position(F.col(c), F.array_max(c)).cast("int") - 1
    scored = common.stage(spark, scored.withColumn("by_text", best("ll")).withColumn("silent", F.array_max("ll") == 0), "langid-rows")
    spoken = scored.filter(~F.col("silent"))
    total = np.zeros(n)
    for r in spoken.groupBy("by_text").count().collect():  # a row for each language
        total[r.by_text] = r["count"]
    prior = (total + 1) / (total.sum() + n)

    def counts(by: str) -> DataFrame:
        return spoken.groupBy(by).agg(*(F.count(F.when(F.col("by_text") == i, 1)).alias(f"c{i}") for i in range(n)))

    def given(by: str) -> DataFrame:
        """log P(value | language), add-one over the values seen and one unseen."""
        per = counts(by).filter(F.col(by).isNotNull())
        values = per.count() + 1
        return per.select(F.col(by).alias(f"_{by}"), F.array(*(F.log((F.col(f"c{i}") + 1) / F.lit(float(total[i] + values))) for i in range(n))).alias(f"p_{by}"))

    def shrunk(per: DataFrame, parent: list[Column]) -> Column:
        size = sum((F.col(f"c{i}") for i in range(1, n)), F.col("c0"))
        return F.array(*((F.col(f"c{i}") + pseudo * parent[i]) / (size + pseudo) for i in range(n)))

    suffixes = counts("suffix")
    suffixes = suffixes.select(F.col("suffix").alias("_s"), shrunk(suffixes, [F.lit(float(p)) for p in prior]).alias("up"))
    hosts = spoken.groupBy("host", "suffix").agg(*(F.count(F.when(F.col("by_text") == i, 1)).alias(f"c{i}") for i in range(n)))
    hosts = hosts.join(suffixes, F.col("suffix").eqNullSafe(F.col("_s")))
    hosts = hosts.select(F.col("host").alias("_h"), F.col("suffix").alias("_hs"), shrunk(hosts, [F.col("up")[i] for i in range(n)]).alias("p_host"))
    out = scored.join(hosts, F.col("host").eqNullSafe(F.col("_h")) & F.col("suffix").eqNullSafe(F.col("_hs")), "left")
    for by in ("declared", "suffix", "code"):
        per = given(by)
        out = out.join(per, F.col(by) == F.col(f"_{by}"), "left")
    term = lambda c, i: F.coalesce(F.col(c)[i], F.lit(0.0))
    fused = F.array(*(F.log(F.coalesce(F.col("p_host")[i], F.lit(float(prior[i])))) + F.col("ll")[i] + term("p_declared", i) + term("p_suffix", i) + term("p_code", i) for i in range(n)))
    out = out.withColumn("z", fused).withColumn("top", F.array_max("z"))
    weight = F.aggregate(F.transform("z", lambda z: F.exp(z - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    named = F.array(*(F.lit(x) for x in langs))
    return out.select(*keep, named[best("z")].alias("lang"), (1 / weight).alias("prob"), F.when(~F.col("silent"), named[F.col("by_text")]).alias("text_lang"))


def evidence(pages: DataFrame) -> DataFrame:
    """Adds declared, host, suffix and code of pages (url, html)."""
    some = lambda c: F.when(c != "", F.lower(c))
    host = some(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    return (
        pages.withColumn("declared", some(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)))
        .withColumn("host", host)
        .withColumn("suffix", some(F.regexp_extract(F.coalesce(F.col("host"), F.lit("")), r"\.([a-z0-9-]+)$", 1)))
        .withColumn("code", some(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]+://[^/]+/([A-Za-z]{2})(?:/|$)", 1)))
    )


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document (its source as host) and every page; the text model learns from a third of the documents left out of nothing else."""
    from .toxicity import fold

    docs, pages = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "pages")
    langs, table = fit(spark, docs, F.coalesce(fold(3) == 0, F.lit(False)))
    null = lambda kind: F.lit(None).cast(kind)
    a = docs.select("doc_id", null("long").alias("page_id"), "text", F.lit(False).alias("is_html"), null("string").alias("declared"), F.col("source").alias("host"), null("string").alias("suffix"), null("string").alias("code"))
    b = evidence(pages).select(null("long").alias("doc_id"), "page_id", F.col("html").alias("text"), F.lit(True).alias("is_html"), "declared", "host", "suffix", "code")
    return identify(spark, a.unionByName(b), langs, table, ["doc_id", "page_id"])
