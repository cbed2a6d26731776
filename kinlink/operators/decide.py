"""Which candidates to answer with."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def threshold_mask(p: str, gate, include) -> Column:
    """Keep a pair if its group's best passes the gate and it passes ``include`` or is the best."""
    best = F.max(p).over(Window.partitionBy("l_id"))
    return (best >= gate) & ((F.col(p) >= include) | (F.col(p) == best))


def _poisson_binomial(p: np.ndarray) -> np.ndarray:
    out = np.ones(1)
    for x in p:
        out = np.r_[out, 0.0] * (1 - x) + np.r_[0.0, out] * x
    return out


def best_prefix(p: np.ndarray, beta2: float = 0.25, most: int = 30, least: float = 0.02) -> int:
    """How many of the candidates, best first, maximise the expected F-beta; 0 if the empty answer does.

    Exact: a prefix's hits and the others' are independent sums of independent trials.  F of the
    empty answer is 1 if nothing is true, else 0.
    """
    p = np.asarray(p, float)[:most]
    if not len(p) or p[0] < least:
        return 0
    best, k_best = float(np.prod(1 - p)), 0
    inside = np.ones(1)
    after = [_poisson_binomial(p[k:]) for k in range(len(p) + 1)]
    for k in range(1, len(p) + 1):
        x = p[k - 1]
        inside = np.r_[inside, 0.0] * (1 - x) + np.r_[0.0, inside] * x
        a, b = np.arange(k + 1)[:, None], np.arange(len(after[k]))[None]
        e = float((inside[:, None] * after[k][None] * (1 + beta2) * a / (beta2 * (a + b) + k)).sum())
        if e > best + 1e-12:
            best, k_best = e, k
    return k_best


def expected_f(pairs: DataFrame, p: str = "p", most: int = 30) -> DataFrame:
    """pairs with keep: the prefix of each l_id's candidates, best first, that maximises the expected F0.5.

    The candidates of one l_id are bounded by the cap of blocking; equal probabilities are in order of r_id.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([p, "r_id"], ascending=[False, True], kind="stable")
        return pdf.assign(keep=np.arange(len(pdf)) < best_prefix(pdf[p].to_numpy(), most=most))

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema), "keep boolean"])
    return pairs.groupBy("l_id").applyInPandas(run, fields)


def threshold_grid(pairs: DataFrame, truth_counts: DataFrame, gates: list[float], includes: list[float], p: str = "p") -> DataFrame:
    """Macro F0.5 of every (gate, include <= gate) in one job: pairs (l_id, p, y), truth_counts (l_id, n_true) of every left record.

    Pairs are summed once for each left record and value of ``include``, as columns; the grid, a
    constant of a few hundred cells, is laid on these rows, not on pairs.
    """
    from .metrics import f_beta

    cells = [(g, i) for g in gates for i in includes if i <= g + 1e-9]
    best = pairs.withColumn("_best", F.max(p).over(Window.partitionBy("l_id")))
    kept = [((F.col(p) >= F.lit(float(i))) | (F.col(p) == F.col("_best"))).cast("int") for i in includes]
    sums = [x for k, c in enumerate(kept) for x in (F.sum(c).alias(f"_n{k}"), F.sum(c * F.col("y")).alias(f"_t{k}"))]
    each = best.groupBy("l_id").agg(F.max("_best").alias("_best"), *sums)
    cell = lambda g, i: F.struct(F.lit(float(g)).alias("gate"), F.lit(float(i)).alias("include"), *(F.when(F.col("_best") >= F.lit(float(g)), F.col(f"_{c}{includes.index(i)}")).otherwise(0).alias(n) for c, n in (("n", "n_pred"), ("t", "tp"))))
    per = each.select("l_id", F.explode(F.array(*(cell(g, i) for g, i in cells))).alias("_c")).select("l_id", "_c.*")
    per = per.join(truth_counts, "l_id")
    without = truth_counts.join(pairs.select("l_id").distinct(), "l_id", "left_anti")
    rest = without.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum((F.col("n_true") == 0).cast("double")), F.lit(0.0)).alias("_f"))
    sums = per.groupBy("gate", "include").agg(F.sum(f_beta("tp", "n_pred", "n_true")).alias("_s"), F.count(F.lit(1)).alias("_m"))
    return sums.join(F.broadcast(rest), how="cross").select("gate", "include", ((F.col("_s") + F.col("_f")) / (F.col("_m") + F.col("_n"))).alias("f05"))  # one row


def choose_rule(pairs: DataFrame, truth_counts: DataFrame, gates: list[float] | None = None, includes: list[float] | None = None) -> dict:
    """The rule of largest macro F0.5: thresholds or expected F, with or without one-to-one first; the first of equal ones.

    pairs: l_id, r_id, p, y; truth_counts: l_id, n_true of every left record.
    """
    from .competition import one_to_one
    from .metrics import f_beta

    gates = gates or [round(0.2 + 0.05 * i, 2) for i in range(15)]
    includes = includes or [round(0.1 + 0.05 * i, 2) for i in range(17)]
    best: dict = {"f05": -1.0}
    for single in (False, True):
        own = one_to_one(pairs) if single else pairs
        g = threshold_grid(own, truth_counts, gates, includes).orderBy(F.col("f05").desc(), "gate", "include").first()
        if g and g.f05 > best["f05"]:
            best = {"rule": "threshold", "one_to_one": single, "gate": g.gate, "include": g.include, "f05": g.f05}
        per = expected_f(own.select("l_id", "r_id", "p", "y")).groupBy("l_id").agg(F.sum(F.col("keep").cast("int")).alias("n_pred"), F.sum(F.col("keep").cast("int") * F.col("y")).alias("tp"))
        e = truth_counts.join(per, "l_id", "left").fillna(0, ["n_pred", "tp"]).agg(F.avg(f_beta("tp", "n_pred", "n_true"))).first()[0]
        if e is not None and e > best["f05"]:
            best = {"rule": "expected", "one_to_one": single, "f05": e}
    return best


def apply_rule(pairs: DataFrame, rule: dict) -> DataFrame:
    """(l_id, r_id) that a rule of choose_rule keeps."""
    from .competition import one_to_one

    own = one_to_one(pairs) if rule["one_to_one"] else pairs
    if rule["rule"] == "expected":
        return expected_f(own.select("l_id", "r_id", "p")).filter("keep").select("l_id", "r_id")
    return own.withColumn("_k", threshold_mask("p", rule["gate"], rule["include"])).filter("_k and p > 0").select("l_id", "r_id")
