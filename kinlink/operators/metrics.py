"""Measures of blocking, ranking and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f_beta(tp: str, n_pred: str, n_true: str, beta2: float = 0.25) -> Column:
    """F-beta of one record: 1 if both sets are empty, 0 if only one is."""
    tp, n_pred, n_true = F.col(tp), F.col(n_pred), F.col(n_true)
    return F.when((n_pred == 0) & (n_true == 0), 1.0).when((n_pred == 0) | (n_true == 0), 0.0).otherwise((1 + beta2) * tp / (beta2 * n_true + n_pred))


def per_record(records: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(records' columns, n_pred, n_true, tp, f05) of every left record; predicted and truth are (l_id, r_id)."""
    both = predicted.select("l_id", "r_id").distinct().withColumn("_p", F.lit(1)).join(truth.select("l_id", "r_id").distinct().withColumn("_t", F.lit(1)), ["l_id", "r_id"], "full")
    sums = both.groupBy("l_id").agg(F.count("_p").alias("n_pred"), F.count("_t").alias("n_true"), F.count(F.when(F.col("_p").isNotNull() & F.col("_t").isNotNull(), 1)).alias("tp"))
    return records.join(sums, "l_id", "left").fillna(0, ["n_pred", "n_true", "tp"]).withColumn("f05", f_beta("tp", "n_pred", "n_true"))


def per_labelled(records: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """As ``per_record``, of predicted pairs that know whether they are in truth (y): pairs are not joined with it."""
    sums = predicted.groupBy("l_id", "r_id").agg(F.max("y").alias("y")).groupBy("l_id").agg(F.count(F.lit(1)).alias("n_pred"), F.sum("y").alias("tp"))
    links = truth.select("l_id", "r_id").distinct().groupBy("l_id").agg(F.count(F.lit(1)).alias("n_true"))
    return records.join(sums, "l_id", "left").join(links, "l_id", "left").fillna(0, ["n_pred", "n_true", "tp"]).withColumn("f05", f_beta("tp", "n_pred", "n_true"))


def summary(per: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, macro f05, micro precision and recall, and f05 of records without and with true links."""
    single = F.col("n_true") == 0
    return per.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("f05").alias("f05"),
        F.try_divide(F.sum("tp"), F.sum("n_pred")).alias("precision"),
        F.try_divide(F.sum("tp"), F.sum("n_true")).alias("recall"),
        F.avg(F.when(single, F.col("f05"))).alias("f05_single"),
        F.avg(F.when(~single, F.col("f05"))).alias("f05_linked"),
    )


def oracle_f(per_candidates: DataFrame) -> DataFrame:
    """Macro F0.5 of a perfect choice among the candidates: all the true ones found."""
    e = F.when(F.col("n_true") == 0, 1.0).when(F.col("tp") == 0, 0.0).otherwise(1.25 * F.col("tp") / (0.25 * F.col("n_true") + F.col("tp")))
    return per_candidates.agg(F.avg(e).alias("oracle_f05"))


def recall_by_view(truth: DataFrame, fused: DataFrame, views: list[str]) -> DataFrame:
    """(view, found, alone, recall): links that a view covers, and those that only it covers."""
    j = truth.join(fused.select("l_id", "r_id", *views), ["l_id", "r_id"], "left")
    n = sum((F.col(v).isNotNull().cast("int") for v in views), F.lit(0))
    rows = j.select(F.explode(F.array(*(F.struct(F.lit(v).alias("view"), F.col(v).isNotNull().cast("int").alias("has"), n.alias("n")) for v in views))).alias("x")).select("x.*")
    return rows.groupBy("view").agg(F.sum("has").alias("found"), F.sum(F.when(F.col("n") == 1, F.col("has")).otherwise(0)).alias("alone"), (F.sum("has") / F.count(F.lit(1))).alias("recall"))


def recall_by_cap(truth: DataFrame, ranked: DataFrame, caps: list[int]) -> DataFrame:
    """(cap, recall): links among the first ``cap`` candidates by brank."""
    j = truth.join(ranked.select("l_id", "r_id", "brank"), ["l_id", "r_id"], "left")
    rows = j.select("brank", F.explode(F.array(*(F.lit(c) for c in caps))).alias("cap"))
    return rows.groupBy("cap").agg(F.avg(F.when(F.col("brank") < F.col("cap"), 1.0).otherwise(0.0)).alias("recall"))


def running(per: DataFrame, score: str, sums: list[str], cells: int = 256) -> DataFrame:
    """Adds, for each of ``sums``, what all smaller scores have (``below_``) and what all have (``all_``); per has one row a score.

    In two levels, so that no task orders more than a cell: scores are dealt into cells between
    approximate quantiles, cells are summed first, and rows are ordered within their cell only.
    """
    cuts = per.agg(F.percentile_approx(score, [i / cells for i in range(1, cells)], 10_000).alias("_cuts"))
    placed = per.join(F.broadcast(cuts), how="cross").withColumn("_cell", F.size(F.filter("_cuts", lambda c: c < F.col(score)))).drop("_cuts")  # one row
    before, whole = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per_cell = placed.groupBy("_cell").agg(*(F.sum(c).alias(f"_{c}") for c in sums))  # at most ``cells`` rows
    per_cell = per_cell.select("_cell", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_below_{c}") for c in sums), *(F.sum(f"_{c}").over(whole).alias(f"all_{c}") for c in sums))
    inside = Window.partitionBy("_cell").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(per_cell), "_cell")
    return out.withColumns({f"below_{c}": F.col(f"_below_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}).drop("_cell", *(f"_below_{c}" for c in sums))


def recall_by_group(truth: DataFrame, pairs: DataFrame, records: DataFrame, by: str) -> DataFrame:
    """(by, links, found, recall) of the groups of left records (l_id, by)."""
    hit = pairs.select("l_id", "r_id").distinct().withColumn("_hit", F.lit(1))
    j = truth.join(records.select("l_id", by), "l_id").join(hit, ["l_id", "r_id"], "left")
    return j.groupBy(by).agg(F.count(F.lit(1)).alias("links"), F.count("_hit").alias("found"), (F.count("_hit") / F.count(F.lit(1))).alias("recall"))


def link_profile(records: DataFrame, truth: DataFrame, sources: DataFrame, by: str) -> DataFrame:
    """(by, n, single, mean_2, mean_3): left records, the share without links, and mean links into either source; sources: r_id, src."""
    per = truth.join(sources.select("r_id", "src"), "r_id").groupBy("l_id").agg(F.count(F.when(F.col("src") == 2, 1)).alias("_2"), F.count(F.when(F.col("src") == 3, 1)).alias("_3"))
    each = records.select("l_id", by).join(per, "l_id", "left").fillna(0, ["_2", "_3"])
    return each.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_2") + F.col("_3") == 0).cast("double")).alias("single"), F.avg("_2").alias("mean_2"), F.avg("_3").alias("mean_3"))


def weak_addresses(pairs: DataFrame, similar: float = 0.5) -> DataFrame:
    """One row of shares of pairs: an address is empty on the right, on the left; both are there but unlike; first numbers differ; states differ.

    pairs: l_addr, r_addr, sim (0 to 1), l_num, r_num, l_state, r_state; empty is unknown.
    """
    share = lambda c: F.avg(c.cast("double"))
    both = lambda a, b: (F.col(a) != "") & (F.col(b) != "")
    return pairs.agg(
        F.count(F.lit(1)).alias("n"), share(F.col("r_addr") == "").alias("right_empty"), share(F.col("l_addr") == "").alias("left_empty"), share(both("l_addr", "r_addr") & (F.col("sim") < similar)).alias("unlike"),
        share(both("l_num", "r_num") & (F.col("l_num") != F.col("r_num"))).alias("number_differs"), share(both("l_state", "r_state") & (F.col("l_state") != F.col("r_state"))).alias("state_differs"),
    )


def auc(df: DataFrame, score: str, y: str) -> DataFrame:
    """Area under the ROC curve by rank sums, over distinct scores: pre-aggregated, ties count half."""
    one = F.col(y).cast("long")
    per = df.groupBy(F.col(score).alias("_s")).agg(F.sum(one).alias("pos"), F.sum(1 - one).alias("neg"))
    won = running(per, "_s", ["pos", "neg"]).withColumn("_won", F.col("pos") * (F.col("below_neg") + F.col("neg") / 2))
    return won.agg(F.try_divide(F.sum("_won"), F.sum("pos") * F.sum("neg")).alias("auc"))


def average_precision(df: DataFrame, score: str, y: str) -> DataFrame:
    """Step-wise area under precision and recall, over distinct scores."""
    per = df.groupBy(F.col(score).alias("_s")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    cum = running(per, "_s", ["pos", "n"]).withColumns({"_tp": F.col("all_pos") - F.col("below_pos"), "_n": F.col("all_n") - F.col("below_n")})
    return cum.agg(F.try_divide(F.sum(F.col("pos") * F.col("_tp") / F.col("_n")), F.sum("pos")).alias("ap"))


def coverage(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Shares of non-empty values."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg((F.coalesce(F.col(c).cast("string"), F.lit("")) != "").cast("double")).alias(f"{c}_share") for c in cols))


def pair_profile(pairs: DataFrame, sims: list[str], equal: list[tuple[str, str, str]], by: list[str]) -> DataFrame:
    """Mean similarities; and for (name, left, right) columns, how often both are known and, if so, equal."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("n"), *(F.avg(s).alias(f"{s}_mean") for s in sims)]
    for name, a, b in equal:
        known = (F.col(a) != "") & (F.col(b) != "")
        aggs += [F.avg(known.cast("double")).alias(f"{name}_known"), F.avg(F.when(known, (F.col(a) == F.col(b)).cast("double"))).alias(f"{name}_equal")]
    return pairs.groupBy(*by).agg(*aggs)


def substitutions(pairs: DataFrame, left: Column, right: Column, n: int = 30) -> DataFrame:
    """(a, b, n): tokens that stand for each other where two records differ in just one token, not a number; the most frequent ones."""
    x, y = F.array_except(left, right), F.array_except(right, left)
    one = pairs.filter((F.size(x) == 1) & (F.size(y) == 1)).select(x[0].alias("a"), y[0].alias("b")).filter(~F.col("a").rlike("[0-9]") & ~F.col("b").rlike("[0-9]"))
    return one.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "a", "b").limit(n)


def drift(right: DataFrame, left: DataFrame, toks: str, least: int, most: int) -> DataFrame:
    """(token, n_right, n_left): tokens frequent on the right and rare on the left."""
    count = lambda d, n: d.select(F.explode(toks).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias(n))
    return count(right, "n_right").join(count(left, "n_left"), "token", "left").fillna(0, ["n_left"]).filter((F.col("n_right") >= least) & (F.col("n_left") <= most))


#: Kinds of hard pairs, in order of precedence.
def hard_category(l_name: Column, r_name: Column, r_raw: Column, alias: Column) -> Column:
    from ..functions.text import INDIC, initials, tokens

    shared = F.size(F.array_intersect(tokens(l_name), tokens(r_name)))
    return (
        F.when(r_name == "", "empty")
        .when(r_raw.rlike(INDIC), "script")
        .when(alias == 1, "alias")
        .when(r_raw.rlike("(?i)www\\.|\\.(com|net|org|in|co|fr|io|biz)\\b"), "website")
        .when((F.length(r_name) >= 2) & (F.replace(r_name, F.lit(" "), F.lit("")) == initials(l_name)), "acronym")
        .when(F.replace(l_name, F.lit(" "), F.lit("")) == F.replace(r_name, F.lit(" "), F.lit("")), "glued")
        .when(shared == 0, "no shared word")
        .otherwise("other")
    )
