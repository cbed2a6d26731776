"""Tables learned from data: mappings, word statistics, a model of made-up words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.similarity import distance_similarity


def learn_mapping(df: DataFrame, key: str, value: str, support: int, purity: float) -> DataFrame:
    """(key, value, n, share): the most frequent value of each key that is seen ``support`` times, if its share is ``purity``; ties to the smaller value."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy(key).agg(F.sum("c").alias("n"), F.min(F.struct((-F.col("c")).alias("c"), F.col(value).alias("v"))).alias("top"))
    out = per.select(key, F.col("top.v").alias(value), "n", (-F.col("top.c") / F.col("n")).alias("share"))
    return out.filter((F.col("n") >= support) & (F.col("share") >= purity))


def native_states(df: DataFrame, known: list[str], component: str = "component", state: str = "state") -> DataFrame:
    """Names of states in native scripts, from components of linked addresses and the state that their owner has."""
    return learn_mapping(df.filter(~F.col(component).isin(known) & (F.col(state) != "")), component, state, 15, 0.9)


def city_regions(df: DataFrame, city: str = "city", region: str = "region") -> DataFrame:
    return learn_mapping(df.filter((F.col(city) != "") & (F.col(region) != "")), city, region, 3, 0.95)


def transliteration(pairs: DataFrame, frequency: DataFrame, avoid: list[str], support: int = 5, purity: float = 0.6, alike: float = 0.4, rare: float = 0.2) -> DataFrame:
    """(token, value, n, share): how tokens of transliterated names are spelled in the names they are linked with.

    pairs: native and plain token arrays of linked names.  Equal lengths are aligned by position,
    others by the most similar skeleton (the first of equal ones).  Kept are values seen
    ``support`` times in ``purity`` of the token's cases, similar in skeleton, not a legal
    word, and tokens that are ``rare`` among plain names (frequency: token, freq) next to their value.
    """
    same = pairs.filter(F.size("native") == F.size("plain")).select(F.explode(F.arrays_zip("native", "plain")).alias("z")).select(F.col("z.native").alias("token"), F.col("z.plain").alias("value"))
    rest = pairs.filter((F.size("native") != F.size("plain")) & (F.size("plain") > 0)).select(F.posexplode("native").alias("_i", "token"), "plain", F.monotonically_increasing_id().alias("_row"))
    each = rest.select("_row", "_i", "token", F.posexplode("plain").alias("_j", "value"))
    sim = distance_similarity(X.skeleton(F.col("token")), X.skeleton(F.col("value")))
    best = each.groupBy("_row", "_i", "token").agg(F.min_by("value", F.struct((-sim).alias("s"), "_j")).alias("value")).select("token", "value")
    found = same.unionByName(best)
    counts = found.groupBy("token", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("token")))
    top = counts.withColumn("_r", F.row_number().over(Window.partitionBy("token").orderBy(F.col("n").desc(), "value"))).filter("_r = 1").drop("_r")
    top = top.filter((F.col("n") >= support) & (F.col("share") >= purity) & ~F.col("value").isin(avoid) & (F.col("token") != F.col("value")))
    top = top.filter(distance_similarity(X.skeleton(F.col("token")), X.skeleton(F.col("value"))) >= alike)
    f = frequency.select("token", F.col("freq").alias("_ft")), frequency.select(F.col("token").alias("value"), F.col("freq").alias("_fv"))
    top = top.join(f[0], "token", "left").join(f[1], "value", "left").fillna(0, ["_ft", "_fv"])
    return top.filter(F.col("_ft") < rare * F.col("_fv")).select("token", "value", "n", "share")


def row_stats(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frequencies over the whole data; both sides have (id, country, name, toks, raw).

    Left gains l_name_n and l_first_n: records of its country with its name, its first token.
    Right gains r_name_n_s1 and r_name_n_r: its name among left and right; r_oov_n and
    r_oov_frac: distinct tokens that no left name has; r_is_web.
    """
    first = F.coalesce(F.get(F.col("toks"), F.lit(0)), F.lit(""))
    l = left.withColumn("l_name_n", F.count(F.lit(1)).over(Window.partitionBy("country", "name"))).withColumn("_first", first)
    l = l.withColumn("l_first_n", F.count(F.lit(1)).over(Window.partitionBy("country", "_first"))).drop("_first")
    counted = left.groupBy("country", "name").agg(F.count(F.lit(1)).alias("r_name_n_s1"))
    r = right.withColumn("r_name_n_r", F.count(F.lit(1)).over(Window.partitionBy("country", "name"))).join(counted, ["country", "name"], "left").fillna(0, ["r_name_n_s1"])
    vocabulary = left.select(F.explode("toks").alias("token")).distinct().withColumn("_known", F.lit(1))
    oov = right.select("id", F.explode(F.array_distinct("toks")).alias("token")).join(vocabulary, "token", "left").groupBy("id").agg(F.sum(F.when(F.col("_known").isNull(), 1).otherwise(0)).alias("r_oov_n"))
    r = r.join(oov, "id", "left").fillna(0, ["r_oov_n"])
    r = r.withColumn("r_oov_frac", F.col("r_oov_n") / F.greatest(F.size(F.array_distinct("toks")), F.lit(1)))
    return l, r.withColumn("r_is_web", F.lower("raw").rlike("www\\.|https?://|\\.(com|in|net|org|co|fr|io|biz)\\b").cast("int"))


def trigrams(word: Column) -> Column:
    return X.char_grams(word, 3, "^$")


def trigram_scores(words: DataFrame, made_up: DataFrame, real: DataFrame, unknown: float = -5.0) -> DataFrame:
    """(word, score): mean log-likelihood ratio of a word's padded trigrams, made-up against real words, add-one smoothed.

    All tables are (word); words that aren't 4 to 14 letters a to z score ``unknown``.
    """

    def counts(d: DataFrame, name: str) -> DataFrame:
        return d.select(F.explode(trigrams(F.col("word"))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias(name))

    both = counts(made_up, "a").join(counts(real, "b"), "g", "full").fillna(0, ["a", "b"])
    sums = both.agg(F.sum("a").alias("_na"), F.sum("b").alias("_nb"), F.count(F.lit(1)).alias("_v"))
    table = both.join(F.broadcast(sums), how="cross").select("g", (F.log((F.col("a") + 1) / (F.col("_na") + F.col("_v") + 1)) - F.log((F.col("b") + 1) / (F.col("_nb") + F.col("_v") + 1))).alias("llr"))  # one row
    base = F.broadcast(sums.select((F.log(1 / (F.col("_na") + F.col("_v") + 1)) - F.log(1 / (F.col("_nb") + F.col("_v") + 1))).alias("_unseen")))
    plain = words.select("word").distinct()
    fit = F.col("word").rlike("^[a-z]{4,14}$")
    each = plain.filter(fit).select("word", F.explode(trigrams(F.col("word"))).alias("g")).join(table, "g", "left").join(base, how="cross")
    scored = each.groupBy("word").agg(F.avg(F.coalesce("llr", "_unseen")).alias("score"))
    return scored.unionByName(plain.filter(~fit).select("word", F.lit(unknown).alias("score")))


def made_up_words(linked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, n): words of right names that share none with the left name they are linked with, and that no left name has.

    linked: l_toks, r_toks of linked names, r_raw as written (web addresses and Indic scripts glue or respell words, so they
    say nothing); vocabulary: word, of all left names.
    """
    plain = ~F.col("r_raw").rlike(X.INDIC) & ~F.lower("r_raw").rlike("\\.(com|net|org|in|fr|co|biz)|www\\.")
    apart = linked.filter(plain & ~F.arrays_overlap("l_toks", "r_toks")).select(F.explode("r_toks").alias("word"))
    known = vocabulary.select("word").distinct()
    return apart.filter(F.col("word").rlike("^[a-z]{4,14}$")).join(known, "word", "left_anti").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def most_made_up(records: DataFrame, scores: DataFrame, id_: str, toks: str = "toks", unknown: float = -5.0) -> DataFrame:
    """(id, gen_max): the highest score (word, score) of a record's words; ``unknown`` without any."""
    each = records.select(id_, F.explode_outer(toks).alias("word")).join(scores, "word", "left")
    return each.groupBy(id_).agg(F.greatest(F.coalesce(F.max("score"), F.lit(unknown)), F.lit(unknown)).alias("gen_max"))


def shared_word_rate(pairs: DataFrame, left: Column, right: Column) -> DataFrame:
    return pairs.agg(F.avg(F.arrays_overlap(left, right).cast("double")).alias("share"))
