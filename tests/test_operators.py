import itertools
import math
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinlink.functions import similarity as S
from kinlink.functions import text as X
from kinlink.operators import blocking as B
from kinlink.operators import competition as C
from kinlink.operators import decide as D
from kinlink.operators import learn as L
from kinlink.operators import metrics as M
from kinlink.sources import io


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_ratio_is_lcs(a, b):
    assert S._lcs(a, b) == lcs(a, b)
    assert 0 <= S._partial(a, b) <= 100 and 0 <= S._token_set(a, b) <= 100
    assert S._jaro_winkler(a, b) <= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=7))
def test_best_prefix_is_exact(p):
    p = sorted(p, reverse=True)

    def value(k):
        total = 0.0
        for bits in itertools.product((0, 1), repeat=len(p)):
            w = math.prod(x if b else 1 - x for x, b in zip(p, bits))
            t, n = sum(bits), sum(bits[:k])
            total += w * ((1.0 if t == 0 else 0.0) if k == 0 else 1.25 * n / (0.25 * t + k))
        return total

    values = [value(k) for k in range(len(p) + 1)]
    k = D.best_prefix(np.array(p))
    assert (k == 0 and p[0] < 0.02) or abs(values[k] - max(values)) < 1e-9


def test_partition_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, ""), (3, "b")], "l_id long, lpart string").selectExpr("*", "'x' as country")
    right = spark.createDataFrame([(10, "a"), (11, ""), (12, "c")], "r_id long, rpart string").selectExpr("*", "'x' as country")
    got = {(r.l_id, r.r_id) for r in B.partition_join(left, right, ["country"]).collect()}
    assert got == {(1, 10), (1, 11), (2, 10), (2, 11), (2, 12), (3, 11)}


def test_second_counts_repeats(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.9), (3, 1, 0.1), (4, 2, 0.5), (5, 3, None)], "l_id long, r_id long, x double")
    got = {r.l_id: r.g for r in C.gap_to_other(df, "x", ["r_id"], ["l_id"], "g").collect()}
    assert got[1] == 0 and got[2] == 0 and abs(got[3] + 0.8) < 1e-12 and got[4] == 1.5 and got[5] is None


def test_transliteration(spark):
    rows = [(["raama", "xyz"], ["rama", "store"])] * 6 + [(["raama"], ["other", "rama"])]
    pairs = spark.createDataFrame(rows, "native array<string>, plain array<string>")
    freq = spark.createDataFrame([("rama", 50)], "token string, freq long")
    got = {r.token: r.value for r in L.transliteration(pairs, freq, ["ltd"]).collect()}
    assert got == {"raama": "rama"}


def test_native_states(spark):
    rows = [("maharastr", "mh")] * 15 + [("maharastr", "gj")] + [("rare", "mh")] * 3 + [("kerala", "kl")] * 20
    got = L.native_states(spark.createDataFrame(rows, "component string, state string"), ["kerala"]).collect()
    assert [(r.component, r.state) for r in got] == [("maharastr", "mh")]


def test_tsv_round_trip(spark, tmp_path):
    p = tmp_path / "train_source1.tsv"
    p.write_text('entity_id\t business_name\tcountry\n a1 \tx "q"\tUS\n\tz\tFR\na1\tagain\tUS\na2\t\tIN\n', encoding="utf-8")
    for k in (2, 3):
        (tmp_path / f"train_source{k}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n", encoding="utf-8")
    got = sorted(tuple(r) for r in io.load_sources(spark, str(tmp_path), "train").collect())
    assert got == [("a1", 'x "q"', "", "US", 1), ("a2", "", "", "IN", 1)]


def test_truth_and_lists(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\na\tx, y,x\nb\t\n", encoding="utf-8")
    truth = io.read_truth(spark, str(tmp_path / "t.tsv"))
    assert sorted(map(tuple, truth.collect())) == [("a", "x"), ("a", "y")]
    records = spark.createDataFrame([("a",), ("b",)], "l_id string")
    lists = io.id_lists(records, truth, "matched")
    assert {r.l_id: r.matched for r in lists.collect()} == {"a": "x,y", "b": ""}
    io.write_lists(lists, str(tmp_path / "out"))
    back = io.read_tsv(spark, str(tmp_path / "out"), ("source1_entity_id", "matched"))
    assert sorted(map(tuple, back.collect())) == [("a", "x,y"), ("b", "")]


def test_stage_table_runs_once(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert io.stage_table(spark, str(tmp_path / "t"), make).count() == 3
    assert len(calls) == 1
    io.write_json(spark, {"a": "é"}, str(tmp_path / "j"))
    assert io.read_json(spark, str(tmp_path / "j")) == {"a": "é"}


def test_f05(spark):
    records = spark.createDataFrame([(i,) for i in range(1, 5)], "l_id long")
    truth = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "l_id long, r_id long")
    guess = spark.createDataFrame([(1, 1), (3, 9)], "l_id long, r_id long")
    got = {r.l_id: r.f05 for r in M.per_record(records, guess, truth).collect()}
    assert got == {1: 1.25 / 1.5, 2: 0.0, 3: 0.0, 4: 1.0}


def test_auc(spark):
    rng = random.Random(1)
    rows = [(round(rng.random(), 1), int(rng.random() < 0.4)) for _ in range(200)]
    pos, neg = [x for x, y in rows if y], [x for x, y in rows if not y]
    expected = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(M.auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first().auc - expected) < 1e-9


def test_variants(spark):
    from kinlink.functions import variants as V

    rows = [
        ("Orbella Co doing business as Nine Lanterns Club", "52 31st Street, Peoria, IL", "US"),
        ("tidewater-shipping.com", "Cove Rd, El Paso, Texas", "US"),
        ("Atelier & Fils Distribution S.A.", "(7) Rue Des Lilas, Le Teich, Gironde", "France"),
        (None, "NULL", "France"),
        ("Maple C0mpany", "Q-12B, near tower, ROHINI, NEW DELHI 110085", "India"),
        ("Maple", "110085 Rohini, Mharastr, 4 hill apts", "India"),
        ("Maple praivet limitet", "00 Anenue X, 07 me", "Peru"),
    ]
    got = V.normalize(spark.createDataFrame(rows, "business_name string, business_address string, country string")).collect()
    a, b, c, d, e, f, g = got
    assert (a.name_core, a.has_alias, a.name_alts, a.legal, a.state, a.nums) == ("orbella", True, "nine lanterns club", "co", "il", "31 52")
    assert (b.is_web, b.name_core, b.state) == (True, "tidewater shipping", "tx")
    assert (c.region, c.nums, c.legal, c.name_strict) == ("gironde", "7", "sa", "atelier distribution")
    assert (d.name, d.addr_missing, d.acronym) == ("", True, "")
    assert (e.postcode, e.state, e.legal, e.has_landmark, e.landmark) == ("110085", "dl", "co", True, "near tower")
    assert (f.postcode, f.state, f.components) == ("", "mh", "110085 rohini|4 hill apartments")
    assert (g.legal, g.name_core, g.addr, g.nums) == ("ltd pvt", "maple", "0 avenue x 7 me", "0 7")


def test_partition_key(spark):
    from pyspark.sql import functions as F

    from kinlink.functions import variants as V

    rows = [("france", "", "3 Quai Y, Douai, Nord"), ("france", "", "3 Quai Y, Redon"), ("india", "tg", ""), ("us", "tx", "")]
    df = spark.createDataFrame(rows, "c string, s string, a string")
    got = [r.k for r in df.select(V.partition_key(F.col("c"), F.col("s"), V.region_parts(F.col("a")), {"redon": "bre"}).alias("k")).collect()]
    assert got == ["hdf", "bre", "tg_ap", "tx"]


def test_pair_features(spark):
    from pyspark.sql import functions as F

    from kinlink.functions import text as X
    from kinlink.operators import features as P

    rows = [("1", "Tidewater Shipping Lines", "42 Kiln River Drive, Boise, ID", "US"), ("2", "Tidewater 5hipping Lines LP", "42 KILN RIVER DR, BOISE ID, ID", "US"), ("3", "", "", "US")]
    n = X.normalize(spark.createDataFrame(rows, "id string, business_name string, business_address string, country string"))
    left, right = n.filter("id = '1'").withColumnRenamed("id", "l_id"), n.filter("id <> '1'").withColumnRenamed("id", "r_id").withColumn("src", F.lit(2))
    idf = lambda c: B.idf(n, "id", X.tokens(F.col(c)))
    pairs = spark.createDataFrame([("1", "2"), ("1", "3")], "l_id string, r_id string").withColumn("cos_v_name_c", F.lit(1.0))
    got = {r.r_id: r for r in P.with_competition(P.pair_features(pairs, left, right, idf("n_core"), idf("a_words"))).collect()}
    assert got["2"].n_ratio == 100 and got["2"].state_eq == 1 and got["2"].num_first_eq == 1 and abs(got["2"].n_idf_jac - 1) < 1e-9
    assert got["3"].n_ratio is None and got["3"].a_tset is None and got["3"].state_eq == -1 and got["3"].n_cand == 2


def test_link_stream(spark, tmp_path):
    from kinlink.streaming.incremental import link_stream

    spark.createDataFrame([(10, "a"), (11, "b")], "r_id long, key string").write.parquet(str(tmp_path / "in"))
    master = spark.createDataFrame([(1, "a"), (2, "c")], "l_id long, key string")
    arriving = spark.readStream.schema("r_id long, key string").parquet(str(tmp_path / "in"))
    link_stream(spark, arriving, master, "key", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [(r.l_id, r.r_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 10)]


def test_choose_rule(spark):
    rows = [(1, 1, 0.9, 1), (1, 2, 0.6, 1), (1, 3, 0.2, 0), (2, 1, 0.5, 0), (2, 4, 0.4, 0), (3, 5, 0.95, 1)]
    pairs = spark.createDataFrame(rows, "l_id long, r_id long, p double, y int")
    counts = spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "l_id long, n_true long")
    rule = D.choose_rule(pairs, counts, [0.3, 0.55], [0.3, 0.55])
    assert rule["f05"] == 1.0
    assert sorted(map(tuple, D.apply_rule(pairs, rule).collect())) == [(1, 1), (1, 2), (3, 5)]


def _records(spark, n=60, seed=5):
    draw = random.Random(seed)
    names = ["red bolt", "red ring", "blue bolt", "old plate", "old plates", "ring"]
    rows = [(i, 1 + i % 3, draw.choice(["x", "y"]), draw.choice(["", "a", "b", None]), draw.choice(names), draw.choice(["1 st", "2 st"])) for i in range(n)]
    rec = spark.createDataFrame(rows, "id long, src int, country string, part string, text string, addr string")
    grams = X.char_grams(F.col("text"), 3)
    left = rec.filter("src = 1").selectExpr("id as l_id", "country", "part as lpart", "text", "addr")
    right = rec.filter("src > 1").selectExpr("id as r_id", "src", "country", "part as rpart", "text", "addr", "array(addr) as addrs")
    texts = rec.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    weights = B.postings(texts, ["text"], grams, B.text_idf(texts, grams, "n"))
    post = B.postings(rec, ["id", "src", "country", "part"], grams, B.idf(rec, "id", grams))
    each = B.cosine_topk(post.filter("src = 1").selectExpr("id as l_id", "part as lpart", "country", "gram", "w"), post.filter("src > 1").selectExpr("id as r_id", "src", "part as rpart", "country", "gram", "w"), 4, digits=6)
    return left, right, B.class_topk(left, right.drop("addr"), weights, 4, digits=6), each


def test_class_topk_is_topk_of_each_record(spark):
    left, _, tops, each = _records(spark)
    got = left.join(tops, ["country", "lpart", "text"])
    rows = lambda df: sorted(map(tuple, df.select("l_id", "src", "rank", "r_id", "score").collect()))
    assert rows(got) == rows(each) and len(rows(got)) > 50
    assert tops.count() < got.count()  # once for a class, not for each of its records


def test_bucket_fuse_is_fuse(spark):
    left, right, tops, each = _records(spark)
    pairs = left.join(right.drop("text"), ["country", "addr"]).select("l_id", "r_id", "src", F.lit(1.0).alias("score"))
    want = B.fuse({"name": each, "bucket": pairs})
    cols = ["l_id", "r_id", "src", "name", "bucket", "n_views", "bsum"]
    rows = lambda df, cols=cols: sorted((tuple(-1 if x is None else x for x in r) for r in df.select(cols).collect()))
    got = B.bucket_fuse(left, right, tops, ["country"], "name", "bucket")
    assert rows(got) == rows(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Exchange")  # pairs are made after the last shuffle


def test_first_rows_of_a_bucket_are_all_that_ranking_keeps(spark):
    left, right, tops, _ = _records(spark, 200)
    whole, first = (B.bucket_fuse(left, right, tops, ["country"], "name", "bucket", most=most) for most in (None, 10))
    assert first.count() < whole.count()
    by = ("country", "addr", "l_id")
    ranked = [sorted(map(tuple, B.rank_fuse(x, ["name"], {"bucket": 0.2}, cap=10, by=b).select("l_id", "brank", "r_id", "brrf").collect())) for x, b in ((whole, ("l_id",)), (first, by))]
    assert ranked[0] == ranked[1]


def test_class_support_is_support(spark):
    pairs = [(i, 10 * i + j, k, p) for i in (1, 2) for j, (k, p) in enumerate([("a", 0.5), ("a", 0.5), ("b", 0.25), ("a", 0.5), ("c", 1.0)][: 5 * (2 - i) + i - 1])]
    df = spark.createDataFrame(pairs, "l_id long, r_id long, kind string, p1 double")
    same = [(x, y, 1.0) for i, x, k, _ in pairs for j, y, m, _ in pairs if i == j and x != y and k == m]
    want = C.support(df, spark.createDataFrame(same, "a long, b long, sim double"))
    met = df.groupBy("l_id", "kind", "p1").agg(F.count(F.lit(1)).alias("n"), F.collect_list("r_id").alias("r_id"))
    got = C.class_support(met, ["l_id"]).withColumn("r_id", F.explode("r_id"))
    rows = lambda x: sorted(tuple(r) for r in x.select("l_id", "r_id", F.round("sup_max", 9), F.round("sup_w", 9)).collect())
    assert rows(got) == rows(want) and len(pairs) == 6


def test_support_features_makes_pairs_once(spark):
    from kinlink.plans import catalog

    plan = catalog.support_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # was a join of all candidates with all of the same record


def test_name_pairs_come_from_classes(spark):
    from kinlink.plans import catalog
    from kinlink.plans import records as R

    d = "/root/testdata/sf0.001"
    got = catalog.set_and_partial_ratios(spark, d)
    assert "_bucket" not in got._jdf.queryExecution().optimizedPlan().toString()  # no pair of records is made
    left, right = R.sides(spark, d)
    want = catalog._fused(spark, d).select("l_id", "r_id").join(left.select("l_id", "l_name"), "l_id").join(right.select("r_id", "r_name"), "r_id").select("l_name", "r_name").distinct()
    assert sorted(map(tuple, got.select("l_name", "r_name").collect())) == sorted(map(tuple, want.collect()))


def test_dense_topk_is_brute_force(spark):
    draw = random.Random(3)
    vector = lambda i: None if i == 7 else [1.0, None] if i == 8 else [1.0] if i == 9 else [math.nan, 1.0] if i == 10 else [draw.choice([0.5, 0.25, 0.123]), draw.choice([1.0, -1.0])]
    df = spark.createDataFrame([(i, "a" if i < 30 else "b" if i < 42 else None, vector(i if i < 30 else 99)) for i in range(44)], "id long, label string, v array<float>")
    left, right = df.selectExpr("id as l_id", "label", "v as lv"), df.selectExpr("id as r_id", "label", "v as rv")
    met = left.join(right, "label").filter("l_id <> r_id").withColumn("score", F.round(S.dot(F.col("lv"), F.col("rv")), 5))
    from pyspark.sql import Window

    want = met.withColumn("rank", F.row_number().over(Window.partitionBy("l_id").orderBy(F.col("score").desc(), F.col("r_id")))).filter("rank <= 15")
    got = B.dense_topk(left, right, ["label"], 15, 5)
    rows = lambda x: sorted((r.l_id, r.rank, r.r_id, str(r.score)) for r in x.collect())
    assert rows(got) == rows(want)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_normalize_classes_is_normalize(spark):
    rows = [(1, "Straße Gears Pvt. Limited", "12 Main St, Austin, TX 78701", "US"), (2, "Straße Gears Pvt. Limited", None, "US"), (3, None, "12 Main St, Austin, TX 78701", None), (4, "राम Ltd", "4th Cross Rd, Pune, Maharashtra 411 001", "India")]
    df = spark.createDataFrame(rows + [(r[0] + 4, *r[1:]) for r in rows], "id long, business_name string, business_address string, country string")
    want, got = X.normalize(df), X.normalize_classes(df)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_normalize_records_works_names_out_once(spark):
    from kinlink.plans import catalog

    plan = catalog.normalize_records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_business_name" in plan and "Aggregate [_business_address" in plan


def test_bucket_support_is_support(spark):
    rnd = random.Random(3)
    names = ["red bolt", "red gear", "big bolt", "zz", "red bolts", None]
    l = [(i, rnd.choice("ab"), rnd.choice(names)) for i in range(12)]
    r = [(100 + i, rnd.choice("abc"), rnd.choice(names)) for i in range(25)]
    left, right = spark.createDataFrame(l, "l_id long, key string, l_name string"), spark.createDataFrame(r, "r_id long, key string, r_name string")
    grams = X.char_grams(F.col("name"), 3)
    rows = right.withColumnsRenamed({"r_id": "id", "r_name": "name"})
    weights = B.idf(rows, "id", grams).filter("df >= 2")
    pairs = left.join(right, "key").withColumn("p1", 1 / (1 + F.levenshtein("l_name", "r_name")))
    want = C.support(pairs, C.right_similarities(pairs, B.postings(rows, ["id"], grams, weights).withColumnRenamed("id", "r_id")))
    got = C.bucket_support(left, right, B.postings(rows.filter("name is not null").select("name").distinct(), ["name"], grams, weights), ["key"])
    shown = lambda df: sorted((x.l_id, x.r_id, round(x.sup_max, 9), None if x.sup_w is None else round(x.sup_w, 9)) for x in df.collect())
    assert shown(got) == shown(want) and got.filter("sup_w is null").count() and got.filter("sup_max > 0").count()


def test_support_by_cosine_of_ids_that_repeat(spark, tmp_path):
    from kinlink.plans import catalog
    from kinlink.plans import records as R

    rnd = random.Random(4)
    words = ["red", "bolt", "gear", "old", "pin", "cog", "nut", "arm"]
    part = [(rnd.randrange(150), " ".join(rnd.sample(words, 2)), rnd.choice(["B#1", "B#2"]), "TIN", rnd.choice([1, 2])) for _ in range(120)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = catalog.support_by_cosine(spark, str(tmp_path))
    p = R.pairs(spark, str(tmp_path)).select("l_id", "r_id", (1 / (1 + F.levenshtein("l_name", "r_name"))).alias("p1"))
    want = C.support(p, catalog._right(spark, str(tmp_path))).select("l_id", "r_id", F.round("sup_max", 5).alias("sup_max"), F.round("sup_w", 4).alias("sup_w"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_bucket_fuse_labels_its_pairs(spark):
    rows, cols = [(1, "a"), (2, "a"), (3, "b")], "l_id long, addr string"
    left = spark.createDataFrame(rows, cols).selectExpr("l_id", "'us' as country", "'' as lpart", "'x' as text", "addr")
    right = spark.createDataFrame([(10, "a", [1]), (11, "a", None), (12, "b", [2, 3]), (13, "c", [1])], "r_id long, addr string, owners array<long>").selectExpr("r_id", "2 as src", "'us' as country", "'' as rpart", "'x' as text", "addr", "owners")
    tops = B.class_topk(left, right.withColumn("addrs", F.array("addr")).drop("addr"), spark.createDataFrame([("x", "x", 1.0)], "text string, gram string, w double"), 4)
    got = B.bucket_fuse(left, right, tops, ["country"], "name", "bucket", owners="owners")
    truth = spark.createDataFrame([(1, 10), (2, 12), (3, 12), (1, 13)], "l_id long, r_id long")
    want = B.label(got.select("l_id", "r_id"), truth).select("l_id", "r_id", "y")
    assert got.count() == 12 and sorted(map(tuple, got.select("l_id", "r_id", "y").collect())) == sorted(map(tuple, want.collect()))


def test_labels_are_made_without_a_shuffle_of_pairs(spark):
    from kinlink.plans import catalog

    plan = catalog.label_join(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("Generate explode")]


def test_per_labelled_is_per_record(spark):
    records = spark.createDataFrame([(1,), (2,), (3,), (4,)], "l_id long")
    truth = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "l_id long, r_id long")
    found = spark.createDataFrame([(1, 10), (1, 13), (3, 12), (1, 10)], "l_id long, r_id long")
    labelled = found.withColumn("y", ((F.col("l_id") == 1) & (F.col("r_id") == 10)).cast("int"))
    cols = ["l_id", "n_pred", "n_true", "tp", "f05"]
    want, got = M.per_record(records, found, truth), M.per_labelled(records, labelled, truth)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_recall_queries_shuffle_the_records_once(spark):
    """All tables of candidates are made of one shuffle of the records; links and their owners need the others."""
    from kinlink.llm.common import setting
    from kinlink.plans import catalog

    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        for query in (catalog.recall_by_view, catalog.recall_by_cap):
            plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan parquet") <= 5 and plan.count("ReusedExchange") >= 5


def test_models_of_classes_score_in_one_pass(spark):
    from kinlink.operators import model as G
    from kinlink.plans import catalog

    df = spark.range(1200).selectExpr("id % 90 as l_id", "id as r_id", "cast(id % 5 as int) as a", "if(id % 7 = 0, null, id % 3) as b", "cast(id % 5 > 2 as int) as y", "1.0D as weight")
    models = G.train_classes(df, ["a", "b"], 2, 2, 2)
    rows = lambda x: sorted((r.r_id, r.p) for r in x.collect())
    got = G.fold_scores(df, models, ["a", "b"], "p")
    assert rows(got) == rows(G.out_of_fold(df, models, ["a", "b"], "p"))
    assert min(r.p for r in got.filter("y = 1").collect()) > max(r.p for r in got.filter("y = 0").collect())
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    # pairs aren't joined with their records or labels, nor shuffled for their competition
    f = catalog._features(spark, "/root/testdata/sf0.001")
    assert {"country", "addr", "y"} <= set(f.columns)


def test_competition_of_repeated_keys_is_of_all_their_addresses(spark, tmp_path):
    from kinlink.plans import catalog

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    part.unionByName(part.filter("p_partkey = 3").withColumn("p_size", F.col("p_size") + 1)).write.parquet(f"{tmp_path}/part.parquet")
    assert catalog._dealt_by(spark, "/root/testdata/sf0.001") == ["country", "addr", "l_id"]
    assert catalog._dealt_by(spark, str(tmp_path)) == ["l_id"]


def _odd_parts(spark, path, again=()):
    """Few names and addresses, so that classes hold many records; some values are unknown, some keys repeat."""
    rnd = random.Random(7)
    names = ["red bolt", "red bolts", "old gear", "old red gear", "big  pin", "cog", "", None]
    part = [(None if i == 50 else i, rnd.choice(names), rnd.choice(["B#1", "B#1", None]), rnd.choice(["TIN", "LEAD", None]), rnd.choice([1, 2])) for i in range(240)]
    part += [(i, "red gear", "B#1", "TIN", 1) for i in again]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{path}/part.parquet")
    return str(path)


def _shown(df):
    cols = sorted(df.columns)
    return sorted((tuple(str(round(x, 9) if isinstance(x, float) else x) for x in r) for r in df.select("l_id", "r_id", *(c for c in cols if c not in ("l_id", "r_id"))).collect()))


def test_class_features_are_features_of_each_pair(spark, tmp_path):
    from kinlink.operators import features as P
    from kinlink.plans import catalog

    d = _odd_parts(spark, tmp_path)
    got, fused = catalog.all_pair_features(spark, d), catalog._fused(spark, d)
    want = P.with_competition(catalog._pair_features(spark, d, fused))
    assert sorted(got.dtypes) == sorted(want.dtypes)
    assert _shown(got) == _shown(want) and want.count() > 900
    assert fused.filter("v_addr is null").count() > 20  # some pairs are of one text but not of one address
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("Generate explode(l_id")] and "Window" not in plan[: plan.index("Generate explode(l_id")]  # pairs are made last


def test_all_pair_features_of_keys_that_repeat(spark, tmp_path):
    from kinlink.plans import catalog

    d = _odd_parts(spark, tmp_path, again=(3, 9, 4, 10, 10))
    rows = catalog.all_pair_features(spark, d).select("l_id", "r_id", "n_cand", "n_ratio", "len_n_l", "n_idf_jac").collect()
    held = {r.id: r.n for r in catalog.R.rec(spark, d).filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    pairs = {(r.l_id, r.r_id) for r in catalog._fused(spark, d).select("l_id", "r_id").collect()}
    assert len(rows) == sum(held[a] * held[b] for a, b in pairs) and {(r.l_id, r.r_id) for r in rows} == pairs
    assert any(held[a] > 1 and held[b] > 1 for a, b in pairs)  # was stopped by a map key that occurs twice
    assert all(r.n_cand == sum(held[a] * held[b] for a, b in pairs if a == r.l_id) for r in rows if r.l_id in (3, 9))


def _standing_batches(groups, whole):
    """What ``_with_standing`` gives back for one batch that holds all groups, without Spark."""
    from types import SimpleNamespace as Named

    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    from kinlink.operators import features as P

    rec, sums = pa.struct([("n_core", pa.string())]), pa.list_(pa.struct([("src", pa.int32()), ("n_tset", pa.float64()), ("a_tset", pa.float64()), ("n", pa.int64())]))
    cols = [("ids", pa.list_(pa.int64())), ("n", pa.int64()), ("sums", sums), ("rec", rec), ("n_core", pa.string()), ("a_street", pa.string()), *([("addr", pa.string())] if whole else [])]
    kind = {"ls": pa.list_(pa.struct(cols)), "rs": pa.list_(pa.struct([*cols, ("src", pa.int32())]))}
    batch = pa.RecordBatch.from_arrays([pa.array([g[k] for g in groups], kind[s]) for k, s in enumerate(kind)], list(kind))
    return P._with_standing(Named(schema=from_arrow_schema(batch.schema), mapInArrow=lambda run, _: list(run(iter([batch])))), whole)


def test_standing_is_given_back_a_few_rows_at_a_time(monkeypatch):
    from kinlink.operators import features as P

    rnd, words = random.Random(3), ["red", "old", "big", "bolt", "gear", "pin", ""]
    few = lambda: [{"src": rnd.choice([2, 3]), "n_tset": rnd.choice([None, 50.0, 100.0]), "a_tset": 80.0, "n": 2}] if rnd.random() < 0.5 else None
    one = lambda i: {"ids": list(range(i, i + 1 + i % 3)), "n": 1 + i % 3, "sums": few(), "n_core": (n := f"{rnd.choice(words)} {rnd.choice(words)}".strip()), "rec": {"n_core": n}, "a_street": rnd.choice(words), "addr": rnd.choice(["a", "b", None]), "src": rnd.choice([2, 3])}
    groups = [([one(i) for i in range(60)], [one(i) for i in range(90)]) for _ in range(5)]
    for whole in (False, True):
        done = _standing_batches(groups, whole)
        assert max(b.num_rows for b in done) <= P._ROWS
        rows = [r for b in done for r in b.to_pylist()]
        assert len(rows) == sum(not whole or r["addr"] is None or r["addr"] != l["addr"] for ls, rs in groups for l in ls for r in rs)
        with monkeypatch.context() as m:  # blocks of one left or right class, other batches
            m.setattr(P, "_CELLS", 7)
            m.setattr(P, "_ROWS", 5)
            again = _standing_batches(groups, whole)
        assert max(b.num_rows for b in again) <= 5 and str([r for b in again for r in b.to_pylist()]) == str(rows)  # a gap may be NaN here


def test_sums_of_classes_in_blocks_are_counts_of_pairs(monkeypatch):
    from kinlink.operators import features as P

    rnd, words = random.Random(5), ["red bolt", "old bolt", "gear", ""]
    one = lambda i: {"ids": None if i % 4 == 0 else [i], "n": 1 + i % 3, "n_core": rnd.choice(words), "a_street": rnd.choice(words), "src": rnd.choice([2, 3])}
    ls, rs = [one(i) for i in range(20)], [one(i) for i in range(30)]
    monkeypatch.setattr(P, "_CELLS", 7)
    score = lambda a, b, c: P.S._token_set(a[c], b[c]) if a[c] and b[c] else None
    for side, own, others in (("l", ls, rs), ("r", rs, ls)):
        got = dict(P._group_sums(ls, rs, side))
        assert set(got) == {k for k, r in enumerate(own) if side == "l" or r["ids"] is not None}
        for k, cols in got.items():
            want = Counter()
            for o in others:
                want[(o["src"] if side == "l" else -1, score(own[k], o, "n_core"), score(own[k], o, "a_street"))] += o["n"]
            assert {(s, None if a != a else a, None if b != b else b): n for s, a, b, n in zip(*(c.tolist() for c in cols))} == want
