import random

import corpus_pipeline as P
from kinlink.llm import common, registry

from .test_operators import cover, make_docs, odd_texts, prose  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    names = docs.columns
    kept = []
    for k, (_, stage) in enumerate(P.STAGES):
        before = docs
        docs = common.stage(spark, stage(spark, docs, SF), "test")
        if k < len(P.STAGES) - 1:
            assert docs.columns == names
        kept.append(docs.count())
        if k == 2:
            old = {r.doc_id: r.text for r in before.collect()}
            new = {r.doc_id: r.text for r in docs.collect()}
            for (i, t), (n, removed, _, _) in zip(old.items(), cover(list(old.values()))):
                assert (new[i] == t) == (removed == 0) and len(new[i].encode()) <= n - removed
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0
    assert P.run(spark, SF).count() == kept[-1]


def test_near_duplicates_keep_texts_that_share_an_id(spark):
    rng = random.Random(14)
    a, b, c, *own = (prose(rng, 60) for _ in range(20))
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [(1, a), (1, b), (0, near), (2, c), (2, c), (5, b), (None, a)] + [(7, t) for t in own] + [(8, None), (8, "")]
    got = P.drop_near_duplicates(spark, make_docs(spark, rows), SF).select("doc_id", "text").collect()
    expected = [(0, near), (1, b), (2, c), (None, a)] + [(7, t) for t in own] + [(8, None), (8, "")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_stages_on_odd_rows(spark, odd_texts):
    """Nulls, empty and long texts, repeated rows and columns whose names clash: every stage keeps what it should, and its columns."""
    rows = [*odd_texts, (None, "alone and without an id"), (7, None), (7, None)]
    docs = make_docs(spark, rows)
    for k, (name, stage) in enumerate(P.STAGES):
        out = common.stage(spark, stage(spark, docs, SF), "odd")
        got = [(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()] if k < len(P.STAGES) - 1 else None
        if got is None:
            assert {"doc_id", "source", "taken"} <= set(out.columns) and out.filter("doc_id = 7").count() == 0  # nothing to take
            break
        assert out.columns == docs.columns
        assert (None, "alone and without an id") in got and (7, None) in got
        if name in ("toxicity", "decontamination"):
            assert len(got) == len(rows)
        if name == "near_duplicates":
            assert got.count((0, rows[0][1])) == 1 and got.count((7, None)) == 2


def test_empty(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        common.table(spark, SF, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_registry_runs(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in registry.ORACLES.items():
        df = registry.QUERIES[name](spark, SF)
        got = con.sql(sql)
        order = df.columns
        assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(r[got.columns.index(c)] for c in order)) for r in got.fetchall())
