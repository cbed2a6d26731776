import collections
import hashlib
import math
import operator
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinlink.llm import blobs, common, decontam, graph, html_extract, katz, langid, minhash, mixing, quality, registry, suffix_dedup, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, n string, d1 string, _leaks string, u string, at string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def make_docs(spark, texts):
    """Texts as documents, with columns whose names clash with the operators' own."""
    rows = [(i, t, "en", None if (i or 0) % 5 == 4 else f"src{(i or 0) % 3}", len(t or ""), "x", "y", "z", "w", "v", "q", "r") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    a, b, long = prose(rng, 60), prose(rng, 120), prose(rng, 60_000)
    edited = a.split()
    edited[5] = "other"
    passage = prose(rng, 55)
    texts = [a, a, " ".join(edited), None, "", "  \t\n", "one two", "One  two", "one two three", b, long, long[: len(long) // 2], "é" * 300, "é" * 300, prose(rng, 30) + " " + passage + " " + prose(rng, 30), prose(rng, 20) + " " + passage, "ab" * 400, "wort " * 300]
    return [(i * 3, t) for i, t in enumerate(texts)] + [(0, a), (None, b), (None, None)]


def shingle_set(t, k=5):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else (frozenset([tuple(w)]) if w else frozenset())


def components_of(sets, percent):
    """Brute force: the least index reachable over links."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def edited(rng, base, edits, words):
    copy = list(base)
    for _ in range(edits):
        copy[rng.randrange(len(copy))] = "edit" + str(rng.randrange(words))
    return " ".join(copy)


def texts_with_copies(rng):
    for _ in range(40):
        base = prose(rng, rng.randrange(20, 150)).split()
        for _ in range(rng.randrange(1, 6)):
            yield edited(rng, base, rng.randrange(0, 4), 9)


def texts_under_the_threshold(rng):
    """Large groups whose members mostly lie just under the threshold, so that stars leave much to do."""
    for n in (40, 60, 90):
        base = prose(rng, n).split()
        for _ in range(60):
            yield edited(rng, base, 1 + n // 30, 40)


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("make", [texts_with_copies, texts_under_the_threshold])
def test_minhash_matches_brute_force(spark, make, percent):
    texts = list(make(random.Random(percent)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark, make_docs(spark, list(enumerate(texts))), percent=percent).collect()}
    sets = [shingle_set(t) for t in texts]
    assert got == {i: (len(sets[i]), c, c == i) for i, c in enumerate(components_of(sets, percent))}


@pytest.mark.parametrize("percent", [80, 85])
def test_meetings_lose_no_link(spark, percent):
    sets = [shingle_set(t) for t in texts_under_the_threshold(random.Random(percent + 1))]
    number = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    full = spark.createDataFrame([(i, [number[x] for x in s]) for i, s in enumerate(sets)], "id long, s array<long>")
    met = {(r.u, r.v) for r in minhash.meetings(full, spark.range(len(sets)).select("id", F.col("id").alias("c")), percent).collect()}
    linked = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    assert linked <= met and len(met) < 60 * 59 / 2


def test_minhash_takes_texts_that_share_an_id_each(spark):
    rng = random.Random(21)
    a, b = prose(rng, 40), prose(rng, 40)
    rows = [(5, a), (5, b), (5, a), (7, a.replace(a.split()[0], "other", 1)), (9, b), (9, b)]
    got = [(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark, make_docs(spark, rows), percent=85).collect()]
    assert sorted(got) == [(5, 5), (5, 5), (5, 5), (7, 5), (9, 5), (9, 5)]


def test_minhash_odd(spark, odd_texts):
    got = minhash.near_duplicates(spark, make_docs(spark, odd_texts), percent=85).collect()
    assert len(got) == len(odd_texts)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [r.component_id for r in by[0]] == [0, 0] and by[3][0].component_id == 0 and not by[3][0].kept
    assert all(by[i][0].n_shingles == 0 and by[i][0].component_id == i for i in (9, 12, 15))
    assert by[21][0].component_id == 18 and by[24][0].component_id == 24
    assert all(r.component_id is None and r.kept for r in by[None])
    assert minhash.near_duplicates(spark, make_docs(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(500, x) for x in range(501, 540)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in graph.components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert graph.components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_a_chain_take_few_rounds(spark, monkeypatch):
    rounds = []
    stage = common.stage
    monkeypatch.setattr(common, "stage", lambda s, df, name: rounds.append(name) or stage(s, df, name))
    got = graph.components(spark, spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")).collect()
    assert {r.component for r in got} == {0} and len(got) == 301 and rounds.count("moves") < 25


def cover(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    for b in raw:
        m = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                m[p : p + length] = b"\1" * length
        yield len(b), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(bytes(x for x, f in zip(b, m) if not f)).hexdigest()


def test_suffix_matches_brute_force(spark, odd_texts):
    rng = random.Random(8)
    passages = [prose(rng, n) for n in (30, 45, 60, 200)]
    extra = [(1000 + i, " ".join(prose(rng, rng.randrange(1, 80)) + " " + rng.choice(passages)[rng.randrange(40) :] for _ in range(rng.randrange(1, 4)))) for i in range(40)]
    rows = [x for x in odd_texts if x[0] != 30] + extra
    got = suffix_dedup.mark(spark, make_docs(spark, rows), with_text=True)
    assert set(DOCS.replace(" long", "").replace(" string", "").split(", ")) <= set(got.columns)
    found = sorted((str(r.doc_id), r.text or "", r._n_bytes, r._n_removed, r._n_spans, r._kept_sha256) for r in got.collect())
    assert found == sorted((str(i), t or "", *x) for (i, t), x in zip(rows, cover([t for _, t in rows])))
    assert suffix_dedup.mark(spark, make_docs(spark, [])).count() == 0


@pytest.mark.parametrize("bits", [64, 3])
def test_suffix_on_periodic_and_shifted_texts(spark, bits):
    """Periods shorter and longer than a gram, passages at other offsets, edges inside windows; with few bits all hashes are equal."""
    rng = random.Random(bits)
    a, b = prose(rng, 120), prose(rng, 120)
    unit = prose(rng, 12)
    texts = ["z" * 3000, "ab" * 900, unit * 12, unit * 3 + a, a[100:700] + b, b[:400] + "q" * 250 + a[:350], "z" * 199, "z" * 200, a + b, a[1:], "x" + a[:260] + "y" + a[200:460], "q" * 230 + "r" * 230, "r" * 215]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r._n_bytes, r._n_removed, r._n_spans, r._kept_sha256) for r in suffix_dedup.mark(spark, make_docs(spark, rows), block=1500, bits=bits).collect()}
    assert got == dict(enumerate(cover(texts)))


def test_periodic_text_makes_few_suffixes():
    raw = np.full(100_000, 97, np.uint8)
    start, n, _, _, content = suffix_dedup.segments(raw, np.array([0, len(raw)]), 200, 48)
    copy, first = suffix_dedup.settle(raw, start, n, content, 200)
    assert copy.all() and first.sum() == 1


def test_equal_hashes_do_not_settle():
    raw = np.frombuffer(("p" * 250 + "q" * 250 + "p" * 250).encode(), np.uint8)
    start, n = np.array([0, 250, 500]), np.array([51, 51, 51])
    copy, first = suffix_dedup.settle(raw, start, n, np.zeros(3, np.uint64), 200)
    assert copy.tolist() == [True, False, True] and first.tolist() == [True, True, False]


def test_multikey_quicksort():
    rng = random.Random(31)
    pool = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    rows = [(rng.choice(pool), rng.choice(pool)) for _ in range(700)]
    keys = suffix_dedup.Suffixes(pa.array([r for r, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.binary()))
    order, same = suffix_dedup.multikey_quicksort(keys, len(rows))
    got = [rows[i] for i in order]
    pad = lambda x: x + b"\0" * (-len(x) % 8 + 8 * (4 - -(-len(x) // 8)))
    assert got == sorted(rows, key=lambda x: (pad(x[0]), len(x[0]), pad(x[1]), len(x[1])))
    assert same.tolist() == [False] + [a == b for a, b in zip(got, got[1:])]


def test_suffix_pieces(monkeypatch, spark):
    rng = random.Random(9)
    a = prose(rng, 900)
    texts = [a, prose(rng, 300) + a[1000:5000] + prose(rng, 10), a[:300]]
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    raw = "".join(texts).encode()
    off = np.cumsum([0, *(len(t) for t in texts)])
    covered = set()
    for i, j, x, y in suffix_dedup._pieces(off, 200):
        start, n, *_ = suffix_dedup.segments(np.frombuffer(raw[x:y], np.uint8), np.clip(off[i : j + 1], x, y) - x, 200, 48)
        for s, k in zip(start, n):
            windows = set(range(x + s, x + s + k))
            assert not covered & windows
            covered |= windows
    assert covered == {p for a, b in zip(off, off[1:]) for p in range(a, b - 199)}


def test_suffix_anchor_hashes_fall_evenly_into_partitions():
    """Anchors are least hashes: as they are, most would meet in the first of 51 partitions."""
    raw = np.frombuffer(prose(random.Random(8), 40_000).encode(), np.uint8)
    _, _, _, g, _ = suffix_dedup.segments(raw, np.array([0, len(raw)]), 200, 48)
    sizes = np.bincount(blobs.place(np.unique(g), 51), minlength=51)
    assert len(g) > 2000 and sizes.max() < 2 * sizes.mean()


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=9), 1)], 0) for i in range(130)]
    rows[7] = (7, rows[6][1], 0)
    rows += [(200, None, 0), (220, [1.0, None], 0), (240, [1.0, float("nan")], 0), (260, [], 0), (280, [2.5], 0), (0, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(spark, df, F.col("vec_id") % 20 == 0, k=5, block_rows=40, chunk_queries=3).collect())
    q = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for a, (i, x) in enumerate(q):
        if i % 20 == 0:
            best = sorted((-sum(map(operator.mul, x, y)), j) for b, (j, y) in enumerate(q) if a != b)[:5]
            expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(expected)
    assert topk.search(spark, df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_topk_takes_all_rows_and_wide_components(spark, tmp_path):
    """The registered query: rows that share a vec_id all take part, and nothing is clipped."""
    rng = np.random.default_rng(5)
    rows = [(i % 41, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(90)]
    rows += [(100, [4e5, -1e6, 0.5, 0.0, 3e7, 1.0]), (101, [-7e5, 2e6, 0.0, 1.0, 1e7, 2.0]), (102, [2e9] + [0.0] * 5), (20, rows[20][1])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = collections.defaultdict(list)
    for r in topk.op3_topk(spark, str(tmp_path)).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    q = [[math.floor(64 * x) for x in v] for _, v in rows]
    expected = collections.defaultdict(list)
    for a, (i, _) in enumerate(rows):
        if i % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(q[a], q[b])), j) for b, (j, _) in enumerate(rows) if a != b)[:20]
            expected[i] += [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in expected.items()}


@pytest.mark.parametrize("large", [1e30, 5e8])
def test_topk_says_when_a_score_overflows(spark, tmp_path, large):
    rows = [(20, [large, 1.0]), (21, [large, 2.0]), (22, [1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    with pytest.raises(Exception, match="does not fit a long"):
        topk.op3_topk(spark, str(tmp_path)).collect()


def test_mixing(spark, odd_texts):
    rng = random.Random(2)
    rows = odd_texts + [(2000 + i, prose(rng, rng.randrange(1, 60))) for i in range(200)]
    docs = make_docs(spark, rows)
    one, two = (mixing.mix(spark, docs.repartition(k), quality=mixing.doc_quality(F.col("text"))).select("doc_id", "source", "size", "source_size", "target", "taken").collect() for k in (2, 5))
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == len(rows)
    per = collections.defaultdict(list)
    for r in one:
        assert 0 <= r.taken <= 3 * r.size
        per[r.source].append(r)
    assert None in per
    for own in per.values():
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
    total = sum(r.size for r in one)
    assert abs(sum(own[0].target for own in per.values()) - total) < 1e-6
    assert mixing.mix(spark, make_docs(spark, [])).count() == 0


class Katz:
    """Brute force of the model, from its definition."""

    def __init__(self, texts, order, top=5):
        self.top, self.order = top, order
        self.grams = [collections.Counter() for _ in range(order)]
        for t in texts:
            padded = ["<s>"] * (order - 1) + t
            for n in range(order):
                self.grams[n].update(tuple(padded[i - n : i + 1]) for i in range(order - 1, len(padded)))
        self.total = sum(self.grams[0].values())
        counts = [np.bincount([min(c, top + 2) for c in g.values()], minlength=top + 3)[: top + 2] for g in self.grams]
        self.d = [katz.discounts(n, top) for n in counts]
        self.follow = [collections.defaultdict(dict) for _ in range(order)]
        for n, g in enumerate(self.grams):
            for x, c in g.items():
                self.follow[n][x[:-1]][x[-1]] = c
        used = sum(self.taken(0, c) for c in self.grams[0].values())
        self.scale = self.total / (self.total + 1) if used >= self.total - 1e-9 else 1.0
        self.unseen = max(1.0, counts[0][1] * (counts[0][1] - 1) / (2 * (counts[0][2] + 1)))
        self.memo = {}

    def taken(self, n, c):
        return (self.d[n][c] if c <= self.top else 1) * c

    def seen(self, h):
        """What each word seen after h has of its mass."""
        own = self.follow[len(h)].get(h, {})
        if not h:
            return {w: self.scale * self.taken(0, c) / self.total for w, c in own.items()}
        n, used = sum(own.values()), {w: self.taken(len(h), c) for w, c in own.items()}
        over = n if sum(used.values()) < n - 1e-9 else n + 1
        return {w: x / over for w, x in used.items()}

    def all(self, h):
        """P(w | h) of all known words and, under None, of each unknown one."""
        if h not in self.memo:
            own = self.seen(h)
            if not h:
                out = own | {None: (1 - sum(own.values())) / self.unseen}
            else:
                below = self.all(h[1:])
                alpha = (1 - sum(own.values())) / (1 - sum(below[w] for w in own)) if own else 1.0
                out = {w: own.get(w, alpha * p) for w, p in below.items()}
            self.memo[h] = out
        return self.memo[h]

    def score(self, t):
        padded = ["<s>"] * (self.order - 1) + t
        return sum(math.log10(d.get(w, d[None])) for i, w in enumerate(t) for d in [self.all(tuple(padded[i : i + self.order - 1]))])


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_matches_brute_force(spark, order):
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice(WORDS[: rng.randrange(2, 12)]) for _ in range(rng.randrange(1, 40)))) for i in range(150)] + [(500, None), (501, ""), (None, "alpha beta"), (502, "Unseen WORDS only"), (1, "alpha alpha"), (503, "beta " * 70)]
    docs = make_docs(spark, texts)
    got = katz.score(spark, docs, F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False)), order=order, block=2000, slice_keys=30).collect()
    assert len(got) == len(texts)
    toks = [((t or "").lower().split() + ["</s>"], i is not None and zlib.crc32(str(i).encode()) % 7 == 2, i) for i, t in texts]
    model = Katz([t for t, held, _ in toks if not held], order)
    uni, total = model.grams[0], model.total
    scores = [model.score(t) for t, _, _ in toks]
    for p in model.memo.values():  # sums to 1 over known and unknown words
        assert abs(sum(p.values()) + (model.unseen - 1) * p[None] - 1) < 1e-9
    known = lambda t: sum((w,) in uni for w in t)
    base = lambda t: sum(math.log10((uni[w,] + 1) / (total + len(uni) + 1)) for w in t)
    expected = sorted((str(i), held, len(t), known(t), total, round(base(t), 6), round(s, 6)) for (t, held, i), s in zip(toks, scores))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == expected


def test_katz_tables_hold_all_counts(spark):
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice(WORDS[:6]) for _ in range(rng.randrange(1, 30)))) for i in range(80)]
    _, tables = katz.fit_and_score(spark, make_docs(spark, texts), F.lit(False), block=500, slice_keys=20)
    rows = katz.ngrams(tables).collect()
    model = Katz([t.split() + ["</s>"] for _, t in texts], 3)
    for order in (2, 3):
        own = [r for r in rows if r.order == order]
        assert len({(tuple(r.history), r.word) for r in own}) == len(own)
        assert sorted(r.n for r in own) == sorted(model.grams[order - 1].values())
        per = collections.Counter()
        for r in own:
            per[tuple(r.history)] += r.n
        assert sorted(per.values()) == sorted(sum(x.values()) for x in model.follow[order - 1].values())


def test_katz_without_training_rows(spark):
    assert katz.score(spark, make_docs(spark, []), F.lit(False)).count() == 0
    got = katz.score(spark, make_docs(spark, [(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert [(r.train_tokens, r.n_known, r.score) for r in got] == [(0, 0, 0.0)] * 2


def test_katz_does_not_favour_unknown_words(spark):
    got = katz.score(spark, common.table(spark, "/root/testdata/sf0.001", "documents"), toxicity.fold(7) == 2)
    each = {r.held_out: r for r in got.groupBy("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("own"), (F.sum("base_score") / F.sum("n_tokens")).alias("base")).collect()}
    assert each[True].own < each[False].own and each[False].own > each[False].base


def test_toxicity_finds_sentences(spark, odd_texts):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        parts = [prose(rng, 8) + "." for _ in range(6)]
        if bad:
            parts[3] = "you " + rng.choice(["vile", "rotten"]) + " thing."
        rows.append((i, " ".join(parts)))
        labels.append((i, 1, int(bad)))
    labels += [(None, 1, 1), (5, None, None), (9999, 1, 1)]
    docs, lab = make_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    w = toxicity.fit(spark, docs, lab, toxicity.fold(3) != 1)
    got = toxicity.score(spark, docs.unionByName(make_docs(spark, odd_texts)), w).collect()
    assert len(got) == len(rows) + len(odd_texts)
    for r in got[: len(rows)]:
        assert r.predicted == int(r.doc_id % 4 == 0)
        if r.predicted:
            assert b"thing" in r.text.encode()[r.worst_start : r.worst_end]
    assert all(0 <= r.score <= 1 for r in got) and all(r.score == 0 for r in got if not (r.text or "").strip())
    empty = toxicity.fit(spark, docs.limit(0), lab.limit(0), F.lit(True))
    assert toxicity.score(spark, docs.limit(3), empty).filter("predicted = 1").count() == 0


def test_long_text_is_scored_whole():
    w = (np.sort(np.array([toxicity.sentences(np.frombuffer(b"vile", np.uint8))[0][0]])), np.array([20.0], np.float32), -7.0)
    text = ("word " * 300_000 + ". vile").encode()
    p, n, worst, a, b = toxicity.score_text(np.frombuffer(text, np.uint8), w)
    assert p > 0.9 and text[a:b] == b"vile"


@pytest.mark.parametrize("gap", [" word", "", " ", "x"])
def test_long_sentence_is_scored_whole(gap):
    """Two words that only together offend, in one sentence of over a megabyte."""
    of = lambda t: int(toxicity.sentences(np.frombuffer(t.encode(), np.uint8))[0][0])
    pair = sorted([of("vile"), of("rotten")])
    w = (np.array(pair), np.array([4.0, 4.0], np.float32), -7.0)
    scored = lambda t: toxicity.score_text(np.frombuffer(t.encode(), np.uint8), w)
    short, long = scored("vile rotten"), scored("vile " + (gap * (1_300_000 // len(gap)) if gap else "") + " rotten")
    assert short[:3] == long[:3] and short[1] == 1 and long[4] > (1_200_000 if gap else 0)


def test_sentences_do_not_depend_on_pieces():
    rng = random.Random(23)
    for _ in range(60):
        text = "".join(rng.choice(["ab", "c ", ". ", "!", "\n", " ", "dd e", ",", "fghijklmnop"]) for _ in range(rng.randrange(0, 60)))
        raw = np.frombuffer(text.encode(), np.uint8)
        whole = [x.tolist() for x in toxicity.sentences(raw)]
        for piece in (1, 2, 5, 16):
            assert [x.tolist() for x in toxicity.sentences(raw, piece=piece)] == whole


def test_decontamination(spark, odd_texts):
    rng = random.Random(11)
    items = [prose(rng, n) for n in (12, 25, 40)] + ["short one", "", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    edited = items[2].split()
    for k in range(0, 40, 7):
        edited[k] = "changed"
    del edited[10]
    rows = [(1, prose(rng, 50) + " " + items[0].upper() + ", " + prose(rng, 20)), (2, prose(rng, 9) + " " + " ".join(edited) + " " + prose(rng, 9)), (3, prose(rng, 200)), (4, "a short one here"), (5, items[1][: len(items[1]) // 4] + prose(rng, 40))]
    found = {r.doc_id: [x.item_id for x in r._leaks] for r in decontam.mark(spark, make_docs(spark, rows), bench, chunk=100).collect()}
    assert found == {1: [0], 2: [2], 3: [], 4: [3], 5: []}
    assert decontam.mark(spark, make_docs(spark, odd_texts), bench).filter(F.size("_leaks") > 0).count() == 0
    assert decontam.mark(spark, make_docs(spark, rows), bench.limit(0)).filter("_leaks is not null").count() == 0
    assert decontam.mark(spark, make_docs(spark, []), bench).count() == 0


@pytest.mark.parametrize("step", [4, 5, 6])
def test_decontamination_finds_many_edited_copies(spark, step):
    """Copies with every step-th word changed, in far more than a thousandth of the documents."""
    rng = random.Random(step)
    items = [prose(rng, n) for n in (18, 24, 38)]
    rows = [(i, prose(rng, 60)) for i in range(100)]
    for i in range(30):
        words = items[i % 3].split()
        words[step - 1 :: step] = [f"changed{i}x{k}" for k in range(len(words) // step)]
        rows.append((1000 + i, prose(rng, 30) + " " + " ".join(words) + " " + prose(rng, 30)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {r.doc_id: [x.item_id for x in r._leaks] for r in decontam.mark(spark, make_docs(spark, rows), bench).collect()}
    assert found == {i: [(i - 1000) % 3] if i >= 1000 else [] for i, _ in rows}


def test_alignment_matches_dynamic_programme():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
        best, start, end = decontam.located(np.array(a), np.array(b))
        assert best == decontam.align(np.array(a), np.array(b))[0] == max(max(x) for x in h)
        assert best == decontam.align(np.array(a), np.array(b[start:end]))[0] and (not best or b[start] in a and b[end - 1] in a)


def test_decontamination_matches_aligning_every_pair(spark):
    """Copies with 5 to 40 words in a hundred changed, left out or added, against the alignment of every item with every whole text."""
    rng = random.Random(41)
    items = [prose(rng, n).split() for n in (6, 12, 20, 30, 45, 60)]
    rows = []
    for i in range(150):
        own, rate = rng.choice(items), rng.choice([0.05, 0.15, 0.25, 0.4])
        copy = [w for x in own for w in ([x] if rng.random() > rate else rng.choice([[], ["other"], [x, "more"]]))]
        rows.append((i, " ".join([*prose(rng, rng.randrange(40)).split(), *copy, *prose(rng, rng.randrange(40)).split()])))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, x.item_id): (x.score, x.word_start, x.word_end) for r in decontam.mark(spark, make_docs(spark, rows), bench).collect() for x in r._leaks}
    number = collections.defaultdict(lambda: len(number))
    code = lambda words: np.array([number[w] for w in words])
    expected = {}
    for i, t in rows:
        for k, own in enumerate(items):
            best, _, end = decontam.align(code(own), code(t.split()))
            if best >= len(own):
                expected[i, k] = best / (2 * len(own)), end
    assert set(got) <= set(expected) and len(got) >= 0.9 * len(expected) and len(expected) > 100
    assert all(abs(got[x][0] - expected[x][0]) < 1e-9 for x in got)
    planted = decontam.mark(spark, make_docs(spark, [(1, prose(rng, 100) + " " + " ".join(items[3]) + " " + prose(rng, 20))]), bench).first()._leaks[0]
    assert (planted.word_start, planted.word_end) == (100, 130)


def test_quality(spark, odd_texts):
    rng = random.Random(12)
    rows = [(i, prose(rng, 60) if i % 3 else "BUY NOW!! " * 40) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = make_docs(spark, rows)
    model = quality.fit(spark, docs, labels, toxicity.fold(3) != 1)
    got = quality.posterior(spark, docs.unionByName(make_docs(spark, odd_texts)), model, "source", "lang").collect()
    assert len(got) == len(rows) + len(odd_texts)
    plain = quality.posterior(spark, docs, model, "source", "lang").collect()
    assert len(plain) == 300 and sum(r.kept != (r.doc_id % 3 > 0) for r in plain) <= 3
    assert all(0 <= r.score <= 1 for r in got)
    blank = quality.fit(spark, docs, labels.limit(0), F.lit(True))
    assert {r.evidence for r in quality.posterior(spark, docs, blank, "source", "lang").collect()} == {0.5}
    assert quality.posterior(spark, make_docs(spark, []), model, "source", "lang").count() == 0


def test_quality_reads_distinct_words_of_whole_texts():
    rng = random.Random(15)
    clean = [f"w{i}" for i in range(200)]
    share = lambda words: quality.features(np.frombuffer(" ".join(words).encode(), np.uint8))[5]
    assert share(clean) == 1 and share(clean + ["buy"] * 400) < 0.6
    for n in (1, 2, 199, 200, 201, 650):
        words = [rng.choice(clean[:90]) for _ in range(n)]
        runs = [words[i : i + 200] for i in range(max(1, n - 199))]
        assert abs(share(words) - sum(len(set(r)) / len(r) for r in runs) / len(runs)) < 1e-12


def test_quality_shrinks_sparse_groups(spark):
    sums = spark.createDataFrame([("a", 1000, 100.0, 60.0), ("b", 1000, 900.0, 850.0), ("c", 1, 1.0, 1.0)], "g string, n long, s double, ss double")
    got = {r.g: r["mean"] for r in quality.shrink(sums, ["g"], F.lit(0.5)).collect()}
    assert abs(got["a"] - 0.1) < 0.01 and abs(got["b"] - 0.9) < 0.01 and got["c"] < 1.0


def test_quality_posterior_matches_brute_force(spark):
    rng = random.Random(61)
    rows = [(i, rng.choice(["buy NOW!! " * rng.randrange(1, 9), prose(rng, rng.randrange(5, 60))]), rng.choice("abc"), rng.choice(["x", "y", None]), rng.choice(["p", None])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, l0 string, l1 string, l2 string")
    model = quality.train(np.stack([quality.features(np.frombuffer(t.encode(), np.uint8)) for _, t, *_ in rows]), np.array(["buy" not in t for _, t, *_ in rows], float))
    got = {r.doc_id: r for r in quality.posterior(spark, df, model, "l0", "l1", "l2").collect()}
    e = quality.evidence(np.stack([quality.features(np.frombuffer(t.encode(), np.uint8)) for _, t, *_ in rows]), model)
    base, means = e.mean(), {(): e.mean()}
    for depth in (1, 2, 3):
        groups = collections.defaultdict(list)
        for x, (_, _, *levels) in zip(e, rows):
            groups[tuple(levels[:depth])].append(x)
        within = sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups.values()) / max(1, len(e) - len(groups))
        between = sum(len(g) * (np.mean(g) - means[k[:-1]]) ** 2 for k, g in groups.items()) / len(e)
        pseudo = min(1e4, max(1.0, within / between))
        means |= {k: (sum(g) + pseudo * means[k[:-1]]) / (len(g) + pseudo) for k, g in groups.items()}
    logit = lambda p: math.log(p / (1 - p))
    for x, (i, _, *levels) in zip(e, rows):
        z = logit(x) + logit(means[tuple(levels)]) - logit(base)
        assert abs(got[i].score - 1 / (1 + math.exp(-z))) < 1e-9 and np.allclose(got[i].means, [means[tuple(levels[:d])] for d in (1, 2, 3)])


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES["op4_quality"](spark, sf)
    labels = common.table(spark, sf, "labels").filter(toxicity.fold(3) == 1).select("doc_id", F.col("quality").alias("y"))
    rows = [(r.score, r.y) for r in got.join(labels, "doc_id").collect()]
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9 and len(rows) > 100
    assert got.count() == sum(common.table(spark, sf, t).count() for t in ("documents", "pages"))


def test_addresses(spark):
    urls = ["https://A.example.org/en/5/x?q=1#t", "http://u@b.example.org:80", "http://c.example.org/one", "nonsense", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [tuple(r) for r in df.select(*quality.address(F.col("url"))).collect()] == [("a.example.org", "en", "en/5"), ("b.example.org", None, None), ("c.example.org", "one", None), (None, None, None), (None,) * 3]


def test_mixing_with_uneven_quality_and_equal_rows(spark):
    rng = random.Random(71)
    rows = [(i, prose(rng, rng.randrange(1, 30))) for i in range(300)] + [(7, "the same row")] * 5000 + [(None, None)] * 40
    docs = make_docs(spark, rows)
    got = mixing.mix(spark, docs, quality=F.pow(F.lit(10.0), -(F.coalesce("doc_id", F.lit(0)) % 4)), keep=("lang",)).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    per = collections.defaultdict(list)
    for r in got:
        per[r.source].append(r)
    assert all(abs(sum(r.taken for r in own) - own[0].target) <= 1 for own in per.values())


def test_langid_held_out(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    langs, table = langid.fit(spark, docs, toxicity.fold(3) != 1)
    pages = spark.createDataFrame(
        [(1, "http://a.de/x", '<html lang="de"><p>der und die nicht einverung</p>'), (2, None, None), (3, "bad url", ""), (4, "https://h.fr/fr/1", '<html lang="FR"></html>')], "page_id long, url string, html string"
    )
    null = lambda kind: F.lit(None).cast(kind)
    rows = docs.filter(toxicity.fold(3) == 1).select("doc_id", null("long").alias("page_id"), "text", F.lit(False).alias("is_html"), null("string").alias("declared"), F.col("source").alias("host"), null("string").alias("suffix"), null("string").alias("code"))
    more = langid.evidence(pages).select(null("long").alias("doc_id"), "page_id", F.col("html").alias("text"), F.lit(True).alias("is_html"), "declared", "host", "suffix", "code")
    got = langid.identify(spark, rows.unionByName(more), langs, table, ["doc_id", "page_id"])
    truth = docs.select("doc_id", F.col("lang").alias("truth"))
    acc = got.filter("doc_id is not null").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("truth")).cast("int"))).first()[0]
    assert acc > 0.98
    assert {r.page_id for r in got.filter("page_id is not null and lang is not null and prob > 0").collect()} == {1, 2, 3, 4}
    assert langid.identify(spark, rows.limit(2), [], table[:0], ["doc_id"]).filter("lang is null").count() == 2


def test_langid_cases(spark):
    rng = random.Random(51)
    vocabulary = {"en": "the and with from this that".split(), "de": "der und mit von dies dass".split()}
    docs = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(20)), lang, "src0", 0, *"xyzwvqr") for i in range(60) for lang in [["en", "de"][i % 2]]]
    docs += [(3, docs[3][1], "de", None, 0, *"xyzwvqr"), (None, "der und", "de", "", 0, *"xyzwvqr"), (70, None, None, "src1", 0, *"xyzwvqr"), (71, "", "en", "src1", 0, *"xyzwvqr"), (72, "mit " * 400_000, None, "src2", 0, *"xyzwvqr")]
    df = spark.createDataFrame(docs, DOCS)
    langs, table = langid.fit(spark, df, F.lit(True))
    assert langs == ["de", "en"] and table.shape == (2, 1 << langid.BITS)
    null = lambda: F.lit(None).cast("string")
    rows = df.select("doc_id", "text", F.lit(False).alias("is_html"), null().alias("declared"), F.col("source").alias("host"), null().alias("suffix"), null().alias("code"))
    got = langid.identify(spark, rows, langs, table, ["doc_id"]).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == len(docs) and all(by[i][0].lang == ["en", "de"][i % 2] for i in range(60))
    assert [r.lang for r in by[3]] == ["de", "de"] and by[None][0].lang == by[72][0].lang == "de"
    assert by[70][0].text_lang is None and by[71][0].text_lang is None and 0 < by[70][0].prob < 1
    tie = langid.identify(spark, rows.filter("doc_id = 71"), langs, table, ["doc_id"]).first()  # nothing speaks for either
    assert (tie.lang, tie.prob) == ("de", 0.5)
    assert langid.identify(spark, rows.limit(0), langs, table, ["doc_id"]).count() == 0
    assert langid.fit(spark, df.limit(0), F.lit(True))[0] == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p><article>";</script></head><body class="has-sidebar"><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><h1>Head &amp; line</h1><p><b>First&nbsp;para <i>graph</i><br>goes   on<p class="ad">Buy!</p><p>Second &lt;para&gt;</p><aside>More</aside>
<ul><li>one<li>two</ul><form><input value="x"><label>Mail</label></form><section id="comments"><p>Reader says</p></section></article></main><footer>&copy; us</footer></body></html>"""


def unmarked(page):
    return re.sub("</?(main|article)>", "", page)


def test_html():
    w = html_extract.learn([PAGE])
    expected = "Head & line\nFirst para graph goes on\nSecond <para>\none\ntwo"
    assert html_extract.extract(PAGE, w) == html_extract.extract(unmarked(PAGE), w) == expected
    assert html_extract.extract(None, w) == html_extract.extract("", w) == html_extract.extract("<nav>a b c</nav>", w) == ""
    assert html_extract.extract("just  text", w) == "just text"
    assert html_extract.extract("<p>a < b and c</p><p", w).startswith("a < b and c")
    long = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    assert html_extract.extract(long, w).count("\n") == 49_999


@pytest.mark.parametrize(
    "part",
    [
        '<p style="overflow:hidden">{}</p>', '<p title="the hidden cost">{}</p>', '<div data-id="comments">{}</div>', '<div class="no-ads">{}</div>', '<div id="related-work">{}</div>',
        '<div id="search-methods">{}</div>', '<div class="share-price-chart">{}</div>', '<div class="page no-sidebar"><div>{}</div></div>', "<ul><li>{}<li>more</ul>", "<p><a href=x>{}</a></p>", "<table><tr><td>{}</table>",
    ],
)
def test_html_keeps(part):
    w = html_extract.learn([PAGE])
    page = f"<html><body class='has-sidebar'><nav>a menu</nav><article><h1>One</h1><p>First words here.</p>{part.format('kept text here')}<p>Last.</p></article></body></html>"
    lines = html_extract.extract(page, w).split("\n")
    assert "kept text here" in lines and lines[0] == "One" and lines[-1] == "Last."


@pytest.mark.parametrize(
    "part",
    ['<div class="ad">{}</div>', "<aside>{}</aside>", "<form>{}</form>", '<section id="comments"><p>{}</p></section>', '<div class="ad-slot">{}</div>', '<div class="cookie-notice">{}</div>', "<div role=navigation>{}</div>", "<div hidden>{}</div>", "<nav>{}</nav>", "<script>{}</script>", "<!-- {} -->"],
)
def test_html_leaves_out(part):
    w = html_extract.learn([PAGE])
    page = f"<html><body><article><h1>One</h1><p>First words are here.</p>{part.format('other text here ' * 60)}<p>Last words are here.</p></article></body></html>"
    for x in (page, unmarked(page)):
        assert html_extract.extract(x, w) == "One\nFirst words are here.\nLast words are here."


def test_html_region_matches_all_ranges():
    rng = random.Random(17)
    for _ in range(300):
        scores = [rng.choice([-3, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(rng.randrange(0, 14))]
        a, b = html_extract.region(scores)
        best = max([0, *(sum(scores[i:j]) for j in range(len(scores) + 1) for i in range(j))])
        assert sum(scores[a:b]) == best and (best > 0 or a == b)


def test_html_scan_finds_marked_text_of_held_out_pages(spark):
    """Weights learned from half the pages, without any prior, find the article of the others with the marking taken away."""
    pages = [r.html for r in common.table(spark, "/root/testdata/sf0.01", "pages").orderBy("page_id").collect()]
    w, held = html_extract.learn(pages[::2], prior=False), pages[1::2]
    found = [html_extract.extract(unmarked(p), w) for p in held]
    marked = [html_extract.extract("<article>" + re.search("<article>(.*)</article>", p, re.S)[1] + "</article>", w) for p in held]
    assert all(marked) and sum(a == b for a, b in zip(found, marked)) >= 0.95 * len(held)
    # without sections, classes and marking, words and tags alone lose nothing of it
    soup = [re.sub(r"<(/?)(nav|footer)>", r"<\1div>", unmarked(p)).replace(' class="ad"', "") for p in held]
    assert all(set(b.split("\n")) <= set(html_extract.extract(p, w).split("\n")) for p, b in zip(soup, marked))


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html_extract.extract_pages(spark, pages, html_extract.fit(pages)).collect()
    assert [r.n_chars for r in got] == [len(r.text) for r in got] and got[2].text == "" and got[0].text == got[1].text != ""
    assert html_extract.extract_pages(spark, pages.limit(0), html_extract.fit(pages.limit(0))).count() == 0
    one, many = html_extract.fit(pages), html_extract.learn([PAGE])
    assert one.marks == many.marks and one.tags == many.tags
