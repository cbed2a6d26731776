"""Language-model scoring: a Katz back-off model with Good-Turing discounts.

Tokens are lower-cased words and one end; a text is preceded by starts.  With h the last
``order`` - 1 tokens and h' = h without its first,

    P(w | h) = d(c) * c(h, w) / c(h)    if the training rows hold h, w
             = alpha(h) * P(w | h')     if they hold h, but not with w
             = P(w | h')                otherwise
    P(w)     = d(c) * c(w) / N          if w is known
             = what is left / U         for each of U unknown words

d are Katz' Good-Turing discounts of each order (counts over ``top`` are taken as they are; none
is cut off), and alpha makes the probabilities after every history sum to exactly 1 over the
known words and the U unknown ones.  U is Chao's estimate of the words not seen yet, from those
seen once and twice, so an unknown word isn't credited with what all of them have together.  If a
history's counts are all too large to be discounted, one more count is set aside for the unseen.

How it runs.  Texts are packed into blocks of about ``block`` bytes: sorted distinct word
hashes and the tokens as positions in them, staged once.  Then, order by order, counts meet in
partitions: each block sends a partition one compressed slice of its distinct n-grams (word
ids, its own count, and the count of the n-gram without its first word); the partition merges
the slices to the model's table of those histories and answers each block with what it asked
for: the count of each n-gram, and of each history how many followers have each count, at this
order and below.  The tables are staged by partition (``ngrams`` reads them); the answers are
staged with the blocks they are for.  Discounts are known when an order is done, so from these
a block evaluates its own tokens, recursively from the highest order down.

Nothing is broadcast but a few counts of counts and, for each order, the histories that more
than one ``parts``-th of all tokens follow (so fewer than partitions); their n-grams are dealt out
by word too, and their sums added up over partitions.  Blocks and answers are joined in several
passes, so that what one pass has shuffled is gone before the next.

Cases.  Null or empty text: its one token is the end.  Null doc_id: scored; whether it is
learned from is the caller's column (null: learned from).  Repeated rows count and are scored
each.  No training rows: N = V = 0, every token unknown, score 0 (P = 1).  Texts of any
length are whole in one block.  Extra columns of any name do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .blobs import ask, bundle, ints, pack, place, unbundle, unpack
from .bytesops import mix, slices, words_of

_U = np.uint64
END = _U(0x656E642D6F662D74)
#: Rows of a staged order: statistics, answers, partial sums of frequent histories, tables.
STATS, ANSWER, HEAVY, TABLE = range(4)
ROW = "block long, kind int, part long, data binary"


def discounts(n: np.ndarray, top: int) -> np.ndarray:
    """d[r] for r <= top from counts of counts n[1..top + 1]; 1 above.  Falls back to (r - 1/2) / r where Good-Turing fails."""
    d = np.ones(top + 2)
    rest = (top + 1) * n[top + 1] / n[1] if n[1] else 0.0
    for r in range(1, top + 1):
        good = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        x = (good - rest) / (1 - rest) if rest < 1 else 0.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


def unseen(n: np.ndarray) -> float:
    """Chao's estimate of how many words the training rows don't hold, from how many they hold once and twice."""
    return max(1.0, n[1] * (n[1] - 1) / (2 * (n[2] + 1)))


# blocks


def _blocks(size: int):
    def run(batches):
        task, k = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        for batch in batches:
            for part in slices(batch, "text", size):
                w, _, n = words_of(part.column("text"))
                end = np.cumsum(n + 1) - 1
                token = np.empty(len(w) + len(n), _U)
                is_end = np.zeros(len(token), bool)
                is_end[end] = True
                token[is_end], token[~is_end] = END, w
                held = np.asarray(part.column("held").fill_null(False).to_numpy(zero_copy_only=False), bool)
                words, at = np.unique(token, return_inverse=True)
                count = np.bincount(at, np.repeat(~held, n + 1), minlength=len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([task << 32 | k], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id")),
                        *(pa.array([x], pa.binary()) for x in (pack(held), pack(n + 1), pack(words, True), pack(count), pack(at))),
                        *(pa.array([x], pa.int64()) for x in (len(words), len(token), int(count.sum()))),
                    ],
                    names=["block", "doc_ids", "held", "n", "words", "counts", "tokens", "n_words", "n_tokens", "n_train"],
                )
                k += 1

    return run


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(("block", "kind", "part", "data"), kinds))})


def _ids(total: np.ndarray, parts: int, part: int) -> np.ndarray:
    """Ids from 1, unlike those of other partitions; frequent ones are small, which packs well."""
    rank = np.empty(len(total), np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
    return rank * parts + part + 1


def _stats(total: np.ndarray, often: list[np.ndarray], top: int, part: int) -> tuple:
    """Counts of counts, sum and number of all counts, and the n-grams that are frequent (their words, one array each)."""
    return -1, STATS, part, bundle(np.r_[np.bincount(np.minimum(total, top + 2), minlength=top + 3)[: top + 2], total.sum(), (total > 0).sum()], *often)


def _merge_words(parts: int, top: int, heavy: int):
    def run(key, table):
        part = key[0].as_py()
        asked = [unpack(x, True) for x in table["words"].to_pylist()]
        count = np.concatenate([ints(x) for x in table["counts"].to_pylist()])
        words, at = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(at, count, minlength=len(words)).astype(np.int64)
        ids = _ids(total, parts, part)
        rows, k = [_stats(total, [ids[total >= heavy]], top, part)], 0
        for block, own in zip(table["block"].to_pylist(), asked):
            i = at[k : k + len(own)]
            rows.append((block, ANSWER, part, bundle(ids[i], total[i])))
            k += len(own)
        return _rows(rows)

    return run


# orders above the first


class Order:
    """The distinct n-grams of a block, by history and word (places of n - 1-grams and words; 0: only starts), and the n-gram of each token.

    Places of words are in order of their ids, so n-grams are in order of the ids of their words.
    """

    def __init__(self, history: np.ndarray, word: np.ndarray, before: Order | None, words: int):
        below = before.gram if before else word
        self.keys, at = np.unique(history * words + word, return_inverse=True)
        self.history, self.word = self.keys // words, self.keys % words
        self.gram = at + 1
        self.below = np.zeros(len(self.keys) + 1, np.int64)
        self.below[self.gram] = below  # without its first token
        start = lambda x: np.r_[0, x]
        self.path = [*(start(x[self.history]) for x in before.path), start(self.word)] if before else [start(self.history), start(self.word)]
        self.count = self.taken = None


class Block:
    """A block's tokens, with what the orders done so far have answered."""

    def __init__(self, row: dict, plan: Plan):
        self.n, self.held = ints(row["n"]), unpack(row["held"]).astype(bool)
        self.ids, self.count, self.word = unbundle(row["words"])
        self.first = np.cumsum(self.n) - self.n
        self.orders: list[Order] = []
        for data in row["orders"]:
            last = self.next()
            last.count, *taken = unbundle(data)
            last.taken = [x.view(np.float64) for x in taken]

    def next(self) -> Order:
        """Adds the n-grams of one more order."""
        last = self.orders[-1] if self.orders else None
        gram = last.gram if last else self.word
        history = np.zeros_like(gram)
        history[1:] = gram[:-1]
        history[self.first] = 0
        self.orders.append(Order(history, self.word, last, len(self.ids)))
        return self.orders[-1]

    def place(self, ids: np.ndarray) -> int:
        """The place of an n-gram of given word ids, or -1."""
        at = 0
        for k, id_ in enumerate(ids):
            word = int(np.searchsorted(self.ids, id_))
            if word == len(self.ids) or self.ids[word] != id_:
                return -1
            if k == 0:
                at = word
            elif at or word:
                keys, key = self.orders[k - 1].keys, at * len(self.ids) + word
                at = int(np.searchsorted(keys, key)) + 1
                if at > len(keys) or keys[at - 1] != key:
                    return -1
        return at

    def dealt(self, plan: Plan) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Order of the last order's n-grams by partition (and then word ids), their partitions in that order, and the frequent histories (place, number)."""
        new = self.orders[-1]
        often = [(at, k) for k, ids in enumerate(plan.often[len(self.orders) - 1]) if (at := self.place(ids)) >= 0]
        spread = np.zeros(int(new.history.max(initial=0)) + 1, bool)
        spread[[at for at, _ in often if at < len(spread)]] = True
        with np.errstate(over="ignore"):
            h = np.zeros(len(new.keys), _U)
            for x in new.path[:-1]:
                h = mix(h * _U(0x9E3779B97F4A7C15) + self.ids[x[1:]].astype(_U))
            to = place(mix(h + np.where(spread[new.history], self.ids[new.word], 0).astype(_U) * _U(0xC2B2AE3D27D4EB4F)), plan.parts)
        order = np.argsort(to.astype(np.uint16) if plan.parts <= 1 << 16 else to, kind="stable")
        return order, to[order], often

    def asks(self, plan: Plan) -> pa.Table:
        """Slices of the n-grams of one more order, for their partitions."""
        new = self.next()
        order, to, _ = self.dealt(plan)
        before = self.orders[-2] if len(self.orders) > 1 else self
        held = np.repeat(self.held, self.n)
        count = np.bincount(new.gram[~held], minlength=len(new.keys) + 1)[1:][order]
        below, history, word = before.count[new.below[1:][order]], new.history[order], self.ids[new.word[order]]
        path = [self.ids[x[1:][order]] for x in new.path[:-1]]
        cut = np.r_[0, np.flatnonzero(np.diff(to)) + 1, len(to)]
        out = []
        for a, b in zip(cut, cut[1:]):
            first = np.r_[0, np.flatnonzero(np.diff(history[a:b])) + 1]
            out.append(bundle(np.diff(np.r_[first, b - a]), word[a:b], count[a:b], below[a:b], *(x[a:b][first] for x in path[1:]), ordered=path[0][a:b][first]))
        return pa.table({"part": pa.array(to[cut[:-1]]), "data": pa.array(out, pa.binary())})

    def answer(self, plan: Plan, answers: list[dict]) -> Order:
        """One more order, with counts of its n-grams and, of its histories, what those seen take of the mass, how many they are, and their mass below."""
        new = self.next()
        order, to, often = self.dealt(plan)
        history = new.history[order]
        first = np.flatnonzero(np.r_[True, (to[1:] != to[:-1]) | (history[1:] != history[:-1])])  # as answered: each run of a history in a partition
        before = len(self.orders[-2].keys) + 1 if len(self.orders) > 1 else len(self.ids)
        new.count, new.taken = np.zeros(len(order) + 1, np.int64), [np.zeros(before) for _ in range(3)]
        i = j = 0
        for a in sorted(answers, key=lambda a: a["part"]):
            count, sums = unbundle(a["data"])
            new.count[order[i : i + len(count)] + 1] = count
            sums = sums.reshape(2 * plan.top + 2, -1)
            for x, y in zip(new.taken, plan.taken(len(self.orders), sums)):
                x[history[first[j : j + sums.shape[1]]]] = y
            i, j = i + len(count), j + sums.shape[1]
        if often:
            at, k = (np.array(x) for x in zip(*often))
            for x, y in zip(new.taken, plan.taken(len(self.orders), plan.heavy[len(self.orders) - 1][k].T)):
                x[at] = y
        return new

    def probabilities(self, plan: Plan) -> np.ndarray:
        """P of each token, from the lowest order up: each n-gram's own or, if it is unseen, that of the n-gram below it times alpha."""
        d, top = plan.discounts, plan.top
        take = lambda d, c: d[np.minimum(c, top + 1)] * c
        p = np.where(self.count > 0, take(d[0], self.count) / max(plan.total, 1), plan.unknown)
        over_below, below = np.full(1, float(max(plan.total, 1))), np.zeros(len(self.ids), np.int64)
        for k, x in enumerate(self.orders):
            used, seen, mass = x.taken
            over = np.where(used > seen - 1e-9, seen + 1, seen)  # nothing discounted: one more count for the unseen
            with np.errstate(divide="ignore", invalid="ignore"):
                alpha = np.where(seen > 0, (1 - used / over) / (1 - mass / over_below[below]), 1.0)
                own = take(d[k + 1], x.count[1:]) / over[x.history]
            p = np.r_[0.0, np.where(x.count[1:] > 0, own, alpha[x.history] * p[x.below[1:]])]
            over_below, below = over, x.below
        last = self.orders[-1].gram if self.orders else self.word
        return p[last]


class Plan:
    """What all blocks are told: discounts and frequent histories (word ids) of the orders done, and those of the order that is under way."""

    def __init__(self, parts: int, top: int, total: int, known: int, unknown: float, uni: np.ndarray):
        self.parts, self.top, self.total, self.known, self.unknown = parts, top, total, known, unknown
        self.discounts, self.often, self.heavy = [uni], [], []

    def taken(self, order: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From sums of histories (a row each column): discounted counts, counts, and discounted counts below."""
        d, top, r = self.discounts, self.top, np.arange(1, self.top + 1)
        own, below = sums[: top + 1], sums[top + 1 :]
        return (r * d[order][r]) @ own[:top] + own[top], r @ own[:top] + own[top], (r * d[order - 1][r]) @ below[:top] + below[top] * d[order - 1][top + 1]


STATE = "block long, doc_ids array<{}>, held binary, n binary, words binary, orders array<binary>"


def _state(block: int, row: dict, words: bytes, orders: list[bytes], doc_ids: pa.ChunkedArray) -> pa.Table:
    own = {"block": pa.array([block], pa.int64()), "doc_ids": doc_ids}
    own |= {c: pa.array([row[c]], pa.binary()) for c in ("held", "n")}
    return pa.table(own | {"words": pa.array([words], pa.binary()), "orders": pa.array([orders], pa.list_(pa.binary()))})


def _number(key, left, right):
    """A block's tokens as places of its words in order of their ids, with ids and counts."""
    row = left.to_pylist()[0]
    ids, count = (np.concatenate(x) for x in zip(*(unbundle(a["data"]) for a in sorted(right.to_pylist(), key=lambda a: a["part"]))))
    order = np.argsort(ids)
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(1, len(ids) + 1)
    return _state(key[0].as_py(), row, bundle(np.r_[0, ids[order]], np.r_[0, count[order]], rank[ints(row["tokens"])]), [], left["doc_ids"])


def _fold(sent):
    def run(key, left, right):
        row = left.to_pylist()[0]
        new = Block(row, sent.value).answer(sent.value, right.to_pylist())
        more = bundle(new.count, *(x.view(np.int64) for x in new.taken))
        return _state(key[0].as_py(), row, row["words"], [*row["orders"], more], left["doc_ids"])

    return run


def _ask_grams(sent):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = Block(row, sent.value).asks(sent.value)
                yield from out.append_column("block", pa.array([row["block"]] * out.num_rows, pa.int64())).select(["part", "block", "data"]).to_batches()

    return run


def _sorted(columns: list[np.ndarray]) -> np.ndarray:
    """Order by the first column, then the next ones; as one number where that fits."""
    bits = [int(x.max(initial=0)).bit_length() for x in columns]
    if sum(bits) > 63:
        return np.lexsort(columns[::-1])
    key = columns[0].copy()
    for x, b in zip(columns[1:], bits[1:]):
        key <<= b
        key |= x
    return np.argsort(key)


def _merge_grams(sent, heavy: int):
    """Of each part: statistics, answers, sums of frequent histories, and the model's table.

    Sums of a history are, for r in 1..top, its followers seen r times, then the counts above top; then the same for their counts below.
    """

    def run(key, table):
        plan, part = sent.value, key[0].as_py()
        top, often = plan.top, {tuple(x): k for k, x in enumerate(plan.often[-1].tolist())}
        firsts, cols = [], []
        for x in table["data"].to_pylist():
            hn, w, c, below, *rest, h = unbundle(x, ordered=True)
            firsts.append(np.cumsum(hn) - hn)
            cols.append([c, below, w, *(np.repeat(y, hn) for y in (h, *rest))])
        sizes = [len(x[0]) for x in cols]
        c, below, w, *path = (np.concatenate(x) for x in zip(*cols))
        order = _sorted([*path, w])
        differ = lambda x: np.r_[True, x[1:] != x[:-1]]
        new_h = np.logical_or.reduce([differ(x[order]) for x in path])
        new = new_h | differ(w[order])
        number = np.empty(len(w), np.int64)
        number[order] = np.cumsum(new) - 1
        total = np.bincount(number, c).astype(np.int64)  # of each distinct n-gram, which are in order
        first = order[new]
        below, w, path = below[first], w[first], [x[first] for x in path]
        new_h = new_h[new]
        history = np.cumsum(new_h) - 1
        heads = [x[new_h] for x in path]
        some, many = total > 0, int(new_h.sum())
        own = history[some]
        sums = np.stack([x for n in (total[some], below[some]) for x in (*(np.bincount(own[n == r], minlength=many) for r in range(1, top + 1)), np.bincount(own, np.where(n > top, n, 0), minlength=many))]).astype(np.int64)
        frequent = total >= heavy
        rows, k = [_stats(total, [x[frequent] for x in (*path, w)], top, part)], 0
        for block, x, size in zip(table["block"].to_pylist(), firsts, sizes):
            at = number[k : k + size]
            rows.append((block, ANSWER, part, bundle(total[at], sums[:, history[at[x]]].ravel())))
            k += size
        maybe = np.flatnonzero(np.logical_and.reduce([np.isin(x, y) for x, y in zip(heads, plan.often[-1].T)]))
        rows.extend((often[h], HEAVY, part, bundle(sums[:, i])) for i in maybe.tolist() if (h := tuple(int(x[i]) for x in heads)) in often)
        kept = np.bincount(own, minlength=many)
        rows.append((-1, TABLE, part, bundle(kept[kept > 0], w[some], total[some], *(x[kept > 0] for x in heads[1:]), ordered=heads[0][kept > 0])))
        return _rows(rows)

    return run


def _sums(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array([unbundle(x.as_py())[0] for x in batch.column("data")], pa.list_(pa.int64()))], names=["k", "s"])


def _frequent(rows: DataFrame, often: np.ndarray, width: int) -> np.ndarray:
    """Sums of the frequent histories over all partitions; one row for each of ``often`` comes to the driver."""
    each = rows.filter(F.col("kind") == HEAVY).select("block", "data").mapInArrow(_sums, "k long, s array<long>")
    sums = np.zeros((len(often), width), np.int64)
    for r in each.groupBy("k").agg(F.array(*(F.sum(F.col("s")[i]) for i in range(width))).alias("s")).collect():
        sums[r.k] = r.s
    return sums


def _listed(batches):
    for batch in batches:
        for order, data in zip(batch.column("order").to_pylist(), batch.column("data").to_pylist()):
            kept, w, c, *rest, h = unbundle(data, ordered=True)
            history = np.stack([np.repeat(x, kept) for x in (h, *rest)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([order] * len(w), pa.int32()), pa.array(list(history), pa.list_(pa.int64())), pa.array(w), pa.array(c)], names=["order", "history", "word", "n"])


def ngrams(tables: DataFrame) -> DataFrame:
    """The model's tables as rows: order, history and word (word ids; 0 is the start), and how often the training rows hold it."""
    return tables.select("order", "data").mapInArrow(_listed, "order int, history array<long>, word long, n long")


def _score(sent):
    """Scores of a block, with the answers of the last order."""

    def run(key, left, right):
        block = Block(left.to_pylist()[0], sent.value)
        if sent.value.often:
            block.answer(sent.value, right.to_pylist())
        return pa.Table.from_batches([_scored(block, sent.value, left["doc_ids"].combine_chunks().flatten())])

    return run


def _scored(b: Block, plan: Plan, doc_ids: pa.Array) -> pa.RecordBatch:
    count = b.count[b.word]
    base = np.log10((count + 1) / (plan.total + plan.known + 1))
    with np.errstate(divide="ignore"):
        p = np.log10(b.probabilities(plan))
    known = np.add.reduceat((count > 0).astype(np.int64), b.first)
    cols = {"doc_id": doc_ids, "held_out": b.held, "n_tokens": b.n, "n_known": known, "train_tokens": np.full(len(b.n), plan.total, np.int64), "base_score": np.add.reduceat(base, b.first), "score": np.add.reduceat(p, b.first)}
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols.values()], names=list(cols))


def _collected(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of counts (then sum and number), and the frequent n-grams of so many words, over all partitions: one row each."""
    found = [unbundle(r.data) for r in rows.filter(F.col("kind") == STATS).select("data").collect()]
    often = np.unique(np.concatenate([np.zeros((1, words), np.int64), *(np.stack(x[1:], axis=1) for x in found)]), axis=0)  # the start, and fewer than partitions
    return sum((x[0] for x in found), np.zeros(1, np.int64)), often


def fit_and_score(spark: SparkSession, docs: DataFrame, held: Column, order: int = 3, top: int = 5, block: int = 3 << 20, slice_keys: int = 1_000_000) -> tuple[DataFrame, DataFrame | None]:
    """Scores of every row (see ``score``), and the model's tables of orders above the first (see ``ngrams``)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", held.alias("held"))
    blocks = rows.mapInArrow(_blocks(block), f"block long, doc_ids array<{kind}>, held binary, n binary, words binary, counts binary, tokens binary, n_words long, n_tokens long, n_train long")
    blocks = common.stage(spark, blocks, "katz-blocks")
    n_words, n_tokens, total = (x or 0 for x in blocks.agg(F.sum("n_words"), F.sum("n_tokens"), F.sum("n_train")).first())
    parts1, parts = (common.partitions(spark, -(-n // slice_keys)) for n in (n_words, n_tokens))
    heavy, passes = max(1, -(-total // parts)), max(1, min(8, n_tokens // 20_000_000))

    def joined(left: DataFrame, right: DataFrame, f, fields: str = STATE.format(kind)) -> DataFrame:
        """Blocks with what was answered, a share of them at a time."""
        of = lambda df, i: df.filter(F.pmod(F.xxhash64("block"), F.lit(passes)) == i).groupBy("block")
        done = [common.stage(spark, of(left, i).cogroup(of(right, i)).applyInArrow(f, fields), "katz-state") for i in range(passes)]
        out = done[0]
        for x in done[1:]:
            out = out.unionByName(x)
        out.staged_at = [x.staged_at for x in done]
        return out

    asked = blocks.select("block", "words", "counts").mapInArrow(ask(parts1), "part long, block long, words binary, counts binary")
    words = common.stage(spark, asked.groupBy("part").applyInArrow(_merge_words(parts1, top, heavy), ROW), "katz-1")
    n, often = _collected(words, 1)
    n, known = (n[: top + 2], int(n[-1])) if total else (np.zeros(top + 2, np.int64), 0)
    uni = discounts(n, top)
    used = sum(uni[r] * r * n[r] for r in range(1, top + 1)) + total - sum(r * n[r] for r in range(1, top + 1))
    if total and used >= total - 1e-9:  # nothing discounted: as for histories
        uni, used = uni * total / (total + 1), used * total / (total + 1)
    plan = Plan(parts, top, total, known, (1 - used / total) / unseen(n) if total else 1.0, uni)
    state = joined(blocks.select("block", "doc_ids", "held", "n", "tokens"), words.filter(F.col("kind") == ANSWER), _number)
    common.release(blocks, words)
    tables = None
    for k in range(2, order + 1):
        plan.often.append(often)
        plan.heavy.append(None)
        sent = spark.sparkContext.broadcast(plan)  # a few numbers, and frequent histories: fewer than partitions
        grams = state.mapInArrow(_ask_grams(sent), "part long, block long, data binary")
        done = common.stage(spark, grams.groupBy("part").applyInArrow(_merge_grams(sent, heavy), ROW), f"katz-{k}")
        n, often = _collected(done, k)
        plan.discounts.append(discounts(n[: top + 2] if len(n) > 1 else np.zeros(top + 2), top))
        plan.heavy[-1] = _frequent(done, plan.often[-1], 2 * top + 2)
        table, answers = done.filter(F.col("kind") == TABLE).select(F.lit(k).alias("order"), "part", "data"), done.filter(F.col("kind") == ANSWER)
        if k < order:
            table = common.stage(spark, table, "katz-table")
            old, state = state, joined(state, answers, _fold(spark.sparkContext.broadcast(plan)))
            common.release(old, done)
        tables = tables.unionByName(table) if tables else table
    if order == 1:
        answers = spark.createDataFrame([], ROW)
    fields = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = joined(state, answers, _score(spark.sparkContext.broadcast(plan)), fields)
    common.release(state)
    return out, tables


def score(spark: SparkSession, docs: DataFrame, held: Column, **settings) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; rows where ``held`` is true are not learned from."""
    return fit_and_score(spark, docs, held, **settings)[0]


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order two: order three takes more disk and time than the limits allow (figures in the README)."""
    docs = common.table(spark, sf_dir, "documents")
    return score(spark, docs, F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False)), order=2)
