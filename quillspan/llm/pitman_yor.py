"""Hierarchical Pitman-Yor language model of words: context restaurants below one shared root restaurant.

A context is what the word before hashes to (one of 65,536 restaurants, so their totals have a fixed size); the dishes
are words and the end of a text. Restaurants send one customer to the root for each of their tables; the root's base is
uniform over the known words and one unknown word. Seatings are sampled by Gibbs: all customers of one dish in one
restaurant are seated at once from the exact distribution of their number of tables (by generalised Stirling numbers;
over 48 customers, in blocks that double), given all other tables. Predictive probabilities are averaged over samples.

Counts and texts meet by the word: each task turns its texts into blocks, divided by the words' hashes into buckets. A
bucket holds all customers of its dishes, and its seating is kept from sweep to sweep; after each sweep the tables of all
buckets are added up, and the next one goes by these totals. The most frequent words are divided over the buckets by
context as well, so that no bucket is hot; the driver seats them at the root. Random numbers are drawn from the hashes of
word, context and sweep, so that scores do not depend on how the work is divided.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import drop_exchanges, id_hash, materialize, release

CONTEXTS = 1 << 16
CODE = "bucket long, block long, data binary"
STATE = f"{CODE}, sums binary"


@dataclass(frozen=True)
class Settings:
    """bucket_chars: text for one bucket; block_tokens: tokens of one block. hot_share: of all tokens, from which a word is
    divided over the buckets (this changes no count)."""

    root_discount: float = 0.85
    root_strength: float = 1.0
    discount: float = 0.8
    strength: float = 5.0
    burn_in: int = 2
    samples: int = 3
    exact: int = 48
    bucket_chars: int = 12_000_000
    block_tokens: int = 500_000
    hot_share: float = 0.001
    folds: int = 10
    held: int = 0


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, 42)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


END, START = b"\n", b"\n\n"  # no word holds white space


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _pack(x) -> bytes:
    return zstandard.compress(pickle.dumps(x, 5), 1)


def _unpack(x: bytes):
    return pickle.loads(zstandard.decompress(x))


def stirling(most: int, d: float) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t) for c, t up to most."""
    s = np.full((most + 1, most + 2), -np.inf)
    s[1, 1] = 0
    t = np.arange(1, most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(t <= c, np.log(np.maximum(c - d * t, 1e-300)) + s[c, 1:-1], -np.inf)
        s[c + 1, 1:-1] = np.logaddexp(s[c, :-2], stay)
    return s


def _uniform(keys: np.ndarray) -> np.ndarray:
    return ((_mix(keys) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _seat_many(c: int, concentration: float, base: float, d: float, draw) -> int:
    """Customers sit down in blocks that double; those of a block see the tables at its beginning."""
    seated, t = 1, 1
    while c > seated:
        more = min(c - seated, seated)
        new = (concentration + d * t) * base
        share = new / (new + max(seated + (more - 1) / 2 - d * t, 1e-9))
        t += int(draw(more, min(max(share, 0.0), 1.0)))
        seated *= 2
    return t


def sample_tables(rng: np.random.Generator | None, c: np.ndarray, tables: np.ndarray, base: np.ndarray, d: float, strength: float, logs: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
    """Tables of c customers of one dish each, given the restaurant's other tables and the dish's base probability. With
    keys, each row is drawn from its own key, whatever the other rows are."""
    exact = len(logs) - 1
    out = np.minimum(c, 1).astype(np.int64)
    concentration = strength + d * tables
    many = np.flatnonzero(c > 1)
    many = many[np.argsort(c[many], kind="stable")]
    edges = np.searchsorted(c[many], np.arange(2, exact + 2))
    for size in range(2, exact + 1):
        rows = many[edges[size - 2] : edges[size - 1]]
        k = np.arange(size)
        for at in range(0, len(rows), max(1, 1_000_000 // size)):
            r = rows[at : at + max(1, 1_000_000 // size)]
            w = np.cumsum(np.log((concentration[r, None] + d * k) * base[r, None]), axis=1) + logs[size, 1 : size + 1]
            share = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            u = rng.random(len(r)) if keys is None else _uniform(keys[r])
            out[r] = 1 + (share[:, :-1] < u[:, None] * share[:, -1:]).sum(axis=1)
    bits = np.random.Philox(0)
    fresh = bits.state
    own = rng if keys is None else np.random.Generator(bits)
    for r in many[edges[exact - 1] :].tolist():
        if keys is not None:
            fresh["state"]["key"][0] = keys[r]
            bits.state = fresh
        out[r] = _seat_many(int(c[r]), float(concentration[r]), float(base[r]), d, own.binomial)
    return out


@dataclass
class Totals:
    """Sums over all buckets. tables: of each context; root_tables, customers: at the root, of dishes that are not divided;
    hot: customers to the root of each divided dish."""

    tables: np.ndarray
    root_tables: int
    customers: int
    hot: np.ndarray

    def __add__(self, x: Totals) -> Totals:
        return Totals(self.tables + x.tables, self.root_tables + x.root_tables, self.customers + x.customers, self.hot + x.hot)


@dataclass
class Whole:
    """What the next sweep goes by: the tables of each context, the root's tables and customers, those of the divided
    dishes, and the number of known words."""

    tables: np.ndarray
    root_tables: int
    customers: int
    hot: np.ndarray
    hot_tables: np.ndarray
    words: int

    def root_share(self, c: np.ndarray, t: np.ndarray, s: Settings) -> np.ndarray:
        """The root's probabilities of dishes with c customers at t tables."""
        return (c - s.root_discount * t + (s.root_strength + s.root_discount * self.root_tables) / (self.words + 1)) / (s.root_strength + self.customers)


def _whole(x: Totals, hot_tables: np.ndarray, words: int) -> Whole:
    return Whole(x.tables, x.root_tables + int(hot_tables.sum()), x.customers + int(x.hot.sum()), x.hot, hot_tables, words)


def _seat_root(sweep: int, hashes: np.ndarray, c: np.ndarray, t: np.ndarray, before: Whole, s: Settings) -> np.ndarray:
    base = np.full(len(c), 1 / (before.words + 1))
    keys = _mix(hashes + np.uint64((sweep + 1) << 40))
    return sample_tables(None, c, np.maximum(before.root_tables - t, 0), base, s.root_discount, s.root_strength, stirling(s.exact, s.root_discount), keys)


@dataclass
class Seating:
    """The customers of a bucket: for each pair its dish (an index into hashes), context, customers c and tables t; of each
    dish the tables at the root, and where in hot it stands if it is divided (-1 if it is not). seated: the sum of t over
    the samples; roots: customers and tables at the root, of each dish, for each sample."""

    hashes: np.ndarray
    dish: np.ndarray
    context: np.ndarray
    c: np.ndarray
    t: np.ndarray
    t_root: np.ndarray
    hot: np.ndarray
    seated: np.ndarray
    roots: list[tuple[np.ndarray, np.ndarray]]

    def customers(self) -> np.ndarray:
        return np.bincount(self.dish, self.t, len(self.hashes)).astype(np.int64)

    def totals(self, hot: int) -> Totals:
        c, own = self.customers(), self.hot < 0
        sums = np.bincount(self.hot[~own], c[~own], hot).astype(np.int64)
        return Totals(np.bincount(self.context, self.t, CONTEXTS).astype(np.int64), int(self.t_root[own].sum()), int(c[own].sum()), sums)

    def sweep(self, k: int, before: Whole, s: Settings) -> None:
        """Seat all pairs anew, then all dishes that are not divided at the root, given what all buckets held before."""
        own = self.hot < 0
        c_root, t_root = self.customers(), self.t_root.astype(np.int64)
        c_root[~own], t_root[~own] = before.hot[self.hot[~own]], before.hot_tables[self.hot[~own]]
        p = np.maximum(before.root_share(c_root, t_root, s), 1e-300)
        keys = _mix(self.hashes)[self.dish] + (self.context.astype(np.uint64) << np.uint64(16)) + np.uint64(k + 1)
        self.t = sample_tables(None, self.c, np.maximum(before.tables[self.context] - self.t, 0), p[self.dish], s.discount, s.strength, stirling(s.exact, s.discount), _mix(keys)).astype(np.int32)
        c_root = self.customers()
        self.t_root[own] = _seat_root(k, self.hashes[own], c_root[own], t_root[own], before, s)
        if k >= s.burn_in:
            self.seated = self.seated + self.t
            self.roots.append((c_root.astype(np.int32), self.t_root.copy()))


def _first_seating(hashes: np.ndarray, dish: np.ndarray, context: np.ndarray, c: np.ndarray, hot: np.ndarray) -> Seating:
    """One table for each pair and dish. hot: sorted hashes of the divided dishes."""
    at = np.full(len(hashes), -1, np.int32)
    divided = np.isin(hashes, hot)
    at[divided] = np.searchsorted(hot, hashes[divided])
    t = np.minimum(c, 1).astype(np.int32)
    t_root = np.where(divided, 0, np.bincount(dish, t, len(hashes)) > 0).astype(np.int32)
    return Seating(hashes, dish, context, c, t, t_root, at, np.zeros(len(c), np.int32), [])


def _next(k: int, x: Totals, before: Whole, hot: np.ndarray, s: Settings) -> Whole:
    """What the sweep after sweep k goes by: the divided dishes are seated at the root here."""
    return _whole(x, _seat_root(k, hot, x.hot, before.hot_tables, before, s), before.words)


@dataclass
class Kept:
    kept: np.ndarray


def seat(seed: int, dish: np.ndarray, context: np.ndarray, c: np.ndarray, divided: np.ndarray, share: int, s: Settings) -> Kept:
    """All sweeps over pairs that lie in one place: what those over any number of buckets come to. dish: index of each pair's
    dish; divided: which dishes are seated by the driver. share, the number of buckets, has no effect. kept: mean of
    customers less discounts for each pair."""
    hashes = _mix(np.arange(len(divided), dtype=np.uint64) + np.uint64(seed << 32))
    hot = np.sort(hashes[divided])
    x = _first_seating(hashes, dish, context, c, hot)
    raw = np.bincount(dish, c, len(divided))
    whole = _whole(x.totals(len(hot)), np.ones(len(hot), np.int64), int((raw > 0).sum()))
    for k in range(s.burn_in + s.samples):
        x.sweep(k, whole, s)
        whole = _next(k, x.totals(len(hot)), whole, hot, s)
    return Kept(c - s.discount * x.seated / s.samples)


def _merge(blocks: list[dict]):
    """The dishes and pairs of a bucket from all its blocks, and for each block where its pairs are among them."""
    hashes = np.unique(np.concatenate([b["words"] for b in blocks]))
    keys = [np.searchsorted(hashes, np.repeat(b["words"], b["pairs"])) * CONTEXTS + b["contexts"] for b in blocks]
    every = np.unique(np.concatenate(keys))
    return hashes, every, [np.searchsorted(every, k).astype(np.int32) for k in keys]


def _blocks(docs: DataFrame, buckets: int, hot: np.ndarray, s: Settings, learn: bool) -> DataFrame:
    """docs: doc_id, text, held_out. Blocks of postings by bucket; under bucket -1 - block, what is known of its rows. To
    learn, instead, blocks of the pairs of the rows to learn from, with their counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        numbers: dict[bytes, int] = {}
        runs: list[np.ndarray] = []
        ids: list = []
        held: list[bool] = []

        def flush() -> pa.RecordBatch:
            words = np.fromiter(map(_hash, numbers), np.uint64, len(numbers))
            sizes = np.array([len(x) for x in runs])
            word = np.concatenate(runs)
            doc = np.repeat(np.arange(len(runs), dtype=np.uint16), sizes)
            hashes = words[word]
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            context = np.empty(len(word), np.uint64)
            context[1:] = hashes[:-1] >> np.uint64(48)
            context[first] = np.uint64(_hash(START) >> 48)
            bucket = _mix(words) % np.uint64(buckets)
            bucket = bucket[word]
            divided = np.isin(words, hot)[word]
            bucket[divided] = _mix(hashes[divided] + context[divided] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)
            key = (bucket << np.uint64(40)) | (word.astype(np.uint64) << np.uint64(16)) | context
            if learn:
                key.sort()
            else:
                order = np.argsort(key, kind="stable")
                key, doc = key[order], doc[order]
            pair = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            posts = np.diff(np.append(pair, len(key)))
            pair_key = key[pair]
            pair_word = pair_key >> np.uint64(16)
            start = np.flatnonzero(np.concatenate([[True], pair_word[1:] != pair_word[:-1]]))
            out = [] if learn else [(-1 - block, block, _pack({"ids": ids, "held": np.array(held), "tokens": sizes}))]
            at_bucket = pair_key >> np.uint64(40)
            edges = np.flatnonzero(np.concatenate([[True], at_bucket[1:] != at_bucket[:-1]]))
            for a, b in zip(edges, [*edges[1:], len(pair)], strict=True):
                lo, hi = np.searchsorted(start, [a, b])
                own = start[lo:hi]
                x, y = pair[a], pair[b] if b < len(pair) else len(key)
                small = lambda v: v.astype(np.uint16) if v.max(initial=0) < 65536 else v.astype(np.uint32)
                data = {"words": words[(pair_word[own] & np.uint64(0xFFFFFF)).astype(np.int64)], "pairs": small(np.diff(np.append(own, b))), "contexts": (pair_key[a:b] & np.uint64(0xFFFF)).astype(np.uint16), "posts": small(posts[a:b])}
                if not learn:
                    data |= {"docs": doc[x:y], "rows": len(runs)}
                out.append((int(at_bucket[a]), block, _pack(data)))
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "block", "data"])

        size = 0
        for b in batches:
            for doc_id, text, out in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "held_out")), strict=True):
                if learn and out:
                    continue
                words = tokens_of(text)
                words.append(END)
                runs.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
                ids.append(doc_id)
                held.append(out)
                size += len(words)
                if size >= s.block_tokens or len(runs) == 65535:
                    yield flush()
                    block += 1
                    size = 0
                    for x in (numbers, runs, ids, held):
                        x.clear()
        if runs:
            yield flush()

    return docs.mapInArrow(run, CODE)


def _together(blocks: DataFrame, key: str) -> DataFrame:
    """All parts of a bucket or block in one task and in a row, each a row of moderate size."""
    return blocks.repartition(key).sortWithinPartitions(key, "block" if key == "bucket" else "bucket")


def _groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[int], list[bytes]]]:
    now, names, parts = None, [], []
    other = "block" if key == "bucket" else "bucket"
    for b in batches:
        for k, o, data in zip(*(b.column(c).to_pylist() for c in (key, other, "data")), strict=True):
            if k != now and parts:
                yield now, names, parts
                names, parts = [], []
            now = k
            names.append(o)
            parts.append(data)
    if parts:
        yield now, names, parts


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Batches of so many rows at most between Spark and Python meanwhile, as the rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _hot_words(docs: DataFrame, s: Settings, most: int = 200_000) -> np.ndarray:
    """Hashes of the words that make up hot_share or more of all tokens: at most 1 / hot_share. Each task counts all of its
    words, and where its table is full takes the least count of the upper half from all (as Misra and Gries do); what a
    word may have lost so is far below hot_share and only concerns how work is divided."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, tokens = Counter(), 0
        for b in batches:
            for text in b.column("text").to_pylist():
                words = tokens_of(text)
                found.update(words)
                found[END] += 1
                tokens += len(words) + 1
            if len(found) > 2 * most:
                least = found.most_common(most)[-1][1]
                found = Counter({w: n - least for w, n in found.items() if n > least})
        rows = [(_hash(w) - (1 << 63), n) for w, n in found.items() if n >= s.hot_share * tokens / 2]
        yield pa.RecordBatch.from_arrays([pa.array([None, *(h for h, _ in rows)], pa.int64()), pa.array([tokens, *(n for _, n in rows)], pa.int64())], names=["word", "n"])

    # A word of hot_share has that share in some task at least, and a task reports 2 / hot_share words at most.
    found = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = found.filter("word IS NULL").agg(F.sum("n")).first()[0] or 0
    rows = found.filter(F.col("word").isNotNull() & (F.col("n") >= s.hot_share * total / 2)).collect()
    return np.array(sorted(r["word"] + (1 << 63) for r in rows), np.uint64)


def _sum(parts: Iterable[bytes]) -> tuple[Totals, dict] | None:
    found = None
    for x in map(_unpack, parts):
        found = x if found is None else (found[0] + x[0], {k: found[1][k] + x[1][k] for k in x[1]})
    return found


def score_texts(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row per row of docs (doc_id, text).

    Learns from the rows outside of the held-out fold (crc32 of the id's text, modulo folds; a null id counts as the
    empty text). Null and empty texts are the end alone; repeated rows count and are scored each; without rows to learn
    from, the only word is the unknown one, of probability 1; an empty table gives no rows; other columns are ignored.
    """
    with small_batches(docs.sparkSession):
        return _score_texts(docs, settings)


def _score_texts(docs: DataFrame, s: Settings) -> DataFrame:
    spark = docs.sparkSession
    fold = F.pmod(id_hash("doc_id"), F.lit(s.folds))
    rows = docs.select("doc_id", "text", (fold == s.held).alias("held_out"))
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-size // s.bucket_chars))
    hot = _hot_words(docs, s) if buckets > 1 else np.zeros(0, np.uint64)
    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Seating, Totals, dict]]:
        for bucket, _, parts in _groups(batches, "bucket"):
            blocks = [_unpack(x) for x in parts]
            hashes, every, where = _merge(blocks)
            c = np.zeros(len(every), np.int64)
            for b, at in zip(blocks, where, strict=True):
                c[at] += b["posts"]
            x = _first_seating(hashes, (every // CONTEXTS).astype(np.int32), (every % CONTEXTS).astype(np.uint16), c.astype(np.int32), hot)
            raw, own = np.bincount(x.dish, c, len(hashes)), x.hot < 0
            counts = {"context": np.bincount(x.context, c, CONTEXTS), "words": int(own.sum()), "hot": np.bincount(x.hot[~own], raw[~own], len(hot))}
            yield bucket, x, x.totals(len(hot)), counts

    def write(found: Iterator[tuple[int, Seating, Totals, dict]]) -> Iterator[pa.RecordBatch]:
        """A row for each bucket, and one with the sums of the task."""
        total = counts = None
        for bucket, x, own, n in found:
            total = own if total is None else total + own
            counts = n if counts is None else {k: counts[k] + n[k] for k in n}
            yield batch([bucket], [0], [_pack(x)], [None])
        if total is not None:
            yield batch([-1], [0], [None], [_pack((total, counts))])

    def batch(bucket: list, block: list, data: list, sums: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(block, pa.int64()), pa.array(data, pa.binary()), pa.array(sums, pa.binary())], names=["bucket", "block", "data", "sums"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _sum(x for b in batches for x in b.column("sums").to_pylist())
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([_pack(found)], pa.binary())], names=["sums"])

    def sums_of(state: DataFrame) -> tuple[Totals, dict] | None:
        # The sums have a fixed size (65,536 contexts); tasks add them up before the driver adds at most eight of them.
        parts = state.select("sums").filter("sums IS NOT NULL").repartition(8).mapInArrow(add, "sums binary").collect()
        return _sum(r["sums"] for r in parts)

    # The buckets' seatings are large rows: one to a batch, and files of few of them.
    learnt = _blocks(rows, buckets, hot, s, True).repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")
    state = materialize(learnt.mapInArrow(lambda batches: write(first(batches)), STATE), "seating")
    none = Totals(np.zeros(CONTEXTS, np.int64), 0, 0, np.zeros(len(hot), np.int64)), {"context": np.zeros(CONTEXTS), "words": 0, "hot": np.zeros(len(hot))}
    sums, counts = sums_of(state) or none
    del learnt
    drop_exchanges(spark)
    whole = _whole(sums, (counts["hot"] > 0).astype(np.int64), counts["words"] + int((counts["hot"] > 0).sum()))
    samples: list[Whole] = []
    with small_batches(spark, 1):
        for k in range(s.burn_in + s.samples):
            now = spark.sparkContext.broadcast(whole)

            def again(batches: Iterable[pa.RecordBatch], k: int = k, now=now) -> Iterator[tuple[int, Seating, Totals, dict]]:
                for b in batches:
                    for bucket, data in zip(b.column("bucket").to_pylist(), b.column("data").to_pylist(), strict=True):
                        x = _unpack(data)
                        x.sweep(k, now.value, s)
                        yield bucket, x, x.totals(len(hot)), {}

            old = state
            state = materialize(old.filter("bucket >= 0").mapInArrow(lambda batches, again=again: write(again(batches)), STATE), "seating")
            sums = (sums_of(state) or none)[0]
            release(old)
            now.destroy()
            whole = _next(k, sums, whole, hot, s)
            if k >= s.burn_in:
                samples.append(whole)
    shared = spark.sparkContext.broadcast((samples, counts))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, counts = shared.value
        tokens, words = float(counts["context"].sum()), samples[-1].words
        for bucket, names, parts in _groups(batches, "bucket"):
            if bucket < 0:
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array(names, pa.int64()), pa.array(parts, pa.binary())], names=["bucket", "block", "data"])
                continue
            x = None
            if names[0] < 0:
                x, names, parts = _unpack(parts[0]), names[1:], parts[1:]
            blocks = [_unpack(p) for p in parts]
            hashes, every, where = _merge(blocks)
            dish, context = every // CONTEXTS, every % CONTEXTS
            kept, raw = np.zeros(len(every)), np.zeros(len(hashes))
            roots = np.zeros((s.samples, 2, len(hashes)))
            if x is not None:
                own = np.searchsorted(hashes, x.hashes)
                kept[np.searchsorted(every, own[x.dish] * CONTEXTS + x.context)] = x.c - s.discount * x.seated / s.samples
                raw[own] = np.bincount(x.dish, x.c, len(own))
                for k, root in enumerate(x.roots):
                    roots[k][:, own] = root
            # Divided dishes may have all their customers in other buckets.
            divided = np.isin(hashes, hot)
            at = np.searchsorted(hot, hashes[divided])
            raw[divided] = counts["hot"][at]
            for k, g in enumerate(samples):
                roots[k][:, divided] = g.hot[at], g.hot_tables[at]
                kept += (s.strength + s.discount * g.tables[context]) * g.root_share(*roots[k], s)[dish] / s.samples
            log_p = np.log10(kept / (s.strength + counts["context"][context]))
            log_base = np.log10((raw + 0.1) / (tokens + 0.1 * (words + 1)))[dish]
            known = (raw > 0).astype(float)[dish]
            out = []
            for one, w in zip(blocks, where, strict=True):
                w = np.repeat(w, one["posts"])
                # Sums of the rows that have words here, the scores in single precision until they are added up.
                at = np.flatnonzero(np.bincount(one["docs"], minlength=one["rows"]))
                sums = {c: np.bincount(one["docs"], v[w], one["rows"])[at] for c, v in (("score", log_p), ("base", log_base), ("known", known))}
                out.append(_pack({"at": at.astype(np.uint16), "score": sums["score"].astype(np.float32), "base": sums["base"], "known": sums["known"].astype(np.uint32)}))
            yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(out), pa.int64()), pa.array(names, pa.int64()), pa.array(out, pa.binary())], names=["bucket", "block", "data"])

    def total_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, names, parts in _groups(batches, "block"):
            x = [(n, _unpack(p)) for n, p in zip(names, parts, strict=True)]
            own = next(p for n, p in x if n < 0)
            n = len(own["ids"])
            sums = {c: np.zeros(n) for c in ("score", "base", "known")}
            for _, p in (y for y in x if y[0] >= 0):
                for c, v in sums.items():
                    v[p["at"]] += p[c]
            columns = [pa.array(own["ids"], pa.int64()), pa.array(own["held"]), pa.array(own["tokens"].astype(np.int64)), pa.array(np.rint(sums["known"]).astype(np.int64)), pa.array(np.full(n, round(g_tokens), np.int64)), pa.array(sums["base"]), pa.array(sums["score"])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    g_tokens = float(counts["context"].sum())
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    # The postings are made from the texts again: that costs less than to keep them.
    seated = state.filter("bucket >= 0").select("bucket", F.lit(-1).cast("long").alias("block"), "data")
    table = _together(_blocks(rows, buckets, hot, s, False).union(seated), "bucket")
    out = materialize(_together(table.mapInArrow(score, CODE), "block").mapInArrow(total_up, schema), "scores")
    release(state)
    return out
