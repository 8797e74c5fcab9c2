"""Exact removal of byte strings that occur more than once, by suffix arrays of the places where repeats can be.

Every string of the given length holds an anchor: a short piece chosen by its hash alone (the least of a window), so
equal strings hold equal anchors. Anchors that occur once cannot lie in a repeat. Around each of the others a region is
taken that holds every string about the anchor; regions with the same anchor meet in one shard, whose suffix array is
built by induced sorting and whose permuted longest common prefixes show which strings start elsewhere too. Regions
that are equal byte for byte are counted, not sorted again, so thousands of copies cost no more than one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import materialize, release
from quillspan.llm.passages import texts_with_passages
from quillspan.llm.suffix_hashes import minima, mix, powers, prefix_sums


@dataclass(frozen=True)
class Settings:
    """length: of the strings; anchor: bytes of an anchor. chunk: bytes that are hashed at once. shard: anchors that
    share a shard on average. hot: an anchor with more distinct regions is compared by the hashes of all strings about
    it, which are counted like any other key, instead of in one shard. passage: words; longer runs that other rows hold
    too are reported."""

    length: int = 400
    anchor: int = 64
    chunk: int = 1 << 20
    shard: int = 3000
    hot: int = 2000
    passage: int = 50


# --- suffix arrays ---------------------------------------------------------------------------------------------------


def _doubling(s: np.ndarray) -> np.ndarray:
    """The suffix array of s (no sentinel) by doubling; the base of the recursion where names are many."""
    n, k = len(s), 1
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        k *= 2


def _scatter(out: np.ndarray, chars: np.ndarray, items: np.ndarray, at: np.ndarray, sign: int) -> None:
    """Put items into the buckets of their chars, in their order, from the bucket's place at going up or down."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    counts = np.diff(np.append(starts, len(c)))
    rank = np.arange(len(c)) - np.repeat(starts, counts)
    out[at[c] + sign * rank] = items[order]
    at[c[starts]] += sign * counts


def _induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The suffixes in the order that the given order of the leftmost-smaller ones induces, one bucket at a time."""
    n = len(s)
    counts = np.bincount(s, minlength=sigma)
    ends = np.cumsum(counts)
    heads = ends - counts
    sa = np.full(n, -1, np.int64)
    by = lms[np.argsort(s[lms], kind="stable")]
    lms_ends = np.cumsum(np.bincount(s[lms], minlength=sigma))
    at = heads.copy()
    present = np.flatnonzero(counts)
    for c in present:
        done = heads[c]
        last = False
        while True:
            if done < at[c]:
                part, done = sa[done : at[c]], at[c]
            elif not last:
                part, last = by[lms_ends[c - 1] if c else 0 : lms_ends[c]], True
            else:
                break
            j = part - 1
            j = j[j >= 0]
            j = j[~is_s[j]]
            if len(j):
                _scatter(sa, s[j], j, at, 1)
    l_ends = at
    at = ends - 1
    for c in present[::-1]:
        done = ends[c] - 1
        last = False
        while True:
            if done > at[c]:
                part, done = sa[at[c] + 1 : done + 1][::-1], at[c]
            elif not last:
                part, last = sa[heads[c] : l_ends[c]][::-1], True
            else:
                break
            j = part - 1
            j = j[j >= 0]
            j = j[is_s[j]]
            if len(j):
                _scatter(sa, s[j], j, at, -1)
    sa[0] = n - 1
    return sa


def suffix_array(s: np.ndarray, names: int = 4096) -> np.ndarray:
    """By induced sorting: s has whole numbers, of which the last is a 0 found nowhere else.

    Suffixes are classified as smaller or larger than the next; substrings between the leftmost smaller ones are sorted
    by one induction and named; the string of names is sorted recursively (by doubling where it has over names names);
    a second induction gives the array.
    """
    s = np.asarray(s, np.int64)
    n = len(s)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    differs = np.append(s[:-1] != s[1:], True)
    after = np.where(differs, np.arange(n), n)
    after = np.minimum.accumulate(after[::-1])[::-1]  # the first place from here where the next symbol differs
    smaller = np.append(s[:-1] < s[1:], True)
    is_s = smaller[after]
    is_s[n - 1] = True
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    sigma = int(s.max()) + 1
    sa = _induce(s, is_s, lms, sigma)
    if len(lms) > 1:
        number = np.full(n, -1, np.int64)
        number[lms] = np.arange(len(lms))
        order = number[sa]
        order = order[order >= 0]
        # Substrings of equal length are compared symbol by symbol, all neighbours at once.
        ends = np.append(lms[1:] + 1, n)
        size = ends - lms
        a, b = order[:-1], order[1:]
        same = size[a] == size[b]
        left = np.flatnonzero(same)
        k = 0
        while len(left):
            left = left[size[a[left]] > k]
            x, y = lms[a[left]] + k, lms[b[left]] + k
            bad = (s[x] != s[y]) | (is_s[x] != is_s[y])
            same[left[bad]] = False
            left = left[~bad]
            k += 1
        name = np.empty(len(lms), np.int64)
        name[order] = np.concatenate([[0], np.cumsum(~same)])
        count = int(name.max()) + 1
        if count == len(lms):
            order = np.argsort(name)
        elif count <= names:
            order = suffix_array(name, names)  # the last substring is the sentinel's, which is named 0 alone
        else:
            order = _doubling(name)
        lms = lms[order]
    return _induce(s, is_s, lms, sigma)


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place, the longest common prefix with the suffix before it in the array.

    Where the symbols before both are equal, it is one less than that of the place before; only the others are compared.
    """
    n = len(s)
    phi = np.empty(n, np.int64)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    place = np.arange(n)
    prior = np.maximum(phi, 1) - 1
    reducible = (place > 0) & (phi > 0) & (s[np.maximum(place, 1) - 1] == s[prior])
    look = np.flatnonzero(~reducible & (phi >= 0))
    lcp = np.zeros(n, np.int64)
    padded = np.concatenate([s, [-1] * 8])
    left, k = look, 0
    while len(left):
        x, y = left + k, phi[left] + k
        ok = (x < n) & (y < n)
        left, x, y = left[ok], x[ok], y[ok]
        equal = padded[x] == padded[y]
        left = left[equal]
        lcp[left] += 1
        k += 1
    start = np.where(reducible, -1, place)
    start = np.maximum.accumulate(start)
    out = lcp[start] - (place - start)
    return np.maximum(out, 0)


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, which of its strings of the given length start anywhere else in the segments."""
    sizes = np.array([len(x) for x in segments])
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    # Bytes are 2 and more, 1 parts the segments, 0 ends the whole.
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int64) + 2
    text[ends - 1] = 1
    text = np.append(text, 0)
    sa = suffix_array(text)
    lcp = permuted_lcp(text, sa)
    long = lcp >= length
    start_here = long.copy()
    before = sa[:-1][long[sa[1:]]]
    start_here[before] = True
    out = []
    for a, n in zip(starts, sizes, strict=True):
        here = start_here[a : a + n].copy()
        here[max(0, n - length + 1) :] = False
        out.append(here)
    return out


# --- anchors -----------------------------------------------------------------------------------------------------------

def window_hashes(raw: np.ndarray, length: int, which: int, most: int) -> np.ndarray:
    """A 64-bit hash of each string of the given length."""
    p = prefix_sums(raw, which, most)
    m = len(raw) - length + 1
    return mix((p[length:] - p[:m]) * powers(which, most)[0][:m])


def anchors(raw: np.ndarray, settings: Settings) -> tuple[np.ndarray, ...]:
    """Places and hashes of a chunk's anchors, the regions about them, and the hashes of those."""
    n, k, most = len(raw), settings.anchor, settings.chunk
    w = settings.length - k + 1
    p = prefix_sums(raw, 0, most)
    up = powers(0, most)[0]
    m = n - k + 1
    h = mix((p[k:] - p[:m]) * up[:m])
    at = minima(h, w)
    start, end = np.maximum(at - (settings.length - k), 0), np.minimum(at + settings.length, n)
    region = mix((p[end] - p[start]) * up[start] + (end - start).astype(np.uint64))
    return h[at], start, end, region


def _chunks(n: int, settings: Settings) -> Iterator[tuple[int, int]]:
    a = 0
    while n - a >= settings.length:
        b = min(n, a + settings.chunk)
        yield a, b
        if b == n:
            return
        a = b - settings.length + 1


def _keyed(docs: DataFrame) -> DataFrame:
    """k, l: 128 bits for the id and the whole text, so rows need no numbering that another run might do otherwise."""
    both = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", both.alias("text"), F.xxhash64("doc_id", both).alias("k"), F.xxhash64(F.lit(17), both, "doc_id").alias("l"), F.xxhash64(both).alias("t"))


def _batch(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    cast = lambda v, t: pa.array(np.concatenate(v) if v and isinstance(v[0], np.ndarray) else v, t)
    return pa.RecordBatch.from_arrays([cast(columns[c], t) for c, t in kinds.items()], names=list(kinds))


def remove_repeats(docs: DataFrame, settings: Settings = Settings(), with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and repeats_passage, one row per row of docs (doc_id, text);
    with_text adds the kept bytes.

    repeats_passage: whether the text holds a run of more than passage words that another row holds too, however few bytes
    they have.

    A byte goes if a string of the given length that covers it starts anywhere else in the table, the same document
    included. Null texts are empty; rows with null ids are kept as they are; a repeated row is another occurrence, so
    either goes wholly if it is long enough; an empty table gives no rows; other columns are ignored.
    """
    rows, length = _keyed(docs), settings.length
    i64 = pa.int64()

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict.fromkeys(("k", "l", "h", "r", "s", "e"), i64)
        for b in batches:
            out: dict[str, list] = {c: [] for c in kinds}
            for text, k, l in zip(*(b.column(c).to_pylist() for c in ("text", "k", "l")), strict=True):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                for a, e in _chunks(len(raw), settings):
                    h, start, end, region = anchors(raw[a:e], settings)
                    for c, v in zip(kinds, (np.full(len(h), k), np.full(len(h), l), h.view(np.int64), region.view(np.int64), start + a, end + a), strict=True):
                        out[c].append(v)
            yield _batch(out, kinds)

    found = rows.select("text", "k", "l").mapInArrow(find, "k long, l long, h long, r long, s long, e long")
    found = materialize(found, "anchors")
    # Of each anchor: how often each region occurs, and how many different ones there are. Copies are added up first.
    same = found.groupBy("h", "r").agg(F.count("*").alias("n"), F.min(F.struct("k", "l", "s")).alias("first"))
    again = same.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).filter("total > 1")
    known = materialize(same.join(again, "h").select("h", "r", "n", "kinds", "first"), "regions")
    shards = max(1, known.filter("kinds > 1").count() // settings.shard)
    met = found.join(known, ["h", "r"]).withColumn("one", F.col("first") == F.struct("k", "l", "s"))
    kind = F.when(F.col("kinds") == 1, -1).when(~F.col("one"), -1).when(F.col("kinds") > settings.hot, -2).otherwise(F.pmod(F.xxhash64("h"), F.lit(shards)))
    met = met.select("k", "l", "s", "e", (F.col("n") > 1).alias("copied"), kind.alias("shard")).filter(f"shard <> -1 OR (copied AND e - s >= {length})")
    met = materialize(met.filter(f"e - s >= {length}"), "places")
    wanted = met.filter("shard <> -1").groupBy("k", "l").agg(F.collect_set(F.struct("shard", "s", "e")).alias("places"))

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"shard": i64, "k": i64, "l": i64, "s": i64, "data": pa.binary()}
        for b in batches:
            out: dict[str, list] = {c: [] for c in kinds}
            for text, k, l, places in zip(*(b.column(c).to_pylist() for c in ("text", "k", "l", "places")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                # Regions of one document in one shard that overlap are one: no place may meet itself.
                shard, start, end = None, 0, 0
                for p in [*sorted((p["shard"], p["s"], p["e"]) for p in places), (None, 0, 0)]:
                    if p[0] == shard and p[1] <= end:
                        end = max(end, p[2])
                        continue
                    if shard is not None:
                        for c, v in zip(kinds, (shard, k, l, start, raw[start:end]), strict=True):
                            out[c].append(v)
                    shard, start, end = p
            yield _batch(out, kinds)

    regions = rows.select("text", "k", "l").join(wanted, ["k", "l"]).mapInArrow(fetch, "shard long, k long, l long, s long, data binary")
    regions = materialize(regions, "shards")

    def sort(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict.fromkeys(("k", "l", "s", "e"), i64)
        shard, held = None, []

        def done() -> pa.RecordBatch:
            # A repeated row brings its regions twice; as an occurrence it was counted before.
            own = {(k, l, s): data for k, l, s, data in held}
            out: dict[str, list] = {c: [] for c in kinds}
            for (k, l, s), here in zip(own, repeated_starts(list(own.values()), length), strict=True):
                for a, e in spans(np.flatnonzero(here), length):
                    for c, v in zip(kinds, (k, l, s + a, s + e), strict=True):
                        out[c].append(v)
            return _batch(out, kinds)

        for b in batches:
            for g, *row in zip(*(b.column(c).to_pylist() for c in ("shard", "k", "l", "s", "data")), strict=True):
                if g != shard and held:
                    yield done()
                    held.clear()
                shard = g
                held.append(row)
        if held:
            yield done()

    sharded = regions.filter("shard >= 0").repartition("shard").sortWithinPartitions("shard").mapInArrow(sort, "k long, l long, s long, e long")

    def strings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict.fromkeys(("a", "b", "k", "l", "s"), i64)
        for b in batches:
            for k, l, s, data in zip(*(b.column(c).to_pylist() for c in ("k", "l", "s", "data")), strict=True):
                raw = np.frombuffer(data, np.uint8)
                for c, e in _chunks(len(raw), settings):
                    x, y = (window_hashes(raw[c:e], length, n, settings.chunk).view(np.int64) for n in (0, 1))
                    yield _batch({"a": [x], "b": [y], "k": [np.full(len(x), k)], "l": [np.full(len(x), l)], "s": [s + c + np.arange(len(x))]}, kinds)

    # Anchors with very many different regions: all strings about them are counted by their hashes of 128 bits.
    used = [found, known, met, regions]
    every = regions.filter("shard = -2").mapInArrow(strings, "a long, b long, k long, l long, s long")
    if known.filter(F.col("kinds") > settings.hot).isEmpty():
        hot = sharded.limit(0)
    else:
        every = materialize(every.distinct(), "strings")
        used.append(every)
        often = every.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1")
        hot = every.join(often, ["a", "b"]).select("k", "l", "s", (F.col("s") + length).alias("e"))
    marks = met.filter("copied").select("k", "l", "s", "e").unionByName(sharded).unionByName(hot)
    # Passages: rows with the same text as another, and texts that share one with another text. Either comes as a mark
    # without a place, so that it meets the rows in the same exchange.
    copied = rows.groupBy("t").count().filter("count > 1").select("t", F.lit(-1).cast("long").alias("s"))
    told = copied.unionByName(texts_with_passages(rows.select("t", "text"), settings.passage).withColumn("s", F.lit(-2).cast("long")))
    told = rows.select("k", "l", "t").join(told, "t").select("k", "l", "s", F.col("s").alias("e"))
    marks = marks.unionByName(told).groupBy("k", "l").agg(F.collect_set(F.struct("s", "e")).alias("marks"))
    marks = materialize(marks, "marks")
    release(*used)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"doc_id": i64, "n_bytes": i64, "n_removed": i64, "n_spans": i64, "kept_sha256": pa.string(), "repeats_passage": pa.bool_()} | ({"kept": pa.binary()} if with_text else {})
        for b in batches:
            out: dict[str, list] = {c: [] for c in kinds}
            for doc_id, text, found in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "marks")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                parts, at, runs, told = [], 0, 0, False
                for s, e in sorted((x["s"], x["e"]) for x in found or ()):
                    if s < 0:
                        told |= s == -2 or len(raw.split()) > settings.passage
                        continue
                    if s > at or not runs:
                        parts.append(raw[at:s])
                        runs += 1
                    at = max(at, e)
                parts.append(raw[at:])
                kept = b"".join(parts)
                row = (doc_id, len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest(), told, kept)
                for c, v in zip(kinds, row, strict=False):
                    out[c].append(v)
            yield _batch(out, kinds)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeats_passage boolean" + ", kept binary" * with_text
    return rows.join(marks, ["k", "l"], "left").select("doc_id", "text", "marks").mapInArrow(cut, schema)


def spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The runs that strings of the given length from these starts (ascending) cover."""
    if not len(starts):
        return []
    gaps = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, gaps + 1)].tolist(), (starts[np.append(gaps, len(starts) - 1)] + length).tolist(), strict=True))
