"""SimHash fingerprints, an exact search of all fingerprints within a radius, and the groups that they form."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import drop_exchanges, materialize, release, sliced

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of size words, joined by spaces; of all words where there are fewer."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    text = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(text, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1]
    return np.array([digest(text[s:e], 42) for s, e in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def bit_majority(h: np.ndarray) -> np.ndarray:
    """The 64 bits that over half of the hashes set, as one word."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 255 * 256):
        bits = np.unpackbits(h[k : k + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        # Sums of 255 bits fit into bytes.
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None, size: int = 3) -> int:
    """64 bits; one is 1 if it is set in over half of the shingle hashes. A text without words has 0."""
    h = shingle_hashes(_words(text), size)
    return int(bit_majority(h)[0]) if len(h) else 0


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed 64-bit number), one row per row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, size) for x in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """fps: n x w words. 64 w x ceil(n / 64) words: bit j of word k in plane b is bit b of fingerprint 64 k + j."""
    n, w = fps.shape
    bits = np.zeros((-(-n // 64) * 64, 64 * w), np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _hits(planes: int, plane, over: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of 64 distances that are counted at once: where they stand, and which bits of them are within the radius.

    plane(b, at) gives bit b of the differences of the words at; over: bits that do not count. Carry-save counters add
    plane after plane, one word for each binary digit; counts that exceed what the digits hold stay marked, and a word is
    abandoned when all of its counts exceed the radius.
    """
    digits = max(1, (radius + 1).bit_length())
    at = np.flatnonzero(over != FULL)
    over, count = over[at], np.zeros((digits, len(at)), np.uint64)
    for b in range(planes):
        if not len(at):
            break
        carry = plane(b, at)
        for d in range(digits):
            count[d], carry = count[d] ^ carry, count[d] & carry
        over |= carry
        if b % 8 == 7 or b == planes - 1:
            # Which counts exceed the radius so far: compare digit by digit from the highest.
            more, same = np.zeros_like(over), np.full_like(over, FULL)
            for d in reversed(range(digits)):
                if radius >> d & 1:
                    same &= count[d]
                else:
                    more |= same & count[d]
                    same &= ~count[d]
            over |= more
            alive = over != FULL
            if not alive.all():
                at, over, count = at[alive], over[alive], count[:, alive]
    return at, ~over


def _set_bits(at: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set bit of the words, which word it is of, and its place there."""
    bits = np.unpackbits(np.ascontiguousarray(hits).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    r, j = np.nonzero(bits)
    return at[r], j


def within(queries: np.ndarray, fps: np.ndarray, radius: int, step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query, fingerprint) at a distance of radius or less; both are n x w words."""
    planes = bit_planes(fps)
    width = planes.shape[1]
    valid = np.full(width, FULL)
    if len(fps) % 64:
        valid[-1] = np.uint64((1 << (len(fps) % 64)) - 1)
    for first in range(0, len(queries), step):
        q = queries[first : first + step]
        plane = lambda b, at: planes[b][at % width] ^ np.where((q[at // width, b >> 6] >> np.uint64(b & 63)) & np.uint64(1), FULL, np.uint64(0))  # noqa: B023, E731
        word, j = _set_bits(*_hits(len(planes), plane, np.tile(~valid, len(q)), radius))
        yield first + word // width, (word % width) * 64 + j


def neighbours(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius of many small groups (of at most 64 fingerprints) at once: each fingerprint is
    compared with the one d places further on, for all places of all groups, by shifting the bit planes by d."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rows = np.concatenate([np.zeros(0, np.int64), *(np.arange(s, e) for s, e in zip(starts, ends, strict=True))]).astype(np.int64)
    left = np.repeat(ends, ends - starts) - rows  # members from here to the group's end
    size = np.repeat(ends - starts, ends - starts)
    for d in range(1, int((ends - starts).max(initial=1))):
        keep = size > d
        rows, left, size = rows[keep], left[keep], size[keep]
        planes = bit_planes(fps[rows])
        ahead = np.concatenate([planes[:, 1:], np.zeros((len(planes), 1), np.uint64)], axis=1)
        shift = np.uint64(d)
        differs = planes ^ ((planes >> shift) | (ahead << (np.uint64(64) - shift)))
        over = np.packbits(np.append(left <= d, np.ones(-len(left) % 64, bool)), bitorder="little").view(np.uint64)
        word, j = _set_bits(*_hits(len(planes), lambda k, at: differs[k][at], over, radius))  # noqa: B023
        a.append(rows[word * 64 + j])
        b.append(rows[word * 64 + j + d])
    return np.concatenate(a), np.concatenate(b)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n can reach by the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for at in (a, b, root[a], root[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def group_links(nodes: np.ndarray, fps: np.ndarray, radius: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one group: nodes, each with the first that it reaches.

    side: 0 and 1 for the two tiles of a divided group, whose members are only compared with the other tile's.
    """
    n = len(fps)
    one, two = (np.arange(n),) * 2 if side is None else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    found = list(within(fps[one], fps[two], radius))
    a, b = (np.concatenate([i[x[k]] for x in found] or [np.zeros(0, np.int64)]) for k, i in ((0, one), (1, two)))
    root = _roots(a, b, n)
    off = np.flatnonzero(root != np.arange(n))
    return nodes[off], nodes[root[off]]


def keyed_links(keyed: DataFrame, key: list[str], radius: int, tile: int = 4096) -> DataFrame:
    """keyed: node (long), fp (binary) and the columns key. Links a-b of nodes that share a key and lie within the
    radius; they have the same components as all such pairs.

    A key that more than tile nodes share is divided into tiles, and each pair of tiles is a group of its own: every
    pair is still compared, in bounded memory.
    """
    counts = keyed.groupBy(*key).count().filter("count > 1")
    met = keyed.join(counts, key).withColumn("tiles", F.ceil(F.col("count") / tile).cast("int")).withColumn("own", F.pmod(F.hash("node"), "tiles"))
    met = met.select(*key, "node", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    met = met.select(F.xxhash64(*key, F.least("own", "other"), F.greatest("own", "other")).alias("g"), *key, "node", "fp", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"), "own")
    group = [*key, "t", "u"]
    met = met.repartition("g").sortWithinPartitions(*group).select(*group, "own", "node", "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None

        def compare(keys: np.ndarray, starts: np.ndarray, own: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            ends = np.append(starts[1:], len(keys))
            tiles = keys[starts, -2] != keys[starts, -1]
            small = (ends - starts > 1) & (ends - starts <= 64) & ~tiles
            x, y = neighbours(fps, starts[small], ends[small], radius)
            a.append(nodes[x])
            b.append(nodes[y])
            large = (ends - starts > 1) & ~small
            for s, e in zip(starts[large], ends[large], strict=True):
                t, u = keys[s, -2:]
                x, y = group_links(nodes[s:e], fps[s:e], radius, None if t == u else (own[s:e] == u).astype(np.int8))
                a.append(x)
                b.append(y)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        def starts_of(keys: np.ndarray) -> np.ndarray:
            return np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in group], axis=1)
            fps = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64).reshape(len(keys), -1)
            new = keys, *(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("own", "node")), fps
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            starts = starts_of(held[0])
            if len(starts) > 1:  # the last group may go on in the next batch
                last = starts[-1]
                yield compare(held[0][:last], starts[:-1], *(x[:last] for x in held[1:]))
                held = tuple(x[last:] for x in held)
        if held is not None:
            yield compare(held[0], starts_of(held[0]), *held[1:])

    return met.mapInArrow(run, "a long, b long").distinct()


def links(distinct: DataFrame, radius: int = 2, tile: int = 4096) -> DataFrame:
    """Links a-b of distinct fingerprints (column fp) whose components are those of all pairs within the radius.

    The bits are divided into radius + 2 blocks; two fingerprints within the radius agree on two blocks at least, so
    they meet under the key of those two.
    """
    parts = radius + 2
    edges = [round(64 * k / parts) for k in range(parts + 1)]
    cut = lambda k: F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1))
    keys = F.array(*(F.struct(F.lit(n).alias("combo"), cut(i).alias("x"), cut(j).alias("y")) for n, (i, j) in enumerate(combinations(range(parts), 2))))
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("k.combo", "k.x", "k.y", F.col("fp").alias("node"), F.to_binary(F.lpad(F.hex("fp"), 16, "0")).alias("fp"))
    return keyed_links(keyed, ["combo", "x", "y"], radius, tile)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and label: the smallest node of its component, for all nodes of edges (columns a, b).

    Each round takes the least label among the neighbours and then the label's own label, so paths shorten by half; the
    labels are written to the shared folder each round. It ends when nothing changes.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = materialize(step.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.filter("old <> label").isEmpty():
            return labels
    raise RuntimeError("the components did not settle")


def near_groups(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest doc_id reachable by links, itself included.

    Texts are compared by their fingerprints alone. Null and empty texts have fingerprint zero and link like any other;
    rows with a null doc_id take part, and a group of such rows alone has a null component_id; repeated rows are kept;
    an empty table gives no rows; other columns are ignored.
    """
    docs = materialize(fingerprints(docs, size), "fingerprints")
    least = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = components(links(least.select("fp"), radius))
    rooted = least.join(labels, least.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(ids, "root").select("fp", "component_id")
    return docs.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(_words(text), size))


def _set_hash(h: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(h.tobytes(), 42) - (1 << 63)


def shingle_levels(docs: DataFrame, size: int, slots: int) -> np.ndarray:
    """A byte for each slot: the binary logarithm of the number of texts' shingles in it. It only orders the work."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for b in sliced(batches):
            found = [shingle_set(x, size) for x in b.column("text").to_pylist()]
            total += np.bincount((np.concatenate([np.zeros(0, np.uint64), *found]) % np.uint64(slots)).astype(np.int64), minlength=slots)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 100_000]), pa.array(total[at[k : k + 100_000]])], names=["slot", "n"])

    table = docs.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).select("slot", F.floor(F.log2("n")).cast("int").alias("level")).toArrow()
    levels = np.zeros(slots, np.uint8)
    levels[table["slot"].to_numpy()] = table["level"].to_numpy()
    return levels


def similar_pairs(docs: DataFrame, overlap: float = 0.8, size: int = 5, slots: int = 1 << 20, prints: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as doc_id, h (a hash of the text), node (their set of shingles) and fp (their fingerprint, null
    without prints), and the links a-b of all nodes whose sets have a Jaccard similarity of overlap or more.

    The join is exact: shingles are ordered by rarity, sets that similar share one among their first
    n - ceil(overlap n) + 1, of the shorter set among even fewer; what meets there is verified on the whole sets.
    """
    t = overlap
    levels = docs.sparkSession.sparkContext.broadcast(shingle_levels(docs, size, slots))

    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            nodes, sizes, firsts, fps = [], [], [], []
            for text in b.column("text").to_pylist():
                fps.append(int(np.uint64(fingerprint(text)).view(np.int64)) if prints else None)
                h = shingle_set(text, size)
                nodes.append(_set_hash(h))
                sizes.append(len(h))
                order = np.lexsort((h, levels.value[(h % np.uint64(slots)).astype(np.int64)]))
                firsts.append(h[order[: len(h) - int(np.ceil(t * len(h) - 1e-9)) + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("h"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(fps, pa.int64())], names=["doc_id", "h", "node", "n", "first", "fp"])

    texts = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    sets = materialize(texts.mapInArrow(prefixes, "doc_id long, h long, node long, n int, first array<long>, fp long"), "shingles")
    drop_exchanges(docs.sparkSession)  # that of the levels
    packed = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at").cast("long"))
    rows = sets.select("node", "n", F.posexplode("first").alias("at", "shingle")).select("shingle", "node", packed.alias("size"))
    rows = rows.repartition("shingle").groupBy("shingle", "node").agg(F.min("size").alias("size"))
    cut = lambda k: (F.shiftright("size", 32).alias(f"n_{k}"), F.col("size").bitwiseAND(0xFFFFFFFF).alias(f"at_{k}"))
    x, y = (rows.select("shingle", F.col("node").alias(k), *cut(k)) for k in "ab")
    # a is the larger set, by the node where both are as large.
    y = y.filter(F.col("at_b") <= F.col("n_b") - F.ceil(2 * t / (1 + t) * F.col("n_b") - 1e-9))
    need = F.ceil(t / (1 + t) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    fits = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") > F.col("b")))
    fits &= F.col("n_b") >= t * F.col("n_a") - 1e-9
    fits &= F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= need
    pairs = materialize(x.join(y, "shingle").filter(fits).select("a", "b").distinct(), "candidates")
    drop_exchanges(docs.sparkSession)  # those of the prefixes
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    hashes = sets.groupBy("node").agg(F.min("h").alias("h")).join(wanted, "node", "left_semi").select("h")

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [shingle_set(x, size) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_set_hash(h) for h in found], pa.int64()), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], names=["node", "shingles"])

    found = texts.join(hashes, "h", "left_semi").dropDuplicates(["h"]).select("text").mapInArrow(whole, "node long, shingles array<long>")
    found = materialize(found, "whole")
    drop_exchanges(docs.sparkSession)
    x, y = (found.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    shared = F.size(F.array_intersect("sa", "sb"))
    good = shared * (1 + t) >= t * (F.size("sa") + F.size("sb")) - 1e-9
    links = materialize(pairs.join(x, "a").join(y, "b").filter(good).select("a", "b"), "links")
    release(pairs, found)
    return sets.select("doc_id", "h", "node", "fp"), links


def print_pairs(rows: DataFrame, radius: int) -> DataFrame:
    """Links a-b of nodes (rows: node, fp) by their fingerprints, which have the components of all those within the radius:
    the nodes of a fingerprint are linked to the least of them, and those of near fingerprints to each other."""
    own = materialize(rows.select("node", "fp").distinct(), "prints")
    least = own.groupBy("fp").agg(F.min("node").alias("least"))
    same = own.join(least, "fp").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    at = lambda k: least.select(F.col("fp").alias(k), F.col("least").alias(f"least_{k}"))
    near = links(least.select("fp"), radius).join(at("a"), "a").join(at("b"), "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    return materialize(same.union(near), "print-links")


def _similar_rows(docs: DataFrame, size: int, overlap: float, radius: int | None = None) -> DataFrame:
    """doc_id, h (a hash of the text) and root, the same for all rows of a group. With a radius, texts whose fingerprints
    are within it are linked too."""
    rows, pairs = similar_pairs(docs, overlap, size, prints=radius is not None)
    if radius is not None:
        pairs = pairs.union(print_pairs(rows, radius))
    labels = components(pairs).withColumnRenamed("node", "at")
    return rows.join(labels, rows.node == labels.at, "left").select("doc_id", "h", F.coalesce("label", "node").alias("root"))


def similar_groups(docs: DataFrame, size: int = 5, overlap: float = 0.8) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable, for texts whose shingle sets overlap by overlap or more.

    Every pair at that overlap is found, and each link is verified. Texts without words are one group; nulls, repeats
    and empty tables are as in near_groups.
    """
    rows = materialize(_similar_rows(docs, size, overlap), "rows")
    # Rows of a group are added up before they meet, so that a large group costs one row for each task.
    ids = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(ids, "root").select("doc_id", "component_id")


def drop_similar(docs: DataFrame, size: int = 5, overlap: float = 0.8, small: int = 8 << 20, radius: int | None = 2) -> DataFrame:
    """docs without all but one row of each group: the row with the smallest doc_id stays (a null one only if there is no
    other), of equal ids that with the smallest hash of its text, and of repeated rows one.

    Texts are linked where their SimHash fingerprints differ in radius bits or fewer, as in near_groups (None: not by
    these), and where their shingle sets overlap by overlap or more, as in similar_groups: fingerprints alone miss copies
    with some changes.

    Rows are told by id and text, so rows without an id, or with the same one, are judged each by itself.
    """
    rows = materialize(_similar_rows(docs, size, overlap, radius), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    first = rows.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    gone = rows.join(first, "root").filter(order != F.col("first")).select("doc_id", "h").distinct()
    gone = materialize(gone.select(F.col("doc_id").alias("__gone"), F.col("h").alias("__h")), "gone")
    twice = materialize(rows.groupBy("doc_id", "h").count().filter("count > 1").select(F.col("doc_id").alias("__gone"), F.col("h").alias("__h")), "twice")
    release(rows)
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    doc_id, text = plain[f"c{names.index('doc_id')}"], plain[f"c{names.index('text')}"]
    own = F.xxhash64(F.coalesce(text, F.lit("")))

    def met(table: DataFrame, how: str, left: DataFrame) -> DataFrame:
        # Rows of 16 bytes: their count bounds what is broadcast.
        table = F.broadcast(table) if 40 * table.count() <= small else table
        return left.join(table, doc_id.eqNullSafe(table["__gone"]) & (own == table["__h"]), how)

    out = met(gone, "left_anti", plain)
    if not twice.isEmpty():
        out = met(twice, "left_anti", out).unionByName(met(twice, "left_semi", out).dropDuplicates([f"c{names.index(c)}" for c in ("doc_id", "text")]))
    return out.toDF(*names)
