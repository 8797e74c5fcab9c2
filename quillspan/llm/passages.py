"""Which texts hold a passage (a run of more words than a limit) that another text holds too, word for word.

Runs of eight words that have the least hash among all those of some passage-long window are anchors: equal passages hold
equal anchors. Around anchors that several texts hold, all windows one word longer than the limit are hashed; texts that
share one of them share a passage. Anchors that few texts hold are compared in one task; for the others the windows
themselves are grouped, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import materialize, release
from quillspan.llm.suffix_hashes import minima, mix, powers, prefix_sums

GRAM = 8
BLOCK = 1 << 18
PART = 1 << 22
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word (what ASCII white space parts)."""
    import xxhash

    a = np.frombuffer(raw, np.uint8)
    space = np.concatenate([[True], _SPACE[a], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        # As many words as a block of bytes holds, one at least.
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        if ends[end - 1] - starts[at] > BLOCK:
            out[at] = xxhash.xxh64_intdigest(raw[starts[at] : ends[at]], 42)
        else:
            s, e = starts[at:end] - starts[at], ends[at:end] - starts[at]
            p = prefix_sums(a[starts[at] : ends[end - 1]], 0, BLOCK)
            out[at:end] = mix((p[e] - p[s]) * powers(0, BLOCK)[0][s] + (e - s).astype(np.uint64))
        at = end
    return out


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of size words, given the words' hashes."""
    out = np.empty(max(0, len(words) - size + 1), np.uint64)
    up, down, _ = powers(1, BLOCK)
    for at in range(0, len(out), BLOCK - size):
        w = words[at : at + BLOCK]
        p = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(w * down[: len(w)], out=p[1:])
        n = min(BLOCK - size, len(out) - at)
        out[at : at + n] = mix((p[size : size + n] - p[:n]) * up[:n])
    return out


def texts_with_passages(texts: DataFrame, limit: int, few: int = 2000) -> DataFrame:
    """t of those texts (t: a hash of the text, text) that share a run of more than limit words with a text of another t."""
    size = limit + 1
    windows = size - GRAM + 1
    i64 = pa.int64()

    def anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[np.zeros(0, np.int64)] for _ in range(3)]
            for t, text in zip(b.column("t").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = word_hashes(text.encode("utf-8", "surrogatepass"))
                if len(words) < size:
                    continue
                h = run_hashes(words, GRAM)
                # Parts overlap by a window less one, so that each window lies in one of them.
                at = np.unique(np.concatenate([k + minima(h[k : k + PART + windows - 1], windows) for k in range(0, len(h) - windows + 1, PART)]))
                for c, v in zip(out, (h[at].view(np.int64), np.full(len(at), t), at), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), i64) for c in out], names=["h", "t", "at"])

    found = materialize(texts.mapInArrow(anchors, "h long, t long, at long"), "passage-anchors")
    many = found.groupBy("h").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count("*").alias("n")).filter("low <> high").select("h", "n")
    many = materialize(many, "passage-many")
    wanted = found.join(many, "h").groupBy("t").agg(F.collect_set(F.struct("at", "h", "n")).alias("anchors"))

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for t, text, own in zip(*(b.column(c).to_pylist() for c in ("t", "text", "anchors")), strict=True):
                w = run_hashes(word_hashes(text.encode("utf-8", "surrogatepass")), size).view(np.int64)
                # One anchor at several places of a text: its windows are put together.
                places: dict[tuple[int, int], list[int]] = {}
                for x in own:
                    places.setdefault((x["h"], x["n"]), []).append(x["at"])
                for (h, n), at in places.items():
                    near = np.unique(np.concatenate([w[max(0, p - windows + 1) : p + 1] for p in at]))
                    rows.append((h, n > few, t, near))
            c = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c[0], i64), pa.array(c[1], pa.bool_()), pa.array(c[2], i64), pa.array(c[3], pa.list_(i64))], names=["h", "hot", "t", "windows"])

    one = texts.join(wanted, "t").dropDuplicates(["t"]).select("t", "text", "anchors")
    near = materialize(one.mapInArrow(spread, "h long, hot boolean, t long, windows array<long>"), "passage-windows")

    def shared(windows: list, texts: list[int]) -> np.ndarray:
        """Which texts hold a window that another one of them holds (a text's own windows differ)."""
        sizes = np.array([len(w) for w in windows])
        _, at, counts = np.unique(np.concatenate(windows), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(windows)), sizes)
        return np.array(texts, np.int64)[np.unique(owner[counts[at] > 1])]

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows, texts = None, [], []
        for b in batches:
            out = [np.zeros(0, np.int64)]
            column = b.column("windows")
            values, ends = column.flatten().to_numpy(), np.cumsum([0, *column.value_lengths().to_pylist()])
            for k, (h, t) in enumerate(zip(b.column("h").to_pylist(), b.column("t").to_pylist(), strict=True)):
                if h != now and windows:
                    out.append(shared(windows, texts))
                    windows, texts = [], []
                now = h
                windows.append(values[ends[k] : ends[k + 1]])
                texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)), i64)], names=["t"])
        if windows:
            yield pa.RecordBatch.from_arrays([pa.array(shared(windows, texts), i64)], names=["t"])

    cold = near.filter("NOT hot").repartition("h").sortWithinPartitions("h").select("h", "t", "windows").mapInArrow(compare, "t long")
    each = near.filter("hot").select("t", F.explode("windows").alias("w"))
    twice = each.groupBy("w").agg(F.min("t").alias("low"), F.max("t").alias("high")).filter("low <> high").select("w")
    out = materialize(cold.union(each.join(twice, "w").select("t")).distinct(), "passages")
    release(found, many, near)
    return out
