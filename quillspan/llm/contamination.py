"""Benchmark decontamination by the q-gram lemma: texts that hold a benchmark item with few edits.

A string within e edits of an item of m bytes shares at least m - q + 1 - q e of its q-grams with it, all on diagonals
(place in the text less place in the item) that lie within e of each other on either side. Shared q-grams are counted in
bands of diagonals that overlap by half, so some band holds all of them; bands that meet the bound are verified by a
banded alignment. Texts and items are compared lower-cased, with runs of white space as one space.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import filter_rows

Q = 8  # a q-gram is exactly one 64-bit word
BITS = 22


@dataclass(frozen=True)
class Settings:
    """rate: edits allowed, as a share of an item's bytes (no more than the lemma can filter). block: bytes of items that
    are compared, and broadcast, at once; more items are taken in further blocks. piece: bytes of text looked at at once."""

    rate: float = 0.1
    block: int = 4_000_000
    piece: int = 1 << 20


def normalise(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")


def grams(raw: bytes | np.ndarray) -> np.ndarray:
    """Each run of 8 bytes as a number."""
    n = len(raw) - Q + 1
    return np.ndarray((max(n, 0),), "<u8", raw, 0, (1,)).astype(np.uint64) if n > 0 else np.zeros(0, np.uint64)


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


def budget(size: int, rate: float) -> int:
    """Edits allowed for an item of so many bytes: at least one q-gram must be left in common."""
    return max(0, min(int(rate * size), (size - Q) // Q))


@dataclass
class Index:
    ids: list[int]
    items: list[bytes]
    rate: float
    tiny: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        sizes = np.array([len(x) for x in self.items], np.int64)
        self.edits = np.array([budget(n, self.rate) for n in sizes], np.int64)
        self.least = np.maximum(1, sizes - Q + 1 - Q * self.edits)
        self.tiny = [k for k, n in enumerate(sizes) if 0 < n < Q]
        codes = [grams(x) for x in self.items]
        code = np.concatenate([*codes, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes] + [np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(code, kind="stable")
        self.codes, self.starts = np.unique(code[order], return_index=True)
        self.starts = np.append(self.starts, len(code))
        self.item, self.place = item[order], place[order]
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[_slot(self.codes)] = True

    def candidates(self, raw: bytes, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first and last diagonal) of bands that meet the bound. raw: texts parted by 8 zero bytes."""
        codes = grams(raw)
        at = np.flatnonzero(self.maybe[_slot(codes)])
        k = np.searchsorted(self.codes, codes[at])
        k[k == len(self.codes)] = 0
        same = self.codes[k] == codes[at] if len(self.codes) else np.zeros(0, bool)
        at, k = at[same], k[same]
        counts = self.starts[k + 1] - self.starts[k]
        post = np.repeat(self.starts[k] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(k) else np.zeros(0, np.int64)
        at = np.repeat(at, counts)
        item, text = self.item[post], np.searchsorted(starts, at, "right") - 1
        diagonal = at - starts[text] - self.place[post]
        width = 2 * self.edits[item] + 1
        band = diagonal // width + (1 << 28)
        text, item, band, post = (np.concatenate([x, x]) for x in (text, item, band, post))
        band[len(band) // 2 :] -= 1
        if not len(text):
            return
        # Of an item's q-grams in a band, each place in the item counts once. Bands with too few hits at all go first.
        key = (text.astype(np.uint64) << np.uint64(44)) | item.astype(np.uint64)
        order = np.lexsort((band, key))
        key, band, post, item, text = key[order], band[order], post[order], item[order], text[order]
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (band[1:] != band[:-1])]))
        sizes = np.diff(np.append(new, len(key)))
        for s, n in zip(new[sizes >= self.least[item[new]]], sizes[sizes >= self.least[item[new]]], strict=True):
            i = int(item[s])
            if len(np.unique(self.place[post[s : s + n]])) >= self.least[i]:
                w = 2 * int(self.edits[i]) + 1
                first = (int(band[s]) - (1 << 28)) * w
                yield int(text[s]), i, first, first + 2 * w - 1


def align(item: bytes, text: bytes, first: int, last: int, most: int) -> tuple[int, int] | None:
    """The fewest edits between item and a string of text that begins on a diagonal from first to last, and where it
    ends; None if over most. Only diagonals within most of those are filled in."""
    lo, hi = first - most, last + most
    m, n, width = len(item), len(text), hi - lo + 1
    a = np.frombuffer(item, np.uint8)
    padded = np.full(width + m, 256, np.int16)
    x, y = max(0, lo), min(n, hi + m)
    if y <= x:
        return None
    padded[x - lo : y - lo] = np.frombuffer(text, np.uint8, y - x, x)
    far = most + 1
    place = np.arange(width)
    row = np.where((place + lo >= 0) & (place + lo <= n), 0, far)
    for i in range(1, m + 1):
        step = row + (padded[i - 1 : i - 1 + width] != a[i - 1])
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        outside = (place + lo + i < 0) | (place + lo + i > n)
        step[outside] = far
        row = np.minimum(np.minimum.accumulate(step - place) + place, far)
        row[outside] = far
        if row.min() > most:
            return None
    k = int(np.argmin(row))
    return (int(row[k]), k + lo + m) if row[k] <= most else None


def matches(texts: list[bytes], index: Index, piece: int) -> list[dict[int, tuple[int, int]]]:
    """For each normalised text, the items that it holds, with the edits and the end of the best place."""
    out: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
    for k in index.tiny:
        for t, found in zip(texts, out, strict=True):
            at = t.find(index.items[k])
            if at >= 0:
                found[index.ids[k]] = 0, at + len(index.items[k])
    held, size = [], 0
    for n in range(len(texts) + 1):
        if n == len(texts) or (size and size + len(texts[n]) > piece):
            if held:
                raw = bytes(Q).join(texts[h] for h in held)
                sizes = np.array([len(texts[h]) + Q for h in held])
                for t, i, first, last in index.candidates(raw, np.cumsum(sizes) - sizes):
                    found, item, text = out[held[t]], index.items[i], texts[held[t]]
                    best = found.get(index.ids[i])
                    if best and best[0] == 0:
                        continue
                    at = text.find(item, max(0, first), max(0, last + len(item)) + 1)
                    hit = (0, at + len(item)) if at >= 0 else align(item, text, first, last, int(index.edits[i]))
                    if hit and (best is None or hit < best):
                        found[index.ids[i]] = hit
            held, size = [], 0
        if n < len(texts):
            held.append(n)
            size += len(texts[n]) + Q
    return out


def indexes(benchmark: DataFrame, settings: Settings) -> Iterator[Index]:
    """In blocks of about settings.block bytes. Items without text or id are passed over."""
    items = benchmark.select("item_id", "text").filter("item_id IS NOT NULL AND trim(text) <> ''")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // settings.block))
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = sorted((r["item_id"], normalise(r["text"])) for r in part.collect())
        rows = [r for r in dict.fromkeys(rows) if r[1]]
        yield Index([i for i, _ in rows], [t for _, t in rows], settings.rate)


def find_items(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending) and edits (of each), one row per row of docs (doc_id, text).

    Each block of items is compared with whole texts in one pass over docs; nothing is shuffled. Null and empty texts
    and an empty benchmark give no matches; null ids and repeated rows are kept as they are; an empty table gives no
    rows; other columns are ignored. Items with the same id and text count once; of an id's several texts the best counts.
    """
    spark = docs.sparkSession
    found = docs.select("doc_id", "text", F.expr("cast(array() as array<bigint>)").alias("item_ids"), F.expr("cast(array() as array<bigint>)").alias("edits"))
    for index in indexes(benchmark, settings):
        shared = spark.sparkContext.broadcast((index.ids, index.items, index.rate))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Index(*shared.value)
            kind = pa.list_(pa.int64())
            for b in batches:
                new = matches([normalise(x) for x in b.column("text").to_pylist()], own, settings.piece)
                ids, edits = [], []
                for i, e, m in zip(b.column("item_ids").to_pylist(), b.column("edits").to_pylist(), new, strict=True):
                    best = dict(zip(i, e, strict=True))
                    for k, (n, _) in m.items():
                        best[k] = min(n, best.get(k, n))
                    ids.append(sorted(best))
                    edits.append([best[k] for k in sorted(best)])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(ids, kind), pa.array(edits, kind)], names=["doc_id", "text", "item_ids", "edits"])

        found = found.mapInArrow(run, found.schema)
    size = F.size("item_ids")
    return found.select("doc_id", (size > 0).alias("contaminated"), size.cast("long").alias("n_items"), "item_ids", "edits")


def clean_rows(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; each row is judged by itself, whatever its id."""
    for index in indexes(benchmark, settings):
        shared = docs.sparkSession.sparkContext.broadcast((index.ids, index.items, index.rate))
        held: dict[int, Index] = {}

        def keep(texts: list, shared=shared, held=held) -> list[bool]:
            own = held.get(0) or held.setdefault(0, Index(*shared.value))
            return [not m for m in matches([normalise(x) for x in texts], own, settings.piece)]

        docs = filter_rows(docs, keep, ("text",))
    return docs
