"""Greedy packing of units into overlapping chunks: each fills up to the target, the next steps back by the overlap."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import clean, units, words


def pack(sizes: Sequence[int], target: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of units. By prefix sums: a chunk holds one unit at least and the target at most; the next begins at the
    earliest later unit from which no more than the overlap is repeated."""
    sums = [0]
    for n in sizes:
        sums.append(sums[-1] + n)
    out, start = [], 0
    while start < len(sizes):
        end = start + 1
        while end < len(sizes) and sums[end + 1] - sums[start] <= target:
            end += 1
        out.append((start, end))
        if end == len(sizes):
            break
        start = next(b for b in range(start + 1, end + 1) if sums[end] - sums[b] <= overlap)
    return out


def chunks(docs: DataFrame, target: int = 120, overlap: int = 20, least: int = 5) -> DataFrame:
    """chunk_id, doc_id, chunk_no, n_tokens and text; numbers count the kept chunks. Documents are packed where they are."""
    ready = docs.select("doc_id", units(clean(F.col("text"))).alias("units"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, own in zip(b["doc_id"], b["units"], strict=True):
                parts = []
                for u in own if own is not None else ():
                    w = u.split()
                    parts += [" ".join(w[k : k + target]) for k in range(0, len(w), target)] if len(w) > target else [u]
                sizes = [len(u.split()) for u in parts]
                number = 0
                for s, e in pack(sizes, target, overlap):
                    if sum(sizes[s:e]) >= least:
                        rows.append((f"{doc}:p1:c{number}", doc, number, sum(sizes[s:e]), "\n".join(parts[s:e])))
                        number += 1
            yield pd.DataFrame(rows, columns=["chunk_id", "doc_id", "chunk_no", "n_tokens", "text"])

    return ready.mapInPandas(run, "chunk_id string, doc_id long, chunk_no int, n_tokens int, text string")


def word_windows(docs: DataFrame, size: int = 260, least: int = 30) -> DataFrame:
    """doc_id, chunk_no (from 0), n_tokens and text of windows of so many words, those of fewer than least left out."""
    w = docs.select("doc_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int")), lambda k: F.slice("w", k * size + 1, F.lit(size)))
    out = w.select("doc_id", F.posexplode(cut).alias("chunk_no", "own")).filter(F.size("own") >= least)
    return out.select("doc_id", "chunk_no", F.size("own").alias("n_tokens"), F.array_join("own", " ").alias("text"))
