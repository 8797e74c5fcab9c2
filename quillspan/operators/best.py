"""What tasks keep while they go through tiles of scores: the best rows of each question. Its size doesn't follow the input."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DIGITS = 6
#: Scores of a tile at most, 8 bytes each: rows times questions.
TILE = 1 << 20
#: Questions of a tile at most.
WIDE = 1024


class Best:
    """The top rows of each of n questions by rounded score, then by key; positive: only those with a score above 0."""

    def __init__(self, n: int, top: int, positive: bool = False):
        self.n, self.top, self.positive = n, top, positive
        self.floor = np.full(n, 10.0**-DIGITS if positive else -np.inf)
        self.question, self.score, self.key = np.empty(0, np.int64), np.empty(0), None

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """scores: one row for each key, one column for each question."""
        # What rounds to the least that is kept may lie under it by half a digit; the key decides then.
        over = scores > self.floor - 10.0**-DIGITS
        if np.count_nonzero(over) > 4 * self.top * self.n and len(scores) > self.top:
            nth = np.partition(scores, len(scores) - self.top, axis=0)[len(scores) - self.top]
            over = scores > np.maximum(self.floor, nth) - 10.0**-DIGITS
        row, question = np.divmod(np.flatnonzero(over), self.n)
        score = np.round(scores[row, question], DIGITS)
        if self.positive:
            row, question, score = (x[score > 0] for x in (row, question, score))
        if not len(row):
            return
        key = keys[row]
        if self.key is not None:
            question, score, key = np.concatenate([self.question, question]), np.concatenate([self.score, score]), np.concatenate([self.key, key])
        place = np.unique(key, return_inverse=True)[1] if key.dtype == object else key
        order = np.lexsort((place, -score, question))
        q = question[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        order = order[nth < self.top]
        self.question, self.score, self.key = question[order], score[order], key[order]
        full = np.flatnonzero(nth[nth < self.top] == self.top - 1)
        self.floor[self.question[full]] = self.score[full]


def map_batches(df: DataFrame, f: Callable[[Iterable[pa.RecordBatch]], Iterator[tuple]], schema: str, most: int = 50_000) -> DataFrame:
    """mapInArrow where f yields a list or an array for each column; batches of most rows at most leave it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in f(batches):
            made = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=x.type) for c, x in zip(columns, out, strict=True)], schema=out)
            yield from (made.slice(k, most) for k in range(0, made.num_rows, most))

    return df.mapInArrow(run, schema)


def keys_of(column: pa.Array) -> np.ndarray:
    """Numbers as they are, other keys as objects."""
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) else np.array(column.to_pylist(), object)
