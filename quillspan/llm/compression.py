"""Compression classifier: what zstandard dictionaries of good and of bad text save becomes a calibrated score.

Texts are coded in blocks with either dictionary. The difference of the two sizes, as a share of their sum, and how far
both shrink the text feed a logistic calibration, fitted on labelled rows that built no dictionary.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import id_hash


@dataclass(frozen=True)
class Settings:
    """per_class and longest bound the labelled sample that the driver fits on: at most 2 * per_class texts, each of at
    most longest characters (longer ones are not learned from, but are scored whole like all others)."""

    per_class: int = 1500
    longest: int = 16_000
    dictionary: int = 112_640
    block: int = 4096
    level: int = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]
    prior: float
    block: int
    level: int

    def __post_init__(self) -> None:
        self._coders = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_coders": None}

    def features(self, text: str) -> tuple[float, float, float]:
        """1 and the two features; the text must not be empty."""
        if self._coders is None:
            self._coders = [zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(x), write_content_size=False, write_dict_id=False, write_checksum=False) for x in (self.good, self.bad)]
        raw = text.encode("utf-8", "surrogatepass")
        good, bad = (sum(len(c.compress(raw[k : k + self.block])) for k in range(0, len(raw), self.block)) for c in self._coders)
        return 1.0, 20 * (bad - good) / (bad + good), math.log((bad + good) / (2 * len(raw)))

    def score(self, text: str) -> float:
        """The chance of label 1; for an empty text, the share of label 1 among the labels."""
        if not text or not self.weights:
            return self.prior
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, sum(w * x for w, x in zip(self.weights, self.features(text), strict=True))))))


def _dictionary(texts: list[str], size: int) -> bytes:
    """A trained dictionary, or where there is too little text to train one, the text itself."""
    parts = [t.encode("utf-8", "surrogatepass")[k : k + 2048] for t in texts for k in range(0, len(t), 2048)]
    parts = [p for p in parts if p]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(parts)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """docs: doc_id, text; labels: doc_id, quality (rows without either are passed over; of several, the mean is taken).

    Without texts of both labels there is nothing to tell apart: every text then scores the share of label 1 (half, if
    there are no labels).
    """
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    total = {r["good"]: r["count"] for r in marks.groupBy("good").count().collect()}
    n = sum(total.values())
    prior = (total.get(True, 0) / n) if n else 0.5
    order = F.xxhash64("doc_id")
    picked = [marks.filter(F.col("good") == g).orderBy(order, "doc_id").limit(settings.per_class) for g in (True, False)]
    picked = F.broadcast(picked[0].union(picked[1]))  # at most 2 * per_class ids
    texts = docs.filter(F.length("text").between(1, settings.longest)).join(picked, "doc_id").select("doc_id", "good", "text").dropDuplicates(["doc_id"])
    rows = sorted((r["doc_id"], r["good"], r["text"]) for r in texts.collect())
    by = {g: [t for _, x, t in rows if x == g] for g in (True, False)}
    model = Model(b"", b"", [], prior, settings.block, settings.level)
    if min(map(len, by.values())) < 2:
        return model
    model.good, model.bad = (_dictionary(by[g][::2], settings.dictionary) for g in (True, False))
    rest = [(t, g) for g in (True, False) for t in by[g][1::2]]
    x, y = np.array([model.features(t) for t, _ in rest]), np.array([float(g) for _, g in rest])
    share = {g: total[g] / max(1, sum(k == g for _, k in rest)) for g in (True, False)}
    model.weights = _logistic(x, y, np.array([share[g] for _, g in rest]) * len(rest) / n).tolist()
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted, one row per row of docs. Nothing is shuffled; the model is of bounded size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = np.array([m.score(t or "") for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.7, settings: Settings = Settings()) -> DataFrame:
    """Fit on the labels outside of the held-out fold (crc32 of the id's text, modulo folds), then score all documents.

    Returns doc_id, held_out, score, predicted. Null and empty texts score the share of label 1; a null doc_id counts as
    the empty id; repeated rows are scored each; an empty table gives no rows; other columns are ignored.
    """
    fold = F.pmod(id_hash("doc_id"), F.lit(folds))
    model = fit(docs.filter(fold != held), labels.filter(fold != held), settings)
    return score(docs, model, threshold).select("doc_id", (fold == held).alias("held_out"), "score", "predicted")
