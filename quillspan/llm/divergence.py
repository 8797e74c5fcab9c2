"""Quality rules on whole texts: counts, and Jensen-Shannon distances to what each language usually looks like."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import filter_rows, give_back, materialize, sliced

SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "line", "point", "mark", "other")


@dataclass(frozen=True)
class Settings:
    """min_words guards the distances: shorter texts are judged by the counts alone. slack / sqrt(words) is added to the
    limits, as a short sample of the reference itself is that far from it by chance. common: words of a histogram.
    min_language_words: words that a language needs for a reference; texts of others are judged by the counts alone."""

    common: int = 48
    min_language_words: int = 2000
    min_words: int = 50
    max_class_distance: float = 0.2
    max_word_distance: float = 0.38
    slack: float = 0.5


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("mark"), np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            table[b] = CLASSES.index("other")
        elif b >= 0x80:
            table[b] = len(CLASSES)  # goes on with the character before: not counted
        elif c.islower():
            table[b] = CLASSES.index("lower")
        elif c.isupper():
            table[b] = CLASSES.index("upper")
        elif c.isdigit():
            table[b] = CLASSES.index("digit")
        elif c == "\n":
            table[b] = CLASSES.index("line")
        elif c.isspace():
            table[b] = CLASSES.index("space")
        elif c in ".,;:'\"?!-()":
            table[b] = CLASSES.index("point")
    return table


_TABLE = _class_table()


def class_counts(raw: bytes) -> np.ndarray:
    """Characters of each class; those beyond ASCII are one class."""
    return np.bincount(_TABLE[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """Words in windows of size words that are found twice or more in the text, the first included.

    Windows get numbers by doubling: equal numbers mean equal windows, so the count is exact.
    """
    n = len(words)
    if n <= size:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    length = 1
    while length < size:
        step = min(length, size - length)
        pair = ids[: len(ids) - step] * (int(ids.max()) + 1) + ids[step:]
        values, ids, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(values) == len(pair):
            return 0
        length += step
    twice = counts[ids] > 1
    change = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(change, at, 1)
    np.add.at(change, at + size, -1)
    return int((np.cumsum(change[:n]) > 0).sum())


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The Jensen-Shannon distance (base 2: from 0 to 1) of histogram p to each row of q, all of which sum to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=-1)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


@dataclass
class References:
    """For each language: its class histogram, its common words, and their histogram with all other words last."""

    names: list[str]
    classes: np.ndarray
    words: list[dict[bytes, int]]
    shares: np.ndarray


def references(docs: DataFrame, settings: Settings = Settings()) -> References:
    """From the words and characters of all texts of each language. Words are counted in each task before they are
    shuffled. Texts without a language build no reference."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            rows = [(g, 0, w.decode("utf-8", "replace"), c) for g, ws in words.items() for w, c in ws.items()]
            rows += [(g, 1, str(k), int(c)) for g, cs in classes.items() for k, c in enumerate(cs) if c]
            words.clear(), classes.clear()
            columns = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "kind", "item", "n"])

        for b in sliced(batches):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                words.setdefault(lang, Counter()).update(raw.lower().split())
                if lang not in classes:
                    classes[lang] = np.zeros(len(CLASSES), np.int64)
                classes[lang] += class_counts(raw)
            if sum(map(len, words.values())) > 200_000:
                yield flush()
        yield flush()
        give_back()

    counted = docs.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(count, "lang string, kind int, item string, n long")
    counted = materialize(counted.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "words")
    rank = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    # The histogram of a language: its first words, and all its words as one sum.
    sums = counted.filter("kind = 0").groupBy("lang").agg(F.sum("n").alias("n")).filter(f"n >= {settings.min_language_words}")
    total = {r["lang"]: r["n"] for r in sums.collect()}
    wide = counted.sparkSession.createDataFrame([(x,) for x in total], "lang string")
    first = counted.join(F.broadcast(wide), "lang", "left_semi").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= settings.common)
    top = {}
    for r in first.collect():
        top.setdefault(r["lang"], {}).setdefault(r["kind"], []).append((r["rank"], r["item"], r["n"]))
    names = sorted(top)
    classes, words, shares = np.zeros((len(names), len(CLASSES))), [], np.zeros((len(names), settings.common + 1))
    for k, name in enumerate(names):
        for _, item, n in top[name].get(1, []):
            classes[k, int(item)] = n
        classes[k] /= max(1, classes[k].sum())
        own = sorted(top[name][0])
        words.append({item.encode("utf-8", "replace"): i for i, (_, item, _) in enumerate(own)})
        for i, (_, _, n) in enumerate(own):
            shares[k, i] = n / total[name]
        shares[k, -1] = 1 - shares[k, :-1].sum()
    return References(names, classes, words, np.clip(shares, 0, 1))


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance", "nearest")


def judge(text: str, lang: str | None, refs: References, s: Settings) -> tuple:
    """FIELDS of one text. The distances are to its own language, and where none is stated or they are too large, to
    whichever language is nearest, so a wrong language mark alone rejects nothing. A text whose stated language has no
    reference is judged by the counts alone."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    repeats = repeated_words(words)
    failed = n < 20 or 100 * repeats > 30 * n
    classes = word = nearest = None
    kept = not failed
    if kept and n >= s.min_words and refs.names and (lang is None or lang in refs.names):
        p = class_counts(raw).astype(float)
        a = js_distance(p / p.sum(), refs.classes)
        found = Counter(raw.lower().split())
        q = np.zeros_like(refs.shares)
        for k, own in enumerate(refs.words):
            for w, i in own.items():
                if w in found:
                    q[k, i] = found[w]
        q /= n
        q[:, -1] = 1 - q[:, :-1].sum(axis=1)
        b = js_distance(np.clip(q, 0, 1), refs.shares)
        more = s.slack / n**0.5
        good = (a <= s.max_class_distance + more) & (b <= s.max_word_distance + more)
        k = refs.names.index(lang) if lang in refs.names else int(np.argmin(a + b))
        if not good[k]:
            k = int(np.argmin(np.where(good, 0, 10) + a + b))
        kept, classes, word, nearest = bool(good[k]), float(a[k]), float(b[k]), refs.names[k]
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeats, failed, kept, classes, word, nearest


def quality_rules(docs: DataFrame, settings: Settings = Settings(), refs: References | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the distances, one row per row of docs (doc_id, text, lang).

    A null text is empty: it has no words, so it fails the base rule. A null doc_id is kept as it is, a null lang is
    judged by the nearest language; repeated rows are judged each; an empty table gives no rows; other columns are
    ignored. Texts of fewer than min_words words, and those whose stated language has no reference, are judged by the
    counts; so are all where no language has one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(refs or references(docs, settings))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2 + [pa.string()]
        for b in batches:
            rows = [judge(t or "", g, shared.value, settings) for t, g in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *FIELDS])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double, nearest string"
    return docs.select("doc_id", "text", "lang").mapInArrow(run, schema)


def keep_rows(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns; each row is judged by itself, whatever its id."""
    shared = docs.sparkSession.sparkContext.broadcast(references(docs, settings))
    return filter_rows(docs, lambda texts, langs: [judge(t or "", g, shared.value, settings)[6] for t, g in zip(texts, langs, strict=True)], ("text", "lang"))
