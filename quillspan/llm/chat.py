"""Transcript parsing: a hidden Markov model over line features recovers who speaks, then turns are rendered.

A state is a role and whether the line begins a turn. A line shows a speaker marker (or none), whether it is blank, how
long it is and whether it asks. Start, transition and emission chances are counted on labelled lines and smoothed; the
roles of a transcript are the most likely path (Viterbi). Long transcripts are divided into blocks: the best chance from
each state to each other across a block is a small matrix, the matrices of a transcript give the states at the blocks'
borders, and the blocks are decoded between those, each by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import materialize

ROLES = ("system", "user", "assistant")
STATES = [(r, first) for r in ROLES for first in (True, False)]
#: The kinds of markers, by what stands before the text of a line.
MARKERS = {
    "system": r"(?:system|instructions?|context)",
    "user": r"(?:user|human|question|q|customer|me)",
    "assistant": r"(?:assistant|ai|bot|answer|a|agent|model)",
}
_MARK = {k: re.compile(r"^\s*(?:#+\s*|\*\*|<\|?|\[)?" + v + r"(?:\|?>|\]|\*\*)?\s*(?::|>|\]|-)\s*|^\s*(?:#+\s*|<\|?|\[)" + v + r"(?:\|?>|\])?\s*$", re.I) for k, v in MARKERS.items()}
SIZES = (0, 5, 15, 40)
FEATURES = (len(MARKERS) + 1) * 2 * (len(SIZES) + 1)


def marker(line: str) -> tuple[str | None, str]:
    """The kind of the line's speaker marker, and the line without it."""
    for kind, pattern in _MARK.items():
        if found := pattern.match(line):
            return kind, line[found.end() :]
    return None, line


def feature(line: str) -> int:
    kind, rest = marker(line)
    words = len(rest.split())
    size = sum(words > x for x in SIZES)
    mark = 0 if kind is None else 1 + ROLES.index(kind)
    return (mark * 2 + rest.rstrip().endswith("?")) * (len(SIZES) + 1) + size


@dataclass
class Model:
    """Logarithms of the chances."""

    start: np.ndarray
    step: np.ndarray
    shows: np.ndarray


def fit(lines: DataFrame, smooth: float = 0.5) -> Model:
    """lines: conv_id, ord, line, role (its true one), first (whether it begins a turn). Counts have a fixed size.

    A transition is counted between neighbouring lines, which a window over the transcript would need whole; instead
    each line carries the state before it (column before: the index of a state, or null at the beginning).
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(len(STATES) * (1 + len(STATES) + FEATURES), np.int64)
        n = len(STATES)
        for b in batches:
            for line, state, before in zip(*(b.column(c).to_pylist() for c in ("line", "state", "before")), strict=True):
                table[state if before is None else n + before * n + state] += 1
                table[n + n * n + state * FEATURES + feature(line or "")] += 1
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(table[at], pa.int64())], names=["cell", "n"])

    counted = lines.select("line", "state", "before").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    n = len(STATES)
    table = np.full(n * (1 + n + FEATURES), smooth)
    for r in counted.collect():
        table[r["cell"]] += r["n"]
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return Model(log(table[:n]), log(table[n : n + n * n].reshape(n, n)), log(table[n + n * n :].reshape(n, FEATURES)))


def viterbi(features: list[int], model: Model, entry: np.ndarray, end: int | None = None) -> list[int]:
    """The best path of states; entry: the chance of each state at the first line, but for what that line shows."""
    if not features:
        return []
    score = entry + model.shows[:, features[0]]
    back = np.zeros((len(features), len(score)), np.int8)
    for k, x in enumerate(features[1:], 1):
        ways = score[:, None] + model.step
        back[k] = ways.argmax(axis=0)
        score = ways.max(axis=0) + model.shows[:, x]
    path = [int(score.argmax()) if end is None else end]
    for k in range(len(features) - 1, 0, -1):
        path.append(int(back[k, path[-1]]))
    return path[::-1]


def transfer(features: list[int], model: Model) -> np.ndarray:
    """The best chance from each state at the first line (what it shows left out) to each state at the last line."""
    m = np.full((len(STATES),) * 2, -np.inf)
    np.fill_diagonal(m, model.shows[:, features[0]])
    for x in features[1:]:
        m = (m[:, :, None] + model.step[None]).max(axis=1) + model.shows[:, x]
    return m


def split_lines(texts: DataFrame, block: int = 4096) -> DataFrame:
    """conv_id, block, ord and line of raw transcripts (conv_id, text)."""
    lines = texts.select("conv_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("ord", "line"))
    return lines.select("conv_id", F.floor(F.col("ord") / block).alias("block"), F.col("ord").cast("long").alias("ord"), "line")


def _runs(batches: Iterable[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """Each run of rows with equal keys, also over the ends of batches."""
    now, held = None, [[] for _ in columns]
    for b in batches:
        for key, row in zip(zip(*(b.column(c).to_pylist() for c in keys), strict=True), zip(*(b.column(c).to_pylist() for c in columns), strict=True), strict=True):
            if key != now and held[0]:
                yield now, held
                held = [[] for _ in columns]
            now = key
            for h, v in zip(held, row, strict=True):
                h.append(v)
    if held[0]:
        yield now, held


BLANK = " \t\n\r\x0b\x0c"


def parse(lines: DataFrame, model: Model) -> DataFrame:
    """conv_id, turn (the ord of its first line), role, n_lines and rendered, for lines (conv_id, block, ord, line).

    Blocks are runs of lines of bounded size in the order of ord; they divide the work only: pieces of a turn that goes on
    in later blocks are put together. A null line is blank, a null conv_id is a transcript like any other, lines with the
    same ord keep the order of their text; a blank transcript is one turn; an empty table gives no rows; other columns are
    ignored.
    """
    spark = lines.sparkSession
    shared = spark.sparkContext.broadcast(model)
    lines = lines.select("conv_id", "block", "ord", "line")
    ordered = lines.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "ord", "line")

    def across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(*key, transfer([feature(x or "") for x in own], shared.value).ravel().tolist()) for key, (own,) in _runs(batches, ["conv_id", "block"], ["line"])]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.float64()))], names=["conv_id", "block", "m"])

    def borders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for (conv,), (blocks, ms) in _runs(batches, ["conv_id"], ["block", "m"]):
            score, back = None, []
            for m in ms:
                m = np.array(m).reshape(len(STATES), -1)
                enter = model.start if score is None else (score[:, None] + model.step).max(axis=0)
                ways = enter[:, None] + m
                back.append((None if score is None else score, m))
                score = ways.max(axis=0)
            end, out = int(score.argmax()), []
            for b, (before, m) in zip(reversed(blocks), reversed(back), strict=True):
                if before is None:
                    out.append((conv, b, None, end))
                    break
                ways = before[:, None] + model.step  # from the last state of the block before to the first of this
                first = int((ways.max(axis=0) + m[:, end]).argmax())
                prior = int(ways[:, first].argmax())
                out.append((conv, b, prior, end))
                end = prior
            c = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=["conv_id", "block", "prior", "end"])

    matrices = ordered.mapInArrow(across, "conv_id long, block long, m array<double>").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    ends = matrices.mapInArrow(borders, "conv_id long, block long, prior long, end long")
    ends = materialize(ends, "borders")
    same = lines["conv_id"].eqNullSafe(ends["conv_id"]) & (lines["block"] == ends["block"])
    known = lines.join(ends, same).select(lines["conv_id"], lines["block"], "ord", "line", "prior", "end")
    known = known.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "ord", "line")

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for (conv, block), (ords, own, priors, end) in _runs(batches, ["conv_id", "block"], ["ord", "line", "prior", "end"]):
            own = [x or "" for x in own]
            path = viterbi([feature(x) for x in own], model, model.start if priors[0] is None else model.step[priors[0]], end[0])
            out: list[list] = []
            for k, (o, x, state) in enumerate(zip(ords, own, path, strict=True)):
                role, first = STATES[state]
                text = marker(x)[1] if first else x
                before = STATES[path[k - 1]][0] if k else None if priors[0] is None else STATES[priors[0]][0]
                if first or before != role:
                    out.append([conv, block, o, True, role, [text]])
                elif not k:
                    out.append([conv, block, o, False, role, [text]])
                else:
                    out[-1][-1].append(text)
            c = list(zip(*out, strict=True))
            columns = [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.bool_()), pa.array(c[4]), pa.array([len(x) for x in c[5]], pa.int64()), pa.array(["\n".join(x) for x in c[5]])]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "block", "ord", "begins", "role", "n_lines", "text"])

    pieces = materialize(known.mapInArrow(decode, "conv_id long, block long, ord long, begins boolean, role string, n_lines long, text string"), "pieces")
    # A block's first piece may go on with the last turn that began in a block before: one row for each block tells which.
    starts = pieces.groupBy("conv_id", "block").agg(F.max(F.when(F.col("begins"), F.col("ord"))).alias("began"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.last("began", ignorenulls=True).over(earlier).alias("start"))
    going_on = pieces.filter("NOT begins").join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    columns = ("conv_id", "turn", "ord", "n_lines", "text")
    own = pieces.filter("begins").withColumn("turn", F.col("ord")).select(*columns, "role")
    rest = going_on.withColumn("turn", F.col("start")).select(*columns, F.lit(None).cast("string").alias("role"))
    parts = F.sort_array(F.collect_list(F.struct("ord", "text")))
    turns = own.unionByName(rest).groupBy("conv_id", "turn").agg(F.max("role").alias("role"), F.sum("n_lines").alias("n_lines"), parts.alias("parts"))
    text = F.btrim(F.array_join(F.transform("parts", lambda x: x["text"]), "\n"), F.lit(BLANK))
    return turns.select("conv_id", "turn", "role", "n_lines", F.concat(F.lit("<|"), "role", F.lit("|>\n"), text, F.lit("\n")).alias("rendered"))


#: How the query writes out a table of turns as transcripts: a style for each conversation.
STYLES = (("System: ", "User: ", "Assistant: "), ("### Instructions\n", "### Human\n", "### AI\n"), ("[system] - ", "[user] - ", "[assistant] - "), ("Context: ", "Q: ", "A: "), ("<|system|>\n", "<|user|>\n", "<|assistant|>\n"))


def transcripts(turns: DataFrame, block: int = 4096, unmarked: int = 12) -> DataFrame:
    """Lines as parse takes them, from turns (conv_id, turn, role, text) written out in one of STYLES; one turn in
    unmarked has no marker. Blocks are so many lines each, wherever turns begin. true_turn, role, first, state and before
    say what is true of each line."""
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user")
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    marks = F.array(*(F.array(*(F.lit(m) for m in s)) for s in STYLES))
    at = F.array_position(F.array(*(F.lit(r) for r in ROLES)), role).cast("int")
    mark = F.when((F.pmod(F.xxhash64("conv_id", "turn"), F.lit(unmarked)) == 0) & (F.col("turn") > 0), "").otherwise(marks[style][at - 1])
    text: Column = F.concat(mark, F.coalesce("text", F.lit("")))
    # Turns of a transcript are in the order of turn, equal ones in that of their role and text.
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    lines = F.split(text, "\n")
    before = F.lag(at * 2 - 2 + F.when(F.size(lines) > 1, 1).otherwise(0)).over(order)
    begin = F.coalesce(F.sum(F.size(lines)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = turns.select("conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("true_turn"), role.alias("role"), at.alias("at"), before.alias("last"), begin.alias("begin"), F.posexplode(lines).alias("pos", "line"))
    first = F.col("pos") == 0
    state = (F.col("at") - 1) * 2 + F.when(first, 0).otherwise(1)
    prior = F.when(first, F.col("last")).otherwise((F.col("at") - 1) * 2 + F.when(F.col("pos") == 1, 0).otherwise(1))
    ord_ = (F.col("begin") + F.col("pos")).cast("long")
    return rows.select("conv_id", F.floor(ord_ / block).alias("block"), ord_.alias("ord"), "line", "true_turn", "role", first.alias("first"), state.cast("int").alias("state"), prior.cast("int").alias("before"))
