"""Evaluation: grading, rates and intervals, retrieval and citation metrics, splits, calibration, reviews and reports of runs.

Run records are rows: id, grp, question, gold, prediction, refused, confidence, evidence and chunks (arrays of doc_id, page),
citations (the same), timings (map of stage to milliseconds), correct and method (once graded).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.answers import POWERS, REFUSAL, verify
from quillspan.operators.metadata import text_hash

UNANSWERABLE = "UNANSWERABLE"
_GRADED = re.compile(r"(?P<n>\(?-?\$?[0-9][0-9,]*(?:\.[0-9]+)?\)?)\s*(?P<unit>%|percent|billion|million|thousand|bn|mn|mm)?", re.I)


def grader_numbers(text: str) -> list[tuple[float, bool]]:
    """(value with its scale, whether it is a percentage) of a text; whole numbers from 1990 to 2049 without a unit are years."""
    out = []
    for m in _GRADED.finditer(text):
        digits, unit = re.sub("[^0-9.]", "", m["n"]), (m["unit"] or "").lower()
        value = float(digits)
        if unit or "." in digits or not 1990 <= value <= 2049:
            minus = "-" in m["n"] or (m["n"][0] == "(" and m["n"][-1] == ")")
            out.append(((-value if minus and value else value) * 10.0 ** POWERS.get(unit, 0), unit in ("%", "percent")))
    return out


def numbers_match(gold: tuple[float, bool], said: tuple[float, bool], share: float = 0.02) -> bool:
    """Magnitudes within a share of the larger, at any power of a thousand up to the third; a hundred times more or less
    will do if one alone is a percentage."""
    powers = [10.0**k for k in range(-9, 10, 3)] + ([100, 0.01] if gold[1] != said[1] else [])
    g = abs(gold[0])
    return any(abs(g - abs(said[0]) * f) <= share * max(g, abs(said[0]) * f, 1e-9) for f in powers)


def numeric_grade(gold: str, said: str) -> bool | None:
    wanted = grader_numbers(gold)
    return any(numbers_match(wanted[0], x) for x in grader_numbers(said)) if wanted else None


def grade(records: DataFrame, judge=None) -> DataFrame:
    """records with correct and method. In this order: an unanswerable question wants a refusal; a refusal is wrong; the
    first number of gold must be in the prediction; else the judge (a column of booleans) decides, or nobody."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "numeric": pd.array([numeric_grade(g or "", p or "") for g, p in zip(b["gold"], b["prediction"], strict=True)], "boolean")})

    kind = records.schema["id"].dataType.simpleString()
    numeric = records.select("id", "gold", "prediction").mapInPandas(run, f"id {kind}, numeric boolean").withColumnRenamed("id", "__id")
    out = records.join(numeric, F.col("id") == F.col("__id"), "left").drop("__id")
    refused, open_ = F.coalesce("refused", F.lit(False)), F.col("gold") == UNANSWERABLE
    asked = F.lit(None).cast("boolean") if judge is None else judge
    correct = F.when(open_, refused).when(refused, False).otherwise(F.coalesce("numeric", asked))
    method = F.when(open_, "unanswerable").when(refused, "refused").when(F.col("numeric").isNotNull(), "numeric").when(asked.isNotNull(), "judge").otherwise("ungraded")
    return out.withColumn("correct", correct).withColumn("method", method).drop("numeric")


# --- metrics -------------------------------------------------------------------------------------------------------------


def rate(flag: Column) -> Column:
    """The share of true flags; an error over no rows."""
    return F.when(F.count("*") > 0, F.avg(flag.cast("double"))).otherwise(F.raise_error(F.lit("a rate needs one row at least")).cast("double"))


def recall(chunks: Column, gold: Column, k: int) -> Column:
    """The share of gold (doc_id, page) that the first k of chunks cover; an error without gold, or for k below 1."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    found = F.size(F.array_intersect(F.array_distinct(gold), F.slice(chunks, 1, k)))
    return F.when(F.size(gold) > 0, found / F.size(F.array_distinct(gold))).otherwise(F.raise_error(F.lit("a question without gold pages")).cast("double"))


def hit(chunks: Column, gold: Column, k: int) -> Column:
    return recall(chunks, gold, k) > 0


def citation_match(cited: Column, gold: Column) -> Column:
    """struct of precision, recall and any_match; all 0 without citations."""
    both = F.size(F.array_intersect(F.array_distinct(cited), gold)).cast("double")
    n = F.size(F.array_distinct(cited))
    return F.struct(F.when(n > 0, both / n).otherwise(0.0).alias("precision"), (both / F.size(F.array_distinct(gold))).alias("recall"), (both > 0).cast("double").alias("any_match"))


def confusion(pairs: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """truth, said and n for every pair of labels (those given, or all seen); a label that is not among those given is an error."""
    seen = pairs.select(F.explode(F.array("truth", "said")).alias("label")).distinct()
    if labels is None:
        domain = seen
    else:
        domain = pairs.sparkSession.createDataFrame([(x,) for x in labels], "label string")
        if strange := seen.join(F.broadcast(domain), "label", "left_anti").take(1):
            raise ValueError(f"unknown label {strange[0][0]}")
    n = pairs.groupBy("truth", "said").agg(F.count("*").alias("n"))
    # The labels are few: their pairs are the cells of the matrix.
    every = F.array_sort(F.collect_set("label"))
    cells = domain.agg(every.alias("all")).select(F.explode("all").alias("truth"), "all").select("truth", F.explode("all").alias("said"))
    return cells.join(n, ["truth", "said"], "left").select("truth", "said", F.coalesce("n", F.lit(0)).alias("n"))


def bootstrap_ci(values: DataFrame, key: str, value: str, resamples: int = 2000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """low and high of the mean of value: percentiles over resamples drawn with repeats, seeded. How often a resample takes
    a row is drawn from the row's hash (Poisson of mean 1), so no row has to know of others and one pass over the values
    makes all resamples, added up in each task."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sample").cast("string"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    limits, p, total = [], 0.36787944117144233, 0.0
    for k in range(12):
        total += p
        limits.append(total)
        p /= k + 1
    times = sum(((u >= x).cast("int") for x in limits[1:]), (u >= limits[0]).cast("int"))
    drawn = values.select(key, value, F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("sample")).withColumn("times", times)
    means = drawn.groupBy("sample").agg((F.sum(F.col("times") * F.col(value)) / F.sum("times")).alias("mean"))
    tail = (1 - confidence) / 2
    return means.agg(F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"))


def latency(records: DataFrame) -> DataFrame:
    """stage, n, median, p95, low and high of timings (a map), for each stage and the total of each record."""
    total = F.aggregate(F.map_values("timings"), F.lit(0.0), lambda a, x: a + x)
    rows = records.filter(F.size("timings") > 0).select(F.explode(F.map_concat("timings", F.create_map(F.lit("total"), total))).alias("stage", "ms"))
    return rows.groupBy("stage").agg(F.count("*").alias("n"), F.percentile("ms", 0.5).alias("median"), F.percentile("ms", 0.95).alias("p95"), F.min("ms").alias("low"), F.max("ms").alias("high"))


def retrieval_metrics(records: DataFrame) -> DataFrame:
    """questions, hit1, hit3, hit5 and hit_candidates over the records that have evidence."""
    gold = records.filter(F.size("evidence") > 0)
    rated = lambda c, k: F.avg(hit(F.col(c), F.col("evidence"), k).cast("double"))
    every = F.avg(F.when(F.size("candidates") > 0, F.arrays_overlap("candidates", "evidence").cast("double")))
    return gold.agg(F.count("*").alias("questions"), *(rated("chunks", k).alias(f"hit{k}") for k in (1, 3, 5)), every.alias("hit_candidates"))


def answer_metrics(records: DataFrame) -> DataFrame:
    """By all, by method and by group (columns dim and value): graded, correct, accuracy, refusal_rate, hallucination_rate
    (answered and wrong, of all graded), wrong_when_answered and citation_any_match. One pass for all of them."""
    answered, wrong = ~F.col("refused"), ~F.col("refused") & ~F.col("correct")
    cites = F.when(answered & (F.size("evidence") > 0), F.arrays_overlap("citations", "evidence").cast("double"))
    rows = records.filter("correct IS NOT NULL").select("refused", "correct", answered.alias("answered"), wrong.alias("wrong"), cites.alias("cites"), F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), v.alias("value")) for d, v in (("all", F.lit("all")), ("method", F.col("method")), ("group", F.coalesce(F.nullif("grp", F.lit("")), F.lit("none"))))))).alias("x"))
    share = lambda c: F.avg(F.col(c).cast("double")).alias
    return rows.groupBy("x.dim", "x.value").agg(
        F.count("*").alias("graded"), F.count_if("correct").alias("correct"), share("correct")("accuracy"), share("refused")("refusal_rate"), share("wrong")("hallucination_rate"),
        (F.count_if("wrong") / F.nullif(F.count_if("answered"), F.lit(0))).alias("wrong_when_answered"), F.avg("cites").alias("citation_any_match"),
    )


# --- splits, calibration, reviews ---------------------------------------------------------------------------------------


def largest_remainder(sizes: DataFrame, total: int) -> DataFrame:
    """grp, n and quota of sizes (grp, n): whole shares of total, what is left to the largest remainders, then by name."""
    every = sizes.agg(F.sum("n")).scalar()
    exact = sizes.select("grp", "n", F.expr(f"n * {total}L").alias("x")).withColumn("all", every)
    exact = exact.select("grp", "n", F.expr("x DIV all").alias("base"), F.expr("x % all").alias("rest"))
    # One row for each group: their number, not the items', passes through this window.
    placed = exact.select("*", F.row_number().over(Window.orderBy(F.desc("rest"), "grp")).alias("place"), (F.lit(total) - F.sum("base").over(Window.partitionBy())).alias("over"))
    return placed.select("grp", "n", (F.col("base") + (F.col("place") <= F.col("over")).cast("long")).alias("quota"))


def stratified_split(items: DataFrame, dev: int, seed: int) -> DataFrame:
    """id, grp and split of items (id, grp): dev items in dev, each group by its quota. It depends on ids, groups and seed
    only. Repeated ids and a dev that there are too few items for are errors."""
    n = items.count()
    if items.groupBy("id").count().filter("count > 1").take(1):
        raise ValueError("ids must be unique")
    if not 0 <= dev <= n:
        raise ValueError(f"dev must be between 0 and {n}")
    quota = largest_remainder(items.groupBy("grp").agg(F.count("*").alias("n")), dev).select("grp", "quota")
    w = Window.partitionBy("grp").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id")
    placed = items.select("id", "grp", F.row_number().over(w).alias("place")).join(F.broadcast(quota), "grp")
    return placed.select("id", "grp", F.when(F.col("place") <= F.col("quota"), "dev").otherwise("test").alias("split"))


def check_split(split: DataFrame) -> DataFrame:
    """The split itself; an error if an id is in both parts."""
    if split.groupBy("id").agg(F.count_distinct("split").alias("n")).filter("n > 1").take(1):
        raise ValueError("ids in both parts of the split")
    return split


def calibrate(records: DataFrame) -> DataFrame:
    """threshold, utility and ungated of graded records: the gate refuses below the threshold. An answer counts 1 if right
    and -1 if wrong, an unanswerable question 1 if refused and -1 if answered. Of equally good thresholds the lowest.

    A record's worth changes where the threshold passes its confidence, so running sums over the confidences give the
    utility of all thresholds: they are added up by value first."""
    open_, refused = F.col("gold") == UNANSWERABLE, F.coalesce("refused", F.lit(False))
    answered = F.when(open_, -1).when(F.col("correct"), 1).otherwise(-1)
    below = F.when(open_, 1).otherwise(0)
    scored = records.filter("confidence IS NOT NULL").select(F.col("confidence").alias("c"), F.when(refused, below).otherwise(answered).alias("above"), below.alias("below"))
    by = scored.groupBy("c").agg(F.sum(F.col("below") - F.col("above")).alias("change"))
    start = scored.agg(F.sum("above")).scalar()
    least = scored.sparkSession.range(1).select(F.lit(0.0).alias("c"), F.lit(0).cast("long").alias("change"))
    points = by.unionByName(least).groupBy("c").agg(F.sum("change").alias("change"))
    w = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    utility = points.select("c", (F.coalesce(F.sum("change").over(w), F.lit(0)) + start).alias("utility"))
    best = F.max_by("c", F.struct("utility", -F.col("c"))).alias("threshold")
    return utility.agg(best, F.max("utility").alias("utility"), F.max_by("utility", -F.col("c")).alias("ungated"))


def to_review(records: DataFrame, reviews: DataFrame) -> DataFrame:
    """Answered records that no review (id, hash, correct, why) of the same text is there for."""
    open_ = records.filter(~F.coalesce("refused", F.lit(False)) & (F.col("gold") != UNANSWERABLE))
    return open_.withColumn("hash", text_hash(F.col("prediction"))).join(reviews.select("id", "hash"), ["id", "hash"], "left_anti")


def apply_reviews(records: DataFrame, reviews: DataFrame) -> DataFrame:
    """Graded records with the verdicts of reviews of the same text: correct, method review, why; auto keeps the old method."""
    known = reviews.select(F.col("id").alias("__id"), F.col("hash").alias("__hash"), F.col("correct").alias("__correct"), "why")
    out = records.join(known, (F.col("id") == F.col("__id")) & (text_hash(F.col("prediction")) == F.col("__hash")), "left").drop("__id")
    use = F.col("__correct").isNotNull() & ~F.coalesce("refused", F.lit(False)) & (F.col("gold") != UNANSWERABLE)
    return out.withColumns({"auto": F.when(use, F.col("method")), "why": F.when(use, F.col("why")), "correct": F.when(use, F.col("__correct")).otherwise(F.col("correct")), "method": F.when(use, "review").otherwise(F.col("method"))}).drop("__hash", "__correct")


RECHECKED = "id long, prediction string, refused boolean, unverified string, reasons array<string>, statuses array<string>"


def recheck(records: DataFrame, hedges: Sequence[str] | None = None) -> DataFrame:
    """records (with passages, unverified and truncated) checked again from the model's own text: failed ones become
    refusals, corrected ones carry the corrected text; graded anew only where text or refusal changed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                own = r.unverified if r.unverified is not None else r.prediction
                if own is None or (r.refused and r.unverified is None):
                    rows.append((r.id, r.prediction, bool(r.refused), r.unverified, [], []))
                    continue
                x = verify(own, [p or "" for p in r.passages], r.question or "", bool(r.truncated), hedges)
                text = x.text if x.ok else REFUSAL
                rows.append((r.id, text, not x.ok, None if text == own else own, x.reasons, [c.status for c in x.numbers]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECHECKED.split(", ")])

    new = records.select("id", "question", "prediction", "refused", "unverified", "truncated", "passages").mapInPandas(run, RECHECKED)
    new = new.toDF("__id", "new_prediction", "new_refused", "new_unverified", "reasons", "statuses")
    out = records.join(new, F.col("id") == F.col("__id"), "left").drop("__id")
    changed = ~F.col("prediction").eqNullSafe(F.col("new_prediction")) | (F.coalesce("refused", F.lit(False)) != F.col("new_refused"))
    out = out.withColumn("changed", changed).withColumnsRenamed({"correct": "old_correct", "method": "old_method"}).drop("prediction", "refused", "unverified").withColumnsRenamed({"new_prediction": "prediction", "new_refused": "refused", "new_unverified": "unverified"})
    out = grade(out)
    return out.withColumns({"correct": F.when(F.col("changed"), F.col("correct")).otherwise(F.col("old_correct")), "method": F.when(F.col("changed"), F.col("method")).otherwise(F.col("old_method"))}).drop("old_correct", "old_method")


def outcome(refused: Column, correct: Column) -> Column:
    return F.when(F.coalesce(refused, F.lit(False)), "refused").when(correct.isNull(), "ungraded").when(correct, "correct").otherwise("wrong")


def run_list(records: DataFrame, labels: Sequence[str] = ()) -> DataFrame:
    """run, n, accuracy, refusal_rate, hallucination_rate, precision and place of records (with run): labelled runs first in
    the order of labels, then by name. Runs of which nothing is graded are left out."""
    wrong = ~F.col("refused") & ~F.col("correct")
    by = records.filter("correct IS NOT NULL").groupBy("run").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg(F.col("refused").cast("double")).alias("refusal_rate"), F.avg(wrong.cast("double")).alias("hallucination_rate"), (1 - F.count_if(wrong) / F.nullif(F.count_if(~F.col("refused")), F.lit(0))).alias("precision"))
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, labels)).cast("array<string>"), F.col("run")), F.lit(0)), F.lit(1 << 30))
    return by.withColumn("place", F.row_number().over(Window.orderBy(order, "run")))  # one row for each run


def run_detail(records: DataFrame) -> DataFrame:
    """id, grp, question, gold, prediction, outcome, method and evidence_in_top5 of each record."""
    return records.select("id", "grp", "question", "gold", "prediction", outcome(F.col("refused"), F.col("correct")).alias("outcome"), "method", F.arrays_overlap(F.slice("chunks", 1, 5), "evidence").alias("evidence_in_top5"))


def sample(rows: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """n rows in the order of a seeded hash of their ids."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(n)


def unanswerable(questions: DataFrame, outside: Sequence[str], n: int, seed: int = 7) -> DataFrame:
    """id, question and source_id of n questions (id, question, company) in which another company's name, one of outside in
    turn, stands for the company's (in any case). Names that are in the corpus are not outside it."""
    known = {r[0] for r in questions.select(F.lower("company")).filter(F.lower("company").isin(*(x.lower() for x in outside))).distinct().collect()}
    names = [x for x in outside if x.lower() not in known]
    if not names:
        raise ValueError("no name is outside the corpus")
    quoted = F.concat(F.lit(r"(?i)\Q"), F.col("company"), F.lit(r"\E"))
    named = questions.filter("company <> ''").filter(F.rlike("question", quoted))
    picked = sample(named, n, seed)
    w = Window.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id")  # n rows
    turn = F.get(F.array(*map(F.lit, names)), ((F.row_number().over(w) - 1) % len(names)).cast("int"))
    return picked.withColumn("outside", turn).select(F.concat(F.lit("unans_"), F.col("id").cast("string")).alias("id"), F.regexp_replace("question", quoted, F.col("outside")).alias("question"), F.lit(UNANSWERABLE).alias("gold"), "company", "outside", F.col("id").alias("source_id"))
