"""URL filter: rules first, then the ratio of two character models, in DataFrame and SQL operations only.

The models are smoothed Markov models of variable order (Witten-Bell: a context hands down as much weight as it has
different successors, so the order that counts is the longest that was seen), one for accepted and one for rejected
URLs, learned from those that the rules decide. The log-likelihood difference by length is calibrated on URLs that
neither model learned from, by the means and the shared variance of both kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import materialize

#: (host and path, verdict) of each rule.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 4


def parts(url: str = "url") -> tuple[Column, Column, Column]:
    """Host, path, and what the models read: all after the scheme, lower-cased. All are empty where there is no ://."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lower(rest)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls without one. Of equally long ones the first counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _grams(df: DataFrame) -> DataFrame:
    text = F.concat(F.lit("^" * (ORDER - 1)), F.col("body"), F.lit("$"))
    return df.withColumn("s", text).withColumn("gram", F.explode(F.expr(f"transform(sequence(1, length(s) - {ORDER - 1}), i -> substring(s, i, {ORDER}))"))).drop("s")


def gram_ratios(labelled: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram and ratio (log of the accepted model's probability of its last character over the rejected model's) for
    every gram in wanted; labelled: body and verdict."""
    both = [(c, F.sum(F.when(F.col("verdict") == v, 1).otherwise(0))) for c, v in (("a", "allow"), ("b", "block"))]
    full = materialize(_grams(labelled).groupBy("gram").agg(*(x.alias(c) for c, x in both)), "grams")
    kinds = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0))
    out = wanted.select("gram").distinct()
    for n in range(ORDER, 0, -1):
        end = F.substring("gram", ORDER - n + 1, n)
        seen = full if n == ORDER else full.groupBy(end.alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        out = out.withColumn("k", end).join(seen.select(F.col("gram").alias("k"), F.col("a").alias(f"a{n}"), F.col("b").alias(f"b{n}")), "k", "left").drop("k")
        context = seen.groupBy(F.substring("gram", 1, n - 1).alias("k")).agg(F.sum("a").alias(f"at{n}"), F.sum("b").alias(f"bt{n}"), kinds("a").alias(f"ad{n}"), kinds("b").alias(f"bd{n}"))
        out = out.withColumn("k", F.substring("gram", ORDER - n + 1, n - 1)).join(context, "k", "left").drop("k")
    # Below the single characters: one chance in as many as either kind has, and one more.
    alphabet = F.coalesce(F.greatest("ad1", "bd1"), F.lit(0)) + 1
    p = {c: 1.0 / alphabet for c in "ab"}
    for n in range(1, ORDER + 1):
        for c in "ab":
            count, total, kind = (F.coalesce(F.col(f"{c}{x}{n}"), F.lit(0)) for x in ("", "t", "d"))
            p[c] = F.when(total > 0, (count + kind * p[c]) / (total + kind)).otherwise(p[c])
    return out.select("gram", (F.log(p["a"]) - F.log(p["b"])).alias("ratio"))


def judge_urls(pages: DataFrame, rules=RULES, small: int = 8 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict, score and threshold, one row per row of pages (page_id, url).

    A quarter of the URLs that rules decide (by md5) calibrates, the others are learned from. URLs are allowed where the
    score is the threshold or more; without both kinds among either part, the threshold is 0 (with no model at all,
    every score is 0: allowed). Nulls and URLs without :// have an empty host and path and an empty text for the models;
    null ids and repeated rows are kept as they are; an empty table gives no rows; other columns are ignored. small: bytes
    that are broadcast at most; a larger table of ratios is joined by an exchange, with the same result.
    """
    host, path, body = parts()
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path"), body.alias("body"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.select("page_id", "url", "host", "path", "body", rule.alias("rule"), verdict.alias("says"))
    # The models read each different URL once.
    urls = judged.groupBy("body", "says").agg(F.count("*").alias("rows"))
    fold = F.substring(F.md5("body"), 1, 1).isin("0", "1", "2", "3")
    bodies = urls.select("body").distinct()
    grams = _grams(bodies)
    labelled = urls.filter("says IS NOT NULL").select("body", F.col("says").alias("verdict"))
    ratios = materialize(gram_ratios(labelled.filter(~fold), grams), "ratios")
    # 64 bytes hold a gram and its ratio: a small table is broadcast, so that grams of a URL are added up where they are.
    ratios = F.broadcast(ratios) if 64 * ratios.count() <= small else ratios
    scores = materialize(grams.join(ratios, "gram").groupBy("body").agg((F.sum("ratio") / F.count("*")).alias("score")), "scores")
    held = labelled.filter(fold).join(scores, "body")
    stat = {}
    for v, n in (("allow", "a"), ("block", "b")):
        is_v = F.col("verdict") == v
        stat |= {f"n{n}": F.count(F.when(is_v, 1)), f"m{n}": F.avg(F.when(is_v, F.col("score"))), f"v{n}": F.var_pop(F.when(is_v, F.col("score")))}
    stats = held.agg(*(c.alias(k) for k, c in stat.items()))
    threshold = stats.select(F.expr("CASE WHEN na > 0 AND nb > 0 AND ma > mb THEN (ma + mb) / 2 + (na * va + nb * vb) / (na + nb) * ln(nb / na) / (ma - mb) ELSE 0D END")).scalar()
    out = judged.join(scores, "body").withColumn("threshold", threshold)
    says = F.coalesce("says", F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", says.alias("verdict"), "score", "threshold")
