"""Keyword search: terms in Arrow batches are those of the columns, nothing is kept, and a task keeps its best alone."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import retrieval



def test_terms_said(spark):
    texts = ["", "The a_b and 1,577,000 or 12,34", "Ünïcode ÑANDÚ the İstanbul K ſ ǅ", "x²½ ①Ⅷ 七 áb _the the_ the", "1,234,567,8901 9,٣٣٣ \x00tab\tnew\nline", "ΣΊΣΥΦΟΣ fin", "The"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    for r in df.select("text", T.terms(F.col("text")).alias("t")).collect():
        assert T.terms_said(r.text) == Counter(r.t)


@pytest.mark.parametrize("wide", [2, 1024])
def test_scores_as_by_hand(spark, monkeypatch, wide):
    monkeypatch.setattr(retrieval, "WIDE", wide)
    docs = [(k, f"w{k % 3} w{k % 5} common " + "w7 " * (k % 4), "en" if k % 2 else "fr") for k in range(40)] + [(40, None, "en"), (41, "", None)]
    asked = [(1, "w0 w0 w7"), (2, "common w4"), (3, "none"), (4, "w1"), (5, "the"), (6, "w2 w3 w1")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(asked, "item_id int, text string")
    own = {k: Counter((t or "").split()) for k, t, _ in docs}
    df = Counter(w for c in own.values() for w in c)
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean, size = sum(raw.values()) / len(raw), sum(sum(c.values()) for c in own.values()) / 41
    idf = {w: x if x >= 0 else mean / 4 for w, x in raw.items()}
    want = set()
    for no, keep in enumerate((lambda lang: True, lambda lang: lang == "en")):
        for i, t in asked:
            terms = Counter(w for w in t.split() if w in idf)
            scores = {k: round(sum(n * idf[w] * own[k][w] * 2.5 / (own[k][w] + 1.5 * (0.25 + 0.75 * own[k].total() / size)) for w, n in terms.items()), 6) for k, _, lang in docs if keep(lang)}
            best = sorted((-s, k) for k, s in scores.items() if s > 0)[:7]
            want |= {(i, k, -s, n, no) for n, (s, k) in enumerate(best, 1)}
    out = retrieval.bm25_lists(d, q, [F.lit(True), F.col("lang") == "en"], top=7)
    assert {tuple(r) for r in out.collect()} == want
    # Terms were kept as arrays, in memory and then on disk, and every occurrence of an asked term was shuffled.
    plan = out._jdf.queryExecution().toString()
    assert "InMemory" not in plan and "explode" not in plan and plan.count("Exchange") > 0
    pairs = {(r.item_id, r.doc_id): r.score for r in retrieval.bm25_scores(d, q).collect()}
    assert pairs == {(i, k): s for i, k, s, *_ in {tuple(r) for r in retrieval.bm25_lists(d, q, [F.lit(True)], top=100).collect()}}


def test_stats_count_in_the_tasks(spark):
    docs = spark.createDataFrame([(k, "both rare" if k == 3 else "both") for k in range(9)] + [(9, None)], "doc_id long, text string")
    out = retrieval.bm25_stats(docs)
    low, high = math.log(10 - 9 + 0.5) - math.log(9.5), math.log(9.5) - math.log(1.5)
    assert {(r.term, r.df, round(r.idf, 9)) for r in out.collect()} == {("both", 9, round((low + high) / 8, 9)), ("rare", 1, round(high, 9))}
    assert "InMemory" not in out._jdf.queryExecution().toString()
    many = retrieval.term_counts(docs, most=1)
    assert {(r.term, r.df, r.size, r.filled) for r in many.collect()} == {(None, 10, 10, 9), ("both", 9, 0, 0), ("rare", 1, 0, 0)}
