"""Languages without a reference, and more languages than two hundred."""

import random

from quillspan.llm import divergence


def test_rare_and_many_languages(spark):
    rng = random.Random(7)
    rows = []
    for g in range(230):
        pool = [f"l{g}w{k}" for k in range(60)]
        rows += [(10 * g + k, " ".join(rng.choice(pool) for _ in range(700)), f"g{g:03}") for k in range(3)]
    rows += [(9000, " ".join(rng.choice([f"rare{k}" for k in range(60)]) for _ in range(200)), "rare")]
    rows += [(9001, "same words over and over again " * 60, "rare")]
    got = {r.doc_id: r for r in divergence.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept and got[i].nearest == g for i, _, g in rows[:-2])
    assert got[9000].kept and got[9000].nearest is None and not got[9001].kept
