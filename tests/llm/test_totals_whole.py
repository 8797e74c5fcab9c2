"""Sweeps go by the totals of all buckets: scores do not depend on how many there are."""

import random

from quillspan.llm import pitman_yor


def test_scores_are_those_of_one_bucket(spark):
    rng = random.Random(9)
    pool = [f"w{k}" for k in range(300)]
    texts = [None, "", *(" ".join(rng.choice(pool[: rng.choice([3, 30, 300])]) for _ in range(rng.choice([5, 80, 400]))) for _ in range(60)), "new words alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = {r.doc_id: r for r in pitman_yor.score_texts(df).collect()}
    for chars, hot in ((3000, 0.005), (10_000, 0.001), (3000, 1.0)):
        many = {r.doc_id: r for r in pitman_yor.score_texts(df, pitman_yor.Settings(bucket_chars=chars, block_tokens=500, hot_share=hot)).collect()}
        assert set(many) == set(one)
        assert all(abs(r.score - one[k].score) < 1e-5 * (1 - r.score) and abs(r.base_score - one[k].base_score) < 1e-6 for k, r in many.items())
