"""Dense search keeps the best of each question, in memory that follows neither the batch times the questions nor ties."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quillspan.operators import retrieval
from quillspan.operators.best import Best


def test_best_of_tiles_with_ties():
    draw = np.random.default_rng(1)
    for positive in (False, True):
        scores, keys = draw.integers(-3, 4, (500, 7)) / 4 + draw.integers(-4, 5, (500, 7)) * 1e-7, draw.permutation(500)
        for own in (keys, np.array([f"k{k}" for k in keys], object)):
            best = Best(7, 10, positive)
            for at in range(0, 500, 90):
                best.add(scores[at : at + 90], own[at : at + 90])
            for q in range(7):
                want = sorted((-s, k) for s, k in zip(np.round(scores[:, q], 6).tolist(), own.tolist()) if s > 0 or not positive)[:10]
                assert [(-s, k) for s, k in zip(best.score[best.question == q].tolist(), best.key[best.question == q].tolist())] == want


def test_one_tile_at_a_time():
    draw = np.random.default_rng(2)
    questions, vectors = draw.normal(size=(12_000, 8)), draw.normal(size=(4_000, 8)).astype(np.float32)
    batch = pa.record_batch({"vec_id": np.arange(4_000), "embedding": pa.array(list(vectors), pa.list_(pa.float32()))})
    tracemalloc.start()
    rows = list(retrieval.nearest(np.arange(12_000), questions, 5, [batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All scores of the batch at once would be 384 MB.
    assert peak < 120e6 and sum(len(ids) for ids, _, _ in rows) == 60_000
    ids, keys, _ = (np.concatenate(c) for c in zip(*rows))
    for q in (0, 5_000, 11_999):
        assert set(keys[ids == q]) == set(np.argsort(-(vectors.astype(np.float64) @ questions[q]))[:5])


def test_filtered_search_through_the_same_tiles(spark):
    rows = [(k, [float(k % 5), 1.0], k % 2) for k in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "query_id long, embedding array<float>")
    out = retrieval.dense(vectors.filter("label = 1"), asked, 3)
    assert {(r.query_id, r.vec_id, r.rank) for r in out.collect()} == {(1, 9, 1), (1, 19, 2), (1, 29, 3), (2, 5, 1), (2, 15, 2), (2, 25, 3)}
    assert "MapInArrow" in out._jdf.queryExecution().toString()
