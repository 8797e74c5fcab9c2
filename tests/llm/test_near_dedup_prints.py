"""The pipeline's near-dedup goes by SimHash fingerprints, and by the overlap of shingles beside them."""

import random

import corpus_pipeline
from quillspan.llm import simhash


def test_links_by_fingerprints_and_by_overlap(spark, tmp_path):
    rng = random.Random(4)
    line = " ".join(f"x{rng.randrange(5000)}" for _ in range(11))
    own = [" ".join(f"{c}{rng.randrange(5000)}" for _ in range(60)) for c in "pqrs"]
    changed = own[2].split()
    changed[30:32] = ["one", "two"]
    # The repeats of a line make up most shingles, so the texts of each pair have one fingerprint, but not one set.
    texts = [(line + " ") * 31 + own[0], (line + " ") * 31 + own[1], own[2], " ".join(changed), own[3]]
    fps = [simhash.fingerprint(x) for x in texts]
    sets = [set(simhash.shingle_set(x, 5).tolist()) for x in texts]
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2
    over = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert near(0, 1) and not over(0, 1) and over(2, 3) and not near(2, 3)
    df = spark.createDataFrame([(k, x, k) for k, x in enumerate(texts)], "doc_id long, text string, other long")
    got = corpus_pipeline.near_dedup(spark, df, str(tmp_path))
    assert sorted((r.doc_id, r.other) for r in got.collect()) == [(0, 0), (2, 2), (4, 4)]
