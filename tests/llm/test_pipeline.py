"""The stages on a small table whose right result is plain, and the whole run on the smallest given tables."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quillspan.llm.queries import tokenizer_path

COMMON = "the of and to in is that it for was on are as with they be at one have this".split()


def prose(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.5 else "".join(rng.choice(["ba", "lo", "ne", "ri", "tu", "mes", "kar"]) for _ in range(rng.randint(2, 5))) for _ in range(n))


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    clean = [prose(rng, 300) for _ in range(30)]
    item = prose(rng, 40)
    near = clean[0].replace(clean[0].split()[20], "altered", 1)
    shared = prose(rng, 25)
    texts = [*clean, clean[1], near, clean[2][:600] + " " + item + " " + clean[3][:600], "short", "Und " * 200, prose(rng, 200) + "\n" + shared, prose(rng, 200) + "\n" + shared]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        seen[name] = {r.doc_id: r.text for r in now.collect()}
    assert set(range(30)) <= set(seen["quality rules"]) and not {33, 34} & set(seen["quality rules"])
    assert seen["line dedup"][35].endswith(shared) and shared not in seen["line dedup"][36]
    assert not {30, 31} & set(seen["simhash near-dedup"]) and set(range(30)) <= set(seen["simhash near-dedup"])
    kept = seen["benchmark decontamination"]
    assert set(kept) == {*range(30), 35, 36}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(tokenizer_path())
    for k, text in kept.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r for r in pieces if r.doc_id == k), key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    assert {r.doc_id for r in pieces} == set(kept)


def test_registered(spark):
    pytest.importorskip("__spark_entry__")
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}
