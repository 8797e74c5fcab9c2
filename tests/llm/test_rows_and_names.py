"""Null ids, repeated rows, long texts and clashing names; the limits of the packer; passages; bit-sliced neighbours."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspan.llm import compression, contamination, divergence, line_dedup, packing, passages, simhash, suffix, url_filter
from quillspan.llm.queries import tokenizer_path

COMMON = "the of and to in is that it for was on are as with they be at one have this".split()
CLASH = ("removed", "id", "row", "set", "n_lines", "__removed", "h", "gone", "c0", "k", "marks")


def prose(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.5 else "".join(rng.choice(["ba", "lo", "ne", "ri", "tu", "mes", "kar"]) for _ in range(rng.randint(2, 5))) for _ in range(n))


def test_line_dedup_names_nulls_and_repeats(spark):
    rows = [(None, "one two three four five six"), (1, "one two three four five six\nother words"), (1, "one two three four five six\nother words"), (2, None), (3, "w " * 50_000 + "\nother words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASH})
    out = line_dedup.dedup_lines(df, line_dedup.Settings(least=1))
    got = [(r.doc_id, r.text, r.n_removed) for r in out.collect()]
    assert sorted(got, key=str)[:2] == [(1, "other words", 1)] * 2
    assert (None, rows[0][1], 0) in got and (2, None, 0) in got and (3, "w " * 50_000, 1) in got
    assert set(CLASH) <= set(out.columns)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_rows_and_names(spark, tmp_path, name, stage):
    """Each stage by itself: nulls, empty and long texts, repeated rows, names that clash, an empty table."""
    rng = random.Random(5)
    item = prose(rng, 40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean, other = prose(rng, 120), prose(rng, 120)
    rows = [(None, clean), (None, other + " " + item), (7, clean + "\n" + other), (7, other + " " + item + "."), (8, None), (9, ""), (10, prose(rng, 30_000)), (7, clean + "\n" + other), (None, "two words")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in CLASH})
    out = stage(spark, df, str(tmp_path))
    got = [(r.doc_id, r.text) for r in out.collect()] if "text" in out.columns else out.collect()
    if name != "packing":
        assert out.columns == df.columns and all(r.removed == "x" for r in out.collect())
    if name == "quality rules":
        assert (None, clean) in got and got.count(rows[2]) == 2 and (8, None) not in got and (None, "two words") not in got
    if name == "line dedup":
        # Lines of null ids are first; of the repeated row both lose the first line.
        assert (None, clean) in got and (7, other) in got and got.count((7, clean + "\n" + other)) == 0 and (8, None) in got and (9, "") in got
    if name == "simhash near-dedup":
        assert (None, clean) in got and got.count(rows[2]) == 1 and sum(t in (None, "") for _, t in got) == 1
    if name == "benchmark decontamination":
        assert sorted(map(str, got)) == sorted(map(str, (r for r in rows if item not in (r[1] or ""))))
    assert stage(spark, df.limit(0), str(tmp_path)).count() == 0


def test_near_dedup_by_rows(spark):
    """Of equal ids with different texts, only the near copy goes; one without an id goes before one with."""
    rng = random.Random(1)
    a, b = prose(rng, 300), prose(rng, 300)
    near = a.replace(a.split()[9], "changed", 1)
    rows = [(3, a), (3, b), (None, near), (5, near)]
    got = simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(3, a), (3, b)])


def test_packer_keeps_the_loss_limit():
    limits = packing.Limits(tokens=128, segments=8, loss=40, pool=16)
    rng = random.Random(2)
    for cut_from in (1, 5):
        packer = packing.VectorPacker(limits)
        sizes = [(n := rng.randint(cut_from, 300), rng.randint(0, n)) for _ in range(60)]
        got = [p for k, (n, b) in enumerate(sizes) for p in packer.add(k, n, b)] + list(packer.finish())
        by, whole = {}, {}
        for p in got:
            by.setdefault(p.sequence, []).append(p)
            whole.setdefault(p.example, []).append(p)
        for v in by.values():
            assert sum(p.length for p in v) <= 128 and len(v) <= 8 and sum(p.loss for p in v) <= 40
            at = 0
            for p in sorted(v, key=lambda p: p.offset):
                assert p.offset == at and p.length > 0
                at += p.length
        for k, (n, b) in enumerate(sizes):
            at = 0
            for p in sorted(whole[k], key=lambda p: p.start):
                assert p.start == at
                at += p.length
            assert at == n and sum(p.loss for p in whole[k]) == b


def test_special_tokens_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    added = [x.content for x in t.get_added_tokens_decoder().values()]
    texts = ["a plain text", *(f"before {x} after{x}" for x in added), *(x.upper() for x in added), "<|", None, "", "\x1codd"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in packing.pack_documents(df.withColumn("ids", F.lit(1)), tokenizer_path(), with_ids=True).collect():
        got.setdefault(r.doc_id, []).append((r.start, list(r.ids)))
    for k, text in enumerate(texts):
        assert [i for _, p in sorted(got[k]) for i in p] == [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_bit_sliced_neighbours_of_many_groups():
    rng = np.random.default_rng(4)
    fps, starts, ends, at = [], [], [], 0
    for _ in range(60):
        n = int(rng.integers(1, 65))
        base = rng.integers(0, 1 << 63, 3, np.uint64)
        own = base[rng.integers(0, 3, n)] ^ (np.uint64(1) << rng.integers(0, 64, n, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n, np.uint64))
        fps.append(own)
        starts.append(at)
        at += n
        ends.append(at)
    fps = np.concatenate(fps)[:, None]
    want = {(a, b) for s, e in zip(starts, ends) for a in range(s, e) for b in range(a + 1, e) if int(fps[a, 0] ^ fps[b, 0]).bit_count() <= 2}
    a, b = simhash.neighbours(fps, np.array(starts), np.array(ends), 2)
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


@pytest.mark.parametrize("few", [2000, 1])
def test_passages_against_brute_force(spark, few, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK", 4096)
    rng = random.Random(6)
    pool = [f"p{k}" for k in range(900)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.choice([20, 60, 200]))) for _ in range(40)]
    for n in (49, 50, 51, 52, 80):
        own = " ".join(rng.choice(pool) for _ in range(n))
        texts += [f"{texts[rng.randrange(9)]} {own} {n}a", f"{n}b {own}\n{texts[10]}"]
    texts += ["la la " * 60, "la " * 300, "x" * 9000 + " " + "la " * 51, "", "one"]
    runs = [{tuple(w[k : k + 51]) for k in range(len(w) - 50)} for w in (t.split() for t in texts)]
    want = {k for k, r in enumerate(runs) if any(r & o for j, o in enumerate(runs) if j != k)}
    df = spark.createDataFrame(list(enumerate(texts)), "t long, text string")
    assert {r.t for r in passages.texts_with_passages(df, 50, few).collect()} == want


def test_repeated_passages_and_rows(spark):
    rng = random.Random(7)
    shared = " ".join(rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randrange(9)) for _ in range(55))
    rows = [(1, prose(rng, 90) + " " + shared), (2, shared + " " + prose(rng, 90)), (3, prose(rng, 90)), (4, prose(rng, 90)), (4, None), (5, "short"), (6, "short")]
    rows.append((7, rows[3][1]))
    got = {(r.doc_id, r.n_bytes): r.repeats_passage for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("marks", F.lit(0))).collect()}
    size = lambda k: len((rows[k][1] or "").encode())
    assert [got[rows[k][0], size(k)] for k in range(8)] == [True, True, False, True, False, False, False, True]


def test_other_operators_with_clashing_names_and_long_texts(spark):
    rng = random.Random(8)
    rows = [(None, prose(rng, 40_000)), (1, prose(rng, 100)), (1, prose(rng, 100)), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("score", "quality", "edits", "item_ids", "held_out", "fp", "node")})
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    assert compression.classify(df, labels).count() == 4
    bench = spark.createDataFrame([(3, rows[0][1][200:500])], "item_id long, text string")
    assert [(r.doc_id, r.contaminated) for r in contamination.find_items(df, bench).collect()] == [(None, True), (1, False), (1, False), (2, False)]
    assert simhash.near_groups(df).count() == 4
    assert divergence.quality_rules(df.withColumn("lang", F.lit("en"))).count() == 4
    urls = spark.createDataFrame([(1, "https://a.org/" + "x" * 30_000), (2, "https://b.com/q"), (None, None)], "page_id long, url string").withColumns({c: F.lit("x") for c in ("body", "gram", "score", "host")})
    assert url_filter.judge_urls(urls).count() == 3


def test_decontamination_against_brute_force(spark):
    """Every document against every item by the full table of edits."""
    rng = random.Random(9)
    items = [prose(rng, 12) for _ in range(6)]
    docs = []
    for k in range(40):
        text = items[k % 6]
        for _ in range(rng.randrange(0, 16)):
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", "z", "qq"]) + text[at + rng.randrange(2) :]
        docs.append(prose(rng, 10) + " " + text + " " + prose(rng, 10))

    def least(item, text):
        row = [0] * (len(text) + 1)
        for a in item:
            new = [row[0] + 1]
            for j, b in enumerate(text):
                new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    want = {}
    for k, d in enumerate(docs):
        raw = contamination.normalise(d)
        for i, x in enumerate(items):
            item = contamination.normalise(x)
            n = least(item, raw)
            if n <= contamination.budget(len(item), 0.1):
                want.setdefault(k, {})[i] = n
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = contamination.find_items(df, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {r.doc_id: dict(zip(r.item_ids, r.edits)) for r in got if r.contaminated} == want
    assert 5 < len(want) < 40
