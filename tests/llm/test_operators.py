"""Each operator against a brute-force version or a round trip, with nulls, empty texts, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import chat, compression, contamination, divergence, line_dedup, packing, pitman_yor, simhash, suffix, url_filter

W = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, pool=W):
    return " ".join(rng.choice(pool) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    own = [words(rng, 60, [f"w{k}" for k in range(400)]) for _ in range(12)]
    texts = [None, "", " \n ", "one", *own, own[0], own[0], own[1] + " tail", words(rng, 4000), "Und " * 300, own[2] + "\n" + own[3] + "\n" + own[2]]
    return [(k, t, "en" if k % 3 else None, "s", 0) for k, t in enumerate(texts)] + [(None, own[4], "en", "s", 0), (5, own[1], "en", "s", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).withColumn("words", F.lit("clash"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_packing_round_trip(spark, docs, empty, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.pack_documents(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), path, limits=packing.Limits(tokens=256, loss=256), with_ids=True).collect()
    by, seqs = {}, {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    t = Tokenizer.from_file(path)
    texts = {r.doc_id: r.text for r in docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()}
    assert set(by) == set(texts)
    for k, pieces in by.items():
        pieces.sort(key=lambda r: r.start)
        ids = [i for r in pieces for i in r.ids]
        assert ids == t.encode(texts[k] or "", add_special_tokens=False).ids + [1]
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in pieces)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256 and (at == 256 or at & (at - 1) == 0)
    assert packing.pack_documents(empty, path).count() == 0


def test_packer_limits():
    p = packing.VectorPacker(packing.Limits(tokens=100, segments=3, loss=60, pool=8), cut=False)
    rng = random.Random(1)
    sizes = [(n := rng.randint(1, 100), rng.randint(0, min(n, 60))) for _ in range(100)]
    got = [x for k, (n, b) in enumerate(sizes) for x in p.add(k, n, b)] + list(p.finish())
    assert sorted(x.example for x in got) == list(range(100))
    by = {}
    for x in got:
        by.setdefault(x.sequence, []).append(x)
    assert all(sum(x.length for x in v) <= 100 and len(v) <= 3 and sum(x.loss for x in v) <= 60 for v in by.values())


def test_simhash_groups(spark, docs, empty, rows):
    fps = [(i, simhash.fingerprint(t)) for i, t, *_ in rows]
    group = list(range(len(fps)))
    for _ in fps:
        for a, (_, x) in enumerate(fps):
            for b, (_, y) in enumerate(fps):
                if (x ^ y).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    least = {}
    for (i, _), g in zip(fps, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted(((i, f"{x:016x}", least.get(g)) for (i, x), g in zip(fps, group, strict=True)), key=str)
    assert sorted((tuple(r) for r in simhash.near_groups(docs).collect()), key=str) == want
    assert simhash.near_groups(empty).count() == 0


def test_bit_sliced_comparison_and_tiles(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    fps = np.unique(np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 40, np.uint64)), base ^ np.uint64(7)]))[:, None]
    want = {(a, b) for a in range(len(fps)) for b in range(len(fps)) if int(fps[a, 0] ^ fps[b, 0]).bit_count() <= 2}
    assert {(int(a), int(b)) for x, y in simhash.within(fps, fps, 2) for a, b in zip(x, y, strict=True)} == want
    df = spark.createDataFrame([(int(x),) for x in fps[:, 0].view(np.int64)], "fp long")
    roots = [simhash.components(simhash.links(df, 2, tile)).orderBy("node").collect() for tile in (4096, 2)]
    assert roots[0] == roots[1]


def test_similar_groups(spark):
    rng = random.Random(2)
    base = [words(rng, 300, [f"x{k}" for k in range(3000)]) for _ in range(20)]
    near = [t.replace(t.split()[50], "changed", 1) for t in base]
    df = spark.createDataFrame(list(enumerate(base + near)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    assert all(got[k] == k and got[k + 20] == k for k in range(20))


def test_suffix_array():
    rng = np.random.default_rng(0)
    for k in range(60):
        s = np.append(rng.integers(1, rng.integers(2, 5), rng.integers(1, 120)), 0)
        sa = suffix.suffix_array(s, names=4096 if k % 2 else 2)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("setting", [suffix.Settings(length=60, anchor=10), suffix.Settings(length=60, anchor=10, hot=1, chunk=300)])
def test_repeats(spark, docs, empty, rows, setting):
    n = setting.length
    raws = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(r[k : k + n] for _, r in raws for k in range(len(r) - n + 1))
    want = []
    for i, r in raws:
        gone = np.zeros(len(r) + 2, np.int8)
        for k in range(len(r) - n + 1):
            if seen[r[k : k + n]] > 1:
                gone[k + 1 : k + 1 + n] = 1
        kept = bytes(b for b, g in zip(r, gone[1:], strict=False) if not g)
        want.append((i, len(r), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r)[:5] for r in suffix.remove_repeats(docs, setting).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert suffix.remove_repeats(empty).count() == 0


def test_line_dedup(spark, docs, empty):
    lines = "\n".join(["a b c d e f g h i j", "a b c d e f g h i", "x y", "x y", "q w e r t y"])
    df = spark.createDataFrame([(1, lines, "z"), (2, "A B C D E F G H I J\nnew words are in this line", "z"), (3, None, "z"), (4, "", "z")], "doc_id long, text string, n_lines string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df).collect()}
    assert got[1] == ("a b c d e f g h i j\nx y\nx y\nq w e r t y", 5, 1)
    assert got[2] == ("new words are in this line", 2, 1)
    assert got[3] == (None, 0, 0) and got[4] == ("", 1, 0)
    assert line_dedup.dedup_lines(docs).count() == docs.count()
    assert line_dedup.dedup_lines(empty).count() == 0


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    item = words(rng, 30, [f"k{k}ab" for k in range(300)])
    edited = item.replace(item.split()[9], "zzz").upper()
    rows = [(1, "before " + item + " after"), (2, "x " * 50 + edited + "  y"), (3, words(rng, 200)), (4, None), (5, item[: len(item) // 2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, " ")], "item_id long, text string")
    got = {r.doc_id: r for r in contamination.find_items(df, bench).collect()}
    assert [got[k].contaminated for k in (1, 2, 3, 4, 5)] == [True, True, False, False, False]
    assert got[1].edits == [0] and 0 < got[2].edits[0] <= 10
    small = contamination.find_items(df, bench, contamination.Settings(block=10, piece=64)).collect()
    assert {r.doc_id: r.item_ids for r in small} == {k: r.item_ids for k, r in got.items()}
    assert contamination.find_items(empty, bench).count() == 0
    assert not contamination.find_items(df, bench.limit(0)).filter("contaminated").count()


def test_quality_rules(spark, docs, empty, rows):
    got = {(r.doc_id, r.n_words, r.n_repeat_words): r for r in divergence.quality_rules(docs).collect()}
    for i, t, *_ in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(tuple(ws[k : k + 8]) for k in range(len(ws) - 7))
        repeated = {j for k in range(len(ws) - 7) if grams[tuple(ws[k : k + 8])] > 1 for j in range(k, k + 8)}
        r = got[i, len(ws), len(repeated)]
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r.word_chars == sum(map(len, ws)) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(ws) < 20 or 100 * len(repeated) > 30 * len(ws))
        assert not (r.base_failed and r.kept)
    assert divergence.quality_rules(empty).count() == 0


def test_compression(spark, empty):
    rng = random.Random(4)
    good = [(k, words(rng, 80, [f"plain{k}" for k in range(50)])) for k in range(0, 160)]
    bad = [(k, " ".join(w.upper() + "!!" for w in words(rng, 80, [f"junk{k}" for k in range(50)]).split())) for k in range(160, 260)]
    df = spark.createDataFrame(good + bad + [(999, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 160)) for k in range(260)] + [(3, 1), (None, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in compression.classify(df, labels).collect()}
    assert all(got[k].predicted == int(k < 160) for k in range(260)) and 0 <= got[999].score <= 1
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items() if k is not None)
    assert {r.score for r in compression.classify(df, labels.limit(0)).collect()} == {0.5}
    assert compression.classify(empty, labels).count() == 0


def test_pitman_yor(spark, docs, empty, rows):
    got = pitman_yor.score_texts(docs).collect()
    train, base = Counter(), {}
    toks = [(i, [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["\n"]) for i, t, *_ in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    for i, ws in toks:
        if not held(i):
            train.update(ws)
    n, v = sum(train.values()), len(train)
    want = sorted((str(i), held(i), len(ws), sum(w in train for w in ws), n, round(sum(np.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in toks)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got) and base == {}
    many = pitman_yor.score_texts(docs, pitman_yor.Settings(bucket_chars=3000, block_tokens=500)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known) for r in many) == sorted((str(r.doc_id), r.n_tokens, r.n_known) for r in got)
    assert pitman_yor.score_texts(empty).count() == 0


def test_tables_have_the_exact_distribution():
    """Two customers of one dish: one table or two, in the proportions of the restaurant process."""
    d, strength, p = 0.5, 1.0, 0.2
    logs = pitman_yor.stirling(8, d)
    t = pitman_yor.sample_tables(np.random.default_rng(1), np.full(40000, 2), np.zeros(40000), np.full(40000, p), d, strength, logs)
    one, two = (1 - d) * p, (strength + d) * p * p
    assert abs((t == 2).mean() - two / (one + two)) < 0.01


def test_urls(spark):
    rows = [(1, "https://A.org/en/2"), (2, "http://x.example.org/en/17?x"), (3, "http://example.org/es/"), (4, "https://b.com/fr/3#t"), (5, "b.com/de/1"), (6, None), (7, "http://q.net/zz"), (7, "http://q.net/zz"), (8, "http://org"), (None, "ftp://b.COM/de/x")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == len(rows)
    assert by[1] == ("a.org", "/en/2", "org/", "allow") and by[2] == ("x.example.org", "/en/17", "example.org/en/1", "block")
    assert by[3][2:] == ("example.org/es/", "block") and by[4] == ("b.com", "/fr/3", "com/fr/", "allow")
    assert by[5][:3] == ("", "", None) and by[6][:3] == ("", "", None) and by[8][:3] == ("org", "", None) and by[None][2] == "com/de/"
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_chat(spark):
    rng = random.Random(6)
    turns = [(c, k, ["system", "user", "assistant"][0 if not k else 1 + (k + 1) % 2], words(rng, 8 if k % 2 else 40) + "\nand more here") for c in range(60) for k in range(7)]
    df = spark.createDataFrame(turns + [(None, 0, "user", None)], "conv_id long, turn long, role string, text string")
    lines = chat.transcripts(df, block=3)
    model = chat.fit(lines)
    got = chat.parse(lines, model).collect()
    truth = {(r.conv_id, r.ord): r.role for r in lines.filter("first").collect()}
    right = sum(truth.get((r.conv_id, r.turn)) == r.role for r in got)
    assert right > 0.95 * len(truth)
    # The blocks only divide the work.
    whole = chat.parse(chat.transcripts(df, block=1000), model).collect()
    assert sorted(map(str, whole)) == sorted(map(str, got))
    assert chat.parse(lines.limit(0), model).count() == 0


def test_chat_long_turn_is_one(spark):
    rows = [(1, 0, "user", "a question for you?"), (1, 1, "assistant", "\n".join(f"line {k} of a long answer" for k in range(40))), (1, 2, "user", "thanks"), (1, 2, "user", "thanks")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("clash"))
    model = chat.fit(chat.transcripts(df, unmarked=10**9))
    got = sorted(chat.parse(chat.transcripts(df, block=8, unmarked=10**9), model).collect(), key=lambda r: r.turn)
    assert [(r.role, r.n_lines) for r in got][:2] == [("user", 1), ("assistant", 40)] and sum(r.n_lines for r in got) == 43
    assert got[1].rendered.count("line ") == 40 and got[1].rendered.startswith("<|assistant|>\nline 0 ")


def test_viterbi_against_all_paths():
    """The block matrices and the path against the best of all paths."""
    from itertools import product

    rng = np.random.default_rng(3)
    n = len(chat.STATES)
    model = chat.Model(rng.normal(size=n), rng.normal(size=(n, n)), rng.normal(size=(n, chat.FEATURES)))
    shown = rng.integers(0, chat.FEATURES, 5).tolist()

    def value(path):
        return model.start[path[0]] + sum(model.step[a, b] for a, b in zip(path, path[1:])) + sum(model.shows[s, x] for s, x in zip(path, shown))

    best = max(product(range(n), repeat=5), key=value)
    assert chat.viterbi(shown, model, model.start) == list(best)
    m = chat.transfer(shown, model)
    assert np.isclose((model.start[:, None] + m).max(), value(best))
