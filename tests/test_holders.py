"""Strings in texts: each text is gone through once, and its pieces are not made rows."""

import random

from quillspan.operators import metadata
from quillspan.operators.holders import SPAN, Strings, squeezed


def test_strings_are_found_as_by_brute_force():
    draw = random.Random(3)
    texts = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(300))) for _ in range(60)] + [b"", b"a" * 90, b"b" * SPAN + b"a" * 40 + b"b" * 20]
    strings = [b"", b"ab", b"a" * 8, b"a" * 40, b"a" * 33 + b"b", b"q" * 15] + [texts[k][5 : 5 + n] for k in range(9) for n in (3, 8, 9, 15, 16, 17, 31, 32, 33, 60)]
    strings = list(dict.fromkeys(strings))
    assert set(Strings(strings).find(texts)) == {(n, k) for n, t in enumerate(texts) for k, s in enumerate(strings) if s in t}


def test_squeezed_is_norm(spark):
    texts = ["A-b 9_Ñ", "", "İK ſ", "x\n\x00Y", "ÀÉÎ"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0].encode() for r in df.select(metadata.norm(df["text"])).collect()] == [squeezed(t) for t in texts]


def test_owners_look_at_texts_where_they_are(spark):
    draw = random.Random(5)
    words = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    own, shared = words(40), words(40)
    filings = spark.createDataFrame([(1, 1, words(9) + own), (1, 2, words(9)), (2, 1, shared), (3, 1, "!" + shared.upper()), (4, 1, None)], "doc_id long, page int, text string")
    excerpts = spark.createDataFrame([(7, own), (8, shared), (9, "short"), (10, words(40))], "id long, text string")
    out = metadata.evidence_owners(excerpts, filings)
    assert [tuple(r) for r in out.collect()] == [(7, 1, [1])]
    # The pieces of the pages were rows before: one for each place.
    assert "sequence(1" not in out._jdf.queryExecution().toString()
