"""What a Python worker holds: few texts at once, few pieces of words."""

import random

from quillspan.llm import common, packing
from quillspan.llm.queries import tokenizer_path


def test_few_texts_at_once():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"x": list(range(a, b))}) for a, b in ((0, 700), (700, 700), (700, 900))]
    got = [b.column("x").to_pylist() for b in common.sliced(iter(batches))]
    assert max(map(len, got)) <= 256 and sum(got, []) == list(range(900))


def test_pieces_are_bounded():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    texts = [" ".join(word() + rng.choice(["", ",", ".x"]) for _ in range(50)) for _ in range(100)]
    small = packing.WordTokenizer(tokenizer_path(), keep=8000)
    assert small.encode(texts) == small._encode(texts)
    # Those of one text may come on top of a full table.
    assert len(small.pieces) <= 8000 // 16 + 200
