"""Groups of texts by the exact overlap of their five-word shingles, against brute force."""

import random

from quillspan.llm import simhash


def shingles(text):
    ws = text.lower().split()
    return {" ".join(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()


def test_links_against_brute_force(spark):
    rng = random.Random(11)
    texts = [None, "", "one two", "one  TWO", "la " * 300 + "p q r s t u v", "la " * 300 + "b c d e f g h"]
    for k in range(60):
        own = [f"x{rng.randrange(5000)}" for _ in range(rng.choice([12, 40, 200, 400]))]
        texts.append(" ".join(own))
        for cut in (0.09, 0.1, 0.11, 0.12, 0.15, 0.2, 0.3):
            texts.append(" ".join(own[: round(len(own) * (1 - cut))] + [f"y{rng.randrange(5000)}" for _ in range(round(len(own) * cut * (k % 2)))]))
    sets = [shingles(t or "") for t in texts]
    at = {}
    group = list(range(len(texts)))
    find = lambda x: x if group[x] == x else find(group[x])
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * len(sets[a] | sets[b]):
                at[a, b] = both / max(1, len(sets[a] | sets[b]))
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    assert sum(0.8 <= v < 0.85 for v in at.values()) > 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    assert got == {k: find(k) for k in range(len(texts))}
    assert simhash.similar_groups(df.limit(0)).count() == 0
