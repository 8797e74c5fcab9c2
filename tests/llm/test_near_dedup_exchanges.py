"""Exchanges that nothing reads again go before the next table of the near-dedup join is made."""

from quillspan.llm import simhash


def test_exchanges_go_between_tables(spark, monkeypatch):
    seen, write, drop = [], simhash.materialize, getattr(simhash, "drop_exchanges", lambda spark: None)
    monkeypatch.setattr(simhash, "materialize", lambda df, tag: (write(df, tag), seen.append(tag))[0])
    monkeypatch.setattr(simhash, "drop_exchanges", lambda spark: (drop(spark), seen.append("drop"))[0], raising=False)
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (2, text + " more"), (3, "other words than these"), (4, None)]
    nodes, links = simhash.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert links.count() == 1 and nodes.count() == 4
    assert seen == ["shingles", "drop", "candidates", "drop", "whole", "drop", "links"]
