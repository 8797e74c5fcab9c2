"""Terms of a text are made once, not for each question that it is a candidate of."""

from pyspark.sql import functions as F

from quillspan.operators import stages
from quillspan.plans.engine import Engine, Variant


class Seen(stages.CoverageReranker):
    def score(self, pairs):
        self.pairs = pairs
        return super().score(pairs)


def test_candidates_come_with_their_terms(spark):
    rows = [(f"c{k}", f"d{k}", 1, 0, "narrative", t, "", "", "", "") for k, t in enumerate(["the risk of debt", "debt and more debt", "nothing"])]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, page int, chunk_no int, chunk_type string, text string, company string, year string, doc_type string, section string")
    asked = spark.createDataFrame([(1, "What risk of debt?"), (2, "Debt debt"), (3, "")], "id long, question string")
    seen = Seen()
    e = Engine(chunks, reranker=seen)
    got = {(r.id, r.chunk_id): r.prob for r in e.retrieve(e.analyze(asked), Variant(vector=False)).collect()}
    assert {"question_terms", "text_terms"} <= set(seen.pairs.columns)
    plain = stages.CoverageReranker().score(seen.pairs.drop("question_terms", "text_terms")).collect()
    assert got == {(r.id, r.chunk_id): r.prob for r in plain} == {(1, "c0"): 0.666667, (1, "c1"): 0.333333, (2, "c0"): 1.0, (2, "c1"): 1.0}
    # Given terms are taken as they are.
    assert stages.CoverageReranker().score(seen.pairs.withColumn("text_terms", F.array(F.lit("x")))).agg(F.max("prob")).first()[0] == 0
