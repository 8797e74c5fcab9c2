import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillspan.operators import evaluation as E
from quillspan.operators import metadata, stages
from quillspan.plans import config
from quillspan.plans.registry import Registry, registry
from quillspan.sources import files


def test_grader():
    assert E.numeric_grade("about $2.5 billion", "2,500 million") and E.numeric_grade("25%", "a share of 0.25") and not E.numeric_grade("120", "130")
    assert E.numeric_grade("no amounts", "5") is None and E.grader_numbers("in 2018 (40) and -3") == [(-40.0, False), (-3.0, False)]


def test_errors(spark):
    items = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(10)], "id long, grp string")
    for bad in (lambda: E.stratified_split(items.union(items), 3, 1), lambda: E.stratified_split(items, 11, 1), lambda: E.bootstrap_ci(items, "id", "id", confidence=1.0), lambda: E.recall(F.lit(1), F.lit(1), 0), lambda: E.confusion(spark.createDataFrame([("x", "y")], "truth string, said string"), ["x"]), lambda: E.check_split(spark.createDataFrame([(1, "dev"), (1, "test")], "id long, split string"))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(PySparkException):
        items.limit(0).agg(E.rate(F.col("id") > 1)).collect()
    # The order of the input does not matter.
    one, two = (E.stratified_split(x, 4, 9).orderBy("id").collect() for x in (items, items.orderBy(F.desc("id"))))
    assert one == two and sum(r.split == "dev" for r in one) == 4


def test_files(spark, tmp_path):
    html = tmp_path / "docs"
    html.mkdir()
    (html / "a.html").write_bytes(b"<p>one</p>\xff<div style='page-break-before:always'>two")
    (html / "b.txt").write_text("x\fy")
    (html / "c.bin").write_text("no")
    got = [(r.doc_id, r.page, r.text) for r in files.read_documents(spark, str(html)).orderBy("doc_id", "page").collect()]
    assert got == [("a", 1, "one"), ("a", 2, "two"), ("b", 1, "x"), ("b", 2, "y")]
    split = spark.createDataFrame([("1", "g", "dev"), ("2", "g", "test")], "id string, grp string, split string")
    files.save_split(split, str(tmp_path / "split"))
    with pytest.raises(PySparkException):
        files.save_split(split, str(tmp_path / "split"))
    back = files.load_split(spark, str(tmp_path / "split"))
    assert back.count() == 2 and [r.id for r in files.rows_of(split, back, "dev").collect()] == ["1"] and files.rows_of(split, back, "all").count() == 2
    bad = spark.createDataFrame([("c", "d", 2, 1)], "chunk_id string, doc_id string, page_start int, page_end int")
    files.write_lines(bad, str(tmp_path / "chunks"))
    with pytest.raises(PySparkException):
        files.read_chunks(spark, str(tmp_path / "chunks")).collect()
    (tmp_path / "manifest.json").write_text('{"d1": {"company": "C", "year": "2001", "doc_type": "10-K", "aliases": ["X"]}}')
    assert files.read_manifest(spark, str(tmp_path / "manifest.json")).first().aliases == ["X"]
    with pytest.raises(RuntimeError):
        files.pdf_tables(b"")


def test_evaluation_goes_on_where_it_stopped(spark, tmp_path):
    items = spark.createDataFrame([("1", "q"), ("2", "q")], "id string, question string")
    answer = lambda df: df.select("id", "question", F.lit("p").alias("prediction"))
    path = str(tmp_path / "run")
    assert files.evaluate_new(items.limit(1), path, answer) == 1 and files.evaluate_new(items, path, answer) == 1 and files.evaluate_new(items, path, answer) == 0
    assert sorted(r.id for r in files.read_records(spark, path).collect()) == ["1", "2"]


def test_registry():
    own = Registry()

    @own.register("gate", "always")
    class Always(stages.Gate):
        def verdict(self, evidence):
            return F.lit("sufficient")

    assert own.available("gate") == ["always"] and isinstance(own.create("gate", "always"), Always)
    own.register("gate", "always")(Always)
    with pytest.raises(ValueError):
        own.register("gate", "always")(stages.ThresholdGate)
    with pytest.raises(TypeError):
        own.register("gate", "x")(dict)
    for bad in (lambda: own.find("gate", "none"), lambda: own.available("nothing")):
        with pytest.raises(KeyError):
            bad()
    own.unregister("gate", "always")
    assert own.available("gate") == [] and {k for k in ("bm25", "dense")} <= set(registry.available("retriever"))


def test_config(tmp_path):
    pack = tmp_path / "pack.yaml"
    pack.write_text("search:\n  top: 7\nsections: [a]\n")
    c = config.load(pack, {"search": {"rrf": 10}})
    assert config.get(c, "search.top") == 7 and config.get(c, "search.rrf") == 10 and config.get(c, "search.fused") == 20 and config.get(c, "search.none.deep", 3) == 3
    with pytest.raises(KeyError):
        config.load(None, {"search": {"top": None}})


def test_stand_ins(spark):
    text = spark.createDataFrame([(1, "The risk of debt and debt")], "id long, text string")
    c = stages.KeywordClassifier({"risk": ["risk", "danger"], "debt": ["debt"]})
    got = text.select(c.scores(F.col("text"), ["risk", "debt"]).alias("s")).first().s
    assert [x.label for x in got] == ["debt", "risk"] and abs(sum(x.score for x in got) - 1) < 1e-9
    tagged = c.tag(text.withColumn("chunk_type", F.lit(None).cast("string")), {"risk": "r", "debt": "d"}).first()
    assert tagged.chunk_type == "d" and tagged.type_score == 0.6667
    v = stages.VocabularyExtractor(spark.createDataFrame([("Debt and", "x"), ("risk", "y")], "span string, type string"))
    assert sorted((r.span, r.type) for r in v.entities(text).collect()) == [("debt and", "x"), ("risk", "y")]
    e = stages.HashingEmbedder(16).embed(text.union(spark.createDataFrame([(2, "")], text.schema))).orderBy("id").collect()
    assert abs(sum(x * x for x in e[0].embedding) - 1) < 1e-9 and set(e[1].embedding) == {0.0}
    asked = spark.createDataFrame([(1, "debt risk?", [("No word. The risk of debt is high.", 4)]), (2, "zzz", [("Nothing.", 1)])], "id long, question string, passages array<struct<text:string,page:int>>")
    out = stages.ExtractiveGenerator().generate(asked).orderBy("id").collect()
    assert out[0].answer == "The risk of debt is high. [p. 4]" and out[1].refused
    pairs = spark.createDataFrame([("q", "debt risk", "risk of debt", 2), ("q", "debt risk", "nothing", 1)], "q string, question string, text string, rank int")
    assert [r.text for r in stages.CoverageReranker().rerank(pairs, "q", 1).collect()] == ["risk of debt"]
    gate = stages.ThresholdGate(0.5, 0.2, "both")
    assert text.select(gate.verdict(gate.evidence(F.lit(0.9), F.lit(0.3))).alias("v")).first().v == "sufficient"


def test_sections_and_statements(spark):
    rows = [("d", 1, "Item 1. First\nbody"), ("d", 2, "x" * 300 + "\nItem 2. Second"), ("d", 3, "plain"), ("e", 1, "plain")]
    df = spark.createDataFrame([(a, b, 0, c) for a, b, c in rows], "doc_id string, page int, chunk_no int, text string")
    out = metadata.add_metadata(df, df.select("doc_id").distinct(), [r"^(item [0-9]+\.[^\n]*)$"]).orderBy("doc_id", "page").collect()
    assert [r.section for r in out] == ["item 1. first", "item 1. first", "item 2. second", ""]
    page = spark.createDataFrame([("Page 3\n** Statement of cash **\n" + "1,000 " * 15,), ("The statement of cash is here\n" + "1,000 " * 15,), ("Statement of cash\n1,000",)], "text string")
    assert [r[0] for r in page.select(metadata.statement_kind(F.col("text"), {"cash": "statements? of cash"})).collect()] == ["cash", None, None]
    q = spark.createDataFrame([("inventories and the Reinvented",), ("invented",)], "q string")
    assert [r[0] for r in q.select(metadata.question_kinds(F.col("q"), {"a": ["invent"], "b": ["the re"]})).collect()] == [["a", "b"], ["a"]]


def test_company_names(spark):
    asked = spark.createDataFrame([(1, "Did Blue Sky Air grow?"), (2, "all of it?"), (3, "Is ALL fine?"), (4, "skyline")], "id long, question string")
    companies = spark.createDataFrame([("Blue Sky",), ("Blue Sky Air",), ("Sky",)], "company string")
    names = spark.createDataFrame([("ALL", "Sky")], "alias string, company string")
    assert {r.id: r.company for r in metadata.match_companies(asked, companies, names).collect()} == {1: "Blue Sky Air", 3: "Sky"}
