"""Questions in batches, from tags to checked answers: analyse, retrieve, widen once, answer, check.

chunks: chunk_id, doc_id, page, chunk_no, chunk_type, text, company, year, doc_type, section. questions: id, question. Every
step is a DataFrame of all questions; texts join only at the end.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators import answers, evaluation, metadata, retrieval, stages
from quillspan.plans import config as C
from quillspan.plans.shared import settle


@dataclass(frozen=True)
class Variant:
    """Which stages take part."""

    keyword: bool = True
    vector: bool = True
    extractor: bool = True
    tags: bool = True
    router: bool = True
    reranker: bool = True
    gate: bool = True
    statements: bool = True
    verify: bool = True


FULL = Variant()
VARIANTS = {
    "full": replace(FULL, statements=False, verify=False), "verified": replace(FULL, router=False, extractor=False), "dense_only": Variant(False, True, False, False, False, False, False, False, False),
    "no_keyword": replace(FULL, keyword=False), "no_vector": replace(FULL, vector=False), "no_tags": replace(FULL, tags=False), "no_router": replace(FULL, router=False), "no_extractor": replace(FULL, extractor=False), "no_reranker": replace(FULL, reranker=False), "no_gate": replace(FULL, gate=False),
}


@dataclass
class Engine:
    chunks: DataFrame
    settings: Mapping[str, Any] = field(default_factory=lambda: C.load())
    names: DataFrame | None = None
    classifier: stages.Classifier = field(default_factory=stages.KeywordClassifier)
    extractor: stages.Extractor | None = None
    embedder: stages.Embedder = field(default_factory=stages.HashingEmbedder)
    reranker: stages.Reranker = field(default_factory=stages.CoverageReranker)
    generator: stages.Generator = field(default_factory=stages.ExtractiveGenerator)

    def get(self, path: str) -> Any:
        return C.get(self.settings, path)

    def analyze(self, questions: DataFrame, variant: Variant = FULL) -> DataFrame:
        """id, question, tag_company, tag_year, tag_section, tag_intent (structs of value and confidence, or null) and kinds."""
        text = F.col("question")
        companies = self.chunks.filter("company <> ''").select("company").distinct()
        found = metadata.match_companies(questions, companies, self.names).select("id", F.struct(F.col("company").alias("value"), F.lit(1.0).alias("confidence")).alias("tag_company"))
        if variant.extractor and self.extractor is not None:
            spans = self.extractor.entities(questions.select("id", F.col("question").alias("text"))).filter("type = 'company'")
            near = metadata.fuzzy_companies(spans.join(found, "id", "left_anti"), companies)
            found = found.unionByName(near.select("id", F.struct(F.col("company").alias("value"), "confidence").alias("tag_company")))
        years = [r[0] for r in self.chunks.filter("year <> ''").select("year").distinct().collect()]  # as many as there are years
        year = metadata.match_year(text, sorted(years))
        none = F.lit(None).cast("struct<value:string,confidence:double>")

        def best(labels: Mapping) -> Any:
            if not labels or not variant.router:
                return none
            top = F.get(self.classifier.scores(text, list(labels)), F.lit(0))
            return F.struct(top["label"].alias("value"), top["score"].cast("double").alias("confidence"))

        keywords = self.get("statements.keywords") or {}
        kinds = metadata.question_kinds(text, keywords) if keywords else F.array().cast("array<string>")
        out = questions.select("id", "question", F.when(year.isNotNull(), F.struct(year.alias("value"), F.lit(1.0).alias("confidence"))).alias("tag_year"), best(self.get("tags.synonyms")).alias("tag_section"), best(self.get("tags.intents")).alias("tag_intent"), kinds.alias("kinds"))
        out = out.join(found, "id", "left")
        return out if variant.tags else out.withColumns(dict.fromkeys(("tag_company", "tag_year", "tag_section", "tag_intent"), none))

    def _lists(self, tags: DataFrame, variant: Variant, deep: int, side: bool) -> DataFrame:
        """id, chunk_id, list_id and rank of up to four lists: by keywords and by vectors, each over all chunks and over
        the filing that the tags name."""
        least = self.get("tags.confidence")
        meta = self.chunks.select("chunk_id", F.col("company").alias("c"), F.col("year").alias("y"))
        sure = lambda t: F.when(F.col(t)["confidence"] >= least, F.col(t)["value"])
        filing = tags.select("id", sure("tag_company").alias("company"), sure("tag_year").alias("want_year")).filter("company IS NOT NULL")
        out = []

        def add(scores: DataFrame, top: int) -> None:
            w = Window.partitionBy("id").orderBy(F.desc("score"), "chunk_id")
            out.append(scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("id", "chunk_id", F.lit(len(out)).alias("list_id"), "rank"))

        inside = (F.col("company") == F.col("c")) & (F.col("want_year").isNull() | (F.col("want_year") == F.col("y")))
        if variant.keyword:
            scores = settle(retrieval.bm25_scores(self.chunks, tags.select(F.col("id").alias("item_id"), F.col("question").alias("text")), "chunk_id").withColumnRenamed("item_id", "id"))
            add(scores, self.get("search.keyword") * deep)
            if side:
                add(scores.join(filing, "id").join(meta, "chunk_id").filter(inside).select("id", "chunk_id", "score"), self.get("search.keyword") * deep)
        if variant.vector:
            vectors = settle(self.embedder.embed(self.chunks.select(F.col("chunk_id").alias("id"), "text")).withColumnRenamed("id", "vec_id"))
            asked = self.embedder.embed(tags.select("id", F.col("question").alias("text")), query=True)
            top = self.get("search.vector") * deep
            found = retrieval.dense(vectors, asked.withColumnRenamed("id", "query_id"), top, kind=self.chunks.schema["chunk_id"].dataType.simpleString())
            out.append(found.select(F.col("query_id").alias("id"), F.col("vec_id").alias("chunk_id"), F.lit(len(out)).alias("list_id"), "rank"))
            if side:
                # The filing's own chunks meet the question by the company, so no other vector is looked at.
                own = filing.join(meta, F.col("company") == F.col("c")).filter(inside).select("id", "chunk_id")
                near = own.join(vectors.withColumnRenamed("vec_id", "chunk_id"), "chunk_id").join(asked.withColumnRenamed("embedding", "q"), "id")
                add(near.select("id", "chunk_id", F.round(retrieval.dot("q", "embedding"), 6).alias("score")), top)
        lists = out[0]
        for part in out[1:]:
            lists = lists.unionByName(part)
        return lists

    def retrieve(self, tags: DataFrame, variant: Variant = FULL, deep: int = 1) -> DataFrame:
        """id, chunk_id, rank, prob, slot (whether it is a reserved statement page), evidence and verdict. deep > 1 is the
        second, wider search: without tags, boosts and slots."""
        side = variant.tags and deep == 1
        lists = self._lists(tags, variant, deep, side)
        fused = retrieval.rrf(lists, "id", "chunk_id", self.get("search.rrf"), top=self.get("search.fused") * deep).select("id", "chunk_id", F.col("rank").alias("prior"))
        fused, extras = settle(fused), None
        if variant.statements and deep == 1 and self.get("statements.titles"):
            pages = metadata.statement_pages(self.chunks, self.get("statements.titles"), self.get("statements.numbers"))
            wanted = tags.select("id", F.col("tag_company")["value"].alias("company"), F.col("tag_year")["value"].alias("year"), "kinds")
            extras = settle(metadata.statement_lookup(wanted, pages, self.get("statements.slots")))
            # Pages that are no candidates yet come after all of them.
            fused = fused.unionByName(extras.join(fused, ["id", "chunk_id"], "left_anti").select("id", "chunk_id", (F.col("pos") + (1 << 20)).alias("prior")))
        # Terms are made before the joins: once for each question and chunk, not for each pair.
        asked = tags.drop("kinds").withColumn("question_terms", stages.own_terms(F.col("question")))
        pairs = fused.join(asked, "id").join(self.chunks.select("chunk_id", "text", "chunk_type", "company", "year", "section", stages.own_terms(F.col("text")).alias("text_terms")), "chunk_id")
        scored = self.reranker.score(pairs)
        boost = metadata.boost_factor(metadata.tag_matches(self.get("tags.confidence"), self.get("tags.synonyms"), self.get("tags.intents")), self.get("tags.boost")) if side else F.lit(1.0)
        base = F.col("prob") if variant.reranker else F.lit(1.0) / F.col("prior")
        scored = settle(scored.select("id", "chunk_id", "prob", "prior", F.round(base * boost, 9).alias("boosted")))
        w = Window.partitionBy("id").orderBy(F.desc("boosted"), "prior", "chunk_id")
        ordered = scored.withColumn("rank", F.row_number().over(w))
        evidence = scored.groupBy("id").agg(F.max("prob").alias("evidence"))
        top = self.get("search.top")
        if extras is None:
            final = ordered.filter(F.col("rank") <= top).select("id", "chunk_id", "rank", F.lit(False).alias("slot"))
        else:
            slots = retrieval.reserve_slots(ordered.select("id", "chunk_id", "rank"), extras, "id", "chunk_id", self.get("statements.keep"), top)
            final = slots.join(extras.select("id", "chunk_id", F.lit(True).alias("slot_")), ["id", "chunk_id"], "left").select("id", "chunk_id", F.col("slot").alias("rank"), F.coalesce("slot_", F.lit(False)).alias("slot"))
        out = final.join(scored.select("id", "chunk_id", "prob"), ["id", "chunk_id"])
        gate = stages.ThresholdGate(self.get("gate.sufficient"), self.get("gate.partial"), self.get("gate.mode"))
        verdict = gate.verdict(gate.evidence(F.col("evidence"))) if variant.gate else F.lit(None).cast("string")
        return out.join(evidence, "id").withColumn("verdict", verdict)

    def search(self, tags: DataFrame, variant: Variant = FULL) -> DataFrame:
        """retrieve, and for questions whose evidence does not suffice once more and wider; widened tells which."""
        first = settle(self.retrieve(tags, variant))
        if not variant.gate:
            return first.withColumn("widened", F.lit(False))
        found = tags.select("id").join(first.select("id", "verdict").distinct(), "id", "left")
        poor = found.filter("verdict IS NULL OR verdict <> 'sufficient'").select("id")
        again = self.retrieve(tags.join(poor, "id", "left_semi"), variant, self.get("search.widen"))
        return first.join(poor, "id", "left_anti").withColumn("widened", F.lit(False)).unionByName(again.withColumn("widened", F.lit(True)))

    def ask(self, questions: DataFrame, variant: Variant = FULL) -> DataFrame:
        """id, text, refused, verdict, evidence, widened, citations, invalid_pages, reasons and chunk_ids. Questions whose
        evidence does not suffice are refused before anything is generated; answers that fail the check are refused too."""
        tags = settle(self.analyze(questions, variant))
        hits = settle(self.search(tags, variant))
        full = hits.join(self.chunks.select("chunk_id", "doc_id", "page", "text"), "chunk_id")
        parts = F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "doc_id", "page", "text")))
        per = full.groupBy("id").agg(parts.alias("p"), F.first("verdict").alias("verdict"), F.first("evidence").alias("evidence"), F.first("widened").alias("widened"))
        asked = questions.join(per, "id", "left").withColumn("passages", F.coalesce("p", F.array().cast(per.schema["p"].dataType)))
        blocked = F.coalesce(F.col("verdict") != "sufficient", F.lit(variant.gate)) if variant.gate else F.lit(False)
        asked = asked.withColumn("blocked", blocked)
        said = self.generator.generate(asked.filter("NOT blocked")).select("id", "question", "passages", "verdict", "evidence", "widened", "answer", "refused")
        stop = asked.filter("blocked").select("id", "question", "passages", "verdict", "evidence", "widened", F.lit("NOT FOUND").alias("answer"), F.lit(True).alias("refused"))
        rows = settle(said.unionByName(stop))
        covered = rows.select("id", F.explode("passages").alias("x")).select("id", "x.doc_id", F.col("x.page").alias("page_start"), F.col("x.page").alias("page_end"))
        if variant.verify:
            ready = rows.select("id", "answer", F.transform("passages", lambda x: x["text"]).alias("passages"), "question", F.lit(False).alias("truncated"), "refused")
            checked = answers.check_answers(ready, covered, self.get("answer.hedges") or None)
        else:
            plain = rows.select("id", F.col("answer").alias("text"), "refused", F.lit(False).alias("checked"), F.array().cast("array<string>").alias("reasons"), F.lit(None).cast("string").alias("original"))
            checked = plain.join(answers.check_citations(plain, covered), "id")
        return checked.join(rows.select("id", "verdict", "evidence", "widened", F.transform("passages", lambda x: x["chunk_id"]).alias("chunk_ids")), "id")

    def info(self, questions: DataFrame, n: int = 50) -> DataFrame:
        """One row: documents, chunks, the companies by name, and up to n of the questions, picked by a seeded hash."""
        picked = evaluation.sample(questions, n).agg(F.array_sort(F.collect_list("id")).alias("examples"))
        counts = self.chunks.agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.array_sort(F.collect_set(F.nullif("company", F.lit("")))).alias("companies"))
        return counts.select("*", picked.scalar().alias("examples"))

    def baseline(self, questions: DataFrame, most: int = 600) -> DataFrame:
        """Answers from the beginning of the right document alone (id, question, doc_id), up to so many tokens."""
        own = stages.context_budget(self.chunks.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "chunk_no")).alias("chunk_no"), "page", "text"), most)
        parts = own.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "text", "page"))), lambda x: F.struct(x["text"].alias("text"), x["page"].alias("page"))).alias("passages"))
        return self.generator.generate(questions.join(parts, "doc_id")).select("id", "answer", "refused")


def chunk_view(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """Chunks as they are shown: their metadata, the score of a search, and whether they took a reserved slot."""
    seen = hits.select("chunk_id", F.col("prob").alias("score"), "slot").dropDuplicates(["chunk_id"])
    return chunks.join(seen, "chunk_id", "left").select("chunk_id", "doc_id", "page", "chunk_type", "company", "year", "section", "score", F.coalesce("slot", F.lit(False)).alias("statement_slot"), "text")
