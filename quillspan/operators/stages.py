"""Interfaces of the stages that models fill elsewhere, and a stand-in for each that needs no model.

The stand-ins follow rules, not weights: their scores are not those of a model. Each takes and returns DataFrames or columns.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import terms, units, words
from quillspan.operators import retrieval
from quillspan.operators.answers import cited_pages


class Classifier(ABC):
    @abstractmethod
    def scores(self, text: Column, labels: Sequence[str], many: bool = False) -> Column:
        """array<struct<label, score>>, best first; scores sum to 1 unless many labels may hold."""


class Extractor(ABC):
    @abstractmethod
    def entities(self, texts: DataFrame) -> DataFrame:
        """id, span, type and score of texts (id, text)."""


class Embedder(ABC):
    @abstractmethod
    def embed(self, texts: DataFrame, query: bool = False) -> DataFrame:
        """id and embedding (of length 1) of texts (id, text)."""


class Retriever(ABC):
    @abstractmethod
    def retrieve(self, chunks: DataFrame, questions: DataFrame, top: int, where: Column | None = None) -> DataFrame:
        """item_id, doc_id, score and rank."""


class Reranker(ABC):
    @abstractmethod
    def score(self, pairs: DataFrame) -> DataFrame:
        """pairs (question and text among the columns) with prob, from 0 to 1."""

    def rerank(self, pairs: DataFrame, question: str, top: int) -> DataFrame:
        """The top of each question by prob; earlier ranks win ties."""
        w = Window.partitionBy(question).orderBy(F.desc("prob"), "rank")
        return self.score(pairs).withColumn("new_rank", F.row_number().over(w)).filter(F.col("new_rank") <= top)


class Gate(ABC):
    @abstractmethod
    def verdict(self, evidence: Column) -> Column:
        """sufficient, partial or insufficient."""


class Generator(ABC):
    @abstractmethod
    def generate(self, asked: DataFrame) -> DataFrame:
        """asked (id, question, passages: array of text and page) with answer and refused."""


def own_terms(text: Column) -> Column:
    """The different terms of a text."""
    return F.array_distinct(terms(text))


def sigmoid(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


class KeywordClassifier(Classifier):
    """The share of a label's words (or of the keywords given for it) that the text holds."""

    def __init__(self, keywords: Mapping[str, Sequence[str]] | None = None):
        self.keywords = dict(keywords or {})

    def scores(self, text: Column, labels: Sequence[str], many: bool = False) -> Column:
        own = F.array_distinct(terms(text))

        def share(label: str) -> Column:
            wanted = self.keywords.get(label) or label.lower().split()
            return F.size(F.array_intersect(own, F.array(*map(F.lit, wanted)))) / len(set(wanted))

        raw = {x: share(x) for x in labels}
        total = sum(raw.values(), F.lit(0.0))
        score = lambda x: raw[x] if many else F.when(total > 0, raw[x] / total).otherwise(1 / len(labels))
        rows = F.array(*(F.struct((-score(x)).alias("s"), F.lit(k).alias("k"), F.lit(x).alias("label")) for k, x in enumerate(labels)))
        return F.transform(F.array_sort(rows), lambda r: F.struct(r["label"].alias("label"), (-r["s"]).alias("score")))

    def tag(self, chunks: DataFrame, labels: Mapping[str, str]) -> DataFrame:
        """chunks with chunk_type and type_score: types that are there stay, others get the kind of the best label."""
        best = F.get(self.scores(F.col("text"), list(labels)), F.lit(0))
        kind = F.element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), best["label"])
        return chunks.withColumns({"type_score": F.when(F.col("chunk_type").isNull(), F.round(best["score"], 4)), "chunk_type": F.coalesce("chunk_type", kind)})


class VocabularyExtractor(Extractor):
    """Runs of up to words words of a text that are in the vocabulary (span, type), each with score 1."""

    def __init__(self, vocabulary: DataFrame, words: int = 4):
        self.vocabulary, self.words = vocabulary, words

    def entities(self, texts: DataFrame) -> DataFrame:
        own = texts.select("id", F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)).alias("w"))
        runs = F.flatten(F.array(*(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), self._run(n)) for n in range(1, self.words + 1))))
        spans = own.select("id", F.explode(F.array_distinct(runs)).alias("span")).withColumn("key", F.lower("span"))
        known = self.vocabulary.select(F.lower("span").alias("key"), "type").distinct()
        return spans.join(known, "key").select("id", "span", "type", F.lit(1.0).alias("score"))

    @staticmethod
    def _run(n: int):
        return lambda i: F.array_join(F.slice("w", i, n), " ")


class HashingEmbedder(Embedder):
    """Counts of terms in hashed places with a hashed sign, of length 1. A query's instruction has no effect here."""

    def __init__(self, dimensions: int = 64, instruction: str = ""):
        self.dimensions, self.instruction = dimensions, instruction

    def embed(self, texts: DataFrame, query: bool = False) -> DataFrame:
        d = self.dimensions
        h = texts.select("id", F.transform(terms(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
        zero = F.array_repeat(F.lit(0.0), d)
        place = lambda x: F.pmod(x, F.lit(d)).cast("int")
        sign = lambda x: F.when(F.shiftright(x, 32) % 2 == 0, 1.0).otherwise(-1.0)
        counts = F.aggregate("h", zero, lambda acc, x: F.transform(acc, lambda v, k: F.when(k == place(x), v + sign(x)).otherwise(v)))
        raw = h.select("id", counts.alias("v"))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        return raw.withColumn("n", norm).select("id", F.when(F.col("n") > 0, F.transform("v", lambda x: x / F.col("n"))).otherwise(F.col("v")).alias("embedding"))


class KeywordRetriever(Retriever):
    def retrieve(self, chunks: DataFrame, questions: DataFrame, top: int, where: Column | None = None) -> DataFrame:
        return retrieval.bm25(chunks, questions, top, where=where)


class VectorRetriever(Retriever):
    """By vectors of an embedder; the filter is applied before distances are worked out."""

    def __init__(self, embedder: Embedder | None = None):
        self.embedder = embedder or HashingEmbedder()

    def retrieve(self, chunks: DataFrame, questions: DataFrame, top: int, where: Column | None = None) -> DataFrame:
        kept = chunks if where is None else chunks.filter(where)
        vectors = self.embedder.embed(kept.select(F.col("doc_id").alias("id"), "text")).select(F.col("id").alias("vec_id"), "embedding")
        asked = self.embedder.embed(questions.select(F.col("item_id").alias("id"), "text"), query=True).select(F.col("id").alias("query_id"), "embedding")
        return retrieval.dense(vectors, asked, top).select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), "score", "rank")


class CoverageReranker(Reranker):
    """The share of the question's terms that the text holds. Terms are dear to make: where pairs have them already
    (question_terms, text_terms; made once for each question and text), those are taken."""

    def score(self, pairs: DataFrame) -> DataFrame:
        asked, own = (F.col(f"{c}_terms") if f"{c}_terms" in pairs.columns else own_terms(F.col(c)) for c in ("question", "text"))
        share = F.size(F.array_intersect(asked, own)) / F.nullif(F.size(asked), F.lit(0))
        return pairs.withColumn("prob", F.round(F.coalesce(share, F.lit(0.0)), 6))


class ClassifierReranker(Reranker):
    """A classifier's score for the label that the passage answers the question: its words are the label's keywords."""

    def score(self, pairs: DataFrame) -> DataFrame:
        joined = F.concat_ws(" ", F.array_intersect(F.array_distinct(terms(F.col("question"))), F.array_distinct(terms(F.col("text")))))
        return pairs.withColumn("prob", F.round(sigmoid(F.size(words(joined)) - F.lit(2.0)), 6))


class ThresholdGate(Gate):
    """mode rerank: the best probability; entail: a classifier's; both: the mean of the two."""

    def __init__(self, sufficient: float, partial: float, mode: str = "rerank"):
        if mode not in ("rerank", "entail", "both"):
            raise ValueError("mode must be rerank, entail or both")
        self.sufficient, self.partial, self.mode = sufficient, partial, mode

    def evidence(self, rerank: Column, entail: Column | None = None) -> Column:
        r, e = F.coalesce(rerank, F.lit(0.0)), F.lit(0.0) if entail is None else F.coalesce(entail, F.lit(0.0))
        return {"rerank": r, "entail": e, "both": (r + e) / 2}[self.mode]

    def verdict(self, evidence: Column) -> Column:
        return retrieval.verdict(evidence, self.sufficient, self.partial)


class ExtractiveGenerator(Generator):
    """The sentence of the passages with most of the question's terms, with its page; NOT FOUND if none has any."""

    def generate(self, asked: DataFrame) -> DataFrame:
        wanted = F.array_distinct(terms(F.col("question")))

        def rated(p: Column) -> Column:
            return F.transform(units(p["text"]), lambda u: F.struct((-F.size(F.array_intersect(wanted, F.array_distinct(terms(u))))).alias("hits"), p["page"].alias("page"), u.alias("unit")))

        best = F.array_min(F.flatten(F.transform("passages", rated)))
        found = F.coalesce(best["hits"] < 0, F.lit(False))
        answer = F.when(found, F.concat(best["unit"], F.lit(" [p. "), best["page"].cast("string"), F.lit("]"))).otherwise("NOT FOUND")
        return asked.withColumn("answer", answer).withColumn("refused", ~found)


def format_passages(chunks: DataFrame) -> DataFrame:
    """id and passages, one text: [n] company year type, page p, then the passage, in the order of rank."""
    label = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.concat_ws(" ", F.nullif("company", F.lit("")), F.nullif("year", F.lit("")), F.nullif("doc_type", F.lit(""))), F.lit(", page "), F.col("page").cast("string"), F.lit("\n"), F.col("text"))
    return chunks.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", label.alias("t")))).alias("p")).select("id", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("passages"))


def context_budget(chunks: DataFrame, most: int) -> DataFrame:
    """chunks (doc_id, chunk_no, text) of each document up to the first that goes over a budget of tokens, with used."""
    w = Window.partitionBy("doc_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("used", F.sum(F.size(words(F.col("text")))).over(w)).filter(F.col("used") <= most)


__all__ = [n for n in dir() if n[0].isupper()] + ["cited_pages", "context_budget", "format_passages", "sigmoid"]
