"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet, and the next stage reads that.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import contamination, divergence, line_dedup, packing, simhash
from quillspan.llm.common import drop_exchanges, materialize, release
from quillspan.llm.queries import tokenizer_path

#: SQL can't express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counts or the distances reject go. Each row is judged by itself: null texts fail the counts and
    go, null ids and repeated rows are like any others, an empty table stays one, other columns pass through."""
    return divergence.keep_rows(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to earlier ones go; a document of which nothing is left goes with them. Null and empty texts stay as
    they are; rows with null ids are first in the order, repeated rows are one document and stay both; n_chars, where
    there is such a column, follows the text; other columns pass through, whatever their names."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    back = {of["doc_id"]: "doc_id", of["text"]: "text"}
    out = line_dedup.dedup_lines(docs.toDF(*(back.get(c, c) for c in names)), line_dedup.Settings(least=1))
    kept = out.filter("n_removed = 0 OR trim(text) <> ''")
    if "n_chars" in of:
        kept = kept.withColumn(of["n_chars"], F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*(F.col(back.get(of[c], of[c])).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are linked where their SimHash fingerprints (of three-word shingles, as in op10) differ in two bits or fewer,
    and where their five-word shingles overlap by 0.8 or more. Of each group that these links form, the document with the
    smallest id stays (one without an id only if there is no other), of repeated rows one. Texts without words, null ones
    included, are one group; an empty table stays one, other columns pass through."""
    return simhash.drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Each row is judged by itself: null and empty texts hold none, null ids and
    repeated rows are like any others, an empty table stays one, other columns pass through."""
    return contamination.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens: each row of docs is packed, null texts as the end id alone; an empty table gives no rows."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup_stage), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            release(before)
        else:
            drop_exchanges(spark)
    return docs
