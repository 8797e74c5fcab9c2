"""Files that come and go: documents by suffix, chunks, run records and splits as JSON lines, metadata, vectors.

Folders of Parquet are the engine's own form; JSON lines are for exchange with other tools.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import clean
from quillspan.operators.evaluation import check_split
from quillspan.sources.html import html_pages

PAGES = "doc_id string, page int, text string"
CHUNK = "chunk_id string, doc_id string, text string, page_start int, page_end int, chunk_type string, type_score double, metadata map<string,string>, score double"
REF = "struct<id:string,doc_id:string,page:int>"
RECORD = f"id string, grp string, question string, gold string, prediction string, refused boolean, confidence double, verdict string, evidence array<struct<doc_id:string,page:int>>, chunks array<{REF}>, candidates array<{REF}>, citations array<struct<doc_id:string,page:int>>, timings map<string,double>, correct boolean, method string"


def pdf_pages(raw: bytes) -> list[str]:
    """The text of each page, by whichever PDF library is installed; an error where none is."""
    try:
        import pypdfium2
    except ImportError:
        try:
            import fitz
        except ImportError:
            raise RuntimeError("reading PDF needs pypdfium2 or PyMuPDF") from None
        with fitz.open(stream=raw, filetype="pdf") as doc:
            return [page.get_text() for page in doc]
    doc = pypdfium2.PdfDocument(raw)
    return [page.get_textpage().get_text_range() for page in doc]


def pdf_tables(raw: bytes) -> list[tuple[int, int, list[list[str | None]]]]:
    """(page, number of the table, rows) of each table, where pdfplumber is installed."""
    try:
        import pdfplumber
    except ImportError:
        raise RuntimeError("reading tables of PDF needs pdfplumber") from None
    import io

    with pdfplumber.open(io.BytesIO(raw)) as doc:
        return [(n, k, rows) for n, page in enumerate(doc.pages, 1) for k, rows in enumerate(page.extract_tables())]


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (the name without its suffix), page and cleaned text of the .html, .htm, .txt and .pdf files in a folder. HTML is
    read as UTF-8, whatever cannot be decoded is left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    files = files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), suffix.alias("suffix"), "content").filter(F.col("suffix").isin("html", "htm", "txt", "pdf"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                if r.suffix == "pdf":
                    pages = pdf_pages(bytes(r.content))
                else:
                    text = bytes(r.content).decode("utf-8", "ignore")
                    pages = html_pages(text) if r.suffix.startswith("htm") else text.split("\f")
                rows += [(r.doc_id, k, t) for k, t in enumerate(pages, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text"])

    return files.mapInPandas(run, PAGES).withColumn("text", clean(F.col("text")))


def read_tables(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, page, table_no and rows of the tables in the PDF files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.path.rsplit("/", 1)[-1][:-4], *x) for r in b.itertuples() for x in pdf_tables(bytes(r.content))]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "table_no", "rows"])

    return files.select("path", "content").mapInPandas(run, "doc_id string, page int, table_no int, rows array<array<string>>")


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON lines; an error where a chunk ends before it begins or begins before page 1."""
    rows = spark.read.schema(CHUNK).json(path)
    good = (F.col("page_start") >= 1) & (F.col("page_end") >= F.col("page_start"))
    return rows.withColumn("page_start", F.when(good, F.col("page_start")).otherwise(F.raise_error(F.concat(F.lit("bad pages of chunk "), F.coalesce("chunk_id", F.lit("?")))).cast("int")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def not_done(items: DataFrame, done: DataFrame | None, key: str = "id") -> DataFrame:
    """The items that no finished record is there for: a run that was stopped goes on with these."""
    return items if done is None else items.join(done.select(key).distinct(), key, "left_anti")


def evaluate_new(items: DataFrame, path: str, answer) -> int:
    """Answer the items that the records at path lack, append their records, and say how many those were. answer takes and
    returns a DataFrame; a run that was stopped is taken up where it was."""
    spark = items.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    done = read_records(spark, path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None
    todo = not_done(items, done).persist()
    n = todo.count()
    if n:
        write_lines(answer(todo), path, append=True)
    todo.unpersist()
    return n


def save_split(split: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write id, grp and split; an existing split is only replaced if that is asked for."""
    check_split(split).write.mode("overwrite" if overwrite else "errorifexists").json(path)


def load_split(spark: SparkSession, path: str) -> DataFrame:
    return check_split(spark.read.schema("id string, grp string, split string").json(path))


def rows_of(items: DataFrame, split: DataFrame, part: str) -> DataFrame:
    """The items whose id is in a part of the split; all for part all."""
    return items if part == "all" else items.join(split.filter(F.col("split") == part).select("id"), "id", "left_semi")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, company, year, doc_type and aliases of a JSON object of documents."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<company:string,year:string,doc_type:string,aliases:array<string>>>").alias("m"))
    return whole.select(F.explode("m").alias("doc_id", "x")).select("doc_id", "x.*")


def write_report(path: str, report: dict) -> None:
    """A report as JSON, with what it was measured on."""
    import os
    import platform

    import pyspark

    with open(path, "w", encoding="utf-8") as f:
        json.dump(report | {"environment": {"python": platform.python_version(), "spark": pyspark.__version__, "cpus": os.cpu_count(), "system": platform.platform()}}, f, indent=1)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """A store of vectors (chunk_id, embedding, and columns to filter by), added to as chunks come."""
    vectors.write.mode("append").parquet(path)
