"""What the operators of this subpackage share: tables in the shared folder and small text helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of the contracts: words are what lies between these.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only in local mode, where there is one machine, and only
    where that is unset, it is a temporary folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="quillspan-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        folder = f"file://{own}"
    return folder.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote and nothing will read again, and let Spark drop the exchanges behind them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    drop_exchanges(tables[0].sparkSession)


def drop_exchanges(spark: SparkSession) -> None:
    """Files of exchanges go when the driver's garbage collector finds their plans unused; this has it look now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_hash(column: str) -> Column:
    """crc32 of an id as text; that of the empty text where the id is null."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def map_arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """mapInArrow where f takes and returns dicts of lists or arrays, one for each batch."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in f(batches):
            arrays = [pa.array(columns[x.name], type=x.type) for x in out]
            yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def sliced(batches: Iterable[pa.RecordBatch], step: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, step of them at a time, so that a worker holds few texts beside the batch. At the end, what
    the task has no use for goes back: workers go on living and serve later tasks."""
    for whole in batches:
        for first in range(0, whole.num_rows, step):
            yield whole.slice(first, step)
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system, from Arrow's pool and, where the C library can do that, from its heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def filter_rows(docs: DataFrame, keep, columns: tuple[str, ...], step: int = 256) -> DataFrame:
    """The rows of docs for which keep says so, row by row and without any exchange. keep takes lists of the columns of step
    rows and returns booleans; whatever other columns there are pass through."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [f"c{k}" for k in range(len(docs.columns))]
    at = [docs.columns.index(c) for c in columns]
    plain = docs.toDF(*names)
    schema = to_arrow_schema(plain.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, step):
            mask = pa.array(keep(*(b.column(k).to_pylist() for k in at)), pa.bool_())
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(b.filter(mask).columns, schema, strict=True)], schema=schema)

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
