"""Helpers shared by the training-data operators: tables, checkpoints, text rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shelf import shared_folder


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the dataset folder, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables written in each open ``scratch``, innermost last.
_WRITTEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that are materialised inside, but for those that ``outlive`` it, at the end."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for path in _WRITTEN.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, label: str, outlive: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gridframe/{label}-{uuid.uuid4().hex}"
    scopes = _WRITTEN[:-1] if outlive else _WRITTEN
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes a core below which a table is dealt out anew, as its files may have fewer parts than there are cores.
SPREAD_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is small; larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) only, so that extra columns of any name cannot clash; null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_batches(df: DataFrame, rows: Callable[[pa.RecordBatch], dict[str, list]], schema: str, max_bytes: int | None = None) -> DataFrame:
    """``mapInArrow`` with a function from one batch to columns; with ``max_bytes`` from one of its ``slices``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, max_bytes) if max_bytes else [batch] * (batch.num_rows > 0):
                yield pa.RecordBatch.from_pydict(rows(part), schema=arrow)

    return df.mapInArrow(run, schema)


def held_out(id_col: str, modulus: int, remainder: int):
    """True where crc32 of the id as text leaves ``remainder``."""
    return F.crc32(F.col(id_col).cast("string")) % modulus == remainder


def slices(batch: pa.RecordBatch, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a piece holds few bytes of text (a single row may hold more)."""
    per_row = max(1, batch.nbytes // max(1, batch.num_rows))
    step = max(1, max_bytes // per_row)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
