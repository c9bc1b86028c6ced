"""Results that several consumers of a plan share.

Spark computes a plan anew for each action and each branch that reads it. While a ``Shelf``
is open, a result that is known to have several consumers is written once to the folder that
driver and executors share, and read from there; the shelf owns these tables and deletes them
when it closes. What is to live longer has to be written or collected before.
"""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..grid import Grid

_OPEN: ContextVar[tuple[Shelf, ...]] = ContextVar("open_shelves", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only on a local master without it."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gridframe-"))
    return context.getCheckpointDir().rstrip("/")


class Shelf:
    """Tables of shared results for the life of a plan: ``with Shelf(spark) as shelf: ...``.

    ``keep`` puts an array or a table on it, and computations that read a result of theirs more than
    once put it on the innermost open shelf. A closed shelf is empty and can be opened again.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._paths: list[str] = []

    def __enter__(self) -> Shelf:
        _OPEN.set((*_OPEN.get(), self))
        return self

    def __exit__(self, *error: object) -> None:
        _OPEN.set(tuple(s for s in _OPEN.get() if s is not self))
        while self._paths:
            path = self._spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop())
            path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, result: Grid | DataFrame) -> Grid | DataFrame:
        """The same values, computed now and read from a table from now on."""
        if self not in _OPEN.get():
            raise ValueError("the shelf is not open")
        if isinstance(result, Grid):
            return Grid(self.keep(result.df), result.meta)
        path = f"{shared_folder(self._spark)}/gridframe/shared-{uuid.uuid4().hex}"
        self._paths.append(path)
        result.write.parquet(path)
        return self._spark.read.schema(result.schema).parquet(path)


def shared(df: DataFrame) -> DataFrame:
    """``df`` on the innermost open shelf; as it is where none is open."""
    shelves = _OPEN.get()
    return shelves[-1].keep(df) if shelves else df
