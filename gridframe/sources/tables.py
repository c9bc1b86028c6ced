"""Arrays from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def length(df: DataFrame, column: str) -> int:
    """One more than the largest index of a dense axis (from column statistics where Spark has them)."""
    return int(df.agg(F.coalesce(F.max(column), F.lit(-1))).first()[0]) + 1


def signal(spark: SparkSession, sf_dir: str) -> Grid:
    """Event values as a 1-d array of whole cents, in event order."""
    events = table(spark, sf_dir, "events")
    return Grid.from_df(events, ["event_id"], F.round(F.col("value") * 100), (length(events, "event_id"),), "int64")


def vectors(spark: SparkSession, sf_dir: str, dtype: str = "float64") -> Grid:
    """Embeddings as a matrix."""
    embeddings = table(spark, sf_dir, "embeddings")
    width = embeddings.select(F.size("embedding")).first()[0]
    rows = embeddings.select("vec_id", F.posexplode("embedding").alias("place", "x"))
    return Grid.from_df(rows, ["vec_id", "place"], "x", (length(embeddings, "vec_id"), width), dtype)


def complex_vectors(spark: SparkSession, sf_dir: str, dtype: str = "complex128") -> Grid:
    """Embeddings as a complex matrix with imaginary part zero."""
    grid = vectors(spark, sf_dir)
    return grid.with_value(F.struct(F.col("v").alias("re"), F.lit(0.0).alias("im")), dtype)
