"""Scans. None of them infers a schema, so none costs an extra pass over the files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(
    spark: SparkSession, name: str, fmt: str | None = None, **options: str
) -> DataFrame:
    """A table of the session's catalog or, with ``fmt``, of an external connector.

    For a connector the table name is passed as its ``table`` option, next to ``options``.
    """
    if fmt is None:
        return spark.table(name)
    return spark.read.format(fmt).options(table=name, **options).load()


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_delimited(
    spark: SparkSession, path: str | list[str], schema: StructType, sep: str = ",",
    header: bool = False,
) -> DataFrame:
    """Delimited text under a fixed schema. Names in a header line must be those of the schema, in
    its order; Spark raises an error otherwise, instead of taking columns by place."""
    return spark.read.schema(schema).csv(path, sep=sep, header=header, enforceSchema=not header)


def read_csv_parts(spark: SparkSession, glob: str, schema: StructType) -> DataFrame:
    """All CSV parts that match a glob, each with a header line; blank lines are skipped."""
    return read_delimited(spark, glob, schema, header=True)


def read_strings(
    spark: SparkSession, path: str, columns: Sequence[str], numbers: Sequence[str] = ()
) -> DataFrame:
    """Header CSV read as text; ``numbers`` become doubles, NULL where the text is no number.

    Columns are picked by their names in the header, in whatever order the file has them.
    """
    df = spark.read.csv(path, header=True).select(*columns)  # text only, nothing is inferred
    return df.withColumns({c: df[c].try_cast("double") for c in numbers})


def sample_rows(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Bernoulli sample of the rows; the same seed over the same partitions repeats it."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)
