"""Helpers shared by the training-data operators: tables in shared storage and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from citeloom.session import scratch_dir

ASCII_SPACE = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once as a table below the shared checkpoint folder and read it back.

    Later steps neither compute it again nor lose it with an executor.
    """
    path = scratch_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str) -> DataFrame:
    """Apply ``step`` to each Arrow batch on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def utf8_values(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes the empty string."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, so that few whole texts are held as Python objects."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)
