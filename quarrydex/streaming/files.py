"""Parquet tables as streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def stream_table(spark: SparkSession, sf_dir: str, name: str, schema: StructType | str, max_files: int | None = None) -> DataFrame:
    """``name`` in ``sf_dir`` as a stream; columns of ``schema`` are read by name.

    A table may be one file or a folder of files; new files of a folder are picked up by
    later micro-batches. ``max_files`` limits the files of one micro-batch.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # As a pattern (of one path) a single file is accepted too.
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")
