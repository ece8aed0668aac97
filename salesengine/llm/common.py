"""Helpers the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder all executors share, named by spark.checkpoint.dir.

    Where it is unset (a session on one machine, as in tests) the session gets
    one; a cluster without it is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a written table: cuts the lineage and outlives executors."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """The name, or one near it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


#: What goes to a Python worker at once, so that long texts stay within memory.
BATCH_BYTES = "8m"


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same DataFrame, whose session now gives Python workers small batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def light_slices(
    batches: Iterator[pa.RecordBatch], column: str, rows: int, most: int
) -> Iterator[pa.RecordBatch]:
    """Slices of ``rows`` rows at most that hold about ``most`` bytes of a column, or one longer value."""
    for batch in slices(batches, rows):
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def text_batches(
    batches: Iterator[pa.RecordBatch], column: str, rows: int = 512
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Small slices of the batches with the texts of one column; null texts are empty."""
    for part in slices(batches, rows):
        yield part, [t or "" for t in part.column(column).to_pylist()]
