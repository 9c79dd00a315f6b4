"""What several training-data operators need: shared tables, size-checked joins, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a join side up to which it may be broadcast, at up to 64 bytes a row. Larger sides are shuffled.
BROADCAST_ROWS = 200_000
#: White space of the contracts: space and the five ASCII controls 9 to 13.
WHITE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where the session names none, an own one, in local mode (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/kinetrace"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_shuffled(side: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a join side for broadcast if its row count is within the bound; beyond it a shuffled (and AQE-split) join."""
    rows = side.count() if rows is None else rows
    return F.broadcast(side) if rows <= most else side.hint("merge")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column, null as empty, whatever its type."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def ids_and_texts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only (doc_id, text): extra columns of any name cannot clash with those an operator adds."""
    return df.select(df[id_column].cast("long").alias("doc_id"), text_of(df, text_column).alias("text"))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)


def slices(rb: pa.RecordBatch, chars: int = 8 << 20, column: str = "text"):
    """Parts of a record batch with about so many text bytes each, so that a task's memory is bounded by its largest text."""
    col = rb.column(rb.schema.get_field_index(column))
    start, size = 0, 0
    for i, n in enumerate(pa.compute.binary_length(col).fill_null(0).to_pylist()):
        if size and size + n > chars:
            yield rb.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < rb.num_rows:
        yield rb.slice(start)
