"""User functions over rows, batches, and models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructType


def map_rows(df: DataFrame, function: Callable[[dict], dict], schema: StructType | str) -> DataFrame:
    """Apply a Python function to each row, a dict in and a dict out. Use column expressions
    instead where they can say it."""
    shape = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([function(row) for row in batch.to_pylist()], schema=arrow)

    return df.mapInArrow(run, shape)


def map_batches(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
    """Apply a vectorised function to each Arrow batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)


def predict_batches(df: DataFrame, make_predictor: Callable[[], Callable[[np.ndarray], np.ndarray]],
                    inputs: list[str | Column], output: str, kind: DataType, batch_size: int = 1024) -> DataFrame:
    """Add a model's prediction. The model is loaded once per Python worker."""
    return df.withColumn(output, predict_batch_udf(make_predictor, return_type=kind, batch_size=batch_size)(
        *[F.col(i) if isinstance(i, str) else i for i in inputs]))


def inspect(df: DataFrame) -> DataFrame:
    """Rows, partitions, rows of the largest partition, columns and schema of a table."""
    sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("partitions"),
                     F.max("n").alias("largest_partition")).select(
        "*", F.lit(len(df.columns)).cast("long").alias("columns"), F.lit(df.schema.simpleString()).alias("schema"))
