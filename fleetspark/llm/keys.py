"""A key for rows that may repeat: equal rows have equal keys, whenever and wherever they are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def row_key() -> Column:
    """MD5 of doc_id and text; null ids and texts have their own sign."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"),
                          F.coalesce(F.concat(F.lit("t"), F.col("text").cast("string")), F.lit("null"))))


def packed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``), doc_id and text: whatever other columns are called, none is in the way."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def mapped(rows: DataFrame, run, names: list[str], shape: StructType) -> DataFrame:
    """``rows`` through ``run``, which takes and gives Arrow batches: ``names``, of the types in ``shape``. Names of columns go
    around Spark's own call, which does not take all of them."""
    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(shape.fields)])
    return rows.toDF(*(f"c{i}" for i in range(len(rows.columns)))).mapInArrow(
        lambda batches: (b.rename_columns(plain.names) for b in run(batches)), plain).toDF(*names)


def chunks(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Rows of ``texts``, first and end, that have about ``size`` bytes together or are one row."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = done = 0
    while first < len(ends):
        end = max(first + 1, int(np.searchsorted(ends, done + size, "right")))
        yield first, end
        first, done = end, int(ends[end - 1])
