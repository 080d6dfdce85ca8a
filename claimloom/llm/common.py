"""Shared helpers: written intermediates, Arrow row streams, ASCII words."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from claimloom.sources.shared import dropped, shared_dir, written  # noqa: F401  for the operators here

#: Bytes of text handed to a Python worker at once; bounds its memory whatever the row sizes are.
ARROW_BYTES = "4m"


def arrow_limits(spark: SparkSession) -> None:
    """Holds Arrow batches to ARROW_BYTES unless the session says otherwise.

    Spark reads the setting when a plan runs, which may be after this call has returned, so it stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, ARROW_BYTES)


def _typed(x, kind: pa.DataType) -> pa.Array:
    if not isinstance(x, pa.Array):
        return pa.array(x, type=kind)
    return x if x.type == kind else x.cast(kind)


def map_rows(df: DataFrame, schema: T.StructType, make) -> DataFrame:
    """Rows of `df` through Python, in Arrow batches.

    `make()` runs once in each task and returns a function from a dict of columns (lists) to a dict
    of columns; state that it holds (caches) lives as long as the task.
    """
    arrow_limits(df.sparkSession)
    names = [f.name for f in schema.fields]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        step = make()
        for b in batches:
            if b.num_rows:
                out = step({n: b.column(i) for i, n in enumerate(b.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [_typed(out[n], kinds.field(n).type) for n in names],
                    schema=kinds,
                )

    return df.mapInArrow(run, schema)


def fields(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so that other columns, whatever their names, cannot clash."""
    from pyspark.sql import functions as F

    return df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
