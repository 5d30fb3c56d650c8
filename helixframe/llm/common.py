"""What the text operators share: reading tables, Arrow functions, checkpoints.

Conventions of every operator in this package
---------------------------------------------
* Operators take DataFrames and column names; other columns are never looked at, so extra columns
  and clashing names are harmless.  Columns that an operator adds for itself beside others get names that are free.
* A null text is an empty text unless the operator says otherwise.
* Two rows that repeat a document id are two documents that happen to carry the same id.
"""

from __future__ import annotations

import ctypes
import functools
import uuid
from typing import get_type_hints

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shared
from ..functions.shared import checkpoint_dir

#: Rows, and bytes of them, that go to a Python worker at once; texts may be long, so this is far below Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def session_of(df: DataFrame) -> SparkSession:
    """The session of df, set up for batches of long texts and with a checkpoint folder."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return checkpoint_dir(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """df, written once to the checkpoint folder: later reads survive the loss of executors."""
    session_of(df)
    return shared.saved(df)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in the shared folder, which later steps read by column."""
    spark = session_of(df)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many _ behind it as it takes to be no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(operator):
    """For operators that return docs with all their columns: columns of the caller's that begin as the operator's own do (__)
    bear other names meanwhile."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *arguments, **options):
        odd = [c for c in docs.columns if c.startswith("__")]
        if not odd:
            return operator(docs, *arguments, **options)
        names = dict(zip(odd, free_names(docs, *[f"own{c}" for c in odd])))
        other = lambda x: names.get(x, x) if isinstance(x, str) else x
        out = operator(docs.withColumnsRenamed(names), *map(other, arguments), **{k: other(x) for k, x in options.items()})
        return out.withColumnsRenamed({b: a for a, b in names.items()})

    return run


def arrow_column(function, returns: str, *columns: Column | str, once: bool = False) -> Column:
    """function(*pa.Array) -> pa.Array as a column. The function sees one Arrow batch at a time, and what it took for a batch
    is given back after it; so do functions of iterators by themselves. once: a filter on the column must not be put before
    it with a second call, as the optimizer does with what it takes for cheap."""
    if "Iterator" not in str(next(iter(get_type_hints(function).values()))):
        inner = function

        @functools.wraps(inner)
        def function(*batch):
            out = inner(*batch)
            del batch
            give_back()
            return out

    udf = F.arrow_udf(function, returns)
    return (udf.asNondeterministic() if once else udf)(*columns)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; nulls are empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Hands memory that is free again to the system; an idle Python worker would keep it from the others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with this C library
        pass


def with_text(docs: DataFrame, text: Column, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with another text; the count of its characters follows where there is one."""
    kept = docs.columns
    out = docs.withColumn(text_col, text)
    if chars_col in kept:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out.select(*[F.col(f"`{c}`") for c in kept])
