"""Helpers that the operators share: staging in the cluster's shared folder, Arrow rows."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the contracts: U+0020 and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); in local mode one of our own where it is unset."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/foldstone-{context.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it again: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    _STAGED[id(staged)] = (weakref.ref(staged), path)
    return staged


#: Paths of staged frames that are still referenced.
_STAGED: dict[int, tuple[weakref.ref, str]] = {}


def release(*staged: DataFrame) -> None:
    """Delete what stage() wrote for these frames, once nothing that is still to run reads them."""
    for df in staged:
        of, path = _STAGED.pop(id(df))
        if of() is df:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def row_key(*columns: str):
    """Tells rows that share an id apart unless they are equal."""
    return F.xxhash64(*columns)


def arrow_rows(df: DataFrame, schema: str | T.StructType, rows: Callable[[Iterator[dict]], Iterator[tuple]], size: int = 4096) -> DataFrame:
    """mapInArrow with a generator over input rows that yields output tuples; batches of `size` rows bound memory."""
    spark_schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = spark_schema.fieldNames()
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for batch in batches:
                columns = batch.schema.names
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    yield from (dict(zip(columns, row)) for row in zip(*(part.column(i).to_pylist() for i in range(part.num_columns))))

        held: list[tuple] = []
        for out in rows(each()):
            held.append(out)
            if len(held) >= size:
                yield as_batch(held)
                held = []
        if held:
            yield as_batch(held)

    def as_batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, arrow.field(i).type) for i, column in enumerate(zip(*held))], schema=pa.schema([(n, arrow.field(i).type) for i, n in enumerate(names)]))

    return df.mapInArrow(run, spark_schema)
