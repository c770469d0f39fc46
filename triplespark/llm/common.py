"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: The white space that ends a word: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one on a single machine where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Shuffle files of a table that has been written are of no more use.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: For long texts whose tasks hold a lot besides.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold for what is run within."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, values: dict[str, str] | None = None) -> DataFrame:
    """Writes `df` as a table in the shared folder and reads it back, which cuts its lineage; the settings `values` hold meanwhile."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, _WRITING | (values or {})):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, keys: list[str], values: dict[str, str] | None = None) -> DataFrame:
    """`df` as a table in the shared folder, dealt into buckets by `keys`, so that joins by them don't deal it again."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    with settings(spark, _WRITING | (values or {})):
        df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")  # the catalog's entry alone; the files stay
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that `written` gave; nothing may read it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def part_of(doc_id: str | Column, parts: int) -> Column:
    """crc32 of doc_id's decimal text, modulo `parts`; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, UPPER, UPPER.lower())


def without(c: Column, characters: str) -> Column:
    """`c` without any of `characters`."""
    for x in characters:
        c = F.replace(c, F.lit(x))
    return c


def map_batches(docs: DataFrame, passed: list[str], inputs: list[str], added: list[T.StructField], start: Callable[[], Callable[..., list[list]]]) -> DataFrame:
    """The columns `passed` as they are, and `added` ones worked out from `inputs`, batch by batch.

    `start` is called once for each task and gives a function from lists of the inputs' values to
    lists of the added columns' values. Passed columns stay in Arrow, so nulls and large integers
    keep their values.
    """
    fields = [docs.schema[c] for c in passed]
    schema = T.StructType([*fields, *added])
    kinds = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            made = work(*[batch.column(c).to_pylist() for c in inputs])
            arrays = [batch.column(c) for c in passed] + [pa.array(v, k) for v, k in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema.fields])

    return docs.select(*dict.fromkeys([*passed, *inputs])).mapInArrow(run, schema)
