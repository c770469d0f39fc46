"""A store that takes commits.

The base is a graph as Parquet, dealt into buckets by subject, one folder each. A commit is one more
folder with the last change of each triple, dealt the same way; nothing else is written. Readers take
the base without the triples that changed and add those whose last change is an addition; buckets
that no commit has met are read as they are. `compact` writes the buckets that commits have met anew,
by overwriting their folders alone, and then removes the commits it has taken in. Commits that are
taken in twice change nothing, so a compaction that was broken off is run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..operators.loops import cut
from ..operators.patterns import predicate_statistics

BUCKETS = 64
_LOG = T.StructType([*S.SCHEMA.fields, T.StructField("op", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("version", T.IntegerType())])
_BASE = T.StructType([*S.SCHEMA.fields, T.StructField("bucket", T.IntegerType())])


class Store:
    """The store in a folder that all executors share; `create` makes one, and the number of buckets stays with it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets = self.spark.read.parquet(f"{self.path}/meta").first()["buckets"]

    @classmethod
    def create(cls, t: DataFrame, path: str, buckets: int = BUCKETS) -> Store:
        """A store with the triples of `t`; the folder must not be there."""
        spark, path = t.sparkSession, path.rstrip("/")
        t = t.select(*S.COLUMNS).distinct().withColumn("bucket", cls._bucket(buckets))
        # A hub's triples are spread over several tasks, and so over several files of its bucket.
        t.repartition("bucket", F.pmod(F.xxhash64("p", "o"), F.lit(4))).sortWithinPartitions("bucket", "s", "p").write.partitionBy("bucket").parquet(f"{path}/base")
        predicate_statistics(t).coalesce(1).write.parquet(f"{path}/statistics")
        spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/meta")
        return cls(spark, path)

    @staticmethod
    def _bucket(buckets: int):
        return F.pmod(F.xxhash64("s"), F.lit(buckets)).cast("int")

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._fs_path(path))

    def versions(self) -> list[int]:
        """The commits that are not yet taken in and were written to the end."""
        root = f"{self.path}/log"
        if not self._exists(root):
            return []
        found = [x.getPath().getName() for x in self._fs.listStatus(self._fs_path(root))]
        return sorted(int(x.partition("=")[2]) for x in found if x.startswith("version=") and self._exists(f"{root}/{x}/_SUCCESS"))

    def _log(self, versions: list[int]) -> DataFrame:
        """The last change of each triple in these commits, with its bucket."""
        paths = [f"{self.path}/log/version={v}" for v in versions]
        rows = self.spark.read.schema(_LOG).option("basePath", f"{self.path}/log").parquet(*paths)
        return rows.groupBy(*S.COLUMNS, "bucket").agg(F.max_by("op", "version").alias("op"))

    def _base(self) -> DataFrame:
        return self.spark.read.schema(_BASE).parquet(f"{self.path}/base").where("s <> ''")

    def _met(self, versions: list[int]) -> list[int]:
        """The buckets that these commits have met, by their folders."""
        names = [x.getPath().getName() for v in versions for x in self._fs.listStatus(self._fs_path(f"{self.path}/log/version={v}"))]
        return sorted({int(x.partition("=")[2]) for x in names if x.startswith("bucket=")})

    @staticmethod
    def _applied(base: DataFrame, log: DataFrame) -> DataFrame:
        keys = [*S.COLUMNS, "bucket"]
        return base.join(log.select(*keys), keys, "left_anti").select(*keys).unionByName(log.where("op = 'add'").select(*keys))

    def read(self) -> DataFrame:
        """The graph with all commits."""
        versions = self.versions()
        if not versions:
            return self._base().select(*S.COLUMNS)
        met, base = self._met(versions), self._base()
        changed = self._applied(base.where(F.col("bucket").isin(met)), self._log(versions))
        return base.where(~F.col("bucket").isin(met)).unionByName(changed).select(*S.COLUMNS)

    def statistics(self) -> DataFrame:
        """Statistics of the predicates, of the time when the store was made or compacted."""
        return self.spark.read.parquet(f"{self.path}/statistics")

    def commit(self, log: DataFrame) -> int:
        """Writes a change log (seq, op, *triple) as one commit, whose number is returned; of several changes of a triple the last counts.

        One writer commits at a time: a number that is taken raises, and nothing is written.
        """
        version = max(self.versions(), default=0) + 1
        last = log.groupBy(*S.COLUMNS).agg(F.max_by("op", "seq").alias("op")).withColumn("bucket", self._bucket(self.buckets))
        last.write.partitionBy("bucket").mode("error").parquet(f"{self.path}/log/version={version}")
        return version

    def compact(self) -> list[int]:
        """Takes all commits in; returns the buckets that were written anew."""
        versions = self.versions()
        if not versions:
            return []
        met = self._met(versions)
        if met:
            rows = self._applied(self._base().where(F.col("bucket").isin(met)), self._log(versions))
            # A bucket that has lost all its triples keeps a row without a subject, or its folder would stay as it was.
            marks = self.spark.createDataFrame([("",) * 7 + (b,) for b in met], _BASE)
            rows = cut(rows.unionByName(marks)).repartition("bucket", F.pmod(F.xxhash64("p", "o"), F.lit(4))).sortWithinPartitions("bucket", "s", "p")
            rows.write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/base")
        predicate_statistics(self._base()).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/statistics")
        for v in versions:
            self._fs.delete(self._fs_path(f"{self.path}/log/version={v}"), True)
        return met
