"""Tables kept in buckets of a key's hash, of which a batch rewrites only those it touches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BUCKET = "_bucket"


class KeyedTable:
    """A table at ``path`` whose rows lie in ``buckets`` folders by the hash of ``key``.

    A batch writes the touched buckets as a folder of its own and a manifest: bucket -> number of the batch that wrote it last. Readers follow the manifest of a
    batch, so a bucket that no batch has touched since keeps its files, and a batch that is run again starts from the manifest before it and
    gives the same table. A manifest has at most ``buckets`` rows.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: StructType | None = None, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the keys of ``rows``: at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket().alias(BUCKET)).distinct().collect())

    def manifest(self, number: int) -> dict[int, int]:
        """bucket -> batch as of batch ``number``; empty before the first."""
        if number < 0:
            return {}
        return {r["bucket"]: r["batch"] for r in self.spark.read.schema("bucket int, batch int").parquet(f"{self.path}/manifest/{number}").collect()}

    def read(self, number: int, only: list[int] | None = None) -> DataFrame:
        """The rows as of batch ``number``, or those of the buckets ``only``. Without a schema the files' own is taken."""
        held = self.manifest(number)
        wanted = [b for b in held if only is None or b in only]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        return reader.parquet(*(f"{self.path}/data/{held[b]}/{BUCKET}={b}" for b in wanted))

    def rewrite(self, number: int, rows: DataFrame, only: list[int]) -> None:
        """Makes ``rows`` the content of the buckets ``only`` as of batch ``number``; the others stay as they were."""
        marked = rows.select(*self.schema.names).withColumn(BUCKET, self.bucket())
        marked.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/data/{number}")
        filled = {r[0] for r in marked.select(BUCKET).distinct().collect()} if only else set()
        held = {b: n for b, n in self.manifest(number - 1).items() if b not in only} | {b: number for b in only if b in filled}
        self.spark.createDataFrame(sorted(held.items()), "bucket int, batch int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{number}")


class AppendedTable:
    """Rows as they arrive, in folders by batch and bucket, so that reading the rows of some keys reads their buckets only."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: StructType, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets

    bucket = KeyedTable.bucket
    touched = KeyedTable.touched

    def append(self, number: int, rows: DataFrame) -> None:
        rows.withColumn(BUCKET, self.bucket()).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/batch={number}")

    def read(self, number: int, only: list[int]) -> DataFrame:
        """The rows of the buckets ``only`` up to batch ``number``; the folders of other buckets are not opened."""
        stored = StructType([*self.schema.fields, StructField(BUCKET, IntegerType()), StructField("batch", IntegerType())])
        if number < 0 or not only:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(stored).option("basePath", self.path).parquet(f"{self.path}/batch=*")
        return rows.filter((F.col("batch") <= number) & F.col(BUCKET).isin(only)).select(*self.schema.names)


def replaced(old: DataFrame, new: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """``old`` without the rows of ``keys``, and ``new``; null keys meet each other."""
    gone = keys.select(*names).distinct().select(*(F.col(n).alias(f"_{n}") for n in names))
    same = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names])
    return old.join(gone, same, "left_anti").select(*new.columns).unionByName(new)
