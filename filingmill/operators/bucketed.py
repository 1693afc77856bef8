"""Tables that change by buckets of their key: a mutation reads and writes only the buckets that its rows touch.

Rows lie in `rows/version=v/bucket=b`; what a version replaced is said by one file in `commits`, written last. A bucket's rows
are those of its last committed version, so a run that dies before its commit changes nothing, and readers see the old state
until then. The driver holds a number for each bucket, never a row. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import exists


class Bucketed:
    """A table at a path, in `buckets` buckets of the columns `key`."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("r")).select("r.*").schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def versions(self) -> dict[int, int]:
        """The committed version of each bucket that has any rows or had some."""
        if not exists(self.spark, f"{self.path}/commits"):
            return {}
        said = self.spark.read.schema("version long, bucket int").parquet(f"{self.path}/commits")
        return {r["bucket"]: r["version"] for r in said.groupBy("bucket").agg(F.max("version").alias("version")).collect()}

    def read(self, only: set[int] | None = None) -> DataFrame:
        """The table as committed; of some buckets only, if asked."""
        at = {b: v for b, v in self.versions().items() if only is None or b in only}
        folders = [f"{self.path}/rows/version={v}/bucket={b}" for b, v in sorted(at.items())]
        folders = [f for f in folders if exists(self.spark, f)]  # a version may have left a bucket empty
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r["bucket"] for r in rows.select(self.bucket().alias("bucket")).distinct().collect()}

    def _commit(self, rows: DataFrame, touched: set[int]) -> int:
        version = max(self.versions().values(), default=0) + 1
        self.write(rows, version)
        said = self.spark.createDataFrame([(version, b) for b in sorted(touched)], "version long, bucket int")
        said.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/of={version}")
        return version

    def write(self, rows: DataFrame, version: int) -> None:
        """The rows of a version, which nobody sees before its commit; what an earlier try has left goes."""
        out = rows.select(*self.schema.fieldNames()).withColumn("bucket", self.bucket())
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={version}")

    def upsert(self, incoming: DataFrame, seq: str) -> set[int]:
        """Inserts or replaces: of several incoming rows with a key the last by seq counts. Returns the buckets written."""
        last = incoming.groupBy(*self.key).agg(F.max_by(F.struct(*incoming.columns), seq).alias("x")).select("x.*")
        touched = self._touched(last)
        if touched:
            kept = self.read(touched).join(last.select(*self.key), self.key, "left_anti")
            self._commit(kept.unionByName(last.select(*self.schema.fieldNames())), touched)
        return touched

    def insert_ignore(self, incoming: DataFrame, seq: str) -> set[int]:
        """Inserts what isn't there: of several incoming rows with a new key the first by seq. Only buckets that get rows are written."""
        first = incoming.groupBy(*self.key).agg(F.min_by(F.struct(*incoming.columns), seq).alias("x")).select("x.*")
        fresh = first.join(self.read(self._touched(first)).select(*self.key), self.key, "left_anti").select(*self.schema.fieldNames())
        touched = self._touched(fresh)
        if touched:
            self._commit(self.read(touched).unionByName(fresh), touched)
        return touched

    def append(self, incoming: DataFrame) -> set[int]:
        """Adds all rows as they are."""
        rows = incoming.select(*self.schema.fieldNames())
        touched = self._touched(rows)
        if touched:
            self._commit(self.read(touched).unionByName(rows), touched)
        return touched

    def delete(self, keys: DataFrame) -> set[int]:
        """Drops the rows of these keys; only buckets that lose some are written."""
        gone = keys.select(*self.key).distinct()
        touched = self._touched(self.read(self._touched(gone)).join(gone, self.key, "left_semi"))
        if touched:
            self._commit(self.read(touched).join(gone, self.key, "left_anti"), touched)
        return touched
