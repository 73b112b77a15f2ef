"""Tables that outlive a session: Parquet in buckets of one column, of which a write rewrites those that it touches.

A row's bucket is a hash of its ``by`` column: the primary key of a table that is upserted, the parent's id of one whose rows are replaced or deleted with
their parent. A write finds the buckets of its rows (a number or two each), reads these alone, works the change out as a plan, writes the result beside the
table and then exchanges exactly these partitions (dynamic overwrite). Work grows with the touched buckets, not with the table.
A write that fails before the exchange leaves the table as it was; one that fails in it has its rows in ``staged`` until
the next write, and ``recover`` exchanges them again. One writer at a time.

A bucket that has lost all rows holds one row without content, which reads leave out. Rows whose ``by`` is null share a bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.operators.relational import replace_in_scope, upsert, without

BUCKETS = 256


class StoredTable:
    def __init__(self, spark: SparkSession, path: str):
        """Opens a table; how it was made is read from beside it."""
        self.spark, self.path = spark, path.rstrip("/")
        made = spark.read.parquet(f"{self.path}/made").first()
        self.by, self.buckets = made["by"], made["buckets"]

    @classmethod
    def create(cls, df: DataFrame, path: str, by: str, buckets: int = BUCKETS) -> StoredTable:
        spark = df.sparkSession
        spark.createDataFrame([(by, buckets)], "by string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/made")
        bucket = F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")
        df.withColumns({"__row": F.lit(True), "__bucket": bucket}).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/rows")
        return cls(spark, path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.by), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").where("__row").drop("__row", "__bucket")

    def recover(self) -> None:
        """Exchanges the partitions that ``staged`` holds."""
        rows = self.spark.read.parquet(f"{self.path}/staged")
        rows.repartition("__bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(f"{self.path}/rows")

    def _change(self, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Rewrites the buckets of ``touched`` (the ``by`` column); gives them."""
        places = sorted(r["b"] for r in touched.select(self._bucket().alias("b")).distinct().collect())  # at most one a bucket
        if not places:
            return []
        old = self.spark.read.parquet(f"{self.path}/rows").where("__row").where(F.col("__bucket").isin(*places)).drop("__row", "__bucket")
        new = change(old).select(*old.columns).withColumns({"__row": F.lit(True), "__bucket": self._bucket()})
        empty = self.spark.createDataFrame([(False, b) for b in places], "__row boolean, __bucket int")
        new.unionByName(empty, allowMissingColumns=True).write.mode("overwrite").parquet(f"{self.path}/staged")
        self.recover()
        return places

    def upsert(self, new: DataFrame, keep: list[str] | None = None) -> list[int]:
        """``new`` over the rows with its keys; columns in ``keep`` stay as they were where the key existed."""
        return self._change(new.select(self.by), lambda old: upsert(old, new, self.by, keep or []))

    def replace(self, new: DataFrame, scope: list[str]) -> list[int]:
        """Rows of every scope that ``new`` has are exchanged for those of ``new``; ``scope`` holds the ``by`` column."""
        if self.by not in scope:
            raise ValueError(f"a scope of this table holds {self.by}")
        return self._change(new.select(self.by), lambda old: replace_in_scope(old, new, scope))

    def delete(self, gone: DataFrame) -> list[int]:
        """Rows whose ``by`` value is in ``gone`` (one column) go: a cascade from the parent."""
        gone = gone.toDF(self.by).distinct()
        return self._change(gone, lambda old: without(old, self.by, gone))
