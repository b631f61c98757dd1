"""Target tables stored by key bucket, so that a merge rewrites only the buckets it touches.

A stored table is a Parquet folder partitioned by ``bucket``, a hash of the
merge keys. A merge reads the buckets that hold a source key, upserts there and
overwrites those partitions alone; files of other buckets stay as they are. An
increment of a day costs what its buckets hold, not what the table holds. The
number of buckets is fixed when the table is made: choose it so that a bucket is
some hundred megabytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spooltrace.operators import merge as C
from spooltrace.session import materialize

c = F.col
BUCKET = "bucket"


class StoredTable:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> StoredTable:
        """``df`` written by bucket. A bucket is written by one task; the keys' hash spreads a hot value of one column."""
        out = cls(df.sparkSession, path, keys, buckets)
        if BUCKET in df.columns:
            raise ValueError(f"a stored table cannot have a column {BUCKET!r}")
        df.withColumn(BUCKET, out._bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)
        return out

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _files(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        return self._files().drop(BUCKET)

    def touched(self, source: DataFrame) -> list[int]:
        """Buckets that hold a source key: at most ``buckets`` numbers."""
        return sorted(r[0] for r in source.select(self._bucket().alias("b")).distinct().collect())

    def _replace(self, rows: DataFrame) -> None:
        # a bucket that is overwritten is also read, so its new rows are written apart first
        new = materialize(rows.withColumn(BUCKET, self._bucket()))
        (new.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(BUCKET).parquet(self.path))

    def merge(self, source: DataFrame, set_cols: Sequence[str], id_col: str | None = "id", **options) -> DataFrame:
        """C2 into the stored table; returns the actions (one row per touched key).

        New ids follow the largest id of the whole table (a scan of that column alone).
        """
        source = materialize(source)
        part = self._files().where(c(BUCKET).isin(self.touched(source))).drop(BUCKET)
        start = C.next_id(self.read(), id_col) if id_col else None
        merged, actions = C.merge_upsert(part, source, self.keys, set_cols, id_col=id_col, start_id=start, **options)
        actions = materialize(actions)
        changed = actions.select(self._bucket().alias("b")).distinct()
        buckets = [r[0] for r in changed.collect()]
        if buckets:  # a merge whose condition holds for no row rewrites nothing
            self._replace(merged.where(self._bucket().isin(buckets)))
        return actions

    def insert(self, source: DataFrame, id_col: str | None = "id", **options) -> DataFrame:
        """C3 into the stored table; returns the inserted rows."""
        part = self._files().where(c(BUCKET).isin(self.touched(source))).drop(BUCKET)
        start = C.next_id(self.read(), id_col) if id_col else None
        _, new = C.insert_missing(part, source, self.keys, id_col=id_col, start_id=start, **options)
        new = materialize(new)
        if not new.isEmpty():
            new.withColumn(BUCKET, self._bucket()).repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(self.path)
        return new
