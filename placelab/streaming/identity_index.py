"""Deduplication of a stream over all time, by an index of the identities seen so far."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from placelab.operators.places import IDENTITY, dedup_global, with_identity
from placelab.session import delete, discard, materialize

BUCKETS, MERGE_EVERY = 64, 16
SEEN = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("key_lat", T.DoubleType()), T.StructField("key_lon", T.DoubleType()),
    T.StructField("bucket", T.IntegerType()),
])


class IdentityIndex:
    """Identities in files by bucket: one folder per micro-batch, merged every ``merge_every`` batches.

    What belongs to a batch follows from its number alone, so a batch that is run
    again sees the same index as before and replaces its own folder.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, merge_every: int = MERGE_EVERY) -> None:
        self.spark, self.path, self.buckets, self.merge_every = spark, path, buckets, merge_every

    def bucketed(self, keyed: DataFrame) -> DataFrame:
        return keyed.withColumn("bucket", F.pmod(F.xxhash64(*IDENTITY), F.lit(self.buckets)).cast("int"))

    def _merged_before(self, number: int) -> int:
        """The last batch before ``number`` whose merged folder holds all batches up to it; -1 if none."""
        return (number - 1) // self.merge_every * self.merge_every if number > self.merge_every else -1

    def _folders(self, number: int) -> list[str]:
        merged = self._merged_before(number)
        folders = [f"{self.path}/merged-{merged}"] if merged >= 0 else []
        return folders + [f"{self.path}/batch-{n}" for n in range(merged + 1, number)]

    def _read(self, folders: list[str]) -> DataFrame:
        tables = [self.spark.read.schema(SEEN).parquet(f) for f in folders]  # at most ``merge_every`` and one
        return reduce(DataFrame.union, tables) if tables else self.spark.createDataFrame([], SEEN)

    def before(self, number: int) -> DataFrame:
        """Identities of all batches before ``number``."""
        return self._read(self._folders(number))

    def fresh(self, keyed: DataFrame, number: int) -> DataFrame:
        """Rows of a bucketed batch whose identity no earlier batch has; only the buckets they fall in are read.

        The index is looked through for what the batch holds, so a small batch
        is what travels, not the index.
        """
        touched = [r.bucket for r in keyed.select("bucket").distinct().collect()]  # at most ``buckets``
        wanted = keyed.select("bucket", *IDENTITY)
        index = self.before(number).filter(F.col("bucket").isin(touched))
        known = index.join(wanted, self._same(index, wanted), "left_semi")
        return keyed.join(known, self._same(keyed, known), "left_anti")

    @staticmethod
    def _same(left: DataFrame, right: DataFrame):
        same = left["bucket"] == right["bucket"]
        for name in IDENTITY:
            same = same & left[name].eqNullSafe(right[name])
        return same

    def add(self, fresh: DataFrame, number: int) -> None:
        rows = fresh.select(*SEEN.fieldNames())
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch-{number}")
        if number and number % self.merge_every == 0:
            together = self._read([*self._folders(number), f"{self.path}/batch-{number}"])
            together.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/merged-{number}")

    def forget_merged(self, number: int) -> None:
        """Remove what the merged folder before ``number`` holds as well; batches before it are never run again."""
        merged = self._merged_before(number)
        if merged >= 0 and number == merged + 1:
            for folder in [*self._folders(merged), f"{self.path}/batch-{merged}"]:
                delete(self.spark, folder)


def dedup_all_time(stream: DataFrame, out: str, index: str, checkpoint: str, *order: str, buckets: int = BUCKETS,
                   merge_every: int = MERGE_EVERY, once: bool = False, every: str = "1 minute") -> StreamingQuery:
    """Write the first arrival of every place identity to ``out``, however late its copies come.

    No event time and no watermark is needed, and no state is kept in memory. Inside a
    micro-batch the first row by ``order`` (default task_id, rank) wins. Every batch writes its
    own folders, so a batch that is run again after a failure changes nothing. ``buckets``
    and ``merge_every`` have to stay the same over the life of an index.
    """
    def write(batch: DataFrame, number: int) -> None:
        seen = IdentityIndex(batch.sparkSession, index, buckets, merge_every)
        seen.forget_merged(number)
        firsts = materialize(seen.bucketed(with_identity(dedup_global(batch, *order))))
        new = materialize(seen.fresh(firsts, number))
        new.drop("key_lat", "key_lon", "bucket").write.mode("overwrite").parquet(f"{out}/batch={number}")
        seen.add(new, number)
        discard(firsts, new)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def kept(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """What ``dedup_all_time`` has written so far."""
    return spark.read.schema(schema).parquet(out).select(*schema.fieldNames())
