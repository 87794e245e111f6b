"""The same place jobs over files that keep arriving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from placelab.operators.places import IDENTITY, assemble, with_identity
from placelab.schemas import CAPTURE
from placelab.session import spread

WATERMARK = "1 hour"


def read_captures(spark: SparkSession, path: str, schema: T.StructType = CAPTURE, fmt: str = "parquet",
                  files_per_trigger: int | None = None, **options) -> DataFrame:
    """Capture files as a stream; each file is read once, and its rows are dealt over all tasks."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return spread(reader.load(path))


def places(captures: DataFrame) -> DataFrame:
    """Captures to valid places; stateless, so every arriving row is worked on once."""
    return assemble(captures)


def dedup(stream: DataFrame, within: str = WATERMARK, time: str = "scraped_at") -> DataFrame:
    """First arrival per identity inside the watermark; state older than that is dropped.

    Needs event times. The batch operator gives the exact answer over all time.
    """
    return (
        with_identity(stream).withWatermark(time, within)
        .dropDuplicatesWithinWatermark(list(IDENTITY)).drop("key_lat", "key_lon")
    )


def _sums() -> list[Column]:
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return [
        F.count("*").alias("total_places"), F.sum("rating").alias("rating_sum"),
        F.count("rating").alias("rated_places"), F.count("phone").alias("with_phone"),
        F.count("website").alias("with_website"), F.count_if(located).alias("with_coords"),
    ]


def windowed_summary(stream: DataFrame, window: str = "10 minutes", within: str = WATERMARK,
                     time: str = "scraped_at", *by: str) -> DataFrame:
    """Summary sums per event-time window (and ``by`` columns), emitted once a window is complete."""
    return (
        stream.withWatermark(time, within).groupBy(F.window(time, window).alias("window"), *by).agg(*_sums())
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by,
                "total_places", "rating_sum", "rated_places", "with_phone", "with_website", "with_coords")
    )


def running_summary(windows: DataFrame) -> DataFrame:
    """The overview so far from the windows written so far; one row."""
    total = F.sum("total_places")
    return windows.agg(
        total.alias("total_places"),
        F.try_divide(F.sum("rating_sum"), F.sum("rated_places")).alias("avg_rating"),
        F.sum("rated_places").alias("rated_places"), F.sum("with_phone").alias("with_phone"),
        F.sum("with_website").alias("with_website"), F.sum("with_coords").alias("with_coords"),
        F.try_divide(F.sum("with_coords") * 100.0, total).alias("coords_pct"),
    )


def running_counts(stream: DataFrame, column: str) -> DataFrame:
    """Running rows per value, for update or complete mode; nulls excluded."""
    return stream.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("places"))


def upsert_to(stream: DataFrame, path: str, checkpoint: str, once: bool = False, every: str = "1 minute") -> StreamingQuery:
    """Keep the changed rows of every micro-batch of an aggregate under the batch's own name.

    A batch that is run again after a failure replaces its own rows, so nothing is counted twice. ``latest`` reads the state.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def latest(spark: SparkSession, path: str, schema: T.StructType, *keys: str) -> DataFrame:
    """The current row of every key of what ``upsert_to`` has written."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    values = [f.name for f in schema.fields if f.name not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_row"))
    return newest.select(*keys, "_row.*")


def append_to(stream: DataFrame, path: str, checkpoint: str, once: bool = False, every: str = "1 minute",
              fmt: str = "parquet") -> StreamingQuery:
    """Append the stream to files; the checkpoint keeps progress over restarts.

    ``once`` works off what is there and stops.
    """
    writer = stream.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    trigger = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return trigger.start(path)
