"""Which links a search task keeps, from what its result panel showed at each scroll."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Scroll budget and idle scrolls before giving up.
MAX_SCROLLS = 10
PATIENCE = 3


def harvest_links(observations: DataFrame, max_results: int = 50, max_scrolls: int = MAX_SCROLLS,
                  patience: int = PATIENCE) -> DataFrame:
    """Ordered, first-seen unique links per task: (task_id, rank, href, scroll_no, pos).

    Reading stops before the first new link that follows ``patience`` scrolls
    without one, after ``max_scrolls`` scrolls, and at ``max_results`` links.

    A task with very many rows costs no more than others past the first
    shuffle: first-seen places combine on the map side, the rank window keeps
    at most ``max_results`` rows per map task, and the idle test sees one row
    per scroll. Ranking first is safe, since the stop only cuts a prefix.
    """
    seen = observations.filter(
        (F.col("scroll_no") < max_scrolls) & F.col("href").isNotNull() & (F.col("href") != "")
    )
    first_seen = (
        seen.groupBy("task_id", "href")
        .agg(F.min(F.struct("scroll_no", "pos")).alias("at"))
        .select("task_id", "href", "at.scroll_no", "at.pos")
    )
    by_sight = Window.partitionBy("task_id").orderBy("scroll_no", "pos", "href")
    ranked = first_seen.withColumn("rank", F.row_number().over(by_sight)).filter(F.col("rank") <= max_results)

    fresh = first_seen.select("task_id", "scroll_no").distinct()
    previous = F.lag("scroll_no", 1, -1).over(Window.partitionBy("task_id").orderBy("scroll_no"))
    stops = (
        fresh.withColumn("idle", F.col("scroll_no") - previous - 1)
        .filter(F.col("idle") >= patience)
        .groupBy("task_id")
        .agg(F.min("scroll_no").alias("stop"))
    )
    kept = ranked.join(stops, "task_id", "left").filter(F.col("stop").isNull() | (F.col("scroll_no") < F.col("stop")))
    return kept.select("task_id", "rank", "href", "scroll_no", "pos")


def harvest_for_tasks(observations: DataFrame, tasks: DataFrame, max_scrolls: int = MAX_SCROLLS,
                      patience: int = PATIENCE) -> DataFrame:
    """As ``harvest_links`` with each task's own ``max_results``."""
    most = tasks.agg(F.max("max_results")).first()[0] or 0
    links = harvest_links(observations, most, max_scrolls, patience)
    limits = tasks.select("task_id", "max_results")
    return links.join(limits, "task_id").filter(F.col("rank") <= F.col("max_results")).drop("max_results")


def captured_links(captures: DataFrame, links: DataFrame) -> DataFrame:
    """Captures of harvested links only, ranked in harvest order."""
    wanted = links.select("task_id", F.col("href").alias("link"), F.col("rank").alias("_rank"))
    return captures.join(wanted, ["task_id", "link"]).withColumn("rank", F.col("_rank")).drop("_rank")
