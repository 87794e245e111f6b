"""A whole search: from a keyword file and a location file to written results."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from placelab.operators import places as P
from placelab.operators import tasks as K
from placelab.plans.search import collect_places
from placelab.session import materialize
from placelab.sources.readers import in_file_order, read_keywords, read_locations, read_text_table
from placelab.sources.sinks import RESULT_SEP, OutputOptions, write_final
from placelab.sources.task_writer import write_task_files


@dataclass(frozen=True)
class Run:
    """``final``: the time-stamped parquet and delimited results, None if nothing was found."""

    tasks: DataFrame
    places: DataFrame
    outcomes: DataFrame
    final: tuple[str, str] | None


def planned_tasks(spark: SparkSession, keywords: str, locations: str, max_results: int, sep: str = ",") -> DataFrame:
    """Tasks of two files, in the order of their rows; ValueError with the reason if a file does not do."""
    words, raw = read_keywords(spark, keywords, sep), read_text_table(spark, locations, sep)
    for check in (K.validate_keywords(words), K.validate_locations(raw)):
        if not check.ok:
            raise ValueError(check.message)
    places = K.form_locations(in_file_order(read_locations(spark, locations, sep)))
    return K.cross_tasks(in_file_order(words), places.select("pos", "location"), max_results)


def run_search(spark: SparkSession, keywords: str, locations: str, observations: DataFrame, captures: DataFrame,
               errors: DataFrame | None = None, options: OutputOptions = OutputOptions(), sep: str = ",",
               at: datetime | None = None) -> Run:
    """Plan the tasks, collect their places and write them: one file per task with places, and the final results.

    ``errors`` (task_id, error) names failed tasks: they give no places and are told apart from tasks that found none.
    Tasks and places are worked out once, into the shared folder.
    """
    tasks = materialize(planned_tasks(spark, keywords, locations, options.max_results, sep))
    if errors is None:
        errors = spark.createDataFrame([], "task_id long, error string")
    found = collect_places(tasks, observations, captures, options.max_scrolls, options.patience)
    places = materialize(P.of_completed_tasks(found, errors))
    outcomes = P.task_states(tasks.select("task_id", "keyword", "location"), places, errors)
    if not places.isEmpty():
        write_task_files(places, options.output_dir, RESULT_SEP)
    return Run(tasks, places, outcomes, write_final(places, options.output_dir, at=at))
