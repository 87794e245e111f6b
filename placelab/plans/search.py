"""From planned tasks and captured tables to the final place table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from placelab.operators import places as P
from placelab.operators.harvest import MAX_SCROLLS, PATIENCE, captured_links, harvest_for_tasks


def collect_places(tasks: DataFrame, observations: DataFrame, captures: DataFrame, max_scrolls: int = MAX_SCROLLS,
                   patience: int = PATIENCE) -> DataFrame:
    """Places of all tasks: harvested links only, parsed, valid, first per link; duplicates across tasks stay."""
    links = harvest_for_tasks(observations, tasks, max_scrolls, patience)
    # the links of a task are bounded by its max_results, so every join after this one is as well
    kept = captured_links(captures.drop("search_keyword", "search_location"), links)
    searched = tasks.selectExpr("task_id", "keyword AS search_keyword", "location AS search_location")
    return P.places_from_captures(kept.join(searched, "task_id"))
