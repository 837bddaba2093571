"""A change log of tasks that keeps growing: each batch is reduced to states, and only states are read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyflow.operators.tasks import merged_states, settled_tasks, task_states
from tallyflow.streaming.additive import read_merged, write_part
from tallyflow.streaming.keyed import COMPACT_EVERY


def add_changes(changes: DataFrame, path: str, batch_id: int, every: int = COMPACT_EVERY) -> None:
    """Store what a batch of changes says about its tasks. Changes may come in any order; a batch that is run again counts once."""
    write_part(task_states(changes), path, merged_states, batch_id, every)


def current_tasks(spark: SparkSession, path: str) -> DataFrame | None:
    """The tasks as `latest_tasks` would have them from all changes so far; None before the first batch. Reads a state for each task
    and batch since the last compaction, and none of the log."""
    states = read_merged(spark, path, merged_states)
    return None if states is None else settled_tasks(states)
