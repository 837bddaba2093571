"""Task log: routing, status, change log, agent performance, collaborations and workflows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.functions import fixed_values as fv
from tallyflow.functions.literals import literal_rows
from tallyflow.operators.skew import newest_chunk, rank_within, running_offsets


def known_agent(agent: Column) -> Column:
    return F.coalesce(agent.isin(*fv.AGENT_TYPES), F.lit(False))


def routed(tasks: DataFrame) -> DataFrame:
    """Route every task: no agent means the default one; `valid` is false for an unknown agent."""
    agent = F.coalesce(F.col("agent_type"), F.lit(fv.DEFAULT_AGENT))
    return tasks.withColumn("agent_type", agent).withColumn("valid", known_agent(F.col("agent_type")))


def task_status(tasks: DataFrame) -> DataFrame:
    """Status from the stored JSON result.

    No result is pending. A result whose `success` is true is completed; everything else, an error, a malformed
    text or an unknown agent, is failed.
    """
    ok = F.get_json_object("result", "$.success") == "true"
    status = (
        F.when(~F.col("valid"), "failed")
        .when(F.col("result").isNull(), "pending")
        .when(F.coalesce(ok, F.lit(False)), "completed")
        .otherwise("failed")
    )
    return routed(tasks).withColumn("status", status)


def task_listing(tasks: DataFrame, result_schema: str, user_id: int | None = None, chunk_by: str = "month") -> DataFrame:
    """Tasks with the parsed result and their `position` in their owner's list, newest first; of one owner or of all.

    Numbered by calendar chunk, see `rank_within`; an owner of any size is many small sorts.
    """
    if user_id is not None:
        tasks = tasks.filter(F.col("user_id") == user_id)
    order = [F.col("ts").desc(), F.col("task_id").desc()]
    numbered = rank_within(tasks, "user_id", newest_chunk("ts", chunk_by), order, "position")
    return numbered.withColumn("parsed", F.from_json("result", result_schema))


def owned_tasks(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """The tasks that a request names with their right owner; others are not found."""
    return tasks.join(requests.select("task_id", "user_id").distinct(), ["task_id", "user_id"], "left_semi")


def latest_tasks(changes: DataFrame, fields: tuple[str, ...] = ("status", "result")) -> DataFrame:
    """Current state of a change log with `op` update, rerun or delete.

    An update sets the fields it names and leaves those that are NULL in it as they were; a rerun sets a task back to pending
    without result and without time of completion; a deleted task is gone. So each field is the last one named since the
    last rerun or delete. One aggregate; nothing is sorted.
    """
    return settled_tasks(task_states(changes, fields), fields)


def task_states(changes: DataFrame, fields: tuple[str, ...] = ("status", "result")) -> DataFrame:
    """What a set of changes says about each task: its last change, its last rerun or delete, and each field as last named.

    All are greatest places in the log with what stands there, so states of parts of a log are merged by taking the greatest again, in
    any order and however often; see `merged_states`.
    """
    place = F.struct("updated_at", "change_id")
    rerun = F.col("op") == "rerun"
    reset = F.col("op") != "update"
    columns = [f.name for f in changes.schema.fields if f.name not in ("task_id", "op", "updated_at", "change_id", *fields)]
    named = [F.max(F.when(F.col(f).isNotNull() & ~reset, F.struct(place.alias("at"), F.col(f).alias("value")))).alias(f) for f in (*fields, *columns)]
    return changes.groupBy("task_id").agg(
        F.max(F.struct(place.alias("at"), F.col("op"))).alias("_last"), F.max(F.when(reset, F.struct(place.alias("at"), rerun.alias("rerun")))).alias("_reset"), *named
    )


def merged_states(states: DataFrame) -> DataFrame:
    """One state for each task out of those of parts of the log."""
    return states.groupBy("task_id").agg(*[F.max(c).alias(c) for c in states.columns if c != "task_id"])


def settled_tasks(states: DataFrame, fields: tuple[str, ...] = ("status", "result")) -> DataFrame:
    """Current tasks from one state each."""
    columns = [c for c in states.columns if c not in ("task_id", "_last", "_reset", *fields)]
    cleared = {"status", "result", "completed_at"}

    def value(name: str) -> Column:
        named_since = F.col("_reset").isNull() | (F.col(f"{name}.at") > F.col("_reset.at"))
        kept = F.when(named_since, F.col(f"{name}.value")) if name in cleared else F.col(f"{name}.value")
        return F.coalesce(kept, F.when(F.col("_reset.rerun"), "pending")).alias(name) if name == "status" else kept.alias(name)

    return states.filter("_last.op <> 'delete'").select(
        "task_id", F.col("_last.at.change_id").alias("change_id"), F.col("_last.at.updated_at").alias("updated_at"), F.col("_last.op").alias("op"),
        *[value(f) for f in (*fields, *columns)],
    )


def agent_performance(tasks: DataFrame) -> DataFrame:
    """Task count and success rate of each of the four agents; 0 and 0.0 for one without tasks.

    Tasks of unknown agents count for nobody.
    """
    counted = routed(tasks).filter("valid").groupBy("agent_type").agg(
        F.count("*").alias("task_count"), F.count_if(F.col("success")).alias("n_success")
    )
    agents = literal_rows(tasks.sparkSession, ("agent_type",), [(a,) for a in fv.AGENT_TYPES])
    n = F.coalesce("task_count", F.lit(0))
    joined = agents.join(counted, "agent_type", "left")
    return joined.select(
        "agent_type",
        n.alias("task_count"),
        F.when(n > 0, F.col("n_success").cast("double") / n).otherwise(0.0).alias("success_rate"),
    )


def running_performance(tasks: DataFrame, chunk_by: str = "day") -> DataFrame:
    """After every task: the agent's task count and success rate so far.

    There are four agents, so each holds a large part of all rows. The log is cut by calendar (`chunk_by`: day, hour, ...); a
    running sum within a chunk starts from the totals of the agent's earlier chunks.
    """
    log = routed(tasks).filter("valid").select("agent_type", "ts", "task_id", "success")
    order = [F.col("ts"), F.col("task_id")]
    chunked = log.withColumn("chunk", F.date_trunc(chunk_by, "ts"))
    offsets = running_offsets(
        chunked, "agent_type", {"_n": F.count("*"), "_ok": F.count_if(F.col("success"))}
    )
    so_far = (
        Window.partitionBy("agent_type", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    n = F.count("*").over(so_far) + F.col("_n")
    ok = F.sum(F.col("success").cast("int")).over(so_far) + F.col("_ok")
    joined = chunked.join(offsets, ["agent_type", "chunk"])
    counted = joined.select("agent_type", "task_id", "ts", n.alias("task_count"), ok.alias("n_success"))
    return counted.withColumn("success_rate", F.col("n_success").cast("double") / F.col("task_count")).drop("n_success")


def collaboration_outcomes(steps: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Outcome of each run both ways.

    Sequential: every step succeeds and names a known agent; an empty run succeeds. Parallel: unknown agents are
    left out and one success is enough; an empty run fails. `runs` lists the run ids, to include empty runs.
    """
    good = known_agent(F.col("agent_type")) & F.col("success")
    per_run = steps.groupBy("workflow_id").agg(
        F.count("*").alias("n_steps"), F.bool_and(good).alias("all_good"), F.bool_or(good).alias("any_good")
    )
    if runs is not None:
        per_run = runs.select("workflow_id").distinct().join(per_run, "workflow_id", "left")
    return per_run.select(
        "workflow_id",
        F.coalesce("n_steps", F.lit(0)).alias("n_steps"),
        F.coalesce("all_good", F.lit(True)).alias("sequential_success"),
        F.coalesce("any_good", F.lit(False)).alias("parallel_success"),
    )


def workflow_progress(steps: DataFrame) -> DataFrame:
    """Steps done, failed tasks among them, next agent and status.

    Only an unknown agent fails a workflow, at the step that names it. A step without success is a failed task
    and the run goes on. The stop is the least such step of the workflow's window; the aggregate shares its shuffle.
    """
    stop = F.min(F.when(~known_agent(F.col("agent_type")), F.col("step"))).over(Window.partitionBy("workflow_id"))
    stopped = F.col("stop_step").isNotNull()
    done = ~stopped | (F.col("step") < F.col("stop_step"))
    at_stop = F.col("step") == F.col("stop_step")
    return steps.withColumn("stop_step", stop).groupBy("workflow_id").agg(
        F.count_if(done).alias("current_step"),
        F.count_if(done & ~F.col("success")).alias("n_failed_tasks"),
        F.max(F.when(at_stop, F.col("agent_type"))).alias("next_agent"),
        F.when(F.bool_or(stopped), "failed").otherwise("completed").alias("status"),
    )


def next_steps(workflows: DataFrame) -> DataFrame:
    """Stored workflows, resumed: the agent at the current step, or completed when there is none left."""
    sequence, step = F.col("agent_sequence"), F.col("current_step")
    finished = step >= F.size(sequence)
    return workflows.withColumn("next_agent", F.try_element_at(sequence, (step + 1).cast("int"))).withColumn(
        "status", F.when(finished, "completed").otherwise(F.col("status"))
    )


def previous_results(steps: DataFrame) -> DataFrame:
    """Results available to the step a workflow has reached: those of its earlier steps, in order, not NULL.

    A running flag along the steps tells what lies before the first unknown agent.
    """
    so_far = Window.partitionBy("workflow_id").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = F.bool_and(known_agent(F.col("agent_type"))).over(so_far)
    return steps.withColumn("_open", open_).filter(F.col("_open") & F.col("result").isNotNull()).select(
        "workflow_id", "step", "agent_type", "result"
    )


def results_of_task_ids(workflows: DataFrame, tasks: DataFrame) -> DataFrame:
    """Stored workflows with the results of their listed tasks, in list order, missing ones left out.

    The array per workflow is no longer than the list the workflow row already holds.
    """
    listed = workflows.select("workflow_id", F.posexplode("task_ids").alias("pos", "task_id"))
    found = listed.join(tasks.select("task_id", "result").filter("result IS NOT NULL"), "task_id")
    gathered = found.groupBy("workflow_id").agg(F.array_sort(F.collect_list(F.struct("pos", "result"))).alias("found"))
    empty = F.array().cast("array<string>")
    return workflows.join(gathered, "workflow_id", "left").select(
        *workflows.columns, F.coalesce(F.col("found.result"), empty).alias("previous_results")
    )
