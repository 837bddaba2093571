"""Task log, collaboration and workflow queries."""

from pyspark.sql import functions as F

from tallyflow.catalog.registry import big, num, query, r, with_
from tallyflow.operators import tasks
from tallyflow.session import shared_path
from tallyflow.sources.star import task_log, table, workflow_steps
from tallyflow.streaming import changes

TASKS = """tasks AS (
  SELECT event_id AS task_id, user_id, CASE event_type WHEN 'click' THEN 'financial' WHEN 'view' THEN 'research'
         WHEN 'purchase' THEN 'productivity' WHEN 'signup' THEN 'learning' ELSE 'unknown' END AS agent_type,
         value < 100 AS success, ts, value, props FROM events)"""
KNOWN = "agent_type IN ('financial', 'research', 'productivity', 'learning')"


@query(with_(TASKS, select=f"""
SELECT a.agent_type, COUNT(task_id) AS task_count, COALESCE({r('AVG(success::INT)')}, 0.0) AS success_rate
FROM (VALUES ('financial'), ('research'), ('productivity'), ('learning')) AS a(agent_type) LEFT JOIN tasks t USING (agent_type)
GROUP BY 1"""))
def agent_performance(spark, sf_dir):
    return tasks.agent_performance(task_log(spark, sf_dir)).select("agent_type", big("task_count"), num("success_rate"))


@query(with_(TASKS, select=f"""
SELECT task_id, agent_type, COUNT(*) OVER w AS task_count, {r('AVG(success::INT) OVER w')} AS success_rate
FROM tasks WHERE {KNOWN}
WINDOW w AS (PARTITION BY agent_type ORDER BY ts, task_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def agent_running_success(spark, sf_dir):
    out = tasks.running_performance(task_log(spark, sf_dir))
    return out.select("task_id", "agent_type", big("task_count"), num("success_rate"))


@query(with_(TASKS, select=f"SELECT task_id, agent_type, {KNOWN} AS valid FROM tasks"))
def task_routing(spark, sf_dir):
    return tasks.routed(task_log(spark, sf_dir)).select("task_id", "agent_type", "valid")


@query(with_(TASKS, f"""stored AS (
  SELECT task_id, agent_type, CASE WHEN value < 2 THEN NULL WHEN value > 200 THEN '{{"success": tr' WHEN value > 150 THEN '{{"error": "timeout"}}'
         ELSE '{{"success": ' || (value < 100)::VARCHAR || '}}' END AS result, value FROM tasks)""", select=f"""
SELECT task_id, CASE WHEN NOT {KNOWN} THEN 'failed' WHEN result IS NULL THEN 'pending' WHEN value < 100 THEN 'completed'
       ELSE 'failed' END AS status FROM stored"""))
def task_status(spark, sf_dir):
    """Results as JSON text: missing, malformed, an error, or with a success flag."""
    value = F.col("value")
    result = (
        F.when(value < 2, F.lit(None).cast("string"))
        .when(value > 200, '{"success": tr')
        .when(value > 150, '{"error": "timeout"}')
        .otherwise(F.concat(F.lit('{"success": '), (value < 100).cast("string"), F.lit("}")))
    )
    log = task_log(spark, sf_dir).withColumn("result", result)
    return tasks.task_status(log).select("task_id", "status")


@query(with_(TASKS, select="""
SELECT task_id, user_id, agent_type, (props->>'$.k')::BIGINT AS k,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, task_id DESC) AS INTEGER) AS position FROM tasks"""))
def task_listing(spark, sf_dir):
    out = tasks.task_listing(task_log(spark, sf_dir), "k bigint")
    return out.select("task_id", "user_id", "agent_type", "parsed.k", "position")


@query(with_(TASKS, select="""
SELECT task_id, user_id, agent_type FROM tasks
WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = task_id AND o_custkey = user_id)"""))
def owned_tasks(spark, sf_dir):
    """Orders stand for requests: a task is found only with its right owner."""
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("user_id"))
    return tasks.owned_tasks(task_log(spark, sf_dir), requests).select("task_id", "user_id", "agent_type")


# Every third change names no status and every fifth no result; reruns and deletes name nothing.
CHANGES = """changes AS (
  SELECT event_id AS change_id, user_id * 100 + (props->>'$.k')::BIGINT AS task_id, ts AS updated_at,
         CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'rerun' ELSE 'update' END AS op,
         CASE WHEN event_id % 3 = 0 THEN NULL WHEN value < 100 THEN 'completed' ELSE 'failed' END AS status,
         CASE WHEN event_id % 5 > 0 THEN props END AS result,
         CASE WHEN value < 100 THEN event_id END AS completed_at, 'p' || (event_id % 4) AS priority FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY updated_at, change_id) AS i FROM changes),
resets AS (SELECT task_id, max(i) AS i, arg_max(op, i) AS op FROM numbered WHERE op <> 'update' GROUP BY 1),
since AS (SELECT n.*, r.i AS reset, r.op AS reset_op FROM numbered n LEFT JOIN resets r USING (task_id))"""


LATEST = with_(CHANGES, select="""
SELECT task_id, arg_max(change_id, i) AS change_id,
       COALESCE(arg_max(status, i) FILTER (status IS NOT NULL AND op = 'update' AND i > COALESCE(reset, 0)),
                CASE WHEN any_value(reset_op) = 'rerun' THEN 'pending' END) AS status,
       arg_max(result, i) FILTER (result IS NOT NULL AND op = 'update' AND i > COALESCE(reset, 0)) AS result,
       arg_max(completed_at, i) FILTER (completed_at IS NOT NULL AND op = 'update' AND i > COALESCE(reset, 0)) AS completed_at,
       arg_max(priority, i) FILTER (op = 'update') AS priority
FROM since GROUP BY task_id HAVING arg_max(op, i) <> 'delete'""")


@query(LATEST)
def task_latest(spark, sf_dir):
    """Edits name only some fields; a rerun clears status, result and completion."""
    return tasks.latest_tasks(_changes(spark, sf_dir)).select("task_id", "change_id", "status", "result", "completed_at", "priority")


@query(LATEST)
def task_latest_increments(spark, sf_dir):
    """The same from stored states: the log comes in six batches that each span all its time, the last one twice; the first four are compacted."""
    path, log = shared_path(spark, "task-states"), _changes(spark, sf_dir)
    for batch in (0, 1, 2, 3, 4, 5, 5):
        changes.add_changes(log.filter(F.col("change_id") % 6 == batch), path, batch, every=4)
    return changes.current_tasks(spark, path).select("task_id", "change_id", "status", "result", "completed_at", "priority")


def _changes(spark, sf_dir):
    kind, number = F.col("event_type"), F.col("event_id")
    done = F.when(F.col("value") < 100, "completed").otherwise("failed")
    return table(spark, sf_dir, "events").select(
        number.alias("change_id"),
        (F.col("user_id") * 100 + F.get_json_object("props", "$.k").cast("bigint")).alias("task_id"),
        F.col("ts").alias("updated_at"),
        F.when(kind == "error", "delete").when(kind == "signup", "rerun").otherwise("update").alias("op"),
        F.when(number % 3 != 0, done).alias("status"),
        F.when(number % 5 > 0, F.col("props")).alias("result"),
        F.when(F.col("value") < 100, number).alias("completed_at"),
        F.concat(F.lit("p"), (number % 4).cast("string")).alias("priority"),
    )


STEPS = """steps AS (
  SELECT conv_id AS workflow_id, turn AS step, CASE role WHEN 'user' THEN 'financial' WHEN 'assistant' THEN 'research' ELSE role END AS agent_type,
         length(text) >= 40 AS success, text AS result FROM conversations)"""
GOOD = f"({KNOWN} AND success)"


@query(with_(STEPS, select=f"""
SELECT workflow_id, COUNT(*) AS n_steps, bool_and({GOOD}) AS sequential_success, bool_or({GOOD}) AS parallel_success
FROM steps GROUP BY 1"""))
def collaboration_outcome(spark, sf_dir):
    out = tasks.collaboration_outcomes(workflow_steps(spark, sf_dir))
    return out.select("workflow_id", big("n_steps"), "sequential_success", "parallel_success")


STOPS = f"stops AS (SELECT workflow_id, MIN(step) FILTER (NOT {KNOWN}) AS stop FROM steps GROUP BY 1)"


@query(with_(STEPS, STOPS, select="""
SELECT workflow_id, COUNT(*) FILTER (stop IS NULL OR step < stop) AS current_step,
       COUNT(*) FILTER ((stop IS NULL OR step < stop) AND NOT success) AS n_failed_tasks,
       MAX(agent_type) FILTER (step = stop) AS next_agent,
       CASE WHEN any_value(stop) IS NULL THEN 'completed' ELSE 'failed' END AS status
FROM steps JOIN stops USING (workflow_id) GROUP BY 1"""))
def workflow_progress(spark, sf_dir):
    out = tasks.workflow_progress(workflow_steps(spark, sf_dir))
    return out.select("workflow_id", big("current_step"), big("n_failed_tasks"), "next_agent", "status")


@query(with_(STEPS, STOPS, select="""
SELECT workflow_id, step, agent_type, result FROM steps JOIN stops USING (workflow_id) WHERE stop IS NULL OR step < stop"""))
def workflow_previous_results(spark, sf_dir):
    return tasks.previous_results(workflow_steps(spark, sf_dir)).select("workflow_id", "step", "agent_type", "result")


# A stored workflow per order: which agents it runs goes by priority, its place by status, its tasks are events.
WORKFLOWS = """workflows AS (
  SELECT o_orderkey AS workflow_id, CASE o_orderpriority WHEN '1-URGENT' THEN ['financial'] WHEN '2-HIGH' THEN ['research', 'financial']
         ELSE ['research', 'learning', 'productivity'] END AS agents,
         CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END AS step, [o_orderkey, o_custkey, o_orderkey * 7] AS ids FROM orders)"""


def _workflows(spark, sf_dir):
    priority, status, key = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey")

    def agents(*names):
        return F.array(*map(F.lit, names))

    return table(spark, sf_dir, "orders").select(
        key.alias("workflow_id"),
        F.when(priority == "1-URGENT", agents("financial"))
        .when(priority == "2-HIGH", agents("research", "financial"))
        .otherwise(agents("research", "learning", "productivity"))
        .alias("agent_sequence"),
        F.when(status == "F", 2).when(status == "P", 1).otherwise(0).alias("current_step"),
        F.lit("active").alias("status"),
        F.array(key, F.col("o_custkey"), key * 7).alias("task_ids"),
    )


@query(with_(WORKFLOWS, select="""
SELECT workflow_id, step::BIGINT AS current_step, agents[step + 1] AS next_agent,
       CASE WHEN step >= len(agents) THEN 'completed' ELSE 'active' END AS status FROM workflows"""))
def workflow_next_step(spark, sf_dir):
    out = tasks.next_steps(_workflows(spark, sf_dir))
    return out.select("workflow_id", big("current_step"), "next_agent", "status")


@query(with_(WORKFLOWS, """listed AS (SELECT workflow_id, unnest(ids) AS id, unnest([1, 2, 3]) AS pos FROM workflows),
found AS (SELECT workflow_id, string_agg(props, '|' ORDER BY pos) AS t FROM listed JOIN events ON event_id = id GROUP BY 1)""",
    select="SELECT workflow_id, COALESCE(t, '') AS previous_results FROM workflows LEFT JOIN found USING (workflow_id)"))
def workflow_task_results(spark, sf_dir):
    """Results of the tasks a stored workflow lists, in list order; tasks that do not exist are left out."""
    out = tasks.results_of_task_ids(_workflows(spark, sf_dir), task_log(spark, sf_dir))
    return out.select("workflow_id", F.array_join("previous_results", "|").alias("previous_results"))
