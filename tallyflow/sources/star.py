"""Views of the star-schema, event and conversation tables as ledgers, profiles, debts, tasks and workflows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions import fixed_values as fv
from tallyflow.functions.money import MONEY, to_money
from tallyflow.session import stored_bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Stored bytes of a large table that a task holds, where it is laid out anew. A table of fewer than MANY_PIECES of them is left to Spark.
PIECE_BYTES = 8 << 20
MANY_PIECES = 16


def lines_of_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items, and (o_orderkey, o_custkey) of the orders to join to them.

    A large table is laid out by order on both sides, in as many pieces as its stored size asks for, so that what a task of the
    join and of an aggregate behind it holds doesn't grow with the table. Spark's own partitions are merged up to 64 MB of
    compressed rows, whose sorted and hashed form takes many times that.
    """
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = stored_bytes(spark, f"{sf_dir}/lineitem.parquet") // PIECE_BYTES
    if n >= MANY_PIECES:
        lines, orders = lines.repartition(n, "l_orderkey"), orders.repartition(n, "o_orderkey")
    return lines, orders


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, laid over all cores where their files are read by fewer tasks than there are cores.

    Spark reads a row group in one task, so a large file of few row groups would have all its texts searched by few of the cores. A
    job that reads no column counts the parts of files that hold rows; there is none for a table of fewer than MANY_PIECES.
    """
    docs = table(spark, sf_dir, "documents")
    pieces, cores = stored_bytes(spark, f"{sf_dir}/documents.parquet") // PIECE_BYTES, spark.sparkContext.defaultParallelism
    if pieces < MANY_PIECES or docs.select("_metadata.file_path", "_metadata.file_block_start").distinct().count() >= cores:
        return docs
    return docs.repartition(max(2 * cores, pieces), "doc_id")


def star_ledger(spark: SparkSession, sf_dir: str, with_category: bool = True) -> DataFrame:
    """Orders as income, their line items as expenses of the ordering customer.

    Line items hold the user only through their order. The join to part is an outer join on its key and gives
    the category alone, so an operator that needs no category can leave it out with the same result.
    Join strategies are left to Catalyst: it broadcasts a side only when its size is known to be small.

    `txn_id` is a struct: (orderkey, linenumber) alone repeats in this data.
    """
    orders = table(spark, sf_dir, "orders")
    lines, keys = lines_of_orders(spark, sf_dir)
    amount = to_money(F.col("l_extendedprice"))
    income_amount = to_money(F.col("o_totalprice"))

    income = orders.select(
        _star_id(F.col("o_orderkey"), F.lit(0), F.lit(0), F.lit(0), income_amount),
        F.col("o_custkey").alias("user_id"),
        income_amount.alias("amount"),
        F.col("o_orderpriority").alias("category"),
        F.lit("income").alias("txn_type"),
        F.col("o_orderdate").alias("ts"),
    )
    spent = lines.join(keys, F.col("l_orderkey") == F.col("o_orderkey"))
    category = F.lit(None).cast("string")
    if with_category:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
        spent = spent.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        category = F.coalesce(F.col("p_type"), F.lit(fv.MISSING_CATEGORY))
    expense = spent.select(
        _star_id(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), amount),
        F.col("o_custkey").alias("user_id"),
        amount.alias("amount"),
        category.alias("category"),
        F.lit("expense").alias("txn_type"),
        F.col("l_shipdate").alias("ts"),
    )
    return income.unionByName(expense)


def _star_id(k1: Column, k2: Column, k3: Column, k4: Column, amount: Column) -> Column:
    return F.struct(
        k1.cast("bigint").alias("k1"),
        k2.cast("bigint").alias("k2"),
        k3.cast("bigint").alias("k3"),
        k4.cast("bigint").alias("k4"),
        amount.alias("k5"),
    ).alias("txn_id")


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as expenses; their values are skewed, so outliers exist."""
    return events_as_ledger(table(spark, sf_dir, "events"))


def events_as_ledger(events: DataFrame) -> DataFrame:
    """Works on a stream of events too."""
    return events.select(
        F.col("event_id").alias("txn_id"),
        "user_id",
        to_money(F.col("value")).alias("amount"),
        F.col("event_type").alias("category"),
        F.concat_ws(" #", "event_type", F.col("event_id").cast("string")).alias("description"),
        F.lit("expense").alias("txn_type"),
        "ts",
    )


def mixed_event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events again, with signups and purchases read as income, so that both types alternate in a user."""
    return events_as_mixed_ledger(table(spark, sf_dir, "events"))


def events_as_mixed_ledger(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("category").isin("signup", "purchase"), "income").otherwise("expense")
    return events_as_ledger(events).withColumn("txn_type", kind)


def stretched(events: DataFrame, times: int = 20) -> DataFrame:
    """Events whose distance from the start of 2024 is multiplied, so that a month of them fills some years."""
    start = "TIMESTAMP_NTZ '2024-01-01'"
    later = F.expr(f"timestampadd(MICROSECOND, {times} * timestampdiff(MICROSECOND, {start}, CAST(ts AS TIMESTAMP_NTZ)), {start})")
    return events.withColumn("ts", later)


# Household names for the part types and order priorities of the test tables.
HOUSEHOLD_NAMES = {
    "STANDARD": "Groceries", "ECONOMY": "Dining", "MEDIUM": "Loan", "PROMO": "Shopping", "SMALL": "Stocks",
    "LARGE": "Housing", "1-URGENT": "Salary", "2-HIGH": "Freelance", "3-MEDIUM": "Investment",
    "4-NOT SPECIFIED": "Bonus", "5-LOW": "Refund",
}


def household_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star ledger with household category names, among them debts and investments."""
    names = [c for pair in HOUSEHOLD_NAMES.items() for c in pair]
    return star_ledger(spark, sf_dir).withColumn(
        "category", F.coalesce(F.create_map(*map(F.lit, names))[F.col("category")], "category")
    )


def statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The household ledger as raw statement text, with some unreadable amounts and dates.

    Signs as on a statement: income positive, expenses negative. A quantity of 50 gives a zero amount.
    """
    lines, orders = lines_of_orders(spark, sf_dir)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    spent = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(part, lines.l_partkey == part.p_partkey, "left")
    names = [c for pair in HOUSEHOLD_NAMES.items() for c in pair]
    household = F.create_map(*map(F.lit, names))
    price = to_money(F.col("l_extendedprice")).cast("string")
    line = F.col("l_linenumber")
    amount = (
        F.when((line == 7) & (F.col("l_returnflag") == "R"), F.concat(F.lit("$"), price))
        .when(F.col("l_quantity") == 1, "")
        .when(F.col("l_quantity") == 50, "0")
        .otherwise(F.concat(F.lit("-"), price))
    )
    date = (
        F.when(line == 3, F.date_format("l_shipdate", "yyyy-MM-dd"))
        .when(line == 5, "13/45/2024")
        .when((line == 6) & (F.col("l_returnflag") == "A"), "")
        .otherwise(F.date_format("l_shipdate", "MM/dd/yyyy"))
    )
    expense = spent.select(
        F.col("o_custkey").alias("user_id"),
        date.alias("Date"),
        F.concat_ws(" ", F.upper(household[F.col("p_type")]), "p_name", F.col("l_suppkey").cast("string")).alias(
            "Description"
        ),
        amount.alias("Amount"),
    )
    income = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("Date"),
        F.concat(F.upper(household[F.col("o_orderpriority")]), F.lit(" DEPOSIT")).alias("Description"),
        to_money(F.col("o_totalprice")).cast("string").alias("Amount"),
    )
    return income.unionByName(expense)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.when(segment == "BUILDING", "gig").when(segment == "HOUSEHOLD", "informal").otherwise("formal").alias(
            "employment_type"
        ),
        F.when(balance < 0, "conservative")
        .when(balance < 5000, "moderate")
        .when(balance < 9000, "aggressive")
        .otherwise("high")
        .alias("risk_tolerance"),
    )


def debts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = lines_of_orders(spark, sf_dir)
    price = to_money(F.col("l_extendedprice"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        _star_id(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), price).alias(
            "debt_id"
        ),
        price.alias("amount"),
        (price * F.col("l_tax").cast("decimal(6,4)")).cast(MONEY).alias("monthly_payment"),
        F.col("l_discount").alias("interest_rate"),
    )


def task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_tasks(table(spark, sf_dir, "events"))


def events_as_tasks(events: DataFrame) -> DataFrame:
    """One finished task per event. An error event names an agent that does not exist."""
    kind, ok = F.col("event_type"), F.col("value") < 100
    return events.select(
        F.col("event_id").alias("task_id"),
        "user_id",
        F.when(kind == "click", "financial")
        .when(kind == "view", "research")
        .when(kind == "purchase", "productivity")
        .when(kind == "signup", "learning")
        .otherwise("unknown")
        .alias("agent_type"),
        ok.alias("success"),
        "ts",
        F.col("props").alias("result"),
        "value",
    )


def workflow_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per workflow step: the turns of a conversation, its roles read as agents.

    A `system` turn names no known agent and so fails its workflow.
    """
    role = F.col("role")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("workflow_id"),
        F.col("turn").alias("step"),
        F.when(role == "user", "financial").when(role == "assistant", "research").otherwise(role).alias("agent_type"),
        (F.length("text") >= 40).alias("success"),
        F.col("text").alias("result"),
    )
