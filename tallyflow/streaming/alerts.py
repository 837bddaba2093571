"""Alerts per arriving transaction, from the user's 30 latest rows by date among those that have arrived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyflow.functions.money import wall_micros
from tallyflow.operators.skew import with_carried_rows
from tallyflow.streaming.keyed import read_keyed, write_keyed

DEPTH = 30
DAY = 86_400_000_000
#: A row as it is held; time and id come first, so that rows sort by them.
ROW = ["micros", "txn_id", "category", "txn_type", "cents"]
HELD = "user_id long, held array<struct<micros: bigint, txn_id: bigint, category: string, txn_type: string, cents: bigint>>"


def arrivals(ledger: DataFrame) -> DataFrame:
    """Transactions in the shape in which they are held: wall-clock microseconds and whole cents."""
    return ledger.select(
        "user_id",
        wall_micros("ts").cast("bigint").alias("micros"),
        F.col("txn_id").cast("bigint").alias("txn_id"),
        "category",
        "txn_type",
        (F.col("amount") * 100).cast("bigint").alias("cents"),
    )


def _spike(recent: Column) -> tuple[Column, Column, Column]:
    """Whether the row's cents are above mean + 2 population sd of its category's recent expenses, with their mean."""
    same = F.filter(recent, lambda r: (r["txn_type"] == "expense") & r["category"].eqNullSafe(F.col("category")))
    exact = "decimal(38,0)"
    n = F.size(same).cast(exact)
    zero = F.lit(0).cast(exact)
    total = F.aggregate(same, zero, lambda s, r: (s + r["cents"]).cast(exact))
    squares = F.aggregate(same, zero, lambda s, r: (s + r["cents"].cast(exact) * r["cents"]).cast(exact))
    excess = (n * F.col("cents") - total).cast(exact)
    spread = (n * squares).cast(exact) - (total * total).cast(exact)
    found = (F.size(same) >= 3) & (excess > 0) & ((excess * excess).cast(exact) > (F.lit(4) * spread).cast(exact))
    return found, F.col("cents") / F.lit(100.0), total.cast("double") / F.lit(100.0) / F.size(same)


def _gap(recent: Column) -> tuple[Column, Column]:
    """Whether the mean of the whole days between successive recent incomes is above 14, and that mean."""
    times = F.transform(F.filter(recent, lambda r: r["txn_type"] == "income"), lambda r: r["micros"])
    gaps = F.zip_with(F.slice(times, 2, DEPTH), times, lambda b, a: F.floor((b - a) / F.lit(DAY)))
    known = F.filter(gaps, lambda g: g.isNotNull())
    days = F.aggregate(known, F.lit(0).cast("bigint"), lambda s, g: s + g).cast("double") / F.greatest(F.size(known), F.lit(1))
    return (F.size(times) >= 3) & (days > 14), days


def judged(batch: DataFrame, held: DataFrame | None, chunk_days: int = 30) -> DataFrame:
    """Alerts of a batch of arrivals, given each user's rows held from earlier batches.

    A user's rows count as arriving by (time, id). The 30 latest rows then are the held rows after the row, which is back-dated
    against them, and before these the latest of the held and arrived rows up to it; a row with 30 held rows after it is judged
    without being among them. A user's rows are windowed by chunks of `chunk_days` days, each with the 29 rows before it, so
    the result depends neither on the size of a user nor on how rows are laid out.
    """
    spark = batch.sparkSession
    held = spark.createDataFrame([], HELD) if held is None else held
    before = held.select("user_id", F.explode("held").alias("r")).select("user_id", "r.*", F.lit(False).alias("arrived"))
    both = before.unionByName(batch.select("user_id", *ROW).withColumn("arrived", F.lit(True)))
    chunked = both.withColumn("chunk", F.floor(F.col("micros") / F.lit(chunk_days * DAY)))
    framed = with_carried_rows(chunked, "user_id", ["micros", "txn_id"], DEPTH - 1)
    latest = Window.partitionBy("user_id", "chunk").orderBy("micros", "txn_id").rowsBetween(-(DEPTH - 1), Window.currentRow)
    placed = framed.withColumn("_upto", F.collect_list(F.struct(*ROW)).over(latest)).filter("arrived AND NOT carried")
    joined = placed.join(held, "user_id", "left")
    here = F.struct("micros", "txn_id")
    after = F.filter(F.coalesce("held", F.array().cast(HELD.split("held ")[1])), lambda r: F.struct(r["micros"], r["txn_id"]) > here)
    room = F.lit(DEPTH) - F.size("_after")
    upto = F.filter("_upto", lambda r, i: i >= F.size("_upto") - room)
    known = joined.withColumn("_after", after).withColumn("_recent", F.concat(upto, F.col("_after")))
    spike, value, mean = _spike(F.col("_recent"))
    gap, days = _gap(F.col("_recent"))
    enough = F.size("_recent") >= 5
    spiked = enough & (F.col("txn_type") == "expense") & spike
    gapped = enough & (F.col("txn_type") == "income") & gap
    return known.withColumns({"_spiked": spiked, "_gapped": gapped}).filter("_spiked OR _gapped").select(
        "user_id",
        "txn_id",
        F.when(F.col("_spiked"), "spending_pattern").otherwise("income_alert").alias("alert"),
        F.when(F.col("_spiked"), "high").otherwise("medium").alias("priority"),
        F.when(F.col("_spiked"), F.col("category")).alias("category"),
        F.when(F.col("_spiked"), value).otherwise(days).alias("value"),
        F.when(F.col("_spiked"), mean).otherwise(F.lit(14.0)).alias("reference"),
    )


def held_after(batch: DataFrame, held: DataFrame | None) -> DataFrame:
    """The 30 latest rows of each user of the batch. The rank filter limits a user's rows before the shuffle too."""
    rows = batch.select("user_id", *ROW)
    if held is not None:
        mine = held.join(rows.select("user_id").distinct(), "user_id", "left_semi")
        rows = rows.unionByName(mine.select("user_id", F.explode("held").alias("r")).select("user_id", "r.*"))
    newest = Window.partitionBy("user_id").orderBy(F.col("micros").desc(), F.col("txn_id").desc())
    latest = rows.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= DEPTH)
    return latest.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(*ROW))).alias("held"))


def alert_batch(ledger: DataFrame, batch_id: int, path: str, state: str) -> None:
    """Write one batch's alerts and the rows held after it. Running it again overwrites both from the state before it."""
    batch = arrivals(ledger).persist()
    try:
        held = read_keyed(ledger.sparkSession, state, ["user_id"], before=batch_id)
        judged(batch, held).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        write_keyed(held_after(batch, held), state, ["user_id"], batch_id)
    finally:
        batch.unpersist()


def start_alerts(ledger: DataFrame, path: str, checkpoint: str, state: str | None = None, **trigger) -> StreamingQuery:
    """Spike and income-gap alerts of a stream of transactions, as parquet files below `path`, each exactly once.

    The rows held for each user are a table at `state`, beside the alerts by default.
    """
    state = state or path.rstrip("/") + "-held"
    return (
        ledger.writeStream.foreachBatch(lambda batch, batch_id: alert_batch(batch, batch_id, path, state))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
