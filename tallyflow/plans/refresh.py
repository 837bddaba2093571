"""Reports kept up to date: what a batch adds to a user's cells is stored, and only users of the batch get a new report.

The numbers of a report come from sums by category and day, which add up over batches, and so do outliers, but for those of cells
that hold more amounts than their sums tell. A refresh reads the stored cells of the touched users, and of the ledger the rows of
such groups alone. Reports are a table of last values by user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyflow.operators.skew import SPLIT_ROWS
from tallyflow.plans.report import anomalies_of, cell_sums, merged_cells, outlying_groups, report_from_cells
from tallyflow.session import stored_bytes
from tallyflow.streaming.additive import read_merged, write_part
from tallyflow.streaming.keyed import COMPACT_EVERY, parts_before, read_keyed, write_keyed

# A batch below this part of the stored cells is small: other users' cells are left out before any are shuffled.
SMALL_BATCH = 8


def refresh_reports(batch: DataFrame, ledger: DataFrame, profiles: DataFrame, path: str, batch_id: int, every: int = COMPACT_EVERY, split_rows: int = SPLIT_ROWS) -> None:
    """Bring the stored reports up to a batch of new rows, which the ledger already holds. A batch that is run again changes nothing.

    `ledger` should be read with the users' rows pruned as far as its layout allows; it is read only where a touched user's cells don't
    tell how many outliers there are. The users are read from the stored cells of the batch, so that the batch itself is read once.
    """
    spark, part = batch.sparkSession, f"{path}/cells/batch={batch_id}"
    write_part(cell_sums(batch), f"{path}/cells", merged_cells, batch_id, every)
    users = spark.read.parquet(part).select("user_id").distinct()
    cells = read_merged(spark, f"{path}/cells", lambda parts: parts, batch_id + 1)
    stored = sum(stored_bytes(spark, p) for _, p in parts_before(spark, f"{path}/cells", batch_id + 1))
    if stored_bytes(spark, part) * SMALL_BATCH < stored:
        cells = cells.join(users, "user_id", "left_semi")
    else:
        # most users are touched: cells are laid out by user once, and the users are met there
        cells = cells.repartition("user_id").join(users.hint("shuffle_hash"), "user_id")
    outlying_groups(cells).write.mode("overwrite").parquet(f"{path}/outlying")
    groups = spark.read.parquet(f"{path}/outlying")
    untold = None if groups.filter("untold").isEmpty() else ledger
    write_keyed(report_from_cells(cells, anomalies_of(groups, untold, split_rows), profiles), f"{path}/reports", ["user_id"], batch_id, every)


def stored_reports(spark, path: str) -> DataFrame | None:
    """The last report of every user, as `comprehensive_report` over the whole ledger gives it; None before the first batch."""
    return read_keyed(spark, f"{path}/reports", ["user_id"])
