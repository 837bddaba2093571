"""Records of CSV files as text, with their row numbers and byte positions, and their fields or what is wrong with them.

A file is read in splits, also where quoted fields hold line breaks. Whether a line begins within a quoted field depends on whether the number
of quotation marks before it in the file is odd, and no split knows that alone. So each split reports its parity, its bytes, and how many
records begin in it for either state at its start; a scan over the few rows of a file's splits gives each its true state, first record and
byte position; and only the lines of records that go over several lines are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns that stand beside a record's fields.
PLACE = ("file", "row", "position")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, text) of all lines below a path; ``line`` gives their order within a block. Lines end at a line feed."""
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            F.col("value").alias("text"),
        )
    )


def _states(lines: DataFrame) -> DataFrame:
    """Per block: whether it begins within quotes, the records that begin in earlier blocks of the file, and its first byte."""
    even = F.col("_odd") == 0
    blocks = lines.groupBy("file", "block").agg(
        F.sum("_marks").alias("marks"),
        F.sum("_bytes").alias("bytes"),
        F.count_if(even).alias("begin_outside"),  # records that begin here if the block begins outside quotes
        F.count_if(~even).alias("begin_within"),
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    blocks = blocks.withColumn("_within", before("marks") % 2).withColumn("_position", before("bytes"))
    begun = F.when(F.col("_within") == 0, F.col("begin_outside")).otherwise(F.col("begin_within"))
    return blocks.withColumn("_begun", begun).withColumn("_records", before("_begun")).select("file", "block", "_within", "_position", "_records")


def read_records(spark: SparkSession, path: str, multi_line: bool = False, mark: str = '"') -> DataFrame:
    """(file, row, position, text, closed) of all records below a path.

    ``row`` counts from 0, the header included; ``position`` is the record's first byte in the file. With ``multi_line`` a line feed
    between quotation marks belongs to the field; marks may then stand nowhere but around fields and, doubled, in them. Otherwise each
    line is a record. ``closed`` says whether the record's last quotation mark is a closing one. Blank lines outside fields are no
    records, but they are counted as rows. A carriage return at the end of a record is left out. Files end with a line feed or
    without; a byte order mark does not count.
    """
    lines = read_lines(spark, path).withColumns(
        {"_marks": F.length("text") - F.length(F.replace("text", F.lit(mark), F.lit(""))), "_bytes": F.octet_length("text") + 1}
    )
    in_order = Window.partitionBy("file", "block").orderBy("line")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    lines = lines.withColumn("_odd", so_far("_marks") % 2 if multi_line else F.lit(0).cast("bigint")).withColumn("_at", so_far("_bytes"))
    if not multi_line:
        lines = lines.withColumn("_all", F.col("_marks")).withColumn("_marks", F.lit(0).cast("bigint"))
    placed = lines.join(_states(lines), ["file", "block"])
    begins = (F.col("_odd") + F.col("_within")) % 2 == 0
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_begins", begins).select(
        "file",
        (F.col("_records") + F.sum(F.col("_begins").cast("int")).over(upto) - 1).alias("row"),
        (F.col("_position") + F.col("_at")).alias("position"),
        "text",
        "_begins",
        ((F.col("_odd") + F.col("_within") + F.col("_marks")) % 2 == 0).alias("_ends"),
        (F.col("_all") % 2 == 0 if not multi_line else F.lit(True)).alias("_closed"),
    )
    trimmed = F.regexp_replace("text", "\r$", "")
    single = placed.where("_begins AND _ends").select("file", "row", "position", trimmed.alias("text"), F.col("_closed").alias("closed"))
    if multi_line:
        parts = placed.where("NOT (_begins AND _ends)").groupBy("file", "row")
        joined = parts.agg(
            F.min("position").alias("position"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda p: p["text"]), "\n").alias("text"),
            F.bool_or("_ends").alias("closed"),
        )
        single = single.unionByName(joined.withColumn("text", trimmed))
    return single.where(F.trim("text") != "")


def parse_records(records: DataFrame, columns: list[str], header: bool = True, separator: str = ",") -> DataFrame:
    """The fields of records as text, their place (``file``, ``row`` from 1 for the first after the header, ``position``), and
    ``record_error``, NULL for a good record: an open quotation mark, or too few or too many fields. A bad record's fields are NULL
    and its text is in ``bad_record``."""
    schema = ", ".join(f"`{c}` string" for c in columns) + ", _bad_record string"
    options = {"sep": separator, "escape": '"', "columnNameOfCorruptRecord": "_bad_record", "mode": "PERMISSIVE", "multiLine": "true"}
    if header:
        records = records.where("row > 0")
    parsed = records.withColumn("_fields", F.from_csv("text", schema, options))
    error = F.when(~F.col("closed"), "open quotation mark").when(F.col("_fields._bad_record").isNotNull(), f"not {len(columns)} fields")
    parsed = parsed.withColumn("record_error", error)
    good = F.col("record_error").isNull()
    row = F.col("row") if header else F.col("row") + 1
    return parsed.select(
        "file", row.alias("row"), "position", *[F.when(good, F.col("_fields").getField(c)).alias(c) for c in columns],
        "record_error", F.when(~good, F.col("text")).alias("bad_record"),
    )


def with_record_errors(normalised: DataFrame, records: DataFrame, error: Column | str = "record_error") -> DataFrame:
    """Errors of an import by place: those of records that could not be parsed, and those of rows that could not be read."""
    unread = records.where(F.col(error).isNotNull()).select(*PLACE, F.col(error).alias("error"))
    return normalised.where("error IS NOT NULL").select(*PLACE, "error").unionByName(unread)
