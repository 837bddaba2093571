"""Bank statements: reading CSV files, mapping columns, normalising rows, separating bad ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyflow.functions.categorize import type_from_column, type_from_sign, with_category
from tallyflow.functions.money import MONEY, is_expense, is_income, sum_where

# Header words by field, most telling first. The first header that contains one of them is taken.
HEADER_WORDS = {
    "date": ("date", "posted", "time"),
    "debit": ("debit", "withdrawal", "paid out", "money out"),
    "credit": ("credit", "deposit", "paid in", "money in"),
    "amount": ("amount", "value", "sum"),
    "description": ("description", "memo", "narrative", "payee", "merchant", "vendor", "particulars", "details", "name"),
    "type": ("type",),
    "category": ("category",),
}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
# Two-digit years from here on belong to the last century.
PIVOT = 69


def read_statements(spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """All statement CSVs below a path, every column as text, with the file, the block of it and the line order.

    Give `columns` to skip reading a header for the schema. Large files are split. With `multi_line` a quoted field may hold
    line breaks; a file is then read by one task.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    return (
        reader.csv(path)
        .withColumn("file", F.col("_metadata.file_path"))
        .withColumn("block", F.col("_metadata.file_block_start"))
        .withColumn("line", F.monotonically_increasing_id())
    )


def default_mapping(columns: list[str]) -> dict[str, str]:
    """Field to header, by the words above; fields without a header are absent.

    Debit and credit columns are taken only where no header names the amount.
    """
    mapping = {}
    for field, words in HEADER_WORDS.items():
        match = next((c for w in words for c in columns if w in c.lower() and c not in mapping.values()), None)
        if match:
            mapping[field] = match
    named = [c for w in HEADER_WORDS["amount"] for c in columns if w in c.lower() and c != mapping.get("date")]
    pair = [mapping.get(f) for f in ("debit", "credit")]
    single = next((c for c in named if c not in pair), None)
    if single or not any(pair):
        mapping.pop("debit", None)
        mapping.pop("credit", None)
        if single:
            mapping["amount"] = single
    else:
        mapping.pop("amount", None)
    return mapping


def with_date(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add the parsed date as timestamp_ntz; NULL if the text is no date.

    The time of day, with or without seconds and AM or PM, is cut off first. Eight digits are year, month, day. With a month name
    the year is the number of four digits, else the last one; otherwise the year is the part of four digits, else the last one, and
    the month comes first unless it exceeds 12. Years of two digits are 1969 to 2068. What comes out is put into
    year-month-day order and cast, which fails without raising; other texts are cast as they are. Each step is
    a column of its own, so that a text is read once.
    """
    clock = r"(?i)[T, ]+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*([ap])?\.?(?:m\.?)?$"
    month_names = "(?i)(?<![a-z])(" + "|".join(MONTHS) + ")[a-z]*"
    trimmed = F.trim(text)
    found = [F.regexp_extract("_text", clock, i) for i in (1, 2, 3, 4)]
    hour = found[0].cast("int")
    half = F.lower(found[3])
    hours = F.when(half == "p", hour % 12 + 12).when(half == "a", hour % 12).otherwise(hour)
    valid = (half == "") | hour.between(1, 12)
    seconds = F.when(found[2] == "", "00").otherwise(found[2])
    time = F.when(found[0] != "", F.when(valid, F.concat_ws(":", hours.cast("string"), found[1], seconds))).otherwise("00:00:00")
    numbers = F.regexp_extract_all("_day", F.lit(r"\d+"), F.lit(0))
    digits = F.col("_day").rlike(r"^\d{8}$")
    compact = F.array(F.substring("_day", 1, 4), F.substring("_day", 5, 2), F.substring("_day", 7, 2))
    part = [F.try_element_at("_parts", F.lit(i)) for i in (1, 2, 3)]
    count = F.size("_parts")
    year_first = F.length(part[0]) == 4
    named = F.col("_month") > 0
    swapped = part[0].try_cast("int") > 12
    year = F.when(year_first, part[0]).when(named, part[1]).otherwise(part[2])
    number = year.try_cast("int")
    full = F.when(F.length(year) == 2, number + F.when(number >= PIVOT, 1900).otherwise(2000)).when(F.length(year) == 4, number)
    month = F.when(named, F.col("_month")).when(year_first | swapped, part[1].try_cast("int")).otherwise(part[0].try_cast("int"))
    day = F.when(named, F.when(year_first, part[1]).otherwise(part[0])).when(year_first, part[2]).when(swapped, part[0]).otherwise(part[1])
    date = F.concat_ws("-", full.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    whole = full.isNotNull() & month.isNotNull() & day.isNotNull() & F.col("_time").isNotNull()
    put = F.when(whole & (count == F.when(named, 2).otherwise(3)), F.concat_ws(" ", date, "_time").try_cast("timestamp_ntz"))
    as_is = F.when(F.col("_month") == 0, F.col("_text").try_cast("timestamp_ntz"))
    steps = rows.withColumn("_text", trimmed).withColumn("_day", F.regexp_replace("_text", clock, "")).withColumn("_time", time)
    names = F.array(*[F.lit(m) for m in MONTHS])
    steps = steps.withColumn("_month", F.array_position(names, F.lower(F.regexp_extract("_day", month_names, 1))).cast("int"))
    steps = steps.withColumn("_parts", F.when(digits, compact).otherwise(numbers))
    return steps.withColumn(name, F.coalesce(put, as_is)).drop("_text", "_day", "_time", "_month", "_parts")


def _amount_text(field, mapping: dict[str, str]) -> Column:
    """What the statement says about the amount."""
    if "amount" in mapping:
        return field("amount")
    return F.concat_ws(" ", *[F.when(F.trim(field(f)) != "", field(f)) for f in ("debit", "credit")])


def _signed(field, mapping: dict[str, str]) -> Column:
    """The amount with its sign; NULL if it is blank or no number."""
    if "amount" in mapping:
        return F.trim(field("amount")).try_cast(MONEY)
    blank = {f: F.coalesce(F.trim(field(f)), F.lit("")) == "" for f in ("debit", "credit")}
    side = {f: F.when(blank[f], F.lit(0).cast(MONEY)).otherwise(F.abs(F.trim(field(f)).try_cast(MONEY))) for f in blank}
    return F.when(~(blank["debit"] & blank["credit"]), (side["credit"] - side["debit"]).cast(MONEY))


def normalise(raw: DataFrame, mapping: dict[str, str], as_of: str, split_columns: list[str] | None = None) -> DataFrame:
    """Typed rows with `error`, NULL for a good row.

    The type comes from a mapped type column, else from the sign of the amount, else (zero) from the words of
    the description. Amounts become absolute and are rounded to cents, half up. With debit and credit columns the amount is the
    credit less the debit, whatever the sign it is written with. A date that cannot be read becomes `as_of`; a blank date, and an
    amount that is blank or no plain number, is an error. `split_columns` are kept as they are.
    """
    kept = [c for c in (split_columns or ("user_id", "file", "block", "line")) if c in raw.columns]

    def field(name: str) -> Column:
        return F.col(f"`{mapping[name]}`") if name in mapping else F.lit(None).cast("string")

    typed = raw.select(
        *kept,
        F.coalesce(field("description"), F.lit("")).alias("description"),
        _amount_text(field, mapping).alias("_amount_text"),
        _signed(field, mapping).alias("_signed"),
        field("date").alias("_date_text"),
        field("type").alias("_type_text"),
        field("category").alias("_own_category"),
    ).withColumn("_lowered", F.lower("description"))
    kind = type_from_column(F.col("_type_text")) if "type" in mapping else type_from_sign(F.col("_signed"), F.col("_lowered"))
    blank_date = F.coalesce(F.trim("_date_text"), F.lit("")) == ""
    error = F.when(
        F.col("_signed").isNull(),
        F.concat(F.lit("could not convert to a number: '"), F.coalesce("_amount_text", F.lit("")), F.lit("'")),
    ).when(blank_date, F.lit("no date"))
    rows = with_date(typed, "_date_text", "_date").withColumns(
        {
            "txn_type": kind,
            "amount": F.abs("_signed"),
            "ts": F.coalesce(F.col("_date"), F.lit(as_of).cast("timestamp_ntz")),
            "error": error,
        }
    )
    named = with_category(rows, own_category="_own_category" if "category" in mapping else None)
    return named.select(*kept, "ts", "description", "amount", "txn_type", "category", "error")


def good_rows(normalised: DataFrame) -> DataFrame:
    return normalised.filter("error IS NULL").drop("error")


def row_errors(normalised: DataFrame) -> DataFrame:
    """Every error with its row number in the file, counted from 1.

    Lines of a block of a file follow one another, so a row's number is its distance from the first line of its block plus
    the rows of the file's earlier blocks: no file is put in order, and good rows are only counted.
    """
    rows = normalised if "block" in normalised.columns else normalised.withColumn("block", F.lit(0))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg(F.min("line").alias("_first"), F.count("*").alias("_n"))
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    bad = rows.filter("error IS NOT NULL").select("file", "block", "line", "error")
    row = F.col("line") - F.col("_first") + F.col("_before") + 1
    return bad.join(blocks, ["file", "block"]).select("file", row.alias("row"), "error")


def import_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and totals of the good rows, with what would be saved; overall or by the given columns."""
    amount = F.col("amount")
    out = rows.groupBy(*(by or [])).agg(
        F.count("*").alias("total_transactions"),
        sum_where(is_income(), amount).alias("total_income"),
        sum_where(is_expense(), amount).alias("total_expenses"),
        F.count_if(is_income()).alias("income_count"),
        F.count_if(is_expense()).alias("expense_count"),
    )
    return out.withColumn("savings", F.col("total_income") - F.col("total_expenses"))


def confirmed(rows: DataFrame, as_of: str) -> DataFrame:
    """Rows a user confirmed: text date yyyy-MM-dd and numeric text, a bad date becomes `as_of`."""
    date = F.try_to_timestamp(F.col("date"), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    return rows.select(
        "user_id",
        F.col("amount").cast(MONEY).alias("amount"),
        "category",
        "description",
        F.col("type").alias("txn_type"),
        F.coalesce(date, F.lit(as_of).cast("timestamp_ntz")).alias("ts"),
    )
