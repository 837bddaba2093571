"""The comprehensive report: spending, income, health, recommendations, predictions and risks per user.

One aggregate by category and day, laid out by user, gives the sums by category, month, day and month of the year that feed every
number of a user; outlying rows take passes of their own, joined to the few groups that can hold any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions import fixed_values as fv
from tallyflow.functions import moments, scoring
from tallyflow.functions.money import MONEY, is_expense, is_income, ratio
from tallyflow.functions.trend import slope, value_at
from tallyflow.operators.anomaly import category_outliers
from tallyflow.operators.health import with_profile, with_rates
from tallyflow.operators.skew import SPLIT_ROWS, attach_group_stats

KEYS = ("category", "month", "day", "season")


def cell_sums(ledger: DataFrame) -> DataFrame:
    """Sums by user, type, category and day. Those of parts of a ledger add up, see `merged_cells`; those by one key are made of
    them, see `_placed`."""
    n, s, q = moments.sums(F.col("amount"))
    rows = ledger.select("user_id", "txn_type", "category", F.to_date("ts").alias("day"), "amount")
    return rows.groupBy("user_id", "txn_type", "category", "day").agg(n.alias("n"), s.alias("total"), q.alias("q"), F.max("amount").alias("largest"))


def merged_cells(cells: DataFrame) -> DataFrame:
    """Cells of several parts as those of the whole."""
    return _added(cells, "user_id", "txn_type", "category", "day").select(*cells.columns)


def _added(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "total", "q")], F.max("largest").alias("largest"))


def _placed(cells: DataFrame, expense: tuple[str, ...] = KEYS, income: tuple[str, ...] = KEYS) -> DataFrame:
    """Sums by user, type and each of KEYS in turn, or of those named for a type; other types have the first alone. `by` names the
    key: the category, or else `at`, which is a month by its first day, a day (both in days since 1970) or a season by its month.

    The cells are laid out by user first, so that this and what follows needs no more shuffles; a user has at most one for each
    type, category and day.
    """
    at = {"month": F.unix_date(F.trunc("day", "month")), "day": F.unix_date("day"), "season": F.month("day")}
    none = F.lit(None)
    one = {
        k: F.struct(F.lit(k).alias("by"), (F.col(k) if k == "category" else none.cast("string")).alias("category"), at.get(k, none.cast("int")).alias("at"))
        for k in KEYS
    }
    chosen = lambda keys: F.array(*[one[k] for k in keys])
    keys = F.when(is_expense(), chosen(expense)).when(is_income(), chosen(income)).otherwise(chosen(KEYS[:1]))
    each = cells.repartition("user_id").select("user_id", "txn_type", "n", "total", F.inline(keys))
    return each.groupBy("user_id", "txn_type", "by", "category", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


# What a report lists of each type, in the order in which a user's list has them.
LISTS = {"expense": ("category", "month", "day"), "income": ("category", "month", "season")}


def _lists(cells: DataFrame) -> DataFrame:
    """Per user an array for each of LISTS, named type_key: structs of category, at, n and total in order of the key.

    They are gathered as one list, sorted once and cut by their sizes. Lists and statistics gathered each for itself take many times
    as long, as every row then meets every one of them.
    """
    names = [(kind, key) for kind, keys in LISTS.items() for key in keys]
    number = F.coalesce(*[F.when((F.col("txn_type") == kind) & (F.col("by") == key), i) for i, (kind, key) in enumerate(names)])
    rows = _placed(cells, **LISTS).select("user_id", number.alias("list"), "category", "at", "n", "total")
    entry = F.when(F.col("list").isNotNull(), F.struct("list", "category", "at", "n", "total"))
    sizes = [F.count_if(F.col("list") == i).cast("int").alias(f"_{i}") for i in range(len(names))]
    per_user = rows.withColumn("entry", entry).groupBy("user_id").agg(F.collect_list("entry").alias("entries"), *sizes)
    per_user = per_user.withColumn("entries", F.sort_array("entries"))
    start = lambda i: sum((F.col(f"_{j}") for j in range(i)), F.lit(1))
    return per_user.select("user_id", *[F.slice("entries", start(i), F.col(f"_{i}")).alias(f"{kind}_{key}") for i, (kind, key) in enumerate(names)])


def _known(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def _folded(pairs: Column) -> Column:
    """Means and squared deviations of the y of an array of structs (x, y), and their products with those of x, in one pass.

    A deviation is that from the mean so far, as in Spark's own aggregates, so equal values have deviations of exactly 0.
    """
    names = ("n", "x", "y", "m2", "xx", "yy", "xy")

    def step(acc: Column, p: Column) -> Column:
        n, dx, dy = acc["n"] + 1.0, p["x"] - acc["x"], p["y"] - acc["y"]
        x, y = acc["x"] + dx / n, acc["y"] + dy / n
        values = (n, x, y, acc["m2"] + dy * (dy - dy / n), acc["xx"] + dx * (p["x"] - x), acc["yy"] + dy * (p["y"] - y), acc["xy"] + dx * (p["y"] - y))
        return F.struct(*[v.alias(name) for name, v in zip(names, values)])

    return F.aggregate(pairs, F.struct(*[F.lit(0.0).alias(name) for name in names]), step)


def _sd(folded: Column) -> Column:
    """Sample deviation, NULL below two values."""
    return F.when(folded["n"] > 1, F.sqrt(folded["m2"] / (folded["n"] - 1.0)))


def _r_squared(folded: Column) -> Column:
    """NULL below two values, 1 for a constant series."""
    flat = F.when(folded["yy"] == 0, 1.0).otherwise(folded["xy"] * folded["xy"] / (folded["xx"] * folded["yy"]))
    return F.when(folded["xx"] > 0, flat)


def _quantile(values: Column, share: float) -> Column:
    """Of a sorted array, with interpolation; NULL of an empty one."""
    place = (F.size(values) - 1) * F.lit(share)
    low, high = (F.get(values, f(place).cast("int")) for f in (F.floor, F.ceil))
    return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)


def _summed(values: Column, kind: str) -> Column:
    """Exact sum of an array without NULLs, NULL of an empty one."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0).cast(kind), lambda acc, v: (acc + v).cast(kind)))


def _numbers(cells: DataFrame) -> DataFrame:
    """Per user: totals, monthly statistics, trend lines, maps and daily totals."""
    zero, wide = F.lit(0).cast(MONEY), "decimal(38,2)"
    mean = lambda e: e["total"].cast("double") / e["n"]
    lists = _lists(cells)
    by_type = (("income", "income"), ("expense", "expenses"))
    for kind, prefix in by_type:
        # the place x of a month counts all months with rows, also those that have no amount
        placed = F.transform(f"{kind}_month", lambda e, x: F.struct(x.alias("x"), e["total"].alias("total")))
        lists = lists.withColumn(f"_{prefix}", F.filter(placed, lambda p: p["total"].isNotNull()))
    for _, prefix in by_type:
        pairs = F.transform(f"_{prefix}", lambda p: F.struct(p["x"].cast("double").alias("x"), p["total"].cast("double").alias("y")))
        lists = lists.withColumns({
            f"_{prefix}_y": F.transform(f"_{prefix}", lambda p: p["total"].cast("double")),
            f"_{prefix}_sum": _summed(F.transform(f"_{prefix}", lambda p: p["total"]), wide),
            f"_{prefix}_fold": _folded(pairs),
        })
    means = F.transform("income_season", lambda e: F.struct(e["at"].alias("season"), mean(e).alias("mean")))
    lists = lists.withColumns({
        "days": F.array_sort(_known(F.transform("expense_day", lambda e: e["total"].cast("double")))),
        "_seasons": F.filter(means, lambda m: m["mean"].isNotNull()),
    })
    by_season = F.transform("_seasons", lambda m: F.struct(F.lit(0.0).alias("x"), m["mean"].alias("y")))
    lists = lists.withColumns({"seasons": F.size("_seasons"), "_season_fold": _folded(by_season)})
    season_sum = F.aggregate("_seasons", F.lit(0.0), lambda acc, m: acc + m["mean"])

    def monthly(kind: str, prefix: str) -> list[Column]:
        fold, total, months = F.col(f"_{prefix}_fold"), F.col(f"_{prefix}_sum"), F.size(f"_{prefix}")
        line = F.transform(f"_{prefix}", lambda p: (p["x"] * p["total"]).cast(wide))
        return [
            F.coalesce(total, zero).alias(f"total_{prefix}"),
            F.aggregate(f"{kind}_month", F.lit(0).cast("bigint"), lambda acc, e: acc + e["n"]).alias(f"n_{prefix}"),
            months.cast("bigint").alias(f"{prefix}_months"),
            _summed(line, wide).alias(f"{prefix}_sxy"),
            (total.cast("double") / F.nullif(months, F.lit(0))).alias(f"{prefix}_mean"),
            _sd(fold).alias(f"{prefix}_sd"),
            F.array_min(f"_{prefix}_y").alias(f"{prefix}_low"),
            F.array_max(f"_{prefix}_y").alias(f"{prefix}_high"),
            _r_squared(fold).alias(f"{prefix}_r2"),
        ]

    analysis = lambda e: F.struct(e["total"].alias("sum"), e["n"].alias("count"), mean(e).alias("mean"))
    named = lambda e: F.date_format(F.date_from_unix_date(e["at"]), "yyyy-MM")
    entries = lambda name, key, value: F.map_from_entries(F.transform(name, lambda e: F.struct(key(e), value(e))))
    category, total = (lambda e: e["category"]), (lambda e: e["total"])
    per_user = lists.select(
        "user_id",
        *[c for names in by_type for c in monthly(*names)],
        F.size("expense_category").cast("bigint").alias("n_categories"),
        F.array_min(F.transform("expense_category", lambda e: F.struct((-e["total"]).alias("minus"), e["category"].alias("category")))).alias("top"),
        entries("expense_category", category, analysis).alias("category_analysis"),
        entries("income_category", category, total).alias("income_sources"),
        entries("expense_month", named, total).alias("monthly_trends"),
        _quantile(F.col("days"), 0.9).alias("day_threshold"),
        "days",
        "seasons",
        ratio(_sd(F.col("_season_fold")), season_sum / F.nullif(F.col("seasons"), F.lit(0))).alias("season_cv"),
        F.array_sort(F.transform("_seasons", lambda m: F.struct((-m["mean"]).alias("key"), m["season"].alias("season")))).alias("high_first"),
        F.array_sort(F.transform("_seasons", lambda m: F.struct(m["mean"].alias("key"), m["season"].alias("season")))).alias("low_first"),
    )
    volatility = F.when(F.col("income_months") >= 2, ratio(F.col("income_sd"), F.col("income_mean"))).otherwise(0.0)
    return with_rates(per_user).withColumn("volatility", volatility)


def _line(prefix: str) -> tuple[Column, Column, Column]:
    return F.col(f"{prefix}_months"), F.col(f"total_{prefix}"), F.col(f"{prefix}_sxy")


def _enough(prefix: str, value: Column) -> Column:
    """NULL below three months."""
    return F.when(F.col(f"{prefix}_months") >= 3, value)


def _next_months(prefix: str) -> Column:
    """The three predicted values; the first lies one month further than the month after the last."""
    n, sy, sxy = _line(prefix)
    return _enough(prefix, F.array(*[value_at(n + k, n, sy, sxy) for k in (1, 2, 3)]))


def _direction(prefix: str, flat: str) -> Column:
    rise = slope(*_line(prefix))
    text = F.when(rise > 0, "increasing").when(rise < 0, "decreasing").otherwise(flat)
    return F.coalesce(_enough(prefix, text), F.lit("insufficient_data"))


def _fit(prefix: str) -> Column:
    """A constant series has r squared 1."""
    return _enough(prefix, F.coalesce(f"{prefix}_r2", F.lit(1.0)))


def _spending() -> Column:
    """Spending patterns; insights are the concentration of spending and the days above the user's 90th percentile."""
    share = -F.col("top.minus").cast("double") / F.col("total_expenses").cast("double") * 100.0
    high_days = F.size(F.filter("days", lambda v: v > F.col("day_threshold")))
    insights = F.filter(
        F.array(
            F.when(share > 40, F.struct(F.lit("concentration_risk").alias("insight"), F.col("top.category").alias("subject"), share.alias("value"))),
            F.when(high_days > 0, F.struct(F.lit("high_spending_days").alias("insight"), F.lit(None).cast("string").alias("subject"), high_days.cast("double").alias("value"))),
        ),
        lambda i: i.isNotNull(),
    )
    return F.struct(
        "total_expenses", "expenses_months", "n_categories", F.col("top.category").alias("top_category"),
        F.coalesce("n_anomalies", F.lit(0)).alias("n_anomalies"), F.coalesce("n_high_anomalies", F.lit(0)).alias("n_high_anomalies"),
        "category_analysis", "monthly_trends", insights.alias("insights"),
    )


def _income() -> Column:
    seasonal = (F.col("seasons") >= 3) & (F.col("season_cv") > 0.3)
    three = lambda name: F.when(seasonal, F.transform(F.slice(name, 1, 3), lambda e: e["season"]))
    confidence = F.when(F.col("income_months") >= 6, "medium").otherwise("low")
    return F.struct(
        "total_income",
        "income_months",
        F.coalesce(_enough("income", F.greatest(F.lit(0.0), 1.0 - F.col("volatility"))), F.lit(0.5)).alias("stability_score"),
        F.coalesce(_enough("income", F.col("volatility")), F.lit(0.0)).alias("volatility"),
        _direction("income", "stable").alias("trend"),
        _enough("income", F.col("income_mean")).alias("average_income"),
        _enough("income", F.col("income_low")).alias("min_income"),
        _enough("income", F.col("income_high")).alias("max_income"),
        "income_sources",
        F.coalesce(seasonal, F.lit(False)).alias("seasonality_detected"),
        F.when(seasonal, F.col("season_cv")).alias("variation_coefficient"),
        three("high_first").alias("peak_months"),
        three("low_first").alias("low_months"),
        F.when(F.col("income_months") >= 3, "available").otherwise("insufficient_data").alias("projection"),
        _next_months("income").alias("next_3_months"),
        _enough("income", slope(*_line("income"))).alias("trend_slope"),
        _enough("income", confidence).alias("confidence"),
    )


def _mitigation(risks: Column) -> Column:
    """Strategy, timeline and priority for each risk, from the fixed table."""
    names = ("risk", "strategy", "timeline", "priority")
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in fv.MITIGATIONS])
    return F.flatten(F.transform(risks, lambda r: F.filter(table, lambda t: t["risk"] == r["risk"])))


def report_anomalies(ledger: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """The list behind the report's number of anomalies: a row for each, as a user may have very many."""
    return category_outliers(ledger, split_rows=split_rows)


def _anomalies(ledger: DataFrame, sums: DataFrame, split_rows: int) -> DataFrame:
    """Outlying expenses per user with the statistics taken from sums of expenses by user and category."""
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    stats = sums.select("user_id", "category", "n", F.col("total").alias("s"), "q", "largest")
    stats = stats.filter((n >= 3) & moments.above(F.col("largest"), 3.0, n, s, q)).drop("largest")
    return _in_rows(ledger, stats, split_rows)


def comprehensive_report(ledger: DataFrame, profiles: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """One row per user with transactions, in struct columns; the parts meet on the user after aggregation.

    Maps and arrays of a user are bounded by its categories and the calendar; the anomalies themselves are the rows
    of `report_anomalies`.
    """
    n, s, q = moments.sums(F.col("amount"))
    spent = ledger.filter(is_expense()).groupBy("user_id", "category").agg(n.alias("n"), s.alias("total"), q.alias("q"), F.max("amount").alias("largest"))
    return report_from_cells(cell_sums(ledger), _anomalies(ledger, spent, split_rows), profiles)


def outlying_groups(cells: DataFrame) -> DataFrame:
    """Groups of a user and category whose expenses hold outliers, out of cells, which need not be merged: their sums as `total`, `n`
    and `q`, their number of outliers as far as cells tell, all and those of high severity, and `untold`.

    A cell has the largest of its amounts and their sum, so both amounts of a cell of two are known. A group is `untold` where a
    cell of more amounts has an outlier: how many there are is for its rows to say. Groups need a user and a category, as rows do
    that are joined to statistics.
    """
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    spent = cells.filter(is_expense() & F.col("user_id").isNotNull() & F.col("category").isNotNull())
    spent = spent.select("user_id", "category", "n", "total", "q", "largest").repartition("user_id")
    stats = _added(spent, "user_id", "category").withColumnRenamed("total", "s")
    stats = stats.filter((n >= 3) & moments.above(F.col("largest"), 3.0, n, s, q)).drop("largest")
    cell = spent.select("user_id", "category", F.col("n").alias("cell_n"), (F.col("total") - F.col("largest")).alias("other"), "largest")
    met = cell.join(stats.hint("shuffle_hash"), ["user_id", "category"])
    over = lambda amount, times: moments.above(F.col(amount), times, n, s, q)
    number = lambda times: over("largest", times).cast("int") + F.when(F.col("cell_n") == 2, over("other", times).cast("int")).otherwise(0)
    counts = [F.sum(number(t)).alias(name) for t, name in ((3.0, "n_anomalies"), (4.0, "n_high_anomalies"))]
    met = met.filter(over("largest", 3.0))
    return met.groupBy("user_id", "category", "n", "s", "q").agg(*counts, F.max(F.col("cell_n") > 2).alias("untold"))


def _in_rows(ledger: DataFrame, stats: DataFrame, split_rows: int) -> DataFrame:
    """Outlying expenses per user, all and those of high severity, in the rows of the groups of `stats`."""
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    rows = ledger.filter(is_expense()).select("user_id", "category", "txn_id", "amount")
    joined = attach_group_stats(rows, stats, ["user_id", "category"], "n", ["txn_id"], split_rows, "inner")
    severe = moments.above(F.col("amount"), 4.0, n, s, q)
    odd = joined.filter(moments.above(F.col("amount"), 3.0, n, s, q))
    return odd.groupBy("user_id").agg(F.count("*").alias("n_anomalies"), F.count_if(severe).alias("n_high_anomalies"))


def anomalies_of(groups: DataFrame, ledger: DataFrame | None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Numbers of outliers per user from `outlying_groups`; the rows of untold ones are in `ledger`, which is None where there are none."""
    counts = ("n_anomalies", "n_high_anomalies")
    told = groups.filter(~F.col("untold")).select("user_id", *counts)
    if ledger is not None:
        told = told.unionByName(_in_rows(ledger, groups.filter("untold").select("user_id", "category", "n", "s", "q"), split_rows))
    return told.groupBy("user_id").agg(*[F.sum(c).alias(c) for c in counts])


def report_from_cells(cells: DataFrame, anomalies: DataFrame, profiles: DataFrame) -> DataFrame:
    """The report out of cells, which need not be merged, and the numbers of outliers per user."""
    wide = with_profile(_numbers(cells), profiles).join(anomalies, "user_id", "left")
    savings, expense_ratio, volatility = F.col("savings_rate"), F.col("expense_ratio"), F.col("volatility")
    employment = F.col("employment_type")
    risks = scoring.assessed_risks(
        F.col("total_income").cast("double"), F.col("total_expenses").cast("double"), F.col("n_income"),
        F.col("n_expenses"), volatility, employment,
    )
    wide = wide.withColumn("risks", risks)
    return wide.select(
        "user_id",
        _spending().alias("spending"),
        _income().alias("income"),
        F.struct(
            scoring.health_score(savings, expense_ratio, volatility, employment).alias("health_score"),
            savings.alias("savings_rate"),
            expense_ratio.alias("expense_ratio"),
            volatility.alias("income_volatility"),
            scoring.risk_factors(savings, expense_ratio, volatility).alias("risk_factors"),
        ).alias("health"),
        scoring.recommendations(savings, employment).alias("recommendations"),
        F.struct(
            F.get(_next_months("income"), F.lit(0)).alias("next_income"),
            _direction("income", "decreasing").alias("income_trend"),
            F.get(_next_months("expenses"), F.lit(0)).alias("next_expenses"),
            _direction("expenses", "decreasing").alias("expenses_trend"),
            _next_months("income").alias("income"),
            _fit("income").alias("income_r_squared"),
            _next_months("expenses").alias("expenses"),
            _fit("expenses").alias("expenses_r_squared"),
        ).alias("predictions"),
        F.struct("risks", scoring.overall_risk(F.col("risks")).alias("overall_risk_level"), _mitigation(F.col("risks")).alias("mitigation")).alias("risk"),
    )


def reports_for(users: DataFrame, ledger: DataFrame, profiles: DataFrame) -> DataFrame:
    """Reports for all users; those without transactions get a message and NULL in every part."""
    report = comprehensive_report(ledger, profiles)
    joined = users.select("user_id").join(report, "user_id", "left")
    return joined.withColumn("message", F.when(F.col("spending").isNull(), "No financial data available"))
