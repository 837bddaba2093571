"""Statement import, categorisation, bank feed and stored tables."""

from pyspark.sql import functions as F

from tallyflow.catalog.registry import MIXED, STRETCHED, big, dbl, micros, money, num, query, with_
from tallyflow.functions import fixed_values as fv
from tallyflow.functions.categorize import parse_rules, type_from_column, type_from_sign, with_category, word_list
from tallyflow.functions.money import MONEY
from tallyflow.functions.rule_table import rule_table, with_table_category
from tallyflow.plans import insights
from tallyflow.session import shared_path
from tallyflow.sources import feed, ledger, records, statement, versions
from tallyflow.sources.star import (
    HOUSEHOLD_NAMES, documents, event_ledger, events_as_mixed_ledger, mixed_event_ledger, statement_rows, stretched, table,
)

AS_OF = "2024-06-30 00:00:00"


def any_of(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def case_sql(text: str, kind: str) -> str:
    """The rule table in SQL, every word of it."""
    arms = []
    for rule in parse_rules():
        if rule.txn_type == kind:
            test = any_of(text, rule.words) + (f" AND NOT {any_of(text, rule.absent)}" if rule.absent else "")
            arms.append(f"WHEN {test} THEN '{rule.category}'")
    default = fv.DEFAULT_INCOME_CATEGORY if kind == "income" else fv.DEFAULT_EXPENSE_CATEGORY
    return f"CASE {' '.join(arms)} ELSE '{default}' END"


@query(f"""
WITH d AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, {case_sql('t', 'expense')} AS expense_category, {case_sql('t', 'income')} AS income_category FROM d""")
def categorize_text(spark, sf_dir):
    """Whole documents through both halves of the rule table."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    as_expense = with_category(docs.withColumn("kind", F.lit("expense")), "text", "kind")
    both = with_category(
        as_expense.withColumnRenamed("category", "expense_category").withColumn("kind", F.lit("income")), "text", "kind"
    )
    return both.select("doc_id", "expense_category", F.col("category").alias("income_category"))


@query(f"""
WITH d AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, {case_sql('t', 'expense')} AS expense_category, {case_sql('t', 'income')} AS income_category FROM d""")
def categorize_by_table(spark, sf_dir):
    """Whole documents through the same rules as a table."""
    docs, rules = documents(spark, sf_dir).select("doc_id", "text"), rule_table(spark)
    as_expense = with_table_category(docs.withColumn("kind", F.lit("expense")), rules, "text", "kind")
    both = with_table_category(as_expense.withColumnRenamed("category", "expense_category").withColumn("kind", F.lit("income")), rules, "text", "kind")
    return both.select("doc_id", "expense_category", F.col("category").alias("income_category"))


@query(f"""
WITH rules AS (
  SELECT c_custkey AS rule_no, CASE WHEN c_custkey % 2 = 1 THEN 'expense' END AS txn_type, c_mktsegment AS category,
         CASE WHEN c_custkey % 10 = 7 THEN substr(lower(c_name), 1, 17) ELSE lower(c_name) END AS word, c_custkey % 5 = 0 AS no_errors FROM customer),
e AS (
  SELECT event_id, lower(event_type || ' by Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0')) AS t, CASE WHEN event_type = 'signup' THEN 'income' ELSE 'expense' END AS kind FROM events)
SELECT event_id, COALESCE(arg_min(category, rule_no), CASE kind WHEN 'income' THEN '{fv.DEFAULT_INCOME_CATEGORY}' ELSE '{fv.DEFAULT_EXPENSE_CATEGORY}' END) AS category
FROM e LEFT JOIN rules ON contains(t, word) AND (txn_type IS NULL OR txn_type = kind) AND NOT (no_errors AND contains(t, 'error')) GROUP BY event_id, kind""")
def categorize_customer_rules(spark, sf_dir):
    """A rule for every customer's name: words that begin alike or hold one another, rules of a type, and words that must be absent."""
    key, name = F.col("c_custkey"), F.lower("c_name")
    customers = table(spark, sf_dir, "customer").select(
        key.alias("rule_no"), F.when(key % 2 == 1, "expense").alias("txn_type"), F.col("c_mktsegment").alias("category"),
        F.when(key % 10 == 7, F.substring(name, 1, 17)).otherwise(name).alias("word"), F.lit(False).alias("absent"),
    )
    no_errors = customers.filter("rule_no % 5 = 0").withColumns({"word": F.lit("error"), "absent": F.lit(True)})
    events = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.col("event_type"), F.lit(" by Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("description"),
        F.when(F.col("event_type") == "signup", "income").otherwise("expense").alias("txn_type"),
    )
    return with_table_category(events, customers.unionByName(no_errors)).select("event_id", "category")


ZERO_WORDS = word_list(fv.ZERO_AMOUNT_INCOME_WORDS)


@query(f"""
WITH d AS (SELECT doc_id, source, lower(text) AS t, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN n_chars ELSE -n_chars END AS amount FROM documents)
SELECT doc_id, CASE WHEN amount > 0 THEN 'income' WHEN amount < 0 THEN 'expense' WHEN {any_of('t', ZERO_WORDS)} THEN 'income'
            ELSE 'expense' END AS type_by_sign,
       CASE WHEN {any_of('t', fv.INCOME_TYPE_WORDS)} THEN 'income' ELSE 'expense' END AS type_by_column FROM d""")
def type_inference(spark, sf_dir):
    """English documents have amount 0, so their words decide."""
    n = F.col("n_chars")
    docs = documents(spark, sf_dir).select(
        "doc_id", "text", F.lower("text").alias("t"),
        F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", n).otherwise(-n).alias("amount"),
    )
    return docs.select(
        "doc_id", type_from_sign(F.col("amount"), F.col("t")).alias("type_by_sign"),
        type_from_column(F.col("text"), F.col("t")).alias("type_by_column"),
    )


_CASES = " ".join(f"WHEN '{k}' THEN '{v.upper()}'" for k, v in HOUSEHOLD_NAMES.items())
STATEMENT = f"""raw AS (
  SELECT o_custkey AS user_id, strftime(o_orderdate, '%m/%d/%Y') AS d, (CASE o_orderpriority {_CASES} END) || ' DEPOSIT' AS description,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS a FROM orders
  UNION ALL
  SELECT o_custkey, CASE WHEN l_linenumber = 3 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN l_linenumber = 5 THEN '13/45/2024'
                         WHEN l_linenumber = 6 AND l_returnflag = 'A' THEN '' ELSE strftime(l_shipdate, '%m/%d/%Y') END,
         (CASE p_type {_CASES} END) || ' ' || p_name || ' ' || CAST(l_suppkey AS VARCHAR),
         CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN '$' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)
              WHEN l_quantity = 1 THEN '' WHEN l_quantity = 50 THEN '0'
              ELSE '-' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
parsed AS (
  SELECT user_id, d, description, lower(description) AS t, TRY_CAST(a AS DECIMAL(18,2)) AS signed, a,
         COALESCE(try_strptime(d, '%m/%d/%Y'), try_strptime(d, '%Y-%m-%d'), TIMESTAMP '{AS_OF}') AS ts FROM raw),
typed AS (
  SELECT *, abs(signed) AS amount,
         CASE WHEN signed > 0 THEN 'income' WHEN signed < 0 THEN 'expense' WHEN {any_of('t', ZERO_WORDS)} THEN 'income' ELSE 'expense' END AS txn_type,
         CASE WHEN signed IS NULL THEN 'amount' WHEN d = '' THEN 'date' END AS bad FROM parsed),
named AS (
  SELECT *, CASE WHEN txn_type = 'income' THEN {case_sql('t', 'income')} ELSE {case_sql('t', 'expense')} END AS category FROM typed),
good AS (SELECT * FROM named WHERE bad IS NULL)"""


def _normalised(spark, sf_dir):
    raw = statement_rows(spark, sf_dir)
    mapping = statement.default_mapping([c for c in raw.columns if c != "user_id"])
    return statement.normalise(raw, mapping, AS_OF, ["user_id"])


@query(with_(STATEMENT, select=f"""
SELECT user_id, strftime(ts, '%Y-%m-%d') AS date, description, {dbl('amount')} AS amount, txn_type, category FROM good"""))
def statement_import(spark, sf_dir):
    """Raw statement text to typed, categorised rows."""
    good = statement.good_rows(_normalised(spark, sf_dir))
    return good.select(
        "user_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), "description", money("amount"), "txn_type", "category"
    )


@query(f"""
WITH v AS (SELECT event_id, user_id, CAST(value AS DECIMAL(18,2)) AS amount, event_type || ' ' || (props->>'$.k') AS description,
           CASE event_type WHEN 'signup' THEN 'Bank CREDIT' WHEN 'error' THEN 'Income' ELSE 'debit' END AS kind,
           CASE WHEN value > 20 THEN 'Own ' || event_type END AS own FROM events),
t AS (SELECT *, CASE WHEN kind = 'debit' THEN 'expense' ELSE 'income' END AS txn_type FROM v)
SELECT event_id, user_id, CAST(amount AS DOUBLE) AS amount, txn_type,
       COALESCE(own, CASE WHEN txn_type = 'income' THEN {case_sql('description', 'income')} ELSE {case_sql('description', 'expense')} END) AS category
FROM t""")
def statement_own_columns(spark, sf_dir):
    """A statement with its own type and category columns: the type beats the sign, the category the rules."""
    kind, value = F.col("event_type"), F.col("value")
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.date_format("ts", "yyyy-MM-dd").alias("Posted"),
        (-value.cast(MONEY)).cast("string").alias("Amount"),
        F.concat_ws(" ", kind, F.get_json_object("props", "$.k")).alias("Memo"),
        F.when(kind == "signup", "Bank CREDIT").when(kind == "error", "Income").otherwise("debit").alias("Entry type"),
        F.when(value > 20, F.concat(F.lit("Own "), kind)).alias("Category"),
    )
    mapping = statement.default_mapping([c for c in raw.columns if not c.endswith("_id")])
    good = statement.good_rows(statement.normalise(raw, mapping, AS_OF, ["event_id", "user_id"]))
    return good.select("event_id", "user_id", money("amount"), "txn_type", "category")


def _summary_sql(table_name, keys=""):
    return f"""
SELECT {keys} COUNT(*) AS total_transactions, COALESCE({dbl("SUM(amount) FILTER (txn_type = 'income')")}, 0.0) AS total_income,
       COALESCE({dbl("SUM(amount) FILTER (txn_type = 'expense')")}, 0.0) AS total_expenses,
       COUNT(*) FILTER (txn_type = 'income') AS income_count, COUNT(*) FILTER (txn_type = 'expense') AS expense_count,
       {dbl("SUM(CASE txn_type WHEN 'income' THEN amount ELSE -amount END)")} AS savings
FROM {table_name} {'GROUP BY ALL' if keys else ''}"""


def _summary(out, *keys):
    return out.select(
        *keys, big("total_transactions"), money("total_income"), money("total_expenses"), big("income_count"),
        big("expense_count"), money("savings"),
    )


@query(with_(STATEMENT, select=_summary_sql("good")))
def import_preview(spark, sf_dir):
    return _summary(statement.import_summary(statement.good_rows(_normalised(spark, sf_dir))))


@query(with_(STATEMENT, select=_summary_sql("good", "user_id,")))
def import_preview_by_user(spark, sf_dir):
    return _summary(statement.import_summary(statement.good_rows(_normalised(spark, sf_dir)), ["user_id"]), "user_id")


@query(with_(STATEMENT, select="""
SELECT user_id, COUNT(*) FILTER (bad = 'amount') AS bad_amounts, COUNT(*) FILTER (bad = 'date') AS bad_dates
FROM named WHERE bad IS NOT NULL GROUP BY 1"""))
def import_errors(spark, sf_dir):
    bad = _normalised(spark, sf_dir).filter("error IS NOT NULL")
    return bad.groupBy("user_id").agg(
        F.count_if(F.col("error") != "no date").alias("bad_amounts"), F.count_if(F.col("error") == "no date").alias("bad_dates")
    )


@query(f"""
WITH v AS (SELECT ts, event_type, event_type || ' #' || event_id AS description, CAST(value AS DECIMAL(18,2)) AS amount FROM events),
e AS (SELECT *, CASE WHEN amount = 0 THEN CASE WHEN {any_of('description', ZERO_WORDS)} THEN 'income' ELSE 'expense' END
                     WHEN event_type = 'signup' THEN 'income' ELSE 'expense' END AS txn_type FROM v)
SELECT strftime(ts, '%Y-%m-%d') AS date, description, CAST(amount AS DOUBLE) AS amount, txn_type,
       CASE WHEN txn_type = 'income' THEN {case_sql('description', 'income')} ELSE {case_sql('description', 'expense')} END AS category
FROM e""")
def statement_csv(spark, sf_dir):
    """Events written as statement CSV files to the shared folder and read back through the import."""
    kind, value = F.col("event_type"), F.col("value").cast(MONEY)
    rows = table(spark, sf_dir, "events").select(
        F.date_format("ts", "MM/dd/yyyy").alias("Date"),
        F.concat_ws(" #", kind, F.col("event_id").cast("string")).alias("Description"),
        F.when(kind == "signup", value).otherwise(-value).cast("string").alias("Amount"),
        F.lit("0.00").alias("Balance"),
    )
    path = shared_path(spark, "statements")
    rows.write.option("header", True).csv(path)
    raw = statement.read_statements(spark, path, ["Date", "Description", "Amount", "Balance"])
    good = statement.good_rows(statement.normalise(raw, statement.default_mapping(rows.columns), AS_OF))
    return good.select(F.date_format("ts", "yyyy-MM-dd").alias("date"), "description", money("amount"), "txn_type", "category")


# Every event is a feed row; values below 50 arrive a second time, and purchases are in the ledger already.
FEED = """feed AS (
  SELECT user_id, event_id AS seq, event_type || '-' || (props->>'$.k') AS name, CASE WHEN event_type = 'signup' THEN -value ELSE value END AS amount,
         CAST(ts AS DATE) AS date, CASE WHEN event_type <> 'view' THEN event_type END AS first_category FROM events
  UNION ALL
  SELECT user_id, event_id + 1000000000, event_type || '-' || (props->>'$.k'), CASE WHEN event_type = 'signup' THEN value ELSE -value END,
         CAST(ts AS DATE), 'again' FROM events WHERE value < 50),
rows AS (
  SELECT user_id, seq, name AS description, CAST(abs(CAST(amount AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount, COALESCE(first_category, 'Other') AS category,
         CASE WHEN amount > 0 THEN 'expense' ELSE 'income' END AS txn_type, CAST(date AS TIMESTAMP) AS ts FROM feed),
stored AS (SELECT * FROM rows WHERE category = 'purchase'),
fresh AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, description, amount, ts ORDER BY seq) AS rk FROM rows
  WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.user_id = rows.user_id AND s.description = rows.description
                    AND s.amount = rows.amount AND s.ts = rows.ts)
  QUALIFY rk = 1)"""


def feed_rows(events):
    """A bank feed out of events: the second copy of a small value has the other sign and a category of its own."""
    k = F.get_json_object("props", "$.k")
    signup = F.col("event_type") == "signup"
    value = F.col("value")
    first = events.select(
        "user_id",
        F.col("event_id").alias("seq"),
        F.concat_ws("-", "event_type", k).alias("name"),
        F.when(signup, -value).otherwise(value).alias("amount"),
        F.to_date("ts").alias("date"),
        F.when(F.col("event_type") == "view", F.array().cast("array<string>")).otherwise(F.array("event_type")).alias("category"),
        value.alias("_value"),
    )
    again = first.filter(F.col("_value") < 50).withColumns({
        "seq": F.col("seq") + 1_000_000_000, "amount": -F.col("amount"), "category": F.array(F.lit("again")),
    })
    return first.unionByName(again).drop("_value")


def _feed_and_ledger(spark, sf_dir):
    rows = feed.normalise_feed(feed_rows(table(spark, sf_dir, "events")))
    return rows, rows.filter("category = 'purchase'")


NEW = f"""
SELECT user_id, seq, description, {dbl('amount')} AS amount, category, txn_type, epoch_us(ts) AS ts FROM fresh"""


@query(with_(FEED, select=NEW))
def feed_dedup(spark, sf_dir):
    rows, stored = _feed_and_ledger(spark, sf_dir)
    return feed.new_rows(rows, stored).select(
        "user_id", "seq", "description", money("amount"), "category", "txn_type", micros("ts")
    )


@query(with_(FEED, select="""
SELECT user_id, COUNT(*) AS total, COALESCE(any_value(n), 0) AS imported
FROM rows LEFT JOIN (SELECT user_id, COUNT(*) AS n FROM fresh GROUP BY 1) USING (user_id) GROUP BY 1"""))
def sync_report(spark, sf_dir):
    rows, stored = _feed_and_ledger(spark, sf_dir)
    return feed.sync_report(rows, stored).select("user_id", big("total"), big("imported"))


@query(with_(FEED, select="""
SELECT (SELECT COUNT(*) FROM rows) AS total, (SELECT COUNT(*) FROM fresh) AS imported, (SELECT COUNT(*) FROM fresh) AS stored"""))
def sync_report_observed(spark, sf_dir):
    """Rows seen and imported, observed while the new rows are written, beside what is stored then."""
    rows, stored = _feed_and_ledger(spark, sf_dir)
    path = shared_path(spark, "observed")
    found = feed.observed_import(rows, stored, lambda fresh: ledger.append_ledger(fresh.drop("seq"), path))
    there = ledger.read_ledger(spark, path).agg(F.count("*").alias("stored"))
    return there.select(F.lit(found["total"]).cast("bigint").alias("total"), F.lit(found["imported"]).cast("bigint").alias("imported"), "stored")


@query("SELECT c_custkey AS account_id, c_name AS account_name FROM customer WHERE c_acctbal > 0")
def active_accounts(spark, sf_dir):
    accounts = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("account_id"), F.col("c_name").alias("account_name"), (F.col("c_acctbal") > 0).alias("is_active")
    )
    return feed.active_accounts(accounts).drop("is_active")


@query(f"""
SELECT strftime(ts, '%Y-%m') AS month, event_type AS category, COUNT(*) AS n, {dbl('SUM(CAST(value AS DECIMAL(18,2)))')} AS total
FROM events GROUP BY ALL""")
def ledger_store(spark, sf_dir):
    """Written in two appends, read back from the stored ledger."""
    rows = event_ledger(spark, sf_dir)
    path = shared_path(spark, "ledger")
    ledger.append_ledger(rows.filter("category = 'click'"), path)
    ledger.append_ledger(rows.filter("category <> 'click'"), path)
    stored = ledger.read_ledger(spark, path)
    return stored.groupBy("month", "category").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query("""
SELECT l_orderkey AS order_key, l_linenumber::BIGINT AS line_number, l_partkey AS part_key, l_suppkey AS supp_key,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS amount,
       strftime(CASE WHEN l_returnflag = 'R' THEN TIMESTAMP '2024-06-30' ELSE l_shipdate END, '%Y-%m-%d') AS date
FROM lineitem""")
def confirmed_import(spark, sf_dir):
    """Rows a user confirmed, all as text; returned ones carry a date that cannot be read."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(
        F.col("l_orderkey").alias("user_id"),
        F.col("l_extendedprice").cast(MONEY).cast("string").alias("amount"),
        F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")]).alias("description"),
        F.lit("Other").alias("category"),
        F.lit("expense").alias("type"),
        F.when(F.col("l_returnflag") == "R", "30.06.24").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"),
    )
    parts = F.split("description", r"\|")
    return statement.confirmed(rows, AS_OF).select(
        F.col("user_id").alias("order_key"),
        *[parts[i].cast("bigint").alias(n) for i, n in enumerate(("line_number", "part_key", "supp_key"))],
        money("amount"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
    )


def _stored_feed(spark, rows, created):
    return insights.insight_feed(rows).withColumn("created_at", F.lit(created).cast("timestamp_ntz"))


def _cols(out):
    return out.select("user_id", big("rank"), "insight_type", "priority", num("value", 5), "subject")


def _feed_sql():
    from tallyflow.catalog.anomalies import FEED as select, feed_sql

    return feed_sql(MIXED, "txn_id") + select


@query(_feed_sql())
def insight_store_replace(spark, sf_dir):
    """A first set from purchases and views only, then replaced for all users by the full set."""
    rows = mixed_event_ledger(spark, sf_dir)
    path = shared_path(spark, "insights")
    ledger.append_insights(_stored_feed(spark, rows.filter("category IN ('purchase', 'view')"), "2024-01-01"), path)
    ledger.replace_insights(_stored_feed(spark, rows, "2024-01-02"), rows.select("user_id"), path)
    return _cols(ledger.read_insights(spark, path))


@query(_feed_sql())
def insight_store_versions(spark, sf_dir):
    """The same replacement in one step: a first set, a second one that is written and never committed, and the full set."""
    rows = mixed_event_ledger(spark, sf_dir)
    path = shared_path(spark, "insight-versions")
    first = _stored_feed(spark, rows.filter("category IN ('purchase', 'view')"), "2024-01-01")
    versions.replace_at_once(first, None, path)
    broken_off = _stored_feed(spark, rows.filter("category = 'click'"), "2024-01-01").withColumn("bucket", F.lit(0))
    broken_off.write.partitionBy("bucket").parquet(f"{path}/data/version=1")
    versions.replace_at_once(_stored_feed(spark, rows, "2024-01-02"), rows.select("user_id"), path)
    return _cols(versions.read_version(spark, path, first.schema))


def _twice():
    return f"SELECT * FROM ({_feed_sql()}) UNION ALL SELECT * FROM ({_feed_sql()})"


@query(_twice())
def insight_store_append(spark, sf_dir):
    """The same set appended twice: the report adds its insights each time it runs."""
    rows = mixed_event_ledger(spark, sf_dir)
    path = shared_path(spark, "insights")
    for created in ("2024-01-01", "2024-01-02"):
        ledger.append_insights(_stored_feed(spark, rows, created), path)
    return _cols(ledger.read_insights(spark, path))


@query("""
WITH stored AS (SELECT event_id AS insight_id, user_id, event_type AS insight_type, ts FROM events)
SELECT user_id, insight_id, insight_type FROM stored
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, insight_id DESC) <= 20""")
def latest_insights(spark, sf_dir):
    """The newest 20 of each user, events standing for stored insights."""
    stored = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("insight_id"), "user_id", F.col("event_type").alias("insight_type"), F.col("ts").alias("created_at")
    )
    return insights.latest_insights(stored).select("user_id", "insight_id", "insight_type")


@query(with_(STRETCHED, select=f"""
SELECT user_id, txn_id, {dbl('amount')} AS amount, category FROM ledger
WHERE txn_type = 'expense' AND strftime(ts, '%Y-%m') BETWEEN '2024-03' AND '2024-08'
  AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)"""))
def ledger_scan(spark, sf_dir):
    """Stored ledger of requested users in some months: the months prune partitions, the type is pushed to the scan."""
    path = shared_path(spark, "ledger")
    rows = events_as_mixed_ledger(stretched(table(spark, sf_dir, "events")))
    ledger.append_ledger(rows, path)
    users = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    stored = ledger.read_ledger(spark, path, users, txn_type="expense", months=("2024-03", "2024-08"))
    return stored.select("user_id", "txn_id", money("amount"), "category")


# Events as seven statement files; every eleventh amount and every thirteenth date is bad, both in every 143rd row.
@query("""
WITH files AS (SELECT event_id % 7 AS file, event_id, row_number() OVER (PARTITION BY event_id % 7 ORDER BY event_id) AS row FROM events)
SELECT file, row, CASE WHEN event_id % 11 = 0 THEN 'could not convert to a number: ' || chr(39) || 'n/a' || chr(39) ELSE 'no date' END AS error
FROM files WHERE event_id % 11 = 0 OR event_id % 13 = 0""")
def import_row_errors(spark, sf_dir):
    """Every error of every uploaded file, with its row number."""
    number = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        (number % 7).alias("upload"),
        number,
        F.when(number % 13 != 0, F.date_format("ts", "MM/dd/yyyy")).alias("Date"),
        F.col("event_type").alias("Description"),
        F.when(number % 11 == 0, "n/a").otherwise(F.col("value").cast(MONEY).cast("string")).alias("Amount"),
    )
    path = shared_path(spark, "uploads")
    one_file_each = rows.repartition("upload").sortWithinPartitions("upload", "event_id").drop("event_id")
    one_file_each.write.partitionBy("upload").option("header", True).csv(path)
    raw = statement.read_statements(spark, path, ["Date", "Description", "Amount"])
    found = statement.row_errors(statement.normalise(raw, statement.default_mapping(["Date", "Description", "Amount"]), AS_OF))
    return found.select(F.regexp_extract("file", r"upload=(\d+)", 1).cast("bigint").alias("file"), big("row"), "error")


# Statements as raw lines. By the last digit of the event's number a line lacks its amount (3), has a field too many (4), opens a quotation mark
# that nothing closes (5), quotes a comma and quotation marks (6) or has an amount that is no number (8); the others are good.
RAW_COLUMNS = ["Date", "Description", "Amount"]
LINES = """lines AS (
  SELECT event_id % 7 AS file, event_id, strftime(ts, '%m/%d/%Y') || ',' || CASE event_id % 10
           WHEN 3 THEN event_type WHEN 4 THEN event_type || ',' || value_text || ',more' WHEN 5 THEN '"' || event_type || ',' || value_text
           WHEN 6 THEN '"' || event_type || ', the ""é"" one",' || value_text WHEN 8 THEN event_type || ',n/a' ELSE event_type || ',' || value_text END AS line
  FROM (SELECT *, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value_text FROM events))"""


def _raw_lines(events):
    number, kind, digit = F.col("event_id"), F.col("event_type"), F.col("event_id") % 10
    value = F.col("value").cast(MONEY).cast("string")
    rest = (
        F.when(digit == 3, kind)
        .when(digit == 4, F.concat(kind, F.lit(","), value, F.lit(",more")))
        .when(digit == 5, F.concat(F.lit('"'), kind, F.lit(","), value))
        .when(digit == 6, F.concat(F.lit('"'), kind, F.lit(', the ""é"" one",'), value))
        .when(digit == 8, F.concat(kind, F.lit(",n/a")))
        .otherwise(F.concat(kind, F.lit(","), value))
    )
    return events.select((number % 7).alias("upload"), number, F.concat(F.date_format("ts", "MM/dd/yyyy"), F.lit(","), rest).alias("value"))


def _raw_records(spark, sf_dir):
    """The lines as seven files, read back as records."""
    path = shared_path(spark, "raw-uploads")
    one_file_each = _raw_lines(table(spark, sf_dir, "events")).repartition("upload").sortWithinPartitions("upload", "event_id")
    one_file_each.drop("event_id").write.partitionBy("upload").text(path)
    parsed = records.parse_records(records.read_records(spark, path), RAW_COLUMNS, header=False)
    return parsed, F.regexp_extract("file", r"upload=(\d+)", 1).cast("bigint").alias("file")


def _read(parsed):
    mapping = statement.default_mapping(RAW_COLUMNS)
    return statement.normalise(parsed.filter("record_error IS NULL"), mapping, AS_OF, list(records.PLACE))


@query(with_(LINES, select="""
SELECT file, row, CAST(position AS BIGINT) AS position,
       CASE event_id % 10 WHEN 5 THEN 'open quotation mark' WHEN 8 THEN 'could not convert to a number: ' || chr(39) || 'n/a' || chr(39) ELSE 'not 3 fields' END AS error
FROM (SELECT *, row_number() OVER w AS row, coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY file ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position
      FROM lines WINDOW w AS (PARTITION BY file ORDER BY event_id))
WHERE event_id % 10 IN (3, 4, 5, 8)"""))
def statement_malformed(spark, sf_dir):
    """Every record that can't be parsed and every row that can't be read, with its row number and first byte."""
    parsed, file = _raw_records(spark, sf_dir)
    return records.with_record_errors(_read(parsed), parsed).select(file, big("row"), "position", "error")


@query(with_(LINES, select=f"""
SELECT file, COUNT(*) AS n, {dbl('SUM(amount)')} AS total, COUNT(*) FILTER (event_id % 10 = 6) AS quoted FROM lines
JOIN (SELECT event_id, CAST(value AS DECIMAL(18,2)) AS amount FROM events) USING (event_id) WHERE event_id % 10 NOT IN (3, 4, 5, 8) GROUP BY file"""))
def statement_well_formed(spark, sf_dir):
    """The good rows of the same files: bad records take none of their neighbours with them."""
    parsed, file = _raw_records(spark, sf_dir)
    good = statement.good_rows(_read(parsed)).select(file, "amount", "description")
    return good.groupBy("file").agg(
        F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"), F.count_if(F.col("description").endswith(', the "é" one')).alias("quoted")
    )


# Descriptions of one to four lines; by the event's number they hold commas, quotation marks, or blank lines.
@query(f"""
WITH e AS (
  SELECT ts, event_id, CAST(value AS DECIMAL(18,2)) AS amount,
         CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN event_type || chr(10) || 'second, line' WHEN 2 THEN event_type || chr(10) || chr(10) || '"quoted"' || chr(10)
              WHEN 3 THEN '"' || chr(10) || event_type ELSE event_type || ' plain' END || ' #' || event_id AS description FROM events)
SELECT strftime(ts, '%Y-%m-%d') AS date, description, CAST(amount AS DOUBLE) AS amount, {case_sql('lower(description)', 'expense')} AS category FROM e WHERE amount > 0""")
def statement_line_breaks(spark, sf_dir):
    """Statements whose quoted fields hold line breaks, read in splits."""
    kind, digit = F.col("event_type"), F.col("event_id") % 5
    text = (
        F.when(digit == 0, kind)
        .when(digit == 1, F.concat(kind, F.lit("\nsecond, line")))
        .when(digit == 2, F.concat(kind, F.lit('\n\n"quoted"\n')))
        .when(digit == 3, F.concat(F.lit('"\n'), kind))
        .otherwise(F.concat(kind, F.lit(" plain")))
    )
    text = F.concat(text, F.lit(" #"), F.col("event_id").cast("string"))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    amount = F.col("value").cast(MONEY)
    lines = table(spark, sf_dir, "events").filter(amount > 0).select(
        F.concat_ws(",", F.date_format("ts", "MM/dd/yyyy"), quoted, (-amount).cast("string")).alias("value")
    )
    path = shared_path(spark, "line-breaks")
    lines.write.text(path)
    parsed = records.parse_records(records.read_records(spark, path, multi_line=True), RAW_COLUMNS, header=False)
    good = statement.good_rows(_read(parsed))
    return good.select(F.date_format("ts", "yyyy-MM-dd").alias("date"), "description", money("amount"), "category")


# How a time is written goes by the event's number; the SQL knows what each form keeps of it, not how it is read.
FORMS = ("MM/dd/yyyy hh:mm a", "M/d/yy", "yyyy-MMM-dd", "MMM dd yyyy h:mm a", "dd-MMM-yy", "yyyy-MM-dd HH:mm:ss", "MMMM d, yyyy", "yyyyMMdd", "d MMM yyyy HH:mm")


@query("""
WITH e AS (SELECT event_id, CAST(value AS DECIMAL(18,2)) AS amount, event_id % 9 AS form,
                  CASE WHEN event_id % 5 = 0 THEN ts - INTERVAL 30 YEAR ELSE ts END AS ts FROM events)
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'income' ELSE 'expense' END AS txn_type, CAST(amount AS DOUBLE) AS amount,
       epoch_us(CASE WHEN form IN (0, 3, 8) THEN date_trunc('minute', ts) WHEN form = 5 THEN date_trunc('second', ts) ELSE date_trunc('day', ts) END) AS ts
FROM e WHERE event_id % 6 > 0 AND amount > 0""")
def statement_forms(spark, sf_dir):
    """Statements with a debit and a credit column, a merchant, and dates in nine forms, some of the last century."""
    number = F.col("event_id")
    early = F.when(number % 5 == 0, F.expr("ts - INTERVAL 30 YEARS")).otherwise(F.col("ts"))
    text = F.coalesce(*[F.when(number % 9 == i, F.date_format("_ts", form)) for i, form in enumerate(FORMS)])
    amount = F.col("value").cast(MONEY).cast("string")
    raw = table(spark, sf_dir, "events").filter(F.col("value").cast(MONEY) > 0).withColumn("_ts", early).select(
        number,
        text.alias("Transaction Date"),
        F.concat(F.lit("Shop "), F.col("event_type")).alias("Merchant"),
        F.when(number % 6 == 0, "").when(number % 4 == 0, F.lit(None)).when(number % 3 == 0, F.concat(F.lit("-"), amount)).otherwise(amount).alias("Debit"),
        F.when(number % 6 == 0, " ").when(number % 4 == 0, amount).alias("Credit"),
    )
    mapping = statement.default_mapping([c for c in raw.columns if c != "event_id"])
    good = statement.good_rows(statement.normalise(raw, mapping, AS_OF, ["event_id"]))
    return good.select("event_id", "txn_type", money("amount"), micros("ts"))
