"""Streams: the same as the batch operators, exact arrival order, restart and late rows."""

import datetime as dt
import random
import statistics

import pytest

from tallyflow.session import shared_root
from tallyflow.streaming import alerts, ingest, totals
from tallyflow.streaming.keyed import read_keyed, write_keyed

LEDGER = "txn_id bigint, user_id bigint, amount decimal(18,2), category string, txn_type string, ts timestamp_ntz"


def write_batches(spark, path, batches, schema=LEDGER):
    """One file per batch; the stream takes them one by one in order of time."""
    import os
    import time

    for i, rows in enumerate(batches):
        part = f"{path}/part-{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        for name in os.listdir(part):
            if name.endswith(".parquet"):
                os.makedirs(f"{path}/in", exist_ok=True)
                os.rename(f"{part}/{name}", f"{path}/in/{i:03d}.parquet")
                stamp = time.time() - 10_000 + i * 10
                os.utime(f"{path}/in/{i:03d}.parquet", (stamp, stamp))
    return f"{path}/in"


def arrivals(seed, n=240):
    """Half of the rows of a user are back-dated against some that arrived before."""
    import decimal

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        when = dt.datetime(2023, 1, 1) + dt.timedelta(days=i * 2 - (rng.randrange(120) if rng.random() < 0.5 else 0), hours=rng.randrange(24))
        amount = decimal.Decimal(str(round(rng.expovariate(1 / 40) + (700 if rng.random() < 0.05 else 0), 2)))
        rows.append((i, rng.choice([0, 0, 1, 2]), amount, rng.choice(["a", "b"]), "income" if rng.random() < 0.25 else "expense", when))
    return rows


def brute_force_alerts(batches):
    """The rule as written: after each insert look at the user's 30 latest rows by date."""
    stored, found = {}, set()
    for batch in batches:
        for row in sorted(batch, key=lambda r: (r[5], r[0])):
            txn, user, amount, category, kind, _ = row
            mine = stored.setdefault(user, [])
            mine.append(row)
            latest = sorted(mine, key=lambda r: (r[5], r[0]))[-30:]
            if len(latest) < 5:
                continue
            if kind == "expense":
                same = [float(r[2]) for r in latest if r[4] == "expense" and r[3] == category]
                if len(same) >= 3 and float(amount) > statistics.fmean(same) + 2 * statistics.pstdev(same) + 1e-9:
                    found.add((txn, "spending_pattern"))
            else:
                times = [r[5] for r in latest if r[4] == "income"]
                gaps = [(b - a).days for a, b in zip(times, times[1:])]
                if len(times) >= 3 and statistics.fmean(gaps) > 14:
                    found.add((txn, "income_alert"))
    return found


def run_alerts(spark, source, folder, files=1):
    stream = spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", files).parquet(source)
    out = str(folder / "out")
    alerts.start_alerts(stream, out, str(folder / "cp")).awaitTermination()
    return {(r["txn_id"], r["alert"]) for r in spark.read.parquet(out).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_alerts_in_order_of_arrival(spark, tmp_path, seed):
    rows = arrivals(seed)
    batches = [rows[i : i + 80] for i in range(0, len(rows), 80)]
    got = run_alerts(spark, write_batches(spark, str(tmp_path), batches), tmp_path)
    want = brute_force_alerts(batches)
    assert got == want and {kind for _, kind in want} == {"spending_pattern", "income_alert"}


def test_alerts_do_not_depend_on_layout(spark, tmp_path):
    """One batch of many shuffled files, one user with over a third of the rows, whatever the size of Arrow batches."""
    rows = arrivals(4, 600)
    want = brute_force_alerts([rows])
    shuffled = random.Random(1).sample(rows, len(rows))
    for k, (size, n_files) in enumerate(((10, 12), (10_000, 12), (10, 1))):
        folder = tmp_path / str(k)
        folder.mkdir()
        step = -(-len(shuffled) // n_files)
        source = write_batches(spark, str(folder), [shuffled[i : i + step] for i in range(0, len(shuffled), step)])
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        try:
            assert run_alerts(spark, source, folder, files=100) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r[1] == 0 for r in rows) > len(rows) / 3


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    rows = arrivals(5, 120)
    frames = [spark.createDataFrame(part, LEDGER) for part in (rows[:60], rows[60:])]
    out, state = str(tmp_path / "out"), str(tmp_path / "held")
    for batch_id, frame in ((0, frames[0]), (1, frames[1]), (1, frames[1])):
        alerts.alert_batch(frame, batch_id, out, state)
    got = [(r["txn_id"], r["alert"]) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted(brute_force_alerts([rows[:60], rows[60:]]))


def test_keyed_table_is_compacted(spark, tmp_path):
    import os

    path = str(tmp_path / "keyed")
    assert read_keyed(spark, path, ["k"]) is None
    want = {}
    for batch in range(9):
        rows = [(k, batch * 10 + k) for k in range(batch % 4 + 1)]
        want |= dict(rows)
        write_keyed(spark.createDataFrame(rows, "k long, v long"), path, ["k"], batch, every=2)
        assert {r["k"]: r["v"] for r in read_keyed(spark, path, ["k"]).collect()} == want
    assert len(os.listdir(path)) <= 6
    before = {r["k"]: r["v"] for r in read_keyed(spark, path, ["k"], before=8).collect()}
    assert before == {0: 70, 1: 71, 2: 72, 3: 73}


def test_month_totals_over_batches_and_after_restart(spark, tmp_path):
    rows = arrivals(3)
    source = write_batches(spark, str(tmp_path), [rows[:100], rows[100:]])
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for _ in range(2):  # the second start finds nothing new
        stream = spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", 1).parquet(source)
        totals.start_latest(totals.running_month_totals(stream), out, checkpoint, ["user_id", "category", "month"]).awaitTermination()
    got = {(r["user_id"], r["category"], r["month"].strftime("%Y-%m")): (r["total"], r["n"]) for r in totals.read_latest(spark, out, ["user_id", "category", "month"]).collect()}
    want = {}
    for _, user, amount, category, kind, when in rows:
        if kind == "expense":
            total, n = want.get((user, category, when.strftime("%Y-%m")), (0, 0))
            want[(user, category, when.strftime("%Y-%m"))] = (total + amount, n + 1)
    assert got == want


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    def row(i, when):
        return (i, 1, 10, "a", "expense", dt.datetime.fromisoformat(when))

    # The watermark moves after a batch and is applied to late rows one batch further on.
    batches = [[row(0, "2024-01-05")], [row(1, "2024-06-05")], [row(4, "2024-06-07")], [row(2, "2024-01-06"), row(3, "2024-06-06")]]
    source = write_batches(spark, str(tmp_path), batches, LEDGER.replace("decimal(18,2)", "int"))
    stream = spark.readStream.schema(LEDGER.replace("decimal(18,2)", "int")).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    totals.start_latest(totals.running_month_totals(stream, "40 days"), out, str(tmp_path / "cp"), ["user_id", "category", "month"]).awaitTermination()
    got = {r["month"].strftime("%Y-%m"): r["n"] for r in totals.read_latest(spark, out, ["user_id", "category", "month"]).collect()}
    assert got == {"2024-01": 1, "2024-06": 3}


def test_feed_stream_equals_one_import(spark, tmp_path):
    schema = "user_id bigint, seq bigint, name string, amount double, date date, category array<string>"
    day = dt.date(2024, 1, 5)
    first = [(1, i, f"n{i % 4}", 5.0, day, ["x"]) for i in range(10)]
    second = [(1, 100 + i, f"n{i % 6}", -5.0, day, ["y"]) for i in range(10)]
    source = write_batches(spark, str(tmp_path), [first, second], schema)
    path = str(tmp_path / "ledger")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    ingest.start_feed_import(stream, path, str(tmp_path / "cp")).awaitTermination()
    stored = spark.read.parquet(path)
    assert {(r["description"], r["category"]) for r in stored.collect()} == {(f"n{i}", "x") for i in range(4)} | {("n4", "y"), ("n5", "y")}
    assert stored.count() == 6


class Named:
    """A session whose cluster names the shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return {"spark.checkpoint.dir": "hdfs://name/folder/"}.get(key, default)


def test_shared_folder_is_the_clusters_when_set():
    assert shared_root(Named()) == "hdfs://name/folder"


def test_shared_folder_is_the_same_throughout(spark):
    assert shared_root(spark) == shared_root(spark)


def test_sums_of_any_lateness(spark, tmp_path):
    """Rows years apart in every batch, batches run again, compaction and a restart."""
    from tallyflow.streaming.additive import read_sums, write_partial

    rng = random.Random(3)
    path, total = str(tmp_path / "sums"), {}
    assert read_sums(spark, path, ["k"], ["x", "n"]) is None
    for batch in range(11):
        rows = [(rng.randrange(5), rng.randrange(100), 1) for _ in range(20)]
        for k, x, _ in rows:
            total[k] = total.get(k, 0) + x
        sums = spark.createDataFrame(rows, "k int, x long, n long").groupBy("k").sum("x", "n").toDF("k", "x", "n")
        for _ in range(1 + batch % 3):
            write_partial(sums, path, ["k"], ["x", "n"], batch, every=4)
        got = read_sums(spark, path, ["k"], ["x", "n"])
        assert {r["k"]: r["x"] for r in got.collect()} == total and got.agg({"n": "sum"}).first()[0] == 20 * (batch + 1)
    assert dict(got.dtypes) == {"k": "int", "x": "bigint", "n": "bigint"}


def test_month_totals_keep_rows_a_year_late(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for months in (["2024-06-01", "2025-01-01"], ["2022-01-05", "2024-06-09"], ["2024-06-30"]):
        rows = [(1, m, "Food", "expense", 2.5) for m in months]
        df = spark.createDataFrame(rows, "user_id long, ts string, category string, txn_type string, amount double")
        df = df.selectExpr("user_id", "CAST(ts AS timestamp_ntz) ts", "category", "txn_type", "CAST(amount AS decimal(18,2)) amount")
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        totals.start_month_totals(stream, out, checkpoint).awaitTermination()
    got = {r["month"].strftime("%Y-%m"): (float(r["total"]), r["n"]) for r in totals.read_month_totals(spark, out).collect()}
    assert got == {"2022-01": (2.5, 1), "2024-06": (7.5, 3), "2025-01": (2.5, 1)}


def feed_frame(spark, rows):
    schema = "user_id long, seq long, name string, amount double, date date, category array<string>"
    return spark.createDataFrame([(u, s, n, float(a), dt.date.fromisoformat(d), ["x"]) for u, s, n, a, d in rows], schema)


def stored_rows(spark, path):
    from tallyflow.sources.ledger import read_ledger

    return sorted((r["user_id"], r["description"], float(r["amount"]), r["ts"].date().isoformat()) for r in read_ledger(spark, path).collect())


def test_import_by_keys(spark, tmp_path, monkeypatch):
    """As the import that reads the ledger; late rows, copies, batches broken off between keys and rows, and compaction."""
    from tallyflow.sources import keys as keys_of

    rng = random.Random(5)
    plain, ledger, keys = (str(tmp_path / x) for x in ("plain", "ledger", "keys"))
    for batch in range(5):
        rows = [(rng.randrange(3), 100 * batch + i, f"n{rng.randrange(6)}", rng.randrange(1, 4), f"202{rng.randrange(4)}-0{rng.randrange(1, 10)}-01") for i in range(60)]
        feed = feed_frame(spark, rows)
        ingest.import_batch(feed, plain)
        if batch == 2:
            with monkeypatch.context() as broken:
                broken.setattr(ingest, "append_ledger", lambda *_: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    ingest.import_batch_by_keys(feed, ledger, keys, batch)
        for _ in range(1 + batch % 2):
            ingest.import_batch_by_keys(feed, ledger, keys, batch)
        if batch == 3:
            keys_of.compact_keys(spark, keys, ["2021-01", "2021-02", "2020-05"])
        assert stored_rows(spark, ledger) == stored_rows(spark, plain)
    held = keys_of.read_keys(spark, keys).select("user_id", "description", "amount", "ts").distinct().count()
    assert held == len(stored_rows(spark, ledger))


def test_a_late_row_reads_one_bucket(spark, tmp_path):
    """Of the keys only buckets of the batch's months are scanned, and the ledger not at all."""
    from tallyflow.sources import keys as keys_of
    from tallyflow.sources.feed import normalise_feed

    path = str(tmp_path / "keys")
    many = feed_frame(spark, [(u, u, f"n{u}", 1, f"2024-0{1 + u % 9}-01") for u in range(900)])
    keys_of.append_keys(normalise_feed(many), path, 0)
    late = keys_of.with_digest(normalise_feed(feed_frame(spark, [(9, 1, "n9", 1, "2024-01-01"), (7, 2, "new", 1, "2024-01-01")])))
    found = keys_of.known(late, keys_of.read_keys(spark, path))
    assert [(r["user_id"], r["description"]) for r in found.collect()] == [(9, "n9")]
    read = {f.split("/part-")[0].split("/keys/")[1] for f in keys_of.in_buckets(keys_of.read_keys(spark, path), late).select("_metadata.file_path").distinct().toPandas()["file_path"]}
    assert len(read) == late.select("bucket").distinct().count() and all(r.startswith("month=2024-01/") for r in read)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [concat_ws(/, month" in plan and str(tmp_path / "ledger") not in plan
    assert len([p for p in (tmp_path / "keys" / "month=2024-01").iterdir() if p.name.startswith("bucket=")]) == keys_of.BUCKETS


def test_task_states_equal_the_whole_log(spark, tmp_path):
    """After every batch, in any order, run again or not, before and after compaction."""
    from tallyflow.operators.tasks import latest_tasks
    from tallyflow.streaming import changes

    rng = random.Random(8)
    schema = "task_id long, change_id long, updated_at timestamp_ntz, op string, status string, result string, completed_at long, priority string"
    rows = []
    for i in range(400):
        op = rng.choice(["update", "update", "update", "rerun", "delete"])
        some = lambda *x: rng.choice([None, *x]) if op == "update" else None
        rows.append((rng.randrange(25), i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(200)), op, some("completed", "failed"), some("a", "b"), some(1, 2), some("high")))
    path, seen = str(tmp_path / "states"), []
    assert changes.current_tasks(spark, path) is None
    for batch in range(9):
        part = rows[batch::9]
        seen += part
        for _ in range(1 + batch % 2):
            changes.add_changes(spark.createDataFrame(part, schema), path, batch, every=4)
        if batch in (0, 3, 4, 8):
            want = latest_tasks(spark.createDataFrame(seen, schema))
            got = changes.current_tasks(spark, path).select(*want.columns)
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert not (tmp_path / "states" / "batch=0").exists()  # the log of old batches is gone
