import datetime as dt
import decimal
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from tallyflow.session import build_session  # noqa: E402

LEDGER = "txn_id bigint, user_id bigint, amount decimal(18,2), category string, txn_type string, ts timestamp_ntz"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_ledger(spark):
    """Rows (user, type, category, amount, 'yyyy-mm-dd[ hh:mm:ss]') to a ledger numbered in order."""

    def make(rows):
        data = [
            (i, user, decimal.Decimal(str(amount)), category, kind, dt.datetime.fromisoformat(when))
            for i, (user, kind, category, amount, when) in enumerate(rows)
        ]
        return spark.createDataFrame(data, LEDGER)

    return make


@pytest.fixture(scope="session")
def profiles(spark):
    def make(*rows):
        return spark.createDataFrame(list(rows), "user_id bigint, employment_type string, risk_tolerance string")

    return make
