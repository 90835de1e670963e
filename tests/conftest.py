import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

LEDGER_SCHEMA = ("account_id string, txn_date date, description string, amount decimal(18,2), "
                 "category string, confidence double")


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("ledgerspark-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "4g")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def m(x) -> Decimal | None:
    return None if x is None else Decimal(str(x)).quantize(Decimal("0.01"))


@pytest.fixture
def ledger(spark):
    """Build a canonical ledger from (account, date, description, amount, category[, conf])."""
    def make(rows):
        out = []
        for r in rows:
            acct, date, desc, amt, cat = r[:5]
            conf = r[5] if len(r) > 5 else 1.0
            out.append((acct, d(date) if date else None, desc, m(amt), cat, conf))
        return spark.createDataFrame(out, LEDGER_SCHEMA)
    return make
