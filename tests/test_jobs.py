"""Jobs on a stored ledger, and pages: what they read and rewrite."""

import datetime as dt
import os
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import filters
from ledgerloom.plans import jobs
from ledgerloom.schemas import CHILD_CATEGORIES, SPLITS
from ledgerloom.session import settings
from ledgerloom.sources import tables
from ledgerloom.sources.ledger import Ledger


@pytest.fixture
def ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = [(n, 1, dt.date(2025, 1 + n % 6, 5), f"row {n}", Decimal(n), 0, 0, "[]") for n in range(60)]
    names = "id BIGINT, account_id BIGINT, date DATE, description STRING, amount DECIMAL(18,2), is_split INT, is_transfer INT, tags STRING"
    tables.write_transactions(spark.createDataFrame(rows, names), path)
    return path


def files(path):
    return {(d[len(path) :], f, os.path.getmtime(f"{d}/{f}")) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet") and "high" not in d}


def test_only_the_months_of_changed_rows_are_read_and_written(spark, ledger):
    children = spark.createDataFrame([(1, 1, "Food", None, None, 0)], CHILD_CATEGORIES)
    before, rows = files(ledger), {r["id"]: r for r in tables.load_ledger(spark, ledger).collect()}
    changes = spark.createDataFrame([(7, "Food", None, "n", 1), (13, None, '["x"]', None, 1)], "id BIGINT, category STRING, tags STRING, notes STRING, seq INT")
    assert jobs.correct_ledger(spark, ledger, changes, children) == ["2025-02"]
    after = files(ledger)
    assert {d for d, *_ in before ^ after} == {"/month=2025-02"}
    now = {r["id"]: r for r in tables.load_ledger(spark, ledger).collect()}
    assert now.keys() == rows.keys() and {i for i in now if now[i] != rows[i]} == {7, 13}
    assert (now[7]["child_category_id"], now[7]["notes"], now[13]["tags"]) == (1, "n", '["x"]')

    marks = spark.createDataFrame([(5, 9, "TFSA", 1), (999, 9, "TFSA", 1)], "id BIGINT, dest_account_id BIGINT, inv_category STRING, seq INT")
    assert jobs.mark_ledger(spark, ledger, marks) == ["2025-06"]
    splits = spark.createDataFrame([], SPLITS)
    new = spark.createDataFrame([(6, 0, "Food", Decimal(1)), (6, 1, "Food", Decimal(2))], "transaction_id BIGINT, line INT, category STRING, amount DECIMAL(18,2)")
    table, months = jobs.split_ledger(spark, ledger, splits, new, children)
    assert months == ["2025-01"] and table.count() == 2
    last = {r["id"]: r for r in tables.load_ledger(spark, ledger).collect()}
    assert last[5]["transfer_to_account_id"] == 9 and last[6]["is_split"] == 1 and len(last) == 60
    assert jobs.mark_ledger(spark, ledger, marks.filter("id = 999")) == []


def test_the_change_scans_its_month_alone(spark, ledger, monkeypatch):
    plans = []
    real = tables.stored
    monkeypatch.setattr(tables, "stored", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or real(df, name))
    marks = spark.createDataFrame([(5, 9, "TFSA", 1)], "id BIGINT, dest_account_id BIGINT, inv_category STRING, seq INT")
    jobs.mark_ledger(spark, ledger, marks)
    assert re.search(r"PartitionFilters: [^]]*2025-06", plans[0])


def test_ids_follow_the_high_water_mark(spark, ledger):
    rows = spark.createDataFrame([(dt.date(2025, 3, 1), "a"), (dt.date(2025, 4, 1), "b")], "date DATE, hash STRING")
    assert tables.high_water(spark, ledger) == 59
    tables.append_transactions(rows, ledger)
    assert sorted(r["id"] for r in tables.load_ledger(spark, ledger).filter("hash IS NOT NULL").collect()) == [60, 61]
    assert tables.high_water(spark, ledger) == 61
    tables.append_transactions(rows.limit(0), ledger)
    assert tables.high_water(spark, ledger) == 61 and tables.load_ledger(spark, ledger).count() == 62
    # the mark comes from its own table, without a scan of the ledger
    spark.createDataFrame([(1_000,)], "high BIGINT").write.mode("append").parquet(f"{ledger}/{tables.HIGH_WATER}")
    tables.append_transactions(rows.limit(1), ledger)
    assert tables.load_ledger(spark, ledger).filter("id > 900").count() == 1


@pytest.mark.parametrize("key, descending", [("date", True), ("amount", False), ("amount", True), ("description", True), ("description", False)])
def test_pages_of_hot_and_missing_keys(spark, key, descending):
    """A third of the rows share a date and an amount, some have none; any page is that of the sorted rows."""
    rng = random.Random(6)
    rows = []
    for n in range(900):
        hot = n % 3 == 0
        day = dt.date(2025, 1, 1) if hot else None if n % 50 == 1 else dt.date(2025, 1, 1) + dt.timedelta(rng.randrange(400))
        amount = Decimal(5) if hot else None if n % 40 == 1 else Decimal(rng.randrange(-10**6, 10**6)) / 100
        rows.append((n, day, amount, None if n % 60 == 1 else rng.choice(["aaaaaaa", "aaaaaab", "Zé", "", "b"]) if not hot else "hot"))
    df = spark.createDataFrame(rows, "id BIGINT, date DATE, amount DECIMAL(18,2), description STRING").cache()
    want = [r["id"] for r in filters.sort_ledger(df, key, descending).collect()]
    for number in (1, 2, 13, 20, 36, 99):
        at = min(number, 36)
        assert [r["id"] for r in filters.page(df, number, 25, key, descending, sort_rows=40).collect()] == want[(at - 1) * 25 : at * 25]


def test_a_page_sorts_few_rows(spark):
    df = spark.range(100_000).selectExpr("id", "DATE '2000-01-01' + CAST(id % 5000 AS INT) AS date")
    parts = filters._parts_of_page(df, [("date", True), ("id", True)], filters.F.lit(True), 50_000, 25, 100_000, 500)
    assert sum(df.filter(where).count() for where, _, _ in parts) <= 1000


@pytest.mark.parametrize("buckets", [None, 5])
def test_batches_meet_the_ledger_as_it_lies(spark, tmp_path, buckets):
    """No exchange and no scan of other months on the ledger's side; ids go on in another session."""
    path = str(tmp_path / "ledger")
    ledger = Ledger.create(spark, path, buckets)

    def batch(first, last):
        rows = [(dt.date(2025, 1 + n % 4, 1), f"row {n}", f"hash {n % 148}", Decimal(n)) for n in range(first, last)]
        return spark.createDataFrame(rows, "date DATE, description STRING, hash STRING, amount DECIMAL(18,2)").withColumn("source_row", F.col("amount"))

    assert ledger.append(ledger.new_rows(batch(0, 100)).drop("source_row")) == 100
    ledger = Ledger.open(spark, path)
    some = batch(80, 200).filter("date = DATE '2025-02-01'")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__shuffle__partitions=str(ledger.buckets)):
        plan = ledger.unknown(some)._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("FileScan parquet") :]
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in side
    assert "Bucketed: true" in side and re.search(r"PartitionFilters: [^]]*month[^]]*2025-02", side) and "2025-03" not in side
    assert sorted(r["hash"] for r in ledger.new_rows(some).collect()) == sorted({f"hash {n}" for n in range(100, 148) if n % 4 == 1})
    assert ledger.append(ledger.new_rows(batch(80, 260)).drop("source_row")) == 48
    rows = tables.load_ledger(spark, path).collect()
    assert sorted(r["id"] for r in rows) == list(range(1, 149)) and len({r["hash"] for r in rows}) == 148
    assert ledger.append(ledger.new_rows(batch(0, 260)).drop("source_row")) == 0
