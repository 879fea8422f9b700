"""Properties and edge tables."""

import datetime as dt
import re
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks.fixtures import Fixtures
from ledgerloom import schemas
from ledgerloom.functions.dates import parse_date
from ledgerloom.functions.money import clean_amount, fmt_money
from ledgerloom.functions.text import parse_tags
from ledgerloom.operators import categorise, filters, maintain, numbering, views
from ledgerloom.operators.merchants import BUILTIN_PATTERNS
from ledgerloom.plans import budgets, reports
from ledgerloom.sources import seeds, tables

START, END = dt.date(1995, 1, 1), dt.date(2001, 12, 31)


@pytest.fixture(scope="module")
def f(spark):
    return Fixtures(spark, "/root/testdata/sf0.001")


def test_shares_sum_to_100(f):
    rows = reports.with_share(reports.spending_by_category(f.txns, f.children, f.parents, START, END)).collect()
    assert sum(r["share"] for r in rows) == pytest.approx(100)


def test_split_lines_sum_to_total(f):
    assert reports.split_balance(f.txns, f.splits).filter("valid = 0").count() == 0
    sums = reports.split_shares(f.splits).groupBy("transaction_id").agg(F.sum("share").alias("s"))
    assert sums.filter(F.abs(F.col("s") - 100) > 1e-6).count() == 0


def test_bridge_ends_on_net_worth(f):
    total = views.net_worth_bridge(f.accounts).filter("kind = 'total'").first()["value"]
    assert float(total) == reports.net_worth(f.accounts).first()["net_worth"]


def test_cash_flow_sums_to_totals(f):
    flow = reports.monthly_cash_flow(f.txns, 12).collect()
    totals = reports.income_expense_totals(f.txns, 12).first()
    assert [r["month"] for r in flow] == sorted(r["month"] for r in flow) and len(flow) == 12
    assert sum(r["income"] - r["expenses"] for r in flow) == pytest.approx(totals["net"])


def test_sorted_pages_cover_all_rows(f):
    order = [r["id"] for r in filters.sort_ledger(f.txns, "amount", False).collect()]
    for limit in (10_000, 60):
        seen = []
        for number in (1, 2, 30, 60):
            seen.append([r["id"] for r in filters.page(f.txns, number, 25, "amount", False, sort_rows=limit).collect()])
        assert seen == [order[(n - 1) * 25 : n * 25] for n in (1, 2, 30, 60)]
    empty = f.txns.filter("id < 0")
    assert filters.page(empty, 3).count() == 0


def test_row_index_and_ids(spark):
    rows = spark.range(5000).withColumn("k", F.col("id") % 7)
    placed = numbering.row_index(rows, [F.col("k"), F.col("id").desc()])
    got = [r["id"] for r in placed.orderBy("row_index").collect()]
    assert got == sorted(range(5000), key=lambda i: (i % 7, -i))
    ids = numbering.assign_ids(rows.drop("k").withColumnRenamed("id", "n"), ["n"], spark.range(41).agg(F.max("id")))
    assert sorted(r["id"] for r in ids.collect()) == list(range(41, 5041))


def test_one_fingerprint_in_most_rows(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("hash"), "id")
    kept = maintain.first_of_each(rows, order=["id"])
    assert kept.filter("hash = 'hot'").collect()[0]["id"] == 0
    assert kept.count() == 1 + sum(1 for i in range(20_000) if i % 3)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.fixture(scope="module")
def empty(spark):
    return {
        "txns": spark.createDataFrame([], schemas.TRANSACTIONS),
        "accounts": spark.createDataFrame([], schemas.ACCOUNTS),
        "children": spark.createDataFrame([], schemas.CHILD_CATEGORIES),
        "parents": spark.createDataFrame([], schemas.PARENT_CATEGORIES),
        "budgets": spark.createDataFrame([], schemas.BUDGETS),
    }


def test_no_rows(empty):
    t, c, p = empty["txns"], empty["children"], empty["parents"]
    assert reports.monthly_cash_flow(t).count() == 0
    assert reports.category_month_pivot(t, c, p, START, END).columns[-1] == "Total"
    kpis = reports.period_kpis(t, c, START, END).first()
    assert (kpis["income"], kpis["expenses"], kpis["savings_rate"]) == (0.0, 0.0, 0.0)
    assert reports.net_worth(empty["accounts"]).first()["net_worth"] == 0.0
    assert reports.list_summary(t).first()["pages"] == 1
    assert budgets.budget_totals(empty["budgets"], t, c, p, "2024-01").first()["remaining"] == 0.0
    assert views.ledger_view(t, empty["accounts"], c, p).columns == views.LEDGER_COLUMNS


def ledger(spark, rows):
    full = [(i, 1, d, "x", Decimal(a), c, 0) for i, (d, a, c) in enumerate(rows)]
    names = "id BIGINT, account_id BIGINT, date DATE, description STRING, amount DECIMAL(18,2), child_category_id BIGINT, is_transfer INT"
    return spark.createDataFrame(full, names)


def test_all_uncategorised_and_zero_income(spark, f):
    rows = ledger(spark, [(dt.date(2024, 1, 5), "-10", None), (dt.date(2024, 3, 5), "-2.50", None)])
    assert reports.spending_by_category(rows, f.children, f.parents, START, dt.date(2025, 1, 1)).count() == 0
    kpis = reports.period_kpis(rows, f.children, START, dt.date(2025, 1, 1)).first()
    assert (kpis["expenses"], kpis["savings_rate"]) == (12.5, 0.0)
    report = reports.savings_report(rows).collect()
    assert [(r["month"], r["savings_rate"], r["cumulative"]) for r in report] == [("2024-01", -1000.0, -10.0), ("2024-03", -250.0, -12.5)]


def test_rate_rounds_half_to_even(spark):
    rows = ledger(spark, [(dt.date(2024, 1, 1), "400", None), (dt.date(2024, 1, 2), "-391", None)])
    assert reports.savings_report(rows).first()["savings_rate"] == 2.2


def test_carry_forward_kinds(spark):
    parents = spark.createDataFrame([(1, "P", None, None, 0)], schemas.PARENT_CATEGORIES)
    kinds = ["none", "underspent", "overspent", "both"]
    children = spark.createDataFrame([(i, 1, f"{k}{s}", None, None, 0) for i, (k, s) in enumerate((k, s) for k in kinds for s in (40, 160))], schemas.CHILD_CATEGORIES)
    rows, plan = [], []
    for i, (k, s) in enumerate((k, s) for k in kinds for s in (40, 160)):
        rows.append((dt.date(2023, 12, 9), str(-s), i))
        plan.append((i, i, dt.date(2023, 6, 1), Decimal(100), 0, k))
    table = spark.createDataFrame(plan, schemas.BUDGETS)
    got = budgets.budget_effective(table, ledger(spark, rows), children, parents, "2024-01").collect()
    assert {r["category"]: r["effective"] for r in got} == {
        "none40": 100, "none160": 100, "underspent40": 160, "underspent160": 100,
        "overspent40": 100, "overspent160": 40, "both40": 160, "both160": 40,
    }


def test_reports_by_household_match_single_runs(f):
    both = reports.monthly_cash_flow(f.txns, 2, by=["currency"]).collect()
    for currency in ("CAD", "USD"):
        one = reports.monthly_cash_flow(f.txns.filter(F.col("currency") == currency), 2).collect()
        assert [(r["month"], r["income"], r["expenses"]) for r in both if r["currency"] == currency] == [tuple(r) for r in one]


def test_seed_tables(spark):
    parents, children = tables.seed_categories(seeds.default_parents(spark), seeds.default_children(spark))
    rows = tables.seed_budgets(seeds.default_budgets(spark), parents, children, dt.date(2024, 1, 1))
    assert (parents.count(), children.count(), rows.count()) == (21, 130, 50)
    assert rows.agg(F.sum("amount")).first()[0] == Decimal("7902.00")


def test_builtin_patterns_agree_with_re(spark):
    texts = set()
    for pattern, _category in BUILTIN_PATTERNS:
        for part in pattern.split("(?!")[0].split("|"):
            word = part.replace(r"\b", "").replace("\\", "").replace("(ca", "ca").replace(")", "").replace("?", "")
            texts |= {word, word.upper(), f"x{word}", f"{word}x", f"pay {word} 12", f"{word} transit", f"{word} mastercard", f"é{word}"}
    compiled = [(re.compile(p, re.IGNORECASE), c) for p, c in BUILTIN_PATTERNS]
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "description STRING")
    for row in categorise.match_builtin(df).collect():
        want = next((c for p, c in compiled if p.search(row["description"])), None)
        assert row["builtin_category"] == want, row["description"]


NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789.,$()- +x", max_size=12), min_size=1, max_size=40))
def test_clean_amount_agrees_with_plain_python(spark, texts):
    def expected(text):
        bare = re.sub(r"[,$ ]", "", text)
        sign = 1
        if bare.startswith("(") and bare.endswith(")"):
            bare, sign = bare[1:-1], -1
        return sign * Decimal(bare) if NUMBER.fullmatch(bare) else Decimal(0)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = [r["a"] for r in df.select("i", clean_amount("t").alias("a")).orderBy("i").collect()]
    assert [g.quantize(Decimal("0.01")) for g in got] == [expected(t).quantize(Decimal("0.01"), rounding="ROUND_HALF_UP") for t in texts]


def test_small_functions(spark):
    df = spark.createDataFrame(
        [("-1234567.5", '["a","b"]', "31/02/2025"), ("0", "[bad", "Sept 1, 2025"), (None, None, " may  7, 2025 ")],
        "m STRING, tags STRING, d STRING",
    )
    got = df.select(fmt_money(F.col("m").cast("decimal(18,2)")).alias("m"), parse_tags("tags").alias("t"), parse_date("d").alias("d")).collect()
    assert [tuple(r) for r in got] == [("-$1,234,567.50", ["a", "b"], None), ("$0.00", [], None), ("$0.00", [], dt.date(2025, 5, 7))]


def test_plans_have_no_cartesian_product_or_python(f):
    for df in (
        reports.category_monthly(f.txns, f.children, f.parents, START, END),
        budgets.budget_performance(f.budgets, f.txns, f.children, f.parents, "1998-07"),
        views.ledger_view(f.txns, f.accounts, f.children, f.parents),
        categorise.categorise_batch(f.merchants, f.rules, f.children),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_period_filter_prunes_partitions(spark, f, tmp_path):
    path = str(tmp_path / "ledger")
    tables.write_transactions(f.txns, path)
    plan = tables.load_ledger(spark, path, dt.date(1998, 1, 1), dt.date(1998, 3, 31))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*month", plan) and "PushedFilters: [IsNotNull(date)" in plan


def test_bad_patterns_are_reported_and_passed_over(spark):
    from ledgerloom.operators.categorise import bad_rules, match_user_rules
    from ledgerloom.schemas import CHILD_CATEGORIES, RULES

    children = spark.createDataFrame([(1, 1, "A", None, None, 0), (2, 1, "B", None, None, 0)], CHILD_CATEGORIES)
    rules = spark.createDataFrame(
        [(1, "(broken", 1, "regex", 9, 0), (2, "sh[ao]p", 2, "regex", 5, 0), (3, "corner", 1, "contains", 5, 3), (4, "", 2, "contains", 1, 0)], RULES
    )
    texts = spark.createDataFrame([(1, "Corner shop"), (2, "a shap"), (3, "zz"), (4, ""), (5, None)], "id INT, description STRING")
    got = {r["id"]: r["rule_id"] for r in match_user_rules(texts, rules, children).collect()}
    assert got == {1: 3, 2: 2, 3: 4, 4: 4, 5: 4}
    assert [r["id"] for r in bad_rules(rules, children).collect()] == [1]


def test_rules_do_not_reach_the_plan(spark):
    """Ten thousand rules: the same plan as for ten, and each text finds the rule of its own number."""
    from ledgerloom.operators.categorise import match_user_rules
    from ledgerloom.schemas import CHILD_CATEGORIES, RULES

    children = spark.createDataFrame([(1, 1, "A", None, None, 0)], CHILD_CATEGORIES)
    rules = spark.createDataFrame([(n, f"shop {n} ", 1, ["contains", "startswith"][n % 2], 5, 0) for n in range(10_000)], RULES)
    texts = spark.createDataFrame([(n, f"SHOP {n} street") for n in range(0, 10_000, 7)], "id INT, description STRING")
    matched = match_user_rules(texts, rules, children)
    assert all(r["id"] == r["rule_id"] for r in matched.collect())
    assert "shop 4321" not in matched._jdf.queryExecution().toString()
