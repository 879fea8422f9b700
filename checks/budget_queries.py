"""Budgets, goals and investments."""

import datetime as dt

from pyspark.sql import functions as F

from checks.ledger_queries import END, IN_PERIOD, START
from checks.registry import check
from checks.report_queries import JOINED, TRANSFERS
from ledgerloom.functions.money import money_out
from ledgerloom.plans import budgets

MONTH = "1998-07"


def asof(day: str) -> str:
    return f"""SELECT b.*, c.name AS category FROM f_budgets b JOIN f_child_categories c ON b.child_category_id = c.id
        WHERE month_year = (SELECT max(x.month_year) FROM f_budgets x WHERE x.child_category_id = b.child_category_id
        AND x.month_year <= DATE '{day}')"""


def spent(day: str) -> str:
    return f"""SELECT n.category, sum(abs(t.amount)) AS spent FROM {JOINED} WHERE t.amount < 0 AND t.is_transfer = 0
        AND n.parent_is_income = 0 AND t.date BETWEEN DATE '{day}' AND last_day(DATE '{day}') GROUP BY 1"""


def performance(day: str) -> str:
    return f"""SELECT c.name AS category, b.amount AS budget, b.carry_forward_type, s.spent FROM f_child_categories c
        LEFT JOIN ({asof(day)}) b ON b.child_category_id = c.id LEFT JOIN ({spent(day)}) s ON s.category = c.name
        WHERE c.is_income = 0"""


def frames(f):
    return f.budgets, f.txns, f.children, f.parents


@check(
    "budgets_asof",
    f"SELECT id, category, month_year, CAST(amount AS DOUBLE) AS amount, carry_forward_type, 0 AS carry_forward FROM ({asof('1998-07-01')})",
)
def _(f):
    return budgets.budgets_asof(f.budgets, f.children, MONTH).drop("child_category_id").withColumn("amount", money_out("amount"))


@check(
    "budgets_asof_months",
    """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS month FROM f_transactions)
    SELECT m.month, c.name AS category, b.id, b.month_year, CAST(b.amount AS DOUBLE) AS amount FROM m
    JOIN f_budgets b ON b.month_year <= m.month JOIN f_child_categories c ON c.id = b.child_category_id
    QUALIFY row_number() OVER (PARTITION BY m.month, b.child_category_id ORDER BY b.month_year DESC) = 1""",
)
def _(f):
    months = f.txns.select(F.trunc("date", "MM").cast("date").alias("month")).distinct()
    rows = budgets.budgets_asof_months(f.budgets, f.children, months)
    return rows.select("month", "category", "id", "month_year", money_out("amount").alias("amount"))


def effective_sql(day: str, before: str) -> str:
    return f"""WITH j AS (SELECT c.name AS category, coalesce(b.carry_forward_type, 'none') AS kind, b.amount AS base,
        coalesce(p.amount, 0) - coalesce(s.spent, 0) AS delta FROM f_child_categories c
        LEFT JOIN ({asof(day)}) b ON b.child_category_id = c.id LEFT JOIN ({asof(before)}) p ON p.child_category_id = c.id
        LEFT JOIN ({spent(before)}) s ON s.category = c.name)
        SELECT category, kind AS carry_forward_type, CAST(coalesce(base, 0) AS DOUBLE) AS base,
        CAST(CASE WHEN base IS NULL THEN 0 WHEN kind = 'underspent' AND delta > 0 THEN base + delta
        WHEN kind = 'overspent' AND delta < 0 THEN base + delta WHEN kind = 'both' THEN base + delta ELSE base END AS DOUBLE) AS effective
        FROM j"""


@check("budget_effective", effective_sql("1998-07-01", "1998-06-01"))
def _(f):
    return budgets.budget_effective(*frames(f), MONTH)


@check("budget_effective_january", effective_sql("1999-01-01", "1998-12-01"))
def _(f):
    return budgets.budget_effective(*frames(f), "1999-01")


@check(
    "budget_performance",
    f"""SELECT *, CASE WHEN pct > 100 THEN 'over' WHEN pct > 75 THEN 'near' ELSE 'ok' END AS band FROM (
    SELECT category, coalesce(carry_forward_type, 'none') AS carry_forward_type, CAST(coalesce(budget, 0) AS DOUBLE) AS budgeted,
    CAST(coalesce(spent, 0) AS DOUBLE) AS spent, CAST(coalesce(budget, 0) - coalesce(spent, 0) AS DOUBLE) AS remaining,
    CASE WHEN coalesce(budget, 0) = 0 THEN 100 ELSE CAST(coalesce(spent, 0) AS DOUBLE) / CAST(budget AS DOUBLE) * 100 END AS pct
    FROM ({performance('1998-07-01')}) WHERE coalesce(budget, 0) > 0 OR coalesce(spent, 0) > 0)""",
)
def _(f):
    return budgets.budget_performance(*frames(f), MONTH)


# Two households share the categories; the second one's budgets are doubled and its rows are the odd ones.
def household(day):
    rows = performance(day)
    for h in (0, 1):
        own = rows.replace("f_transactions", f"(SELECT * FROM f_transactions WHERE id % 2 = {h})")
        own = own.replace("f_budgets", f"(SELECT id, child_category_id, month_year, CAST(amount * {h + 1} AS DECIMAL(18,2)) AS amount, carry_forward_type FROM f_budgets)")
        yield f"SELECT {h} AS household, * FROM ({own})"


def households(f):
    txns = f.txns.withColumn("household", (F.col("id") % 2).cast("int"))
    doubled = f.budgets.withColumn("amount", (F.col("amount") * 2).cast("decimal(18,2)"))
    both = f.budgets.withColumn("household", F.lit(0)).unionByName(doubled.withColumn("household", F.lit(1)))
    return both, txns


@check(
    "budget_performance_by_household",
    f"""SELECT household, category, CAST(coalesce(budget, 0) AS DOUBLE) AS budgeted, CAST(coalesce(spent, 0) AS DOUBLE) AS spent,
    CAST(coalesce(budget, 0) - coalesce(spent, 0) AS DOUBLE) AS remaining
    FROM ({' UNION ALL '.join(household('1998-07-01'))}) WHERE coalesce(budget, 0) > 0 OR coalesce(spent, 0) > 0""",
)
def _(f):
    both, txns = households(f)
    rows = budgets.budget_performance(both, txns, f.children, f.parents, MONTH, by=["household"])
    return rows.drop("carry_forward_type", "pct", "band")


@check(
    "budget_totals",
    f"""WITH b AS (SELECT coalesce(sum(amount), 0) AS b FROM ({asof('1998-07-01')})),
    s AS (SELECT coalesce(sum(spent), 0) AS s FROM ({performance('1998-07-01')}) WHERE budget IS NOT NULL)
    SELECT CAST(b AS DOUBLE) AS budgeted, CAST(s AS DOUBLE) AS spent, CAST(b - s AS DOUBLE) AS remaining FROM b, s""",
)
def _(f):
    return budgets.budget_totals(*frames(f), MONTH)


@check(
    "budget_totals_by_household",
    f"""WITH p AS ({' UNION ALL '.join(household('1998-07-01'))}),
    b AS (SELECT 0 AS household, sum(amount) AS b FROM ({asof('1998-07-01')}) UNION ALL SELECT 1, 2 * sum(amount) FROM ({asof('1998-07-01')})),
    s AS (SELECT household, sum(spent) AS s FROM p WHERE budget IS NOT NULL GROUP BY household)
    SELECT household, CAST(b AS DOUBLE) AS budgeted, CAST(coalesce(s, 0) AS DOUBLE) AS spent, CAST(b - coalesce(s, 0) AS DOUBLE) AS remaining
    FROM b LEFT JOIN s USING (household)""",
)
def _(f):
    both, txns = households(f)
    return budgets.budget_totals(both, txns, f.children, f.parents, MONTH, by=["household"])


@check(
    "budgets_asof_months_by_household",
    """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS month FROM f_transactions),
    h AS (SELECT 0 AS household, id, child_category_id, month_year, amount FROM f_budgets UNION ALL SELECT 1, id, child_category_id, month_year, 2 * amount FROM f_budgets)
    SELECT h.household, m.month, c.name AS category, h.id, CAST(h.amount AS DOUBLE) AS amount FROM m
    JOIN h ON h.month_year <= m.month JOIN f_child_categories c ON c.id = h.child_category_id
    QUALIFY row_number() OVER (PARTITION BY m.month, h.household, h.child_category_id ORDER BY h.month_year DESC) = 1""",
)
def _(f):
    months = f.txns.select(F.trunc("date", "MM").cast("date").alias("month")).distinct()
    rows = budgets.budgets_asof_months(households(f)[0], f.children, months, ["household"])
    return rows.select("household", "month", "category", "id", money_out("amount").alias("amount"))


@check(
    "unbudgeted_spend",
    f"SELECT category, CAST(spent AS DOUBLE) AS spent FROM ({performance('1995-06-01').replace('FROM f_budgets b', 'FROM (SELECT * FROM f_budgets WHERE id % 3 = 0) b').replace('FROM f_budgets x', 'FROM (SELECT * FROM f_budgets WHERE id % 3 = 0) x')}) WHERE budget IS NULL AND spent > 0",
)
def _(f):
    return budgets.unbudgeted_spend(f.budgets.filter("id % 3 = 0"), f.txns, f.children, f.parents, "1995-06")


ID_ORDER = "substr(md5(concat_ws('|', CAST(child_category_id AS VARCHAR), CAST(month_year AS VARCHAR))), 1, 2), child_category_id, month_year"


def upserted(updates: str) -> str:
    return f"""WITH u AS ({updates}),
    n AS (SELECT c.id AS child_category_id, u.month_year, u.amount, u.carry_forward_type FROM u JOIN f_child_categories c ON c.name = u.category),
    a AS (SELECT * FROM n ANTI JOIN f_budgets USING (child_category_id, month_year))
    SELECT id, child_category_id, month_year, CAST(amount AS DOUBLE) AS amount, carry_forward_type FROM f_budgets ANTI JOIN n USING (child_category_id, month_year)
    UNION ALL SELECT b.id, n.child_category_id, n.month_year, CAST(n.amount AS DOUBLE), n.carry_forward_type FROM n JOIN f_budgets b USING (child_category_id, month_year)
    UNION ALL SELECT (SELECT max(id) FROM f_budgets) + row_number() OVER (ORDER BY {ID_ORDER}), child_category_id, month_year, CAST(amount AS DOUBLE), carry_forward_type FROM a"""


@check("copy_budgets", upserted(f"SELECT category, DATE '1998-08-01' AS month_year, amount, 'none' AS carry_forward_type FROM ({asof('1998-07-01')})"))
def _(f):
    return budgets.copy_budgets(f.budgets, f.children, "1998-08").drop("carry_forward").withColumn("amount", money_out("amount"))


@check(
    "upsert_budgets",
    upserted(
        """SELECT concat('NATION_', CAST(account_id % 30 AS VARCHAR)) AS category, CAST(date_trunc('month', date) AS DATE) AS month_year,
        CAST(arg_max(abs(amount), id) AS DECIMAL(18,2)) AS amount, 'both' AS carry_forward_type FROM f_transactions GROUP BY 1, 2"""
    ),
)
def _(f):
    # as many updates of a category and month as it has transactions; the last one holds
    updates = f.txns.select(
        F.concat(F.lit("NATION_"), (F.col("account_id") % 30).cast("string")).alias("category"),
        F.col("date").alias("month"), F.abs("amount").alias("amount"), F.col("id").alias("seq"),
        F.lit("both").alias("carry_forward_type"),
    )
    changed = budgets.upsert_budgets(f.budgets, updates, f.children)
    return changed.drop("carry_forward").withColumn("amount", money_out("amount"))


@check(
    "upsert_budgets_effective",
    upserted(
        """SELECT name AS category, DATE '1998-06-01' AS month_year, CAST(id * 10 AS DECIMAL(18,2)) AS amount, 'none' AS carry_forward_type
        FROM f_child_categories"""
    ),
)
def _(f):
    updates = f.children.select(
        F.col("name").alias("category"), F.lit(dt.date(2001, 1, 1)).alias("month"),
        F.lit(dt.date(1998, 6, 17)).alias("effective_date"), (F.col("id") * 10).alias("amount"), F.lit(2).alias("seq"),
    )
    earlier = updates.withColumns({"amount": F.lit(1), "seq": F.lit(1), "effective_date": F.lit(dt.date(1998, 6, 30))})
    changed = budgets.upsert_budgets(f.budgets, updates.unionByName(earlier), f.children)
    return changed.drop("carry_forward").withColumn("amount", money_out("amount"))


@check(
    "goal_progress",
    """WITH j AS (SELECT g.*, a.name AS account_name, CASE WHEN goal_type = 'monthly' THEN coalesce(monthly_amount, 0)
    ELSE greatest(coalesce(a.balance, 0), 0) END AS done FROM f_goals g LEFT JOIN f_accounts a ON g.account_id = a.id),
    p AS (SELECT *, least(CASE WHEN target_amount = 0 THEN 0 ELSE CAST(done AS DOUBLE) / CAST(target_amount AS DOUBLE) * 100 END, 100) AS pct FROM j)
    SELECT id, name, goal_type, account_name, CAST(target_amount AS DOUBLE) AS target_amount, CAST(done AS DOUBLE) AS done, pct,
    CASE WHEN pct >= 100 THEN 'reached' WHEN pct >= 50 THEN 'half' ELSE 'started' END AS band FROM p""",
)
def _(f):
    return budgets.goal_progress(f.goals, f.accounts)


@check(
    "investment_accounts",
    """SELECT id, name[1:20] AS name, CAST(balance AS DOUBLE) AS balance, concat(institution, ' ', coalesce(account_number, '')) AS label
    FROM f_accounts WHERE type = 'investment' ORDER BY type, f_accounts.name, id LIMIT 4""",
)
def _(f):
    return budgets.investment_accounts(f.accounts)


@check(
    "investment_transfers",
    f"""SELECT id, date, description[1:40] AS description, from_account, to_account,
    coalesce(nullif(transfer_investment_cat, ''), 'General') AS category, CAST(abs(amount) AS DOUBLE) AS amount, currency
    FROM ({TRANSFERS}) WHERE {IN_PERIOD} AND (to_type = 'investment' OR coalesce(transfer_investment_cat, '') <> '')""",
)
def _(f):
    return budgets.investment_transfers(f.txns, f.accounts, START, END).withColumn("amount", money_out("amount"))
