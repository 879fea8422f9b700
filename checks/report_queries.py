"""Aggregations, window functions and reports."""

from pyspark.sql import functions as F

from checks.ledger_queries import BRIDGE, END, IN_PERIOD, SPENT, START
from checks.registry import check
from ledgerloom.functions.money import money_out
from ledgerloom.operators import filters, views
from ledgerloom.plans import reports
from ledgerloom.sources.seeds import CATEGORY_TREE

CATEGORY = "n.category, n.parent_category"
JOINED = "f_transactions t JOIN f_names n ON t.child_category_id = n.child_category_id"
EARNED = f"""SELECT {CATEGORY}, sum(t.amount) AS total FROM {JOINED}
    WHERE t.amount > 0 AND t.is_transfer = 0 AND t.{IN_PERIOD} AND n.parent_is_income = 1 GROUP BY ALL"""
FLOW = """SELECT strftime(date, '%Y-%m') AS month, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS income,
    sum(CASE WHEN amount < 0 THEN abs(amount) ELSE 0 END) AS expenses FROM f_transactions
    WHERE coalesce(is_transfer, 0) = 0 GROUP BY 1 ORDER BY 1 DESC LIMIT 12"""
NET = f"SELECT *, income - expenses AS net FROM ({FLOW})"
RATES = f"""SELECT *, round_even(CAST(net AS DOUBLE) / CASE WHEN income = 0 THEN 1 ELSE CAST(income AS DOUBLE) END * 100, 1) AS savings_rate,
    sum(net) OVER (ORDER BY month) AS cumulative FROM ({NET})"""
TAX_LIKE = "(lower(category) LIKE '%nation_1%' OR lower(category) LIKE '%_7%')"


def args(f):
    return f.txns, f.children, f.parents


@check(
    "monthly_cash_flow",
    f"SELECT month, CAST(income AS DOUBLE) AS income, CAST(expenses AS DOUBLE) AS expenses FROM ({FLOW})",
)
def _(f):
    return reports.monthly_cash_flow(f.txns, 12)


@check(
    "monthly_cash_flow_by_account",
    """WITH m AS (SELECT account_id, strftime(date, '%Y-%m') AS month, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS income,
       sum(CASE WHEN amount < 0 THEN abs(amount) ELSE 0 END) AS expenses FROM f_transactions WHERE is_transfer = 0 GROUP BY 1, 2)
       SELECT account_id, month, CAST(income AS DOUBLE) AS income, CAST(expenses AS DOUBLE) AS expenses FROM m
       QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY month DESC) <= 3""",
)
def _(f):
    return reports.monthly_cash_flow(f.txns, 3, by=["account_id"])


@check("spending_by_category", f"SELECT category, parent_category, CAST(total AS DOUBLE) AS total FROM ({SPENT})")
def _(f):
    return reports.spending_by_category(*args(f), START, END)


@check(
    "spending_by_category_by_account",
    f"""SELECT t.account_id, {CATEGORY}, CAST(sum(abs(t.amount)) AS DOUBLE) AS total FROM {JOINED}
    WHERE t.amount < 0 AND t.is_transfer = 0 AND n.parent_is_income = 0 GROUP BY ALL""",
)
def _(f):
    return reports.spending_by_category(*args(f), by=["account_id"])


@check("income_by_category", f"SELECT category, parent_category, CAST(total AS DOUBLE) AS total FROM ({EARNED})")
def _(f):
    return reports.income_by_category(*args(f), START, END)


@check(
    "category_monthly",
    f"""SELECT strftime(t.date, '%Y-%m') AS month, n.parent_category, n.category, n.parent_is_income AS is_income,
    CAST(sum(t.amount) AS DOUBLE) AS total FROM {JOINED} WHERE t.is_transfer = 0 AND t.{IN_PERIOD} GROUP BY ALL""",
)
def _(f):
    return reports.category_monthly(*args(f), START, END)


@check(
    "period_kpis",
    f"""WITH k AS (SELECT sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS i, sum(CASE WHEN amount < 0 THEN abs(amount) ELSE 0 END) AS e
    FROM f_ledger WHERE is_transfer = 0 AND {IN_PERIOD} AND category NOT IN ('NATION_3', 'NATION_7'))
    SELECT CAST(i AS DOUBLE) AS income, CAST(e AS DOUBLE) AS expenses, CAST(i - e AS DOUBLE) AS savings,
    CASE WHEN i = 0 THEN 0 ELSE CAST(i - e AS DOUBLE) / CAST(i AS DOUBLE) * 100 END AS savings_rate FROM k""",
)
def _(f):
    return reports.period_kpis(f.txns, f.children, START, END, skip=["NATION_3", "NATION_7"])


@check(
    "net_worth",
    f"""SELECT CAST(sum(CASE WHEN kind = 'asset' THEN value ELSE 0 END) AS DOUBLE) AS assets,
    CAST(sum(CASE WHEN kind = 'liability' THEN -value ELSE 0 END) AS DOUBLE) AS liabilities,
    CAST(sum(value) AS DOUBLE) AS net_worth FROM ({BRIDGE})""",
)
def _(f):
    return reports.net_worth(f.accounts)


@check(
    "net_worth_by_household",
    f"""SELECT household, CAST(sum(CASE WHEN kind = 'asset' THEN value ELSE 0 END) AS DOUBLE) AS assets,
    CAST(sum(CASE WHEN kind = 'liability' THEN -value ELSE 0 END) AS DOUBLE) AS liabilities,
    CAST(sum(value) AS DOUBLE) AS net_worth FROM ({BRIDGE.replace('SELECT name,', 'SELECT institution AS household, name,')}) GROUP BY 1""",
)
def _(f):
    return reports.net_worth(f.accounts.withColumn("household", F.col("institution")), by=["household"])


@check(
    "list_summary",
    """SELECT count(*) AS row_count, CAST(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS DOUBLE) AS income,
    CAST(sum(CASE WHEN amount < 0 THEN abs(amount) ELSE 0 END) AS DOUBLE) AS expenses,
    greatest((count(*) + 24) // 25, 1) AS pages FROM f_ledger WHERE category IN ('NATION_2', 'NATION_9')""",
)
def _(f):
    return reports.list_summary(filters.by_category(f.view, ["NATION_2", "NATION_9"]))


@check(
    "spending_by_parent",
    f"""SELECT parent_category, category, CAST(grouping(category) AS INTEGER) AS is_parent, CAST(sum(total) AS DOUBLE) AS total
    FROM ({SPENT}) GROUP BY GROUPING SETS ((parent_category, category), (parent_category))""",
)
def _(f):
    return reports.spending_by_parent(*args(f), START, END).withColumn("is_parent", F.col("is_parent").cast("int"))


@check(
    "category_month_pivot",
    f"""WITH s AS (SELECT strftime(t.date, '%Y-%m') AS month, {CATEGORY}, sum(t.amount) AS total FROM {JOINED}
    WHERE t.is_transfer = 0 AND t.{IN_PERIOD} GROUP BY ALL),
    r AS (SELECT parent_category, coalesce(category, '(all)') AS category, month, sum(total) AS total FROM s
          GROUP BY GROUPING SETS ((parent_category, category, month), (parent_category, month))),
    g AS (SELECT * FROM (SELECT DISTINCT parent_category, category FROM r), (SELECT DISTINCT month FROM r))
    SELECT g.parent_category, g.category, g.month, CAST(coalesce(r.total, 0) AS DOUBLE) AS total
    FROM g LEFT JOIN r USING (parent_category, category, month)
    UNION ALL SELECT parent_category, category, 'Total', CAST(sum(total) AS DOUBLE) FROM r GROUP BY ALL""",
)
def _(f):
    wide = reports.category_month_pivot(*args(f), START, END)
    fixed = ["parent_category", "category"]
    months = [c for c in wide.columns if c not in (*fixed, "is_parent")]
    named = wide.withColumn("category", F.coalesce("category", F.lit("(all)")))
    return named.unpivot(fixed, months, "month", "total")


TRANSFERS = """SELECT t.*, d.name AS to_account, d.type AS to_type, a.name AS from_account FROM f_transactions t
    LEFT JOIN f_accounts a ON t.account_id = a.id LEFT JOIN f_accounts d ON t.transfer_to_account_id = d.id WHERE is_transfer = 1"""


@check(
    "contributions_by_category",
    f"""SELECT coalesce(nullif(transfer_investment_cat, ''), nullif(to_account, ''), 'General') AS category,
    CAST(sum(abs(amount)) AS DOUBLE) AS total FROM ({TRANSFERS}) GROUP BY 1""",
)
def _(f):
    return reports.contributions_by_category(f.txns, f.accounts)


@check(
    "spending_facts",
    f"""SELECT CAST(sum(total) AS DOUBLE) AS total, arg_min(category, (-total, category)) AS top_category, count(*) AS categories,
    CAST(sum(total) AS DOUBLE) / 729 AS avg_per_day FROM ({SPENT})""",
)
def _(f):
    return reports.spending_facts(*args(f), START, END)


@check(
    "income_facts",
    f"""SELECT CAST(sum(total) AS DOUBLE) AS total, count(*) AS categories,
    CAST(sum(total) AS DOUBLE) / 729 AS avg_per_day FROM ({EARNED})""",
)
def _(f):
    return reports.income_facts(*args(f), START, END)


@check(
    "savings_report",
    f"""SELECT month, CAST(income AS DOUBLE) AS income, CAST(expenses AS DOUBLE) AS expenses, CAST(net AS DOUBLE) AS net,
    savings_rate, CAST(cumulative AS DOUBLE) AS cumulative FROM ({RATES})""",
)
def _(f):
    return reports.savings_report(f.txns)


@check(
    "savings_stats",
    f"""SELECT CAST(sum(net) AS DOUBLE) AS total_saved, CAST(sum(net) AS DOUBLE) / count(*) AS avg_month,
    CAST(sum(CAST(savings_rate AS DECIMAL(28,1))) AS DOUBLE) / count(*) AS avg_rate, max(savings_rate) AS peak_rate FROM ({RATES})""",
)
def _(f):
    return reports.savings_stats(f.txns)


@check(
    "monthly_summary",
    f"""SELECT CAST(sum(income) AS DOUBLE) AS income, CAST(sum(expenses) AS DOUBLE) AS expenses,
    CAST(sum(net) AS DOUBLE) / count(*) AS avg_net, arg_min(month, (-net, month)) AS best_month FROM ({NET})""",
)
def _(f):
    return reports.monthly_summary(f.txns)


@check(
    "monthly_rates",
    f"""SELECT month, CAST(income AS DOUBLE) AS income, CAST(expenses AS DOUBLE) AS expenses, CAST(net AS DOUBLE) AS net,
    savings_rate FROM ({RATES})""",
)
def _(f):
    return reports.monthly_rates(f.txns)


@check(
    "income_expense_totals",
    f"SELECT CAST(sum(income) AS DOUBLE) AS income, CAST(sum(expenses) AS DOUBLE) AS expenses, CAST(sum(net) AS DOUBLE) AS net FROM ({NET})",
)
def _(f):
    return reports.income_expense_totals(f.txns)


@check(
    "tax_report",
    f"""SELECT category, parent_category, CAST(total AS DOUBLE) AS total,
    CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE) * 100 AS share FROM ({SPENT}) WHERE {TAX_LIKE}""",
)
def _(f):
    return reports.tax_report(*args(f), START, END, words=["nation_1", "_7"])


# Child names from the default tree, so that the default words meet names they were made for.
DEFAULT_NAMES = [name for names in CATEGORY_TREE.values() for name in names]
DEFAULT_NAMES = sorted(dict.fromkeys(DEFAULT_NAMES), key=lambda n: not any(w in n.lower() for w in reports.TAX_WORDS))[:25][::-1]
NAMED = f"([{', '.join(chr(39) + n.replace(chr(39), chr(39) * 2) + chr(39) for n in DEFAULT_NAMES)}])[CAST(substr(category, 8) AS INTEGER) + 1]"
DEFAULT_LIKE = " OR ".join(f"contains(lower(category), '{w}')" for w in reports.TAX_WORDS)
DEFAULT_SPENT = f"SELECT * FROM (SELECT {NAMED} AS category, parent_category, total FROM ({SPENT})) WHERE {DEFAULT_LIKE}"


def named_children(f):
    names = F.array(*[F.lit(n) for n in DEFAULT_NAMES])
    return f.children.withColumn("name", F.element_at(names, (F.col("id") + 1).cast("int")))


@check(
    "tax_report_default_words",
    f"SELECT category, parent_category, CAST(total AS DOUBLE) AS total, CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE) * 100 AS share FROM ({DEFAULT_SPENT})",
)
def _(f):
    return reports.tax_report(f.txns, named_children(f), f.parents, START, END)


@check(
    "tax_totals_default_words",
    f"""WITH i AS (SELECT sum(total) AS i FROM ({EARNED})), x AS (SELECT sum(total) AS x FROM ({DEFAULT_SPENT}))
    SELECT CAST(i AS DOUBLE) AS income_total, CAST(x AS DOUBLE) AS tax_total, CAST(x AS DOUBLE) / CAST(i AS DOUBLE) * 100 AS deductible_rate FROM i, x""",
)
def _(f):
    return reports.tax_totals(f.txns, named_children(f), f.parents, START, END)


@check(
    "tax_totals",
    f"""WITH i AS (SELECT sum(total) AS i FROM ({EARNED})), x AS (SELECT sum(total) AS x FROM ({SPENT}) WHERE {TAX_LIKE})
    SELECT CAST(i AS DOUBLE) AS income_total, CAST(x AS DOUBLE) AS tax_total, CAST(x AS DOUBLE) / CAST(i AS DOUBLE) * 100 AS deductible_rate
    FROM i, x""",
)
def _(f):
    return reports.tax_totals(*args(f), START, END, words=["nation_1", "_7"])


@check(
    "table_counts",
    """SELECT 'transactions' AS table_name, count(*) AS row_count FROM f_transactions UNION ALL
    SELECT 'accounts', count(*) FROM f_accounts UNION ALL SELECT 'categorization_rules', count(*) FROM part UNION ALL
    SELECT 'goals', count(*) FROM f_goals""",
)
def _(f):
    return reports.table_counts(
        {"transactions": f.txns, "accounts": f.accounts, "categorization_rules": f.table("part"), "goals": f.goals}
    )


@check(
    "category_sizes",
    """SELECT p.name, p.is_income, count(c.id) AS children FROM f_parent_categories p
    LEFT JOIN f_child_categories c ON c.parent_id = p.id GROUP BY ALL""",
)
def _(f):
    return reports.category_sizes(f.children, f.parents)


@check(
    "split_balance",
    """WITH s AS (SELECT transaction_id, sum(amount) AS allocated FROM f_split_transactions GROUP BY 1)
    SELECT t.id AS transaction_id, CAST(t.amount AS DOUBLE) AS total, CAST(allocated AS DOUBLE) AS allocated,
    CAST(t.amount - allocated AS DOUBLE) AS leftover, CASE WHEN abs(t.amount - allocated) <= 0.01 THEN 1 ELSE 0 END AS valid
    FROM f_transactions t JOIN s ON s.transaction_id = t.id""",
)
def _(f):
    return reports.split_balance(f.txns, f.splits)


@check(
    "split_balance_broken",
    """WITH s AS (SELECT transaction_id, sum(amount) AS allocated FROM f_split_transactions WHERE child_category_id % 5 <> 1 GROUP BY 1)
    SELECT t.id AS transaction_id, CAST(t.amount - allocated AS DOUBLE) AS leftover,
    CASE WHEN abs(t.amount - allocated) <= 0.01 THEN 1 ELSE 0 END AS valid
    FROM f_transactions t JOIN s ON s.transaction_id = t.id""",
)
def _(f):
    return reports.split_balance(f.txns, f.splits.filter("child_category_id % 5 <> 1")).select("transaction_id", "leftover", "valid")


@check(
    "accounts_by_type",
    "SELECT type, count(*) AS accounts, CAST(sum(balance) AS DOUBLE) AS balance FROM f_accounts GROUP BY type",
)
def _(f):
    return reports.accounts_by_type(f.accounts)


@check(
    "accounts_listing",
    "SELECT id, name, institution, type, account_number, currency, CAST(balance AS DOUBLE) AS balance FROM f_accounts",
)
def _(f):
    return reports.accounts_listing(f.accounts)


@check("running_net", f"SELECT month, CAST(net AS DOUBLE) AS net, CAST(cumulative AS DOUBLE) AS cumulative FROM ({RATES})")
def _(f):
    return reports.running_net(f.txns)


@check(
    "with_share",
    f"""SELECT category, parent_category, CAST(total AS DOUBLE) AS total,
    CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE) * 100 AS share FROM ({SPENT})""",
)
def _(f):
    return reports.with_share(reports.spending_by_category(*args(f), START, END))


@check(
    "top_spending",
    f"""SELECT category, parent_category, CAST(total AS DOUBLE) AS total, least(p, 100.0) AS pct,
    CASE WHEN p > 80 THEN 'high' WHEN p > 50 THEN 'medium' ELSE 'low' END AS band
    FROM (SELECT *, CAST(total AS DOUBLE) / CAST(max(total) OVER () AS DOUBLE) * 100 AS p FROM ({SPENT}) ORDER BY total DESC, category LIMIT 7)""",
)
def _(f):
    return reports.top_spending(*args(f), START, END)


@check(
    "top_categories",
    f"SELECT category, parent_category, CAST(total AS DOUBLE) AS total FROM ({SPENT}) ORDER BY total DESC, category LIMIT 10",
)
def _(f):
    return reports.top_categories(*args(f), START, END)


@check(
    "split_shares",
    """SELECT id, transaction_id, CAST(amount AS DOUBLE) AS amount, CAST(abs(amount) AS DOUBLE) /
    CASE WHEN sum(abs(amount)) OVER w = 0 THEN 1 ELSE CAST(sum(abs(amount)) OVER w AS DOUBLE) END * 100 AS share
    FROM f_split_transactions WINDOW w AS (PARTITION BY transaction_id)""",
)
def _(f):
    return reports.split_shares(f.splits).select("id", "transaction_id", money_out("amount").alias("amount"), "share")
