"""Filters, projections, joins, sorts and set operations on the ledger."""

import datetime as dt

from pyspark.sql import functions as F

from checks.fixtures import text_of
from checks.registry import check
from ledgerloom.functions import dates, text
from ledgerloom.functions.money import fmt_money, money_out
from ledgerloom.operators import filters, views
from ledgerloom.operators.numbering import row_index

START, END = dt.date(1997, 1, 1), dt.date(1998, 12, 31)
IN_PERIOD = "date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"
TAGS_SQL = "coalesce(array_to_string(CAST(CAST(tags AS JSON) AS VARCHAR[]), ','), '')"
ROW = "SELECT id, date, CAST(amount AS DOUBLE) AS amount, category FROM f_ledger"


def row(df):
    return df.select("id", "date", money_out("amount").alias("amount"), "category")


# --- filters -------------------------------------------------------------------


@check("between_dates", f"{ROW} WHERE {IN_PERIOD}")
def _(f):
    return row(filters.between_dates(f.view, START, END))


@check("between_dates_open", f"{ROW} WHERE date >= DATE '2000-01-01'")
def _(f):
    return row(filters.between_dates(f.view, dt.date(2000, 1, 1)))


@check("by_account", f"{ROW} WHERE account_id IN (3, 7, 11)")
def _(f):
    return row(filters.by_account(f.view, [3, 7, 11]))


@check("by_category", f"{ROW} WHERE category IN ('NATION_3', 'Uncategorized')")
def _(f):
    return row(filters.by_category(f.view, ["NATION_3", "Uncategorized"]))


@check("by_category_strict", f"{ROW} WHERE child_cat_name = 'NATION_3'")
def _(f):
    return row(filters.by_category_strict(f.view, "NATION_3"))


@check("search", f"{ROW} WHERE contains(lower(description), 'ring')")
def _(f):
    return row(filters.search(f.view, "RING"))


@check("search_wildcards", f"{ROW} WHERE description ILIKE '%r_d%w%'")
def _(f):
    return row(filters.search(f.view, "R_D%w", wildcards=True))


@check("with_any_tag", f"{ROW} WHERE tags LIKE '%\"1-URGENT\"%' OR tags LIKE '%\"P\"%'")
def _(f):
    return row(filters.with_any_tag(f.view, ["1-URGENT", "P"]))


@check("by_flow_expense", f"{ROW} WHERE amount < 0")
def _(f):
    return row(filters.by_flow(f.view, "expense"))


@check("by_flow_income", f"{ROW} WHERE amount > 0")
def _(f):
    return row(filters.by_flow(f.view, "income"))


@check("by_abs_amount_above", f"{ROW} WHERE abs(amount) > 250000")
def _(f):
    return row(filters.by_abs_amount(f.view, ">", 250000))


@check("by_abs_amount_below", f"{ROW} WHERE abs(amount) < 20000")
def _(f):
    return row(filters.by_abs_amount(f.view, "<", 20000))


@check("exclude_transfers", f"{ROW} WHERE coalesce(is_transfer, 0) = 0")
def _(f):
    return row(filters.exclude_transfers(f.view))


@check("only_transfers", f"{ROW} WHERE is_transfer = 1")
def _(f):
    return row(filters.only_transfers(f.view))


@check("exclude_categories", f"{ROW} WHERE category NOT IN ('NATION_3', 'NATION_7')")
def _(f):
    return row(filters.exclude_categories(f.view, ["NATION_3", "NATION_7"]))


@check(
    "resolve_period",
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS today FROM orders),
    m AS (SELECT today, CAST(date_trunc('month', today) AS DATE) AS f FROM d)
    SELECT today, 'Last 30 Days' AS period, CAST(today - 30 AS DATE) AS start_date, today AS end_date FROM m
    UNION ALL SELECT today, 'This Month', f, last_day(today) FROM m
    UNION ALL SELECT today, 'Last Month', CAST(date_trunc('month', f - 1) AS DATE), CAST(f - 1 AS DATE) FROM m
    UNION ALL SELECT today, 'Last 3 Months', CAST(date_trunc('month', f - 90) AS DATE), today FROM m
    UNION ALL SELECT today, 'Last 6 Months', CAST(date_trunc('month', f - 180) AS DATE), today FROM m
    UNION ALL SELECT today, 'This Year', CAST(date_trunc('year', today) AS DATE), today FROM m""",
)
def _(f):
    today = F.col("today")
    spans = []
    for name in dates.PERIODS:
        start, end = dates.resolve_period(name, today)
        spans.append(F.struct(F.lit(name).alias("period"), start.alias("start_date"), end.alias("end_date")))
    days = f.txns.select(F.col("date").alias("today")).distinct()
    return days.select("today", F.explode(F.array(*spans)).alias("s")).select("today", "s.*")


# --- projections ---------------------------------------------------------------


@check(
    "ledger_view",
    f"""SELECT id, account_id, date, description, CAST(amount AS DOUBLE) AS amount, is_split, is_transfer,
       transfer_to_account_id, transfer_investment_cat, currency, {TAGS_SQL} AS tags, account_name, account_number,
       parent_cat_name, child_cat_name, category, CAST(NULL AS VARCHAR) AS original_desc, CAST(NULL AS VARCHAR) AS memo,
       CAST(NULL AS VARCHAR) AS notes, CAST(NULL AS DOUBLE) AS ai_confidence FROM f_ledger""",
)
def _(f):
    return f.view.withColumns(
        {"ai_confidence": F.col("ai_confidence").cast("double"), "original_desc": F.col("original_desc").cast("string"), "memo": F.col("memo").cast("string"), "notes": F.col("notes").cast("string"), "amount": money_out("amount"), "tags": text_of(F.col("tags"))}
    )


@check(
    "money_out",
    """SELECT id, coalesce(CAST(monthly_amount AS DOUBLE), 0.0) AS monthly, CAST(target_amount AS DOUBLE) AS target
       FROM f_goals""",
)
def _(f):
    return f.goals.select("id", money_out("monthly_amount").alias("monthly"), money_out("target_amount").alias("target"))


@check(
    "parse_tags",
    f"SELECT id, {TAGS_SQL} AS tags, CASE WHEN tags IS NULL THEN 0 ELSE 2 END AS tag_count FROM f_transactions",
)
def _(f):
    tags = text.parse_tags("tags")
    return f.txns.select("id", text_of(tags).alias("tags"), F.size(tags).alias("tag_count"))


@check(
    "category_path",
    """SELECT t.id, concat(n.parent_category, ' > ', n.category) AS category_path, n.category AS child
       FROM f_transactions t JOIN f_names n ON t.child_category_id = n.child_category_id""",
)
def _(f):
    rows = views.categorised(f.txns, f.children, f.parents)
    path = text.category_path("parent_category", "category")
    return rows.select("id", path.alias("category_path"), text.child_of_path(path).alias("child"))


@check(
    "category_paths",
    "SELECT category, concat(parent_category, ' > ', category) AS category_path FROM f_names",
)
def _(f):
    return views.category_paths(f.children, f.parents).select("category", "category_path")


@check(
    "fmt_money",
    """SELECT id, concat(CASE WHEN amount < 0 THEN '-$' ELSE '$' END, format('{:,}', CAST(floor(abs(amount)) AS BIGINT)),
       '.', lpad(CAST(CAST((abs(amount) - floor(abs(amount))) * 100 AS BIGINT) AS VARCHAR), 2, '0')) AS shown
       FROM f_transactions""",
)
def _(f):
    return f.txns.select("id", fmt_money("amount").alias("shown"))


@check(
    "recent_transactions",
    f"""SELECT id, date, description[1:42] AS description, category, CAST(amount AS DOUBLE) AS amount,
       coalesce(account_name[1:18], '') AS account FROM f_ledger WHERE {IN_PERIOD} ORDER BY date DESC, id DESC LIMIT 10""",
)
def _(f):
    rows = views.recent_transactions(f.txns, f.accounts, f.children, f.parents, START, END)
    return rows.withColumn("amount", money_out("amount"))


# --- joins ---------------------------------------------------------------------


@check(
    "categorised",
    """SELECT t.id, n.category, n.parent_category, n.child_is_income, n.parent_is_income
       FROM f_transactions t JOIN f_names n ON t.child_category_id = n.child_category_id""",
)
def _(f):
    rows = views.categorised(f.txns, f.children, f.parents)
    return rows.select("id", "category", "parent_category", "child_is_income", "parent_is_income")


@check(
    "transfers",
    f"""SELECT t.id, t.date, a.name AS from_account, d.name AS to_account, t.transfer_investment_cat AS inv_category,
       CAST(t.amount AS DOUBLE) AS amount FROM f_transactions t LEFT JOIN f_accounts a ON t.account_id = a.id
       LEFT JOIN f_accounts d ON t.transfer_to_account_id = d.id WHERE t.is_transfer = 1 AND {IN_PERIOD}""",
)
def _(f):
    rows = views.transfers(f.txns, f.accounts, START, END)
    return rows.select("id", "date", "from_account", "to_account", "inv_category", money_out("amount").alias("amount"))


@check(
    "goals_view",
    """SELECT g.id, g.name, g.goal_type, CAST(g.target_amount AS DOUBLE) AS target_amount, a.name AS account_name
       FROM f_goals g LEFT JOIN f_accounts a ON g.account_id = a.id""",
)
def _(f):
    rows = views.goals_view(f.goals, f.accounts)
    return rows.select("id", "name", "goal_type", money_out("target_amount").alias("target_amount"), "account_name")


@check(
    "splits_of",
    """SELECT s.id, s.transaction_id, c.name AS category, CAST(s.amount AS DOUBLE) AS amount, s.memo
       FROM f_split_transactions s JOIN f_child_categories c ON s.child_category_id = c.id""",
)
def _(f):
    rows = views.splits_of(f.splits, f.children, f.txns)
    return rows.select("id", "transaction_id", "category", money_out("amount").alias("amount"), "memo")


@check(
    "resolve_category",
    "SELECT m.id, m.category, c.id AS child_category_id FROM f_merchants m LEFT JOIN f_child_categories c ON m.category = c.name",
)
def _(f):
    return views.resolve_category(f.merchants, f.children).select("id", "category", "child_category_id")


@check(
    "unresolved_categories",
    """SELECT category, count(*) AS rows FROM f_merchants WHERE category NOT IN (SELECT name FROM f_child_categories)
       GROUP BY category""",
)
def _(f):
    return views.unresolved_categories(f.merchants, f.children)


SPENT = f"""SELECT n.category, n.parent_category, sum(abs(t.amount)) AS total
    FROM f_transactions t JOIN f_names n ON t.child_category_id = n.child_category_id
    WHERE t.amount < 0 AND t.is_transfer = 0 AND t.{IN_PERIOD} AND n.parent_is_income = 0 GROUP BY ALL"""


@check(
    "drilldown",
    f"""SELECT id, category, date, CAST(abs(amount) AS DOUBLE) AS amount, {TAGS_SQL} AS tags FROM f_ledger
       WHERE amount < 0 AND {IN_PERIOD} AND category IN (SELECT category FROM ({SPENT}))""",
)
def _(f):
    from ledgerloom.plans.reports import spending_by_category

    report = spending_by_category(f.txns, f.children, f.parents, START, END)
    rows = views.drilldown(filters.between_dates(f.view, START, END), report, "expense")
    return rows.select("id", "category", "date", money_out(F.abs("amount")).alias("amount"), text_of(F.col("tags")).alias("tags"))


# --- sorts, pages --------------------------------------------------------------


@check(
    "ledger",
    f"""WITH top AS (SELECT * FROM f_ledger WHERE {IN_PERIOD} AND description ILIKE '%e%' ORDER BY date DESC, id DESC LIMIT 400)
       SELECT id, date, CAST(amount AS DOUBLE) AS amount, category FROM top WHERE tags LIKE '%"2-HIGH"%'""",
)
def _(f):
    return row(
        views.ledger(f.txns, f.accounts, f.children, f.parents, start=START, end=END, search="e", tags=["2-HIGH"], limit=400)
    )


@check(
    "ledger_category",
    f"""SELECT id, date, CAST(amount AS DOUBLE) AS amount, category FROM f_ledger
       WHERE child_cat_name = 'NATION_4' ORDER BY date DESC, id DESC LIMIT 50""",
)
def _(f):
    return row(views.ledger(f.txns, f.accounts, f.children, f.parents, category="NATION_4", limit=50))


def _sorted(name, key, descending, sql_order):
    @check(
        name,
        f"""SELECT id, date, CAST(amount AS DOUBLE) AS amount, row_number() OVER (ORDER BY {sql_order}) - 1 AS place
            FROM f_transactions""",
    )
    def _(f):
        placed = row_index(f.txns, filters.sort_order(key, descending), "place")
        rows = filters.sort_ledger(placed, key, descending)
        return rows.select("id", "date", money_out("amount").alias("amount"), "place")


_sorted("sort_ledger_newest", "date", True, "date DESC, id DESC")
_sorted("sort_ledger_oldest", "date", False, "date, id DESC")
_sorted("sort_ledger_largest", "amount", True, "amount DESC, date DESC, id DESC")
_sorted("sort_ledger_smallest", "amount", False, "amount, date DESC, id DESC")


@check("page", "SELECT id, date, CAST(amount AS DOUBLE) AS amount FROM f_transactions ORDER BY date DESC, id DESC LIMIT 25 OFFSET 50")
def _(f):
    return filters.page(f.txns, 3).select("id", "date", money_out("amount").alias("amount"))


@check(
    "page_last",
    """SELECT id, date, CAST(amount AS DOUBLE) AS amount FROM (SELECT *, row_number() OVER (ORDER BY amount DESC, date DESC, id DESC) - 1 AS place,
       count(*) OVER () AS n FROM f_transactions) WHERE place >= ((n + 24) // 25 - 1) * 25""",
)
def _(f):
    rows = filters.page(f.txns, 10**9, key="amount", sort_rows=100)
    return rows.select("id", "date", money_out("amount").alias("amount"))


@check(
    "page_deep",
    "SELECT id, date, CAST(amount AS DOUBLE) AS amount FROM f_transactions ORDER BY amount, date DESC, id DESC LIMIT 25 OFFSET 500",
)
def _(f):
    rows = filters.page(f.txns, 21, key="amount", descending=False, sort_rows=100)
    return rows.select("id", "date", money_out("amount").alias("amount"))


# --- set operations ------------------------------------------------------------


@check(
    "categories_view",
    """SELECT id, name, coalesce(icon, '💰') AS icon, color, is_income, CAST(NULL AS VARCHAR) AS parent
       FROM f_parent_categories UNION ALL
       SELECT c.id, c.name, coalesce(c.icon, '💰'), c.color, c.is_income, p.name
       FROM f_child_categories c JOIN f_parent_categories p ON c.parent_id = p.id""",
)
def _(f):
    return views.categories_view(f.children, f.parents)


@check(
    "all_tags",
    """SELECT DISTINCT tag FROM (SELECT unnest(CAST(CAST(tags AS JSON) AS VARCHAR[])) AS tag FROM f_transactions
       WHERE tags IS NOT NULL AND tags <> '[]') WHERE tag IS NOT NULL AND tag <> ''""",
)
def _(f):
    return views.all_tags(f.txns)


@check(
    "unused_tags",
    """WITH s AS (SELECT DISTINCT coalesce(tags, '[]') AS tags FROM f_transactions),
       k AS (SELECT DISTINCT unnest(CAST(CAST(tags AS JSON) AS VARCHAR[])) AS tag FROM s)
       SELECT s.tags, string_agg(k.tag, ',' ORDER BY k.tag) AS unused FROM s, k
       WHERE NOT list_contains(CAST(CAST(s.tags AS JSON) AS VARCHAR[]), k.tag) GROUP BY s.tags""",
)
def _(f):
    return views.unused_tags(f.txns, f.txns).select("tags", text_of(F.col("unused")).alias("unused"))


# Households whose tags differ: the account's number, and each has tags of a month of its own.
HOUSE_TAGS = """SELECT account_id % 7 AS household, date, CASE WHEN tags IS NOT NULL AND month(date) % 7 <= account_id % 7
    THEN concat('["m', CAST(month(date) AS VARCHAR), '",', substr(tags, 2)) ELSE tags END AS tags FROM f_transactions"""


def house_tags(f):
    house, month = F.col("account_id") % 7, F.month("date")
    own = F.concat(F.lit('["m'), month.cast("string"), F.lit('",'), F.substr("tags", F.lit(2)))
    return f.txns.select(house.alias("household"), "date", F.when(F.col("tags").isNotNull() & (month % 7 <= house), own).otherwise(F.col("tags")).alias("tags"))


@check(
    "all_tags_by_household",
    f"""SELECT DISTINCT household, unnest(CAST(CAST(tags AS JSON) AS VARCHAR[])) AS tag FROM ({HOUSE_TAGS})""",
)
def _(f):
    return views.all_tags(house_tags(f), ["household"])


@check(
    "unused_tags_by_household",
    f"""WITH t AS ({HOUSE_TAGS}), s AS (SELECT DISTINCT household, coalesce(tags, '[]') AS tags FROM t WHERE date >= DATE '1998-01-01'),
       k AS (SELECT DISTINCT household, unnest(CAST(CAST(tags AS JSON) AS VARCHAR[])) AS tag FROM t)
       SELECT s.household, s.tags, coalesce(string_agg(k.tag, ',' ORDER BY k.tag) FILTER (NOT list_contains(CAST(CAST(s.tags AS JSON) AS VARCHAR[]), k.tag)), '') AS unused
       FROM s LEFT JOIN k ON k.household = s.household GROUP BY s.household, s.tags""",
)
def _(f):
    rows = house_tags(f)
    asked = rows.filter("date >= DATE '1998-01-01'")
    return views.unused_tags(rows, asked, ["household"]).select("household", "tags", text_of(F.col("unused")).alias("unused"))


BRIDGE = """SELECT name, CASE WHEN type IN ('checking', 'investment') THEN 'asset' ELSE 'liability' END AS kind,
    CASE WHEN type IN ('checking', 'investment') THEN balance ELSE -abs(balance) END AS value FROM f_accounts
    WHERE type IN ('credit', 'mortgage') OR balance > 0"""


@check(
    "net_worth_bridge",
    f"""SELECT name, kind, CAST(value AS DOUBLE) AS value FROM ({BRIDGE})
        UNION ALL SELECT 'Net Worth', 'total', CAST(sum(value) AS DOUBLE) FROM ({BRIDGE})""",
)
def _(f):
    return views.net_worth_bridge(f.accounts).withColumn("value", money_out("value"))


@check(
    "month_grid",
    """WITH y AS (SELECT DISTINCT CAST(date_trunc('year', date) AS DATE) AS january FROM f_transactions)
       SELECT DISTINCT january, CAST(unnest(generate_series(january - INTERVAL 12 MONTH, january + INTERVAL 23 MONTH, INTERVAL 1 MONTH)) AS DATE)
       AS month FROM y""",
)
def _(f):
    years = f.txns.select(F.trunc("date", "YEAR").cast("date").alias("january")).distinct()
    return years.select("january", F.explode(dates.month_grid(F.col("january"))).alias("month"))
