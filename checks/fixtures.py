"""The given tables shaped as a ledger, once as DataFrames and once as SQL for the oracle."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

# Merchant texts for categorisation: hits for the built-in patterns and near misses.
MERCHANTS = [
    "NETFLIX.COM", "Spotify P1", "apple.com/bill", "DISNEY+ CA", "crave tv", "Amazon Prime", "YouTube Premium",
    "HBO MAX", "Tim Hortons", "TIMS ON KING", "timsbury ltd", "Starbucks", "Second Cup", "the coffee shop",
    "coffeehouse", "McDonald's 12", "MCDONALDS", "burger king", "Wendys", "SUBWAY", "subways", "KFC", "pizza hut",
    "A&W", "five guys", "Loblaws", "SAFEWAY", "metro", "metro transit", "METRO 45", "metropolis", "IGA", "costco",
    "Walmart", "food basics", "T&T Supermarket", "whole foods", "Zehrs", "farm boy", "ESSO", "petro-canada",
    "Petrocan", "shell", "shelley", "Husky", "circle k", "Sunoco", "TTC", "OC Transpo", "via rail", "metrolinx",
    "PRESTO", "Uber", "LYFT", "taxi", "Hydro One", "Enbridge", "union gas", "BELL", "bellevue", "Rogers",
    "rogers bank", "ROGERS wireless", "rogers mastercard", "Telus", "virgin mobile", "SHAW", "Shoppers Drug Mart",
    "rexall", "pharmacie", "jean coutu", "GoodLife", "YMCA", "amazon.ca", "AMAZON.COM", "amazon", "H&M", "lululemon",
    "winners", "best buy", "bistro", "sushi bar", "The Pub", "public", "the keg", "Swiss Chalet", "LCBO", "hilton",
    "booking.com", "WestJet", "dentist", "physio", "td mortgage", "e-transfer", "etransfer", "INTERAC",
    "bill payment", "annual fee", "NSF", "interest charge", "RRSP", "tax-free savings", "RESP", "dividend",
    "payroll", "CRA", "child benefit", "EI", "dollarama", "chapters", "IMAX", "impark", "desjardins",
    "canadian tire", "plain text", "", "café", "unknown shop",
]

# User rules: id, pattern, match type, priority, use count, child category id.
USER_RULES = [
    (1, "Rogers", "startswith", 5, 3, 1),
    (2, "metro", "contains", 5, 3, 2),
    (3, "METRO 45 #", "startswith", 9, 0, 3),
    (4, "costco #36", "exact", 7, 1, 4),
    (5, r"bell\w+ #\D*7", "regex", 7, 1, 7),
    (6, "shop", "contains", 5, 8, 8),
    (7, "coffee", "contains", 5, 8, 9),
    (8, "uber", "fuzzy", 99, 99, 11),
    (9, "e.transfer|interac", "regex", 1, None, 12),
    (10, "lost", "contains", 50, 0, 99),
]


def _texts(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


SQL = {
    "f_parent_categories": """
        SELECT r_regionkey AS id, r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'P' END AS icon, concat('#', CAST(r_regionkey AS VARCHAR)) AS color,
               CASE WHEN r_regionkey = 0 THEN 1 ELSE 0 END AS is_income FROM region""",
    "f_child_categories": """
        SELECT n_nationkey AS id, n_regionkey AS parent_id, n_name AS name,
               CASE WHEN n_nationkey % 2 = 0 THEN 'C' END AS icon, concat('#', CAST(n_nationkey AS VARCHAR)) AS color,
               CASE WHEN n_nationkey IN (0,5,10,15,20,6) THEN 1 ELSE 0 END AS is_income FROM nation""",
    "f_accounts": """
        SELECT c_custkey AS id, c_name AS name, concat('INST_', CAST(c_nationkey AS VARCHAR)) AS institution,
               CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'checking' WHEN 'MACHINERY' THEN 'credit'
                                 WHEN 'BUILDING' THEN 'mortgage' ELSE 'investment' END AS type,
               CASE WHEN c_custkey % 3 <> 0
                    THEN concat('****', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')) END AS account_number,
               'CAD' AS currency, CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM customer""",
    # One row, joined before the rest, so that no count stands in a join's condition.
    "f_sizes": "SELECT (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM customer) AS customers",
    "f_transactions": """
        SELECT o_orderkey AS id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS date, p_name AS description,
               CAST(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(18,2)) AS amount,
               CASE WHEN o_orderkey % 50 <> 49 THEN o_orderkey % 25 END AS child_category_id,
               CASE WHEN o_orderkey % 40 = 0 THEN 1 ELSE 0 END AS is_split,
               CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS is_transfer,
               CASE WHEN o_orderpriority = '5-LOW' THEN (o_custkey + 7) % customers END AS transfer_to_account_id,
               CASE WHEN o_orderpriority = '5-LOW'
                    THEN CASE o_orderkey % 3 WHEN 0 THEN 'RRSP' WHEN 1 THEN '' END END AS transfer_investment_cat,
               CASE WHEN o_orderkey % 20 = 0 THEN 'USD' ELSE 'CAD' END AS currency,
               CASE WHEN o_orderkey % 4 <> 0
                    THEN concat('["', o_orderpriority, '","', o_orderstatus, '"]') END AS tags
        FROM (SELECT orders.*, customers, o_orderkey % parts AS part_key FROM orders CROSS JOIN f_sizes) o JOIN part ON p_partkey = part_key""",
    "f_split_transactions": """
        SELECT t.id * 2 + k.k AS id, t.id AS transaction_id, (t.id + k.k) % 25 AS child_category_id,
               CASE WHEN k.k = 0 THEN CAST(t.amount * 0.6 AS DECIMAL(18,2))
                    ELSE CAST(t.amount - CAST(t.amount * 0.6 AS DECIMAL(18,2)) AS DECIMAL(18,2)) END AS amount,
               CASE WHEN k.k = 1 THEN concat('part of ', CAST(t.id AS VARCHAR)) END AS memo
        FROM f_transactions t CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) k WHERE t.is_split = 1""",
    "f_budgets": """
        SELECT n_nationkey * 10 + m.v AS id, n_nationkey AS child_category_id, m.d AS month_year,
               CAST(20000 + 1000 * n_nationkey + 500 * m.v AS DECIMAL(18,2)) AS amount,
               CASE n_nationkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'underspent' WHEN 2 THEN 'overspent'
                                    ELSE 'both' END AS carry_forward_type
        FROM nation CROSS JOIN (SELECT 0 AS v, DATE '1995-01-01' AS d UNION ALL SELECT 1, DATE '1998-06-01'
                                UNION ALL SELECT 2, DATE '2000-03-01') m
        WHERE n_nationkey % (m.v + 1) = 0 AND n_nationkey <> 24""",
    "f_goals": """
        SELECT c_custkey AS id, concat('goal ', CAST(c_custkey AS VARCHAR)) AS name,
               CASE WHEN c_custkey % 3 = 0 THEN 'monthly' ELSE 'total' END AS goal_type,
               CAST(1000 * (c_custkey % 6) AS DECIMAL(18,2)) AS target_amount,
               CASE WHEN c_custkey % 3 = 0 THEN CAST(50 * c_custkey AS DECIMAL(18,2)) END AS monthly_amount,
               CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS account_id FROM customer""",
    "f_raw_statement": """
        SELECT l_orderkey, l_linenumber, l_suppkey,
               CASE l_linenumber % 3 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d')
                    WHEN 1 THEN strftime(l_shipdate, '%m/%d/%Y') ELSE strftime(l_shipdate, '%b %d, %Y') END AS date_raw,
               CAST(l_shipdate AS DATE) AS date_true,
               p_name AS desc_raw,
               CASE WHEN l_returnflag = 'R' THEN concat('(', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), ')')
                    WHEN l_returnflag = 'A' THEN concat('$', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR))
                    ELSE concat(' ', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), ' ') END AS amount_raw,
               CAST(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,2)) AS amount_true
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "f_merchants": f"""
        SELECT o_orderkey AS id, concat(([{_texts(MERCHANTS)}])[o_orderkey % {len(MERCHANTS)} + 1], ' #',
               CAST(o_orderkey AS VARCHAR)) AS description,
               CASE o_orderkey % 7 WHEN 0 THEN 'NATION_3' WHEN 1 THEN 'Uncategorized' WHEN 2 THEN '' END AS category
        FROM orders""",
    "f_rules": "SELECT * FROM (VALUES "
    + ", ".join(
        f"({i}, {_texts([p])}, '{m}', {pr}, {'NULL' if u is None else u}, {c})" for i, p, m, pr, u, c in USER_RULES
    )
    + ") r(id, pattern, match_type, priority, use_count, child_category_id)",
    "f_names": """
        SELECT c.id AS child_category_id, c.name AS category, c.is_income AS child_is_income, p.name AS parent_category,
               p.is_income AS parent_is_income
        FROM f_child_categories c JOIN f_parent_categories p ON c.parent_id = p.id""",
    "f_ledger": """
        SELECT t.*, a.name AS account_name, a.account_number, n.parent_category AS parent_cat_name,
               n.category AS child_cat_name, coalesce(n.category, 'Uncategorized') AS category
        FROM f_transactions t LEFT JOIN f_accounts a ON t.account_id = a.id
        LEFT JOIN f_names n ON t.child_category_id = n.child_category_id""",
}

_NAME = re.compile(r"\bf_[a-z_]+\b")


def with_views(sql: str) -> str:
    """Prefixes a query with the views it uses, as CTEs."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in SQL and name not in order:
                visit(SQL[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    ctes = ",\n".join(f"{name} AS ({SQL[name]})" for name in order)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Fixtures:
    """Lazily built frames of one testdata folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def size(self, name: str) -> int:
        """Rows of a table; keys of parts and customers run from 0, so this is the modulus that reaches all of them."""
        return self.table(name).count()

    @cached_property
    def parents(self) -> DataFrame:
        key = F.col("r_regionkey")
        return self.table("region").select(
            key.alias("id"), F.col("r_name").alias("name"), F.when(key % 2 == 0, "P").alias("icon"), F.concat(F.lit("#"), key.cast("string")).alias("color"),
            F.when(key == 0, 1).otherwise(0).alias("is_income"),
        )

    @cached_property
    def children(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self.table("nation").select(
            key.alias("id"), F.col("n_regionkey").alias("parent_id"), F.col("n_name").alias("name"),
            F.when(key % 2 == 0, "C").alias("icon"), F.concat(F.lit("#"), key.cast("string")).alias("color"),
            F.when(key.isin(0, 5, 10, 15, 20, 6), 1).otherwise(0).alias("is_income"),
        )

    @cached_property
    def accounts(self) -> DataFrame:
        key, segment = F.col("c_custkey"), F.col("c_mktsegment")
        kind = (
            F.when(segment == "HOUSEHOLD", "checking").when(segment == "MACHINERY", "credit")
            .when(segment == "BUILDING", "mortgage").otherwise("investment")
        )
        number = F.concat(F.lit("****"), F.lpad((key % 10000).cast("string"), 4, "0"))
        return self.table("customer").select(
            key.alias("id"), F.col("c_name").alias("name"),
            F.concat(F.lit("INST_"), F.col("c_nationkey").cast("string")).alias("institution"),
            kind.alias("type"), F.when(key % 3 != 0, number).alias("account_number"), F.lit("CAD").alias("currency"),
            F.col("c_acctbal").cast(MONEY).alias("balance"),
        )

    @cached_property
    def txns(self) -> DataFrame:
        key, low = F.col("o_orderkey"), F.col("o_orderpriority") == "5-LOW"
        names = self.table("part").select("p_partkey", "p_name")
        rows = self.table("orders").join(names, F.col("p_partkey") == key % self.size("part"))
        price = F.col("o_totalprice")
        return rows.select(
            key.alias("id"), F.col("o_custkey").alias("account_id"), F.col("o_orderdate").cast("date").alias("date"),
            F.col("p_name").alias("description"),
            F.when(F.col("o_orderstatus") == "P", price).otherwise(-price).cast(MONEY).alias("amount"),
            F.when(key % 50 != 49, key % 25).alias("child_category_id"),
            F.when(key % 40 == 0, 1).otherwise(0).alias("is_split"),
            F.when(low, 1).otherwise(0).alias("is_transfer"),
            F.when(low, (F.col("o_custkey") + 7) % self.size("customer")).alias("transfer_to_account_id"),
            F.when(low, F.when(key % 3 == 0, "RRSP").when(key % 3 == 1, "")).alias("transfer_investment_cat"),
            F.when(key % 20 == 0, "USD").otherwise("CAD").alias("currency"),
            F.when(
                key % 4 != 0,
                F.concat(F.lit('["'), F.col("o_orderpriority"), F.lit('","'), F.col("o_orderstatus"), F.lit('"]')),
            ).alias("tags"),
        )

    @cached_property
    def splits(self) -> DataFrame:
        first = (F.col("amount") * F.lit(0.6).cast("decimal(2,1)")).cast(MONEY)
        rows = self.txns.filter(F.col("is_split") == 1).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
        return rows.select(
            (F.col("id") * 2 + F.col("k")).alias("id"), F.col("id").alias("transaction_id"),
            ((F.col("id") + F.col("k")) % 25).alias("child_category_id"),
            F.when(F.col("k") == 0, first).otherwise((F.col("amount") - first).cast(MONEY)).alias("amount"),
            F.col("k").alias("line"), F.when(F.col("k") == 1, F.concat(F.lit("part of "), F.col("id").cast("string"))).alias("memo"),
        )

    @cached_property
    def budgets(self) -> DataFrame:
        key = F.col("n_nationkey")
        dates = [(0, "1995-01-01"), (1, "1998-06-01"), (2, "2000-03-01")]
        steps = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(d).cast("date").alias("d")) for v, d in dates])
        kind = F.when(key % 4 == 0, "none").when(key % 4 == 1, "underspent").when(key % 4 == 2, "overspent").otherwise("both")
        rows = self.table("nation").withColumn("m", F.explode(steps))
        return rows.filter((key % (F.col("m.v") + 1) == 0) & (key != 24)).select(
            (key * 10 + F.col("m.v")).alias("id"), key.alias("child_category_id"), F.col("m.d").alias("month_year"),
            (20000 + 1000 * key + 500 * F.col("m.v")).cast(MONEY).alias("amount"), kind.alias("carry_forward_type"),
        )

    @cached_property
    def goals(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("id"), F.concat(F.lit("goal "), key.cast("string")).alias("name"),
            F.when(key % 3 == 0, "monthly").otherwise("total").alias("goal_type"),
            (1000 * (key % 6)).cast(MONEY).alias("target_amount"),
            F.when(key % 3 == 0, (50 * key).cast(MONEY)).alias("monthly_amount"),
            F.when(key % 5 != 0, key).alias("account_id"),
        )

    @cached_property
    def raw(self) -> DataFrame:
        line = F.col("l_linenumber") % 3
        price = F.col("l_extendedprice").cast(MONEY).cast("string")
        day = F.col("l_shipdate")
        parts = self.table("part").select("p_partkey", "p_name")
        rows = self.table("lineitem").join(parts, F.col("p_partkey") == F.col("l_partkey"))
        return rows.select(
            "l_orderkey", "l_linenumber", "l_suppkey",
            F.when(line == 0, F.date_format(day, "yyyy-MM-dd")).when(line == 1, F.date_format(day, "MM/dd/yyyy"))
            .otherwise(F.date_format(day, "MMM dd, yyyy")).alias("date_raw"),
            F.col("p_name").alias("desc_raw"),
            F.when(F.col("l_returnflag") == "R", F.concat(F.lit("("), price, F.lit(")")))
            .when(F.col("l_returnflag") == "A", F.concat(F.lit("$"), price))
            .otherwise(F.concat(F.lit(" "), price, F.lit(" "))).alias("amount_raw"),
        )

    @cached_property
    def merchants(self) -> DataFrame:
        key = F.col("o_orderkey")
        texts = F.array(*[F.lit(m) for m in MERCHANTS])
        name = F.element_at(texts, (key % len(MERCHANTS) + 1).cast("int"))
        return self.table("orders").select(
            key.alias("id"), F.concat(name, F.lit(" #"), key.cast("string")).alias("description"),
            F.when(key % 7 == 0, "NATION_3").when(key % 7 == 1, "Uncategorized").when(key % 7 == 2, "").alias("category"),
        )

    @cached_property
    def rules(self) -> DataFrame:
        return self.spark.createDataFrame(
            USER_RULES,
            "id BIGINT, pattern STRING, match_type STRING, priority INT, use_count BIGINT, child_category_id BIGINT",
        )

    @cached_property
    def view(self) -> DataFrame:
        from ledgerloom.operators.views import ledger_view

        return ledger_view(self.txns, self.accounts, self.children, self.parents)


def text_of(tags: Column) -> Column:
    """Tags as one text, for outputs that both engines can hash alike."""
    return F.array_join(tags, ",")
