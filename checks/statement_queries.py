"""Statement files: scan, header roles, normalisation, import and export."""

from pyspark.sql import functions as F

from checks.fixtures import text_of
from checks.ledger_queries import END, IN_PERIOD, START
from checks.registry import check
from ledgerloom.functions import dates, text
from ledgerloom.functions.money import clean_amount, memo_balance, memo_mortgage, money_out
from ledgerloom.operators import normalise
from ledgerloom.operators.numbering import assign_ids
from ledgerloom.plans import imports
from ledgerloom.session import shared_folder, shuffles_dropped
from ledgerloom.sources import seeds, statements, tables
from ledgerloom.streaming.imports import import_stream

KEY = "l_orderkey, l_linenumber"
SEEDED = [(p, c, *look) for p, names in seeds.CATEGORY_TREE.items() for c, look in zip(names, seeds.CHILD_LOOKS[p], strict=True)]
WRITE = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def lineage(f, file_by="l_suppkey"):
    """The raw rows with a file per supplier and a position that orders a file."""
    return f.table("lineitem").join(f.table("part"), F.col("p_partkey") == F.col("l_partkey")).select(
        F.concat(F.lit("file_"), F.col(file_by).cast("string")).alias("source_file"),
        F.col("l_orderkey").alias("source_block"),
        (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey")).alias("source_row"),
        "*",
    )


def cells(f):
    """Raw rows with lineage and the statement texts of f_raw_statement."""
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    line, day = F.col("l_linenumber") % 3, F.col("l_shipdate")
    return lineage(f).withColumns(
        {
            "date_raw": F.when(line == 0, F.date_format(day, "yyyy-MM-dd"))
            .when(line == 1, F.date_format(day, "MM/dd/yyyy"))
            .otherwise(F.date_format(day, "MMM dd, yyyy")),
            "amount_raw": F.when(F.col("l_returnflag") == "R", F.concat(F.lit("("), price, F.lit(")")))
            .when(F.col("l_returnflag") == "A", F.concat(F.lit("$"), price))
            .otherwise(F.concat(F.lit(" "), price, F.lit(" "))),
        }
    )


LINEAGE = statements.LINEAGE


# --- files ---------------------------------------------------------------------


def raw_csv(f):
    """The raw statement rows as files with odd header blanks and words for missing cells."""
    return f.raw.select(
        F.col("date_raw").alias(" Date "),
        F.when(F.col("l_linenumber") == 3, "N/A").otherwise(F.col("desc_raw")).alias("Description"),
        F.col("amount_raw").alias("Amount"),
        F.col("l_linenumber").alias("line"),
    )


MISSING = "CASE WHEN l_linenumber <> 3 THEN desc_raw END"


@check("read_statement", f'SELECT date_raw AS "Date", {MISSING} AS "Description", amount_raw AS "Amount" FROM f_raw_statement')
def _(f):
    path = shared_folder(f.spark, "statement")
    raw_csv(f).drop("line").write.options(**WRITE).csv(path)
    return statements.read_statement(f.spark, path).drop(*statements.LINEAGE)


@check(
    "read_statement_many",
    """SELECT CAST(l_linenumber % 4 AS VARCHAR) AS account, count(*) AS parsed, count(CASE WHEN l_linenumber <> 3 THEN 1 END) AS described
    FROM f_raw_statement GROUP BY 1""",
)
def _(f):
    path = shared_folder(f.spark, "statement")
    raw_csv(f).withColumn("account", F.col("line") % 4).drop("line").write.options(**WRITE).partitionBy("account").csv(path)
    files = statements.read_statement(f.spark, [f"{path}/account={i}" for i in range(4)])
    account = F.regexp_extract("source_file", r"account=(\d+)", 1).alias("account")
    return files.groupBy(account).agg(F.count(F.lit(1)).alias("parsed"), F.count("Description").alias("described"))


@check(
    "read_statements",
    f'SELECT date_raw AS "Date", {MISSING} AS "Description", amount_raw AS "Amount" FROM f_raw_statement',
)
def _(f):
    path = shared_folder(f.spark, "statement")
    rows = raw_csv(f)
    even = F.col("line") % 2 == 0
    rows.filter(even).select(" Date ", "Description", "Amount").write.options(**WRITE).csv(f"{path}/a")
    rows.filter(~even).select("Amount", "Description", F.col(" Date ").alias("Date")).write.options(**WRITE).csv(f"{path}/b")
    layouts = statements.read_statements(f.spark, [f"{path}/a", f"{path}/b"])
    return imports.union_all(list(layouts.values())).drop(*statements.LINEAGE, statements.BAD)


WHOLE = "concat_ws(',', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_suppkey AS VARCHAR))"


@check(
    "read_statement_bad_rows",
    f"""SELECT {WHOLE} AS line, 'good' AS kind FROM lineitem WHERE l_linenumber NOT IN (2, 5, 6)
    UNION ALL SELECT concat({WHOLE}, ',extra'), 'bad' FROM lineitem WHERE l_linenumber = 2
    UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'bad' FROM lineitem WHERE l_linenumber = 5
    UNION ALL SELECT concat_ws(',', CAST(l_orderkey AS VARCHAR), 'broken' || chr(10) || 'line', CAST(l_suppkey AS VARCHAR)), 'good' FROM lineitem WHERE l_linenumber = 6""",
)
def _(f):
    path = shared_folder(f.spark, "statement")
    line, key, last = F.col("l_linenumber"), F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")
    whole = F.concat_ws(",", key, line.cast("string"), last)
    texts = (
        F.when(line == 2, F.array(F.concat(whole, F.lit(",extra"))))
        .when(line == 5, F.array(key))
        .when(line == 6, F.array(F.concat(key, F.lit(',"broken')), F.concat(F.lit('line",'), last)))
        .otherwise(F.array(whole))
    )
    rows = f.table("lineitem").select(F.explode(texts).alias("a,b,c"))
    rows.write.options(header=True, quote="\u0000", sep="\u0001").csv(path)
    good = statements.read_statement(f.spark, path).select(F.concat_ws(",", "a", "b", "c").alias("line"), F.lit("good").alias("kind"))
    bad = statements.bad_rows(f.spark, path).select(F.col(statements.BAD).alias("line"), F.lit("bad").alias("kind"))
    return good.unionAll(bad)


@check(
    "read_statement_bad_bytes",
    "SELECT concat(desc_raw, ' caf', chr(65533)) AS \"Description\", count(*) AS n FROM f_raw_statement GROUP BY 1",
)
def _(f):
    path = shared_folder(f.spark, "statement")
    rows = f.raw.select(F.concat("desc_raw", F.lit(" café")).alias("Description"), F.lit("x").alias("Memo"))
    rows.write.options(**WRITE, encoding="ISO-8859-1").csv(path)
    return statements.read_statement(f.spark, path).groupBy("Description").agg(F.count(F.lit(1)).alias("n"))


@check(
    "resolve_columns",
    "SELECT date_raw AS date, desc_raw AS description, amount_raw AS amount, CAST(NULL AS VARCHAR) AS kind FROM f_raw_statement",
)
def _(f):
    named = f.raw.select(
        F.col("l_orderkey").cast("string").alias("Posted"), F.col("date_raw").alias("Transaction Date"),
        F.col("desc_raw").alias("Merchant Name"), F.col("amount_raw").alias("Transaction Amount"),
    )
    return statements.resolve_columns(named, normalise.LAYOUTS["Rogers Mastercard"].spec)[0]


@check("preview", "SELECT id, description, date FROM f_transactions ORDER BY id LIMIT 5")
def _(f):
    return statements.preview(f.txns.select("id", "description", "date").orderBy("id"))


@check("preview_count", "SELECT count(*) AS row_count FROM f_raw_statement")
def _(f):
    return statements.row_count(f.raw)


@check("load_ledger", f"SELECT id, date, description, CAST(amount AS DOUBLE) AS amount, tags FROM f_transactions WHERE {IN_PERIOD}")
def _(f):
    path = shared_folder(f.spark, "ledger")
    tables.write_transactions(f.txns, path)
    rows = tables.load_ledger(f.spark, path, START, END)
    return rows.select("id", "date", "description", money_out("amount").alias("amount"), "tags")


@check(
    "export_csv",
    f"""SELECT CAST(date AS VARCHAR) AS date, description, category, CAST(amount AS VARCHAR) AS amount, currency, account_name,
    CAST(NULL AS VARCHAR) AS memo, coalesce(tags, '[]') AS tags, CAST(is_split AS VARCHAR) AS is_split FROM f_ledger WHERE {IN_PERIOD}""",
)
def _(f):
    from ledgerloom.operators.filters import between_dates

    path = shared_folder(f.spark, "export")
    tables.export_csv(between_dates(f.view, START, END), path)
    return f.spark.read.options(header=True, escape='"').csv(path)


SEED_ORDER = "substr(md5(concat_ws('|', {keys})), 1, 2), {keys}"


@check(
    "seed_categories",
    f"""WITH p AS (SELECT row_number() OVER (ORDER BY {SEED_ORDER.format(keys='name')}) AS id, name, is_income FROM f_parent_categories),
    c AS (SELECT row_number() OVER (ORDER BY {SEED_ORDER.format(keys='parent_category, category')}) AS id, category AS name,
          child_is_income AS is_income, parent_category FROM f_names)
    SELECT c.id, p.id AS parent_id, c.name, c.is_income FROM c JOIN p ON p.name = c.parent_category
    UNION ALL SELECT id, CAST(NULL AS BIGINT), name, is_income FROM p""",
)
def _(f):
    owners = f.parents.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    seeds = f.children.join(owners, "parent_id").select("parent", "name", "is_income")
    lost = seeds.withColumn("parent", F.concat("parent", F.lit(" unknown")))
    parents, children = tables.seed_categories(f.parents.select("name", "is_income"), seeds.unionByName(lost))
    top = parents.select("id", F.lit(None).cast("bigint").alias("parent_id"), "name", "is_income")
    return children.select("id", "parent_id", "name", "is_income").unionByName(top)


@check(
    "seed_looks",
    """SELECT t.id, c.child, c.look FROM f_transactions t JOIN (VALUES """
    + ", ".join(f"({n}, '{parent} > {child}', '{color} {icon}')" for n, (parent, child, color, icon) in enumerate(SEEDED))
    + f") c(n, child, look) ON c.n = t.id % {len(SEEDED)}",
)
def _(f):
    # every transaction under one of the default children, shown with its look
    parents, children = tables.seed_categories(seeds.default_parents(f.spark), seeds.default_children(f.spark))
    order = f.spark.createDataFrame([(n, *row[:2]) for n, row in enumerate(SEEDED)], "n INT, parent STRING, name STRING")
    owners = parents.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    placed = children.join(owners, "parent_id").join(order, ["parent", "name"])
    rows = f.txns.select("id", (F.col("id") % len(SEEDED)).alias("n")).join(placed.drop("id"), "n")
    return rows.select("id", F.concat_ws(" > ", "parent", "name").alias("child"), F.concat_ws(" ", "color", "icon").alias("look"))


@check(
    "seed_budgets",
    f"""SELECT row_number() OVER (ORDER BY {SEED_ORDER.format(keys='parent_category, category')}) AS id, child_category_id,
    DATE '2024-01-01' AS month_year, CAST(child_category_id * 100 AS DOUBLE) AS amount FROM f_names""",
)
def _(f):
    owners = f.parents.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    seeds = f.children.join(owners, "parent_id").select("parent", F.col("name").alias("child"), (F.col("id") * 100).alias("amount"))
    rows = tables.seed_budgets(seeds, f.parents, f.children, START.replace(year=2024))
    return rows.select("id", "child_category_id", "month_year", money_out("amount").alias("amount"))


# --- cells ---------------------------------------------------------------------


@check("clean_amount", f"SELECT {KEY}, CAST(amount_true AS DOUBLE) AS amount FROM f_raw_statement")
def _(f):
    return f.raw.select("l_orderkey", "l_linenumber", money_out(clean_amount("amount_raw")).alias("amount"))


@check("parse_date", f"SELECT {KEY}, date_true AS date FROM f_raw_statement")
def _(f):
    return f.raw.select("l_orderkey", "l_linenumber", dates.parse_date("date_raw").alias("date"))


@check(
    "parse_date_formats",
    """SELECT l_orderkey, l_linenumber, CASE l_orderkey % 10 WHEN 8 THEN NULL WHEN 9 THEN NULL
    WHEN 2 THEN CASE WHEN day(l_shipdate) <= 12 THEN make_date(year(l_shipdate), day(l_shipdate), month(l_shipdate))
                     ELSE CAST(l_shipdate AS DATE) END ELSE CAST(l_shipdate AS DATE) END AS date FROM lineitem""",
)
def _(f):
    day, kind = F.col("l_shipdate"), F.col("l_orderkey") % 10
    patterns = ["yyyy-MM-dd", "M/d/yyyy", "dd/MM/yyyy", "MMM d, yyyy", "MMMM dd, yyyy", "yyyy/M/dd", "dd-MMM-yyyy", "MM-d-yyyy"]
    raw = F.when(kind == 8, "junk").when(kind == 9, F.lit(None).cast("string"))
    for i, pattern in enumerate(patterns):
        raw = raw.when(kind == i, F.concat(F.lit(" "), F.upper(F.date_format(day, pattern))))
    return f.table("lineitem").select("l_orderkey", "l_linenumber", dates.parse_date(raw).alias("date"))


@check(
    "memo_text",
    f"""SELECT {KEY}, concat('Balance: $', CAST(amount_true AS VARCHAR)) AS balance,
    concat('Principal: $', CAST(amount_true AS VARCHAR), ' | Interest: $', CAST(abs(amount_true) AS VARCHAR)) AS mortgage FROM f_raw_statement""",
)
def _(f):
    amount = clean_amount("amount_raw")
    return f.raw.select(
        "l_orderkey", "l_linenumber", memo_balance(amount).alias("balance"), memo_mortgage(amount, F.abs(amount)).alias("mortgage")
    )


@check(
    "account_label",
    """SELECT id, concat(institution, CASE WHEN account_number IS NULL THEN '' ELSE ' ' || account_number END) AS label,
    concat(institution, '_', coalesce(account_number, 'default')) AS ref FROM f_accounts""",
)
def _(f):
    return f.accounts.select(
        "id", text.account_label("institution", "account_number").alias("label"),
        text.account_ref("institution", "account_number").alias("ref"),
    )


@check(
    "fingerprint",
    """SELECT id, md5(concat_ws('|', concat('acc_', CAST(account_id AS VARCHAR)), CAST(date AS VARCHAR), description, CAST(amount AS VARCHAR)))
    AS hash FROM f_transactions""",
)
def _(f):
    ref = F.concat(F.lit("acc_"), F.col("account_id").cast("string"))
    return f.txns.select("id", text.fingerprint(ref, "date", "description", "amount").alias("hash"))


@check(
    "fingerprint_float_text",
    """SELECT id, md5(concat_ws('|', concat('acc_', CAST(account_id AS VARCHAR)), CAST(date AS VARCHAR), description, CAST(CAST(amount AS DOUBLE) AS VARCHAR)))
    AS hash FROM f_transactions""",
)
def _(f):
    ref = F.concat(F.lit("acc_"), F.col("account_id").cast("string"))
    return f.txns.select("id", text.fingerprint(ref, "date", "description", "amount", float_amounts=True).alias("hash"))


# Note cells: nothing on even lines, plain text on every third order, else a card number, a digit run or a short number.
NOTE = """CASE WHEN l_linenumber % 2 = 0 THEN NULL WHEN l_orderkey % 3 = 0 THEN 'note 77'
    WHEN l_suppkey % 4 = 1 THEN concat('card 4500-1234-5678-', lpad(CAST(l_orderkey % 10000 AS VARCHAR), 4, '0'))
    WHEN l_suppkey % 4 = 2 THEN concat('ref ', CAST(1000000000 + l_orderkey AS VARCHAR)) ELSE 'note 123456789' END"""


@check(
    "detect_account",
    f"""WITH r AS (SELECT concat('file_', CAST(l_suppkey AS VARCHAR)) AS source_file, l_suppkey, l_orderkey AS b,
        l_linenumber * 100000000 + l_partkey AS p, {NOTE} AS note,
        CASE WHEN l_suppkey % 4 = 0 AND l_linenumber > 2 THEN concat('no. 12-', CAST(100000 + l_orderkey AS VARCHAR)) END AS acct FROM lineitem),
    n AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY b, p) AS k FROM r WHERE note IS NOT NULL),
    c AS (SELECT source_file, arg_min(concat('****', right(note, 4)), k) AS masked FROM n
          WHERE k <= 3 AND (note LIKE 'card%' OR note LIKE 'ref%') GROUP BY 1),
    a AS (SELECT source_file, concat('****', right(arg_min(acct, (b, p)), 4)) AS masked FROM r WHERE acct IS NOT NULL GROUP BY 1)
    SELECT f.source_file, coalesce(a.masked, c.masked) AS account_number FROM (SELECT DISTINCT source_file FROM r) f
    LEFT JOIN a USING (source_file) LEFT JOIN c USING (source_file)""",
)
def _(f):
    order, supplier = F.col("l_orderkey"), F.col("l_suppkey") % 4
    note = (
        F.when(F.col("l_linenumber") % 2 == 0, F.lit(None).cast("string")).when(order % 3 == 0, "note 77")
        .when(supplier == 1, F.concat(F.lit("card 4500-1234-5678-"), F.lpad((order % 10000).cast("string"), 4, "0")))
        .when(supplier == 2, F.concat(F.lit("ref "), (1_000_000_000 + order).cast("string"))).otherwise("note 123456789")
    )
    number = F.when((supplier == 0) & (F.col("l_linenumber") > 2), F.concat(F.lit("no. 12-"), (100_000 + order).cast("string")))
    return normalise.detect_account(lineage(f).select(*LINEAGE, number.alias("Account #"), F.col("p_name").alias("Description"), note.alias("Note")))


# --- layouts -------------------------------------------------------------------

OUT = "date, description, original_desc, CAST(amount AS DOUBLE) AS amount, category, memo, currency, hash"


def shown(rows):
    return rows.select(
        "date", "description", "original_desc", money_out("amount").alias("amount"), "category", "memo", "currency", "hash"
    )


def hashed(ref, inner):
    return f"""SELECT {OUT} FROM (SELECT *, md5(concat_ws('|', '{ref}', CAST(date AS VARCHAR), description, CAST(amount AS VARCHAR))) AS hash
    FROM ({inner}))"""


PAID = "CAST(abs(amount_true) AS DECIMAL(18,2))"


@check(
    "normalise_cash",
    hashed(
        "Wealthsimple Cash ****9999_****9999",
        f"""SELECT date_true AS date, desc_raw AS description, desc_raw AS original_desc,
        CAST(CASE WHEN l_linenumber % 2 = 0 THEN amount_true ELSE -amount_true END AS DECIMAL(18,2)) AS amount, CAST(NULL AS VARCHAR) AS category,
        concat('Balance: $', CAST(amount_true AS VARCHAR)) AS memo, 'CAD' AS currency FROM f_raw_statement""",
    ),
)
def _(f):
    even = F.col("l_linenumber") % 2 == 0
    rows = cells(f).select(
        *LINEAGE, F.col("date_raw").alias("Date"), F.col("p_name").alias("Description"),
        F.when(~even, F.col("amount_raw")).alias("Withdrawals ($)"), F.when(even, F.col("amount_raw")).alias("Deposits ($)"),
        F.col("amount_raw").alias("Balance ($)"), F.lit("****9999").alias("Account Number"),
    )
    return shown(normalise.normalise_statement(rows, "Wealthsimple Cash"))


@check(
    "normalise_card",
    hashed(
        "My card_****1234",
        f"""SELECT date_true AS date, desc_raw AS description, desc_raw AS original_desc,
        CAST(CASE WHEN l_linenumber % 3 = 0 THEN {PAID} ELSE -{PAID} END AS DECIMAL(18,2)) AS amount, CAST(NULL AS VARCHAR) AS category,
        CAST(NULL AS VARCHAR) AS memo, 'CAD' AS currency FROM f_raw_statement""",
    ),
)
def _(f):
    rows = cells(f).select(
        *LINEAGE, F.col("date_raw").alias("Transaction Date"), F.col("p_name").alias("Merchant Name"),
        F.col("amount_raw").alias("Transaction Amount"),
        F.when(F.col("l_linenumber") % 3 != 0, "Purchase").when(F.col("l_orderkey") % 2 == 0, "PAYMENT").otherwise("Credit note").alias("Type"),
    )
    return shown(normalise.normalise_statement(rows, "Rogers Mastercard", "****1234", "My card"))


ACTIONS = ["BUY", "TFI", "SELL", "TFO", "DEP", "CSH", "EFT", "CON", "DIV", "INT", "FEE", "mng", "XXX", None]
ACTION_SQL = """CASE WHEN a IN ('BUY', 'TFI', 'SELL', 'TFO') THEN 'Stocks' WHEN a IN ('DEP', 'CSH', 'EFT', 'CON') THEN 'Transfer'
    WHEN a = 'DIV' THEN 'Dividends' WHEN a = 'INT' THEN 'Interest Income' WHEN a IN ('FEE', 'mng') THEN 'Bank Fees' ELSE 'Investments' END"""
PICK_ACTION = "([" + ", ".join(f"'{a}'" if a else "NULL" for a in ACTIONS) + f"])[l_orderkey % {len(ACTIONS)} + 1]"


def pick(values, key):
    array = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(array, (F.col(key) % len(values) + 1).cast("int"))


@check(
    "normalise_brokerage",
    hashed(
        "Questrade ****77_****77",
        f"""SELECT date_true AS date, CASE WHEN l_linenumber % 2 = 1 AND l_linenumber % 5 = 0 THEN concat(coalesce(a, ''), ' SYM') WHEN l_linenumber % 2 = 1
        THEN concat(coalesce(a, ''), ' SYM - ', desc_raw) WHEN l_linenumber % 5 = 0 THEN coalesce(a, '') ELSE desc_raw END AS description,
        CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE desc_raw END AS original_desc, amount_true AS amount, {ACTION_SQL} AS category,
        CAST(NULL AS VARCHAR) AS memo, CASE WHEN l_linenumber = 1 THEN 'USD' ELSE 'CAD' END AS currency
        FROM (SELECT *, {PICK_ACTION} AS a FROM f_raw_statement)""",
    ),
)
def _(f):
    line = F.col("l_linenumber")
    rows = cells(f).select(
        *LINEAGE, F.col("date_raw").alias("Activity Date"), pick(ACTIONS, "l_orderkey").alias("Action"),
        F.when(line % 2 == 1, "SYM").alias("Symbol"), F.when(line % 5 != 0, F.col("p_name")).alias("Description"),
        F.lit("5").alias("Gross Amount"), F.col("amount_raw").alias("Net Amount"), F.when(line == 1, "USD").alias("Currency"),
        F.lit("A-77").alias("My account"),
    )
    return shown(normalise.normalise_statement(rows, "Questrade"))


@check("action_category", f"SELECT {KEY}, {ACTION_SQL} AS category FROM (SELECT *, {PICK_ACTION} AS a FROM f_raw_statement)")
def _(f):
    action = F.coalesce(pick(ACTIONS, "l_orderkey"), F.lit(""))
    return f.raw.select("l_orderkey", "l_linenumber", normalise.action_category(action).alias("category"))


KINDS = ["Buy order", "Purchase", "Sell", "Dividend", "Contribution", "Deposit", "Withdrawal", "Management fee", "Interest", "Other", "Fee for sell", "dividend purchase"]
PICK_KIND = "([" + ", ".join(f"'{k}'" for k in KINDS) + f"])[l_orderkey % {len(KINDS)} + 1]"


@check(
    "normalise_invest",
    hashed(
        "Wealthsimple Invest_default",
        f"""SELECT date_true AS date, CASE WHEN l_linenumber % 2 = 1 THEN concat(k, ': XEQT') ELSE desc_raw END AS description,
        desc_raw AS original_desc, amount_true AS amount, CASE WHEN k ILIKE '%buy%' OR k ILIKE '%purchase%' THEN 'ETFs' WHEN k ILIKE '%sell%' THEN 'ETFs'
        WHEN k ILIKE '%dividend%' THEN 'Dividends' WHEN k ILIKE '%contribution%' OR k ILIKE '%deposit%' THEN 'Transfer'
        WHEN k ILIKE '%withdrawal%' THEN 'Transfer' WHEN k ILIKE '%fee%' THEN 'Bank Fees' WHEN k ILIKE '%interest%' THEN 'Interest Income'
        ELSE 'Investments' END AS category, CAST(NULL AS VARCHAR) AS memo, 'CAD' AS currency
        FROM (SELECT *, {PICK_KIND} AS k FROM f_raw_statement)""",
    ),
)
def _(f):
    rows = cells(f).select(
        *LINEAGE, F.col("date_raw").alias("Transaction Date"), pick(KINDS, "l_orderkey").alias("Type"),
        F.when(F.col("l_linenumber") % 2 == 1, "XEQT").alias("Security"), F.col("p_name").alias("Description"),
        F.col("amount_raw").alias("Amount"),
    )
    return shown(normalise.normalise_statement(rows, "Wealthsimple Invest"))


@check(
    "normalise_mortgage",
    hashed(
        "CIBC Mortgage_default",
        """SELECT date_true AS date, CASE WHEN l_linenumber = 2 THEN 'Mortgage Payment' ELSE desc_raw END AS description,
        CASE WHEN l_linenumber = 2 THEN 'Mortgage Payment' ELSE desc_raw END AS original_desc,
        CAST(-abs(CASE WHEN l_linenumber % 3 = 0 THEN amount_true + 10.5 ELSE 99.25 END) AS DECIMAL(18,2)) AS amount, 'Mortgage' AS category,
        concat('Principal: $', CAST(amount_true AS VARCHAR), ' | Interest: $10.50') AS memo, 'CAD' AS currency FROM f_raw_statement""",
    ),
)
def _(f):
    line = F.col("l_linenumber")
    rows = cells(f).select(
        *LINEAGE, F.col("date_raw").alias("Date"), F.when(line != 2, F.col("p_name")).alias("Activity"),
        F.col("amount_raw").alias("Principal"), F.lit("10.5").alias("Interest"),
        F.when(line % 3 == 0, "0").otherwise("99.25").alias("Total Payment"),
    )
    return shown(normalise.normalise_statement(rows, "CIBC Mortgage"))


@check(
    "normalise_mortgage_debit",
    hashed(
        "CIBC Mortgage_default",
        """SELECT date_true AS date, desc_raw AS description, desc_raw AS original_desc,
        CAST(CASE WHEN l_linenumber % 2 = 0 THEN 25.75 - amount_true ELSE -amount_true END AS DECIMAL(18,2)) AS amount, 'Mortgage' AS category,
        'Balance: $0.00' AS memo, 'CAD' AS currency FROM f_raw_statement""",
    ),
)
def _(f):
    rows = cells(f).select(
        *LINEAGE, F.col("date_raw").alias("Transaction Date"), F.col("p_name").alias("Description"),
        F.col("amount_raw").alias("Debit ($)"), F.when(F.col("l_linenumber") % 2 == 0, "25.75").alias("Credit ($)"),
        F.lit("abc").alias("Balance ($)"),
    )
    return shown(normalise.normalise_statement(rows, "CIBC Mortgage"))


def card_rows(f, broken=False):
    """Card statement rows; with ``broken`` every line 4 has no readable date and every line 5 no date cell."""
    line = F.col("l_linenumber")
    day = F.when(line == 4, "junk").when(line != 5, F.col("date_raw")) if broken else F.col("date_raw")
    return cells(f).select(
        *LINEAGE, day.alias("Date"), F.col("p_name").alias("Description"), F.col("amount_raw").alias("Amount"),
        F.lit("Purchase").alias("Type"),
    )


@check("split_rejects", f"SELECT desc_raw AS description, 'junk' AS date_raw, CAST(-{PAID} AS DOUBLE) AS amount FROM f_raw_statement WHERE l_linenumber = 4")
def _(f):
    rejects = normalise.split_rejects(normalise.normalise_statement(card_rows(f, broken=True), "Rogers Mastercard"))[1]
    return rejects.select("description", "date_raw", money_out("amount").alias("amount"))


@check(
    "normalise_statement",
    """SELECT i.institution, i.bank, i.account_type, count(*) AS rows, CAST(sum(amount_true * i.sign) AS DOUBLE) AS total FROM f_raw_statement
    JOIN (VALUES (0, 'Wealthsimple Cash', 'Wealthsimple', 'checking', 1), (1, 'Questrade', 'Questrade', 'investment', 1),
    (2, 'Wealthsimple Invest', 'Wealthsimple', 'investment', 1)) i(k, institution, bank, account_type, sign) ON i.k = l_suppkey % 3 GROUP BY ALL""",
)
def _(f):
    kinds = {"Wealthsimple Cash": "Date", "Questrade": "Activity Date", "Wealthsimple Invest": "Date"}
    parts = []
    for i, (institution, header) in enumerate(kinds.items()):
        part = cells(f).filter(F.col("l_suppkey") % 3 == i).select(
            *LINEAGE, F.col("date_raw").alias(header), F.col("p_name").alias("Description"), F.col("amount_raw").alias("Net Amount")
        )
        parts.append(normalise.normalise_statement(part, institution))
    rows = normalise.institutions(imports.union_all(parts))
    return rows.groupBy("institution", "bank", "account_type").agg(
        F.count(F.lit(1)).alias("rows"), money_out(F.sum("amount")).alias("total")
    )


# --- import --------------------------------------------------------------------

BATCH = f"""SELECT concat('file_', CAST(l_suppkey AS VARCHAR)) AS source_file, CAST(l_shipdate AS DATE) AS date, p_name AS description,
    CAST(-abs(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount, l_linenumber, l_orderkey AS b, l_linenumber * 100000000 + l_partkey AS p
    FROM lineitem JOIN part ON p_partkey = l_partkey"""


def known(f):
    """A ledger that holds the rows of line 1 already; these files show no account number."""
    rows = card_rows(f).filter(F.col("source_row") < 200_000_000)
    files = rows.select(
        "source_file", F.lit("Rogers Mastercard").alias("institution"), F.lit("Rogers Mastercard").alias("account_label"),
        F.lit(None).cast("string").alias("account_number"),
    ).distinct()
    return normalise.normalise_statement(rows, "Rogers Mastercard", files=files).select("hash").distinct()


def imported(f, broken=False):
    return imports.import_frames([(card_rows(f, broken), "Rogers Mastercard")], known(f), f.accounts, f.children, f.rules)


@check(
    "import_summary",
    f"""WITH a AS ({BATCH}), ok AS (SELECT * FROM a WHERE l_linenumber NOT IN (4, 5)),
    old AS (SELECT DISTINCT date, description, amount FROM a WHERE l_linenumber = 1),
    new AS (SELECT date, description, amount, arg_min(source_file, (source_file, b, p)) AS source_file FROM ok
            ANTI JOIN old USING (date, description, amount) GROUP BY 1, 2, 3),
    u AS (SELECT source_file, 1 AS parsed, 0 AS inserted, 0 AS rejected FROM ok UNION ALL SELECT source_file, 0, 1, 0 FROM new
          UNION ALL SELECT source_file, 0, 0, 1 FROM a WHERE l_linenumber = 4)
    SELECT coalesce(source_file, 'ALL FILES') AS source_file, CAST(sum(parsed) AS BIGINT) AS parsed, CAST(sum(inserted) AS BIGINT) AS inserted,
    CAST(sum(parsed) - sum(inserted) AS BIGINT) AS skipped, CAST(sum(rejected) AS BIGINT) AS rejected FROM u GROUP BY ROLLUP (source_file)""",
)
def _(f):
    return imported(f, broken=True).summary()


@check(
    "import_rows",
    f"""WITH a AS ({BATCH}) SELECT DISTINCT date, description, CAST(amount AS DOUBLE) AS amount, CAST(0 AS DOUBLE) AS ai_confidence,
    (SELECT max(id) + 1 FROM f_accounts) AS account_id FROM a
    ANTI JOIN (SELECT date, description, amount FROM a WHERE l_linenumber = 1) USING (date, description, amount)""",
)
def _(f):
    rows = imported(f).added
    return rows.select("date", "description", money_out("amount").alias("amount"), money_out("ai_confidence").alias("ai_confidence"), "account_id")


@check(
    "import_stream",
    f"""WITH k AS (SELECT DISTINCT date, description, amount FROM ({BATCH}))
    SELECT date, description, CAST(amount AS DOUBLE) AS amount, 1 AS ids_are_dense FROM k""",
)
def _(f):
    folder, ledger = shared_folder(f.spark, "arriving"), shared_folder(f.spark, "ledger")
    accounts, state = shared_folder(f.spark, "accounts"), shared_folder(f.spark, "progress")
    first = normalise.normalise_statement(card_rows(f).filter(F.col("source_row") < 200_000_000), "Rogers Mastercard")
    start = first.select("date", "description", "amount", "hash").dropDuplicates(["hash"])
    tables.write_transactions(assign_ids(start, ["hash"], digits=4), ledger)
    f.accounts.withColumn("id", F.col("id").cast("bigint")).write.parquet(accounts)
    columns = ["Date", "Description", "Amount", "Type"]
    for _run in range(2):
        # The second run finds the same rows in new files, each compressed and of at most a million rows, as none is split.
        packed = {**WRITE, "compression": "gzip", "maxRecordsPerFile": 1_000_000}
        card_rows(f).select(*columns).write.mode("append").options(**packed).csv(folder)
        import_stream(f.spark, folder, columns, "Rogers Mastercard", ledger, accounts, f.children, f.rules, state).awaitTermination()
    rows = tables.load_ledger(f.spark, ledger)
    ids = rows.agg((F.countDistinct("id") == F.max("id")).cast("int").alias("dense")).scalar()
    return rows.select("date", "description", money_out("amount").alias("amount"), ids.alias("ids_are_dense"))


@check(
    "import_statements",
    f"SELECT 2 * count(*) AS parsed, count(DISTINCT (date, description, amount)) + count(DISTINCT (date, description, amount)) AS inserted FROM ({BATCH})",
)
def _(f):
    folder = shared_folder(f.spark, "statement")
    rows = card_rows(f).select("Date", "Description", "Amount", "Type")
    # compressed, and of at most 100,000 rows, as no file is split
    packed = {**WRITE, "compression": "gzip", "maxRecordsPerFile": 100_000}
    with shuffles_dropped(f.spark):
        rows.write.options(**packed).csv(f"{folder}/card")
        rows.select("Amount", "Description", "Date").write.options(**packed).csv(f"{folder}/invest")
    empty = f.txns.select("id", F.lit("").alias("hash")).filter("hash = 'x'")
    sources = {"Rogers Mastercard": f"{folder}/card", "Wealthsimple Invest": f"{folder}/invest"}
    done = imports.import_statements(f.spark, sources, empty, f.accounts, f.children, f.rules)
    return done.summary().filter("source_file = 'ALL FILES'").select("parsed", "inserted")
