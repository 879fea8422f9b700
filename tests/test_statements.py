"""Golden statement files: expected rows are written by hand."""

import csv
import datetime as dt
import gzip
import hashlib
import io
import random
import re
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import normalise
from ledgerloom.operators.maintain import new_rows
from ledgerloom.plans.imports import import_statements
from ledgerloom.schemas import ACCOUNTS, CHILD_CATEGORIES, RULES
from ledgerloom.session import settings, stored
from ledgerloom.sources import statements
from ledgerloom.sources.firsts import first_record
from ledgerloom.sources.statements import read_statement, read_statements, scan_statement
from ledgerloom.streaming.imports import import_stream
from ledgerloom.sources.tables import load_ledger, write_transactions


def write(folder, name, text):
    path = folder / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def rows_of(df, *columns):
    return [tuple(r) for r in df.orderBy("source_row").select(*columns).collect()]


CASH = """ Date ,Description,Withdrawals ($),Deposits ($),Balance ($)
2025-01-05,Rent,"1,234.56",,"$10,000.00"
03/04/2025,Pay,,"$2,000.00",12 345.00
25/12/2025,Both,(45.10),50,abc
"Jan 5, 2025",Nothing,,,
"January 15, 2025",A,1,,0
2025/2/3,B,1,,0
05-Mar-2025,C,1,,0
3-14-2025,D,1,,0
junk,Bad,1,,0
,No date,1,,0
"""


def test_cash(spark, tmp_path):
    df = read_statement(spark, write(tmp_path, "cash.csv", CASH))
    rows = normalise.normalise_statement(df, "Wealthsimple Cash")
    fits, rejects = normalise.split_rejects(rows)
    D = Decimal
    assert rows_of(fits, "date", "description", "amount", "memo") == [
        (dt.date(2025, 1, 5), "Rent", D("-1234.56"), "Balance: $10000.00"),
        (dt.date(2025, 3, 4), "Pay", D("2000.00"), "Balance: $12345.00"),
        (dt.date(2025, 12, 25), "Both", D("95.10"), "Balance: $0.00"),
        (dt.date(2025, 1, 5), "Nothing", D("0.00"), "Balance: $0.00"),
        (dt.date(2025, 1, 15), "A", D("-1.00"), "Balance: $0.00"),
        (dt.date(2025, 2, 3), "B", D("-1.00"), "Balance: $0.00"),
        (dt.date(2025, 3, 5), "C", D("-1.00"), "Balance: $0.00"),
        (dt.date(2025, 3, 14), "D", D("-1.00"), "Balance: $0.00"),
    ]
    assert rows_of(rejects, "date_raw") == [("junk",)]
    first = fits.orderBy("source_row").first()
    text = "Wealthsimple Cash_default|2025-01-05|Rent|-1234.56"
    assert first["hash"] == hashlib.md5(text.encode()).hexdigest()
    assert first["currency"] == "CAD"


def test_card(spark, tmp_path):
    text = "Transaction Date,Merchant Name,Transaction Amount,Type,Card Number\n"
    text += "2025-01-02,Shop,10.00,Purchase,XXXX-4321\n2025-01-03,Thanks,-25,PAYMENT,\n2025-01-04,Back,5,credit note,\n2025-01-05,,7,,\n"
    rows = normalise.normalise_statement(read_statement(spark, write(tmp_path, "card.csv", text)), "Rogers Mastercard")
    assert rows_of(rows, "description", "amount", "account_label") == [
        ("Shop", Decimal("-10.00"), "Rogers Mastercard ****4321"),
        ("Thanks", Decimal("25.00"), "Rogers Mastercard ****4321"),
        ("Back", Decimal("5.00"), "Rogers Mastercard ****4321"),
        ("", Decimal("-7.00"), "Rogers Mastercard ****4321"),
    ]


def test_brokerage(spark, tmp_path):
    codes = ["BUY", "TFI", "SELL", "TFO", "DEP", "CSH", "EFT", "CON", "DIV", "INT", "FEE", "MNG", "XXX"]
    text = "Transaction Date,Action,Symbol,Description,Net Amount,Currency,Account #\n"
    text += "".join(f"2025-02-01,{c},ABC,desc,-1.5,USD,5567-1234\n" for c in codes)
    text += "2025-02-02,buy,,Plain,2,,\n2025-02-03,DIV,XYZ,,3,CAD,\n2025-02-04,INT,,,4,CAD,\n"
    rows = normalise.normalise_statement(read_statement(spark, write(tmp_path, "b.csv", text)), "Questrade")
    got = rows_of(rows, "description", "original_desc", "category", "currency", "account_number")
    want = ["Stocks"] * 4 + ["Transfer"] * 4 + ["Dividends", "Interest Income", "Bank Fees", "Bank Fees", "Investments"]
    assert got[:13] == [(f"{c} ABC - desc", "desc", w, "USD", "****1234") for c, w in zip(codes, want)]
    assert got[13:] == [
        ("Plain", "Plain", "Stocks", "CAD", "****1234"),
        ("DIV XYZ", "", "Dividends", "CAD", "****1234"),
        ("INT", "", "Interest Income", "CAD", "****1234"),
    ]


def test_invest(spark, tmp_path):
    kinds = {
        "buy": "ETFs", "Purchase": "ETFs", "sell": "ETFs", "Dividend": "Dividends", "contribution": "Transfer",
        "deposit": "Transfer", "withdrawal": "Transfer", "fee": "Bank Fees", "interest": "Interest Income", "other": "Investments",
    }
    text = "Date,Type,Symbol,Description,Net Amount,Currency\n" + "".join(f"2025-01-01,{k},S,d,1,CAD\n" for k in kinds)
    text += "2025-01-01,fee,,,1,CAD\n"
    rows = normalise.normalise_statement(read_statement(spark, write(tmp_path, "i.csv", text)), "Wealthsimple Invest")
    got = rows_of(rows, "description", "category")
    assert got == [(f"{k}: S", c) for k, c in kinds.items()] + [("fee", "Bank Fees")]


def test_mortgage(spark, tmp_path):
    text = "Date,Activity,Principal,Interest,Total Payment\n2025-01-01,,100,50.5,0\n2025-02-01,Extra,100,50.5,160\n2025-03-01,Gap,100,50.5,\n"
    rows = normalise.normalise_statement(read_statement(spark, write(tmp_path, "m.csv", text)), "CIBC Mortgage")
    memo = "Principal: $100.00 | Interest: $50.50"
    assert rows_of(rows, "description", "amount", "memo", "category") == [
        ("Mortgage Payment", Decimal("-150.50"), memo, "Mortgage"),
        ("Extra", Decimal("-160.00"), memo, "Mortgage"),
        ("Gap", Decimal("0.00"), memo, "Mortgage"),
    ]


@pytest.mark.parametrize(
    ("cells", "want"),
    [
        (["x", "card 4500-1234-5678-9012", "y"], "****9012"),
        (["ref 12345678901", "y", "z"], "****8901"),
        (["", "a", "b", "c", "ref 12345678901"], None),
        (["", "a", "b", "ref 12345678901"], "****8901"),
        (["123456789", "12-34", "z"], None),
    ],
)
def test_account_in_cells(spark, tmp_path, cells, want):
    text = "Date,Note\n" + "".join(f"2025-01-01,{c}\n" for c in cells)
    df = read_statement(spark, write(tmp_path, "n.csv", text))
    assert [r["account_number"] for r in normalise.detect_account(df).collect()] == [want]


def test_account_from_hint(spark, tmp_path):
    df = read_statement(spark, write(tmp_path, "h.csv", "Date,Note\n2025-01-01,a\n"))
    assert normalise.detect_account(df, hint="visa_99887766.csv").first()["account_number"] == "****7766"


def test_unknown_institution():
    with pytest.raises(ValueError):
        normalise.layout_of("No Such Bank")


def test_amount_too_wide_is_rejected(spark, tmp_path):
    text = "Date,Description,Amount,Type\n2025-01-01,a,12345678901234567890,x\n2025-01-01,b,NaN,x\n2025-01-01,c,(abc),x\n2025-01-01,d,(5,x\n"
    rows = normalise.normalise_statement(read_statement(spark, write(tmp_path, "w.csv", text)), "Rogers Mastercard")
    fits, rejects = normalise.split_rejects(rows)
    assert rows_of(rejects, "description") == [("a",)]
    assert rows_of(fits, "description", "amount") == [(d, Decimal("0.00")) for d in "bcd"]


def test_bad_bytes_and_swapped_columns(spark, tmp_path):
    write(tmp_path, "a.csv", b"Date,Description\n2025-01-01,caf\xe9\n")
    write(tmp_path, "b.csv", "Description,Date\nother,2025-01-02\n")
    layouts = read_statements(spark, str(tmp_path))
    got = {tuple(r) for df in layouts.values() for r in df.select("Date", "Description").collect()}
    assert got == {("2025-01-01", "caf�"), ("2025-01-02", "other")}


def tables(spark):
    accounts = spark.createDataFrame([(7, "Old", "Rogers Bank", "credit", "****4321", "CAD", Decimal("1.00"))], ACCOUNTS)
    children = spark.createDataFrame([(1, 1, "Groceries", None, None, 0), (2, 1, "Transfer", None, None, 0)], CHILD_CATEGORIES)
    rules = spark.createDataFrame([(1, "corner", 1, "contains", 5, 0)], RULES)
    return accounts, children, rules


STATEMENT = "Date,Description,Amount,Type,Card #\n" + "".join(
    f"2025-01-0{d},{text},{d}.50,x,4321\n" for d, text in [(1, "Corner store"), (1, "Corner store"), (2, "LOBLAWS 12"), (3, "what"), (4, "interac")]
)


def test_import_twice_adds_nothing(spark, tmp_path):
    accounts, children, rules = tables(spark)
    path = write(tmp_path, "s.csv", STATEMENT)
    empty = spark.createDataFrame([], "id BIGINT, hash STRING")
    first = import_statements(spark, {"Rogers Mastercard": path}, empty, accounts, children, rules)
    rows = first.numbered(empty)
    got = {(r["description"], r["account_id"], r["child_category_id"], float(r["ai_confidence"])) for r in rows.collect()}
    assert got == {("Corner store", 7, 1, 0.9), ("LOBLAWS 12", 7, 1, 0.75), ("what", 7, None, 0.0), ("interac", 7, 2, 0.75)}
    assert sorted(r["id"] for r in rows.collect()) == [1, 2, 3, 4]
    counts = first.summary().filter("source_file = 'ALL FILES'").first()
    assert (counts["parsed"], counts["inserted"], counts["skipped"], counts["rejected"]) == (5, 4, 1, 0)
    again = import_statements(spark, {"Rogers Mastercard": path}, rows.select("id", "hash"), accounts, children, rules)
    assert again.added.count() == 0


BROKEN = """Date,Description,Amount,Type
2025-01-01,"two
lines",10,x
2025-01-02,ok,5,y
2025-01-03,short
2025-01-04,long,1,x,more
nodate,odd,3,x
2025-01-05,wide,12345678901234567890,x
,none,4,x
"""


def test_no_row_is_lost(spark, tmp_path):
    accounts, children, rules = tables(spark)
    path = write(tmp_path, "s.csv", BROKEN)
    empty = spark.createDataFrame([], "id BIGINT, hash STRING")
    done = import_statements(spark, {"Rogers Mastercard": path}, empty, accounts, children, rules)
    got = sorted((r["description"], r["amount"]) for r in done.added.collect())
    assert got == [("ok", Decimal("-5.00")), ("two\nlines", Decimal("-10.00"))]
    rejected = {tuple(r["cells"]): r["reason"] for r in done.rejected.collect()}
    assert {k for k, v in rejected.items() if v.startswith("more or fewer")} == {("2025-01-03,short",), ("2025-01-04,long,1,x,more",)}
    assert {k[1] for k, v in rejected.items() if v.startswith("unreadable")} == {"odd", "wide"}
    assert "FileScan csv" not in done.summary()._jdf.queryExecution().toString()


def test_sums_too_wide_are_rejected(spark, tmp_path):
    wide = "9999999999999999.00"
    cash = f"Date,Description,Withdrawals,Deposits\n2025-01-01,a,-{wide},{wide}\n2025-01-02,b,1,2\n"
    loan = f"Date,Description,Principal,Interest\n2025-01-01,a,{wide},{wide}\n2025-01-02,b,1,2\n"
    for name, text in (("Wealthsimple Cash", cash), ("CIBC Mortgage", loan)):
        rows = normalise.normalise_statement(read_statement(spark, write(tmp_path, "w.csv", text)), name)
        fits, rejects = normalise.split_rejects(rows)
        assert (rows_of(fits, "description"), rows_of(rejects, "description")) == ([("b",)], [("a",)])


def test_repeated_header_names(spark, tmp_path):
    text = "Date,Description,Date,Amount,Amount,Type\n2025-01-01,a,x,5,7,y\n"
    df = read_statement(spark, write(tmp_path, "w.csv", text))
    assert df.columns[:6] == ["Date", "Description", "Date.1", "Amount", "Amount.1", "Type"]
    rows = normalise.normalise_statement(df, "Rogers Mastercard")
    assert rows_of(rows, "description", "amount") == [("a", Decimal("-5.00"))]


def test_given_accounts(spark, tmp_path):
    accounts, children, rules = tables(spark)
    paths = [write(tmp_path, name, STATEMENT) for name in ("a.csv", "b.csv")]
    empty = spark.createDataFrame([], "id BIGINT, hash STRING")
    given = spark.createDataFrame([(f"file:{paths[1]}", "My card", "****1111")], "source_file string, account_name string, account_number string")
    done = import_statements(spark, {"Rogers Mastercard": paths}, empty, accounts, children, rules, given)
    assert {(r["name"], r["account_number"]) for r in done.accounts.collect()} == {("Old", "****4321"), ("My card", "****1111")}
    assert {r["account_id"] for r in done.added.collect()} == {7, 8}


def test_stream_refuses_swapped_columns(spark, tmp_path):
    accounts, children, rules = tables(spark)
    folder, ledger, stored, state = (str(tmp_path / n) for n in ("in", "ledger", "accounts", "state"))
    (tmp_path / "in").mkdir()
    accounts.write.parquet(stored)
    spark.createDataFrame([], "id BIGINT, date DATE, hash STRING, month STRING").write.partitionBy("month").parquet(ledger)
    write(tmp_path / "in", "a.csv", "Description,Date,Amount,Type\na,2025-01-01,5,x\n")
    columns = ["Date", "Description", "Amount", "Type"]
    with pytest.raises(Exception, match="(?i)header"):
        import_stream(spark, folder, columns, "Rogers Mastercard", ledger, stored, children, rules, state).awaitTermination()


def test_dedupe_reads_the_batch_months_only(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = [(1, dt.date(2025, 1, 5), "a"), (2, dt.date(2025, 2, 5), "b"), (3, dt.date(2025, 3, 5), "c")]
    ledger = spark.createDataFrame(rows, "id BIGINT, date DATE, hash STRING")
    write_transactions(ledger, path)
    batch = spark.createDataFrame([(dt.date(2025, 2, 5), "b"), (dt.date(2025, 2, 6), "x")], "date DATE, hash STRING")
    fresh = new_rows(batch, spark.read.parquet(path), order=["date"])
    assert [r["hash"] for r in fresh.collect()] == ["x"]
    assert re.search(r"PartitionFilters: [^]]*2025-02", fresh._jdf.queryExecution().toString())


def test_stream_stores_accounts_and_rows_once(spark, tmp_path):
    accounts, children, rules = tables(spark)
    folder, ledger, stored, state = (str(tmp_path / n) for n in ("in", "ledger", "accounts", "state"))
    (tmp_path / "in").mkdir()
    accounts.write.parquet(stored)
    spark.createDataFrame([], "id BIGINT, date DATE, hash STRING, month STRING").write.partitionBy("month").parquet(ledger)
    columns = ["Date", "Description", "Amount", "Type", "Card #"]
    for name, text in [("a.csv", STATEMENT), ("b.csv", STATEMENT), ("c.csv", STATEMENT.replace("4321", "9999"))]:
        write(tmp_path / "in", name, text)
        import_stream(spark, folder, columns, "Rogers Mastercard", ledger, stored, children, rules, state, 1).awaitTermination()
    rows = load_ledger(spark, ledger).collect()
    assert len(rows) == 8 and len({r["id"] for r in rows}) == 8
    assert {r["account_id"] for r in rows} == {7, 8}
    assert spark.read.parquet(stored).count() == 2


def random_csv(rng):
    """A file of records with quotes, separators, line breaks and blanks in cells, and rows of other widths."""
    lines = ["h1,h2,h3"]
    for _ in range(rng.randrange(1, 14)):
        cells = []
        for _ in range(rng.choice([3, 3, 3, 3, 2, 4])):
            cell = "".join(rng.choice(["a", "b", ",", '"', "\n", " ", "\n\n", 'x"y']) for _ in range(rng.randrange(0, 6)))
            if rng.random() < 0.5 or "," in cell or "\n" in cell or cell.startswith('"'):
                cell = '"' + cell.replace('"', '""') + '"'
            cells.append(cell)
        lines.append(",".join(cells))
    return "\n".join(lines) + rng.choice(["", "\n"])


@pytest.mark.parametrize("split", ["64", "1000000"])
def test_records_over_lines_and_splits(spark, tmp_path, split):
    """Good and rejected rows are the records of a plain CSV reader, also where a file is split every 64 bytes."""
    rng = random.Random(int(split))
    texts = {f"f{n}.csv": random_csv(rng) for n in range(24)}
    for name, text in texts.items():
        write(tmp_path, name, text)
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = scan_statement(spark, str(tmp_path), ["h1", "h2", "h3"]).orderBy("source_file", "source_block", "source_row").collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    got = {}
    for r in rows:
        got.setdefault(r["source_file"].rsplit("/", 1)[1], []).append(r)
    for name, text in texts.items():
        want = [r for r in csv.reader(io.StringIO(text)) if not (len(r) == 0 or len(r) == 1 and not r[0].strip())][1:]
        found = got.get(name, [])
        assert [len(w) == 3 for w in want] == [r["bad_record"] is None for r in found], name
        assert [w for w in want if len(w) == 3] == [[r[c] or "" for c in ("h1", "h2", "h3")] for r in found if r["bad_record"] is None]


def test_a_quote_that_is_never_closed_ends_with_its_line(spark, tmp_path):
    text = 'a,b\n1,2\n3,"open\n4,5\n6,again\n7,8\n'
    rows = scan_statement(spark, write(tmp_path, "o.csv", text)).orderBy("source_row").collect()
    assert [r["a"] for r in rows] == ["1", "3", "4", "6", "7"]
    assert [r["b"] for r in rows] == ["2", "open", "5", "again", "8"]


def test_only_files_with_open_lines_are_joined(spark, tmp_path):
    write(tmp_path, "plain.csv", 'a,b\n1,"x, y"\n')
    plan = scan_statement(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Window" not in plan and "collect_list" not in plan


def test_headers_read_the_first_record_only(spark, tmp_path):
    big = 'Date,"De\nsc",Amount\n' + "x" * 3_000_000
    write(tmp_path, "a b%.csv", big)
    write(tmp_path, "c.csv", "\n \nDate , Description,AMOUNT\r\n1,2,3")
    write(tmp_path, "d.csv", "")
    write(tmp_path, "e.csv.gz", gzip.compress(big.encode()))
    got = {r["source_file"].rsplit("/", 1)[1]: r["header"] for r in statements.statement_headers(spark, str(tmp_path)).collect()}
    assert got == {"a%20b%25.csv": 'Date,"De\nsc",Amount', "c.csv": "Date , Description,AMOUNT", "e.csv.gz": 'Date,"De\nsc",Amount'}
    taken = []

    def parts():
        for begin in range(0, len(big), 1000):
            taken.append(begin)
            yield big[begin : begin + 1000].encode()

    assert first_record(parts()) == 'Date,"De\nsc",Amount' and len(taken) == 1
    assert "content" not in spark.read.format("binaryFile").load(str(tmp_path)).select("path")._jdf.queryExecution().toString().split("ReadSchema")[-1]


def test_groups_by_role_positions(spark, tmp_path):
    """A byte-order mark, blanks and names that no role asks for make no frame of their own; another order does."""
    spec = normalise.LAYOUTS["Rogers Mastercard"].spec
    heads = ["Date,Description,Amount,Note", "\ufeffDate,Description,Amount,Note", " Date ,Description, Amount,note", "Date,Description,Amount,Remark"]
    for n, head in enumerate([*heads, "Amount,Description,Date,Note"]):
        write(tmp_path, f"{n}.csv", f"{head}\n2025-01-0{n + 1},a{n},5,x\n" if n < 4 else f"{head}\n5,a4,2025-01-05,x\n")
    groups = read_statements(spark, str(tmp_path), spec)
    assert len(groups) == 2
    rows = [r for df in groups.values() for r in normalise.normalise_statement(df, "Rogers Mastercard").select("date", "description").collect()]
    assert sorted((str(r[0]), r[1]) for r in rows) == [(f"2025-01-0{n + 1}", f"a{n}") for n in range(5)]


def test_stream_of_mixed_layouts(spark, tmp_path):
    """One folder with statements of three layouts and two institutions imports like the batch does, file by file."""
    accounts, children, rules = tables(spark)
    folder, ledger, held, state = (str(tmp_path / n) for n in ("in", "ledger", "accounts", "state"))
    (tmp_path / "in" / "card").mkdir(parents=True)
    (tmp_path / "in" / "cash").mkdir()
    accounts.write.parquet(held)
    spark.createDataFrame([], "id BIGINT, date DATE, hash STRING, month STRING").write.partitionBy("month").parquet(ledger)
    write(tmp_path / "in" / "card", "a.csv", STATEMENT)
    write(tmp_path / "in" / "card", "b.csv", 'Type,Amount,Description,Date\nx,9.00,"over\ntwo lines",2025-02-01\n')
    write(tmp_path / "in" / "cash", "c.csv", CASH)
    write(tmp_path / "in", "other.csv", "a,b\n1,2\n")
    kind = F.regexp_extract("source_file", "/(card|cash)/", 1)
    whose = F.when(kind == "card", "Rogers Mastercard").when(kind == "cash", "Wealthsimple Cash")
    listed = [r["source_file"] for r in statements.statement_headers(spark, [f"{folder}/card", f"{folder}/cash"]).collect()]
    mine = [p for p in listed if p.endswith("b.csv")]
    given = spark.createDataFrame([(mine[0], "My card", "****1111")], "source_file STRING, account_name STRING, account_number STRING")
    for size in (1, 1000):  # the second run finds nothing new
        import_stream(spark, folder, None, whose, ledger, held, children, rules, state, size, given).awaitTermination()
        rows = load_ledger(spark, ledger).collect()
        empty = spark.createDataFrame([], "id BIGINT, hash STRING")
        sources = {"Rogers Mastercard": f"{folder}/card", "Wealthsimple Cash": f"{folder}/cash"}
        done = import_statements(spark, sources, empty, accounts, children, rules, given)
        key = lambda r: (r["date"], r["description"], r["amount"], r["hash"], r["child_category_id"])
        assert sorted(map(str, map(key, rows))) == sorted(map(str, map(key, done.added.collect()))) and len(rows) > 8
        assert sorted(r["id"] for r in rows) == list(range(1, len(rows) + 1))
        names = {(r["name"], r["account_number"]) for r in spark.read.parquet(held).collect()}
        assert names == {(r["name"], r["account_number"]) for r in done.accounts.collect()} and ("My card", "****1111") in names


def test_helpers_travel_without_the_package(tmp_path):
    """What tasks call is sent with the job: it runs where this package isn't installed."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from ledgerloom.functions.regexes import required_texts

    first, needed = first_record, required_texts
    sent = tmp_path / "job"
    sent.write_bytes(cloudpickle.dumps(lambda: (first(iter([b'a,"b\nc"\n1'])), needed("sh[ao]p|corner"))))
    code = "import sys, pickle; print(pickle.load(open(sys.argv[1], 'rb'))(), 'ledgerloom' in sys.modules)"
    out = subprocess.run([sys.executable, "-c", code, str(sent)], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    assert out.strip() == f"{('a,' + chr(34) + 'b' + chr(10) + 'c' + chr(34), ['sh', 'corner'])} False"


def test_records_by_small_chunks(spark):
    """Records that go over chunks and splits, quotes that are never closed, and windows that hold no more than a chunk."""
    from ledgerloom.sources.firsts import is_open
    from ledgerloom.sources.records import joined_records

    pieces = ["a,b", 'x,"open', 'mid "" dle', 'end",y', '"one",2', 'q,"', '"', 'it"s']
    draw = random.Random(5)
    files = {f"f{n}": [draw.choice(pieces) for _ in range(40)] for n in range(8)}
    rows = [(name, i // 16 * 1000, i // 16 * 2**33 + i, line) for name, lines in files.items() for i, line in enumerate(lines)]
    lines = spark.createDataFrame(rows, "source_file STRING, source_block BIGINT, source_row BIGINT, value STRING")
    want = []
    for name, held in files.items():
        at = 0
        while at < len(held):
            ends = [e for e in range(at, len(held)) if not is_open("\n".join(held[at : e + 1]))]
            size = ends[0] - at + 1 if ends else 1
            want.append((name, at // 16 * 1000, at // 16 * 2**33 + at, "\n".join(held[at : at + size])))
            at += size
    for bits in (1, 2, 15):
        got = joined_records(lines, bits).select("source_file", "source_block", "source_row", "record").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_rows_meet_small_tables(spark, tmp_path, monkeypatch):
    """Rows are judged against the files' accounts, not the account table, and joined with accounts of files that are written."""
    from ledgerloom.plans import imports

    accounts, children, rules = tables(spark)
    path, seen = write(tmp_path, "s.csv", STATEMENT), []

    def check_constraints(batch, not_null, dims):
        seen.append([r["id"] for r in dims["account_id"].collect()])
        return normal(batch, not_null, dims)

    normal = imports.check_constraints
    monkeypatch.setattr(imports, "check_constraints", check_constraints)
    other = accounts.withColumns({"id": F.lit(8).cast("bigint"), "account_number": F.lit("****1111")})
    done = import_statements(spark, {"Rogers Mastercard": path}, spark.createDataFrame([], "id BIGINT, hash STRING"), accounts.unionByName(other), children, rules)
    assert seen == [[7]] and done.rejected.isEmpty() and {r["account_id"] for r in done.added.collect()} == {7}
    rows = normalise.normalise_statement(read_statement(spark, path), "Rogers Mastercard")
    assert "Aggregate" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_new_rows_are_found_without_moving_them(spark, tmp_path, monkeypatch):
    """Of the rows only fingerprints and positions are shuffled; the first of equal rows stays, by file, block and row."""
    from ledgerloom.plans import imports

    accounts, children, user_rules = tables(spark)
    text = "Date,Description,Amount,Type\n" + "".join(f"2025-01-0{1 + n % 3},shop {n % 5},{n % 5}.00,x{n}\n" for n in range(200))
    for name in ("b.csv", "a.csv"):
        write(tmp_path, name, text)
    rows = read_statement(spark, str(tmp_path))
    # places that repeat or are missing
    rows = rows.withColumns({"source_block": F.expr("nullif(source_row % 2, 0)"), "source_row": F.lit(1).cast("bigint")})
    ids = normalise.file_accounts(rows, "Rogers Mastercard")
    batch = normalise.normalise_statement(rows, "Rogers Mastercard", files=ids)
    known = [r["hash"] for r in batch.select("hash").distinct().orderBy("hash").limit(4).collect()]
    # the upper-case text is another fingerprint, as are those that are no MD5
    ledger = spark.createDataFrame([(h,) for h in [*known[:3], known[3].upper(), "x", None]], "hash STRING")
    want = new_rows(batch, ledger).select("source_file", "source_block", "hash")
    # a file that is told of twice has each row twice; none is added twice
    name = ids.select("source_file", F.lit("Rogers Mastercard").alias("account_name"), F.lit(None).cast("string").alias("account_number"))
    given = name.unionAll(name)
    plans = []

    def stored(df, purpose, *rest):
        out = kept(df, purpose, *rest)
        plans.append((purpose, df._jdf.queryExecution().executedPlan().toString()))
        return out

    kept = imports.stored
    monkeypatch.setattr(imports, "stored", stored)
    done = imports.import_frames([(rows, "Rogers Mastercard")], ledger, accounts, children, user_rules, given)
    got = done.added.select("source_file", "source_block", "hash")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 12
    assert {r["source_file"].rsplit("/", 1)[1] for r in got.collect()} == {"a.csv"}
    moved = [plan for purpose, plan in plans if purpose == "added"]
    assert len(moved) == 1 and "Window" not in moved[0] and "getbit" in moved[0]


@pytest.mark.parametrize("most", [1, 1 << 15])
def test_rows_of_large_imports_meet_their_marks_in_passes(spark, tmp_path, monkeypatch, most):
    """However many the marks are, rows aren't shuffled to meet them, and a pass has the marks of some tasks only."""
    from ledgerloom.plans import imports

    accounts, children, user_rules = tables(spark)
    header = "Date,Description,Amount,Type\n"
    for name in "abc":  # 300 rows in each file aren't in the file before
        lines = [f"2025-01-01,shop {n},{n}.00,x\n" for n in range(300 * "abc".index(name), 5000 + 300 * "abc".index(name))]
        write(tmp_path, f"{name}.csv", header + "".join(lines))
    plans = []

    def stored(df, purpose, *rest):
        plans.append((purpose, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, purpose, *rest)

    kept, ranges = imports.stored, imports.mark_ranges
    monkeypatch.setattr(imports, "stored", stored)
    monkeypatch.setattr(imports, "mark_ranges", lambda marks: ranges(marks, most))
    with settings(spark, spark__sql__files__maxPartitionBytes="64k", spark__sql__files__openCostInBytes="64k", spark__sql__autoBroadcastJoinThreshold="-1"):
        done = import_statements(spark, {"Rogers Mastercard": str(tmp_path)}, spark.createDataFrame([], "id BIGINT, hash STRING"), accounts, children, user_rules)
        total = done.summary().filter("source_file = 'ALL FILES'").first()
    assert (total["parsed"], total["inserted"], total["skipped"]) == (15000, 5600, 9400)
    added = [tuple(r) for r in done.added.select(F.regexp_extract("source_file", "[a-c](?=.csv)", 0), "description").collect()]
    assert sorted(added) == sorted([("a", f"shop {n}") for n in range(5000)] + [("b", f"shop {n}") for n in range(5000, 5300)] + [("c", f"shop {n}") for n in range(5300, 5600)])
    moved = [plan for purpose, plan in plans if purpose == "added"]
    assert (len(moved) > 1) == (most < 10) and not any("hashpartitioning(frame" in plan for plan in moved)


def test_shuffles_go_when_their_table_is_written(spark):
    """Shuffle files of a written table would stay until the driver collects its garbage."""
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        names = set()
        while files.hasNext():
            names.add(files.next().getName())
        return {n for n in names if n.startswith("shuffle_")}

    before = shuffled()
    out = stored(spark.range(10_000).repartition(3, "id"), "test")
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and out.count() == 10_000
