"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Each kind has a score to start from. A valid checksum (Luhn for cards, mod 97 for bank account
numbers) raises it, context words within ``NEAR`` characters raise or lower it. The four base
kinds stay whatever their score; the further kinds, bank accounts and national numbers, are
proposed by weaker patterns and kept where the score passes the threshold. Column expressions
only.

The patterns are the contract's, written so that no text makes the search quadratic: a run of
the first class starts a match only at its own start or where the last match ended (``\\G``),
and repetitions after which nothing else follows don't give back what they took.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import match_spans, stringed
from ledgerloom.llm.secret_scan import no_spans

KINDS = ["email", "ip", "card", "phone", "iban", "national"]
BASE_KINDS = 4
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Countries whose bank account numbers have so many characters, country and check digits included.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC",
}
_ACCOUNT = "|".join(f"(?:{'|'.join(names.split())})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{length - 4}}}" for length, names in ACCOUNT_LENGTHS.items())
# The head alone is consumed, so an account that starts inside a proposal is proposed as well; group 1 is the account.
IBAN = rf"(?<![A-Za-z0-9])(?=({_ACCOUNT})(?![A-Za-z0-9]))[A-Z]{{2}}[0-9]{{2}}"
IBAN_HEAD = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}"
NATIONAL = r"(?<![0-9+.(-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

START = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.7, "iban": 0.4, "national": 0.3}
CONFIRMED, NEARBY, AGAINST, THRESHOLD = 0.4, 0.25, -0.25, 0.5
NEAR = 40
WORDS_FOR = {
    "email": r"(?i)\b(?:e-?mail|contact|write|reply)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|client|login)\b",
    "card": r"(?i)\b(?:card|visa|master|credit|debit|payment|cvv|expir\w*)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|dial)\b",
    "iban": r"(?i)\b(?:iban|account|bank|transfer|bic|swift)\b",
    "national": r"(?i)\b(?:ssn|social|security|insurance|tax|national)\b",
}
WORDS_AGAINST = r"(?i)\b(?:example|sample|test|version|order|invoice|isbn|serial|sku)\b"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.array(*(F.lit(2 * d // 10 + 2 * d % 10) for d in range(10)))
    total = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("sum"), F.lit(False).alias("twice")),
        lambda s, c: F.struct(
            F.when(c == "", s["sum"])
            .when(s["twice"], s["sum"] + F.element_at(doubled, c.try_cast("int") + 1))
            .otherwise(s["sum"] + c.try_cast("int"))
            .alias("sum"),
            F.when(c == "", s["twice"]).otherwise(~s["twice"]).alias("twice"),
        ),
        lambda s: s["sum"],
    )
    return (digits != "") & (total % 10 == 0)


def mod_97(account: Column) -> Column:
    """Whether an account number without blanks passes the mod-97 check: its first four characters go last."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))
    rest = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda s, c: F.when(c == "", s)
        .when(c.rlike("^[0-9]$"), (s * 10 + c.try_cast("int")) % 97)
        .otherwise((s * 100 + F.ascii(c) - 55) % 97)
        .cast("int"),
    )
    return rest == 1


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _octets(found: Column) -> Column:
    return F.forall(F.split(found, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(p, -3, 3).try_cast("int") <= 255))


def _accounts(text: Column) -> Column:
    """Spans of the length that the country's account numbers have, from the matched heads and what stands there."""
    return F.zip_with(
        match_spans(text, IBAN),
        F.regexp_extract_all(text, F.lit(IBAN), F.lit(1)),
        lambda s, account: F.struct(s["start"].alias("start"), (s["start"] + F.length(account)).alias("end"), account.alias("found")),
    )


def proposals(text: Column) -> dict[str, Column]:
    """Spans by kind. Base kinds: matches that fail are dropped after the search, without a second try."""
    has_digit = text.rlike("[0-9]")

    def where(condition: Column, spans: Column) -> Column:
        return F.when(condition, spans).otherwise(no_spans())

    cards = F.filter(
        F.filter(match_spans(text, CARD), lambda s: F.length(s["found"]) >= 13),
        lambda s: F.length(digits_of(s["found"])).between(13, 19) & luhn(digits_of(s["found"])),
    )
    return {
        "email": where(F.contains(text, F.lit("@")), match_spans(text, EMAIL)),
        "ip": where(has_digit & F.contains(text, F.lit(".")), F.filter(match_spans(text, IP), lambda s: _octets(s["found"]))),
        "card": where(has_digit, cards),
        "phone": where(
            F.contains(text, F.lit("+")),
            F.filter(match_spans(text, PHONE), lambda s: F.length(digits_of(s["found"])).between(9, 15)),
        ),
        "iban": where(text.rlike(IBAN_HEAD), _accounts(text)),
        "national": where(F.contains(text, F.lit("-")), match_spans(text, NATIONAL)),
    }


def _confirmed(kind: str, found: Column) -> Column:
    if kind == "card":
        return luhn(digits_of(found))
    if kind == "iban":
        return mod_97(F.replace(found, F.lit(" "), F.lit("")))
    if kind == "national":
        return ~found.rlike(r"^(?:000|666|9..)|-00-|-0000$")
    return F.lit(False)


def _scored(kind: str, text: Column, span: Column) -> Column:
    around = F.substr(text, F.greatest(span["start"] + 1 - NEAR, F.lit(1)), span["end"] - span["start"] + 2 * NEAR)
    score = (
        F.lit(START[kind])
        + F.when(_confirmed(kind, span["found"]), CONFIRMED).otherwise(0.0)
        + F.when(around.rlike(WORDS_FOR[kind]), NEARBY).otherwise(0.0)
        + F.when(around.rlike(WORDS_AGAINST), AGAINST).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def find_pii(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans, n_email, n_ip, n_card, n_phone, n_spans``, one row per row; null text is empty and has no spans.

    ``spans`` is an array of ``(kind, start, end, score)`` by kind (its place in ``KINDS``), then
    start. Base kinds are all there; a further kind is there if its score reaches the threshold
    and its checksum holds. ``n_spans`` counts all kinds. Repeated rows give equal rows, empty tables none. Texts
    of any length are searched whole, each pattern in one pass.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), stringed(F.col(text_col)).alias("text"))
    found = rows.withColumns(proposals(text))

    def judged(number: int, kind: str) -> Column:
        spans = F.col(kind)
        if number >= BASE_KINDS:
            spans = F.filter(spans, lambda s: _confirmed(kind, s["found"]))
        scored = F.transform(
            spans,
            lambda s: F.struct(
                F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _scored(kind, text, s).alias("score")
            ),
        )
        return scored if number < BASE_KINDS else F.filter(scored, lambda s: s["score"] >= threshold)

    spans = F.concat(*(judged(n, kind) for n, kind in enumerate(KINDS)))
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:BASE_KINDS]]
    return found.select("doc_id", spans.alias("spans"), *counts).withColumn("n_spans", F.size("spans").cast("long"))
