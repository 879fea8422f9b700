"""User rules as data: keys of regular expressions, rare parts, the bitmap, and plans that don't grow."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.regexes import required_texts
from ledgerloom.operators import categorise
from ledgerloom.operators.categorise import match_user_rules
from ledgerloom.schemas import CHILD_CATEGORIES, RULES


@pytest.mark.parametrize(
    "pattern, texts",
    [
        ("corner", ["corner"]), ("e.transfer|interac", ["transfer", "interac"]), (r"bell\w+ #\D*7", ["bell"]), ("sh[ao]p", ["sh"]),
        ("colou?r shop", ["r shop"]), ("ab+cd", ["ab"]), ("a{2}bc", ["bc"]), (r"a\.b\+c", ["a.b+c"]), ("(x|y)zed", ["zed"]), ("x(?!y)uv", ["uv"]),
        (".*", []), (r"\d{4}", []), ("", []), ("a|.*", []), ("(?x) a b", []), ("[]a]bc", ["bc"]), ("[^]|]bc|de", ["bc", "de"]), ("^start$", ["start"]),
    ],
)
def test_required_texts(pattern, texts):
    assert required_texts(pattern) == texts


def grown(rng, depth=0):
    """A random expression, and a function that makes texts it matches."""
    kind = rng.randrange(8) if depth < 3 else rng.randrange(3)
    if kind < 3:
        text = "".join(rng.choice("abcd -") for _ in range(rng.randrange(1, 5)))
        return re.escape(text), lambda: text
    if kind == 3:
        return "[abc]", lambda: rng.choice("abc")
    if kind == 4:
        return ".", lambda: rng.choice("xyz")
    a, make_a = grown(rng, depth + 1)
    if kind == 5:
        mark, low, high = rng.choice([("*", 0, 3), ("+", 1, 3), ("?", 0, 1), ("{2}", 2, 2), ("{0,1}", 0, 1), ("*?", 0, 2), ("+?", 1, 2)])
        if rng.random() < 0.5:
            return "a" + mark, lambda: "a" * rng.randint(low, high)
        return f"({a}){mark}", lambda: "".join(make_a() for _ in range(rng.randint(low, high)))
    b, make_b = grown(rng, depth + 1)
    if kind == 6:
        return f"{a}{b}", lambda: make_a() + make_b()
    inside = rng.random() < 0.5 or depth
    return (f"({a}|{b})" if inside else f"{a}|{b}"), lambda: rng.choice([make_a, make_b])()


def test_every_match_holds_a_required_text():
    rng, keyed = random.Random(8), 0
    for _ in range(4000):
        pattern, make = grown(rng)
        texts = required_texts(pattern)
        keyed += bool(texts)
        for _ in range(5):
            text = make()
            found = re.search(pattern, text)
            assert found and (not texts or any(t in found.group() for t in texts)), (pattern, texts, text)
    assert keyed > 2000


def test_rules_against_trying_all(spark):
    """Random rules of all kinds, with patterns that share parts, against every rule tried on every text."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 9)))
    rows = []
    for n in range(300):
        kind = ["contains", "startswith", "exact", "regex", "sounds"][n % 5]
        pattern = word() if kind != "regex" else rng.choice(["{}.{}", "{}|{}", "{}[ab]{}", "{}+{}", "^{}\\w*{}", "({}|{})", "\\s{}?{}"]).format(word(), word())
        rows.append((n, pattern, 1 + n % 2, kind, rng.randrange(4), rng.randrange(3)))
    rows += [(900, ".c", 1, "regex", 0, 0), (901, "(bad", 1, "regex", 99, 0), (902, "", 2, "startswith", -1, 0), (903, None, 1, "contains", 99, 0)]
    children = spark.createDataFrame([(1, 1, "A", None, None, 0), (2, 1, "B", None, None, 0)], CHILD_CATEGORIES)
    texts = ["".join(rng.choice("abcABC  ") for _ in range(rng.randrange(0, 20))) for _ in range(400)] + [rows[2][1], rows[7][1].upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, description STRING")

    def hits(kind, pattern, text):
        if kind == "regex":
            return pattern != "(bad" and re.search(pattern.lower(), text) is not None
        return {"contains": pattern in text, "startswith": text.startswith(pattern), "exact": text == pattern}.get(kind, False)

    want = {}
    for i, text in enumerate(texts):
        good = [(-p, -u, n) for n, pattern, _, kind, p, u in rows if pattern is not None and hits(kind, pattern.lower(), text.lower())]
        want[i] = min(good)[2] if good else None
    for key_chars in (1, 3, 5):
        got = {r["id"]: r["rule_id"] for r in match_user_rules(df, spark.createDataFrame(rows, RULES), children, key_chars=key_chars).collect()}
        assert got == want


def shape(df):
    return re.sub(r"#\d+|\d+|Statistics.*", "", " ".join(re.findall(r"[A-Z]\w+(?= )|[A-Z]\w+(?=\n)", df._jdf.queryExecution().optimizedPlan().toString())))


def test_many_regular_expressions_have_the_plan_of_few(spark):
    children = spark.createDataFrame([(1, 1, "A", None, None, 0)], CHILD_CATEGORIES)
    texts = spark.createDataFrame([(n, f"SHOP{n}x{n} street") for n in range(0, 100_000, 997)], "id INT, description STRING").cache()

    def rules(count):
        return spark.range(count).select(
            "id", F.concat(F.lit("shop"), "id", F.lit("[xy]"), "id", F.lit(" st.*t$")).alias("pattern"), F.lit(1).cast("bigint").alias("child_category_id"),
            F.lit("regex").alias("match_type"), F.lit(5).alias("priority"), F.lit(0).cast("bigint").alias("use_count"),
        )

    few, many = (match_user_rules(texts, rules(n), children) for n in (10, 100_000))
    assert shape(few) == shape(many)
    assert all(r["id"] == r["rule_id"] for r in many.collect())


def test_few_parts_of_a_text_are_looked_up(spark):
    """Of some 150 parts of a text, in the lengths of the keys, hardly one that is no key reaches the join."""
    rng = random.Random(10)
    rows = [(n, "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9) + 2)), 1, "contains", 5, 0) for n in range(500)]
    children = spark.createDataFrame([(1, 1, "A", None, None, 0)], CHILD_CATEGORIES)
    texts = spark.createDataFrame([("".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(40)),) for _ in range(500)], "_text STRING")
    keyed = categorise.keyed_rules(categorise._lower_rules(spark.createDataFrame(rows, RULES), children), texts)
    keys = categorise.text_keys(F.col("_text"), keyed, categorise.key_shapes(keyed))
    looked_up = texts.select(F.sum(F.size(keys))).first()[0] / 500
    all_parts = sum(40 - n + 1 for n in (3, 4, 5))
    assert looked_up <= all_parts / 10
    # the frequent start that all rules share is nobody's key
    shared = [(n, f"purchase at {w}", 1, "contains", 5, 0) for n, w in enumerate(["xylo", "quark", "vortex"])]
    busy = spark.createDataFrame([(f"purchase at place {n}",) for n in range(300)], "_text STRING")
    chosen = {r["rule_key"] for r in categorise.keyed_rules(categorise._lower_rules(spark.createDataFrame(shared, RULES), children), busy).collect()}
    assert len(chosen) == 3 and not any(k[1:] in "purchase at " for k in chosen)


def test_rules_without_a_key_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(categorise, "MOST_LISTED", 3)
    children = spark.createDataFrame([(1, 1, "A", None, None, 0)], CHILD_CATEGORIES)
    rules = spark.createDataFrame([(n, f".{{{n + 1}}}", 1, "regex", 5, 0) for n in range(4)], RULES)
    texts = spark.createDataFrame([(1, "abc")], "id INT, description STRING")
    with pytest.raises(ValueError, match="at most 3"):
        match_user_rules(texts, rules, children)
    assert match_user_rules(texts, rules.filter("id < 3"), children).first()["rule_id"] == 0


def test_builtin_patterns_by_their_parts(spark):
    """The first pattern that hits, as one search after the other finds it, over texts made of parts that overlap."""
    from ledgerloom.operators.categorise import _builtin_rows, _trie_regex, builtin_category

    assert re.compile(_trie_regex(["metro", "metrolinx", "me", "h&m"])).findall("metrol metrolinx h&m m") == ["metro", "metrolinx", "h&m"]
    rows = _builtin_rows()
    draw = random.Random(3)
    words = [r["part"] for r in rows] + ["transit", "bank", "s", " ", "\n"]
    texts = ["".join(draw.choice(words) + draw.choice(["", " "]) for _ in range(draw.randint(0, 4))) for _ in range(2000)]

    def first(text):
        found = (r["category"] for r in rows if r["part"] in text and (r["regex"] is None or re.search(r["regex"], text, re.ASCII)))
        return next(found, None)

    held = spark.createDataFrame([(t,) for t in [*texts, None]], "t STRING")
    got = held.select("t", builtin_category(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in got} == {None: None} | {t: first(t) for t in texts}
    # patterns are not tried one after the other
    plan = held.select(builtin_category(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "contains(" not in plan.lower()
