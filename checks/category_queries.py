"""Categorisation, rules and learning."""

from pyspark.sql import functions as F

from checks.registry import check
from ledgerloom.functions.money import money_out
from ledgerloom.operators import categorise, views
from ledgerloom.operators.merchants import BUILTIN_PATTERNS
from ledgerloom.plans import imports


def builtin_sql() -> str:
    """The patterns as a CASE; the two lookaheads become "and not"."""
    branches = []
    for pattern, category in BUILTIN_PATTERNS:
        if "(?!" in pattern:
            head, tail = pattern[:-1].split("(?!")
            condition = f"regexp_matches(d, '{head}') AND NOT regexp_matches(d, '{head}({tail})')"
        else:
            condition = f"regexp_matches(d, '{pattern}')"
        branches.append(f"WHEN {condition} THEN '{category}'")
    return "CASE " + " ".join(branches) + " END"


LOW = "SELECT *, lower(description) AS d FROM f_merchants"
BUILTIN = f"SELECT *, {builtin_sql()} AS builtin FROM ({LOW})"
HIT = """CASE r.match_type WHEN 'contains' THEN contains(m.d, lower(r.pattern)) WHEN 'startswith' THEN starts_with(m.d, lower(r.pattern))
    WHEN 'exact' THEN m.d = lower(r.pattern) WHEN 'regex' THEN regexp_matches(m.d, lower(r.pattern)) ELSE false END"""
NAMED_RULES = """SELECT r.*, c.name AS rule_category, coalesce(use_count, 0) AS uses FROM f_rules r JOIN f_child_categories c
    ON r.child_category_id = c.id"""
USER = f"""SELECT m.id, arg_min(r.rule_category, (-r.priority, -r.uses, r.id)) AS user_category, arg_min(r.id, (-r.priority, -r.uses, r.id)) AS rule_id
    FROM ({LOW}) m JOIN ({NAMED_RULES}) r ON {HIT} GROUP BY m.id"""
BOTH = f"SELECT b.*, u.user_category, u.rule_id FROM ({BUILTIN}) b LEFT JOIN ({USER}) u USING (id)"
CONFIDENCE = "CASE WHEN user_category IS NOT NULL THEN 0.9 WHEN builtin IS NOT NULL THEN 0.75 ELSE 0.0 END"
PICK = "coalesce(user_category, builtin, 'Uncategorized')"


@check("builtin_category", f"SELECT id, builtin AS builtin_category FROM ({BUILTIN})")
def _(f):
    return categorise.match_builtin(f.merchants).select("id", "builtin_category")


@check("user_category", f"SELECT m.id, u.user_category, u.rule_id FROM f_merchants m LEFT JOIN ({USER}) u USING (id)")
def _(f):
    return categorise.match_user_rules(f.merchants, f.rules, f.children).select("id", "user_category", "rule_id")


@check(
    "import_categories",
    f"""SELECT b.id, c.id AS child_category_id, CAST({CONFIDENCE} AS DOUBLE) AS ai_confidence, u.rule_id
    FROM ({BUILTIN}) b LEFT JOIN ({USER}) u USING (id) LEFT JOIN f_child_categories c ON c.name = {PICK}""",
)
def _(f):
    # one statement row per merchant text, its amount being the row's number
    rows = f.merchants.select(
        F.lit("m.csv").alias("source_file"), F.lit(0).cast("bigint").alias("source_block"), F.col("id").cast("bigint").alias("source_row"),
        F.lit("2025-01-01").alias("Date"), F.col("description").alias("Description"), F.col("id").cast("string").alias("Amount"),
        F.lit("Purchase").alias("Type"),
    )
    empty = f.txns.select("id", F.lit("").alias("hash")).filter("hash = 'x'")
    done = imports.import_frames([(rows, "Rogers Mastercard")], empty, f.accounts, f.children, f.rules)
    return done.added.select(
        (-F.col("amount")).cast("bigint").alias("id"), "child_category_id", money_out("ai_confidence").alias("ai_confidence"), "rule_id"
    )


@check("user_category_many_lists", f"SELECT m.id, u.user_category, u.rule_id FROM f_merchants m LEFT JOIN ({USER}) u USING (id)")
def _(f):
    return categorise.match_user_rules(f.merchants, f.rules, f.children, key_chars=2).select("id", "user_category", "rule_id")


# Rules taken from the part names: one per distinct name, of four kinds and one unknown kind.
PART_RULES = """SELECT min(p_partkey) AS id, CASE min(p_partkey) % 5 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN split_part(p_name, ' ', 1)
    WHEN 3 THEN concat(split_part(p_name, ' ', 1), '.*', substr(split_part(p_name, ' ', 2), 2, 2)) ELSE upper(p_name) END AS pattern,
    CASE min(p_partkey) % 5 WHEN 0 THEN 'contains' WHEN 1 THEN 'startswith' WHEN 2 THEN 'exact' WHEN 3 THEN 'regex' ELSE 'sounds' END AS match_type,
    CAST(max(p_size) % 10 AS INTEGER) AS priority, count(*) AS use_count, min(p_partkey) % 25 AS child_category_id FROM part GROUP BY p_name"""


def part_rules(f):
    key, first = F.min("p_partkey"), F.split("p_name", " ")[0]
    rows = f.table("part").groupBy("p_name").agg(
        key.alias("id"), (F.max("p_size") % 10).alias("priority"), F.count(F.lit(1)).alias("use_count")
    )
    kind = F.col("id") % 5
    regex = F.concat(first, F.lit(".*"), F.substring(F.split("p_name", " ")[1], 2, 2))
    pattern = F.when(kind.isin(0, 1), first).when(kind == 3, regex).otherwise(F.upper("p_name"))
    match_type = F.when(kind == 0, "contains").when(kind == 1, "startswith").when(kind == 2, "exact").when(kind == 3, "regex").otherwise("sounds")
    return rows.select(
        "id", pattern.alias("pattern"), match_type.alias("match_type"), "priority", "use_count",
        (F.col("id") % 25).alias("child_category_id"),
    )


# Each distinct text meets exact rules by equality, and the few distinct patterns of the other kinds.
PART_USER = f"""WITH rules AS (
        SELECT r.*, lower(pattern) AS p, c.name AS category, {{'a': -r.priority, 'b': -r.use_count, 'c': r.id}} AS place
        FROM ({PART_RULES}) r JOIN f_child_categories c ON r.child_category_id = c.id),
    texts AS (SELECT DISTINCT lower(description) AS d FROM f_transactions),
    best AS (SELECT p, match_type, min(place) AS place FROM rules GROUP BY p, match_type),
    met AS (
        SELECT m.d, r.place FROM texts m JOIN best r ON r.match_type = 'exact' AND m.d = r.p UNION ALL
        SELECT m.d, r.place FROM texts m JOIN (SELECT *, p AS pattern FROM best WHERE match_type <> 'exact') r ON {HIT}),
    won AS (SELECT d, min(place).c AS rule_id FROM met GROUP BY d)
    SELECT m.id, r.category AS user_category, r.id AS rule_id FROM f_transactions m JOIN won ON lower(m.description) = won.d JOIN rules r ON r.id = won.rule_id"""


@check("user_category_parts", f"SELECT m.id, u.user_category, u.rule_id FROM f_transactions m LEFT JOIN ({PART_USER}) u USING (id)")
def _(f):
    return categorise.match_user_rules(f.txns, part_rules(f), f.children).select("id", "user_category", "rule_id")


@check("rules_view", f"SELECT r.id, r.pattern, r.match_type, r.priority, r.use_count, c.name AS category FROM ({PART_RULES}) r JOIN f_child_categories c ON r.child_category_id = c.id")
def _(f):
    return views.rules_view(part_rules(f), f.children).drop("child_category_id")


@check("rule_usage", f"SELECT r.* REPLACE (use_count + (SELECT count(*) FROM ({PART_USER}) u WHERE u.rule_id = r.id) AS use_count) FROM ({PART_RULES}) r")
def _(f):
    rules = part_rules(f)
    return categorise.rule_usage(categorise.match_user_rules(f.txns, rules, f.children), rules)


@check(
    "add_rules",
    f"""WITH n AS (SELECT n_name AS pattern, n_nationkey AS child_category_id, 'contains' AS match_type, 5 AS priority FROM nation)
    SELECT id, pattern, child_category_id, match_type, priority, use_count FROM ({PART_RULES}) UNION ALL
    SELECT (SELECT max(id) FROM ({PART_RULES})) + row_number() OVER (ORDER BY substr(md5(concat_ws('|', pattern, CAST(child_category_id AS VARCHAR),
    match_type, CAST(priority AS VARCHAR))), 1, 2), pattern), pattern, child_category_id, match_type, priority, 0 FROM n""",
)
def _(f):
    new = f.children.select(F.col("name").alias("pattern"), F.col("name").alias("category"))
    unknown = f.parents.select(F.col("name").alias("pattern"), F.lit("no such").alias("category"))
    return categorise.add_rules(part_rules(f), new.unionByName(unknown), f.children)


@check("categorise", f"SELECT id, {PICK} AS category, CAST({CONFIDENCE} AS DOUBLE) AS ai_confidence FROM ({BOTH})")
def _(f):
    return categorise.categorise(f.merchants, f.rules, f.children).select("id", "category", "ai_confidence")


NEEDS = "coalesce(category, '') IN ('', 'Uncategorized')"


@check(
    "categorise_batch",
    f"""SELECT id, CASE WHEN {NEEDS} THEN {PICK} ELSE category END AS category, CAST(CASE WHEN {NEEDS} THEN {CONFIDENCE} ELSE 0.8 END AS DOUBLE)
    AS ai_confidence, CASE WHEN {NEEDS} THEN rule_id END AS rule_id FROM ({BOTH})""",
)
def _(f):
    rows = categorise.categorise_batch(f.merchants, f.rules, f.children)
    return rows.select("id", "category", money_out("ai_confidence").alias("ai_confidence"), "rule_id")


@check(
    "suggest",
    f"""SELECT id, coalesce(nullif(concat_ws(' ', user_category || ':0.9', CASE WHEN user_category IS NULL OR user_category <> builtin
    THEN builtin || ':0.75' END), ''), 'Uncategorized:0.0') AS suggestions FROM ({BOTH})""",
)
def _(f):
    rows = categorise.suggest(f.merchants, f.rules, f.children)
    shown = F.transform("suggestions", lambda s: F.concat(s["category"], F.lit(":"), s["confidence"].cast("string")))
    return rows.select("id", F.array_join(shown, " ").alias("suggestions"))


STOP = ", ".join(f"'{w}'" for w in categorise.STOP_WORDS)
WORDS = f"list_filter(regexp_extract_all(lower(description), '[a-z]{{3,}}'), lambda w: w NOT IN ({STOP}))"
KEYWORD = f"nullif(list_reduce(list_prepend('', {WORDS}), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END), '')"


@check("keyword", f"SELECT id, {KEYWORD} AS word FROM f_merchants")
def _(f):
    return f.merchants.select("id", categorise.keyword(F.col("description")).alias("word"))


@check(
    "learn_rules",
    f"""WITH x AS (SELECT description, concat('NATION_', CAST(id % 27 AS VARCHAR)) AS category, category AS old FROM f_merchants),
    w AS (SELECT {KEYWORD} AS word, category, count(*) AS times FROM x WHERE category <> coalesce(old, '') GROUP BY 1, 2 HAVING word IS NOT NULL),
    k AS (SELECT lower(pattern) AS word, c.name AS category, arg_min(r.id, (-priority, -coalesce(use_count, 0), r.id)) AS id FROM f_rules r
          JOIN f_child_categories c ON r.child_category_id = c.id GROUP BY 1, 2),
    u AS (SELECT k.id, w.times FROM w JOIN k USING (word, category)),
    n AS (SELECT w.*, c.id AS child_category_id FROM w ANTI JOIN k USING (word, category) JOIN f_child_categories c ON c.name = w.category)
    SELECT r.id, pattern, child_category_id, match_type, priority, coalesce(use_count, 0) + coalesce(times, 0) AS use_count
    FROM f_rules r LEFT JOIN u USING (id) UNION ALL
    SELECT (SELECT max(id) FROM f_rules) + row_number() OVER (ORDER BY substr(md5(concat_ws('|', word, category)), 1, 2), word, category), word,
    child_category_id, 'contains', 10, times - 1 FROM n""",
)
def _(f):
    corrections = f.merchants.select(
        "description", F.concat(F.lit("NATION_"), (F.col("id") % 27).cast("string")).alias("new_category"),
        F.col("category").alias("old_category"),
    )
    return categorise.learn_rules(corrections, f.rules, f.children)


@check(
    "uncategorised_names",
    f"SELECT builtin AS category, count(*) AS rows FROM ({BUILTIN}) WHERE builtin NOT IN (SELECT name FROM f_child_categories) GROUP BY 1",
)
def _(f):
    used = categorise.match_builtin(f.merchants.drop("category")).withColumnRenamed("builtin_category", "category")
    return views.unresolved_categories(used, f.children)
