"""Categories for transactions: built-in patterns, user rules and learning from corrections.

Each distinct text is matched once. User rules stay a table and meet texts by equi-join on a key: a few characters
that every text the rule matches holds, the rarest there are in the pattern, or in what each match of a
regular expression must hold. A bitmap of all keys, of bounded size, keeps those parts of a text that are no key
out of the join. Only regular expressions without such a part become part of the plan. Built-in patterns are found
by one regular expression, a trie of their literal parts; of a text only the patterns whose part it holds are tried,
in order. Trying all of them, one after the other, was measured at over 200 microseconds a text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ledgerloom.functions import regexes
from ledgerloom.functions.text import UNCATEGORIZED
from ledgerloom.operators.merchants import BUILTIN_PATTERNS
from ledgerloom.operators.numbering import assign_ids
from ledgerloom.operators.views import category_ids, named_rules
from ledgerloom.session import carried, stored

# Confidence of each way to get a category.
USER_CONFIDENCE, BUILTIN_CONFIDENCE, PRESET_CONFIDENCE = 0.90, 0.75, 0.80

# Words that never become a learned pattern.
STOP_WORDS = [
    "the", "and", "for", "inc", "ltd", "llc", "co", "ca", "purchase", "payment", "pos", "debit", "credit",
    "card", "transaction", "via", "ref", "from", "with", "des", "cad", "usd",
]
LEARNED_PRIORITY = 10

# Characters of a rule's join key at most. Longer keys meet fewer texts that don't match.
KEY_CHARS = 5
# Texts that are looked at to tell rare keys from frequent ones; which key a rule has changes no result.
SAMPLE_TEXTS = 10_000
# Bits of the key bitmap for each key, and at most. Beyond that more parts that are no key reach the join.
KEY_BITS, MOST_BITS = 32, 1 << 21
# Rules without a key that can be listed: regular expressions whose matches need hold no text.
MOST_LISTED = 500
_HIT = "struct<rank:struct<p:bigint,u:bigint,i:bigint>,category:string>"

_LOW = "_low_description"
carried(regexes)
_PLAIN = re.compile(r"^[\w &/'-]+$")


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern without groups, else the pattern itself."""
    return [pattern] if "(" in pattern else pattern.split("|")


def _literal_part(regex: str) -> str:
    """The longest text that every match of the regular expression holds."""
    text = regex.split("(")[0].replace(r"\.", "\0").replace(r"\+", "\1")
    parts = re.split(r"\\b|\.\??", text)
    return max(parts, key=len).replace("\0", ".").replace("\1", "+")


def _lower_rules(rules: DataFrame, children: DataFrame) -> DataFrame:
    """Rules with category names and lower-case patterns, without those that can't match: no pattern, or one that can't be compiled."""
    lower = named_rules(rules, children).withColumn("pattern", F.lower("pattern")).filter("pattern IS NOT NULL")
    return lower.filter((F.col("match_type") != "regex") | _compiled(F.col("pattern")).isNotNull())


def _compiled(pattern: Column) -> Column:
    """NULL for what isn't a regular expression."""
    return F.call_function("try_reflect", F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern)


def bad_rules(rules: DataFrame, children: DataFrame) -> DataFrame:
    """(id, pattern, problem) of regular expressions that can't be compiled; matching passes over them."""
    lower = named_rules(rules, children).withColumn("pattern", F.lower("pattern"))
    bad = lower.filter((F.col("match_type") == "regex") & F.col("pattern").isNotNull() & _compiled(F.col("pattern")).isNull())
    return bad.select(F.col("id").cast("bigint").alias("id"), "pattern", F.lit("not a regular expression").alias("problem"))


def _rank(priority: Column, uses: Column, rule_id: Column) -> Column:
    """Smaller is better: priority, then use count, then the older rule. No priority comes last."""
    worst = F.lit(-(2**31)).cast("bigint")
    return F.struct(
        (-F.coalesce(priority.cast("bigint"), worst)).alias("p"), (-uses.cast("bigint")).alias("u"), rule_id.cast("bigint").alias("i")
    )


def _listed(text: Column, rows: list[Row]) -> Column:
    """The best of the listed rules that matches. Each is a literal of its own, so it is compiled once a task."""
    none = F.lit(None).cast(_HIT)
    chain = None
    for r in rows:
        rank = _rank(F.lit(r["priority"]), F.lit(r["use_count"]), F.lit(r["id"]))
        hit = F.struct(rank.alias("rank"), F.lit(r["category"]).alias("category")).cast(_HIT)
        found = text.rlike(r["pattern"])
        chain = F.when(found, hit) if chain is None else chain.when(found, hit)
    return none if chain is None else chain.otherwise(none)


def _grams(text: Column, size: int) -> Column:
    """All parts of ``size`` characters, none of a shorter text."""
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    parts = F.transform(places, lambda at: F.concat(F.lit("*"), F.substring(text, at, F.lit(size))))
    return F.when(F.length(text) >= size, parts).otherwise(F.array().cast("array<string>"))


def keyed_rules(rules: DataFrame, texts: DataFrame, key_chars: int = KEY_CHARS) -> DataFrame:
    """Rules with ``rule_key``, one row for each key; NULL where there is none. Written: it is read for the bitmap and the join.

    ``rules`` are lower-case, ``texts`` has ``_text``. An exact rule's key is its pattern, a startswith rule's the start of
    it. A contains rule has the rarest of its parts, a regular expression the rarest part of each text of
    which its matches hold one. Unknown match types have no row.
    """
    kind, pattern = F.col("match_type"), F.col("pattern")

    required_texts = regexes.required_texts

    @F.pandas_udf("array<string>")
    def required(patterns: pd.Series) -> pd.Series:
        return patterns.map(required_texts)

    words = rules.filter(kind.isin("contains", "startswith", "exact")).withColumn("needed", F.array("pattern"))
    regex = rules.filter(kind == "regex").withColumn("needed", required("pattern"))
    every = words.unionByName(regex).withColumn("hit", F.struct(_rank(F.col("priority"), F.col("use_count"), F.col("id")).alias("rank"), "category"))
    held = ["id", "pattern", "match_type", "priority", "use_count", "category", "hit"]
    part = every.select(*held, F.explode_outer("needed").alias("needed"))

    def sized(size: Column) -> Column:
        return F.when(size >= key_chars, key_chars).otherwise(size)

    length = sized(F.length("needed"))
    places = F.sequence(F.lit(1), F.length("needed") - length + 1)
    grams = F.transform(places, lambda at: F.concat(F.lit("*"), F.substring(F.col("needed"), at, length)))
    own = (
        F.when(kind == "exact", F.array(F.concat(F.lit("="), pattern)))
        .when(F.length("needed") == 0, F.array().cast("array<string>"))
        .when(kind == "startswith", F.array(F.concat(F.lit("^"), F.substring(pattern, F.lit(1), sized(F.length(pattern))))))
        .otherwise(grams)
    )
    offered = stored(part.withColumn("place", F.monotonically_increasing_id()).withColumn("offers", own), "rule-parts")
    offer = offered.select("place", F.posexplode("offers").alias("nth", "offer"))
    sizes = [r[0] for r in offer.filter("offer LIKE '*%'").select((F.length("offer") - 1).alias("size")).distinct().collect()]
    sample = texts.orderBy(F.xxhash64("_text"), "_text").limit(SAMPLE_TEXTS)
    seen = sample.select(F.explode(F.concat(F.array().cast("array<string>"), *(_grams(F.col("_text"), n) for n in sizes))).alias("gram"))
    wanted = offer.select(F.col("offer").alias("wanted")).distinct()
    counts = seen.join(wanted, F.col("gram") == F.col("wanted"), "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("times"))
    rarest = (
        offer.join(counts, F.col("offer") == F.col("gram"), "left")
        .groupBy(F.col("place").alias("of"))
        .agg(F.min(F.struct(F.coalesce("times", F.lit(0)), "nth", "offer")).alias("best"))
        .select("of", F.col("best.offer").alias("rule_key"))
    )
    chosen = offered.join(rarest, F.col("place") == F.col("of"), "left").select(*held, "rule_key")
    return stored(chosen, "rule-keys")


def key_bitmap(keyed: DataFrame, count: int) -> tuple[int, str]:
    """(bits, words) of a bitmap of the hashes of ``count`` keys: at most MOST_BITS whatever the number of rules."""
    bits = 1 << 10
    while bits < min(KEY_BITS * count, MOST_BITS):
        bits *= 2
    words = keyed.filter("rule_key IS NOT NULL").select(_bit(F.col("rule_key"), bits).alias("at"))
    words = words.selectExpr("at >> 5 AS word", "1L << (at & 31) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = {r["word"]: r["bits"] for r in words.collect()}
    return bits, ",".join(str(found.get(w, 0)) for w in range(bits >> 5))


def _bit(key: Column, bits: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(bits - 1)).cast("int")


def key_shapes(keyed: DataFrame) -> dict[tuple[str | None, int | None], int]:
    """Keys by kind (exact, start, part; None for rules without one) and length: at most ``2 * key_chars + 2`` entries."""
    kind = F.substring("rule_key", 1, 1)
    size = F.when(kind != "=", F.length("rule_key") - 1)
    rows = keyed.groupBy(kind.alias("kind"), size.alias("size")).agg(F.count(F.lit(1)).alias("rules")).collect()
    return {(r["kind"], r["size"]): r["rules"] for r in rows}


def text_keys(text: Column, keyed: DataFrame, shapes: dict[tuple[str | None, int | None], int]) -> Column:
    """The parts of a text that are keys of rules, by the bitmap: the text, its starts and its parts of the keys' lengths."""
    bits, words = key_bitmap(keyed, sum(n for (kind, _), n in shapes.items() if kind))
    bitmap = F.split(F.lit(words), ",").cast("array<bigint>")
    keys = [F.array().cast("array<string>")]
    for kind, size in sorted((k, n or 0) for k, n in shapes if k):
        if kind == "*":
            keys.append(_grams(text, size))
        else:
            keys.append(F.array(F.concat(F.lit(kind), text if kind == "=" else F.substring(text, 1, size))))

    def is_key(key: Column) -> Column:
        word = F.get(bitmap, F.shiftright(_bit(key, bits), 5))
        return F.getbit(word, _bit(key, bits).bitwiseAND(F.lit(31))) == 1

    return F.array_distinct(F.filter(F.concat(*keys), is_key))


def _by_keys(texts: DataFrame, keyed: DataFrame, shapes: dict[tuple[str | None, int | None], int]) -> DataFrame:
    """(_text, hit): the best rule with a key of each text that has one, whatever the number of rules."""
    text, kind, pattern = F.col("_text"), F.col("match_type"), F.col("pattern")
    listed = texts.select("_text", F.explode(text_keys(text, keyed, shapes)).alias("text_key"))
    rules = keyed.filter("rule_key IS NOT NULL").select("rule_key", "match_type", "pattern", "hit")
    holds = (
        F.when(kind == "contains", text.contains(pattern))
        .when(kind == "startswith", text.startswith(pattern))
        .when(kind == "regex", F.rlike(text, pattern))
        .otherwise(text == pattern)
    )
    met = listed.join(rules, F.col("text_key") == F.col("rule_key")).filter(holds)
    return met.groupBy("_text").agg(F.min("hit").alias("hit"))


def _user_hits(texts: DataFrame, rules: DataFrame, children: DataFrame, key_chars: int) -> DataFrame:
    """(_text, user_category, rule_id) of all texts."""
    keyed = keyed_rules(_lower_rules(rules, children), texts, key_chars)
    shapes = key_shapes(keyed)
    rows: list[Row] = []
    if bare := shapes.get((None, None), 0):
        if bare > MOST_LISTED:
            raise ValueError(f"{bare} rules whose matches need hold no text; at most {MOST_LISTED} can be listed")
        order = [F.col("priority").desc(), F.col("use_count").desc(), "id"]
        anything = F.when(F.col("match_type") == "regex", F.col("pattern")).otherwise("")
        rows = keyed.filter("rule_key IS NULL").withColumn("pattern", anything).orderBy(*order).collect()
    words = _by_keys(texts, keyed, shapes).withColumnRenamed("_text", "_word_text")
    joined = texts.join(words, F.col("_text") == F.col("_word_text"), "left")
    best = F.least(F.col("hit").cast(_HIT), _listed(F.col("_text"), rows))
    return joined.withColumn("_best", best).select(
        "_text", F.col("_best.category").alias("user_category"), F.col("_best.rank.i").alias("rule_id")
    )


def _builtin_rows() -> list[dict]:
    """Ordered (nth, part, regex, category); regex is NULL where the part alone decides."""
    rows = []
    for pattern, category in BUILTIN_PATTERNS:
        for part in _alternatives(pattern):
            plain = _PLAIN.match(part) is not None
            rows.append(
                {"nth": len(rows), "part": part if plain else _literal_part(part), "regex": None if plain else part, "category": category}
            )
    return rows


def _trie_regex(parts: Iterable[str]) -> str:
    """A regular expression of the longest of some texts that begins at a place; it looks at each character once."""
    by_first: dict[str, list[str]] = {}
    for part in parts:
        if part:
            by_first.setdefault(part[0], []).append(part[1:])
    branches = []
    for first, rests in by_first.items():
        inner = _trie_regex(rests)
        here = first if first.isalnum() else "\\" + first
        branches.append(here + (f"(?:{inner})" + ("?" if "" in rests else "") if inner else ""))
    return "|".join(branches)


def builtin_category(low: Column) -> Column:
    """Category of the first built-in pattern that hits a lower-case description, else NULL.

    One regular expression finds the longest part at each place of the text. Only patterns whose part begins
    there, the longest itself or a shorter one, are looked at further.
    """
    rows = _builtin_rows()
    parts = sorted({r["part"] for r in rows})
    begun = {part: [{k: r[k] for k in ("nth", "regex", "category")} for r in rows if part.startswith(r["part"])] for part in parts}
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?=({_trie_regex(parts)}))"), 1))
    lists = F.from_json(F.lit(json.dumps(list(begun.values()))), "array<array<struct<nth:int,regex:string,category:string>>>")
    places = F.array(*[F.lit(part) for part in parts])
    near = F.flatten(F.transform(found, lambda part: F.element_at(lists, F.array_position(places, part).cast("int"))))
    hits = F.filter(near, lambda p: p["regex"].isNull() | F.rlike(low, p["regex"]))
    return F.array_min(F.transform(hits, lambda p: F.struct(p["nth"].alias("nth"), p["category"].alias("category"))))["category"]


def _with_low(df: DataFrame, description: str) -> DataFrame:
    return df.withColumn(_LOW, F.lower(F.coalesce(F.col(description), F.lit(""))))


def _texts(keyed: DataFrame) -> DataFrame:
    return keyed.filter(F.col(_LOW).isNotNull()).select(F.col(_LOW).alias("_text")).distinct()


def match_user_rules(
    df: DataFrame, rules: DataFrame, children: DataFrame, description: str = "description", key_chars: int = KEY_CHARS
) -> DataFrame:
    """Adds user_category and rule_id of the best matching rule.

    Order: priority, then use count, then id. Any number of rules is searched; each
    distinct description once.
    """
    keyed = _with_low(df, description)
    hits = _user_hits(_texts(keyed), rules, children, key_chars)
    return keyed.join(hits, F.col(_LOW) == F.col("_text"), "left").drop(_LOW, "_text")


def match_builtin(df: DataFrame, description: str = "description") -> DataFrame:
    """Adds builtin_category."""
    return _with_low(df, description).withColumn("builtin_category", builtin_category(F.col(_LOW))).drop(_LOW)


def _matched(df: DataFrame, low: Column, rules: DataFrame, children: DataFrame, always: bool = False) -> DataFrame:
    """Adds user_category, rule_id and builtin_category for the lower-case text ``low``; none where it is NULL.

    Each distinct text is matched once, built-in patterns only where no user rule hits or with ``always``,
    and the result is joined back. Texts repeat far more often than they differ, so both the texts and what is found for them
    are written: the rows are read once for them, and meet a table of known size, few texts without being shuffled.
    """
    keyed = df.withColumn(_LOW, low)
    hits = _user_hits(stored(_texts(keyed), "texts", "zstd"), rules, children, KEY_CHARS)
    builtin = builtin_category(F.col("_text"))
    matched = hits.withColumn("builtin_category", builtin if always else F.when(F.col("rule_id").isNull(), builtin))
    found = stored(matched, "text-categories", "zstd")
    return keyed.join(found, F.col(_LOW) == F.col("_text"), "left").drop(_LOW, "_text")


def categorise(
    df: DataFrame, rules: DataFrame, children: DataFrame, description: str = "description", where: Column | None = None
) -> DataFrame:
    """Adds category and ai_confidence: user rule, else built-in pattern, else Uncategorized.

    Rows for which ``where`` doesn't hold are not matched.
    """
    low = F.lower(F.coalesce(F.col(description), F.lit("")))
    matched = _matched(df, low if where is None else F.when(where, low), rules, children)
    user, builtin = F.col("user_category"), F.col("builtin_category")
    return matched.withColumns(
        {
            "category": F.coalesce(user, builtin, F.lit(UNCATEGORIZED)),
            "ai_confidence": F.when(user.isNotNull(), USER_CONFIDENCE).when(builtin.isNotNull(), BUILTIN_CONFIDENCE).otherwise(0.0),
        }
    ).drop("user_category", "builtin_category")


def categorise_batch(df: DataFrame, rules: DataFrame, children: DataFrame, description: str = "description") -> DataFrame:
    """Categorises rows without a category; preset ones keep theirs, confidence 0.80 if none is given.

    rule_id is set only where a user rule gave the category, so that usage can be counted.
    """
    preset = F.col("category")
    needs = F.coalesce(preset, F.lit("")).isin("", UNCATEGORIZED)
    given = F.col("ai_confidence").cast("double") if "ai_confidence" in df.columns else F.lit(None).cast("double")
    kept = df.withColumns({"_preset": preset, "_needs": needs, "_given": given})
    done = categorise(kept, rules, children, description, F.col("_needs"))
    return done.withColumns(
        {
            "category": F.when(F.col("_needs"), F.col("category")).otherwise(F.col("_preset")),
            "ai_confidence": F.when(F.col("_needs"), F.col("ai_confidence")).otherwise(
                F.coalesce("_given", F.lit(PRESET_CONFIDENCE))
            ),
            "rule_id": F.when(F.col("_needs"), F.col("rule_id")),
        }
    ).drop("_preset", "_needs", "_given")


def suggest(df: DataFrame, rules: DataFrame, children: DataFrame, description: str = "description") -> DataFrame:
    """Adds suggestions: ARRAY<STRUCT<category, confidence>>, best first, at most three."""
    matched = _matched(df, F.lower(F.coalesce(F.col(description), F.lit(""))), rules, children, always=True)
    user, builtin = F.col("user_category"), F.col("builtin_category")

    def entry(name: Column, confidence: float) -> Column:
        return F.struct(name.alias("category"), F.lit(confidence).alias("confidence"))

    found = F.filter(
        F.array(
            entry(user, USER_CONFIDENCE),
            entry(F.when(user.isNull() | (user != builtin), builtin), BUILTIN_CONFIDENCE),
        ),
        lambda s: s["category"].isNotNull(),
    )
    fallback = F.array(entry(F.lit(UNCATEGORIZED), 0.0))
    picked = F.when(F.size(found) > 0, found).otherwise(fallback)
    return matched.withColumn("suggestions", F.slice(picked, 1, 3)).drop("user_category", "builtin_category", "rule_id")


def keyword(description: Column) -> Column:
    """Longest run of three or more letters that is no stop word, the first on ties; NULL without one."""
    words = F.regexp_extract_all(F.lower(description), F.lit("([a-z]{3,})"), 1)
    kept = F.filter(words, lambda w: ~w.isin(STOP_WORDS))
    best = F.aggregate(
        kept, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best)
    )
    return F.nullif(best, F.lit(""))


def learn_rules(corrections: DataFrame, rules: DataFrame, children: DataFrame) -> DataFrame:
    """The rule table after corrections(description, new_category, old_category).

    A known (pattern, category) gets its use count raised by the number of
    corrections. A new one becomes a ``contains`` rule of priority 10: its first
    correction creates it, the others count as uses. Empty, unchanged and unknown
    categories do nothing.
    """
    real = corrections.filter(
        (F.coalesce("description", F.lit("")) != "")
        & (F.coalesce("new_category", F.lit("")) != "")
        & (F.col("new_category") != F.coalesce("old_category", F.lit("")))
    )
    wanted = (
        real.select(keyword(F.col("description")).alias("word"), F.col("new_category").alias("category"))
        .filter(F.col("word").isNotNull())
        .groupBy("word", "category")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    named = children.select(F.col("id").alias("child_category_id"), F.col("name").alias("category"))
    known = rules.join(named, "child_category_id").withColumn("word", F.lower("pattern"))
    # Several rules may share a pattern and category; the one first in matching order counts.
    first = known.groupBy("word", "category").agg(
        F.min_by("id", F.struct(-F.col("priority"), -F.coalesce("use_count", F.lit(0)), F.col("id"))).alias("id")
    )
    used = wanted.join(first, ["word", "category"]).select("id", "times")
    raised = rules.join(used, "id", "left").withColumn(
        "use_count", F.coalesce("use_count", F.lit(0)) + F.coalesce("times", F.lit(0))
    )
    fresh = wanted.join(first, ["word", "category"], "left_anti").join(category_ids(children), "category")
    added = assign_ids(fresh, ["word", "category"], rules.agg(F.max("id"))).select(
        "id",
        F.col("word").alias("pattern"),
        "child_category_id",
        F.lit("contains").alias("match_type"),
        F.lit(LEARNED_PRIORITY).alias("priority"),
        (F.col("times") - 1).alias("use_count"),
    )
    return raised.select(added.columns).unionByName(added)


def rule_usage(matched: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule table with each match of ``matched.rule_id`` added to use_count."""
    hits = matched.filter(F.col("rule_id").isNotNull()).groupBy(F.col("rule_id").alias("id")).agg(
        F.count(F.lit(1)).alias("hits")
    )
    return rules.join(hits, "id", "left").withColumn(
        "use_count", F.coalesce("use_count", F.lit(0)) + F.coalesce("hits", F.lit(0))
    ).drop("hits")


def add_rules(rules: DataFrame, new: DataFrame, children: DataFrame) -> DataFrame:
    """The rule table with new(pattern, category[, match_type, priority]) added; unknown categories are ignored."""
    kind = F.coalesce("match_type", F.lit("contains")) if "match_type" in new.columns else F.lit("contains")
    rank = F.coalesce("priority", F.lit(5)) if "priority" in new.columns else F.lit(5)
    known = new.join(category_ids(children), "category").select(
        "pattern", "child_category_id", kind.alias("match_type"), rank.alias("priority"), F.lit(0).cast("bigint").alias("use_count")
    )
    added = assign_ids(known, ["pattern", "child_category_id", "match_type", "priority"], rules.agg(F.max("id")))
    return rules.select("id", *known.columns).unionByName(added.select("id", *known.columns))
