"""Each method's own claims, on small made-up input."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import common, decontaminate, linededup, mixing, pii, quality, secret_scan, sharding, simhash, toxicity

from . import brute


def test_code_is_perfect():
    words = np.arange(1 << simhash.CODE_BITS, dtype=np.int64)
    assert np.bincount(simhash.syndrome(words), minlength=2048).tolist() == [1 << 12] * 2048
    flips, starts = simhash._flips(0)
    assert len(flips) == 2048 and (np.diff(starts) == 1).all()


def test_anchors_cover_every_link():
    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 2)))
        signed = np.array([simhash._signed(a), simhash._signed(b)])
        _, home = simhash.anchors(signed, 0)
        rows, anchor = simhash.anchors(signed, 2)
        assert len(home) == 2 and home[0] in anchor[rows == 1] and home[1] in anchor[rows == 0]


def test_links_and_components(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):  # chains of up to 12 steps
            fps.add(f)
            f ^= sum(1 << i for i in rng.sample(range(64), 2))
    frame = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = {frozenset((r.a & (1 << 64) - 1, r.b & (1 << 64) - 1)) for r in simhash.links(frame).collect()}
    assert got == {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    scratch = common.Scratch(spark, "test")
    roots = {r.node: r.label for r in simhash.components(simhash.links(frame), scratch).collect()}
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for a, b in map(tuple, got):
        up[root(a)] = root(b)
    groups = {}
    for f in fps:
        groups.setdefault(root(f), set()).add(simhash._signed(f))
    assert all({roots.get(f, f) for f in g} == {min(g)} for g in groups.values())


def test_visits_are_never_broadcast(spark):
    """Each fingerprint makes 61 visits, which Spark sizes like one row: a table just below the broadcast limit would fill the driver."""
    frame = spark.range(5).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(frame)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_one_row_of_each_component_stays(spark):
    """Near copies without ids are one row; rows that share an id are judged each by its own component."""
    rng = random.Random(15)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)) for _ in range(5))
    rows = [(None, a), (None, a), (None, a.upper()), (1, b), (2, b), (2, c), (2, c), (3, d), (3, e), (None, None), (None, "")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, a.upper()), (1, b), (2, c), (3, d), (3, e), (None, None)]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))


def test_long_text_in_chunks():
    text = " ".join(str(i) for i in range(70_000))
    assert simhash.simhash(text.encode()) == brute.simhash(text)


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 1000])
def test_match_spans(spark, size):
    text = "é" + "ab \U0001f600" * size
    row = spark.createDataFrame([(text,)], "t string").select(common.match_spans(F.col("t"), "[a-b]+").alias("s")).first()
    assert [(s.start, s.end) for s in row.s] == [m.span() for m in re.finditer("[a-b]+", text)]


def test_leaks_against_alignment():
    rng = random.Random(5)
    letters = "abcdefgh "
    items = [(n, "".join(rng.choice(letters) for _ in range(rng.choice([8, 30, 59, 75, 140])))) for n in range(12)]
    index = decontaminate.Index(items)
    for _ in range(60):
        _, item = rng.choice(items)
        a = rng.randrange(max(1, len(item) - 40))
        part = list(item[a:])
        for _ in range(rng.randint(0, 7)):
            k = rng.randrange(len(part))
            part[k : k + 1] = rng.choice([[], [rng.choice(letters)], [part[k], rng.choice(letters)]])
            part = part or ["a"]
        text = decontaminate.normal("".join(rng.choice(letters) for _ in range(50)) + "".join(part) + "xyz " * rng.randint(0, 20))
        got = {(index.ids[i], f[0]): f[1] for i, found in index.leaks(text).items() for f in found}
        want = {}
        for n, whole in items:
            whole = decontaminate.normal(whole)
            b = decontaminate.Budget.of(len(whole), 60, 1 / 15, decontaminate.Q)
            for start in range(len(whole) - b.window + 1) if b else ():
                edits = brute.edits_in(whole[start : start + b.window], text)
                if edits <= b.edits:
                    want[n, start] = edits
        assert got == want


def test_leaks_in_long_texts():
    rng = random.Random(6)
    item = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(30))
    index = decontaminate.Index([(1, item)])
    for place in (0, decontaminate.SEGMENT - 30, decontaminate.SEGMENT + 5, 2 * decontaminate.SEGMENT - 300):
        filler = ("lorem " * (place // 6 + 1))[: max(place - 1, 0)].strip()
        text = decontaminate.normal(f"{filler} {item} {'dolor ' * 50000}")
        (found,) = index.leaks(text).values()
        assert len(found) == len(item) - 59 and text[found[0][2] : found[-1][3]] == item


def test_markov_model_tells_random_from_words(spark):
    rng = random.Random(7)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda: "_".join(rng.choice("get set total count value index user name order line".split()) for _ in range(4))
    noise = lambda: "".join(rng.choice(chars) for _ in range(30))
    samples = [(noise(), True) for _ in range(3000)] + [(word(), False) for _ in range(3000)] + [(None, True), ("", False), ("x", None)]
    model = secret_scan.train(spark.createDataFrame(samples, "sample string, is_random boolean"))
    texts = [(n, f"see {noise()} here") for n in range(50)] + [(n + 50, f"see {word()}_{word()} here") for n in range(50)]
    rows = secret_scan.find_secrets(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    found = {r.doc_id: [s for s in r.spans if s.kind == 3] for r in rows}
    assert sum(bool(found[n]) for n in range(50)) >= 48 and sum(bool(found[n]) for n in range(50, 100)) <= 2
    assert all((s.start, s.end) == (4, 34) for n in range(50) for s in found[n])


def test_random_pieces_beside_spans_and_in_paths(spark):
    rng = random.Random(9)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    noise = lambda n: "".join(rng.choice(chars) for _ in range(n))
    word = lambda: "".join(rng.choice("get set total count value index user name order line".split()) for _ in range(4))
    samples = [(noise(30), True) for _ in range(3000)] + [(word(), False) for _ in range(3000)]
    model = secret_scan.train(spark.createDataFrame(samples, "sample string, is_random boolean"))
    short, key = noise(24), noise(40)
    planted = [
        ("key AKIA" + "QRSTUVWXYZ234567" + "/" + key + " end", key),
        ("sum " + "0123456789abcdef" * 2 + "Z" + key, "Z" + key),
        (key + "Z" + "0123456789abcdef" * 2, key + "Z"),
        (f"/home/{word()}/{word()}-{word()}={short}/{word()}/{word()}", short),
        (f"{word()}_{word()} {key} token = abcdefgh1 {word()}", key),
        (f"{word()}/{word()}_{word()}={word()}", None),
    ]
    frame = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(planted)], "doc_id long, text string")
    for r in secret_scan.find_secrets(frame, model).collect():
        text, piece = planted[r.doc_id]
        got = [text[s.start : s.end] for s in r.spans if s.kind == 3]
        assert got == ([] if piece is None else [piece]), (r.doc_id, got)
        assert all(a.end <= b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_bank_accounts_before_other_words(spark):
    good = ["GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606"]
    texts = [f"iban {a}{tail}" for a in good for tail in ("", " BIC ABCD", " EUR", " 2024", ", or", "X", "9")] + ["iban DE00 GB82 WEST 1234 5698 7654 32 EUR", "ZZ82WEST12345698765432"]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        found = [texts[r.doc_id][s.start : s.end] for s in r.spans if pii.KINDS[s.kind] == "iban"]
        want = [a for a in good[:1] if a in texts[r.doc_id]] if r.doc_id == 35 else [good[r.doc_id // 7]] if r.doc_id < 35 and r.doc_id % 7 < 5 else []
        assert found == want, texts[r.doc_id]
        assert r.n_spans == len(r.spans)


def test_checksums(spark):
    rows = [("4111111111111111", True, False), ("4111111111111112", False, False), ("", False, False), ("GB82WEST12345698765432", False, True), ("GB82WEST12345698765431", False, False)]
    frame = spark.createDataFrame([r[:1] for r in rows], "t string")
    luhn = [bool(r[0]) for r in frame.select(pii.luhn(pii.digits_of(F.col("t")))).collect()][:3]
    assert luhn == [r[1] for r in rows[:3]]
    assert [bool(r[0]) for r in frame.select(pii.mod_97(F.col("t"))).collect()][3:] == [True, False]


def test_context_and_checksum_decide(spark):
    texts = [(1, "my bank account GB82 WEST 1234 5698 7654 32 thanks"), (2, "part GB82WEST12345698765431"), (3, "social security 123-45-6789"), (4, "order 123-45-6789")]
    rows = pii.find_pii(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    kinds = {r.doc_id: [pii.KINDS[s.kind] for s in r.spans] for r in rows}
    assert kinds == {1: ["iban"], 2: [], 3: ["national"], 4: []}


def test_water_filling(spark):
    rng = random.Random(8)
    for _ in range(5):
        sizes = {f"s{n:02d}": rng.choice([0, 1, 10, 1000, 50_000]) for n in range(rng.randint(1, 12))}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        rows = mixing.water_filled(mixing.ranked_weights(frame)).collect()
        assert {r.source: r.target for r in rows} == pytest.approx(brute.mix_targets(sizes))


def test_mixed_rows_keep_their_own_counts(spark):
    """Null and repeated ids in sources of other targets, and alike rows among which the edge falls."""
    rng = random.Random(14)
    sizes = {"a": 10, "b": 40, "c": 90}
    rows = [(rng.choice([None, None, 1, n]), f"{s} {n} " + "w " * rng.choice([3, 3, 7]), s) for s, k in sizes.items() for n in range(k)]
    docs = spark.createDataFrame(rows + [(None, "w " * 5, "d"), (None, None, None)], "doc_id long, text string, source string").cache()
    key = lambda r: (str(r.doc_id), str(r.source), len(brute.words(r.text)))
    want, got = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        want[str(r.doc_id), str(r.source), r.size] += r.repeats
    drawn = mixing.mixed_rows(docs).collect()
    got.update(map(key, drawn))
    assert +want == +got
    copies = Counter((r.doc_id, r.source, r.text) for r in drawn)
    for r in docs.collect():
        most = max(n for k, n in copies.items() if key(r) == (str(k[0]), str(k[1]), len(brute.words(k[2])))) if got[key(r)] else 0
        assert most - 1 <= copies[r.doc_id, r.source, r.text] <= most


def best_segments(scores):
    """Maximal scoring segments by their definition: the best one, then the same left and right of it."""
    best = None
    for a in range(len(scores)):
        total = 0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 0 and (best is None or total > best[2] or total == best[2] and b + 1 - a < best[1] - best[0]):
                best = (a, b + 1, total)
    if best is None:
        return []
    a, b, _ = best
    shift = [(x + b, y + b, t) for x, y, t in best_segments(scores[b:])]
    return best_segments(scores[:a]) + [best] + shift


def test_segments():
    rng = random.Random(9)
    for _ in range(300):
        scores = [rng.choice([-7, -5, -3, -2, 1, 2, 3, 5, 6]) + rng.random() / 1000 for _ in range(rng.randint(0, 14))]
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(scores)]
        assert got == [(a, b, round(s, 6)) for a, b, s in best_segments(scores)]


def test_toxic_held_out(spark):
    rng = random.Random(10)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def text(toxic):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["zgrok", "vlimp", "bruxk" + rng.choice(plain)])
        return " ".join(words)

    rows = [(n, text(n % 4 == 0), int(n % 4 == 0)) for n in range(800)]
    model = toxicity.train(spark.createDataFrame([r[1:] for r in rows[:600]], "text string, label int"))
    frame = spark.createDataFrame([r[:2] for r in rows[600:]], "doc_id long, text string")
    got = {r.doc_id: r.score >= 0.7 for r in toxicity.scored(frame, model).collect()}
    assert sum(got[n] == bool(y) for n, _, y in rows[600:]) >= 196


def test_many_weak_segments_count_together():
    """One toxic word in 60: the longer the text, the weaker each hit alone and the stronger all of them."""
    model = toxicity.Model({"zgrok$": 2.2}, scale=3.9, rate=0.2, slope=2.7, offset=-5.4)
    scorer = toxicity.Scorer(model)
    totals = [scorer.passages(("zgrok " + "plain " * 59) * (n // 60))[0] for n in (1_200, 6_000, 24_000, 96_000)]
    assert totals == sorted(totals) and model.probability(totals[0]) >= toxicity.CUTOFF
    # as many hits as chance gives in a text of this length
    assert scorer.passages(("zgrok " + "plain " * 11_999) * 8)[0] == 0


def test_passages_are_all_significant_segments():
    """One strong and many lesser passages: all that are significant alone, and all that are so together."""
    rng = random.Random(13)
    scores = {"zgrok": 2.6, "vlimp": 3.4, "bruxk": 9.0, "mild": 1.2}
    model = toxicity.Model({f"{w}$": s for w, s in scores.items()}, scale=3.9, rate=0.2)
    scorer = toxicity.Scorer(model)
    for size in (40, 300, 3_000, 10_000):
        words = [rng.choice([*scores]) if rng.random() < 1 / 60 else "plain" for _ in range(size)]
        words[size // 2] = "bruxk"
        text = " ".join(words)
        total, got = scorer.passages(text)
        # the brute-force list: segments of a plain scan, each judged by itself
        starts = [0, *np.cumsum([len(w) + 1 for w in words])]
        own = [
            (int(starts[a]), int(starts[b]) - 1, model.scale * s - np.log(model.rate * size))
            for a, b, s in toxicity.segments([scores.get(w, 0) - toxicity.DRIFT for w in words])
        ]
        want = [(a, b) for a, b, e in own if e >= -np.log(toxicity.EXPECTED)]
        assert want and set(want) <= {(a, b) for a, b, _ in got} and got == sorted(got)
        _, count = model.together([s for *_, s in scorer.raw(text)[0]], size)
        assert len(got) == max(count, len(want))
        assert sum(e for *_, e in got) == pytest.approx(sum(sorted((e for *_, e in own), reverse=True)[: len(got)]))


def test_chance_is_not_exceeded_by_trying_every_count():
    """Chance segments: evidences are the points of a Poisson process of density exp(-x)."""
    points = -np.log(np.cumsum(np.random.default_rng(12).exponential(size=(4_000, 100)), axis=1))
    model = toxicity.Model({}, scale=1.0, rate=1.0)
    assert np.mean([model.together(list(p), 1)[0] > 0 for p in points]) <= 1.5 * toxicity.EXPECTED


def test_quality_gradients():
    net = quality.initial(1)
    rng = np.random.default_rng(2)
    data = bytes(rng.integers(0, 256, 700, dtype=np.uint8))
    net = {k: v.astype(np.float64) for k, v in net.items()}
    _, found = quality.gradients(net, data, 1)

    def loss(at):
        return float(np.log1p(np.exp(-quality.logit(at, data))))

    for name in net:
        if name == "embed":
            place = (data[3] + 1, 2)
        else:
            place = tuple(0 for _ in net[name].shape)
        moved = {k: v.copy() for k, v in net.items()}
        moved[name][place] += 1e-5
        back = {k: v.copy() for k, v in net.items()}
        back[name][place] -= 1e-5
        assert (loss(moved) - loss(back)) / 2e-5 == pytest.approx(float(found[name][place]), abs=2e-4)


def test_quality_held_out():
    rng = random.Random(11)

    def text(good):
        words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(10, 120))]
        return (" ".join(words) if good else " ".join(w + "$$$" for w in words)).encode()

    rows = [(text(n % 3 > 0), int(n % 3 > 0)) for n in range(300)]
    net = quality.fit(rows[:200], steps=80)
    assert sum((quality.logit(net, t) > 0) == bool(y) for t, y in rows[200:]) >= 97


def test_movement_is_confined():
    keys = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 20_000)
    before = sharding.descend(keys, sharding.tree(16))
    after = sharding.descend(keys, sharding.grown(sharding.tree(16), 16))
    assert ((after == before) | (after == 16)).all()
    assert 0.8 / 17 < (after == 16).mean() < 1.2 / 17
    assert np.bincount(before, minlength=16).min() > 1000
    heavier = sharding.descend(keys, sharding.tree(16, weights={5: 3.0}))
    moved = before != heavier
    # shard 5 is in the first region's second rack: what leaves the second region goes to the first, nothing goes back
    assert moved.any() and not (moved & (before < 8) & (heavier >= 8)).any()


def test_runs_are_levelled(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    scratch = common.Scratch(spark, "test")
    dropped = []
    for n in range(5):
        text = "\n".join(["the same line in all", f"line number {n} of all", f"line number {n // 2} of pairs"])
        rows = spark.createDataFrame([(n, n, text)], "doc_id long, row long, text string")
        dropped.append(sorted(r.at for r in runs.add(scratch.keep(linededup.lines_of(rows))).collect()))
        assert [len(level) for level in runs.levels] == [int(b) for b in reversed(f"{n + 1:b}")]
    assert dropped == [[], [0, 2], [0], [0, 2], [0]]


def line_rows(spark, first, last, words=9):
    rows = [(i, f"line number {i % words} of all\nonly here {i}\nline number {(i * 7) % words} of all") for i in range(first, last)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.xxhash64("text"))


def test_runs_are_merged_without_exchange_or_sort(spark):
    """Batches and runs meet a run's sorted buckets as they lie."""
    runs, scratch = linededup.LineRuns(spark, fanout=4, buckets=8), common.Scratch(spark, "test-lines")
    for n in range(3):
        runs.add(scratch.keep(linededup.lines_of(line_rows(spark, 40 * n, 40 * n + 40))))
    names = runs.levels[0]
    assert len(names) == 3
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with linededup.sorted_buckets(spark, 8):
            plan = runs.merged(names[:2])._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan and plan.count("Bucketed: true") == 2
            lines = scratch.keep(linededup.lines_of(line_rows(spark, 200, 240)))
            owned = lines.groupBy("high", "low").agg(F.min("doc_id").alias("owner"))
            plan = runs.unknown(owned)._jdf.queryExecution().executedPlan().toString()
            # one exchange, that of the batch's own aggregate, and one sort of what comes out of it
            assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    runs.close()


@pytest.mark.parametrize("buckets", [8, 3])
def test_another_session_adds_a_batch(spark, buckets):
    """Batches added through the manifest drop the lines that one go over all of them drops."""
    scratch, path, dropped = common.Scratch(spark, "test-lines"), None, []
    for n in range(5):
        runs = linededup.LineRuns.open(spark, path) if path else linededup.LineRuns(spark, fanout=2, buckets=buckets)
        path = runs.path
        drops = runs.add(scratch.keep(linededup.lines_of(line_rows(spark, 30 * n, 30 * n + 30))))
        dropped += [(r.doc_id, r.at) for r in drops.collect()]
    assert [len(level) for level in runs.levels] == [1, 0, 1] and runs.buckets == buckets
    owners, want = {}, []
    rows = [(r.doc_id, r.text.split("\n")) for r in line_rows(spark, 0, 150).collect()]
    for i, lines in rows:
        for line in lines:
            owners[line] = min(i, owners.get(line, i))
    want = [(i, at) for i, lines in rows for at, line in enumerate(lines) if owners[line] != i]
    assert sorted(dropped) == sorted(want)
    hashes = runs.run(runs.levels[2][0]).unionAll(runs.run(runs.levels[0][0]))
    assert hashes.count() == hashes.select("high", "low").distinct().count() == len(owners)
