"""Periodic runs: catchers against the definition, any way of appending, and the query against plain Python."""

import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import periodic, queries

from . import brute

FOLDER = "/root/testdata/sf0.001"


def all_runs(w, least_words, least_periods):
    """Maximal stretches (start, end, smallest period), by trying every period at every place."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = p
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - p]:
                j += 1
            if j - i >= p:
                found.setdefault((i - p, j), p)
            i = max(j, i + 1)
    return sorted((s, e, p) for (s, e), p in found.items() if e - s >= least_words and e - s >= least_periods * p)


def folded(words, doc_id):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 or n == 0:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def contract(doc_id, text):
    words = folded(brute.words(text), doc_id)
    runs = sorted((s, e - s, p) for s, e, p in all_runs(words, 6, 4))
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    best = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, brute.sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), brute.sha(kept))


def texts(rng, count):
    for _ in range(count):
        n, kinds = rng.randrange(70), rng.choice([1, 2, 2, 3, 5])
        words = [rng.randrange(kinds) for _ in range(n)]
        if rng.random() < 0.5 and n:
            a, p = rng.randrange(n), rng.randrange(1, 9)
            words = [w if i < a + p else words[a + (i - a) % p] for i, w in enumerate(words)]
            words = [9 if rng.random() < 0.02 else w for w in words]
        yield np.array(words, np.int64)


def test_runs_by_definition_and_by_any_appends():
    rng = random.Random(11)
    for words in texts(rng, 1500):
        want = all_runs(words.tolist(), 2, 2)
        assert sorted(map(tuple, periodic.find_runs(words, 2, 2).tolist())) == want
        catchers, squares, at = periodic.SquareCatchers(), [], 0
        while at < len(words):
            size = rng.choice([1, 1, 2, 5, 16])
            new = catchers.append(words[at : at + size])
            assert all(e > at for _, e, _ in new)  # reported once it is complete, not before
            squares += new
            at += size
        assert sorted(map(tuple, catchers.runs().tolist())) == want
        assert all(e - s == 2 * p and (words[s : s + p] == words[s + p : e]).all() for s, e, p in squares)
        assert {(s, p) for s, _, p in want} <= {(s, p) for s, _, p in squares}


def test_a_square_is_reported_with_the_word_that_completes_it():
    words = np.array([7, 1, 2, 3, 1, 2, 3, 1, 5])
    catchers = periodic.SquareCatchers()
    assert [catchers.append(words[i : i + 1]) for i in range(9)] == [[]] * 6 + [[(1, 7, 3)]] + [[]] * 2
    assert catchers.runs().tolist() == [[1, 8, 3]]


def test_long_texts():
    words = np.random.default_rng(5).integers(0, 50, 150_000)
    words[20_000:140_000] = np.resize(words[20_000:20_777], 120_000)
    assert [20_000, 777] in periodic.find_runs(words)[:, [0, 2]].tolist()
    again = np.resize(np.arange(3), 200_000)
    assert periodic.find_runs(again).tolist() == [[0, 200_000, 3]]
    # areas of one word each, cut by other words: many matches, no square across
    cut = np.zeros(5_000, np.int64)
    cut[::100] = np.arange(50) + 1
    assert len(periodic.find_runs(cut)) == 50


def test_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(tuple(r[n] for n in names) for r in queries.QUERIES["op11_periodic_runs"](spark, FOLDER).collect())
    assert got == sorted(contract(*r) for r in rows)
    assert sum(r[1] for r in got)


@pytest.mark.parametrize("fold", [False, True])
def test_edges(spark, fold):
    rows = [(None, None), (None, "a b"), (1, ""), (2, " \t\n "), (3, "x " * 9), (3, "x " * 9), (4, "é é é é é é é é"), (5, "A a A a A a A a b" * 3)]
    rows += [(6, "lo rem " * 30_000), (None, "q\x0bq\x0cq\rq q q q q q")]
    docs = spark.createDataFrame([(*r, 1, "r", "w") for r in rows], "doc_id long, text string, n_runs int, runs string, words string")
    found = periodic.periodic_runs(docs, fold=fold)
    got = [tuple(r) for r in periodic.digested(found).collect()]
    if fold:
        assert sorted(map(str, got)) == sorted([str(contract(*r)) for r in rows if r[0] != 6] + [str(r) for r in got if r[0] == 6])
    assert len(got) == len(rows)
    runs = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in found.collect()}
    if not fold:
        assert runs[3, "x"] == [(0, 9, 1)] and runs[6, "lo rem"] == [(0, 60_000, 2)] and runs[1, ""] == []
    assert periodic.digested(periodic.periodic_runs(docs.limit(0), fold=fold)).count() == 0
