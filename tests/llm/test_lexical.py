"""Ranked search: sketches bound every score, and the ranks are those of scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import lexical, queries
from ledgerloom.llm.lexical import MaxSketchIndex

from . import brute

FOLDER = "/root/testdata/sf0.001"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(brute.LOWER))


def ranked(docs, items, top=10):
    """All documents against all items, from the contract alone."""
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, length = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, counts, n in held:
            total = 0
            for t, times in wanted.items():
                if counts[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 75 + (75 * n * n_docs) // length
                    total += times * w * ((1000000000 * counts[t]) // (1000 * counts[t] + 8 * m))
            if total > 0:
                scores.append((-total, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(map(str, out))


def found(index, docs, items, **more):
    return sorted(str(tuple(r)) for r in index.search(docs, items, **more).collect())


def test_terms():
    odd = "Ab1 c-D\x00e_f Ééß  x 中文,z{|}~\x7f\x80"
    assert [t.decode() for t in lexical.terms_of(odd.encode())] == terms(odd)


def test_bounds_are_never_below_scores():
    rng = random.Random(2)
    words = [f"w{n}".encode() for n in range(400)]
    rows = [(q, rng.choice(words), rng.randrange(1, 4), rng.randrange(0, 9000)) for q in range(20) for _ in range(30)]
    rows = list({r[:2]: r for r in rows}.values())
    block = lexical.Block(rows, documents=1000, length=90_000)
    tight = []
    for _ in range(200):
        counts = Counter(rng.choices(words, k=rng.choice([1, 30, 300, 3000])))
        if rng.random() < 0.2:
            counts[words[0]] += 700
        n = counts.total()
        cells, made = lexical.sketch(counts, {})
        bounds = block.bounds(cells, [made], np.array([n]))[:, 0]
        scores = np.array(block.score(counts, n, block.names))
        assert (bounds >= scores).all()
        tight.append(scores.sum() / bounds.sum())
    assert np.mean(tight) > 0.7


def test_query(spark):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{name}.parquet").select(*c).collect()]
    rows = queries.QUERIES["op12_ranked_search"](spark, FOLDER).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(str(tuple(r)) for r in rows) == ranked(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    vocabulary = [f"t{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    rows = [(n, " ".join(rng.choices(vocabulary, k=rng.choice([3, 20, 90])))) for n in range(300)]
    rows += [(1000 + n, "rare passage of the hot group t5") for n in range(200)] + [(900, "rare"), (899, "Rare!"), (901, "rare"), (901, "rare")]
    rows += [(None, None), (None, "rare"), (None, "rare"), (-5, "rare"), (-(1 << 62) - 1, "rare"), (2000, ""), (2001, " .,\n"), (2002, "rare " * 400 + "zq " * 300), (2003, "é中 É " * 40_000)]
    items = [(1, "Rare"), (2, "rare passage hot"), (3, rows[7][1]), (4, " ".join(rng.choices(vocabulary, k=200))), (5, "absent words"), (6, None), (7, ""), (8, "é zq zq")]
    items += [(9, "t1"), (9, "t2 rare"), (None, "中é é")]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, n long, key long, term string")
    asked = spark.createDataFrame([(*i, "d", 3, 1) for i in items], "item_id int, text string, doc_id string, rank int, score int")
    return rows, items, docs, asked


@pytest.mark.parametrize("top", [1, 10])
def test_edges(corpus, top):
    rows, items, docs, asked = corpus
    assert found(MaxSketchIndex.build(docs), docs, asked, top=top) == ranked(rows, items, top)


def test_few_seeds_and_small_blocks(spark, corpus, monkeypatch):
    """A weak threshold only means more rescoring; blocks of queries are searched one by one."""
    rows, items, docs, asked = corpus
    index = MaxSketchIndex.build(docs)
    monkeypatch.setattr(lexical, "SEEDS", 1)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 40)
    again = MaxSketchIndex(spark, index.path)  # another session opens it
    assert found(again, docs, asked, top=3) == ranked(rows, items, 3)


def test_empty(corpus):
    _, _, docs, asked = corpus
    assert MaxSketchIndex.build(docs.limit(0)).search(docs.limit(0), asked).count() == 0
    assert MaxSketchIndex.build(docs).search(docs, asked.limit(0)).count() == 0
