"""The registered queries over the smallest tables against plain Python."""

import hashlib
import json
import zlib
from collections import defaultdict
from statistics import mean

import pytest

from ledgerloom.llm import queries
from . import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "source").collect()
    return sorted((r[0], r[1], r[2]) for r in rows)


@pytest.fixture(scope="module")
def result(spark):
    kept = {}

    def get(name):
        if name not in kept:
            kept[name] = queries.QUERIES[name](spark, FOLDER).collect()
        return kept[name]

    return get


def test_near_duplicates(docs, result):
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in result("op1_simhash_near_duplicates"))
    assert got == sorted(brute.near_duplicates([d[:2] for d in docs]))


def test_decontamination(spark, docs, result):
    from ledgerloom.llm.decontaminate import Q, Budget, normal

    items = [(r[0], normal(r[1])) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in result("op2_benchmark_decontamination")}
    want = {(i, item) for i, t, _ in docs for item, text in items if text in normal(t)}
    assert want and want <= got
    for i, item in got - want:  # a part of an item, or a part with edits
        text, whole = normal(docs[i][1]), dict(items)[item]
        b = Budget.of(len(whole), 60, 1 / 15, Q)
        assert any(brute.edits_in(whole[a : a + b.window], text) <= b.edits for a in range(len(whole) - b.window + 1))


def test_secrets(docs, result):
    got = sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in result("op3_secrets"))
    assert got == [(i, *brute.secrets(t)) for i, t, _ in docs]


def test_mixing(docs, result):
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(brute.words(t))
    want = brute.mix_targets(sizes)
    source = {i: s for i, _, s in docs}
    rows = result("op4_mixing")
    assert sorted(r.doc_id for r in rows) == sorted(source)
    largest = defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert r.size == len(brute.words(docs[r.doc_id][1])) and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s], rel=1e-9)
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1


def test_toxicity(spark, docs, result):
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic").collect()}
    rows = result("op5_toxicity")
    assert sorted(r.doc_id for r in rows) == [d[0] for d in docs]
    assert all(r.held_out == (brute.crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert set(labels.values()) <= {0, 1, None}


def test_fingerprints(docs, result):
    from ledgerloom.llm.digest import digest, edited, likeness

    order = sorted(docs, reverse=True)
    got = {r.doc_id: r for r in result("op6_document_fingerprints")}
    assert len(got) == len(docs)
    for (i, t, _), (_, after, _) in zip(order, [*order[1:], order[0]], strict=True):
        r, mixed = got[i], edited(t, after)
        assert r.n_chars == len(t)
        assert mixed == t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert r.edited_sha256 == hashlib.sha256(mixed.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (digest(t), digest(mixed))
        assert r.near_edited == likeness(digest(t), digest(mixed)) and r.near_next == likeness(digest(t), digest(after))
    assert mean(r.near_edited for r in got.values()) > 0.2 + mean(r.near_next for r in got.values())


def test_line_dedup(docs, result):
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in result("op7_line_dedup"))
    assert got == brute.line_dedup([d[:2] for d in docs])
    assert sum(r[2] for r in got)


def test_pii(docs, result):
    rows = result("op8_personal_data")
    got = sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows)
    assert got == [(i, *brute.pii(t)) for i, t, _ in docs]
    assert all(sum(r[n] for r in got) for n in (1, 2, 3, 4))


def test_quality(docs, result):
    rows = result("op9_quality")
    assert sorted(r.doc_id for r in rows) == [d[0] for d in docs]
    assert all(r.held_out == (brute.crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_sharding(docs, result):
    rows = result("op10_sharding")
    text = {i: t for i, t, _ in docs}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    slots = defaultdict(list)
    for r in rows:
        data = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        assert r.law == "key" and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert any(r.grown_shard == 16 for r in rows)


def test_rerun_is_equal(spark, result):
    for name in ("op4_mixing", "op10_sharding"):
        again = queries.QUERIES[name](spark, FOLDER).collect()
        assert sorted(map(str, again)) == sorted(map(str, result(name)))


def test_oracle_names():
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    assert json.dumps(sorted(queries.QUERIES))


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_sql_gives_the_same_rows(result, name):
    from checks.harness import compare, duck

    con = duck(FOLDER)
    con.execute(queries.ORACLE[name])
    rows = result(name)
    assert compare(rows[0].__fields__, rows, [d[0] for d in con.description], con.fetchall()) is None
