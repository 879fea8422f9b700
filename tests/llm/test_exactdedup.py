"""The cuckoo filter, the index over batches, deletions and sessions, and exact deduplication against plain Python."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from ledgerloom.llm import exactdedup
from ledgerloom.llm.exactdedup import CuckooFilter, DigestIndex


def hashes(seed, count):
    return np.random.default_rng(seed).integers(0, 2**64, count, dtype=np.uint64)


@pytest.mark.parametrize("count", [0, 1, 7, 1000, 60_000])
def test_filter_holds_all_and_lets_go(count):
    keys = hashes(1, count)
    made = CuckooFilter.of(keys)
    assert made.may_hold(keys).all() and (made.cells != 0).sum() == count
    assert made.may_hold(hashes(2, 50_000)).mean() < 0.001
    made.delete(keys[: count // 2])
    assert made.may_hold(keys[count // 2 :]).all() and (made.cells != 0).sum() == count - count // 2
    again = CuckooFilter(made.buckets, made.cells.tobytes())
    assert again.insert(keys[: count // 2]) and again.may_hold(keys).all()


def test_filter_overflow_and_repeated_fingerprints():
    small = CuckooFilter(64)
    assert not small.insert(hashes(3, 300))
    assert CuckooFilter.of(hashes(3, 300)).buckets == 128
    same = np.full(8, hashes(4, 1)[0])
    made = CuckooFilter(64)
    assert made.insert(same) and not CuckooFilter(64).insert(np.full(9, same[0]))
    made.delete(same[:7])
    assert made.may_hold(same).all()
    made.delete(same[:1])
    assert not made.may_hold(same).any()
    with pytest.raises(ValueError):
        made.delete(same[:1])


def digests(spark, numbers, size=1):
    rows = [(hashlib.sha256(str(n).encode()).digest(), n, size) for n in numbers]
    return spark.createDataFrame(rows, "digest binary, owner long, size long")


def state(index):
    return {(r.owner, r.size) for r in index.groups().collect()}


def test_index_inserts_deletes_resizes_and_opens_again(spark):
    index = DigestIndex.create(spark, buckets=1)  # four cells a part: nearly every batch overflows
    known = {r.digest: r.known for r in index.insert(digests(spark, range(900))).collect()}
    assert len(known) == 900 and not any(known.values())
    assert sum(r.known for r in index.insert(digests(spark, range(800, 1500))).collect()) == 100
    want = {(n, 2 if 800 <= n < 900 else 1) for n in range(1500)}
    assert state(index) == want
    sizes = [r.buckets for r in index._filters().collect()]
    assert len(sizes) == index.parts and max(sizes) > 1 and not any(r.overflow for r in index._filters().collect())

    gone = index.delete(digests(spark, [5, 850, 1499, 99_999]).select("digest"))
    assert gone.count() == 3
    assert state(index) == {(n, s) for n, s in want if n not in (5, 850, 1499)}
    index = DigestIndex.open(spark, index.path)  # another session
    assert sum(r.known for r in index.insert(digests(spark, [5, 6, 2000])).collect()) == 1
    assert state(index) == {(n, s + (n == 6)) for n, s in want if n not in (5, 850, 1499)} | {(5, 1), (2000, 1)}
    assert index.delete(digests(spark, [5, 850]).select("digest")).count() == 1
    assert index.insert(digests(spark, []).limit(0)).count() == 0


def test_false_hits_are_verified(spark):
    """A filter of one bucket a part with 16-bit marks holds the marks of other digests too: made here by hand."""
    index = DigestIndex.create(spark)
    a = bytes(6) + b"\x11\x22" + b"a" * 24
    others = [bytes([n]) + bytes(5) + b"\x11\x22" + b"b" * 24 for n in range(1, 200)]
    index.insert(spark.createDataFrame([(a, 1, 1)], "digest binary, owner long, size long"))
    found = index.insert(spark.createDataFrame([(d, 2, 1) for d in others] + [(a, 3, 1)], "digest binary, owner long, size long"))
    assert [r.digest for r in found.filter("known").collect()] == [a]
    assert index.groups().count() == 200


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), n == 0, sha) for n, i in enumerate(ids)]
    return sorted(map(str, out))


def test_dedup_edges(spark):
    rows = [(i, f"text {i % 7}") for i in range(60)] + [(i, "hot  text\n") for i in range(100, 200)]
    rows += [(None, None), (None, ""), (None, "only here"), (None, "only here"), (None, "hot text "), (5, "text 5"), (5, "text 5"), (7, "seven")]
    rows += [(300, " a"), (301, "a"), (302, "a \x0b"), (303, "a\t"), (304, "é" * 60_000), (299, "é" * 60_000), (305, "x\n" * 50_000), (306, "x " * 50_000)]
    docs = spark.createDataFrame([(*r, 1, "d", b"k") for r in rows], "doc_id long, text string, size long, owner string, digest binary")
    for batches, buckets in ((1, 0), (3, 1)):
        got = [str(tuple(r)) for r in exactdedup.dedup_exact(docs, batches, buckets=buckets).collect()]
        assert sorted(got) == brute(rows)
    assert exactdedup.dedup_exact(docs.limit(0)).count() == 0
