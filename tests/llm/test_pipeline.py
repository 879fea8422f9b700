"""The whole chain against the same five steps in plain Python."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm import quality, queries
from ledgerloom.llm.decontaminate import Q, Budget, normal

from . import brute

FOLDER = "/root/testdata/sf0.001"


def rejected(net, text):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, quality.logit(net, (text or "").encode()))))) < quality.CUTOFF


def leaks(text, items):
    """Whether some window of an item is within its edits of a part of the text, by all windows' edit distances."""
    text = normal(text)
    for item in items:
        budget = Budget.of(len(item), 60, 1 / 15, Q)
        # a window within its edits shares a piece of a (edits+1)-th of it
        if budget is None:
            continue
        for a in range(0, len(item) - budget.window + 1):
            window = item[a : a + budget.window]
            step = len(window) // (budget.edits + 1)
            if any(window[k * step : (k + 1) * step] in text for k in range(budget.edits + 1)) and brute.edits_in(window, text) <= budget.edits:
                return True
    return False


def mixed(rows):
    """Documents as often as the mix takes them, by the contract's rounds and the seeded order."""
    sizes, members = defaultdict(int), defaultdict(list)
    for i, t, s in rows:
        n = len(brute.words(t))
        sizes[s] += n
        members[s].append((hashlib.md5("|".join(["17", str(i), s or "", str(n)]).encode()).hexdigest(), i, n))
    targets, out = brute.mix_targets(sizes), Counter()
    for s, found in members.items():
        whole = int(targets[s] // sizes[s]) if sizes[s] else 0
        rest, upto = targets[s] - whole * sizes[s], 0
        for _, i, n in sorted(found):
            upto += n
            out[i] += whole + (rest > 0 and upto - n / 2 <= rest)
    return +out


@pytest.fixture(scope="module")
def chain(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "source").collect()]
    documents, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    net = quality.unpacked(quality.train(quality.sampled(documents, labels, queries.fold(5) != 0)))
    items = [normal(r[0]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("text").collect()]
    good = [d for d in docs if not rejected(net, d[1])]
    component = {i: c for i, _, c in brute.near_duplicates([d[:2] for d in good])}
    firsts = [d for d in good if component[d[0]] == d[0]]
    clean = [d for d in firsts if not leaks(d[1], items)]
    return docs, good, firsts, clean, mixed(clean)


def test_run(spark, chain):
    docs, good, firsts, clean, times = chain
    assert len(docs) > len(good) > len(firsts) > len(clean) > 0
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter(r.doc_id for r in rows) == times
    text = {i: (t or "").encode() for i, t, _ in docs}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id])) for r in rows)
    alone = {r.doc_id: (r.shard, r.grown_shard) for r in queries.QUERIES["op10_sharding"](spark, FOLDER).collect()}
    assert all((r.shard, r.grown_shard) == alone[r.doc_id] and r.law == "key" for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_each_stage_on_what_the_one_before_kept(spark, chain):
    """Stage by stage, as the driver runs them, with written tables between."""
    _, good, firsts, clean, times = chain
    kept = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = kept.columns
    for (_, stage), want in zip(corpus_pipeline.STAGES[:4], (good, firsts, clean, None), strict=True):
        kept = stage(spark, kept, FOLDER)
        assert kept.columns == columns
        got = Counter(r[0] for r in kept.select("doc_id").collect())
        assert got == (times if want is None else Counter(d[0] for d in want))


def test_digest_against_a_plain_count():
    """Fingerprints from triplets counted one by one."""
    from ledgerloom.llm import digest

    rng = np.random.default_rng(3)
    for size in (0, 1, 2, 3, 5, 40, 3000):
        text = "".join(chr(c) for c in rng.choice([97, 98, 99, 32, 233, 0x4E2D], size))
        data, counts = text.encode(), [0] * 256
        for i in range(len(data)):
            kind = 0
            for j in range(1, 5):
                for k in range(j + 1, 5):
                    if i + k < len(data):
                        code = data[i] | data[i + j] << 8 | data[i + k] << 16 | kind << 24
                        counts[(code * 0x9E3779B1 % 2**32) >> 24] += 1
                    kind += 1
        ordered = sorted(counts)
        cut = [ordered[63], ordered[127], ordered[191]]
        quartile = [sum(c > q for q in cut) for c in counts]
        packed = bytes(sum(quartile[4 * b + s] << 2 * s for s in range(4)) for b in range(64))
        length = min(255, round(math.log(len(data) + 1) / math.log(1.1)))
        assert digest.digest(text) == f"{length:02x}{packed.hex()}"
        other = digest.digest(text + "more")
        steps = sum(abs(a - b) for a, b in zip(quartile, [other_q for byte in bytes.fromhex(other[2:]) for other_q in (byte & 3, byte >> 2 & 3, byte >> 4 & 3, byte >> 6)], strict=True))
        assert digest.difference(digest.digest(text), other) == steps + min(40, abs(length - int(other[:2], 16)))
