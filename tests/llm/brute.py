"""Plain Python versions of what the queries must return, from the contracts alone."""

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def simhash(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(docs):
    """(doc_id, fingerprint, component_id) by all pairs of fingerprints."""
    fps = [simhash(t) for _, t in docs]
    distinct = sorted(set(fps))
    up = {f: f for f in distinct}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                up[root(b)] = root(a)
    first = {}
    for (i, _), f in zip(docs, fps, strict=True):
        if i is not None:
            first[root(f)] = min(i, first.get(root(f), i))
    return [(i, f"{f:016x}", first.get(root(f))) for (i, _), f in zip(docs, fps, strict=True)]


def find(pattern, text, good=lambda m: True):
    return [(m.start(), m.end()) for m in re.finditer(pattern, text) if good(m)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secrets(text):
    text = text or ""
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [
        ("assign", find(assign, text, lambda m: len(m[1]) >= 8)),
        ("access", find("AKIA[A-Z0-9]+", text, lambda m: len(m[0]) >= 16)),
        ("hex", find("[0-9a-f]+", text, lambda m: len(m[0]) >= 32)),
    ]
    spans = sorted((a, n, b, k) for n, (k, s) in enumerate(found) for a, b in s)
    return (*(len(s) for _, s in found), sha(joined((k, a, b) for a, _, b, k in spans)))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [
        ("email", find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)),
        ("ip", find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text, lambda m: all(int(p) <= 255 for p in m[0].split(".")))),
        ("card", find(r"[0-9]([\x20-]?[0-9])+", text, lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)))),
        ("phone", find(r"\+[0-9][\x20().0-9-]+[0-9]", text, lambda m: 9 <= len(digits(m)) <= 15)),
    ]
    return (*(len(s) for _, s in found), sha(joined((k, a, b) for k, s in found for a, b in s)))


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def line_dedup(docs):
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders[line_key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            k = line_key(line)
            known = [h for h in holders[k] if h is not None]
            owner = min(known) if known else None
            if not (len(k) >= 10 and len(holders[k]) > 1 and i != owner):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def mix_targets(sizes):
    """Source to target by the contract's own rounds."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be"))
    names += [None] * (None in sizes)
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    target, open_, rest = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / total for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        open_ -= above
    return target


def edits_in(window, text):
    """Least edits between a window and any part of a text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def crc(i, parts):
    return zlib.crc32(str(i).encode()) % parts
