"""op7: fingerprints and likeness rebuilt in plain Python, one window after the other."""

import base64
import math
from collections import Counter

import pytest
from quire.llm import rare_digest
from quire.llm.words import BASE

SF = "/root/testdata/sf0.001"
M = (1 << 64) - 1


def mixed(h):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = ((h ^ (h >> 33)) * factor) & M
    return h ^ (h >> 33)


def hashed(piece):
    return mixed((sum((b + 1) * pow(BASE, i, 1 << 64) for i, b in enumerate(piece)) + len(piece)) & M)


def windows(data):
    """Starts of words, of the text, and of its last window; None for texts with long runs, which have further starts."""
    space = [b in b" \t\n\v\f\r" for b in data]
    starts = {k for k in range(len(data)) if not space[k] and (k == 0 or space[k - 1])} | ({0} if data else set())
    marks = [*sorted(starts), len(data)]
    if any(b - a > 64 for a, b in zip(marks, marks[1:], strict=False)):
        return None
    if len(data) >= 64:
        starts.add(len(data) - 64)
    return [k for k in sorted(starts) if k + 64 <= len(data)]


def level(piece):
    counts = Counter(b & 31 for b in piece).values()
    bits = math.log2(64) - sum(c * math.log2(c) for c in counts) / 64
    return min(max(round(bits / 5 * 127), 0), 127)


def features(data, starts, rank):
    pieces = [data[k : k + 64] for k in starts]
    votes = Counter()
    ranks = [rank[level(p)] for p in pieces]
    for k in range(len(pieces) - 7):
        votes[min(range(k, k + 8), key=lambda i: (ranks[i], i))] += 1
    for least in (2, 1, 0):
        chosen = [k for k in range(len(pieces)) if votes[k] >= least]
        if len({hashed(pieces[k]) for k in chosen}) >= 7:
            break
    found = list(dict.fromkeys(hashed(pieces[k]) for k in chosen)) if pieces else []
    return found or ([hashed(data)] if data else [])


def filters(found):
    out = []
    for a in range(0, len(found), 160):
        bits = {(h >> (11 * k)) & 2047 for h in found[a : a + 160] for k in range(5)}
        out.append(bits)
    return out


def encoded(some):
    return base64.b64encode(b"".join(bytes(sum(128 >> b for b in range(8) if 8 * byte + b in bits) for byte in range(256)) for bits in some)).decode()


def like(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    a, b = (b, a) if len(a) > len(b) else (a, b)
    best = []
    for x in a:
        scores = [(len(x & y) - len(x) * len(y) / 2048) / max(min(len(x), len(y)) - len(x) * len(y) / 2048, 1e-9) for y in b]
        best.append(min(max(max(scores), 0), 1) * len(x))
    return sum(best) / sum(map(len, a))


def test_fingerprints_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("length(text) < 6000")
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    data = {r.doc_id: (r.text or "").encode() for r in rows}
    every = {d: windows(x) for d, x in data.items()}
    histogram = rare_digest.histogram(docs)
    plain = [d for d, s in every.items() if s is not None]
    counts = Counter(level(data[d][k : k + 64]) for d in plain for k in every[d])
    assert len(plain) > 0.8 * len(rows) and all(histogram[n] >= c for n, c in counts.items())
    order = sorted(range(128), key=lambda n: (n < 32, histogram[n], n))
    rank = {n: i for i, n in enumerate(order)}
    made = {d: filters(features(data[d], every[d], rank)) for d in plain}
    found = {r.doc_id: r for r in rare_digest.fingerprints(docs, parts=3).collect()}
    for k, r in enumerate(rows):
        if r.doc_id not in made:
            continue
        assert found[r.doc_id].fingerprint == encoded(made[r.doc_id]), r.doc_id
        after = rows[(k + 1) % len(rows)].doc_id
        if after in made:
            assert found[r.doc_id].near_next == pytest.approx(like(made[r.doc_id], made[after]))
        own, other = r.text or "", rows[(k + 1) % len(rows)].text or ""
        edited = (own[: len(own) - len(own) // 2] + other[: len(own) // 2]).encode()
        if (starts := windows(edited)) is not None:
            assert found[r.doc_id].near_edited == pytest.approx(like(made[r.doc_id], filters(features(edited, starts, rank))))
