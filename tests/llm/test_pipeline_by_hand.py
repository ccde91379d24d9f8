"""The pipeline over all of sf0.001, each stage's rows rebuilt in plain Python from its predecessor's."""

import hashlib
import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from quire.llm import byte_cnn_lang, token_store

SF = "/root/testdata/sf0.001"
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def places(text):
    data = (text or "").encode().translate(FOLD)
    return [(m.start(), m.end(), m[0]) for m in WORD.finditer(data)]


def probabilities(model, text):
    """The network's forward pass, one window, filter and offset after the other."""
    net, data, length = model["net"], text.encode(), model["length"]
    cuts = range(0, len(data), length)
    total = np.zeros(len(model["langs"]))
    for a in cuts:
        start = max(0, min(a, len(data) - length))
        window = data[start : start + length]
        rows = [*window, *[0] * (length - len(window) + 3)]
        embedded = net.p["embed"][rows]
        pooled = []
        for filter_no in range(48):
            width = (2, 3, 4)[filter_no // 16]
            weights = [net.p[f"w{k}"][:, filter_no - [0, 0, 16, 32][k]] for k in range(width)]
            pooled.append(max(sum(float(embedded[i + k] @ weights[k]) for k in range(width)) for i in range(length)))
        hidden = np.maximum(np.array(pooled) + net.p["bias"], 0)
        z = hidden @ net.p["out"] + net.p["out_bias"]
        z = np.exp(z - z.max())
        total += z / z.sum()
    return total / len(cuts)


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = byte_cnn_lang.fit(docs)
    kept = {r.doc_id: r for r in byte_cnn_lang.accepted(docs, model, least=0.3).collect()}
    rows = docs.collect()
    checked = 0
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        if not letters:
            assert r.doc_id not in kept
        elif len(r.text) < 500 and checked < 12:
            checked += 1
            p = probabilities(model, r.text)
            assert (r.doc_id in kept) == (p.max() >= 0.3)
            assert kept[r.doc_id].lang == model["langs"][int(p.argmax())]
    assert checked == 12 and {r.doc_id for r in rows} >= set(kept)


def near_copies(rows):
    """doc_ids that stay: the least of each component of texts with a Jaccard similarity of 0.8 or more."""
    sets, where = {}, {}
    for r in rows:
        w = [x for *_, x in places(r.text)]
        n = min(5, len(w))
        sets[r.doc_id] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
        for s in sets[r.doc_id]:
            where.setdefault(s, []).append(r.doc_id)
    shared = Counter((a, b) for some in where.values() for i, b in enumerate(some) for a in some[:i])
    parent = {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for (a, b), k in shared.items():
        if 9 * k >= 4 * (len(sets[a]) + len(sets[b])):
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    return {top(d) for d in sets}


def cut(text, items):
    """The text without its hit words, None if half of them or more are hit."""
    found = places(text)
    words = [w for *_, w in found]
    hit = [False] * len(words)
    for item in items:
        n = min(10, len(item))
        grams = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if n else set()
        for k in range(len(words) - n + 1) if grams else ():
            if tuple(words[k : k + n]) in grams:
                hit[k : k + n] = [True] * n
    if not any(hit):
        return text
    if sum(hit) >= 0.5 * len(hit):
        return None
    data, out, at = text.encode(), [], 0
    for k, h in enumerate(hit):
        if h and (k == 0 or not hit[k - 1]):
            out.append(data[at : found[k][0]])
        if h:
            at = found[k][1]
    return b"".join([*out, data[at:]]).decode()


def mixture(rows):
    """(time, doc_id) of every use of a document, by the targets, schedules and hash order of the sources."""
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    amount = {s: sum(size[r.doc_id] for r in rows if r.source == s) for s in sources}
    weight, slope = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}, {s: 0.5 * (k % 3 - 1) for k, s in enumerate(sources)}
    target, free = {}, set(sources)
    while True:
        level = (sum(amount.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * amount[s]}
        if not over:
            break
        target |= {s: 3 * amount[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    out = []
    for s in sources:
        own = sorted((r.doc_id for r in rows if r.source == s), key=lambda d: hashlib.md5(str(d).encode()).hexdigest())
        ratio = target[s] / amount[s]
        extra = round((ratio - math.floor(ratio + 1e-12)) * amount[s])
        before = 0
        for d in own:
            taken = math.floor(ratio + 1e-12) * size[d] + max(0, min(extra - before, size[d]))
            for k in range(math.floor(taken / size[d] + 0.5) if size[d] else 0):
                t, c = min(1.0, before / target[s] + k * amount[s] / target[s]), slope[s]
                out.append(((t if c == 0 else (c - 1 + math.sqrt((1 - c) ** 2 + 4 * c * t)) / (2 * c)), d))
            before += size[d]
    return sorted(out)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        out[name] = docs.collect()
    return out


def test_near_copies(stages):
    assert {r.doc_id for r in stages["near_copies"]} == near_copies(stages["language"]) and len(stages["near_copies"]) < len(stages["language"])


def test_benchmark(spark, stages):
    items = [[w for *_, w in places(r.text)] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r.doc_id: t for r in stages["near_copies"] if (t := cut(r.text, items)) is not None}
    assert {r.doc_id: r.text for r in stages["benchmark"]} == want
    assert any(r.text != want.get(r.doc_id) for r in stages["near_copies"])
    assert all(r.n_chars == len(r.text) for r in stages["benchmark"])


def test_mixture(stages):
    want = mixture(stages["benchmark"])
    assert Counter(r.doc_id for r in stages["mixture"]) == Counter(d for _, d in want)
    time = {}
    for t, d in want:
        time.setdefault(d, []).append(t)
    seen = Counter()
    order = []
    for r in stages["mixture"]:
        order.append(time[r.doc_id][seen[r.doc_id]])
        seen[r.doc_id] += 1
    assert len(order) > 100 and all(b >= a - 1e-6 for a, b in zip(order, order[1:], strict=False))


def test_tokens(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_store.default_tokenizer())
    rows = sorted(stages["mixture"], key=lambda r: (r.doc_id, r.text))
    want, start = [], 0
    for r in rows:
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in stages["tokens"]) == sorted(want)


def test_run_equals_stages(spark, stages):
    found = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, stages["tokens"]))
