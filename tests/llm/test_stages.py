"""Every pipeline stage on nulls, empty and long texts, ties, repeated rows, an empty table and columns with clashing names."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from quire.llm import chosen_path_join, curriculum_mix, rare_digest, shared, toxicity_ordinal
from quire.llm.curriculum_mix import targets

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, part int, bucket string, payload string, size string, hit string, text_sha256 string, own_doc_id long, n string, row string, key string"
STAGES = dict(corpus_pipeline.STAGES)


def odd_rows(spark):
    known = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null and length(text) > 200").orderBy("doc_id").limit(60).collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 60").orderBy("item_id").first().text
    more = lambda k: (k, k % 3, f"b{k}", "p", "s", "h", "t", k, "n", "r", "k")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, *more(i)) for i, r in enumerate(known)]
    rows += [(2000, None, None, None, None, *more(1)), (2001, "", "en", "a", 0, *more(2)), (2002, " \n", None, "a", 2, *more(3)), (2003, "123 ½ ²!", "en", None, 8, *more(4)), (None, known[0].text + " tail", None, None, 1, *more(5))]
    rows += [rows[3], rows[3], (2004, " ".join(r.text for r in known) * 4, None, "long", 1, *more(6)), (2005, f"{known[1].text} {item} {known[2].text}", None, "a", 1, *more(7)), (2006, item, None, "a", 1, *more(8))]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(spark), SCHEMA).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, odd, name):
    found = STAGES[name](spark, odd, SF)
    if name == "tokens":
        assert found.count() == odd.count()
    else:
        assert found.columns == odd.columns and dict(found.dtypes) == dict(odd.dtypes)
        assert found.count() > 20
    rows = found.collect()
    ids = [r.doc_id for r in rows]
    if name == "language":
        assert not {2000, 2001, 2002, 2003} & set(ids) and {2004, 2005, None} <= set(ids) and all(r.lang in ("de", "en", "es", "fr") for r in rows)
    if name == "near_copies":
        assert len({(r.doc_id, r.text) for r in rows}) == len(rows) and {2000, 2004} <= set(ids) and None not in ids
    if name == "benchmark":
        by = {r.doc_id: r for r in rows}
        item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 60").orderBy("item_id").first().text
        assert 2006 not in ids and item not in by[2005].text and len(by[2005].text) > 300 and by[2000].text is None and by[2005].n_chars == len(by[2005].text)
    if name == "mixture":
        assert 2000 not in ids and 2002 not in ids and all(r.text.strip() for r in rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, odd, name):
    assert STAGES[name](spark, odd.limit(0), SF).count() == 0


def test_unlabelled_corpus_is_kept(spark, odd):
    found = STAGES["language"](spark, odd.withColumn("lang", F.lit(None).cast("string")), SF).collect()
    assert {r.doc_id for r in found} == {r.doc_id for r in odd.collect()} - {2000, 2001, 2002, 2003} and all(r.lang is None for r in found)


def test_letters_are_letters(spark):
    from quire.llm import byte_cnn_lang

    rows = [(k, t, "en") for k, t in enumerate(["½ ² ①", "Ⅷ", "٣", "_", "é", "字", "ʰ", "x" * 3000] + ["the and of"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in byte_cnn_lang.identified(docs, byte_cnn_lang.fit(docs)).collect()}
    assert [found[k] for k in range(8)] == ["und"] * 4 + ["en"] * 4


def test_sample_is_bounded(spark):
    """However often an id repeats and however long a text is, the sample has its bounds."""
    from quire.llm import byte_cnn_lang

    same = [(1, f"the same id {k}", "en") for k in range(4000)] + [(2, "a long text " * 40_000, "de")]
    seen = []
    before, byte_cnn_lang.trained = byte_cnn_lang.trained, lambda x, langs, length: seen.append((len(x), langs)) or before(x, langs, length, epochs=1)
    try:
        byte_cnn_lang.fit(spark.createDataFrame(same, "doc_id long, text string, lang string").repartition(4), per_lang=50, doc_windows=7)
    finally:
        byte_cnn_lang.trained = before
    (n, langs), = seen
    assert langs.count("en") == 50 and langs.count("de") == 7 and n == 57


def test_toxicity_sample_and_repeats(spark):
    docs = spark.createDataFrame([(k % 40, f"text {k} " + ("vile " * (k % 3)) + "w " * (200_000 if k == 7 else 5)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k in range(40) for y in ((0, 1) if k % 3 == 2 else (0, 0))], "doc_id long, toxic int")
    seen = []
    before, toxicity_ordinal.fitted = toxicity_ordinal.fitted, lambda texts, y: seen.append((texts, y))
    try:
        toxicity_ordinal.fit(docs, labels, most_chars=1000)
    finally:
        toxicity_ordinal.fitted = before
    (texts, y), = seen
    assert len(texts) == 40 and max(map(len, texts)) <= 1000 and sum(y) == 13


def test_toxicity_scores_by_hand(spark):
    """Severity recomputed word by word from the model's weights."""
    import re

    from quire.llm.words import FOLDED, Words, mix, powers
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = [(k, " ".join([*rng.choice([f"w{i}" for i in range(80)], 40), *rng.choice(["badword", "vileword"], k % 4 == 0 and 3 or 0)]), int(k % 4 == 0)) for k in range(400)]
    model = toxicity_ordinal.fitted([t for _, t, _ in rows], [y for *_, y in rows])

    def feature(word):
        out = [int(Words(pa.array([word]), FOLDED).hashes()[0])]
        if len(word) > 5:
            head = word.encode()[:5]
            up, _ = powers(16)
            with np.errstate(over="ignore"):
                total = np.add.reduce((np.frombuffer(head, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:5], dtype=np.uint64)
                out.append(int(mix(np.array([total ^ np.uint64(0x5DEECE66D)]))[0]))
        return out

    weights = dict(zip(model["features"].tolist(), model["w"].tolist(), strict=True))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900, None)], "doc_id long, text string")
    for r in toxicity_ordinal.graded(docs, model).collect():
        counts = {}
        for word in re.findall(r"[a-z0-9]+", rows[r.doc_id][1] if r.doc_id < 900 else ""):
            for f in feature(word):
                counts[f] = counts.get(f, 0) + 1
        score = sum((1 + np.log(n)) * weights[f] for f, n in counts.items() if f in weights)
        assert r.severity == pytest.approx(sum(1 / (1 + np.exp(t - score)) for t in model["theta"]))
        assert 0 <= r.grade <= 3 and r.toxic == (r.p_toxic >= 0.5)


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(6)
    sizes = {(None if k == 0 else f"site{k:04d}"): int(n) for k, n in enumerate(rng.choice([0, 1, 5, 5, 5, 40, 1000, 1000, 250_000], 700))}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, free = {}, set(order)
    while True:
        level = (sum(sizes.values()) - sum(want.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        want |= {s: 3 * sizes[s] for s in over}
        free -= over
    want |= {s: level * weight[s] for s in free}
    for parts in (5, 64):
        found = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(4), parts=parts).collect()
        assert len(found) == 700 and all(r.target == pytest.approx(want[r.source]) and r.weight == weight[r.source] for r in found)


def brute_links(texts, num=4, den=5):
    """Links between different texts and classes, by comparing all sets that share a shingle."""
    import re

    fold = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets, where = {}, {}
    for t in set(texts):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(fold))
        n = min(5, len(w))
        sets[t] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
        for s in sets[t]:
            where.setdefault(s, []).append(t)
    shared = {}
    for some in where.values():
        for i, a in enumerate(some):
            for b in some[:i]:
                pair = (a, b) if a < b else (b, a)
                shared[pair] = shared.get(pair, 0) + 1
    return {p for p, k in shared.items() if k * (num + den) >= num * (len(sets[p[0]]) + len(sets[p[1]]))}


def measured_recall(rows, found):
    """Links found, of those that brute force finds; no other may be found. rows: doc_id, text; found: n_links by doc_id."""
    want = brute_links([t for _, t in rows])
    counts = {}
    for a, b in want:
        counts[a], counts[b] = counts.get(a, 0) + 1, counts.get(b, 0) + 1
    assert all(found[d] <= counts.get(t, 0) for d, t in rows)
    return sum({t: found[d] for d, t in rows}.values()) / max(1, 2 * len(want)), len(want)


def test_recall_at_default_settings(spark):
    """All pairs of sf0.01, and planted pairs just above the threshold, at the production recall."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").fillna("", ["text"])
    recall, n = measured_recall([tuple(r) for r in docs.collect()], {r.doc_id: r.n_links for r in chosen_path_join.classes(docs).collect()})
    assert recall == 1 and n >= 5
    rng = np.random.default_rng(12)
    planted = []
    for _ in range(1500):
        words = [f"w{k}" for k in rng.integers(0, 5000, 56)]
        planted += [" ".join(words), " ".join([*words[:20], "other", *words[21:]])]  # 47 of 57 shingles are shared: 0.825
    docs = spark.createDataFrame(list(enumerate(planted)), "doc_id long, text string")
    recall, n = measured_recall(list(enumerate(planted)), {r.doc_id: r.n_links for r in chosen_path_join.classes(docs).collect()})
    assert n == 1500 and recall >= 0.999


def test_header_groups_are_split(spark, monkeypatch):
    """Texts that share a header but are far apart leave the large bucket; near ones are still found."""
    rng = np.random.default_rng(2)
    header = " ".join(f"h{k}" for k in range(40))
    texts = [f"{header} " + " ".join(map(str, rng.integers(0, 10**6, 160))) for _ in range(300)]
    near = [t.rsplit(" ", 1)[0] + f" z{k}" for k, t in enumerate(texts[:60])]
    docs = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    sent = []
    before = chosen_path_join._members
    monkeypatch.setattr(chosen_path_join, "_members", lambda *a: sent.append(before(*a)) or sent[-1])
    found = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path_join.classes(docs, small=64, recall=1 - 1e-9).collect()}
    assert all(found[300 + k] == (k, 1) and found[k] == (k, 1) for k in range(60)) and all(found[k] == (k, 0) for k in range(60, 300))
    sizes = [r["size"] for r in sent[0].select(F.explode("buckets").alias("b")).select("b.*").distinct().collect()]
    assert sizes and sum(n > 64 for n in sizes) <= 0.2 * len(sizes)


def test_shared_folder_is_asked_for_on_clusters(spark, monkeypatch):
    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "_jsc": type("J", (), {"sc": staticmethod(lambda: type("X", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))})})

    with pytest.raises(RuntimeError):
        shared.shared_dir(Fake)


def test_stored_tables_are_cleared(spark):
    import os

    a, b = shared.stored(spark.range(10), "a"), shared.stored(spark.range(5), "b", narrow=True)
    at = [x.stored_at.removeprefix("file:").replace("//", "/") for x in (a, b)]
    assert a.count() == 10 and b.count() == 5 and all(map(os.path.exists, at))
    shared.forget(a)
    assert not os.path.exists(at[0]) and os.path.exists(at[1])
    shared.clear(spark)
    assert not os.path.exists(at[1])


def test_long_benchmark_items(spark):
    """Items longer than a piece, cut or not, give one result."""
    from quire.llm import decontaminate

    rng = np.random.default_rng(9)
    item = " ".join(map(str, rng.integers(0, 10**9, 40_000)))
    words = item.split()
    rows = [(1, "x " + " ".join(words[8185:8200]) + " y"), (2, " ".join(words[39_990:])), (3, " ".join(words[100:109])), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([("a", item), (None, "x y"), ("b", "")], "item_id string, text string")
    for size in (8 << 20, 100_000):
        found = sorted((r.doc_id, r.n_hit, r.n_items) for r in decontaminate.hits(docs, benchmark, slice_bytes=size).collect())
        assert found == [(1, 15, 1), (2, 10, 1), (3, 0, 0), (4, 0, 0)]


def test_digests_by_hand(spark):
    """Fingerprints of equal texts are equal; likeness is that of a plain count of shared features."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40)
    rows = rare_digest.fingerprints(docs).collect()
    by = {r.doc_id: r for r in rows}
    order = sorted(by, reverse=True)
    for k, d in enumerate(order):
        after = by[order[(k + 1) % len(order)]]
        assert 0 <= by[d].near_next <= 1 and 0 <= by[d].near_edited <= 1
        if by[d].fingerprint == after.fingerprint:
            assert by[d].near_next == 1
        if by[d].fingerprint == by[d].edited_fingerprint:
            assert by[d].near_edited == 1
