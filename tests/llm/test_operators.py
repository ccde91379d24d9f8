"""Each operator against brute force on a small fixture with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from quire.llm import byte_cnn_lang, chosen_path_join, curriculum_mix, decontaminate, html_consensus, license_scan, rans, rare_digest, substring_dedup, token_store, toxicity_ordinal
from quire.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, part int, bucket string, payload string, size string"


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    vocabulary = ["ab", "Cd", "é", "x9", "of", "the", "ström", "mit", "license", "y-z", "n0"]
    draw = lambda n: " ".join(rng.choice(vocabulary, n))
    shared, base = draw(40), draw(120)
    texts = [None, "", " \n\t", "a", "The MIT License", "mit license mit license", shared, f"x {shared} y", f"{draw(30)}\n{shared}", base, base, f"{base} tail", f"head {base}", draw(4000), shared + "\x00" + base, "!!!", "Ab, cd. " * 60, draw(5), draw(4), "x" * 5000]
    texts += [base.replace("of", w, 1) for w in ("q", "w", "e", "r", "t")]
    out = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, i, i, "b", "p", "s") for i, t in enumerate(texts)]
    return [*out, out[9], out[0], (None, base, "fr", "s0", 1, 0, 0, "b", "p", "s"), (3, "another text of doc three", "en", None, 2, 0, 0, "b", "p", "s")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def gathered(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=repr)


def test_license_scan(docs, rows, empty):
    phrases = {(b"mit", b"license"): "mit", (b"apache", b"license"): "apache", (b"general", b"public", b"license"): "gpl"}
    want = []
    for doc, text, *_ in rows:
        w = words(text)
        at = [(k, name) for p, name in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        places = [k for k, _ in at]
        want.append((doc, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({n for _, n in at}))))
    assert gathered(license_scan.license_scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    assert license_scan.license_scan(empty).count() == 0


@pytest.mark.parametrize(
    ("text", "rank", "families"),
    [("MIT", 1, {"mit"}), ("MIT OR GPL-2.0-only", 1, {"mit", "gpl"}), ("MIT and GPL-2.0-only", 3, {"mit", "gpl"}), ("GPL-2.0 WITH Classpath-exception-2.0", 2, {"gpl"}), ("(MIT OR Apache-2.0) AND LGPL-2.1", 2, {"mit", "apache", "lgpl"}), ("MIT OR Apache-2.0 AND GPL-3.0", 1, {"mit", "apache", "gpl"})],
)
def test_expressions(text, rank, families):
    assert license_scan.evaluate(license_scan.postfix(text)) == (rank, families)


@pytest.mark.parametrize("text", ["", "MIT OR", "(MIT", "MIT)", "AND MIT", "MIT GPL", "()"])
def test_malformed_expressions(text):
    assert license_scan.postfix(text) is None


def test_tag():
    found = license_scan.scan_text("// SPDX-License-Identifier: (MIT OR GPL-2.0) AND BSD-3-Clause\nx")
    assert found[5] == "bsd,gpl,mit" and found[6] == 1.0 and found[7] == 1 and found[8] == ["MIT GPL-2.0 or BSD-3-Clause and"]


@pytest.mark.parametrize("blocks", [1, 3, 300])
def test_substring_dedup(docs, rows, empty, blocks):
    first = {}
    own = [(math.inf if r[0] is None else r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    for doc, w in own:
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), math.inf), doc)
    want = []
    for doc, w in own:
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < doc for p in range(k, k + 13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want.append((None if doc == math.inf else doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert gathered(substring_dedup.substring_dedup(docs, blocks=blocks), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert substring_dedup.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("slice_bytes", [1 << 20, 60])
def test_decontaminate(spark, docs, rows, empty, slice_bytes):
    items = [("1", rows[6][1]), ("10", "ab cd"), ("2", rows[9][1][30:150]), ("3", None), ("4", ""), (None, "mit license"), ("2", "license mit")]
    benchmark = spark.createDataFrame([(*i, 7) for i in items], "item_id string, text string, doc_id int")
    want = []
    for doc, text, *_ in rows:
        w, hit, names = words(text), set(), set()
        for item, t in items:
            b = words(t)
            n = min(10, len(b))
            some = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
            at = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in some] if n else []
            hit |= {p for k in at for p in range(k, k + n)}
            names |= {item} if at and item else set()
        want.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    found = gathered(decontaminate.hits(docs, benchmark, slice_bytes=slice_bytes), *columns)
    assert found == sorted(want, key=repr)
    assert decontaminate.hits(empty, benchmark).count() == 0
    assert not decontaminate.hits(docs, benchmark.limit(0)).filter("contaminated").count()


def test_decontaminated_text(spark):
    benchmark = spark.createDataFrame([("1", "one two three four five six seven eight nine ten")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "A b c d e f g h i j k. One two, three four five six seven eight nine TEN! l"), (2, "one two three four five six seven eight nine ten"), (3, None)], "doc_id long, text string")
    assert gathered(decontaminate.decontaminate(docs, benchmark), "doc_id", "text") == [(1, "A b c d e f g h i j k. ! l"), (3, None)]


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 0])
def test_slices_do_not_change_results(spark, broadcast_bytes):
    w = [f"w{k}" for k in range(60)]
    items = [w[0:12], w[5:20], w[30:42], [*w[50:55], *w[20:25]], ["uno", "dos"]]
    benchmark = spark.createDataFrame([(str(k), " ".join(x)) for k, x in enumerate(items)], "item_id string, text string").coalesce(1)
    rest = [f"r{k}" for k in range(30)]
    texts = [
        [*rest, *w[0:20], *rest],  # two items overlap
        [*w[0:12], *rest[:16], *w[30:42]],  # 30 % by each of two items
        [*rest, *w[50:55], "uno", "dos", *w[20:25], *rest],  # neighbours only after a cut
        [*rest, *w[0:12]], [*w[30:42], *rest], [*w[30:42], *rest],  # different texts, and a repeated one, under one id
    ]
    ids = [0, 1, 2, 3, 3, 3]
    docs = spark.createDataFrame([(i, " ".join(t), k, "x", "y") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], "doc_id long, text string, n_chars long, hit string, text_sha256 string").coalesce(2)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items", "hit")
    hits, text = gathered(decontaminate.hits(docs, benchmark), *columns), gathered(decontaminate.decontaminate(docs, benchmark), *docs.columns)
    assert [r[2] for r in hits] == [20, 24, 2, 12, 12, 12] and [r[0] for r in text] == [0, 2, 3, 3, 3]
    sliced = {"slice_bytes": 80, "broadcast_bytes": broadcast_bytes, "salts": 3}
    assert len(decontaminate.slices(benchmark, 80)) == 3
    assert gathered(decontaminate.hits(docs, benchmark, **sliced), *columns) == hits
    found = decontaminate.decontaminate(docs, benchmark, **sliced)
    assert found.schema == docs.schema and gathered(found, *docs.columns) == text


def test_mixture(docs, rows, empty):
    found = curriculum_mix.mixture(docs, buckets=3).collect()
    assert len(found) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        rest = sum(sizes.values()) - sum(target.values())
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken = collections.Counter()
    by_id = collections.defaultdict(set)
    for r in rows:
        by_id[r[0]].add(r[3])
    for r in found:
        assert 0 <= r.taken <= 3 * r["size"]
        assert any(math.isclose(r.target, target[s]) and r.source_size == sizes[s] for s in by_id[r.doc_id])
    for r in curriculum_mix.placed(docs.select("doc_id", "source", curriculum_mix.size_of(docs.text).alias("size"))).collect():
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    again = curriculum_mix.mixture(docs.repartition(2), buckets=3)
    assert gathered(again, "doc_id", "size", "taken") == sorted([(r.doc_id, r["size"], r.taken) for r in found], key=repr)
    assert curriculum_mix.mixture(empty).count() == 0


def test_mixed(docs, rows):
    out = curriculum_mix.mixed(docs)
    assert out.columns == docs.columns
    assert out.filter("text is null").count() == 0 and out.count() > 0


def test_due_time_inverts_demand(spark):
    from pyspark.sql import functions as F

    t = spark.range(11).select((F.col("id") / 10).alias("t")).withColumn("s", F.lit(-0.4))
    back = t.select("t", curriculum_mix.due_time(F.col("t") + F.col("s") * (F.col("t") * F.col("t") - F.col("t")), F.col("s")).alias("b")).collect()
    assert all(math.isclose(r.t, r.b, abs_tol=1e-9) for r in back)


@pytest.mark.parametrize("small", [512, 2])
def test_chosen_path_join(docs, rows, empty, small):
    sets = []
    for r in rows:
        w = words(r[1])
        n = min(5, len(w))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset())
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [set() for _ in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
            parent[max(top(i), top(j))] = min(top(i), top(j))
            if (rows[i][1] or "") != (rows[j][1] or ""):
                links[i].add(rows[j][1])
                links[j].add(rows[i][1])
    key = lambda i: math.inf if rows[i][0] is None else rows[i][0]
    least = {top(i): min((key(j) for j in range(len(rows)) if top(j) == top(i))) for i in range(len(rows))}
    want = [(r[0], None if least[top(i)] == math.inf else least[top(i)], len(links[i]), len(sets[i])) for i, r in enumerate(rows)]
    assert gathered(chosen_path_join.classes(docs, small=small, recall=1 - 1e-9), "doc_id", "class_id", "n_links", "n_shingles") == sorted(want, key=repr)
    assert chosen_path_join.classes(empty).count() == 0
    kept = chosen_path_join.representatives(docs, recall=1 - 1e-9)
    assert kept.columns == docs.columns
    assert kept.count() == len({top(i) for i in range(len(rows)) if sets[i]} | {(rows[i][0], rows[i][1] or "") for i in range(len(rows)) if not sets[i]})


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200)]
    found = dict(gathered(components(spark.createDataFrame(chain, "a long, b long")), "a", "root"))
    assert found == dict.fromkeys(range(1, 41), 0) | dict.fromkeys(range(101, 130), 100)


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 200_000])
@pytest.mark.parametrize("k", [1, 3, 40_000])
def test_rans(n, k):
    ids = (np.random.default_rng(n).zipf(1.3, n) % k).astype(np.uint16)
    table = rans.Table(rans.scaled(np.bincount(ids, minlength=k)))
    blob = rans.encode(ids, table)
    assert (rans.decode(blob, table) == ids).all()
    parts = [rans.decode(blob, table, p) for p in range(-(-n // (rans.LANES * rans.EVERY)))]
    assert not n or (np.concatenate(parts) == ids).all()
    with pytest.raises(ValueError):
        rans.decode(blob[:-6] + bytes([blob[-6] ^ 1]) + blob[-5:], table)


def test_frequencies_of_many_rare_ids():
    freq = rans.scaled(np.concatenate([np.full(100, 10**6), np.ones(60_000, np.int64), np.zeros(5, np.int64)]))
    assert freq.sum() == 1 << 16 and (freq[:-5] > 0).all() and not freq[-5:].any()


def test_token_store(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_store.default_tokenizer())
    extra = [(50, "a<|endoftext|>b <|startoftext|>", None, None, None, 0, 0, "", "", ""), (51, "Ａ ﬁ é İ ǅ 's t \x1c 12", None, None, None, 0, 0, "", "", "")]
    path = token_store.write(docs.union(spark.createDataFrame(extra, SCHEMA)), block_ids=500)
    want, at = [], 0
    for doc, text, *_ in sorted([*rows, *extra], key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert gathered(token_store.read(spark, path), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert token_store.ids_of(spark, path).count() == len(want)
    assert token_store.read(spark, token_store.write(empty)).count() == 0


def test_fingerprints(docs, rows, empty):
    found = {(r.doc_id, r.edited_sha256): r for r in rare_digest.fingerprints(docs, parts=3).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    digests = {}
    for k, (doc, text, *_) in enumerate(order):
        t, following = text or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = found[doc, hashlib.sha256(edited.encode()).hexdigest()]
        assert r.n_chars == len(t)
        assert digests.setdefault(t, r.fingerprint) == r.fingerprint
        assert r.near_edited == pytest.approx(rare_digest.likeness(r.fingerprint, r.edited_fingerprint))
        assert (r.fingerprint == "") == (t == "")
    assert rare_digest.fingerprints(empty).count() == 0


def test_likeness():
    rank = rare_digest.rarity(np.zeros(rare_digest.LEVELS, np.int64))
    rng = np.random.default_rng(1)
    draw = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(900))
    a, b = draw(), draw()
    d = rare_digest.Digests([x.encode() for x in (a, a, b, a[:3000] + b[3000:], "")], rank)
    assert d.likeness(0, 1) == 1 and d.likeness(0, 2) < 0.1 and 0.3 < d.likeness(0, 3) < 0.7 and d.likeness(4, 4) == 1 and d.likeness(0, 4) == 0


def test_every_byte_is_in_a_window():
    rng = np.random.default_rng(2)
    draw = lambda n: "".join(rng.choice(list("一二三四五六七八九十百千"), n))
    a, b = draw(3000), draw(3000)
    texts = [a, a[:100] + b, a[:1500] + b[:1500], "x" + a, "ab " * 90, " " * 500 + "end", "=" * 1000, "", "y" * 63, "word " * 20 + a[:50]]
    coded = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)])
    start, row, _ = rare_digest.entropies(data, offsets)
    covered = np.zeros(len(data), bool)
    for s in start:
        covered[s : s + rare_digest.WINDOW] = True
    assert all(covered[offsets[i] : offsets[i + 1]].all() for i, t in enumerate(coded) if len(t) >= rare_digest.WINDOW)
    alone = [s - offsets[3] for s in start[row == 3]]
    assert alone == rare_digest.entropies(np.frombuffer(coded[3], np.uint8), np.array([0, len(coded[3])]))[0].tolist()
    d = rare_digest.Digests(coded, rare_digest.rarity(np.zeros(rare_digest.LEVELS, np.int64)))
    assert d.likeness(0, 1) < 0.2 and 0.3 < d.likeness(0, 2) < 0.7 and d.likeness(0, 3) > 0.9


def test_short_texts_keep_enough_features():
    rng = np.random.default_rng(4)
    rank = rare_digest.rarity(rng.integers(0, 1000, rare_digest.LEVELS))
    for n in range(17, 40):
        for _ in range(20):
            w = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(n)]
            text, edited = " ".join(w).encode(), " ".join([*w[:-1], "edit"]).encode()
            start, row, level = rare_digest.entropies(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            chosen = rare_digest.Digests.elected(row, rank[level], np.arange(len(row), dtype=np.uint64))
            assert len(chosen) >= min(len(start), rare_digest.SPAN - 1)
            assert rare_digest.Digests([text, edited], rank).likeness(0, 1) > 0
    pattern = b"one two three four five six seven eight nine ten " * 30
    start, row, level = rare_digest.entropies(np.frombuffer(pattern, np.uint8), np.array([0, len(pattern)]))
    same = np.unique([hash(pattern[s : s + rare_digest.WINDOW]) for s in start], return_inverse=True)[1].astype(np.uint64)
    assert len(np.unique(same[rare_digest.Digests.elected(row, rank[level], same)])) >= rare_digest.SPAN - 1


def test_entropies():
    text = b"the quick brown fox jumps over the lazy dog " * 4
    start, _, level = rare_digest.entropies(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    for s, q in zip(start.tolist(), level.tolist(), strict=True):
        n = collections.Counter(c & 31 for c in text[s : s + 64])
        bits = -sum(v / 64 * math.log2(v / 64) for v in n.values())
        assert abs(q - bits / 5 * 127) <= 0.51


def test_html(spark):
    page = '<html><head><title>T</title><script>var a="<p>";</script></head><body><nav><a href=x>N</a></nav><div class="ad">A</div><article class="c1"><h1>H &amp; h</h1><p>one  <b>two<br>three<p>four &eacute;</p><div class="comments"><p>no</p></div></article><footer>F</footer>'
    rows = [(1, "http://a.example/x", page), (2, "http://a.example/y", page), (3, None, None), (4, "http://b.example", ""), (5, "http://b.example", "plain & text"), (5, "http://b.example", "plain & text"), (6, "http://b.example", "<p>open"), (7, "http://a.example", "<div><p>other</div>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    article = "H & h\none two three\nfour é"
    want = [(1, article), (2, article), (3, ""), (4, ""), (5, "plain & text"), (5, "plain & text"), (6, "open"), (7, "other")]
    assert gathered(html_consensus.extracted(pages), "page_id", "text") == want
    assert gathered(html_consensus.extracted(pages, broadcast_bytes=0, salts=3), "page_id", "text") == want
    assert html_consensus.extracted(pages.limit(0)).count() == 0


def test_self_closed_raw_elements():
    for raw in ("<svg/>", "<svg viewBox='0 0 1 1' />", '<script src="x"/>', "<iframe hidden/>"):
        assert html_consensus.extract(f"<div>{raw}<p>one two</p></div>", None)[0] == "one two", raw
    for raw in ("<svg><p>no</p></svg>", "<script src=/a/>no</script>", "<iframe src=a/>no</iframe>", "<script src = a/>no</script>"):
        assert html_consensus.extract(f"<div>{raw}<p>one two</p></div>", None)[0] == "one two", raw


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    plain = [f"w{k}" for k in range(300)]
    texts, toxic = [], []
    for k in range(900):
        w = list(rng.choice(plain, 30))
        if k % 6 == 0:
            w += list(rng.choice(["badword", "vileword", "awfulone"], rng.integers(1, 4)))
        texts.append(" ".join(rng.permutation(w)))
        toxic.append(int(k % 6 == 0))
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(5000, None, "x"), (5001, "", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(k, y) for k, y in enumerate(toxic) if k % 2 == 0] + [(None, 1), (3, None)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity_ordinal.graded(docs, toxicity_ordinal.fit(docs, labels)).collect()}
    assert len(found) == 902 and not found[5000].toxic and not found[5001].toxic
    assert np.mean([found[k].toxic == bool(toxic[k]) for k in range(900)]) > 0.98
    assert all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 for r in found.values())
    assert toxicity_ordinal.fit(docs, labels.limit(0)) is None
    assert not toxicity_ordinal.graded(docs, None).filter("toxic").count()


def test_language(spark):
    rng = np.random.default_rng(0)
    parts = {"aa": ["the", "ing", "and", "wh"], "bb": ["ça", "eau", "é", "ment"], "cc": ["ß", "ung", "schl", "ü"]}
    rows = [(k, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(rng.integers(1, 200))), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 200)]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "12 !!", "bb"), (None, "the and", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    model = byte_cnn_lang.fit(docs, per_lang=60)
    found = byte_cnn_lang.identified(docs, model).collect()
    by = {r.doc_id: r for r in found}
    assert {by[k].lang_pred for k in (1000, 1001, 1002)} == {"und"}
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in found if r.doc_id is not None)
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)
    kept = byte_cnn_lang.accepted(docs, model)
    assert kept.columns == docs.columns and not kept.filter("doc_id between 1000 and 1002").count()
    assert byte_cnn_lang.fit(docs.limit(0)) is None and byte_cnn_lang.identified(docs, None).filter("lang_pred = 'und'").count() == len(rows)


def test_cnn_gradient():
    net = byte_cnn_lang.Net(3)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (4, 20)), np.array([0, 1, 2, 1])
    loss = lambda: -np.log(net.classified(net.convolved(net.tables(), x).max(1))[np.arange(4), y]).mean()
    g = net.gradients(x, y)
    for name in ("out", "w1", "embed"):
        i = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        net.p[name][i] += 1e-2
        up = loss()
        net.p[name][i] -= 2e-2
        down = loss()
        net.p[name][i] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(g[name][i], rel=0.05, abs=1e-4)


def test_html_of_arrow_nulls():
    assert html_consensus.extract(None, None)[0] == "" and pa.array([None], pa.string()).null_count == 1
