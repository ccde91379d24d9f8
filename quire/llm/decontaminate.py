"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over training windows, hits verified.

Words are maximal runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. A window is `n` consecutive words of
an item; an item of fewer words, but not none, is one window. Window hashes are looked up in a broadcast sorted array
and every hit is verified word by word. The index of a slice of the benchmark holds its folded words, and for each window
a hash and three numbers: at most 13 bytes for a byte of text. Long items are cut into overlapping pieces first, so that
slices keep under about `slice_bytes` of text, and a slice's index under 13 times that, at the driver, on the wire and in
a worker. A larger benchmark is scanned slice by slice. Each slice scans the input texts; the hits of all slices are
united by text (its SHA-256, as hits depend on the text alone) before any word is cut or any share is judged, so the
slices don't change the result. The united hits are broadcast up to a measured size, else joined with a salt.

Defined cases: null or empty texts have no words; equal windows of several items count for each; rows with one item_id
are one item with all their windows; a null item_id is skipped in the digest of ids but its words count as hit; an
empty benchmark hits nothing; very long texts are scanned whole; repeated rows of docs are judged each; other columns are
ignored by hits() and kept by decontaminate().
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import partitions, stored
from quire.llm.words import FOLD_TO_SPACES, FOLDED, Words, chunks, mix, rolled

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, hit binary"
_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
_SLICE = ["text_sha256", "n_words", "items", "hit"]
_BITS = 22


def folded(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD_TO_SPACES).split()


def canonical(words: Words) -> tuple[bytes, np.ndarray]:
    """All words, one space after each, and where each begins."""
    sizes = words.ends - words.starts
    cuts = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(int(cuts[-1]), 0x20, np.uint8)
    shift = np.repeat(cuts[:-1] - words.starts, sizes)
    at = np.flatnonzero(words.bytes)
    out[at + shift] = words.bytes[at]
    return out.tobytes(), cuts


def _grams(words: Words, h: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    g, at = words.grams(size, h)
    return mix(g ^ np.uint64(seed)), at


def window_index(items: list[tuple[str | None, str | None]], n: int, seed: int = 0) -> dict:
    """Names of the items, their words, and by window length: sorted hashes, one place of each window, and its items."""
    names = sorted({i for i, _ in items if i is not None})
    number = {name: k for k, name in enumerate(names)}
    words = Words(pa.array([t for _, t in items], pa.large_string()), FOLDED)
    text, cuts = canonical(words)
    own, rows, h = np.array([number.get(i, -1) for i, _ in items], np.int64), words.rows(), words.hashes()
    sets = {}
    for size in sorted({min(n, c) for c in words.counts.tolist()} - {0}):
        g, at = _grams(words, h, size, seed)
        if size < n:
            whole = words.counts[rows[at]] == size
            g, at = g[whole], at[whole]
        order = np.lexsort((at, g))
        g, at = g[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        group = np.repeat(np.arange(len(first)), np.diff([*first, len(g)]))
        again = np.flatnonzero(np.concatenate([[False], g[1:] == g[:-1]]))
        if any(text[cuts[k] : cuts[k + size]] != text[cuts[j] : cuts[j + size]] for k, j in zip(at[again].tolist(), at[first[group[again]]].tolist(), strict=True)):
            return window_index(items, n, seed + 1)  # two windows of one hash: hash anew
        pairs = np.unique(np.stack([group, own[rows[at]]], 1)[own[rows[at]] >= 0], axis=0)
        bounds = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        sets[size] = (g[first], at[first].astype(np.uint32), bounds.astype(np.uint32), pairs[:, 1].astype(np.uint32))
    return {"names": names, "text": text, "cuts": cuts.astype(np.uint32), "seed": seed, "sets": sets}


def _scanner(index: dict):
    """Words and digest of a batch, by the window index of a benchmark."""
    names, text, cuts, sets = index["names"], index["text"], index["cuts"], index["sets"]
    filters = {}
    for size, (hashes, *_) in sets.items():
        filters[size] = np.zeros(1 << _BITS, bool)
        filters[size][hashes >> np.uint64(64 - _BITS)] = True

    def scan(batch: pa.RecordBatch) -> tuple[Words, pa.RecordBatch]:
        words = Words(batch.column("text"), FOLDED)
        h = words.hashes()
        hits: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, list[np.ndarray]] = {}
        own: tuple[bytes, np.ndarray] | None = None
        rows = words.rows()
        for size, (hashes, places, bounds, numbers) in sets.items():
            g, at = _grams(words, h, size, index["seed"])
            maybe = np.flatnonzero(filters[size][g >> np.uint64(64 - _BITS)])
            slot = np.searchsorted(hashes, g[maybe])
            slot[slot == len(hashes)] = 0
            good = hashes[slot] == g[maybe]
            if not good.any():
                continue
            data, mine = own = own or canonical(words)
            for k, s in zip(at[maybe[good]].tolist(), slot[good].tolist(), strict=True):
                w = places[s]
                if data[mine[k] : mine[k + size]] == text[cuts[w] : cuts[w + size]]:
                    row = int(rows[k])
                    hits.setdefault(row, []).append((k - int(words.bounds[row]), size))
                    items.setdefault(row, []).append(numbers[bounds[s] : bounds[s + 1]])
        named = {row: [names[k] for k in np.unique(np.concatenate(some)).tolist()] for row, some in items.items()}
        return words, _digest(batch.column("doc_id"), words.counts, hits, named)

    return scan


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(shared.value)
        for whole in batches:
            for batch in chunks(whole):
                yield scan(batch)[1]

    return run


def _digest(ids: pa.Array, counts: np.ndarray, hits: dict, named: dict) -> pa.RecordBatch:
    m = len(counts)
    n_hit, n_items, shas, items, masks = np.zeros(m, np.int64), np.zeros(m, np.int64), [hashlib.sha256(b"").hexdigest()] * m, [[]] * m, [None] * m
    for row, found in hits.items():
        mask = np.zeros(int(counts[row]), bool)
        for k, size in found:
            mask[k : k + size] = True
        names = named[row]
        n_hit[row], n_items[row], items[row], masks[row] = mask.sum(), len(names), names, np.packbits(mask).tobytes()
        shas[row] = hashlib.sha256(",".join(names).encode()).hexdigest()
    return pa.record_batch(
        [ids.cast(pa.int64()), pa.array(counts.astype(np.int64)), pa.array(n_hit), pa.array(n_items), pa.array(shas, pa.string()), pa.array(n_hit > 0), pa.array(items, pa.list_(pa.string())), pa.array(masks, pa.binary())],
        names=_COLUMNS,
    )


#: Windows that begin in one piece of a long item.
PIECE = 1 << 13


def pieces_of(benchmark: DataFrame, n: int) -> DataFrame:
    """item_id, text: folded words of items; long items as pieces that share n - 1 words, so that each window is in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = folded(text)
                for a in range(0, max(1, len(words) - n + 1), PIECE):
                    ids.append(item)
                    texts.append(b" ".join(words[a : a + PIECE + n - 1]).decode("utf-8", "replace"))
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["item_id", "text"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return items.mapInArrow(run, "item_id string, text string").filter(F.octet_length("text") > 0).dropDuplicates()


def slices(pieces: DataFrame, slice_bytes: int) -> list[DataFrame]:
    """The pieces in parts by hash, each of about slice_bytes of text."""
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    n = int(total // slice_bytes) + 1
    return [pieces] if n == 1 else [pieces.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _scan_slice(shared):
    """Of rows that a slice hits: the text's hash, its number of words, the items and the hit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(shared.value)
        for whole in batches:
            for batch in chunks(whole):
                found = scan(batch)[1]
                yield pa.RecordBatch.from_arrays([batch.column("text_sha256"), *(found.column(c) for c in _SLICE[1:])], names=_SLICE).filter(found.column("contaminated"))

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one text as one row with all their items and hit words."""
    held: tuple | None = None
    out: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        sha, n_words, items, masks = zip(*((s, n, sorted(x), np.packbits(m).tobytes()) for s, n, x, m in out), strict=True) if out else ((),) * 4
        return pa.record_batch([pa.array(sha, pa.string()), pa.array(n_words, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(masks, pa.binary())], names=_SLICE)

    for batch in batches:
        for sha, n_words, items, bits in zip(*(batch.column(c).to_pylist() for c in _SLICE), strict=True):
            mask = np.unpackbits(np.frombuffer(bits, np.uint8), count=n_words).astype(bool)
            if held is not None and held[0] == sha:
                held[2].update(items)
                held[3][mask] = True
                continue
            if held is not None:
                out.append(held)
            held = (sha, n_words, set(items), mask)
        yield flushed()
        out = []
    if held is not None:
        out.append(held)
        yield flushed()


def _hit_texts(docs: DataFrame, parts: list[DataFrame], n: int) -> DataFrame:
    """One row for each different text that any slice hits; see _SLICE. Every slice scans the texts as they came.

    A text's hits depend on nothing but the text, so it is known by its SHA-256. One slice is held at a time.
    """
    spark, schema = docs.sparkSession, "text_sha256 string, n_words long, items array<string>, hit binary"
    texts = docs.select(F.lit(0).cast("long").alias("doc_id"), "text", F.sha2("text", 256).alias("text_sha256"))
    found = []
    for some in parts:
        shared = spark.sparkContext.broadcast(window_index([(r.item_id, r.text) for r in some.toLocalIterator()], n))
        found.append(stored(texts.mapInArrow(_scan_slice(shared), schema).dropDuplicates(["text_sha256"]), "slice"))
        shared.destroy()
    rows = reduce(DataFrame.union, found)
    return stored(rows.repartition(partitions(spark), "text_sha256").sortWithinPartitions("text_sha256").mapInArrow(_merge, schema), "hits")


def _with_hits(rows: DataFrame, sha: str, found: DataFrame, names: dict[str, str], broadcast_bytes: int, salts: int) -> DataFrame:
    """rows, each with the found columns of its text's hash under new names; null where no slice hit it."""
    size = found.agg(F.coalesce(F.sum(F.octet_length("hit") + F.octet_length(F.array_join("items", ",", "")) + 128), F.lit(0)).alias("b")).first().b
    found = found.select(F.col("text_sha256").alias(sha), *(F.col(a).alias(b) for a, b in names.items()))
    if size <= broadcast_bytes:
        return rows.join(F.broadcast(found), sha, "left").drop(sha)
    salt = _free(rows, f"{sha}_salt")
    salted = found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(salted, [sha, salt], "left").drop(sha, salt)


def _free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole):
            counts = Words(batch.column("text"), FOLDED).counts
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(counts.astype(np.int64)), batch.column("text_sha256")], names=["doc_id", "n_words", "text_sha256"])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of rows from the hits of all slices."""
    for batch in batches:
        n_hit, shas, masks = [], [], batch.column("hit").to_pylist()
        items = [x or [] for x in batch.column("items").to_pylist()]
        for names, bits in zip(items, masks, strict=True):
            n_hit.append(0 if bits is None else int(np.unpackbits(np.frombuffer(bits, np.uint8)).sum()))
            shas.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        columns = [pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(shas, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), pa.array(items, pa.list_(pa.string())), pa.array(masks, pa.binary())]
        yield pa.record_batch([batch.column("doc_id"), batch.column("n_words"), *columns], names=_COLUMNS)


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, slice_bytes: int = 8 << 20, broadcast_bytes: int = 32 << 20, salts: int = 64) -> DataFrame:
    """One row per row of docs with its hit words and items; see RESULT. hit: packed bits of the words, null if none."""
    spark = docs.sparkSession
    docs, parts = docs.select("doc_id", "text"), slices(pieces_of(benchmark, n), slice_bytes)
    if len(parts) == 1:
        items = [(r.item_id, r.text) for r in parts[0].toLocalIterator()]
        return docs.mapInArrow(_scan(spark.sparkContext.broadcast(window_index(items, n))), RESULT)
    rows = docs.withColumn("text_sha256", F.sha2("text", 256)).mapInArrow(_count, "doc_id long, n_words long, text_sha256 string")
    joined = _with_hits(rows, "text_sha256", _hit_texts(docs, parts, n), {"items": "items", "hit": "hit"}, broadcast_bytes, salts)
    return joined.mapInArrow(_united, RESULT)


def _cut(batch: pa.RecordBatch, words: Words, hit: list[bytes | None], share: float) -> pa.RecordBatch:
    """The batch without its hit words, and without rows of which share or more is hit."""
    texts = batch.column("text").to_pylist()
    keep = np.ones(len(texts), bool)
    data = words.raw.tobytes()
    for row, bits in enumerate(hit):
        if bits is None:
            continue
        mask = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(words.counts[row])).astype(bool)
        if mask.sum() >= share * len(mask):
            keep[row] = False
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
        first, base = int(words.bounds[row]), int(words.offsets[row])
        left, out = base, []
        for a, b in itertools.batched(edge.tolist(), 2):
            out.append(data[left : words.starts[first + a]])
            left = int(words.ends[first + b - 1])
        out.append(data[left : words.offsets[row + 1]])
        texts[row] = b"".join(out).decode("utf-8", "replace")
    sizes = pa.array([None if t is None else len(t) for t in texts], pa.int64())
    columns = {name: batch.column(name) for name in batch.schema.names} | {"text": pa.array(texts, pa.string())}
    if "n_chars" in columns:
        columns["n_chars"] = sizes.cast(batch.schema.field("n_chars").type)
    return pa.RecordBatch.from_pydict(columns).filter(pa.array(keep))


def _without_spans(shared, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(shared.value)
        for whole in batches:
            for batch in chunks(whole):
                words, found = scan(batch)
                yield _cut(batch, words, found.column("hit").to_pylist(), share)

    return run


def _without_joined(hit: str, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                own = batch.select([c for c in batch.schema.names if c != hit])
                yield _cut(own, Words(own.column("text"), FOLDED), batch.column(hit).to_pylist(), share)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, drop_share: float = 0.5, slice_bytes: int = 8 << 20, broadcast_bytes: int = 32 << 20, salts: int = 64) -> DataFrame:
    """docs without the hit words; a document of which drop_share or more is hit goes as a whole.

    All columns stay; n_chars follows the text. Each slice of a large benchmark is one more pass over the texts as they
    came; words are cut, and drop_share is judged, once, by the hits of all slices.
    """
    spark = docs.sparkSession
    parts = slices(pieces_of(benchmark, n), slice_bytes)
    if len(parts) == 1:
        items = [(r.item_id, r.text) for r in parts[0].toLocalIterator()]
        return docs.mapInArrow(_without_spans(spark.sparkContext.broadcast(window_index(items, n)), drop_share), docs.schema)
    sha, hit = _free(docs, "text_sha256"), _free(docs, "hit")
    rows = _with_hits(docs.withColumn(sha, F.sha2("text", 256)), sha, _hit_texts(docs, parts, n), {"hit": hit}, broadcast_bytes, salts)
    return rows.mapInArrow(_without_joined(hit, drop_share), docs.schema)
