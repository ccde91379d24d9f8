"""Document fingerprints by improbable features.

A window is the `WINDOW` bytes from a text's or a word's first byte, and the last `WINDOW` bytes of a text. Where there is
no such start for over `WINDOW` bytes (no white space between words, encoded data), windows start at content-defined bytes
too, and at the latest `WINDOW` bytes after the last one, so each byte of a text is in a window. A window's entropy (of 32 byte classes) is quantised; a corpus-wide
histogram of the quantised entropies, counted over all documents, gives each its rarity. Among every `SPAN` neighbouring
windows the rarest is elected, and windows elected at least twice are features; where a text gets fewer than `SPAN` - 1
different features so, every elected window is one, and where these are too few, every window. Features enter a chain of Bloom filters
(2048 bits, 5 bits a feature, 160 features a filter). Two filters overlap by their common bits, less those expected by
chance, over the most they could share; two digests by the mean, over the shorter chain, of each filter's best overlap,
weighted by its bits. A text that is shorter than a window is one feature. A fingerprint is the filters in base64.

The next document (by descending doc_id) of a partition's last one is the first of the following partition; those first
documents, one for each partition, are sent to both. Texts are shuffled once.

Defined cases: null text is empty; an empty text has the empty fingerprint, which is like another empty one (1) and
unlike all others (0); rows with one doc_id follow each other in text order; a null doc_id comes last; a single
document is its own next; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import dealt, partitions
from quire.llm.words import chunks, mix, powers, raw

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
WINDOW, SPAN, ELECTED = 64, 8, 2
CLASSES, LEVELS = 32, 128
FILTER_BITS, HASHES, CAPACITY = 2048, 5, 160
#: For each eight of the byte classes: a byte's class as a one in one of eight lanes.
_LANES = [np.array([1 << 8 * (c & 7) if (c & (CLASSES - 1)) >> 3 == k else 0 for c in range(256)], np.uint64) for k in range(CLASSES // 8)]
_GAIN = np.array([0.0, *(c * np.log2(c) for c in range(1, WINDOW + 1))], np.float32)


def _inner(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Starts inside runs of over WINDOW bytes that have none: where the next four bytes say so, and each WINDOW bytes from the last one."""
    size = np.diff(start, append=len(data))
    long = np.flatnonzero(size > WINDOW)
    if not len(long):
        return long
    n = size[long]
    base = np.repeat(start[long], n)
    at = base + np.arange(len(base)) - np.repeat(np.cumsum(n) - n, n)
    four = np.zeros(len(at), np.uint32)
    for k in range(4):  # of a window that fits, all four are in its text
        four |= data[np.minimum(at + k, len(data) - 1)].astype(np.uint32) << np.uint32(8 * k)
    low = (four * np.uint32(0x9E3779B1)) >> np.uint32(29) == 0
    cut = low & (at > base)
    cut[1:] &= ~low[:-1]  # a repeated byte is no start again and again
    last = np.maximum.accumulate(np.where(cut, at, base))
    return at[cut | ((at > last) & ((at - last) % WINDOW == 0))]


def entropies(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, row and quantised entropy of every window."""
    space = (data == 0x20) | ((data >= 9) & (data <= 13))
    first = ~space
    first[1:] &= space[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    first[_inner(data, np.flatnonzero(first))] = True
    first[offsets[1:][np.diff(offsets) >= WINDOW] - WINDOW] = True
    start = np.flatnonzero(first)
    row = np.searchsorted(offsets, start, "right") - 1
    fits = start + WINDOW <= offsets[row + 1]
    start, row = start[fits], row[fits]
    gain = np.zeros(len(start), np.float32)
    end, upto = start + WINDOW, np.zeros(len(data) + 1, np.uint64)
    for lanes in _LANES:  # eight classes at a time: their counts in a window are the eight bytes of one difference
        np.cumsum(lanes[data], out=upto[1:])
        gain += _GAIN[(upto[end] - upto[start]).view(np.uint8)].reshape(-1, 8).sum(1)
    bits = np.log2(WINDOW) - gain / WINDOW
    return start, row, np.clip(np.rint(bits / np.log2(CLASSES) * (LEVELS - 1)), 0, LEVELS - 1).astype(np.int64)


def rarity(histogram: np.ndarray) -> np.ndarray:
    """Rank of each quantised entropy, the rarest first; those below a quarter of the scale (repeated bytes) come last."""
    low = np.arange(LEVELS) < LEVELS // 4
    order = np.lexsort((np.arange(LEVELS), histogram, low))
    rank = np.empty(LEVELS, np.int64)
    rank[order] = np.arange(LEVELS)
    return rank


def _different(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The number of different hashes of each of n rows."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return np.bincount(row[fresh], minlength=n)


class Digests:
    """Fingerprints of many texts: a filter matrix, and each text's rows in it."""

    def __init__(self, texts: list[bytes], rank: np.ndarray):
        sizes = np.array([len(t) for t in texts], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        start, row, level = entropies(data, offsets) if len(data) else (np.zeros(0, np.int64),) * 3
        up, down = powers(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
            h = mix((sums[start + WINDOW] - sums[start]) * down[start] + np.uint64(WINDOW))
            chosen = self.elected(row, rank[level], h)
            whole = np.flatnonzero((np.bincount(row[chosen], minlength=len(texts)) == 0) & (sizes > 0))
            begin = np.concatenate([start[chosen], offsets[whole]])
            end = np.concatenate([start[chosen] + WINDOW, offsets[whole + 1]])
            row = np.concatenate([row[chosen], whole])
            h = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
        order = np.lexsort((begin, h, row))
        fresh = np.concatenate([[True], (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1])]) if len(h) else np.zeros(0, bool)
        keep = order[fresh]
        keep = keep[np.lexsort((begin[keep], row[keep]))]
        row, h = row[keep], h[keep]
        count = np.bincount(row, minlength=len(texts))
        filters = -(-count // CAPACITY)
        self.first = np.concatenate([[0], np.cumsum(filters)])
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        where = self.first[row] + nth // CAPACITY
        bits = np.zeros((int(self.first[-1]), FILTER_BITS), bool)
        for k in range(HASHES):
            bits[where, (h >> np.uint64(11 * k)).astype(np.int64) & (FILTER_BITS - 1)] = True
        self.filters = np.packbits(bits, axis=1)
        self.ones = bits.sum(1).astype(np.int64)
        self.words = self.filters.view(np.uint64) if len(self.filters) else np.zeros((0, FILTER_BITS // 64), np.uint64)

    @staticmethod
    def elected(row: np.ndarray, rank: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Windows that are the rarest of at least ELECTED spans; where these are too few, of one span, else all."""
        if not len(row):
            return np.zeros(0, np.int64)
        votes = np.zeros(len(row), np.int64)
        if len(row) >= SPAN:
            inside = np.flatnonzero(row[: len(row) - SPAN + 1] == row[SPAN - 1 :])
            best = np.lib.stride_tricks.sliding_window_view(rank, SPAN)[inside].argmin(1) + inside
            votes = np.bincount(best, minlength=len(row))
        need = np.full(int(row[-1]) + 1, ELECTED)
        for least in range(ELECTED - 1, -1, -1):
            chosen = np.flatnonzero(votes >= need[row])
            need[_different(row[chosen], h[chosen], len(need)) < SPAN - 1] = least
        return np.flatnonzero(votes >= need[row])

    def text(self, i: int) -> str:
        return base64.b64encode(self.filters[self.first[i] : self.first[i + 1]].tobytes()).decode()

    def likeness(self, i: int, j: int) -> float:
        a, b = slice(self.first[i], self.first[i + 1]), slice(self.first[j], self.first[j + 1])
        return overlap(self.words[a], self.ones[a], self.words[b], self.ones[b])


def overlap(a: np.ndarray, a_ones: np.ndarray, b: np.ndarray, b_ones: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, a_ones, b, b_ones = b, b_ones, a, a_ones
    common = np.array([np.bitwise_count(row & b).sum(1) for row in a], np.float64)
    chance = a_ones[:, None] * b_ones / FILTER_BITS
    most = np.minimum(a_ones[:, None], b_ones)
    best = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(1)
    return float((best * a_ones).sum() / a_ones.sum())


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints."""
    words = [np.frombuffer(base64.b64decode(x), np.uint64).reshape(-1, FILTER_BITS // 64) for x in (a, b)]
    ones = [np.bitwise_count(w).sum(1).astype(np.int64) for w in words]
    return overlap(words[0], ones[0], words[1], ones[1])


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LEVELS, np.int64)
    for whole in batches:
        for batch in chunks(whole, limit=1 << 20):
            data, offsets = raw(batch.column("text"))
            if len(data):
                total += np.bincount(entropies(data, offsets)[2], minlength=LEVELS)
    yield pa.record_batch([pa.array(np.arange(LEVELS), pa.int64()), pa.array(total, pa.int64())], names=["level", "n"])


def histogram(docs: DataFrame) -> np.ndarray:
    """Windows of each quantised entropy over all documents."""
    out = np.zeros(LEVELS, np.int64)
    for r in docs.select("text").mapInArrow(_levels, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.level] = r.n
    return out


def _parts(bounds: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Part 0 has the largest ids; nulls are in the last part."""
    values = ids.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    return len(bounds) - np.searchsorted(bounds, values, "left")


def _dealt_ids(bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(_parts(bounds, batch.column("doc_id")), pa.int32()), batch.column("doc_id").cast(pa.int64())], names=["part", "doc_id"])

    return run


def _dealt_docs(bounds: np.ndarray, heads: dict[int, tuple[int, int | None]]):
    """Rows with their part, and again, as context, those that are first in a part, for the part before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _parts(bounds, batch.column("doc_id"))
            ids = batch.column("doc_id").cast(pa.int64())
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array(np.zeros(len(part), np.int32)), ids, batch.column("text")], names=["part", "context", "doc_id", "text"])
            again = [(k, heads[p][0]) for k, (p, i) in enumerate(zip(part.tolist(), ids.to_pylist(), strict=True)) if heads[p][1] == i]
            if again:
                rows, to = zip(*again, strict=True)
                some = batch.take(pa.array(rows))
                yield pa.record_batch([pa.array(to, pa.int32()), pa.array(np.ones(len(to), np.int32)), some.column("doc_id").cast(pa.int64()), some.column("text")], names=["part", "context", "doc_id", "text"])

    return run


def _fingerprints(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        held: list[tuple[int | None, str]] = []
        after: str | None = None
        size = 0
        for batch in batches:
            for context, doc, text in zip(*(batch.column(c).to_pylist() for c in ("context", "doc_id", "text")), strict=True):
                if context:
                    after = (text or "") if after is None else after
                    continue
                held.append((doc, text or ""))
                size += len(held[-1][1])
                if size > 200_000 and len(held) > 1:
                    yield _block(held[:-1], held[-1][1], rank)
                    held, size = held[-1:], len(held[-1][1])
        if held:
            yield _block(held, after or "", rank)

    return run


def _block(rows: list[tuple[int | None, str]], after: str, rank: np.ndarray) -> pa.RecordBatch:
    texts = [t for _, t in rows]
    following = [*texts[1:], after]
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
    n = len(rows)
    coded = [t.encode("utf-8", "surrogatepass") for t in (*texts, after, *edited)]
    d = Digests(coded, rank)
    columns = [
        pa.array([i for i, _ in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in coded[n + 1 :]]),
        pa.array([d.text(k) for k in range(n)], pa.string()), pa.array([d.text(n + 1 + k) for k in range(n)], pa.string()),
        pa.array([d.likeness(k, n + 1 + k) for k in range(n)], pa.float64()), pa.array([d.likeness(k, k + 1) for k in range(n)], pa.float64()),
    ]
    return pa.record_batch(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per row of docs; see RESULT."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    n = parts or partitions(spark)
    rank = rarity(histogram(docs))
    places = [k / n for k in range(1, n)]
    bounds = np.unique(np.array(docs.select(F.col("doc_id").cast("double").alias("doc_id")).approxQuantile("doc_id", places, 0.1 / n) if places else [], np.float64).astype(np.int64))
    first = docs.select("doc_id").mapInArrow(_dealt_ids(bounds), "part int, doc_id long").groupBy("part").agg(F.max("doc_id").alias("head"))
    found = sorted((r.part, r.head) for r in first.toLocalIterator())  # a row for each part
    heads = {part: (found[k - 1][0], head) for k, (part, head) in enumerate(found)}
    rows = docs.mapInArrow(_dealt_docs(bounds, heads), "part int, context int, doc_id long, text string")
    ordered = dealt(rows, len(bounds) + 1, "part").sortWithinPartitions("part", "context", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(_fingerprints(spark.sparkContext.broadcast(rank)), RESULT)
