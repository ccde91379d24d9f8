"""Substring dedup by relative Lempel-Ziv parsing against hash-dealt reference blocks, with verified factors.

The reference is all documents. Its index holds every phrase, a window of `window` words, and is dealt into blocks by
phrase hash, so that each phrase of a document is looked up in the one block that can hold it, and no document has to be
sent to every block. The lookup gives a place in a smaller document (the smallest that holds the phrase). A factor is the
longest run of a document's words that continues at one place of one smaller document: it is extended greedily, phrase
after phrase, and ends where the next phrase isn't found or is found elsewhere; so it has at least `window` words. At its
two ends every factor is checked: the words between them are compared with the source's words, by 128-bit BLAKE2b digests
that both sides make from the texts. Only the words of factors that pass are removed. Phrase and row hashes have 64 bits;
where two of them meet by chance, a factor fails its check and its words stay: no word is removed unverified. In the result,
n_factors counts runs of phrases that smaller documents hold: factors of which one begins right where another's place
ends are one run, so that the count doesn't depend on which of several sources was found.

Shuffles: phrases to blocks (packed, about 9 bytes each); places found to the document's group; claims to the source's
group, with the texts; digests and factors to the document's group, with the texts. A phrase that many rows of one batch
hold is sent once, and a place that many documents of a group continue is claimed once, so a popular passage isn't
gathered anywhere. Every step's rows are sorted by block or group, and these are worked on one at a time; factors
and claims are written to the shared folder, and the shuffles before them dropped. A task needs the memory of one block: a partition, unless
`spread` cuts partitions into so many blocks each (at the price of as many more, smaller packed rows).

Defined cases: null text has no words; a document with fewer words than the window keeps all; rows with equal doc_id
are not smaller than each other, so neither loses words to the other; repeated rows are judged each; a null doc_id counts
as the largest; very long texts are read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import partitions, stored
from quire.llm.words import SPACES, Words, chunks, identity, numbers

MOVED = "part int, kind int, payload binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long, longest_factor long"
_PHRASES, _PLACES, _FACTORS, _CLAIMS, _DIGESTS, _TEXTS = range(6)
_NULL_ID = np.iinfo(np.int64).max


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays, each with its length in bytes before it, compressed together."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x for a in arrays for x in (struct.pack("<Q", a.nbytes), a.tobytes())))


def _loose(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        (n,) = struct.unpack_from("<Q", data, at)
        out.append(np.frombuffer(data, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def _runs(keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _rows(items: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    parts, kinds, blobs = zip(*items, strict=True) if items else ((), (), ())
    return pa.record_batch([pa.array(parts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "payload"])


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """Blocks or groups to n partitions, one after the other in each."""
    return rows.repartitionById(n, F.pmod("part", F.lit(n)).cast("int")).sortWithinPartitions("part", "kind")


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """The payloads of each block or group, by kind."""
    at, held = None, defaultdict(list)
    for batch in batches:
        for part, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if part != at:
                if held:
                    yield at, held
                at, held = part, defaultdict(list)
            held[kind].append(blob)
    if held:
        yield at, held


def _places(uid: np.ndarray, pos: np.ndarray, source: np.ndarray, source_pos: np.ndarray, parts: int) -> list[tuple[int, int, bytes]]:
    """Found phrases by document group: row identities, counts, position steps, and the places found."""
    group = (uid % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((pos, uid, group))
    group, uid, pos, source, source_pos = group[order], uid[order], pos[order].astype(np.int64), source[order], source_pos[order]
    out = []
    for a, b in itertools.pairwise([*_runs(group), len(group)]):
        starts = _runs(uid[a:b])
        steps = np.diff(pos[a:b], prepend=0)
        steps[starts] = pos[a:b][starts]
        out.append((int(group[a]), _PLACES, _squeeze(uid[a:b][starts], np.diff([*starts, b - a]).astype(np.uint32), steps.astype(np.uint32), source[a:b], source_pos[a:b].astype(np.uint32))))
    return out


#: Text bytes that are taken apart at once: the more, the fewer packed arrays for each block.
PACKED_BYTES = 4 << 20


def _phrases(window: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for some in chunks(whole, limit=PACKED_BYTES):
                ids = numbers(some.column("doc_id"))
                up = np.argsort(ids, kind="stable")
                ids, batch = ids[up], some.take(pa.array(up))
                words = Words(batch.column("text"), SPACES)
                uid = identity(batch.column("doc_id"), words)
                h, at = words.grams(window)
                if not len(h):
                    continue
                row = words.rows()[at]
                pos = at - words.bounds[row]
                order = np.argsort(h, kind="stable")  # so the smallest document comes first
                h, row, pos = h[order], row[order], pos[order]
                starts = _runs(h)
                first = np.repeat(starts, np.diff([*starts, len(h)]))
                later = np.flatnonzero(ids[row] > ids[row[first]])  # a smaller document of this batch holds the phrase
                items = _places(uid[row[later]], pos[later], uid[row[first[later]]], pos[first[later]], parts)
                left = np.ones(len(h), bool)
                left[later] = False
                h, row, pos = h[left], row[left], pos[left]
                block = (h % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((pos, row, block))
                h, row, pos, block = h[order], row[order], pos[order], block[order]
                for a, b in itertools.pairwise([*_runs(block), len(block)]):
                    docs = _runs(row[a:b])
                    steps = np.diff(pos[a:b], prepend=0)
                    steps[docs] = pos[a:b][docs]
                    wide = np.flatnonzero(steps > 254)
                    short = steps.astype(np.uint8)
                    short[wide] = 255
                    meta = _squeeze(ids[row[a:b][docs]], uid[row[a:b][docs]], np.diff([*docs, b - a]).astype(np.uint32), short, steps[wide].astype(np.uint32))
                    items.append((int(block[a]), _PHRASES, struct.pack("<Q", len(meta)) + meta + h[a:b].tobytes()))
                yield _rows(items)

    return run


def _found(parts: int):
    """Of each block: the phrases that a smaller document holds too, with the place in the smallest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, kinds in _one_by_one(batches):
            if kinds[_PLACES]:
                yield _rows([(part, _PLACES, blob) for blob in kinds[_PLACES]])
            hs, idss, uids, poss = [], [], [], []
            for blob in kinds.pop(_PHRASES, ()):
                (n,) = struct.unpack_from("<Q", blob)
                ids, uid, counts, short, wide = _loose(blob[8 : 8 + n], "<i8", "<u8", "<u4", "u1", "<u4")
                hs.append(np.frombuffer(blob, "<u8", offset=8 + n))
                steps = short.astype(np.int64)
                steps[short == 255] = wide
                total = np.cumsum(steps)
                first = np.cumsum(counts) - counts
                poss.append((total - np.repeat(total[first] - steps[first], counts)).astype(np.uint32))
                idss.append(np.repeat(ids, counts))
                uids.append(np.repeat(uid, counts))
            if not hs:
                continue
            h = np.concatenate(hs)
            order = np.argsort(h)
            h = h[order]
            same = np.zeros(len(h) + 1, bool)
            same[1:-1] = h[1:] == h[:-1]
            shared = same[1:] | same[:-1]  # phrases that come more than once
            order, h = order[shared], h[shared]
            if not len(h):
                continue
            ids, starts = np.concatenate(idss)[order], _runs(h)
            group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(h)]))
            least = np.minimum.reduceat(ids, starts)[group]
            source = np.minimum.reduceat(np.where(ids == least, np.arange(len(h)), len(h)), starts)[group]
            later = np.flatnonzero(ids > least)
            if len(later):
                uid, pos = np.concatenate(uids)[order], np.concatenate(poss)[order]
                yield _rows(_places(uid[later], pos[later], uid[source[later]], pos[source[later]], parts))

    return run


def _factored(window: int, parts: int):
    """Of each group: the documents' factors, and one claim for each place that any of them continues."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, kinds in _one_by_one(batches):
            uids, poss, sources, source_poss = [], [], [], []
            for blob in kinds.pop(_PLACES, ()):
                uid, counts, steps, source, source_pos = _loose(blob, "<u8", "<u4", "<u4", "<u8", "<u4")
                total = np.cumsum(steps.astype(np.int64))
                first = np.cumsum(counts) - counts
                poss.append(total - np.repeat(total[first] - steps[first], counts))
                uids.append(np.repeat(uid, counts))
                sources.append(source)
                source_poss.append(source_pos.astype(np.int64))
            uid, pos, source, source_pos = (np.concatenate(x) for x in (uids, poss, sources, source_poss))
            order = np.lexsort((pos, uid))
            uid, pos = uid[order], pos[order]
            fresh = np.concatenate([[True], (uid[1:] != uid[:-1]) | (pos[1:] != pos[:-1])])  # repeated rows find a place each
            uid, pos, source, source_pos = uid[fresh], pos[fresh], source[order][fresh], source_pos[order][fresh]
            goes_on = (uid[1:] == uid[:-1]) & (pos[1:] == pos[:-1] + 1) & (source[1:] == source[:-1]) & (source_pos[1:] == source_pos[:-1] + 1)
            starts = np.flatnonzero(np.concatenate([[True], ~goes_on]))
            n = (pos[np.append(starts[1:], len(pos)) - 1] - pos[starts] + window).astype(np.uint32)
            factors = (uid[starts], pos[starts].astype(np.uint32), n, source[starts], source_pos[starts].astype(np.uint32))
            items = [(part, _FACTORS, _squeeze(*factors))]
            claims = np.unique(np.rec.fromarrays([(factors[3] % np.uint64(parts)).astype(np.int64), factors[3], factors[4], n], names="group,uid,pos,n"))
            for a, b in itertools.pairwise([*_runs(claims.group), len(claims)]):
                items.append((int(claims.group[a]), _CLAIMS, struct.pack("<i", part) + _squeeze(claims.uid[a:b].astype(np.uint64), claims.pos[a:b].astype(np.uint32), claims.n[a:b].astype(np.uint32))))
            yield _rows(items)

    return run


def _words_of(texts: list[bytes], wanted: set[int] | None = None) -> Iterator[tuple[int, int, list[bytes]]]:
    """doc_id, identity and words of the rows of a group."""
    for blob in texts:
        ids, uid, sizes, body = _loose(blob, "<i8", "<u8", "<i8", "u1")
        data, at = body.tobytes(), 0
        for doc, u, size in zip(ids.tolist(), uid.tolist(), sizes.tolist(), strict=True):
            if wanted is None or u in wanted:
                yield doc, u, data[at : at + size].split()
            at += size


def _digest(words: list[bytes], pos: int, n: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[pos : pos + n]), digest_size=16).digest()


def _digests():
    """Answers to claims: digests of the source's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kinds in _one_by_one(batches):
            claims = [(struct.unpack_from("<i", blob)[0], *_loose(blob[4:], "<u8", "<u4", "<u4")) for blob in kinds.pop(_CLAIMS, ())]
            asked: dict[int, dict[tuple[int, int], bytes]] = defaultdict(dict)
            for _, uid, pos, n in claims:
                for u, *place in zip(uid.tolist(), pos.tolist(), n.tolist(), strict=True):
                    asked[u][tuple(place)] = bytes(16)
            done = set()
            for _, u, words in _words_of(kinds[_TEXTS], set(asked)):
                if u not in done:
                    done.add(u)
                    asked[u] = {(pos, n): _digest(words, pos, n) for pos, n in asked[u]}
            for group, uid, pos, n in claims:
                made = b"".join(asked[u][p, k] for u, p, k in zip(uid.tolist(), pos.tolist(), n.tolist(), strict=True))
                yield _rows([(group, _DIGESTS, _squeeze(uid, pos, n, np.frombuffer(made, np.uint8)))])

    return run


def _texts(parts: int):
    """Each batch's rows, compressed by document group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, limit=PACKED_BYTES):
                words = Words(batch.column("text"), SPACES)
                uid = identity(batch.column("doc_id"), words)
                group = (uid % np.uint64(parts)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                ids, sizes, items = numbers(batch.column("doc_id")), np.diff(words.offsets), []
                data = words.raw.tobytes()
                for a, b in itertools.pairwise([*_runs(group[order]), len(order)]):
                    rows = order[a:b]
                    body = b"".join(data[words.offsets[r] : words.offsets[r + 1]] for r in rows)
                    items.append((int(group[rows[0]]), _TEXTS, _squeeze(ids[rows], uid[rows], sizes[rows], np.frombuffer(body, np.uint8))))
                yield _rows(items)

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kinds in _one_by_one(batches):
            digests: dict[tuple[int, int, int], bytes] = {}
            for blob in kinds.pop(_DIGESTS, ()):
                uid, pos, n, made = _loose(blob, "<u8", "<u4", "<u4", "u1")
                made = made.tobytes()
                digests.update((place, made[16 * k : 16 * k + 16]) for k, place in enumerate(zip(uid.tolist(), pos.tolist(), n.tolist(), strict=True)))
            factors: dict[int, list[tuple[int, int, bytes]]] = defaultdict(list)
            for blob in kinds.pop(_FACTORS, ()):
                for u, pos, n, source, source_pos in zip(*(x.tolist() for x in _loose(blob, "<u8", "<u4", "<u4", "<u8", "<u4")), strict=True):
                    factors[u].append((pos, n, digests[source, source_pos, n]))
            out: list[tuple] = []
            for doc, u, words in _words_of(kinds[_TEXTS]):
                held = [(pos, n) for pos, n, made in factors.get(u, ()) if _digest(words, pos, n) == made]
                runs: list[list[int]] = []  # factors of one document, joined where the next phrase begins in another place
                for pos, n in sorted(held):
                    if runs and pos == runs[-1][1] - window + 1:
                        runs[-1][1] = pos + n
                    else:
                        runs.append([pos, pos + n])
                kept, at = [] if runs else words, 0
                for a, b in runs:
                    kept += words[at:a] if a > at else []
                    at = b
                kept += words[at:] if runs else []
                longest = max((b - a for a, b in runs), default=0)
                out.append((None if doc == _NULL_ID else doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), len(runs), longest, kept))
                if len(out) >= 2000:
                    yield _result(out)
                    out = []
            if out:
                yield _result(out)

    return run


def _result(rows: list[tuple]) -> pa.RecordBatch:
    ids, n, gone, sha, factors, longest, words = zip(*rows, strict=True)
    longs = [pa.array(x, pa.int64()) for x in (ids, n, gone, factors, longest)]
    columns = [*longs[:3], pa.array(sha, pa.string()), *longs[3:], pa.array([b" ".join(w).decode() for w in words], pa.string())]
    return pa.record_batch(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors", "longest_factor", "kept_text"])


def substring_dedup(docs: DataFrame, window: int = 13, blocks: int | None = None, spread: int = 1) -> DataFrame:
    """One row per row of docs: counts, the kept words (joined by one space) and their SHA-256."""
    n = blocks or partitions(docs.sparkSession)
    parts = spread * n
    docs = docs.select("doc_id", "text")
    found = _dealt(docs.mapInArrow(_phrases(window, parts), MOVED), n).mapInArrow(_found(parts), MOVED)
    factored = stored(_dealt(found, n).mapInArrow(_factored(window, parts), MOVED), "factors")
    texts = docs.mapInArrow(_texts(parts), MOVED)
    digests = _dealt(factored.filter(F.col("kind") == _CLAIMS).union(texts), n).mapInArrow(_digests(), MOVED)
    return _dealt(factored.filter(F.col("kind") == _FACTORS).union(digests).union(texts), n).mapInArrow(_kept(window), f"{RESULT}, kept_text string")
