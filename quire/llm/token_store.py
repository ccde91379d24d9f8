"""Token-ID output: documents as ids in ascending doc_id order, in blocks of a static range asymmetric numeral coder.

A store is a folder with two Parquet datasets, so that any file system Spark knows can hold it: `table` (one row: the
shared frequency table) and `blocks` (a row each: its number, the ids before it, doc_ids and lengths, and the coded
bytes of quire.llm.rans). Blocks hold whole documents and about `block_ids` ids, and are decoded independently; a
longer document is a block of its own with more checkpoints.

Steps: range-sort texts by doc_id; tokenise, and write packed blocks of raw ids once; count ids over all blocks for
the table; code every block. Driver-side data: one row for each partition, and the table (a row for each id in use).

Defined cases: null text is empty and gives the end id alone; rows with one doc_id follow each other in text order; a
null doc_id comes last; an empty table gives a store without blocks; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import rans
from quire.llm.shared import MODEST, partitions, remove, settings, shared_dir
from quire.llm.words import chunks, mix, powers, raw

RAW = "part int, seq int, doc_ids array<bigint>, lengths array<int>, ids binary, before long, n_ids long, used binary"
BLOCK = "part int, seq int, first_id long, doc_ids array<bigint>, lengths array<int>, coded binary"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Pieces that an encoder remembers before it drops the rarer half (about 60 bytes each).
CACHE = 300_000
#: The one pre-tokenizer whose pieces are known here, and normalizers that keep its pieces apart.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
APOSTROPHE = 0x27


def _kinds() -> np.ndarray:
    """Of each byte: 0 white space, 1 letter, 2 digit, 3 other ASCII, 4 part of a longer character."""
    kinds = np.full(256, 3, np.uint8)
    kinds[[0x20, 9, 10, 11, 12, 13]] = 0
    for low, high, kind in ((0x41, 0x5B, 1), (0x61, 0x7B, 1), (0x30, 0x3A, 2), (0x80, 0x100, 4)):
        kinds[low:high] = kind
    return kinds


KINDS = _kinds()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts by the tokenizers library, with a bounded memory of pieces.

    Where the tokenizer's file has the pre-tokenizer and normalizers above, a text's ids are those of its pieces, one
    after the other: texts are cut at ASCII white space and between ASCII bytes of different kinds (not after an
    apostrophe, which may open a suffix), and A-Z are lower-cased unless a longer character follows. Each distinct piece
    of a batch is looked up by hash and compared byte by byte; the library encodes those that aren't remembered. A
    tokenizer of another make, and a batch in which an added token is written out or two pieces' hashes meet, get the
    library's ids of whole texts.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end_id
        known = json.loads(self.tokenizer.to_str())
        self.kind = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.added = [t["content"].encode() for t in known["added_tokens"]]
        splits = (known.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        model = known["model"]
        self.by_piece = (
            splits.get("type") == "Split" and splits["pattern"] == {"Regex": SPLIT} and (splits["behavior"], splits["invert"]) == ("Removed", True)
            and (known.get("normalizer") or {}).get("normalizers") == NORMALIZERS
            and known.get("post_processor") is None and not (known.get("truncation") or known.get("padding"))
            and model["type"] == "BPE" and not model["dropout"] and bool(model["end_of_word_suffix"])
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in known["added_tokens"])
        )
        if self.by_piece:
            self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(model["end_of_word_suffix"])]] = True
        self.forget()

    def forget(self) -> None:
        self.memory = Memory()
        self.at, self.n, self.uses, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def halved(self) -> None:
        """Drop the half of the pieces that was used least."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: CACHE // 2])
        n, at = self.n[keep], self.at[keep].astype(np.int64)
        new_at = np.cumsum(n) - n
        self.flat = self.flat[np.repeat(at - new_at, n) + np.arange(int(n.sum()))]
        self.memory = self.memory.kept(keep)
        self.at, self.n, self.uses = new_at.astype(np.int32), n, self.uses[keep] >> 1

    def singly(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for some in ids for i in some], self.kind), np.array([len(x) for x in ids], np.int64)

    def joined(self, pieces: pa.Array, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of so many words each, in runs: a word's last id tells its end."""
        data, offsets = raw(pieces)
        spaced = np.full(len(data) + len(pieces), 0x20, np.uint8)
        spaced[np.arange(len(data)) + np.repeat(np.arange(len(pieces)), np.diff(offsets))] = data
        blob, cuts = spaced.tobytes(), (offsets + np.arange(len(offsets)))[[*range(0, len(pieces), 64), len(pieces)]].tolist()
        runs = [blob[a:b].decode("utf-8", "replace") for a, b in itertools.pairwise(cuts)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False) for i in e.ids], self.kind)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != words.sum() or len(ids) and ends[-1] != len(ids):
            return self.singly([x.decode("utf-8", "replace") for x in pieces.to_pylist()])
        return ids, np.diff(ends[np.cumsum(words) - 1], prepend=0)

    def learn(self, pieces: pa.Array, h: np.ndarray) -> None:
        """Remember new pieces. Those that are surely one word, or so many digits, are encoded in runs."""
        words = word_counts(pieces)
        for some in (np.flatnonzero(words), np.flatnonzero(words == 0)):
            if not len(some):
                continue
            own = pieces.take(pa.array(some))
            ids, n = self.joined(own, words[some]) if words[some[0]] else self.singly([x.decode("utf-8", "replace") for x in own.to_pylist()])
            self.memory.add(own, h[some])
            self.at = np.concatenate([self.at, (len(self.flat) + np.cumsum(n) - n).astype(np.int32)])
            self.n = np.concatenate([self.n, n.astype(np.int32)])
            self.uses = np.concatenate([self.uses, np.zeros(len(n), np.int64)])
            self.flat = np.concatenate([self.flat, ids])

    def whole(self, column: pa.Array) -> list[np.ndarray]:
        ids, n = self.singly([x or "" for x in column.to_pylist()])
        cuts, filled = np.cumsum(n), np.insert(ids, np.cumsum(n), self.end)
        return np.split(filled, (cuts + np.arange(1, len(n) + 1))[:-1])

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text, with the end id."""
        data, offsets = raw(column)
        rows = len(offsets) - 1
        if not rows:
            return []
        if not self.by_piece or any(x in data.tobytes() for x in self.added):
            return self.whole(column)
        if len(self.at) > CACHE:
            self.halved()
        pieces, bounds = cut(data, offsets)
        dealt = pieces.dictionary_encode()
        index, distinct = dealt.indices.to_numpy(), dealt.dictionary
        h = hashes(distinct)
        place = self.memory.find(h)
        new = np.flatnonzero(place < 0)
        if len(new):
            self.learn(distinct.take(pa.array(new)), h[new])
            place[new] = self.memory.find(h[new])
        if not self.memory.holds(place, distinct):
            return self.whole(column)
        self.uses[place] += np.bincount(index, minlength=len(distinct))
        n = self.n[place][index]
        upto = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        total = int(upto[-1])
        source = np.repeat((self.at[place][index] - upto[:-1]).astype(np.int32), n)
        source += np.arange(total, dtype=np.int32)
        ends = upto[bounds[1:]] + np.arange(rows)  # where the end ids are
        keep = np.ones(total + rows, bool)
        keep[ends] = False
        out = np.full(total + rows, self.end, self.kind)
        out[keep] = self.flat[source]
        return np.split(out, ends[:-1] + 1)


class Memory:
    """Numbers of byte strings, by an open-addressing table of their hashes."""

    def __init__(self):
        self.slots, self.h, self.bytes, self.ends = np.full(1 << 16, -1, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of the first string with each hash, or -1."""
        mask = len(self.slots) - 1
        at, todo, found = (h & np.uint64(mask)).astype(np.int64), np.arange(len(h)), np.full(len(h), -1, np.int64)
        while len(todo):
            slot = self.slots[at[todo]]
            held = slot >= 0
            todo, slot = todo[held], slot[held]
            same = self.h[slot] == h[todo]
            found[todo[same]] = slot[same]
            todo = todo[~same]
            at[todo] = (at[todo] + 1) & mask
        return found

    def holds(self, place: np.ndarray, strings: pa.Array) -> bool:
        """Whether the strings with these numbers are the given ones, byte by byte."""
        data, offsets = raw(strings)
        n = np.diff(offsets)
        if not np.array_equal(self.ends[place + 1] - self.ends[place], n):
            return False
        return np.array_equal(self.bytes[np.repeat(self.ends[place] - offsets[:-1], n) + np.arange(len(data))], data)

    def add(self, strings: pa.Array, h: np.ndarray) -> None:
        data, offsets = raw(strings)
        first = len(self.h)
        self.h, self.bytes = np.concatenate([self.h, h]), np.concatenate([self.bytes, data])
        self.ends = np.concatenate([self.ends, self.ends[-1] + offsets[1:]])
        if 2 * len(self.h) > len(self.slots):
            self.slots, first = np.full(4 * len(self.slots), -1, np.int32), 0
        self._put(first)

    def _put(self, first: int) -> None:
        """Give each string from this number on a slot; of those that want one slot, one gets it."""
        mask = len(self.slots) - 1
        number = np.arange(first, len(self.h), dtype=np.int32)
        at = (self.h[first:] & np.uint64(mask)).astype(np.int64)
        while len(number):
            free = self.slots[at] < 0
            self.slots[at[free]] = number[free]
            left = self.slots[at] != number
            number, at = number[left], (at[left] + 1) & mask

    def kept(self, keep: np.ndarray) -> Memory:
        """These strings, numbered anew in order."""
        new, n = Memory(), np.diff(self.ends)[keep]
        ends = np.concatenate([[0], np.cumsum(n)])
        new.h, new.ends = self.h[keep], ends
        new.bytes = self.bytes[np.repeat(self.ends[keep] - ends[:-1], n) + np.arange(int(ends[-1]))]
        new.slots = np.full(len(self.slots), -1, np.int32)
        new._put(0)
        return new


def hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    data, offsets = raw(strings)
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[offsets[1:]] - sums[offsets[:-1]]) * down[offsets[:-1]] + np.diff(offsets).view(np.uint64))


def word_counts(pieces: pa.Array) -> np.ndarray:
    """The pre-tokens of each piece of cut(), where that is sure: a run of letters, of digits or of other signs; else 0."""
    data, offsets = raw(pieces)
    at, kinds = offsets[:-1], KINDS[data]
    most, odd = np.maximum.reduceat(kinds, at), np.maximum.reduceat((data == APOSTROPHE) | (data < 0x21) | (data == 0x7F), at)
    words = np.where(odd | (most == 4) | (np.minimum.reduceat(kinds, at) != most), 0, np.where(most == 2, np.diff(offsets), 1))
    longer = np.flatnonzero(~odd & (most == 4))
    words[longer] = [_letters(x.decode("utf-8", "replace")) for x in pieces.take(pa.array(longer)).to_pylist()]
    return words


def _letters(piece: str) -> bool:
    """Whether a piece is surely one run of letters, also when it is normalised."""
    low = piece.lower()
    return piece.isalpha() and low.isalpha() and len(low) == len(piece) and unicodedata.is_normalized("NFC", piece)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of texts, lower-cased where that is safe, and the number of pieces before each row, and of all."""
    kinds = KINDS[data]
    word = kinds != 0
    starts = word.copy()
    low = data
    if len(data) > 1:
        left, right = kinds[:-1], kinds[1:]
        starts[1:] &= ~word[:-1] | ((left != right) & (left < 4) & (right < 4) & (data[:-1] != APOSTROPHE))
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        starts[inner] = word[inner]
        upper = (data >= 0x41) & (data < 0x5B)
        upper[:-1] &= right < 4
        low = data + (upper.view(np.uint8) << 5)
    first = np.flatnonzero(starts)
    packed = low[word]
    places = np.zeros(len(first) + 1, np.int64)
    gaps = np.flatnonzero(~word)
    places[:-1] = first - np.searchsorted(gaps, first)
    places[-1] = len(packed)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(places), pa.py_buffer(packed)])
    return pieces, np.searchsorted(first, offsets)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder_of(path: str, end_id: int) -> Encoder:
    """One for each Python worker, which outlives tasks."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _packed(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, seq = TaskContext.get().partitionId(), encoder_of(path, end_id), 0
        held: list[np.ndarray] = []
        docs: list[int | None] = []
        size = before = 0

        def block() -> pa.RecordBatch:
            nonlocal held, docs, size, seq, before
            ids = np.concatenate(held)
            used, n = np.unique(ids, return_counts=True)
            row = [[part], [seq], [docs], [[len(x) for x in held]], [ids.tobytes()], [before], [len(ids)], [np.concatenate([used.astype("<u4"), n.astype("<u4")]).tobytes()]]
            seq, held, docs, size, before = seq + 1, [], [], 0, before + len(ids)
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
            return pa.record_batch([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["part", "seq", "doc_ids", "lengths", "ids", "before", "n_ids", "used"])

        for whole in batches:
            for batch in chunks(whole):
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder(batch.column("text")), strict=True):
                    held.append(ids)
                    docs.append(doc)
                    size += len(ids)
                    if size >= block_ids:
                        yield block()
        if held:
            yield block()

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id counts of a partition, one row."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for blob in batch.column("used").to_pylist():
            used, n = np.frombuffer(blob, "<u4").reshape(2, -1)
            if len(used) and used[-1] >= len(total):
                total = np.concatenate([total, np.zeros(int(used[-1]) + 1 - len(total), np.int64)])
            total[used] += n
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])


def _coded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, first = shared.value
        table = rans.Table(freq)
        for batch in batches:
            for row in batch.to_pylist():
                coded = rans.encode(np.frombuffer(row["ids"], f"<u{len(row['ids']) // row['n_ids']}"), table)
                values = [[row["part"]], [row["seq"]], [first[row["part"]] + row["before"]], [row["doc_ids"]], [row["lengths"]], [coded]]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
                yield pa.record_batch([pa.array(x, k) for x, k in zip(values, kinds, strict=True)], names=["part", "seq", "first_id", "doc_ids", "lengths", "coded"])

    return run


def write(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 1, block_ids: int = 1 << 17) -> str:
    """Write a store and return its folder, by default a new one in the shared folder."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    ordered = docs.select("doc_id", "text").repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
    scratch = f"{path}/raw"
    with settings(spark, MODEST):
        ordered.mapInArrow(_packed(tokenizer or default_tokenizer(), end_id, block_ids), RAW).write.parquet(scratch)
    packed = spark.read.schema(RAW).parquet(scratch)
    sizes = {r.part: r.n for r in packed.groupBy("part").agg(F.sum("n_ids").alias("n")).toLocalIterator()}  # a row for each partition
    first, total = {}, 0
    for part in sorted(sizes):
        first[part], total = total, total + sizes[part]
    rows = packed.select("used").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row for each id in use
    ids, counts = rows["id"].to_numpy(), rows["n"].to_numpy()
    full = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int64)
    full[ids] = counts
    freq = rans.scaled(full)
    spark.createDataFrame([(rans.BITS, bytearray(freq.astype("<u4").tobytes()))], "bits int, freq binary").coalesce(1).write.parquet(f"{path}/table")
    blocks = packed.select("part", "seq", "doc_ids", "lengths", "ids", "n_ids", "before")
    blocks.mapInArrow(_coded(spark.sparkContext.broadcast((freq, first))), BLOCK).write.parquet(f"{path}/blocks")
    remove(spark, scratch)
    return path


def _decoded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids = rans.decode(row["coded"], table).astype("<u4")
                ends = np.cumsum(row["lengths"])
                data, starts = ids.tobytes(), (ends - row["lengths"]).tolist()
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, ends.tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["first_id"] + a for a in starts], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def _frequencies(spark: SparkSession, path: str) -> np.ndarray:
    return np.frombuffer(spark.read.parquet(f"{path}/table").first().freq, "<u4")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a store, from its decoded blocks; see RESULT."""
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    return blocks.mapInArrow(_decoded(spark.sparkContext.broadcast(_frequencies(spark, path))), RESULT)


def ids_of(spark: SparkSession, path: str) -> DataFrame:
    """The ids themselves: doc_id, start, ids."""
    shared = spark.sparkContext.broadcast(_frequencies(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids = rans.decode(row["coded"], table)
                ends = np.cumsum(row["lengths"])
                parts = [ids[b - n : b].astype(np.int32) for b, n in zip(ends, row["lengths"], strict=True)]
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(row["first_id"] + ends - row["lengths"], pa.int64()), pa.array(parts, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return spark.read.schema(BLOCK).parquet(f"{path}/blocks").mapInArrow(run, "doc_id long, start long, ids array<int>")
