"""N-gram Jaccard self-join by chosen paths.

A document is the set of its runs of five words (words as in quire.llm.decontaminate; a text of fewer words, but not
none, is one run). A path is a sequence of tokens of the set: in each of several runs, a token extends a path if a hash
of both lies below `spread` / set size. Sets meet in the bucket of a path that they share. Buckets of up to `small` sets
are brute-forced; the sets of a larger one are split by the paths' extensions, level by level, down to `LEVELS` tokens.
Where splitting can't help it stops early: if the bucket's sets lie with most (`DENSE`) of their paths in large buckets,
they are near each other and have to be compared. Such buckets, and those that are large at the last level, are
brute-forced in pairs of blocks. The number of runs follows from the target recall for pairs at the threshold: with
mu = shared share * spread, a path of l + 1 tokens is shared with probability q(l + 1) = 1 - exp(-mu * q(l)) at least.

Equal sets are one node, so copies are never compared. Buckets with the same members are kept once. A pair that meets in
several buckets counts in the smallest of their numbers. Brute force multiplies a block's sets by token incidence
matrices, sums links there, and passes on only sums and a spanning star for each component.

Defined cases: a null text, or one without words, has no links and is a class of its own; rows with one doc_id are
separate documents; a null doc_id is larger than all others; ties in class ids go by doc_id; other columns are ignored
by classes() and kept by representatives(); very long texts are taken whole; an empty table gives no rows.

Keys that many rows share (a popular text, a boilerplate shingle, a giant class) are joined by broadcast: the fewer than
HOT keys that hold more than 1 / HOT of the rows each.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.shared import few_join, forget, hub_join, partitions, stored
from quire.llm.words import FOLDED, Words, chunks, mix, rolled, trim

SIGNED = "doc_id long, key string, node long, n long, paths array<bigint>, kids array<bigint>, parents array<bigint>"
SHINGLE = 5
#: Tokens of the longest paths, and the share of paths in large buckets from which a bucket isn't split.
LEVELS, DENSE = 4, 0.6
#: Bytes of a token's hash that go to a bucket: two of 1000 tokens in a pair of sets are alike by chance in 1 of 10**8 pairs.
SENT_BYTES = 6


def shingles(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the distinct word runs, by row and hash."""
    h = words.hashes()
    g, at = words.grams(n, h)
    row = words.rows()[at] if len(at) else np.zeros(0, np.int64)
    parts, rows = [g], [row]
    for size in range(1, n):
        short = np.flatnonzero(words.counts == size)
        if len(short):
            parts.append(mix(rolled(h, size)[words.bounds[short]]))
            rows.append(short)
    g, row = np.concatenate(parts), np.concatenate(rows)
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (row[1:] != row[:-1])]) if len(g) else np.zeros(0, bool)
    return g[fresh], row[fresh]


def runs_for(recall: float, similarity: float, spread: float, levels: int = LEVELS) -> int:
    """Runs that let a pair at the threshold share a path of so many tokens with the given probability."""
    mu = spread * similarity  # the least shared share of the larger set, at this similarity
    q = 1.0
    for _ in range(levels):
        q = 1 - math.exp(-mu * q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def _below(tokens: np.ndarray, spread: float) -> np.uint64:
    return np.uint64(min(int(spread / len(tokens) * 2.0**64), 2**64 - 1))


def extended(tokens: np.ndarray, paths: np.ndarray, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """The paths' extensions by tokens, and the extensions' parents."""
    if not len(paths):
        return paths, paths
    path, at = np.nonzero(mix(tokens[None, :] ^ mix(paths)[:, None]) <= _below(tokens, spread))
    return mix(tokens[at] * np.uint64(5) + paths[path]), paths[path]


def _signed(runs: int, spread: float):
    seeds = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def one(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Paths of one token, their extensions, and the extensions' parents."""
        run, at = np.nonzero(mix(tokens[None, :] ^ seeds[:, None]) <= _below(tokens, spread))
        paths = mix(tokens[at] + seeds[run] * np.uint64(3))
        return paths, *extended(tokens, paths, spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                words = Words(batch.column("text"), FOLDED)
                g, row = shingles(words)
                bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
                node, n, columns = np.zeros(batch.num_rows, np.int64), np.diff(bounds), ([], [], [])
                with np.errstate(over="ignore"):
                    for k, (a, b) in enumerate(itertools.pairwise(bounds.tolist())):
                        found = one(g[a:b]) if b > a else (g[:0],) * 3
                        if b > a:
                            node[k] = mix(np.array([np.bitwise_xor.reduce(mix(g[a:b])) + np.add.reduce(mix(g[a:b] ^ seeds[0]))], np.uint64)).view(np.int64)[0]
                        for column, x in zip(columns, found, strict=True):
                            column.append(x.view(np.int64))
                lists = [pa.array(c, pa.list_(pa.int64())) for c in columns]
                yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), batch.column("key"), pa.array(node), pa.array(n), *lists], names=["doc_id", "key", "node", "n", "paths", "kids", "parents"])

    return run


def _deeper(spread: float):
    """Extensions of paths of two tokens down to the last level: node, bucket, parent, level."""
    names = ["node", "bucket", "parent", "level"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                g, row = shingles(Words(batch.column("text"), FOLDED))
                bounds = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
                parts: list[tuple] = []
                with np.errstate(over="ignore"):
                    for k, (node, paths) in enumerate(zip(batch.column("node").to_pylist(), batch.column("paths").to_pylist(), strict=True)):
                        tokens, at = g[bounds[k] : bounds[k + 1]], np.unique(np.array(paths, np.int64)).view(np.uint64)
                        for level in range(3, LEVELS + 1):
                            at, parent = extended(tokens, at, spread)
                            parts.append((np.full(len(at), node), at.view(np.int64), parent.view(np.int64), np.full(len(at), level, np.int32)))
                            at = np.unique(at)
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.int32)]
                yield pa.record_batch([pa.array(x) for x in columns], names=names)

    return run


def _sent(small: int):
    """Each needed set once for each of its buckets, and for each pair of blocks in a large bucket."""
    names = ["bucket", "i", "j", "block", "node", "n_texts", "others", "tokens"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, limit=1 << 20):
                g, row = shingles(Words(batch.column("text"), FOLDED))
                bounds = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
                out: list[tuple] = []
                size = 0
                for k, (node, n_texts, buckets) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("node", "n_texts", "buckets")), strict=True)):
                    tokens = g[bounds[k] : bounds[k + 1]].view(np.uint8).reshape(-1, 8)[:, :SENT_BYTES].tobytes()
                    mine = np.array(sorted(b["bucket"] for b in buckets), "<i8").tobytes()
                    for b in buckets:
                        blocks = -(-b["size"] // small)
                        block = int(mix(np.array([node ^ b["bucket"]], np.int64).view(np.uint64))[0] % np.uint64(blocks))
                        for other in range(blocks):
                            i, j = min(block, other), max(block, other)
                            out.append((b["bucket"], i, j, block, node, n_texts, mine, tokens))
                            size += len(tokens)
                            if size > 2 << 20:
                                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                                out, size = [], 0
                if out:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def unsent(tokens: bytes) -> np.ndarray:
    short = np.frombuffer(tokens, np.uint8).reshape(-1, SENT_BYTES)
    full = np.zeros((len(short), 8), np.uint8)
    full[:, :SENT_BYTES] = short
    return full.view(np.uint64).ravel()


def common(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """The size of every two sets' intersection."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    many = np.flatnonzero(times >= 2)
    place = np.full(len(times), -1, np.int64)
    place[many] = np.arange(len(many))
    token = place[token]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, len(many), columns):
        here = (token >= a) & (token < a + columns)
        grid = np.zeros((len(sets), min(columns, len(many) - a)), np.float32)
        grid[owner[here], token[here] - a] = 1
        out += grid @ grid.T
    return out.astype(np.int64)


def linked(bucket: int, rows: list[tuple], across: bool, num: int, den: int) -> list[tuple[int, int, int]]:
    """(node, root, links) of the sets of one bucket or pair of blocks. rows: block, node, n_texts, others, tokens."""
    rows = [next(same) for _, same in itertools.groupby(sorted(rows, key=lambda r: r[1]), key=lambda r: r[1])]
    if len(rows) < 2:
        return []
    block, nodes, weight = (np.array(x, np.int64) for x in list(zip(*rows, strict=True))[:3])
    sets = [unsent(r[4]) for r in rows]
    size = np.array([len(s) for s in sets])
    # inter / (a + b - inter) >= num / den
    near = common(sets) * (num + den) >= num * (size[:, None] + size)
    np.fill_diagonal(near, False)
    if across:
        near &= block[:, None] != block
    if not near.any():
        return []
    others = [np.frombuffer(r[3], "<i8") for r in rows]
    earlier, at = np.unique(np.concatenate([o[o < bucket] for o in others]), return_inverse=True)
    own = near
    if len(earlier):
        held = np.zeros((len(rows), len(earlier)), np.float32)
        held[np.repeat(np.arange(len(rows)), [int((o < bucket).sum()) for o in others]), at] = 1
        own = near & (held @ held.T == 0)  # other pairs count in a bucket with a smaller number
    links = own @ weight
    label = np.arange(len(rows))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(rows)).min(1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = np.flatnonzero(near.any(1))
    return list(zip(nodes[keep].tolist(), nodes[label[keep]].tolist(), links[keep].tolist(), strict=True))


def _brute(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> pa.RecordBatch:
            rows = linked(key[0], held, key[1] != key[2], num, den)
            a, b, n = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.record_batch([pa.array(x, pa.int64()) for x in (a, b, n)], names=["node", "root", "links"])

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                for bucket, i, j, *row in zip(*(c.to_pylist() for c in batch.slice(a, 500).columns), strict=True):
                    if (bucket, i, j) != key:
                        if len(held) > 1:
                            yield out()
                        key, held = (bucket, i, j), []
                    held.append(row)
            trim()
        if len(held) > 1:
            yield out()

    return run


def _buckets(members: DataFrame, *more) -> DataFrame:
    """bucket, n (its size) and two marks of the members, for buckets of two or more. members: bucket, node."""
    return members.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"), *more).filter("n > 1")


def _members(nodes: DataFrame, text_of, small: int, spread: float) -> DataFrame:
    """node, buckets (bucket and size): the buckets to compare, written once. text_of: adds the texts to rows with a node."""
    held: list[DataFrame] = []

    def kept(df: DataFrame, name: str, narrow: bool = True) -> DataFrame:
        held.append(stored(df, name, narrow))
        return held[-1]

    level1 = nodes.select("node", F.explode("paths").alias("bucket")).distinct()
    sizes1 = kept(_buckets(level1), "sizes")
    total = nodes.agg(F.coalesce(F.sum(F.size("paths")), F.lit(0)).alias("n")).first().n
    large = sizes1.filter(F.col("n") > small)
    wide = kept(few_join(level1, large.select("bucket", "n"), "bucket", total), "wide")
    crowded = wide.groupBy("node").agg(F.count("*").alias("c")).join(nodes.select("node", F.size("paths").alias("p")), "node").select("node", (F.col("c") / F.col("p")).alias("share"))
    dense = F.avg("share").alias("share")

    def closed(sizes: DataFrame) -> DataFrame:
        return sizes.filter((F.col("n") <= small) | (F.col("share") >= DENSE))

    def still_open(sizes: DataFrame) -> DataFrame:
        return sizes.filter((F.col("n") > small) & (F.col("share") < DENSE)).select(F.col("bucket").alias("parent"), "n")

    marks = kept(_buckets(wide.join(crowded, "node"), dense), "wide_sizes")
    level, sizes = [level1], [sizes1.filter(F.col("n") <= small), closed(marks).drop("share")]
    split, deep = still_open(marks), None
    for k in range(2, LEVELS + 1):
        if split.isEmpty():
            break
        if k == 2:
            rows = nodes.select("node", F.explode(F.arrays_zip("kids", "parents")).alias("k")).select("node", F.col("k.kids").alias("bucket"), F.col("k.parents").alias("parent"))
        else:
            if deep is None:
                paths = few_join(level[-1].withColumnRenamed("bucket", "parent"), split, "parent", total).groupBy("node").agg(F.collect_list("parent").alias("paths"))
                deep = kept(text_of(paths).select("node", "paths", "text").mapInArrow(_deeper(spread), "node long, bucket long, parent long, level int"), "deep", narrow=False)
            rows = deep.filter(F.col("level") == k).drop("level")
        total = max(1, rows.count())
        level.append(kept(few_join(rows, split, "parent", total).select("node", "bucket").distinct(), "extended"))
        marks = kept(_buckets(level[-1].join(crowded, "node", "left").fillna(0.0, ["share"]), dense), "extended_sizes")
        sizes.append((closed(marks) if k < LEVELS else marks).drop("share"))
        split = still_open(marks)
    every = kept(reduce(DataFrame.unionByName, sizes), "buckets")
    once = every.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n", F.col("n").alias("size"))
    rows = reduce(DataFrame.unionByName, [x.select("node", "bucket") for x in level])
    found = hub_join(rows, once, "bucket", every.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("n")).first().n)
    out = stored(found.groupBy("node").agg(F.collect_list(F.struct("bucket", "size")).alias("buckets")), "members", narrow=True)
    forget(*held)
    return out


def signed(docs: DataFrame, similarity: float = 0.8, recall: float = 0.9995, spread: float = 1.75) -> DataFrame:
    """Each row's text key, node, set size, paths and number, written once."""
    rows = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("key"), "text")
    found = rows.mapInArrow(_signed(runs_for(recall, similarity, spread), spread), SIGNED)
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "signed")


def classes(docs: DataFrame, similarity: tuple[int, int] = (4, 5), recall: float = 0.9995, small: int = 512, spread: float = 1.75) -> DataFrame:
    """doc_id, key, class_id, n_links, n_shingles, root: one row per row of docs.

    class_id: the smallest doc_id of the class. n_links: different texts with similarity num / den or more.
    root: the class itself, also where rows of several classes share a doc_id; null without words.
    """
    num, den = similarity
    full = signed(docs, num / den, recall, spread)
    live = full.filter("n > 0")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "row")).alias("first")
    firsts = live.groupBy("node").agg(least, F.countDistinct("key").alias("n_texts"), F.count("*").alias("copies")).select("node", F.col("first.row").alias("row"), "n_texts", "copies")
    pathed = stored(live.join(firsts, ["node", "row"]).select("node", "doc_id", "key", "n_texts", "copies", "paths", "kids", "parents"), "paths", narrow=True)
    rows, nodes = stored(full.select("doc_id", "key", "node", "n"), "rows", narrow=True), stored(pathed.select("node", "doc_id", "key", "n_texts", "copies"), "nodes", narrow=True)
    forget(full)
    live = rows.filter("n > 0")
    total = live.count()
    texts = docs.select(F.col("doc_id").alias("own_id"), F.md5(F.coalesce("text", F.lit(""))).alias("own_key"), "text")

    def text_of(rows: DataFrame) -> DataFrame:
        wanted = nodes.select("node", "doc_id", "key", "n_texts").join(rows, "node")
        return texts.join(wanted, texts.own_id.eqNullSafe(wanted.doc_id) & (texts.own_key == wanted.key))

    members = _members(pathed, text_of, small, spread)
    forget(pathed)
    needed = text_of(members).select("node", "n_texts", "buckets", "text")
    sent = needed.mapInArrow(_sent(small), "bucket long, i int, j int, block int, node long, n_texts long, others binary, tokens binary")
    dealt = sent.repartition(partitions(docs.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = stored(dealt.mapInArrow(_brute(num, den), "node long, root long, links long"), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    by_node = nodes.select("node", "n_texts", "copies", F.col("doc_id").alias("least")).join(links, "node", "left").join(roots.withColumnRenamed("a", "node"), "node", "left")
    by_node = stored(by_node.select("node", "copies", (F.coalesce("links", F.lit(0)) + F.col("n_texts") - 1).alias("n_links"), "least", F.coalesce("root", "node").alias("root")), "by_node", narrow=True)
    heads = by_node.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least")).getField("least").alias("class_id"), F.count("*").alias("n"))
    by_class = stored(hub_join(by_node, heads, "root", by_node.count()).select("node", "n_links", "class_id", "root", F.col("copies").alias("n")), "by_class", narrow=True)
    some = hub_join(live.select("doc_id", "key", "node", F.col("n").alias("n_shingles")), by_class, "node", total).select("doc_id", "key", "class_id", "n_links", "n_shingles", "root")
    return some.union(rows.filter("n = 0").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long"), F.col("n"), F.lit(None).cast("long")))


def representatives(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each class: the one with the smallest doc_id (of equal ids the smallest text key)."""
    found = classes(docs, **how)
    lone = found.filter("n_shingles = 0").select("doc_id", "key").distinct()
    first = found.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("f")).select("f.doc_id", "f.key")
    keep = stored(lone.union(first), "kept", narrow=True).select(F.col("doc_id").alias("keep_id"), F.col("key").alias("keep_key"))
    own = F.md5(F.coalesce(docs["text"], F.lit("")))
    kept = docs.join(keep, docs["doc_id"].eqNullSafe(keep.keep_id) & (own == keep.keep_key), "left_semi")
    twice = docs.select("doc_id", own.alias("key")).groupBy("doc_id", "key").count().filter("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if twice else kept
