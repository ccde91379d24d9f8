"""Language identification by a byte convolutional network in numpy.

A text is cut into windows of `length` bytes (the last one ends with the text; a shorter text is padded). Bytes are
embedded, convolved with filters of widths 2, 3 and 4, max-pooled over the window, rectified, and classified by a
softmax layer. A document's prediction is the mean over all of its windows. At prediction, embedding and filters are
folded into one table for each offset, so a convolution is four table look-ups.

The network is trained on a bounded sample: of each language `per_lang` labelled rows that are not held out, by hash; of
each of these up to `doc_windows` windows drawn from its whole text, where they are cut; of each language up to
`lang_windows` of those. So the driver receives at most per_lang * doc_windows windows a language, whatever the lengths of
texts and however often a doc_id repeats. Held out: crc32 of doc_id as text is a multiple of 5.

Defined cases: text that is null or has no letter (Unicode categories L*) is `und` with score 0; where no row is
labelled, identified() finds `und` everywhere and accepted() keeps every text with a letter, its lang as it was; very
long texts are judged by all of their windows; of equal probabilities the language that sorts first wins; a null doc_id
hashes as the empty text; rows with a null language train nothing; repeated rows are judged each; an empty table gives no
rows; other columns are ignored by identified() and kept by accepted().
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.words import chunks, raw

RESULT = "doc_id long, held_out boolean, lang_pred string, score double, windows long"
WIDTHS, FILTERS, EMBED = (2, 3, 4), 16, 8
_LETTER = regex.compile(r"\p{L}")
LENGTH = 192
_ALL = FILTERS * len(WIDTHS)
#: Columns of the folded tables that offset k contributes to: filters wider than k.
_FROM = [next((i for i, w in enumerate(WIDTHS) if w > k), 0) * FILTERS for k in range(WIDTHS[-1])]


def windows(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every window; an empty text has none."""
    sizes = np.diff(offsets)
    counts = -(-sizes // length)
    rows = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[rows] + np.maximum(0, np.minimum(nth * length, sizes[rows] - length))
    return start, np.minimum(start + length, offsets[rows + 1]), rows


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    at = start[:, None] + np.arange(length + WIDTHS[-1] - 1)
    return np.where(at < end[:, None], data[np.minimum(at, len(data) - 1)], 0)


class Net:
    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), "bias": np.zeros(_ALL, np.float32), "out": draw(_ALL, classes), "out_bias": np.zeros(classes, np.float32)}
        self.p |= {f"w{k}": draw(EMBED, _ALL - _FROM[k]) for k in range(WIDTHS[-1])}

    def tables(self) -> list[np.ndarray]:
        return [self.p["embed"] @ self.p[f"w{k}"] for k in range(WIDTHS[-1])]

    @staticmethod
    def convolved(tables: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        n = x.shape[1] - WIDTHS[-1] + 1
        out = tables[0][x[:, :n]]
        for k in range(1, WIDTHS[-1]):
            out[:, :, _FROM[k] :] += tables[k][x[:, k : k + n]]
        return out

    def classified(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.p["bias"], 0) @ self.p["out"] + self.p["out_bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        conv = self.convolved(self.tables(), x)
        best = conv.argmax(1)
        pooled = np.take_along_axis(conv, best[:, None], 1)[:, 0]
        hidden = np.maximum(pooled + self.p["bias"], 0)
        dz = self.classified(pooled)
        dz[np.arange(len(y)), y] -= 1
        dz /= len(y)
        dh = (dz @ self.p["out"].T) * (hidden > 0)
        g = {"out": hidden.T @ dz, "out_bias": dz.sum(0), "bias": dh.sum(0), "embed": np.zeros_like(self.p["embed"])}
        for k in range(WIDTHS[-1]):
            size = _ALL - _FROM[k]
            hit = np.take_along_axis(x, best[:, _FROM[k] :] + k, 1).astype(np.int64)
            dt = np.bincount((hit * size + np.arange(size)).ravel(), dh[:, _FROM[k] :].ravel(), 256 * size).reshape(256, size).astype(np.float32)
            g[f"w{k}"] = self.p["embed"].T @ dt
            g["embed"] += dt @ self.p[f"w{k}"].T
        return g


def trained(x: np.ndarray, langs: list[str], length: int = LENGTH, epochs: int = 8, seed: int = 7) -> dict:
    """A model of labelled windows (a row of bytes each): its network and languages."""
    names = sorted(set(langs))
    y = np.searchsorted(names, np.array(langs, object).astype(str))
    rng = np.random.default_rng(seed)
    net, m, v, t = Net(len(names), seed), {}, {}, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 128):
            t += 1
            some = order[a : a + 128]
            for k, g in net.gradients(x[some], y[some]).items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                net.p[k] -= (0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return {"net": net, "langs": names, "length": length}


def predicted(model: dict, column: pa.Array, block: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mean class probabilities, and the windows, of each text."""
    data, offsets = raw(column)
    net, length = model["net"], model["length"]
    tables = net.tables()
    start, end, rows = windows(data, offsets, length)
    total = np.zeros((len(offsets) - 1, len(model["langs"])))
    for a in range(0, len(start), block):
        x = gathered(data, start[a : a + block], end[a : a + block], length)
        np.add.at(total, rows[a : a + block], net.classified(net.convolved(tables, x).max(1)))
    count = np.bincount(rows, minlength=len(total))
    return total / np.maximum(count, 1)[:, None], count, total


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in chunks(whole):
                yield _labelled(model, batch)

    return run


def _labelled(model: dict | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0 for i in ids.to_pylist()]
    lang, score, count = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    if model:
        mean, count, _ = predicted(model, batch.column("text"))
        best = mean.argmax(1)
        for row, text in enumerate(texts):
            if text and _LETTER.search(text):
                lang[row], score[row] = model["langs"][best[row]], min(1.0, mean[row, best[row]])
    return pa.record_batch([ids.cast(pa.int64()), pa.array(held), pa.array(lang, pa.string()), pa.array(score), pa.array(count.astype(np.int64))], names=["doc_id", "held_out", "lang_pred", "score", "windows"])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _cut(length: int, most: int):
    """Up to `most` windows of each text, drawn by a hash of the text, as rows of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                data, offsets = raw(batch.column("text"))
                start, end, rows = windows(data, offsets, length)
                picked = []
                for row, (a, b) in enumerate(zip(np.searchsorted(rows, np.arange(batch.num_rows)), np.searchsorted(rows, np.arange(batch.num_rows), "right"), strict=True)):
                    seed = zlib.crc32(data[offsets[row] : offsets[row + 1]])
                    picked.append(a + np.sort(np.random.default_rng(seed).permutation(b - a)[:most]))
                pick = np.concatenate(picked) if picked else np.zeros(0, np.int64)
                x = gathered(data, start[pick], end[pick], length) if len(pick) else np.zeros((0, length + WIDTHS[-1] - 1), np.uint8)
                yield pa.record_batch([batch.column("lang").take(pa.array(rows[pick])), pa.array([r.tobytes() for r in x.astype(np.uint8)], pa.binary())], names=["lang", "window"])

    return run


def fit(docs: DataFrame, per_lang: int = 300, doc_windows: int = 40, lang_windows: int = 1500, length: int = LENGTH) -> dict | None:
    """A model from a bounded sample of labelled rows, see above; None if no row is labelled or none has a byte."""
    known = docs.filter(F.col("lang").isNotNull() & (F.octet_length("text") > 0) & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    counts = docs.sparkSession.createDataFrame([(r.lang, r.n) for r in known.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()], "lang string, n long")  # a row a class of the model
    place = F.pmod(F.xxhash64(F.lit("byte_cnn"), "doc_id", "text"), F.lit(1 << 30))
    likely = known.join(F.broadcast(counts), "lang").withColumn("place", place).filter(F.col("place") / F.lit(float(1 << 30)) < F.lit(1.5 * per_lang + 50) / F.col("n"))
    first = likely.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "text"))).filter(F.col("nth") <= per_lang)
    rows = first.select("lang", "text").mapInArrow(_cut(length, doc_windows), "lang string, window binary").toArrow()
    if not rows.num_rows:
        return None
    order = np.lexsort((np.array(rows["window"].to_pylist(), object), np.array(rows["lang"].to_pylist(), object)))
    langs, x = np.array(rows["lang"].to_pylist(), object)[order], np.frombuffer(b"".join(rows["window"].to_pylist()), np.uint8).reshape(len(order), -1)[order]
    mixed = np.random.default_rng(7).permutation(len(x))
    keep = np.concatenate([mixed[langs[mixed] == name][:lang_windows] for name in sorted(set(langs))])
    return trained(x[np.sort(keep)], langs[np.sort(keep)].tolist(), length)


def identified(docs: DataFrame, model: dict | None) -> DataFrame:
    """One row per row of docs; see RESULT. No shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), RESULT)


def accepted(docs: DataFrame, model: dict | None, least: float = 0.5) -> DataFrame:
    """docs without the texts that are `und` or score below least; lang becomes the prediction.

    Without a model no language can be told: texts with a letter stay, as they are.
    """

    def run(batches: Iterator[pa.RecordBatch], shared=docs.sparkSession.sparkContext.broadcast(model)) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                if shared.value is None:
                    yield batch.filter(pa.array([bool(x and _LETTER.search(x)) for x in batch.column("text").to_pylist()], pa.bool_()))
                    continue
                found = _labelled(shared.value, batch)
                keep = [p != "und" and s >= least for p, s in zip(found.column("lang_pred").to_pylist(), found.column("score").to_pylist(), strict=True)]
                columns = {n: batch.column(n) for n in batch.schema.names}
                if "lang" in columns:
                    columns["lang"] = found.column("lang_pred")
                yield pa.RecordBatch.from_pydict(columns).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
