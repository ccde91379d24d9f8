"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

Features are folded words and their five-byte prefixes, counted over the whole text; those whose log odds between toxic
and other texts stand out (root of the likelihood ratio of `least_z` or more) are kept, at most `most_features`. P(grade >= k) is
sigmoid(w.x - threshold_k) with one w for all k and increasing thresholds; the output is the expected severity, the sum
of these. Graded labels are taken as they are. Labels of 0 and 1 hold no grades; toxic texts then get grades 1 to 3 by
how many distinct strong features they have (thirds of the toxic sample), where the strong features are those of the
other half of the sample: no text is graded by features that it helped to choose. These grades measure how much toxic
wording a text holds, not a human judgement; `toxic` rests on the first threshold alone, which the labels fix.

The model is fitted on a bounded sample: `most_rows` labelled ids, by id hash, with one text each (of several under one
id the one with the least MD5), and of a text of more than `most_chars` characters one stretch of that length, at a place
that its hash chooses. So the driver receives most_rows * most_chars characters at most. Scores are of whole texts.

Defined cases: null or empty text has no features and so the severity of the intercepts; without labelled rows of both
kinds all severities are 0; an id with several labels has the highest; of equal likely grades the lowest is given; rows
with one doc_id, and repeated rows, are scored each; very long texts are scored whole; empty documents give no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.words import FOLDED, Words, chunks, mix, powers

RESULT = "doc_id long, severity double, p_toxic double, grade int, toxic boolean"
PREFIX = 5
#: Texts of the sample that are taken apart at once.
SLICE = 200


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes and their rows: each word, and the prefix of each longer word."""
    rows = words.rows()
    long = np.flatnonzero(words.ends - words.starts > PREFIX)
    up, down = powers(len(words.bytes) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((words.bytes.astype(np.uint64) + np.uint64(1)) * up[: len(words.bytes)], dtype=np.uint64)])
        start = words.starts[long]
        head = mix((sums[start + PREFIX] - sums[start]) * down[start] ^ np.uint64(0x5DEECE66D))
    return np.concatenate([words.hashes(), head]), np.concatenate([rows, rows[long]])


def counted(chosen: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and count of the chosen (sorted) features."""
    h, rows = features(words)
    gate = np.zeros(1 << 16, bool)
    gate[chosen >> np.uint64(48)] = True
    maybe = np.flatnonzero(gate[h >> np.uint64(48)])
    at = np.minimum(np.searchsorted(chosen, h[maybe]), len(chosen) - 1)
    good = chosen[at] == h[maybe]
    pair, n = np.unique(rows[maybe[good]] * len(chosen) + at[good], return_counts=True)
    return pair // len(chosen), pair % len(chosen), n


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def counts_of(texts: list[str], is_bad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features, and the bad and the other texts that have each; merged slice by slice."""
    names, counts = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    for a in range(0, len(texts), SLICE):
        h, rows = features(Words(pa.array(texts[a : a + SLICE], pa.large_string()), FOLDED))
        order = np.lexsort((rows, h))
        h, rows = h[order], rows[order]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])]) if len(h) else np.zeros(0, bool)
        h, bad = h[fresh], is_bad[a + rows[fresh]]
        own, inverse = np.unique(h, return_inverse=True)
        mine = np.stack([np.bincount(inverse, bad, len(own)), np.bincount(inverse, ~bad, len(own))], 1).astype(np.int64)
        place = np.minimum(np.searchsorted(names, own), max(0, len(names) - 1))
        known = names[place] == own if len(names) else np.zeros(len(own), bool)
        counts[place[known]] += mine[known]
        at = np.searchsorted(names, own[~known])
        names, counts = np.insert(names, at, own[~known]), np.insert(counts, at, mine[~known], axis=0)
    return names, counts[:, 0], counts[:, 1]


def signed_root(bad: np.ndarray, fine: np.ndarray, n_bad: int, n_fine: int) -> np.ndarray:
    """The signed root of the log-likelihood ratio of each feature: positive if it leans to the bad texts."""
    part = lambda k, n: np.where(k > 0, k * np.log(np.maximum(k, 1) / (n * (bad + fine) / (n_bad + n_fine))), 0)
    return np.sign(bad * n_fine - fine * n_bad) * np.sqrt(2 * np.maximum(0, part(bad, n_bad) + part(fine, n_fine)))


def strong_features(texts: list[str], y: np.ndarray, least_z: float) -> np.ndarray:
    """Of each text: its distinct features that lean to toxic texts in the half of the texts that it isn't in."""
    half = np.random.default_rng(11).permutation(len(y)) % 2
    out = np.zeros(len(y), np.int64)
    for side in (0, 1):
        mine, other = np.flatnonzero(half == side), np.flatnonzero(half != side)
        n_bad, n_fine = (y[other] > 0).sum(), (y[other] == 0).sum()
        if not n_bad or not n_fine:
            continue
        names, bad, fine = counts_of([texts[k] for k in other], y[other] > 0)
        chosen = names[signed_root(bad, fine, n_bad, n_fine) >= least_z]
        for a in range(0, len(mine) if len(chosen) else 0, SLICE):
            row, _, _ = counted(chosen, Words(pa.array([texts[k] for k in mine[a : a + SLICE]], pa.large_string()), FOLDED))
            out[mine[a : a + SLICE]] = np.bincount(row, minlength=len(mine[a : a + SLICE]))
    return out


def fitted(texts: list[str], labels: list[int], least_z: float = 4.5, most_features: int = 4096, grades: int = 3, steps: int = 600, penalty: float = 5e-6) -> dict | None:
    y = np.array(labels)
    if not (y > 0).any() or not (y == 0).any():
        return None
    names, bad, fine = counts_of(texts, y > 0)
    n_bad, n_fine = (y > 0).sum(), (y == 0).sum()
    z = signed_root(bad, fine, n_bad, n_fine)
    picked = np.flatnonzero(np.abs(z) >= least_z)
    picked = np.sort(picked[np.argsort(-np.abs(z[picked]), kind="stable")[:most_features]])
    if not len(picked):
        return None
    chosen = names[picked]
    parts = [(row + a, feature, n) for a in range(0, len(y), SLICE) for row, feature, n in [counted(chosen, Words(pa.array(texts[a : a + SLICE], pa.large_string()), FOLDED))]]
    row, feature, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    grade = np.minimum(y, grades)
    if y.max() == 1:
        strong = strong_features(texts, y, least_z)
        cuts = np.quantile(strong[y > 0], [k / grades for k in range(1, grades)])
        grade = np.where(y > 0, 1 + (strong[:, None] > cuts).sum(1), 0)
    x = 1 + np.log(n)
    w, base, gaps = np.zeros(len(chosen)), 1.0, np.zeros(grades - 1)
    m, v = np.zeros(len(chosen) + grades), np.zeros(len(chosen) + grades)
    for t in range(1, steps + 1):
        score = np.bincount(row, x * w[feature], len(y))
        theta = base + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        up = np.hstack([np.ones((len(y), 1)), sigmoid(score[:, None] - theta), np.zeros((len(y), 1))])  # P(grade >= k)
        slope = up * (1 - up)
        i = np.arange(len(y))
        p = np.maximum(up[i, grade] - up[i, grade + 1], 1e-9)
        ds = (slope[i, grade] - slope[i, grade + 1]) / p / len(y)
        dtheta = np.zeros((len(y), grades + 2))
        dtheta[i, grade] -= slope[i, grade] / p / len(y)
        dtheta[i, grade + 1] += slope[i, grade + 1] / p / len(y)
        dtheta = dtheta.sum(0)[1:-1]
        after = np.cumsum(dtheta[::-1])[::-1]
        g = -np.concatenate([np.bincount(feature, x * ds[row], len(chosen)) - penalty * w, [dtheta.sum()], after[1:] * np.exp(gaps)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, base, gaps = w - step[: len(chosen)], base - step[len(chosen)], gaps - step[len(chosen) + 1 :]
    return {"features": chosen, "w": w, "theta": base + np.concatenate([[0], np.cumsum(np.exp(gaps))])}


def scored(model: dict, column: pa.Array) -> np.ndarray:
    """P(grade >= k) for each text and k."""
    words = Words(column, FOLDED)
    row, feature, n = counted(model["features"], words)
    return sigmoid(np.bincount(row, (1 + np.log(n)) * model["w"][feature], len(words.counts))[:, None] - model["theta"])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in chunks(whole):
                up = scored(model, batch.column("text")) if model else np.zeros((batch.num_rows, 1))
                share = np.hstack([1 - up[:, :1], -np.diff(up, axis=1), up[:, -1:]])
                yield pa.record_batch(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(up.sum(1)), pa.array(up[:, 0]), pa.array(share.argmax(1).astype(np.int32)), pa.array(up[:, 0] >= 0.5)],
                    names=["doc_id", "severity", "p_toxic", "grade", "toxic"],
                )

    return run


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 6000, most_chars: int = 1 << 14) -> dict | None:
    """A model from a bounded sample of labelled rows, see above."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if not n:
        return None
    place = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30))
    sample = known.filter(place / F.lit(float(1 << 30)) < 1.2 * (most_rows + 100) / n).orderBy(place, "doc_id").limit(most_rows)
    found = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    one = found.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.md5("text")))).filter("nth = 1")
    stretch = F.when(F.length("text") > most_chars, F.expr(f"substring(text, cast(1 + pmod(xxhash64(text), length(text) - {most_chars} + 1) as int), {most_chars})")).otherwise(F.col("text"))
    rows = one.select("doc_id", "toxic", stretch.alias("text")).toArrow().sort_by("doc_id")
    return fitted(rows["text"].to_pylist(), rows["toxic"].to_pylist()) if rows.num_rows else None


def graded(docs: DataFrame, model: dict | None) -> DataFrame:
    """One row per row of docs; see RESULT. No shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), RESULT)
