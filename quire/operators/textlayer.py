"""The text layer of pages: characters to items, in one exchange and one fold.

Before the exchange, the characters that a task has of one page are packed into one row, so that pages move, not
characters. After it, whole pages are unpacked and folded.

Rows of a page are found from the top down: a character belongs to the last row if its centre is less than half of the
lower height (of the row's whole extent, or its own) away from the row's centre. Characters that share their top and foot
are taken at once, so the walk takes a step for each height on a line, not for each character; everything else is
vectorised over whole batches of pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.config import BREAK_SIZES, RULE_HIGH, RULE_SLIM, RULE_WIDE
from quire.plans.folding import dealt

PAGE = ("doc_id", "page_no")
ITEMS = "doc_id long, page_no int, row int, seg int, seq int, t string, x0 double, y0 double, x1 double, y1 double, s double"
_GIVEN = ("doc_id", "page_no", "seq", "c", "x0", "y0", "x1", "y1", "size")


def real_chars(chars: DataFrame) -> DataFrame:
    """Characters that stand on the page, as upright boxes. chars: doc_id, page_no, seq, c, generated, ax, ay, bx, by (two corners) and size.

    Control characters, and those that the reader made up for line ends and alignment, go.
    """
    own = chars.filter(F.col("c").isNotNull() & ~F.col("c").rlike(r"^\p{Cc}") & ~F.coalesce("generated", F.lit(False)))
    return own.select(*PAGE, "seq", "c", *_upright(), "size")


def standing_rules(paths: DataFrame) -> DataFrame:
    """x, y0 and y1 of the long thin upright paths of pages; fills and frames are too wide. paths: doc_id, page_no, ax, ay, bx, by."""
    boxes = paths.select(*PAGE, *_upright())
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return boxes.filter((high >= RULE_HIGH) & (wide <= RULE_WIDE) & (wide <= RULE_SLIM * high)).select(*PAGE, ((F.col("x0") + F.col("x1")) / 2).alias("x"), "y0", "y1")


def _upright() -> list:
    return [F.least("ax", "bx").alias("x0"), F.least("ay", "by").alias("y0"), F.greatest("ax", "bx").alias("x1"), F.greatest("ay", "by").alias("y1")]


def _order(*keys: np.ndarray) -> np.ndarray:
    """np.lexsort, which takes far longer than seeing that rows are in order, as they mostly come."""
    less, same = np.zeros(max(len(keys[0]) - 1, 0), bool), np.ones(max(len(keys[0]) - 1, 0), bool)
    for key in reversed(keys):
        less |= same & (key[:-1] < key[1:])
        same &= key[:-1] == key[1:]
    return np.arange(len(keys[0])) if (less | same).all() else np.lexsort(keys)


def _rows(y0: np.ndarray, y1: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each character, and the rows' tops and feet. Characters come by page and centre."""
    new = np.flatnonzero(np.concatenate([[True], (y0[1:] != y0[:-1]) | (y1[1:] != y1[:-1]) | (page[1:] != page[:-1])]))
    tops, feet, labels = [], [], []
    at = None
    for a, b, own in zip(y0[new].tolist(), y1[new].tolist(), page[new].tolist(), strict=True):
        if at == own:
            top, foot = tops[-1], feet[-1]
            reach = 0.5 * max(min(foot - top, b - a), 1.0)
            if abs((top + foot) / 2 - (a + b) / 2) < reach:
                tops[-1], feet[-1] = min(top, a), max(foot, b)
                labels.append(len(tops) - 1)
                continue
        at = own
        tops.append(a)
        feet.append(b)
        labels.append(len(tops) - 1)
    return np.repeat(labels, np.diff(new, append=len(y0))), np.array(tops), np.array(feet)


def _parted(row: np.ndarray, middle: np.ndarray, page: np.ndarray, centre: np.ndarray, rules: dict[int, np.ndarray]) -> np.ndarray:
    """For each character and the next of its row: whether a rule stands between their middles. rules: x, y0, y1 by page."""
    out = np.zeros(len(row), bool)
    held = np.isin(page, list(rules))
    for k in np.unique(row[held]).tolist():
        here = np.flatnonzero(row == k)
        own = rules[int(page[here[0]])]
        xs = np.sort(own[(own[:, 1] <= centre[k]) & (centre[k] <= own[:, 2]), 0])
        out[here[1:]] = np.searchsorted(xs, middle[here[1:]], "left") > np.searchsorted(xs, middle[here[:-1]], "right")
    return out


def _items(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The items of whole pages. Rows without a character are rules."""
    number = lambda name, rows: rows.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
    is_rule = pc.is_null(batch.column("c")).to_numpy(zero_copy_only=False)
    doc, no = (batch.column(c).to_numpy(zero_copy_only=False) for c in PAGE)
    page = np.cumsum(np.concatenate([[True], (doc[1:] != doc[:-1]) | (no[1:] != no[:-1])])) if len(doc) else doc
    rules: dict[int, np.ndarray] = {}
    if is_rule.any():
        lines = np.stack([number(c, batch)[is_rule] for c in ("x0", "y0", "y1")], 1)
        own = page[is_rule]
        rules = {int(p): lines[own == p] for p in np.unique(own).tolist()}
        batch, page = batch.filter(pa.array(~is_rule)), page[~is_rule]
    x0, y0, x1, y1, size, seq = (number(c, batch) for c in ("x0", "y0", "x1", "y1", "size", "seq"))
    if not len(x0):
        return pa.RecordBatch.from_pylist([], _SCHEMA)
    down = _order(seq, x0, (y0 + y1) / 2, page)
    row = np.zeros(len(x0), np.int64)
    row[down], tops, feet = _rows(y0[down], y1[down], page[down])
    order = _order(seq, x0, row)
    row, page, x0, y0, x1, y1, size = (v[order] for v in (row, page, x0, y0, x1, y1, size))
    gap = np.concatenate([[0.0], x0[1:] - x1[:-1]]) > BREAK_SIZES * np.maximum(np.maximum(size, np.concatenate([[0.0], size[:-1]])), 1.0)
    first = np.concatenate([[True], row[1:] != row[:-1]])
    begins = np.flatnonzero(first | gap | (_parted(row, (x0 + x1) / 2, page, (tops + feet) / 2, rules) if rules else False))
    chars = pc.take(batch.column("c"), pa.array(order)).cast(pa.large_string())
    _, offsets, data = chars.buffers()
    cuts = np.frombuffer(offsets, np.int64, len(chars) + 1, chars.offset * 8)[np.append(begins, len(chars))]
    text = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(np.ascontiguousarray(cuts)), data]).cast(pa.string())
    own, first_row = row[begins], np.searchsorted(page, page[begins])
    nth = np.arange(len(begins)) - np.searchsorted(own, own) + 1
    seq = np.arange(len(begins)) - np.searchsorted(page[begins], page[begins])
    ids = [batch.column(c).take(pa.array(order[begins])) for c in PAGE]
    extent = [f.reduceat(v, begins) for f, v in ((np.minimum, x0), (np.minimum, y0), (np.maximum, x1), (np.maximum, y1))]
    columns = [*ids, pa.array((own - row[first_row] + 1).astype(np.int32)), pa.array(nth.astype(np.int32)), pa.array(seq.astype(np.int32)), text, *map(pa.array, extent), pa.array(np.ones(len(begins)))]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA).filter(pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(text)), 0))


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
_SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in ITEMS.split(", "))])
#: Characters that are gathered before they are packed, and before a fold.
ENOUGH = 100_000
PACKED = "doc_id long, page_no int, n int, chars binary"
#: Before a packed page's bytes: how many characters, bytes before compression, bytes of a length; of each number its kind, bytes of a step and first.
_NUMBERS, _SCALES = ("seq", "x0", "y0", "x1", "y1", "size"), (1, 1024)
_HEAD = np.dtype([("n", "i4"), ("size", "i8"), ("length", "i1"), ("kind", "i1", 6), ("width", "i1", 6), ("first", "i8", 6)])
_CODEC = pa.Codec("zstd", 1)
_CHARS = pa.schema([("seq", pa.int64()), ("c", pa.string()), *[(c, pa.float64()) for c in ("x0", "y0", "x1", "y1", "size")]])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= ENOUGH:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _narrow(v: np.ndarray, first: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Numbers as steps of few bytes from one to the next, and the first of each page: kind, firsts, steps (0 at a page's first).

    Kinds 0 to 2: whole numbers, multiples of 1/1024, bits of doubles. Steps of 64 bits wrap around, so nothing is lost.
    """
    for kind, k in enumerate(_SCALES):
        scaled = v * k
        if (np.abs(scaled) < 1 << 52).all():
            bits = scaled.astype(np.int64)
            if ((bits / k).view(np.int64) == v.view(np.int64)).all():
                break
    else:
        kind, bits = len(_SCALES), v.view(np.int64)
    steps = np.diff(bits, prepend=bits[:1])
    steps[first] = 0
    return kind, bits[first], steps.astype(_least(steps))


def _least(v: np.ndarray) -> np.dtype:
    """The smallest signed type for whole numbers."""
    low, high = (int(v.min()), int(v.max())) if len(v) else (0, 0)
    return next(np.dtype(t) for t in ("i1", "i2", "i4", "i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)


def packed(table: pa.Table) -> pa.RecordBatch:
    """Characters (doc_id, page_no and the columns of a character) as rows of PACKED: a row for each page.

    Its bytes are _HEAD and, compressed, the texts' lengths in bytes (-1: null), the steps of each number and the texts:
    neighbours on a line differ little, so a page takes about as much as its text.
    """
    doc, no = (table.column(c).to_numpy() for c in PAGE)
    order = np.lexsort((no, doc))
    if (np.diff(order) < 0).any():
        table, doc, no = table.take(pa.array(order)), doc[order], no[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (no[1:] != no[:-1])])) if len(doc) else np.zeros(0, np.int64)
    n = np.diff(first, append=len(doc))
    text = pc.fill_null(table.column("c").cast(pa.large_string()), "").combine_chunks()
    _, offsets, data = text.buffers()
    ends = np.frombuffer(offsets, np.int64, len(text) + 1, text.offset * 8)
    length = np.where(table.column("c").is_null().to_numpy(), -1, np.diff(ends))
    length = length.astype(_least(length))
    numbers = [_narrow(np.ascontiguousarray(table.column(c).cast(pa.float64()).to_numpy()), first) for c in _NUMBERS]
    head = np.zeros(len(first), _HEAD)
    head["n"], head["length"] = n, length.itemsize
    for k, (kind, firsts, steps) in enumerate(numbers):
        head["kind"][:, k], head["first"][:, k], head["width"][:, k] = kind, firsts, steps.itemsize
    columns = [memoryview(v).cast("B") for v in (length, *(steps for *_, steps in numbers))]
    widths = [length.itemsize, *(steps.itemsize for *_, steps in numbers)]
    texts = memoryview(data).cast("B") if data is not None else memoryview(b"")
    raw = [b"".join([*(v[a * w : (a + k) * w] for v, w in zip(columns, widths, strict=True)), texts[ends[a] : ends[a + k]]]) for a, k in zip(first.tolist(), n.tolist(), strict=True)]
    head["size"] = list(map(len, raw))
    blobs = [h.tobytes() + _CODEC.compress(r, asbytes=True) for h, r in zip(head, raw, strict=True)]
    return pa.record_batch([pa.array(doc[first], pa.int64()), pa.array(no[first], pa.int32()), pa.array(n, pa.int32()), pa.array(blobs, pa.binary())], names=["doc_id", "page_no", "n", "chars"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from map(packed, _gathered(batches))


def _unpacked(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    """The characters of packed rows, with their pages."""
    doc, no, n = (np.array([r[k] for r in rows]) for k in range(3))
    head = np.concatenate([np.frombuffer(blob, _HEAD, 1) for *_, blob in rows])
    parts: list[list[np.ndarray]] = [[] for _ in range(len(_NUMBERS) + 1)]
    texts = []
    for (*_, k, blob), size, widths in zip(rows, head["size"].tolist(), np.column_stack((head["length"], head["width"])).tolist(), strict=True):
        raw, at = _CODEC.decompress(memoryview(blob)[_HEAD.itemsize :], size), 0
        for part, w in zip(parts, widths, strict=True):
            part.append(np.frombuffer(raw, f"i{w}", k, at))
            at += k * w
        texts.append(memoryview(raw)[at:])
    length = np.concatenate(parts[0]).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(np.maximum(length, 0))))
    null = pa.py_buffer(np.packbits(length >= 0, bitorder="little")) if (length < 0).any() else None
    columns = {"c": pa.Array.from_buffers(pa.large_string(), len(length), [null, pa.py_buffer(offsets), pa.py_buffer(b"".join(texts))]).cast(pa.string())}
    first = np.cumsum(n) - n
    for k, name in enumerate(_NUMBERS):
        steps = np.cumsum(np.concatenate(parts[k + 1]).astype(np.int64))
        bits, kind = steps + np.repeat(head["first"][:, k] - steps[first], n), head["kind"][:, k]
        some = [(bits.view(np.float64) if j == len(_SCALES) else bits / _SCALES[j]) for j in np.unique(kind).tolist()]
        columns[name] = some[0] if len(some) == 1 else np.select([np.repeat(kind == j, n) for j in np.unique(kind).tolist()], some)
    whole = {"doc_id": pa.array(np.repeat(doc, n), pa.int64()), "page_no": pa.array(np.repeat(no, n), pa.int32()), **{name: columns[name] for name in _CHARS.names}}
    return pa.record_batch(whole)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int, int, bytes]] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page_no", "n", "chars")), strict=True):
            if size >= ENOUGH and row[:2] != held[-1][:2]:
                yield _items(_unpacked(held))
                held, size = [], 0
            held.append(row)
            size += row[2]
    if held:
        yield _items(_unpacked(held))


def segments(chars: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Items from characters: a row breaks at wide gaps, and where a standing rule lies between two characters' middles.

    chars: doc_id, page_no, seq, c, x0, y0, x1, y1, size. rules: doc_id, page_no, x, y0, y1.
    """
    rows = chars.select(*_GIVEN)
    if rules is not None:
        kinds = dict(rows.dtypes)
        line = {"seq": F.lit(-1), "c": F.lit(None), "x0": F.col("x"), "x1": F.col("x"), "size": F.lit(0)}
        rows = rows.union(rules.select(*[line.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in _GIVEN]))
    return segments_packed(rows.mapInArrow(_packed, PACKED))


def segments_packed(pages: DataFrame) -> DataFrame:
    """Items of characters in rows of PACKED, of which a page may have several: the form in which a reader in Python hands them over."""
    return dealt(pages, *PAGE).sortWithinPartitions(*PAGE).mapInArrow(_folded, ITEMS)


def segments_of(pages: DataFrame) -> DataFrame:
    """Items of pages that hold their characters as an array, as sources.render gives them: nothing moves.

    pages: doc_id, page_no, chars (array of c, x0, y0, x1, y1, size, in the order of seq) and, where there are rules, rules
    (array of x, y0, y1).
    """
    ruled = "rules" in pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, no = (batch.column(c).to_numpy(zero_copy_only=False) for c in PAGE)
            parts = []
            for name in ("chars", "rules") if ruled else ("chars",):
                lists = batch.column(name)
                n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                flat = lists.flatten()
                column = lambda c, flat=flat: flat.field(c)
                seq = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                number = lambda c: column(c).cast(pa.float64())
                if name == "chars":
                    own = [pa.array(seq), column("c"), *map(number, ("x0", "y0", "x1", "y1", "size"))]
                else:
                    own = [pa.array(seq), pa.nulls(len(flat), pa.string()), number("x"), number("y0"), number("x"), number("y1"), pa.array(np.zeros(len(flat)))]
                parts.append(pa.table([pa.array(np.repeat(doc, n), pa.int64()), pa.array(np.repeat(no, n), pa.int32()), *own], names=[*PAGE, *_CHARS.names]))
            table = pa.concat_tables(parts)
            if ruled:
                table = table.take(pa.array(np.lexsort((table.column("page_no").to_numpy(), table.column("doc_id").to_numpy()))))
            if table.num_rows:
                yield _items(table.combine_chunks().to_batches()[0])

    return pages.select(*PAGE, "chars", *(["rules"] if ruled else [])).mapInArrow(run, ITEMS)
