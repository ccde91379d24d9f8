"""Made files written to a folder that all executors share (a mount); nothing that is there is ever overwritten.

A file is written beside its place under a name of its own and then linked there, which fails if the name is taken: then
the name gets the time stamp, and then a number. A file of the same content that is already there counts as written, so a
task that runs again leaves no second one.
"""

from __future__ import annotations

import contextlib
import filecmp
import itertools
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def names(stem: str, end: str, stamp: str) -> Iterator[str]:
    yield f"{stem}{end}"
    yield f"{stem}-{stamp}{end}"
    yield from (f"{stem}-{stamp}-{n}{end}" for n in itertools.count(2))


def placed(folder: str, stem: str, end: str, stamp: str, content_for) -> str:
    """The path that the file got. content_for: its bytes for a file name without ending."""
    part = os.path.join(folder, f".{uuid.uuid4().hex}.part")
    for name in names(stem, end, stamp):
        path = os.path.join(folder, name)
        try:
            with open(part, "xb") as f:
                f.write(content_for(name.removesuffix(end)))
            with contextlib.suppress(FileExistsError):
                os.link(part, path)
                return path
            if filecmp.cmp(part, path, shallow=False):
                return path
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(part)
    raise AssertionError


def saved(books: DataFrame, folder: str, end: str, stamp: str, name: Column | None = None) -> DataFrame:
    """doc_id and path of each document, written as the rows are read. books: doc_id and content.

    name: file names without ending (the doc_id by default); signs that paths give a meaning become underscores.
    """
    stem = F.regexp_replace(F.col("doc_id").cast("string") if name is None else name, r"[/\\\x00-\x1f]|^\.+", "_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            rows = zip(batch.column("stem").to_pylist(), batch.column("content").to_pylist(), strict=True)
            paths = [placed(folder, s, end, stamp, lambda _, c=c: c) for s, c in rows]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(paths, pa.string())], names=["doc_id", "path"])

    return books.select("doc_id", stem.alias("stem"), "content").mapInArrow(run, "doc_id long, path string")


def saved_markdown(books: DataFrame, folder: str, stamp: str) -> DataFrame:
    """The same for sinks.markdown.books(): a text goes with its figures, in a folder beside it that has its name.

    Texts are named by doc_id; links follow if a text gets another name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths = []
            for doc, text, figures in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "markdown", "figures")), strict=True):
                old = text.partition(".assets/fig-1.png)")[0].rpartition("](")[2] if figures else ""
                path = placed(folder, str(doc), ".md", stamp, lambda stem, old=old, text=text: text.replace(f"]({old}.assets/", f"]({stem.replace(' ', '%20')}.assets/").encode())
                for k, png in enumerate(figures or (), 1):
                    assets = f"{path.removesuffix('.md')}.assets"
                    os.makedirs(assets, exist_ok=True)
                    with open(os.path.join(assets, f"fig-{k}.png"), "wb") as f:
                        f.write(png)
                paths.append(path)
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(paths, pa.string())], names=["doc_id", "path"])

    return books.select("doc_id", "markdown", "figures").mapInArrow(run, "doc_id long, path string")
