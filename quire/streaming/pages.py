"""Table continuation on a stream of pages: keyed by document, state is the open tables and the pages that wait."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame

from quire.operators.crosspage import Anchors

OUT = "doc_id long, page_no int, block int, kind string, table_no int"
STATE = "state string"


def continued_stream(blocks: DataFrame, wait: bool = False, most_waiting: int = 256) -> DataFrame:
    """Pieces of tables with their table numbers, after the policy of crosspage.Anchors, as crosspage.continued() has them.

    blocks: doc_id, page_no, block, kind (table, grid, text, figure or failed), starts. Pages are ordered inside a batch.
    With wait, a page that comes before one of its forerunners waits in the state until that one has come; every page then
    needs a row (compose.blocks_of gives one to pages without blocks). If more than most_waiting pages of a document wait,
    the page that they wait for is given up and the first of them goes on, so that state stays bounded.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"number": 0, "held": {}, "next": 1, "waiting": []}
        anchors = Anchors(held["number"], {kind: tuple(v) for kind, v in held["held"].items()})
        rows = [(int(r.page_no), int(r.block), r.kind, [float(x) for x in (r.starts if r.starts is not None else [])]) for f in frames for r in f.itertuples()]
        waiting = sorted([*map(tuple, held["waiting"]), *rows], key=lambda r: r[:2])
        pages = {no: [r[2:] for r in some] for no, some in groupby(waiting, key=lambda r: r[0])}
        out, due = [], held["next"]
        for no in sorted(pages):
            if wait and no > due and len(pages) <= most_waiting:
                break
            own = pages.pop(no)
            out += anchors.page(no, None if any(kind == "failed" for kind, _ in own) else [b for b in own if b[0] != "empty"])
            due = no + 1
        left = [(no, k, kind, starts) for no, some in pages.items() for k, (kind, starts) in enumerate(some)]
        state.update((json.dumps({"number": anchors.number, "held": anchors.held, "next": due, "waiting": left}),))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["doc_id", "page_no", "block", "kind", "table_no"])

    return blocks.groupBy("doc_id").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")
