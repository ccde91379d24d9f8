"""Connected components of the crossing rules of one page; a page is one group."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quire.plans.folding import folded


def roots(edges: list[tuple]) -> dict:
    """The smallest member of each node's component."""
    parent: dict = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in parent}


def rule_components(crossings: DataFrame) -> DataFrame:
    """h_id and v_id of each page with the smallest h_id of their component."""

    def one(key: tuple, rows: list[tuple]) -> list[tuple]:
        found = roots([((0, h), (1, v)) for h, v in rows])
        return [(*key, "hv"[kind], i, root[1]) for (kind, i), root in found.items()]

    return folded(crossings.select("doc_id", "page_no", "h_id", "v_id"), ["doc_id", "page_no"], ["h_id", "v_id"], one, "doc_id long, page_no int, kind string, id long, root long")
