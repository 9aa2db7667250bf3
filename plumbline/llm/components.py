"""Connected components by contraction of the link table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of ``edges(u, v)``; component is the smallest node reachable.

    Each round points every node at the smallest of itself and its neighbours, then rewrites the links
    between the nodes pointed at. The smallest node of a component points at itself in every round, so what
    remains once no link is left is the answer. Every round at least halves a path, and a star takes one.
    All steps are equi-joins and partial aggregates, so a node with very many links is split by adaptive
    execution and nothing but an emptiness flag comes to the driver. Null ends and loops are ignored; an
    empty table gives an empty table.
    """
    clean = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    live = scratch.save(clean.where("u is not null and v is not null and u <> v").distinct(), "links")
    assigned = None
    while True:
        both = live.select("u", "v").unionAll(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "parents")
        if assigned is None:
            mapped = parent.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            mapped = (
                assigned.join(parent, assigned.component == parent.u, "left")
                .select("node", F.coalesce("p", "component").alias("component"))
            )
        new_assigned = scratch.save(mapped, "assigned")
        left = parent.select(F.col("u"), F.col("p").alias("pu"))
        right = parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        new_live = scratch.save(
            live.join(left, "u").join(right, "v").where("pu <> pv")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "links")
        for old in (live, parent, assigned):
            scratch.drop(old)
        live, assigned = new_live, new_assigned
        if live.isEmpty():
            scratch.drop(live)
            return assigned


def forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links of one task."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        a, b = root(x), root(y)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((x, y))
    return out
