"""Distributed union-find.

Each round every task first unites its own edges (a spanning forest of them remains), then every node
hooks onto its smallest neighbour, the hooks are shortened by pointer jumping, and the edges are drawn
again between the roots so far. Rounds are written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.session import materialize, ship

#: Edges that a task unites at a time.
CHUNK = 200_000


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its part) that join what the given edges join."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b, n = [], [], 0

    def out() -> pa.RecordBatch:
        u, v = _forest(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        if batch.num_rows:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
            n += batch.num_rows
        if n >= CHUNK:
            yield out()
            a, b, n = [], [], 0
    if n:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges (u, v); a component is named by its smallest node.

    Self loops and repeated edges are harmless; no edges give no rows. Nothing is collected but counts.
    """
    spark = edges.sparkSession
    ship(spark)
    empty = spark.createDataFrame([], "id long, component long")
    now = materialize(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u != v").mapInArrow(_unite, "u long, v long"), "edges")
    levels: list[DataFrame] = []
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p"))
        hooks = materialize(hooks, "hooks")
        for _ in range(2):  # p of p; roots hook onto themselves
            up = hooks.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            hooks = hooks.join(up, "p").select("u", F.col("pp").alias("p"))
        hooks = materialize(hooks, "jumps")
        levels.append(hooks)
        mapped = now.join(hooks.select("u", F.col("p").alias("pu")), "u").select("pu", "v")
        mapped = mapped.join(hooks.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v").select(F.col("pu").alias("u"), F.col("pv").alias("v"))
        now = materialize(mapped.filter("u != v").mapInArrow(_unite, "u long, v long").distinct(), "edges")
    if not levels:
        return empty
    # From the last, smallest level down, so that the nodes themselves are joined once.
    upper = None
    for level in reversed(levels):
        named = level.select(F.col("u").alias("id"), F.col("p").alias("component"))
        if upper is not None:
            above = upper.select(F.col("id").alias("component"), F.col("component").alias("top"))
            named = named.join(above, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
        upper = named
    # Names are the smallest node already: hooks only go down, and the last round left no edge.
    return materialize(upper, "components")


def extended(known: DataFrame, edges: DataFrame) -> DataFrame:
    """``components`` of the edges behind ``known`` and further ``edges`` (u, v): only the classes that those join are looked at."""
    for side in ("u", "v"):
        edges = edges.join(known.select(F.col("id").alias(side), F.col("component").alias(f"c{side}")), side, "left")
    upper = components(edges.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")))
    above = upper.select(F.col("id").alias("component"), F.col("component").alias("top"))
    old = known.join(above, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    # A class is named by a node of its own, so other ids are nodes that had no edge so far.
    new = upper.join(known.select(F.col("component").alias("id")).distinct(), "id", "left_anti")
    return materialize(old.unionByName(new), "components")
