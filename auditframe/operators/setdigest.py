"""An exact digest of a set of rows, the same for any order and partitioning (SRC5, SRC18, GV5).

Rows are leaves of a tree: equal entries become one leaf with their count, so none cancels another; a
leaf's place is the beginning of its own digest. The digests of all leaves of a place, sorted and each
with its length before it, make the digest of that place, places make those of a shorter beginning, up to the
root. No list is longer than about ``FAN`` digests, whatever the number of rows; where a layout of few
places is asked for, the digests of a place stream through its hash instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.session import materialize, ship

#: Digests that one node of the tree is made of, about.
FAN = 4_096


def framed(*parts: Column) -> Column:
    """Parts one after another, each with its length in bytes before it, so that no two lists of parts are the same text."""
    pieces = [x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]
    return F.concat(*pieces)


def _node(digests: Column) -> Column:
    """The digest of a sorted list of digests of 64 characters."""
    return F.sha2(F.concat(F.size(digests).cast("string"), F.lit("|"), F.array_join(F.transform(F.array_sort(digests), lambda d: F.concat(F.lit("64:"), d)), "")), 256)


def levels(n: int) -> list[int]:
    """How many digits of a leaf's digest name its place at each level, from the longest to none, for ``n`` leaves."""
    digits = 0
    while n > FAN * 16**digits and digits < 12:
        digits += 1
    found = [digits]
    while found[-1] > 0:
        found.append(max(0, found[-1] - 3))
    return found


def set_digest(rows: DataFrame, entry: Column, keys: list[str] | None = None, name: str = "set_sha256", n: int | None = None, most_digits: int | None = None) -> DataFrame:
    """(keys, n_entries, digest) of the texts ``entry``; without keys of all rows, in one row even if there are none.

    ``n`` is the number of rows of the largest key if it is known; it is counted otherwise and decides the
    depth of the tree, so it must be the same number for digests that are compared. With ``most_digits`` (without keys
    only) places are named by so many digits at most, however many leaves there are.
    """
    if keys and most_digits is not None:
        raise ValueError("most_digits is for sets without keys")
    keys = keys or []
    leaves = rows.select(*keys, F.sha2(entry, 256).alias("__d")).groupBy(*keys, "__d").agg(F.count("*").alias("__n"))
    leaves = leaves.select(*keys, "__n", F.sha2(framed(F.col("__d"), F.col("__n").cast("string")), 256).alias("__d"))
    if most_digits is not None:
        leaves = materialize(leaves, "leaves")
    if n is None:
        most = leaves.groupBy(*keys).agg(F.count("*").alias("c")).agg(F.max("c")).first()[0]
        n = most or 0
    nodes, depths = leaves.withColumn("__p", F.col("__d")), levels(n)
    if most_digits is not None and depths[0] > most_digits:
        nodes, depths = _streamed(leaves, most_digits), [d for d in depths[1:] if d < most_digits] or [0]
    for digits in depths:
        place = F.substring("__p", 1, digits) if digits else F.lit("")
        nodes = nodes.withColumn("__p", place).groupBy(*keys, "__p").agg(F.sum("__n").alias("__n"), _node(F.collect_list("__d")).alias("__d"))
    if keys:
        return nodes.select(*keys, F.col("__n").alias("n_entries"), F.col("__d").alias(name))
    return nodes.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_entries"), F.coalesce(F.max("__d"), _node(F.array().cast("array<string>"))).alias(name))


def _streamed(leaves: DataFrame, digits: int) -> DataFrame:
    """Nodes (__p, __n, __d) as ``_node`` makes them, of places of any length: the digests of each go in order through one hash."""
    ship(leaves.sparkSession)
    placed = leaves.withColumn("__p", F.substring("__d", 1, digits))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__c"), F.sum("__n").alias("__n"))  # a row for each of 16**digits places
    ordered = placed.drop("__n").join(F.broadcast(sizes), "__p").select("__p", "__c", "__n", "__d").repartition("__p").sortWithinPartitions("__p", "__d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = held = total = None
        done = lambda: pa.RecordBatch.from_pydict({"__p": [at], "__n": [total], "__d": [held.hexdigest()]})
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for place, rows in groupby(zip(*columns, strict=True), itemgetter(0)):
                rows = list(rows)
                if place != at:
                    if held is not None:
                        yield done()
                    at, total, held = place, rows[0][2], hashlib.sha256(f"{rows[0][1]}|".encode())
                held.update("".join(["64:" + r[3] for r in rows]).encode())
        if held is not None:
            yield done()

    return ordered.mapInArrow(run, "__p string, __n long, __d string")
