"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree hashes a vector to a string of 64 bits, the signs of its products with the tree's own random
orthogonal directions, and keeps the strings as one sorted array: all strings with a common prefix are
a range of it. A query descends to the longest prefix it shares with any string of each tree, then all
trees ascend together until their ranges hold enough candidates; these are ranked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditframe.session import ship

TREES = 192
BITS = 64
#: Vectors of a block, which one forest holds, and queries that pass it in one task.
BLOCK_ROWS = 16_384
QUERY_ROWS = 65_536
#: The ascent gathers at least this times k^0.2 N^0.8 of N vectors; see the README for the recall that it gives.
GATHER = 0.95
SEED = 20


class PrefixForest:
    """The forest of one block of vectors."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = SEED) -> None:
        self.vectors = np.ascontiguousarray(vectors, np.float64)
        rng = np.random.default_rng(seed)
        self.planes = [_directions(self.vectors.shape[1], rng) for _ in range(trees)]
        n = len(self.vectors)
        self.order = np.empty((trees, n), np.int32)
        self.strings = np.empty((trees, n), np.uint64)
        for t, plane in enumerate(self.planes):
            strings = _strings(self.vectors, plane)
            self.order[t] = np.argsort(strings, kind="stable")
            self.strings[t] = strings[self.order[t]]

    def _ranges(self, asked: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each tree and query, the range of strings that share the query's first ``depth`` bits."""
        rest = np.where(depth > 0, (np.uint64(1) << (BITS - np.maximum(depth, 1)).astype(np.uint64)) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
        low, high = asked & ~rest, asked | rest
        lows, highs = np.empty(asked.shape, np.int64), np.empty(asked.shape, np.int64)
        for t, strings in enumerate(self.strings):
            lows[t] = np.searchsorted(strings, low[t], "left")
            highs[t] = np.searchsorted(strings, high[t], "right")
        return lows, highs

    def _longest(self, asked: np.ndarray) -> np.ndarray:
        """The longest prefix of each query that any tree holds: next to its place in the sorted array."""
        best = np.zeros(asked.shape[1], np.int64)
        for t, strings in enumerate(self.strings):
            at = np.searchsorted(strings, asked[t])
            for near in (strings[(at - 1).clip(min=0)], strings[at.clip(max=len(strings) - 1)]):
                differ = near ^ asked[t]
                best = np.maximum(best, np.where(differ == 0, BITS, BITS - 1 - np.floor(np.log2(np.maximum(differ, 1).astype(np.float64))).astype(np.int64)))
        return best.clip(0, BITS)

    def candidates(self, queries: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """Row numbers for each query: all that share, in some tree, the longest prefix at which there are ``wanted``.

        The ascent is synchronous: one depth for all trees of a query. Ranges only grow on the way up, so
        the first depth at which their sizes add up to ``wanted`` is found by halving; from there on the
        union counts, a bit at a time.
        """
        asked = np.stack([_strings(queries, plane) for plane in self.planes])
        low, high = np.zeros(len(queries), np.int64), self._longest(asked)
        while (low < high).any():
            middle = (low + high + 1) // 2
            a, b = self._ranges(asked, middle)
            enough = (b - a).sum(axis=0) >= wanted
            low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
        depth = low
        a, b = self._ranges(asked, depth)
        seen = np.zeros(len(self.vectors), np.int64)
        stamp = 0
        for k in range(len(queries)):
            d, lows, highs = int(depth[k]), a[:, k], b[:, k]
            while True:
                n = highs - lows
                first = lows + np.arange(len(lows)) * len(self.vectors)
                at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                stamp += 1
                seen[self.order.reshape(-1)[at]] = stamp
                rows = np.flatnonzero(seen == stamp)
                if len(rows) >= wanted or d == 0:
                    break
                d -= 1
                lows, highs = (x[:, 0] for x in self._ranges(asked[:, k : k + 1], np.array([d])))
            yield rows


def _directions(dim: int, rng: np.random.Generator) -> np.ndarray:
    """``BITS`` random directions, orthogonal to each other in groups of ``dim``."""
    groups = [np.linalg.qr(rng.standard_normal((dim, min(dim, BITS - a))))[0] for a in range(0, BITS, dim)]
    return np.concatenate(groups, axis=1)


def _strings(vectors: np.ndarray, plane: np.ndarray) -> np.ndarray:
    bits = np.packbits(vectors @ plane > 0, axis=1, bitorder="big")
    return np.ascontiguousarray(bits).view(">u8").astype(np.uint64).reshape(-1)


def nearest(forest: PrefixForest, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, gather: float = GATHER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query the row numbers and products of the k largest, ties to smaller ids; never of the query's own id."""
    wanted = min(len(ids), max(k + 1, int(np.ceil(gather * k**0.2 * len(ids) ** 0.8))))
    for own, query, rows in zip(query_ids, queries, forest.candidates(queries, wanted), strict=True):
        rows = rows[ids[rows] != own]
        with np.errstate(over="ignore", invalid="ignore"):  # products of finite vectors may be infinite, and their sum no number
            rough = forest.vectors[rows] @ query
            if len(rows) > k and np.isfinite(rough).all():
                # all that may be among the k by exact arithmetic, ties included
                border = np.partition(rough, len(rough) - k)[len(rough) - k]
                rows = rows[rough >= border - 1e-9 * max(1.0, abs(border))]
            score = (forest.vectors[rows] * query).sum(axis=1)
        best = np.lexsort((ids[rows], -score))[:k]
        yield own, rows[best], score[best]


#: Queries whose ranges in all trees are held at a time.
_PASS = 512


def _pass_blocks(k: int, gather: float, trees: int):
    """Reads (b, q, dim, turn, id, v, n) in order: a block's vectors (turn 0), then the queries that pass it (turn 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, vectors, copies, forest = None, [], [], [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("b", "q", "dim", "turn")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                key, turn, part = tuple(keys[a, :3]), keys[a, 3], batch.slice(a, b - a)
                own = part.column("id").to_numpy()
                values = part.column("v").flatten().to_numpy().reshape(len(own), -1)
                if key != block:
                    block, ids, vectors, copies, forest = key, [], [], [], None
                if turn == 0:
                    ids.append(own)
                    vectors.append(values)
                    copies.append(part.column("n").to_numpy())
                elif ids:
                    if forest is None:
                        forest = PrefixForest(np.concatenate(vectors), trees)
                        ids, copies, vectors = [np.concatenate(ids)], [np.concatenate(copies)], []
                    for at in range(0, len(own), _PASS):
                        found = list(nearest(forest, ids[0], own[at : at + _PASS], values[at : at + _PASS], k, gather))
                        rows = np.concatenate([r for _, r, _ in found])
                        query = np.repeat([q for q, _, _ in found], [len(r) for _, r, _ in found])
                        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids[0][rows]), pa.array(np.concatenate([s for _, _, s in found])), pa.array(copies[0][rows].clip(max=k), pa.int32())], ["query_id", "vec_id", "score", "n"])

    return run


def search(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, gather: float = GATHER, trees: int = TREES, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """k nearest by inner product of each query among all other rows: query_id, rank, vec_id, score.

    Vectors are dealt by a hash to blocks. A task builds the forest of one block and lets the queries,
    up to ``query_rows`` of them, stream past it; it gives k rows a query, and these merge by rank.
    Without ``queries`` the queries are the rows whose id is divisible by 20.

    Rows with a null id, a null, empty or zero vector, or a null or non-finite component take no part;
    vectors of other lengths than a query's are compared only with their like. Every row is a
    candidate, so a repeated one may be found repeatedly, but no row with the query's own id is; a product beyond
    the doubles is infinite and counts as such, one that is no number comes last;
    of queries that repeat an id the one with the least vector in array order counts. An empty table
    gives an empty result. Other columns take no part.
    """
    spark = vectors.sparkSession
    ship(spark)

    def clean(df: DataFrame) -> DataFrame:
        v = F.col("v")
        bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        rows = df.select(df[f"`{vec_id}`"].cast("long").alias("id"), df[f"`{embedding}`"].cast("array<double>").alias("v"))
        return rows.filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))

    # Equal rows are one with a count, so many copies fill no block.
    rows = clean(vectors).groupBy("id", "v").agg(F.count("*").alias("n"))
    asked = clean(queries) if queries is not None else clean(vectors.filter(F.col(f"`{vec_id}`") % 20 == 0))
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    n_blocks = max(1, -(-clean(vectors).count() // block_rows))
    n_query = max(1, -(-asked.count() // query_rows))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dim = F.size("v").alias("dim")
    left = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)).cast("int").alias("b"), numbers(n_query).alias("q"), dim, F.lit(0).alias("turn"), "id", "v", "n")
    right = asked.select(numbers(n_blocks).alias("b"), F.pmod(F.xxhash64("id"), F.lit(n_query)).cast("int").alias("q"), dim, F.lit(1).alias("turn"), "id", "v", F.lit(1).cast("long").alias("n"))
    met = left.unionByName(right).repartition("b", "q", "dim").sortWithinPartitions("b", "q", "dim", "turn")
    found = met.mapInArrow(_pass_blocks(k, gather, trees), "query_id long, vec_id long, score double, n int")
    found = found.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.isnan("score"), F.col("score").desc(), F.col("vec_id").asc()))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
