"""Hard negatives by distributed radix selection.

A selection is a set of windows: an anchor, a range of integer scores, and whether rows of the anchor's
label or of other labels count. Each wants its first k rows by score, then id. Scores are never sorted
or kept: a pass over all (anchor, row) scores counts, for each window, the next base-256 digit of the
distance from the window's top; the digit in which the kth row falls is located from the summed counts, and the
next pass looks only inside it. A window is settled when few rows reach down to its digit or no digit
is left; a last pass gathers the rows that qualify, and nothing else is moved.

Scores are made block by block: a task holds one block of rows while a share of the anchors streams past it.
Nothing is broadcast, and a label or score that many rows share is only counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditframe.session import materialize, ship

#: Bytes of the vectors of a block, and its rows at most.
BLOCK_BYTES = 1 << 25
BLOCK_ROWS = 65_536
#: Anchors that stream past a block in one task, and those scored at a time against so many rows.
ANCHORS = 16_384
AT_A_TIME = 64
ROWS = 8_192
DIGIT = 8
#: A window is gathered once so few rows reach down to its located digit.
FEW = 64
#: Scores beyond this are held at it.
MOST = 1 << 62
#: Integers up to here are exact as doubles.
EXACT = float(1 << 53)


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, v): rows that take part, one for each id, components times 256."""
    v = F.transform(F.col("v"), lambda x: x * 256)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(vectors[f"`{vec_id}`"].cast("long").alias("id"), vectors[f"`{label}`"].cast("long").alias("label"), vectors[f"`{embedding}`"].cast("array<double>").alias("v"))
    rows = rows.filter("id is not null and label is not null and v is not null").withColumn("v", v).filter(~F.coalesce(bad, F.lit(True)))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products (anchors x rows) of integral doubles, exact; held at +-2^62."""
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    if float(np.abs(anchors).max()) * float(np.abs(rows).max()) * anchors.shape[1] < EXACT:
        return (anchors @ rows.T).astype(np.int64)
    whole = [np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape) for m in (anchors, rows)]
    return np.clip(whole[0] @ whole[1].T, -MOST, MOST).astype(np.int64)


class _Block:
    """A block of rows in ascending id: vectors padded to one length, labels."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        ids = np.concatenate([p.column("id").to_numpy() for p in parts])
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.labels = np.concatenate([p.column("label").to_numpy() for p in parts])[order]
        self.dim = max(_widths(p).max(initial=0) for p in parts)
        self.vectors = np.concatenate([_matrix(p, self.dim) for p in parts])[order]


def _widths(part: pa.RecordBatch) -> np.ndarray:
    return np.asarray(part.column("v").value_lengths().fill_null(0))


def _matrix(part: pa.RecordBatch, dim: int) -> np.ndarray:
    """Whole components of up to ``dim`` places; shorter vectors end in zeros."""
    widths, flat = _widths(part), np.floor(part.column("v").flatten().to_numpy(zero_copy_only=False))
    if len(widths) and (widths == dim).all():
        return flat.reshape(len(widths), dim)
    out = np.zeros((len(widths), dim))
    row = np.repeat(np.arange(len(widths)), widths)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(widths) - widths, widths)
    inside = col < dim
    out[row[inside], col[inside]] = flat[inside]
    return out


#: Of each window: its number, the scores from high (best) to low that still count, the width of a digit (0: gather), rows wanted.
WINDOW = "array<struct<w:int,high:long,low:long,shift:int,k:int>>"


def _windows(lists: list[list[dict]]) -> dict[str, np.ndarray]:
    flat = [(i, w["w"], w["high"], w["low"], w["shift"], w["k"]) for i, ws in enumerate(lists) for w in ws or []]
    table = np.array(flat, np.int64).reshape(-1, 6)
    return dict(zip(("row", "w", "high", "low", "shift", "k"), table.T, strict=True))


def _pass(same: bool, gather: bool):
    """Reads (block, share, turn, id, label, v, windows) in order: the rows of a block (turn 0), then anchors (turn 1).

    Gives (anchor, w, digit, n), counts of digits down to the block's own kth row; or, to gather, (anchor, w, id, score).
    The kth row of all blocks is never below a block's own, so the counts behind that are not needed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "share", "turn")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                key, part = tuple(keys[a, :2]), batch.slice(a, b - a)
                if key != now:
                    now, parts, block = key, [], None
                if keys[a, 2] == 0:
                    parts.append(part)
                    continue
                if parts:
                    block, parts = _Block(parts), []
                if block is None:
                    continue
                for x in range(0, part.num_rows, AT_A_TIME):
                    found = _met(block, part.slice(x, AT_A_TIME), same, gather)
                    if found is not None:
                        yield found

    return run


def _met(block: _Block, anchors: pa.RecordBatch, same: bool, gather: bool) -> pa.RecordBatch | None:
    ids, labels, vectors = anchors.column("id").to_numpy(), anchors.column("label").to_numpy(), _matrix(anchors, block.dim)
    windows = _windows(anchors.column("windows").to_pylist())
    n, base = len(windows["row"]), 1 << DIGIT
    counts = np.zeros(n * base, np.int64) if not gather else None
    held: list[np.ndarray] = []
    order = np.argsort(windows["w"], kind="stable")
    turns = np.split(order, np.flatnonzero(np.diff(windows["w"][order])) + 1)  # a window of each anchor at a time
    for y in range(0, len(block.ids), ROWS):
        part = slice(y, y + ROWS)
        matrix = scores(vectors, block.vectors[part])
        fits = (block.labels[part] == labels[:, None]) if same else (block.labels[part] != labels[:, None])
        fits &= block.ids[part] != ids[:, None]
        for at in turns:
            rows = windows["row"][at]
            of = matrix if len(rows) == len(matrix) and (rows == np.arange(len(matrix))).all() else matrix[rows]
            hit = (of <= windows["high"][at, None]) & (of >= windows["low"][at, None]) & (fits if of is matrix else fits[rows])
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            which, score = at[i], of[i, j]
            if gather:
                held.append(np.stack([which, score, j + y]))
            else:
                digit = (windows["high"][which] - score).astype(np.uint64) >> windows["shift"][which].astype(np.uint64)
                counts += np.bincount(which * base + digit.astype(np.int64), minlength=n * base)
        if gather and len(held) > 64:
            held = [_first(np.concatenate(held, axis=1), windows["k"])]
    if gather:
        if not held:
            return None
        which, score, j = _first(np.concatenate(held, axis=1), windows["k"])
        columns = [ids[windows["row"][which]], windows["w"][which], block.ids[j], score]
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int32()), pa.array(columns[2]), pa.array(columns[3])], ["anchor", "w", "id", "score"])
    counts = counts.reshape(n, base)
    which, digit = np.nonzero((counts > 0) & (np.cumsum(counts, axis=1) - counts < windows["k"][:, None]))
    if not len(which):
        return None
    return pa.RecordBatch.from_arrays([pa.array(ids[windows["row"][which]]), pa.array(windows["w"][which], pa.int32()), pa.array(digit, pa.int32()), pa.array(counts[which, digit])], ["anchor", "w", "digit", "n"])


def _first(rows: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Of (window, score, place) the first k of each window by score, then place: more from one block cannot be wanted."""
    rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
    begin = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
    rank = np.arange(rows.shape[1]) - np.repeat(begin, np.diff(np.append(begin, rows.shape[1])))
    return rows[:, rank < k[rows[0]]]


class Selection:
    """The rows that take part, dealt into blocks, and their anchors."""

    def __init__(self, rows: DataFrame, anchors: Column) -> None:
        spark = rows.sparkSession
        ship(spark)
        self.rows = materialize(rows, "vectors")
        self.anchors = materialize(self.rows.filter(anchors), "anchors")
        size = self.rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.floor(x).cast("double") * F.floor(x).cast("double")))).alias("norm")).first()
        self.norm = size.norm or 0.0
        held = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, size.dim or 1))))
        # At least as many blocks as there are cores, while they have some rows; the layout changes no result.
        self.blocks = max(1, -(-size.n // held), min(spark.sparkContext.defaultParallelism, size.n // 512))
        self.shares = max(1, -(-self.anchors.count() // ANCHORS))

    def _run(self, windows: DataFrame, same: bool, gather: bool) -> DataFrame:
        """One pass over the scores of anchors with ``windows`` (anchor, windows)."""
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        left = self.rows.select(block(self.blocks).alias("block"), numbers(self.shares).alias("share"), F.lit(0).alias("turn"), "id", "label", "v", F.lit(None).cast(WINDOW).alias("windows"))
        asked = self.anchors.join(windows.withColumnRenamed("anchor", "id"), "id")
        right = asked.select(numbers(self.blocks).alias("block"), block(self.shares).alias("share"), F.lit(1).alias("turn"), "id", "label", "v", F.col("windows").cast(WINDOW).alias("windows"))
        met = left.unionByName(right).repartition(self.blocks * self.shares, "block", "share").sortWithinPartitions("block", "share", "turn")
        shape = "anchor long, w int, id long, score long" if gather else "anchor long, w int, digit int, n long"
        return met.mapInArrow(_pass(same, gather), shape)

    def first(self, windows: DataFrame, same: bool) -> DataFrame:
        """(anchor, w, id, score, rank) of the first k rows of windows (anchor, w, high, low, k), scores from high down to low."""
        bits = F.ceil(F.log2(F.col("high").cast("double") - F.col("low").cast("double") + 2) + 1e-9).cast("int")  # a little more, as doubles are rounded
        # Of each window: where its located digits begin and end, rows above them, and the width of the digit to come.
        open_ = windows.filter("low <= high").withColumn("top", F.col("high"))
        state = materialize(open_.withColumn("shift", F.greatest(F.lit(0), F.ceil(bits / DIGIT).cast("int") * DIGIT - DIGIT)).withColumn("above", F.lit(0).cast("long")).withColumn("done", F.lit(False)), "radix")
        settled = state.filter("done").select("anchor", "w", "top", "low", "k")
        while not state.isEmpty():
            packed = self._packed(state.select("anchor", F.struct("w", "high", "low", "shift", (F.col("k") - F.col("above")).cast("int").alias("k")).alias("s")))
            counts = self._run(packed, same, gather=False).groupBy("anchor", "w", "digit").agg(F.sum("n").alias("n"))
            state = materialize(self._located(state, counts), "radix")
            settled = settled.unionByName(state.filter("done").select("anchor", "w", "top", "low", "k"))
            state = state.filter("not done")
        wanted = materialize(settled, "settled")
        packed = self._packed(wanted.select("anchor", F.struct("w", F.col("top").alias("high"), "low", F.lit(0).alias("shift"), "k").alias("s")))
        found = self._run(packed, same, gather=True)
        rank = F.row_number().over(Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank.cast("int")).join(wanted.select("anchor", "w", "k"), ["anchor", "w"]).filter("rank <= k").select("anchor", "w", "id", "score", "rank")

    @staticmethod
    def _packed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("anchor").agg(F.array_sort(F.collect_list("s")).alias("windows"))

    @staticmethod
    def _located(state: DataFrame, counts: DataFrame) -> DataFrame:
        """The state after a pass: the digit in which each window's last wanted row falls."""
        running = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("anchor", "w").orderBy("digit")))
        met = state.join(running, ["anchor", "w"], "left")
        reach = F.col("above") + F.col("upto")
        at = F.min(F.when(reach >= F.col("k"), F.struct("digit", "n", reach.alias("reach")))).alias("at")
        found = met.groupBy("anchor", "w").agg(at).join(state, ["anchor", "w"])
        width = F.expr("shiftleft(1L, shift)")
        begin = F.col("high") - F.col("at.digit") * width
        end = F.greatest(F.col("low"), begin - width + 1)
        # Without a digit the window has fewer rows than it wants, and all of them qualify.
        done = F.col("at").isNull() | (F.col("shift") == 0) | (F.col("at.reach") <= FEW)
        return found.select(
            "anchor", "w", "top", "k", done.alias("done"), F.when(F.col("at").isNull(), F.col("high")).otherwise(begin).alias("high"), F.when(F.col("at").isNull(), F.col("low")).otherwise(end).alias("low"),
            F.greatest(F.lit(0), F.col("shift") - DIGIT).alias("shift"), F.when(F.col("at").isNull(), F.col("above")).otherwise(F.col("at.reach") - F.col("at.n")).alias("above"),
        )


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from rows (id, label, v) of ``quantised``.

    An anchor's positives are its first rows of the same label by score, then id; for each, the first
    negatives by the same order whose score is from ``low`` to ``high`` per cent of the positive's.
    """
    chosen = Selection(rows, anchors)
    # By Cauchy and Schwarz no score of an anchor lies beyond the product of its norm and the largest one.
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.floor(x).cast("double") * F.floor(x).cast("double")))
    bound = F.least(F.lit(float(MOST)), norm * chosen.norm * 1.000001 + 2)
    bound = F.when(bound >= float(MOST), F.lit(MOST)).otherwise(F.ceil(bound).cast("long"))
    own = chosen.anchors.select(F.col("id").alias("anchor"), F.lit(0).alias("w"), bound.alias("high"), (-bound).alias("low"), F.lit(positives).alias("k"))
    first = materialize(chosen.first(own, same=True), "positives")
    score = F.col("score")
    # Whole per cents apart from the rest, so that no product passes a long.
    below = F.expr(f"score div 100 * {high}") + F.floor(score % 100 * high / 100).cast("long")
    above = F.expr(f"score div 100 * {low}") + F.ceil(score % 100 * low / 100).cast("long")
    spans = first.select("anchor", F.col("rank").alias("w"), below.alias("high"), above.alias("low"), F.lit(negatives).alias("k"))
    found = chosen.first(spans, same=False)
    names = first.select("anchor", F.col("rank").alias("w"), F.col("id").alias("positive_id"), score.alias("positive_score"))
    joined = found.join(names, ["anchor", "w"])
    return joined.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def contract_rows(embeddings: DataFrame) -> DataFrame:
    """(id, label, v) of ``embeddings``; where vec_id is divisible by 7 the label moves on by one (modulo 10).

    Rows take no part if vec_id, label or vector is null, or a component is null or not finite (256 times
    it, too). Of rows that repeat a vec_id the least (label, vector) counts. Vectors of unlike length
    meet as if the shorter one ended in zeros; empty and zero vectors score 0. Scores are exact
    integers, held at +-2^62. An empty table gives an empty result; other columns take no part.
    """
    rows = quantised(embeddings)
    return rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
