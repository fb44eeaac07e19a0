"""Quality by importance resampling.

Two bags of hashed n-grams are fitted: one to the target (labelled good texts), one to all raw texts.
The log importance weight of a text is the mean of log(p_target / p_raw) over its n-grams (a sum
would let noise grow with length; see the README). With a scaled Gumbel variable added, the k largest
are a sample without replacement by importance (Gumbel top-k).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditframe.llm.common import text_slices
from auditframe.session import materialize, ship

BUCKETS = 1 << 16
#: Labelled rows used at most: the fit of the target and the choice of k read a bounded sample.
MAX_LABELLED = 20_000
#: Observations of ratio 1 added to each bucket, in units of raw counts.
SMOOTHING = 10.0
#: Scale of the Gumbel variable against the log weights; 0 selects the best k.
TEMPERATURE = 0.02
#: N-grams of ratio 1 that stand beside those of each text, so that short texts say little.
PRIOR_GRAMS = 20
_TOKENS = re.compile(r"\w+|[^\w\s]+").findall
_REPEAT = 1
_CACHE = 150_000


class _Hashes(dict):
    """Word to 32-bit hash, kept by the worker."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = value = zlib.crc32(word.encode("utf-8", "surrogatepass")) | 2
        return value


_hashes = _Hashes()


def ngram_buckets(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the unigrams and bigrams of texts, one after another, and how many each text has.

    Tokens are runs of word characters or of other signs, in lower case; a token equal to the one
    before it becomes one common mark of repetition.
    """
    lists = [_TOKENS(t.lower()) if t else [] for t in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    if not n.sum():
        return np.zeros(0, np.int64), n
    get = _hashes.__getitem__
    ids = np.fromiter(map(get, chain.from_iterable(lists)), np.uint64, int(n.sum()))
    first = np.zeros(len(ids), bool)
    starts = np.cumsum(n) - n
    first[starts[n > 0]] = True
    repeat = np.zeros(len(ids), bool)
    repeat[1:] = (ids[1:] == ids[:-1]) & ~first[1:]
    ids[repeat] = _REPEAT
    one = (ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    before = np.concatenate([ids[:1], ids[:-1]])
    two = ((before * np.uint64(0xC2B2AE3D27D4EB4F) + ids) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    both = np.empty(2 * len(ids), np.int64)
    both[0::2] = one % np.uint64(buckets)
    both[1::2] = np.where(first, both[0::2], (two % np.uint64(buckets)).astype(np.int64))
    return both, 2 * n


@dataclass
class ImportanceModel:
    """log(p_target / p_raw) by bucket, and the log weight from which texts are kept."""

    ratio: np.ndarray
    threshold: float
    seed: int
    temperature: float

    def log_weights(self, texts: list[str | None]) -> np.ndarray:
        grams, n = ngram_buckets(texts, len(self.ratio))
        out = np.zeros(len(texts))
        if len(grams):
            starts = np.cumsum(n) - n
            out[n > 0] = np.add.reduceat(self.ratio[grams], starts[n > 0])
        return out / (n + PRIOR_GRAMS)


def gumbel(doc_ids: list[int | None], seed: int) -> np.ndarray:
    """A standard Gumbel variable for each document, the same in every run."""
    u = np.array([zlib.crc32(f"{seed}:{i}".encode()) for i in doc_ids], np.float64)
    return -np.log(-np.log((u + 0.5) / 2**32))


def labelled_sample(labels: DataFrame, label: str, limit: int = MAX_LABELLED) -> dict[int, int]:
    """At most ``limit`` labelled documents, by a hash of their id: doc_id to label, the larger of several."""
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return {r.doc_id: r.y for r in rows.orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").limit(limit).collect()}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", buckets: int = BUCKETS, seed: int = 1, temperature: float = TEMPERATURE) -> ImportanceModel:
    """Count raw and target n-grams over all documents in one pass, then choose the threshold.

    Counts leave each task as at most ``buckets`` rows. The threshold is the log weight that best
    parts the labelled sample, in the middle of the widest gap that does so; the default k of the Gumbel
    top-k is the number of rows above it. Without labels of both kinds that is every row.
    """
    spark = docs.sparkSession
    ship(spark)
    sample = labelled_sample(labels, label)
    known = spark.sparkContext.broadcast(sample)
    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for part in text_slices(batches):
            grams, n = ngram_buckets(part.column("text").to_pylist(), buckets)
            raw += np.bincount(grams, minlength=buckets)
            good = np.array([known.value.get(i) == 1 for i in part.column("doc_id").to_pylist()], bool)
            if good.any():
                target += np.bincount(grams[np.repeat(good, n)], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    counts = columns.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    model = ImportanceModel(log_ratio(raw, target), -np.inf, seed, temperature)
    if not target.sum() or 0 not in sample.values():
        return model
    shared = spark.sparkContext.broadcast((raw, target))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            ids = part.column("doc_id").to_pylist()
            mine = [k for k, i in enumerate(ids) if i in known.value]
            if mine:
                y = [known.value[ids[k]] for k in mine]
                w = held_out_weights(part.column("text").take(pa.array(mine)).to_pylist(), y, *shared.value)
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in mine], pa.int64()), pa.array(w), pa.array(y, pa.int32())], ["doc_id", "w", "y"])

    # A row for each labelled document, so no more than the sample; of rows that repeat a doc_id the least weight counts.
    scored = columns.mapInArrow(score, "doc_id long, w double, y int").groupBy("doc_id", "y").agg(F.min("w").alias("w")).toPandas().sort_values(["w", "y"], kind="stable")
    model.threshold = best_cut(scored["w"].to_numpy(), scored["y"].to_numpy())
    return model


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(p_target / p_raw) by bucket; a bucket with few raw counts stays near 0."""
    share = max(target.sum(), 1e-9) / max(raw.sum(), 1e-9)
    return np.log((target + SMOOTHING * share) / (share * (raw + SMOOTHING)))


def held_out_weights(texts: list[str | None], y: list[int], raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log weights of labelled texts as if they were not in the target: their own counts are taken out of it."""
    share = max(target.sum(), 1e-9) / max(raw.sum(), 1e-9)
    grams, n = ngram_buckets(texts, len(raw))
    ends = np.cumsum(n)
    out = np.zeros(len(texts))
    for k, (a, b) in enumerate(zip((ends - n).tolist(), ends.tolist(), strict=True)):
        bucket, count = np.unique(grams[a:b], return_counts=True)
        good = np.maximum(target[bucket] - (count if y[k] == 1 else 0), 0)
        out[k] = 1 / (b - a + PRIOR_GRAMS) * count @ np.log((good + SMOOTHING * share) / (share * (raw[bucket] + SMOOTHING)))
    return out


def best_cut(w: np.ndarray, y: np.ndarray) -> float:
    """Between ascending weights, the cut with the least loss: a good text lost counts 5, a bad one kept 1."""
    if not len(w):
        return -np.inf
    lost = np.concatenate([[0], np.cumsum(y == 1)])
    kept = (y == 0).sum() - np.concatenate([[0], np.cumsum(y == 0)])
    loss = 5 * lost + kept
    edges = np.concatenate([[w[0] - 2.0], (w[1:] + w[:-1]) / 2, [w[-1] + 1.0]])
    width = np.concatenate([[1.0], np.diff(w), [0.0]])
    best = np.flatnonzero(loss == loss.min())
    return float(edges[best[np.argmax(width[best])]])


def importance_sample(docs: DataFrame, model: ImportanceModel, k: int | None = None, text: str = "text", keep_all: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Add log_weight, perturbed (with the Gumbel variable) and kept; by default only kept rows remain.

    The k rows of largest perturbed weight are kept. Without ``k`` it is the number of rows whose log
    weight is the model's threshold or more. The k-th largest is found by counting the scores in ever
    finer cells, not by a global sort; rows equal to it are all kept. ``columns`` of ``docs`` stay (all
    by default); they are written once with their scores, so that each text is scored once. Null and
    empty texts have log weight 0. Columns named like an output are replaced, repeated rows stay
    repeated and share their fate. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    made = ["log_weight", "perturbed"]
    names = [c for c in (docs.columns if columns is None else columns) if c not in {*made, "kept"}]
    base = docs.select(docs[f"`{text}`"].alias("__text"), docs["doc_id"].cast("long").alias("__id"), *[docs[f"`{c}`"] for c in names])
    schema = StructType(list(base.schema.fields[2:])).add("log_weight", "double").add("perturbed", "double")
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in text_slices(batches, "__text"):
            w = m.log_weights(part.column("__text").to_pylist())
            g = w + m.temperature * gumbel(part.column("__id").to_pylist(), m.seed)
            yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(w), pa.array(g)], [*names, *made])

    scored = materialize(base.mapInArrow(run, schema), "importance-scores")
    if k is None:
        k = scored.filter(F.col("log_weight") >= model.threshold).count()
    cut = kth_largest(scored.select("perturbed"), "perturbed", k) if k > 0 else float("inf")
    out = scored.withColumn("kept", F.col("perturbed") >= F.lit(cut))
    return out if keep_all else out.filter("kept")


def kth_largest(values: DataFrame, column: str, k: int, cells: int = 1024) -> float:
    """The exact k-th largest double of a column; -inf if there are fewer. Each round sends ``cells`` counts at most."""
    low, high, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if n < k:
        return -np.inf
    while low < high:
        width = (high - low) / cells
        if width <= 0 or low + width == low:
            break
        inside = values.filter(F.col(column).between(low, high))
        above = values.filter(F.col(column) > high).count()
        cell = F.least(F.floor((F.col(column) - low) / width), F.lit(cells - 1))
        rows = inside.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("c")).collect()
        for r in rows:
            above += r.n
            if above >= k:
                stuck = (r.low, r.high) == (low, high)
                low, high = r.low, r.high
                break
        if stuck:
            break
    return low
