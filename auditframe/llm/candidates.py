"""From banding keys to classes: candidate pairs, exact verification, union-find.

Rows that share a band key are a run. A run costs as many pairs as it has members, whatever its size: each member meets the run's first member, its hub. Hub pairs are
verified exactly and united. A member that is still apart from its hub is an outsider of the run; few
are. Outsiders meet the next hubs of the run, which covers every pair of a short run. What long runs
still leave apart is settled by streaming their members past their outsiders, once for all runs whose
hubs are in one class, so no pair of a run that could join two classes is left out.

Before texts are fetched for a pair, short sketches of both are compared: a pair whose sketches agree
in fewer than 36 of 64 places is dropped. At a similarity of 0.8 that happens about four times in a
million, far less often than that the bands miss such a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditframe.llm.common import mix64, text_slices
from auditframe.llm.components import components, extended
from auditframe.session import materialize, ship

#: The first members of a run serve as hubs, one after another.
HUBS = 8
SKETCH = 64
SKETCH_LEAST = 36
#: Texts whose sketches are made at a time, and pairs that are compared at a time: their elements fit a CPU's cache.
SKETCH_ROWS = 512
PAIR_ROWS = 128
#: A class's outsiders that one task holds while its members stream past: their number and bytes.
OUTSIDERS = 1_024
OUTSIDER_BYTES = 1 << 19
#: Members that stream past them in one task.
STREAM_ROWS = 1_024
STREAM_BYTES = 1 << 26
#: Members that meet the outsiders at a time, and common elements.
MEMBERS = 256
MATCHES = 1 << 17
#: One text in so many tells which keys are hot: those found ``HOT_SAMPLED`` times, ``HOT_KEYS`` at most.
SAMPLE = 64
HOT_SAMPLED = 24
HOT_KEYS = 2_000
#: Parts of a hot run.
SALTS = 64
#: Band rows of one partition (16 bytes each), by the sample's estimate.
RUN_ROWS = 1_000_000
#: Band rows that a task gathers before it deals them to buckets, and buckets of one partition.
DEALT_ROWS = 1 << 19
BUCKETS = 4
#: Up to so many ids of wanted texts (8 bytes each, 8 MB in all) are broadcast to filter the texts where they are
#: read; beyond, texts and ids meet in a shuffle.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Bands:
    """Band rows as ``made`` gives them from ``rows``: batches of (key long, id long)."""

    rows: DataFrame
    made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _dealt(made: Callable | None, buckets: int, hot: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gives (bucket, rows): the (key, id) rows of a bucket, 16 bytes each, as one value.

    All rows of a key are in one bucket; those of a ``hot`` key (sorted) are dealt by their ids over ``SALTS`` ones.
    """

    def packed(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        bucket = mix64(keys.view(np.uint64), 1) % np.uint64(buckets)
        if len(hot):
            at = np.flatnonzero(hot[np.searchsorted(hot, keys).clip(max=len(hot) - 1)] == keys)
            salt = mix64(ids[at].view(np.uint64), 2) % np.uint64(SALTS)
            bucket[at] = mix64(keys[at].view(np.uint64) + (salt << np.uint64(32)), 3) % np.uint64(buckets)
        bucket = bucket.astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        some = np.flatnonzero(np.diff(ends, prepend=0))
        offsets = np.concatenate([[0], ends[some] * 16]).astype(np.int32)
        data = np.stack([keys, ids], axis=1)[order]
        values = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), values], ["bucket", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in made(batches) if made else batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= DEALT_ROWS:
                yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _undealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The (key, id) rows of (bucket, rows)."""
    for batch in batches:
        for value in batch.column("rows"):
            rows = np.frombuffer(value.as_buffer(), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["key", "id"])


def _stream(hubs: int, hot: np.ndarray | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads the (key, id) rows of a partition; gives (key, a, b, n, hot): b is a member whose hub is a, or, with b
    null, a is a later hub; n is the number of the run's members but its hub. Without ``hot`` only (key, a, b).

    A partition holds about ``RUN_ROWS`` rows of 16 bytes. Runs whose keys are ``hot`` (sorted) are parts of a run: they
    also give their hub among the later ones, so that a lone member shows.
    """

    def is_hot(keys: np.ndarray) -> np.ndarray:
        some = hot is not None and len(hot)
        return hot[np.searchsorted(hot, keys).clip(max=len(hot) - 1)] == keys if some else np.zeros(len(keys), bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        keys, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        same = keys[1:] == keys[:-1]
        shared = np.zeros(len(keys), bool)
        shared[1:] |= same
        shared[:-1] |= same
        shared |= is_hot(keys)
        keys, ids = keys[shared], ids[shared]  # few rows share their key
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        keys, ids = keys[fresh], ids[fresh]
        if not len(keys):
            return
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(begin, len(keys)))
        begin, n = np.repeat(begin, size), np.repeat(size - 1, size)
        rank = np.arange(len(keys)) - begin
        part_of_hot = is_hot(keys)
        pick = rank > 0
        later = (pick & (rank < hubs)) | ((rank == 0) & part_of_hot)
        for mask, a, b in ((pick, ids[begin], ids), (later, ids, None)):
            at = np.flatnonzero(mask)
            for k in range(0, len(at), 1 << 16):
                part = at[k : k + (1 << 16)]
                other = pa.array(b[part]) if b is not None else pa.nulls(len(part), pa.int64())
                columns = {"key": pa.array(keys[part]), "a": pa.array(a[part]), "b": other}
                if hot is not None:
                    columns |= {"n": pa.array(n[part]), "hot": pa.array(part_of_hot[part])}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def sampled(rows: DataFrame, text: Column) -> DataFrame:
    """About one row in ``SAMPLE``, by a hash of the text."""
    return rows.filter(F.pmod(F.xxhash64(text, F.lit(SAMPLE)), F.lit(SAMPLE)) == 0)


def _runs(bands: DataFrame | Bands, sample: DataFrame | None, hubs: int) -> DataFrame:
    """(key, a, b, n) as ``_stream`` gives it for whole runs; hot runs are read in ``SALTS`` parts.

    The sample only says which runs are hot: ``HOT_KEYS`` at most, since a key that is not among the most
    frequent ones has less than a share of 1 / HOT_KEYS.
    """
    rows, made = (bands.rows, bands.made) if isinstance(bands, Bands) else (bands.select("key", "id"), None)
    spark = rows.sparkSession
    setting = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = sample if sample is not None else rows.mapInArrow(made, "key long, id long") if made else rows
    counts = materialize(counted.groupBy("key").agg(F.count("*").alias("n")), "band-sample")
    seen = (counts.agg(F.sum("n")).first()[0] or 0) * (1 if sample is None else SAMPLE)
    hot = [] if sample is None else [r.key for r in counts.filter(F.col("n") >= HOT_SAMPLED).orderBy(F.desc("n"), "key").limit(HOT_KEYS).collect()]
    hot = np.sort(np.array(hot, np.int64))
    parts = max(setting, -(-seen // RUN_ROWS))
    stream = _stream(hubs, hot)
    dealt = rows.mapInArrow(_dealt(made, min(BUCKETS * parts, 1 << 16), hot), "bucket int, rows binary").repartition(parts, "bucket")
    found = materialize(dealt.mapInArrow(lambda batches: stream(_undealt(batches)), "key long, a long, b long, n long, hot boolean"), "runs")
    cold = found.filter("not hot").drop("hot")
    if not len(hot):
        return cold
    warm = found.filter("hot")
    every = warm.filter("b is null").select("key", F.col("a").alias("id")).unionByName(warm.filter("b is not null").select("key", F.col("b").alias("id"))).distinct()
    every = materialize(every, "hot-members")
    ranked = warm.filter("b is null").select("key", "a").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("a"))).filter(F.col("rank") <= hubs)
    ranked = materialize(ranked, "hot-hubs")
    sizes = materialize(every.groupBy("key").agg(F.min("id").alias("a"), (F.count("*") - 1).alias("n")), "hot-sizes")
    joined = every.join(F.broadcast(sizes), "key").filter("a != id").select("key", "a", F.col("id").alias("b"), "n")
    later = ranked.filter("rank > 1").join(F.broadcast(sizes.select("key", "n")), "key").select("key", "a", F.lit(None).cast("long").alias("b"), "n")
    return cold.unionByName(joined).unionByName(later)


def classes(bands: DataFrame | Bands, texts: DataFrame, sets: Sets, similarity: float, hubs: int = HUBS, sample: DataFrame | None = None, twin_of: Column | None = None, elements: Elements | None = None) -> DataFrame:
    """(id, component) of all ids that a link joins, from bands (key long, id long) and texts (id, text; copies allowed).

    ``sample`` holds the bands of ``sampled`` texts; with it, very frequent keys are dealt over many tasks.
    ``twin_of``, an expression over text, is the id that a node is only another form of, or null: both are united.
    ``elements`` gives the same sets, all of whose weights are 1, without sorting them.

    Two texts are linked at a Jaccard similarity of ``similarity`` or more of their ``sets``. Repeated
    band rows are harmless. Ids are hashes, so their order is a random one. Only texts that share a
    run are moved, and once.
    """
    ship(texts.sparkSession)
    found = _runs(bands, sample, hubs)
    members = found.filter("b is not null")
    # A run's hub has its smallest id, so a < b.
    hub_pairs = materialize(members.select("a", "b").distinct(), "hub-pairs")
    wanted = materialize(hub_pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    needed = texts.join(wanted, "id", "left_semi").dropDuplicates(["id"])
    needed = materialize(needed.mapInArrow(_sketches(sets, elements), "id long, text string, size long, sketch binary"), "texts")

    def of(known: DataFrame, name: str, to: str) -> DataFrame:
        return known.select(F.col("id").alias(name), F.col("component").alias(to))

    def compared(likely: DataFrame) -> DataFrame:
        with_a = likely.join(needed.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        both = with_a.join(needed.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        return materialize(both.select("a", "b", "ta", "tb").mapInArrow(_compare(sets, similarity, elements), "u long, v long"), "links")

    def linked(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(needed.select(F.col("id").alias(side), F.col("sketch").alias(f"s{side}")), side)
        return compared(materialize(pairs.select("a", "b", "sa", "sb").mapInArrow(_likely, "a long, b long"), "likely"))

    links = linked(hub_pairs)
    if twin_of is not None:
        links = links.unionByName(needed.select(F.col("id").alias("u"), twin_of.alias("v")).filter("v is not null"))
    known = components(links)
    # Outsiders of runs, by (key, member). Pairs repeat over bands, so classes are looked up once for each.
    paired = hub_pairs.join(of(known, "a", "ca"), "a", "left").join(of(known, "b", "cb"), "b", "left")
    apart = materialize(paired.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "apart")
    marked = members.filter("n > 1").join(apart, ["a", "b"])  # a pair is settled by itself
    outside = materialize(marked.select("key", F.col("a").alias("hub"), F.col("b").alias("id"), "n"), "outsiders")
    if outside.isEmpty():
        return known
    later = found.filter("b is null").select("key", F.col("a").alias("other"))
    # A run's later hubs come with their sketches as one row, so an outsider is a row here, not one for each hub
    # that it meets: only pairs whose sketches agree become rows.
    marks = needed.select("id", "sketch")
    ahead = later.join(outside.select("key").distinct(), "key", "left_semi").join(marks.withColumnRenamed("id", "other"), "other")
    ahead = ahead.groupBy("key").agg(F.collect_list(F.struct("other", "sketch")).alias("ahead"))
    met = outside.select("key", "id").join(ahead, "key").join(marks, "id").select("id", "sketch", "ahead").mapInArrow(_meet, "a long, b long")
    met = materialize(met.distinct().join(hub_pairs, ["a", "b"], "left_anti"), "likely")
    more = compared(met)
    if not more.isEmpty():
        known = extended(known, more)
    # n is without the hub, and the later hubs are one fewer than hubs: with n = hubs one member met no other.
    still = outside.filter(F.col("n") >= hubs).join(of(known, "hub", "ch"), "hub", "left").join(of(known, "id", "ci"), "id", "left")
    still = materialize(still.filter(F.coalesce("ch", "hub") != F.coalesce("ci", "id")).select("key", "id", F.coalesce("ch", "hub").alias("c")), "outsiders")
    if still.isEmpty():
        return known
    # An open run belongs to its hub's class. Runs of one class are settled together, so that neither its
    # outsiders nor its members are read again for each band: all its members pass each chunk of its outsiders.
    open_runs = still.select("key", F.col("c")).distinct()
    inside = materialize(members.select("key", F.col("b").alias("id")).join(open_runs, "key").select("c", "id").distinct(), "inside")
    apart_ids = still.select("c", "id").distinct()
    weights = needed.select("id", "size")

    def dealt(rows: DataFrame, size: int, most: int, name: str) -> DataFrame:
        """(c, name): into how many parts a class's rows are dealt, by their bytes and number."""
        parts = F.greatest(F.ceil(F.sum("size") / size), F.ceil(F.count("*") / most)).cast("int")
        return rows.join(weights, "id").groupBy("c").agg(parts.alias(name))

    shape = dealt(apart_ids, OUTSIDER_BYTES, OUTSIDERS, "chunks").join(dealt(inside, STREAM_BYTES, STREAM_ROWS, "shares"), "c")
    shape = materialize(shape, "shape")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.col(n)).cast("int").alias(n)
    first = apart_ids.join(shape, "c").select("c", mine("chunks"), every("shares").alias("shares"), "id", F.lit(0).alias("turn"))
    then = inside.join(shape, "c").select("c", every("chunks").alias("chunks"), mine("shares"), "id", F.lit(1).alias("turn"))
    rows = first.unionByName(then).join(needed.select("id", "text", "sketch"), "id").join(of(known, "id", "own"), "id", "left")
    rows = rows.select("c", "chunks", "shares", "turn", "id", F.coalesce("own", "id").alias("own"), "text", "sketch")
    ordered = rows.repartition("c", "chunks", "shares").sortWithinPartitions("c", "chunks", "shares", "turn", "id")
    last = materialize(ordered.mapInArrow(_past_outsiders(sets, similarity), "u long, v long"), "links")
    return known if last.isEmpty() else extended(known, last)


#: From texts: (text number, hash of 44 bits, weight) of each distinct element, sorted by number and hash.
Sets = Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: From texts: (text number, hash of 44 bits) of each element, repeats allowed, in any order.
Elements = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


@cache
def _path(k: int, attempt: int) -> np.ndarray:
    """For each of k bins, the bin that it looks at in an attempt if it is empty."""
    return (mix64(np.arange(k, dtype=np.uint64) + np.uint64(attempt << 16)) % np.uint64(k)).astype(np.int64)


def bin_signatures(owner: np.ndarray, hashes: np.ndarray, n_sets: int, k: int) -> np.ndarray:
    """One-permutation MinHash (n_sets x k) of sets of 44-bit hashes, repeats allowed: each bin keeps its smallest.

    An empty bin takes the value of the first filled bin on a hashed path of its own; an empty set has
    no value but the largest.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    signature = np.full((n_sets, k), empty, np.uint64)
    np.minimum.at(signature.reshape(-1), owner * k + ((hashes * np.uint64(k)) >> np.uint64(44)).astype(np.int64), hashes)
    filled = signature != empty
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for attempt in range(1, 64 * k):
        if not len(row):
            break
        source = _path(k, attempt)[col]
        hit = filled[row, source]
        signature[row[hit], col[hit]] = signature[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    return signature


def _copies(owner: np.ndarray, hashes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets without weights, as similar as the weighted ones: each element as often as it weighs, sorted."""
    if (weight == 1).all():
        return owner, hashes
    weight = weight.astype(np.int64)
    turn = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    owner, hashes = np.repeat(owner, weight), np.repeat(hashes, weight)
    hashes = np.where(turn == 0, hashes, mix64(hashes + (turn.astype(np.uint64) << np.uint64(44))) >> np.uint64(20))
    order = np.lexsort((hashes, owner))
    return owner[order], hashes[order]


def _sketches(sets: Sets, elements: Elements | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x.slice(a, SKETCH_ROWS) for x in text_slices(batches, "text", 1 << 20) for a in range(0, x.num_rows, SKETCH_ROWS)):
            texts = part.column("text").to_pylist()
            owner, hashes = elements(texts) if elements else _copies(*sets(texts))
            marks = (mix64(bin_signatures(owner, hashes, part.num_rows, SKETCH)) & np.uint64(255)).astype(np.uint8)
            size = pc.binary_length(part.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text"), size, pa.array([r.tobytes() for r in marks], pa.binary())], ["id", "text", "size", "sketch"])

    return run


def _marks(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, SKETCH)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches (along the last axis) agree in enough places."""
    words = (a == b).view(np.uint64).sum(axis=-1)  # of eight places each, one a byte
    return ((words * np.uint64(0x0101010101010101)) >> np.uint64(56)) >= SKETCH_LEAST


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(_agree(_marks(batch.column("sa")), _marks(batch.column("sb")))))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads outsiders (id, sketch, ahead: the later hubs of its run with their sketches); gives the likely pairs."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = pc.list_value_length(batch.column("ahead")).to_numpy()
        flat = batch.column("ahead").flatten()
        a, b = np.repeat(batch.column("id").to_numpy(), n), flat.field(0).to_numpy()
        own, other = _marks(batch.column("sketch")), _marks(flat.field(1))
        likely = _agree(own[np.repeat(np.arange(len(n)), n)], other) & (a != b)
        a, b = a[likely], b[likely]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def jaccard_pairs(left: list[str], right: list[str], sets: Sets) -> np.ndarray:
    """Exact (weighted) Jaccard similarity of texts, pair by pair; 0 for two empty sets."""
    owner, elements, weight = sets([t for pair in zip(left, right, strict=True) for t in pair])
    pair = owner // 2
    keys = (pair.astype(np.uint64) << np.uint64(44)) | elements
    total = np.bincount(pair, weights=weight, minlength=len(left))
    if (weight == 1).all():
        keys.sort()
        both = (keys[:-1][keys[1:] == keys[:-1]] >> np.uint64(44)).astype(np.int64)
        shared = np.bincount(both, minlength=len(left)).astype(np.float64)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weight = keys[order], weight[order]
        at = np.flatnonzero(keys[1:] == keys[:-1]) + 1
        shared = np.bincount((keys[at] >> np.uint64(44)).astype(np.int64), weights=np.minimum(weight[at], weight[at - 1]), minlength=len(left))
    return np.where(total > shared, shared / np.maximum(total - shared, 1), 0.0)


def plain_jaccard(left: list[str], right: list[str], elements: Elements) -> np.ndarray:
    """``jaccard_pairs`` of sets whose weights are all 1, by one sort of their ``elements``; at most 2^19 pairs."""
    owner, hashes = elements([t for pair in zip(left, right, strict=True) for t in pair])
    # Pair, element, side: equal elements of a pair are neighbours.
    sides = np.arange(2 * len(left), dtype=np.uint64)
    keys = (((sides >> np.uint64(1)) << np.uint64(45)) | (sides & np.uint64(1)))[owner]
    keys |= hashes << np.uint64(1)
    keys.sort()
    step = keys[1:] ^ keys[:-1]
    ends = np.arange(1, len(left) + 1, dtype=np.uint64) << np.uint64(45)
    total = np.diff(np.searchsorted(np.concatenate([keys[:1], keys[1:][step != 0]]), ends), prepend=0)
    shared = np.diff(np.searchsorted(keys[1:][step == 1], ends), prepend=0)
    return np.where(total > shared, shared / np.maximum(total - shared, 1), 0.0)


def _compare(sets: Sets, similarity: float, elements: Elements | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "ta", 1 << 20):
            for sub in (x.slice(a, PAIR_ROWS) for x in text_slices([part], "tb", 1 << 20) for a in range(0, x.num_rows, PAIR_ROWS)):
                left, right = sub.column("ta").to_pylist(), sub.column("tb").to_pylist()
                similar = (plain_jaccard(left, right, elements) if elements else jaccard_pairs(left, right, sets)) >= similarity
                yield pa.RecordBatch.from_arrays([sub.column("a"), sub.column("b")], ["u", "v"]).filter(pa.array(similar))

    return run


def _past_outsiders(sets: Sets, similarity: float):
    """Reads (c, chunks, shares, turn, id, own, text, sketch) in order: a chunk of outsiders (turn 0), then members (turn 1).

    Holds one chunk's outsiders and one slice of members. Sets are made only of members whose sketch agrees with that of an
    outsider of another class, and of the outsiders that they meet. Gives the links (outsider, member) of different classes,
    one for each outsider and class in a slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, index = None, [], None
        for part in text_slices(batches, "text", 1 << 19):
            rows = np.stack([part.column(c).to_numpy() for c in ("c", "chunks", "shares", "turn")], axis=1)
            all_ids, all_cls, all_marks, texts = part.column("id").to_numpy(), part.column("own").to_numpy(), _marks(part.column("sketch")), part.column("text")
            cuts = [0, *(np.flatnonzero((rows[1:] != rows[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                key, turn = tuple(rows[a, :3].tolist()), rows[a, 3]
                if key != group:
                    group, held, index = key, [], None
                if turn == 0:
                    held.append((all_ids[a:b], all_cls[a:b], all_marks[a:b], texts.slice(a, b - a).to_pylist()))
                    continue
                if not held:
                    continue
                if len(held) > 1:
                    held = [(*(np.concatenate(x) for x in list(zip(*held, strict=True))[:3]), [t for h in held for t in h[3]])]
                ids, cls, marks, own_texts = held[0]
                for x in range(a, b, MEMBERS):
                    y = min(x + MEMBERS, b)
                    likely = _agree(marks[:, None, :], all_marks[None, x:y, :]) & (cls[:, None] != all_cls[None, x:y])
                    at = x + np.flatnonzero(likely.any(axis=0))
                    if not len(at):
                        continue
                    if index is None:
                        o, h, w = sets(own_texts)
                        order = np.argsort(h, kind="stable")
                        index = (h[order], o[order], w[order], np.bincount(o, weights=w, minlength=len(ids)))
                    u, v = _links(index, cls, sets(texts.take(pa.array(at)).to_pylist()), all_cls[at], similarity)
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(all_ids[at][v])], ["u", "v"])

    return run


def _links(index: tuple, cls: np.ndarray, other: tuple, other_cls: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of similar (outsider, member) pairs of different classes, the first of each outsider and class."""
    hashes, owner, weight, total = index
    m_owner, m_hash, m_weight = other
    m_total = np.bincount(m_owner, weights=m_weight, minlength=len(other_cls))
    plain = bool((weight == 1).all() and (m_weight == 1).all())
    shared = np.zeros(len(total) * len(other_cls), np.int64 if plain else np.float64)
    owner, m_owner = (owner * len(other_cls)).astype(np.int32), m_owner.astype(np.int32)
    lows, highs = np.searchsorted(hashes, m_hash, "left"), np.searchsorted(hashes, m_hash, "right")
    cuts = np.searchsorted(np.cumsum(highs - lows), np.arange(0, int((highs - lows).sum()) + 1, MATCHES)[1:])
    for part in map(slice, [0, *cuts.tolist()], [*cuts.tolist(), len(m_hash)]):
        low, n = lows[part], highs[part] - lows[part]
        at = np.repeat(low - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        place = owner[at] + np.repeat(m_owner[part], n)
        shared += np.bincount(place, weights=None if plain else np.minimum(weight[at], np.repeat(m_weight[part], n)), minlength=len(shared))
    shared = shared.reshape(len(total), -1)
    union = total[:, None] + m_total[None, :] - shared
    u, v = np.nonzero((shared >= similarity * union) & (union > 0) & (cls[:, None] != other_cls[None, :]))
    _, first = np.unique(np.stack([u, other_cls[v]]), axis=1, return_index=True) if len(u) else (None, np.zeros(0, int))
    return u[first], v[first]
