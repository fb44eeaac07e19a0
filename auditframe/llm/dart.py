"""DartMinHash near-duplicates.

Every element (a hashed shingle) of a weighted set is a column of the half plane of weight and rank.
Darts thrown there by a hash, the same for all sets, hit a set where their weight is at most the
element's. Rank is cut into cells with a Poisson number of darts each; a set looks only at cells below
the rank where it expects enough hits for all coordinates. Each dart belongs to one coordinate, and
the earliest dart of each is that coordinate's value: a weighted minwise sample, in time about the
number of elements plus k log k. Bands of coordinates give candidates, exact Jaccard the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditframe.llm.candidates import Bands, classes, sampled
from auditframe.llm.common import mix64, text_slices, unit
from auditframe.session import materialize, ship

_HASH_BITS = np.uint64(44)
_SLOT_BITS = 64 - 44


@dataclass(frozen=True)
class DartParams:
    """``bands`` of ``rows`` coordinates each; shingles of ``words`` words; links at ``similarity`` or more."""

    bands: int = 20
    rows: int = 4
    words: int = 5
    similarity: float = 0.8
    weighted: bool = False  # weights: how often a shingle occurs, instead of 1
    seed: int = 1

    @property
    def k(self) -> int:
        return self.bands * self.rows


_CACHE = 200_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_word_hash = _WordHash()


def shingles(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of texts, one after another, and how many each text has.

    Words are runs of anything but ASCII white space. A text of fewer words than a shingle is one
    shingle; a text without words has none.
    """
    lists = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    total = int(n.sum())
    get = _word_hash.__getitem__
    flat = np.fromiter(map(get, chain.from_iterable(lists)), np.uint64, total)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    if not total:
        return np.zeros(0, np.uint64), count
    padded = np.concatenate([flat, np.zeros(words, np.uint64)])
    rolled = np.zeros(total, np.uint64)
    for k in range(words):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + total]
    starts = np.cumsum(n) - n
    short = np.flatnonzero((n > 0) & (n < words))
    for d in short.tolist():  # few words each
        h = 0x51ED270B
        for x in flat[starts[d] : starts[d] + n[d]].tolist():
            h = (h * 0x9E3779B97F4A7C15 + x) & 0xFFFFFFFFFFFFFFFF
        rolled[starts[d]] = h
    rank = np.arange(total) - np.repeat(starts, n)
    return mix64(rolled[rank < np.repeat(count, n)]), count


def weighted_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text as (text number, 44-bit hash, occurrences), sorted."""
    hashes, n = shingles(texts, words)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), n)
    keys = np.sort((owner << _HASH_BITS) | (hashes >> np.uint64(_SLOT_BITS)))
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    keys = keys[at]
    return (keys >> _HASH_BITS).astype(np.int64), keys & np.uint64((1 << 44) - 1), np.diff(np.append(at, len(first)))


#: Rank cells: one up to 2^-7, then doubling up to 1, then one of width 1 after another.
_FIRST = -7


def _cell(c: int) -> tuple[float, float]:
    if c == 0:
        return 0.0, 2.0**_FIRST
    if c <= -_FIRST:
        return 2.0 ** (_FIRST + c - 1), 2.0 ** (_FIRST + c)
    low = float(c + _FIRST)
    return low, low + 1.0


def _poisson_tail(area: float) -> list[float]:
    """P(count <= d) for d = 0, 1, ... until nothing is left."""
    out, term, total = [], float(np.exp(-area)), 0.0
    d = 0
    while total < 1 - 1e-15 and d < 200:
        total += term
        out.append(total)
        d += 1
        term *= area / d
    return out


#: Quantum of ranks in signatures: the earliest dart's rank is its name.
_QUANTUM = 2.0**30
_EMPTY = np.iinfo(np.uint64).max


def dart_signatures(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_sets: int, k: int, seed: int = 1) -> np.ndarray:
    """Signatures (n_sets x k) of weighted sets; rows of empty sets hold only ``_EMPTY``.

    ``weights`` are whole numbers of at least 1: weight is cut into layers [0,1), [1,2), [2,4), ...,
    and in a layer darts above the element's weight miss.
    """
    signature = np.full((n_sets, k), _EMPTY, np.uint64)
    size = np.bincount(owner, weights=weights, minlength=n_sets)
    wanted = k * np.log(k) + 2 * k
    need = np.zeros(n_sets)
    need[size > 0] = wanted / size[size > 0]
    top = int(np.ceil(np.log2(weights.max()))) if len(weights) else 0
    layers = [(0.0, 1.0), *((2.0**j, 2.0 ** (j + 1)) for j in range(top))]
    live = size > 0
    own, el, wt = owner, elements, weights
    c = 0
    while len(own):
        low, high = _cell(c)
        got_owner, got_value, got_slot = [], [], []
        for layer, (w0, w1) in enumerate(layers):
            if layer:
                deep = wt > w0
                own_l, el_l, wt_l = own[deep], el[deep], wt[deep]
            else:
                own_l, el_l, wt_l = own, el, wt
            if not len(own_l):
                continue
            base = mix64(el_l, seed * 1_000_003 + layer * 4099 + c)
            u = unit(base)
            for d, tail in enumerate(_poisson_tail((high - low) * (w1 - w0))):
                more = u > tail  # the element has more than d darts in this cell
                if not more.any():
                    break
                own_l, wt_l, base, u = own_l[more], wt_l[more], base[more], u[more]
                dart = mix64(base, 2 * d + 1)
                hit = slice(None)
                if layer:
                    hit = w0 + (w1 - w0) * unit(mix64(dart, 3)) <= wt_l
                    dart = dart[hit]
                rank = low + (high - low) * unit(dart)
                got_owner.append(own_l[hit])
                got_value.append((rank * _QUANTUM).astype(np.uint64))
                got_slot.append((mix64(dart, 5) % np.uint64(k)).astype(np.int64))
        if got_owner:
            o, v, s = np.concatenate(got_owner), np.concatenate(got_value), np.concatenate(got_slot)
            np.minimum.at(signature.reshape(-1), o * k + s, v)
        # A set goes on while it is below its rank, or has an empty coordinate.
        c += 1
        at = np.flatnonzero(live & (need <= high))
        if len(at):
            full = at[(signature[at] != _EMPTY).all(axis=1)]
            if len(full):
                live[full] = False
                stay = live[own]
                own, el, wt = own[stay], el[stay], wt[stay]
    return signature


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each set and band."""
    of_bands = signature[:, : bands * rows].reshape(-1, bands, rows)
    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(signature), axis=0)
    for r in range(rows):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + of_bands[:, :, r], r)
    return keys


#: Ids that a task remembers, so that a copy it has seen gives no more band rows.
SEEN = 1 << 16


def _text_bands(params: DartParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in text_slices(batches, "text", 2 << 20):
            for a in range(0, part.num_rows, 1 << 13):
                sub = part.slice(a, 1 << 13)
                fresh = []
                for k, i in enumerate(sub.column("id").to_pylist()):
                    if i not in seen:
                        seen.add(i)
                        fresh.append(k)
                if len(seen) > SEEN:
                    seen.clear()
                if len(fresh) < sub.num_rows:
                    sub = sub.take(pa.array(fresh, pa.int64()))
                owner, elements, count = weighted_sets(sub.column("text").to_pylist(), params.words)
                weights = count if params.weighted else np.ones(len(count), np.int64)
                some = np.unique(owner)
                if not len(some):
                    continue
                keys = band_keys(dart_signatures(owner, elements, weights, sub.num_rows, params.k, params.seed)[some], params.bands, params.rows)
                ids = sub.column("id").to_numpy()[some]
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, params.bands))], ["key", "id"])

    return run


_WORD = "[^\\x20\\x09-\\x0D]"
#: Stands for a null doc_id in a key.
_NO_ID = -(1 << 63)


def _linked(docs: DataFrame, params: DartParams, body: Column) -> DataFrame:
    """(id, component) of the texts with words that have near duplicates."""
    texts = docs.select(F.xxhash64(body).alias("id"), body.alias("text"))

    def sets(both: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, elements, count = weighted_sets(both, params.words)
        return owner, elements, count if params.weighted else np.ones(len(count), np.int64)

    found = _text_bands(params)
    return classes(Bands(texts, found), texts, sets, params.similarity, sample=sampled(texts, F.col("text")).mapInArrow(found, "key long, id long"))


def near_duplicates(docs: DataFrame, params: DartParams | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Add text_id (a hash of the text), class_id, own and first to every row.

    Texts that are equal are one node (their 64-bit hash), so copies cost nothing beyond their own row.
    Nodes whose shingle sets are similar are linked; a class is a connected part, and class_id is the
    smallest doc_id in it (null if none has one). ``own`` marks the text that is kept of each class,
    that of the smallest doc_id, and ``first`` is the smallest doc_id of the row's own text.

    Texts without words (null, empty, white space) are classes of their own, row by row: never a
    duplicate. Columns named like an output are replaced. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    params = params or DartParams()
    made = ["text_id", "class_id", "own", "first"]
    names = [c for c in docs.columns if c not in made]
    base = docs.select(*[docs[f"`{c}`"] for c in names])
    body = F.col(f"`{text}`")
    has_words = F.coalesce(body.rlike(_WORD), F.lit(False))
    by_text = _by_text(base, has_words, _linked(base.filter(has_words), params, body), body, doc_id)
    own_id = F.col(f"`{doc_id}`").cast("long")
    # Rows without words meet nothing; each goes by its doc_id, so that they do not gather in one task.
    keyed = base.withColumn("text_id", F.when(has_words, F.xxhash64(body)))
    named = by_text.withColumnRenamed("text_id", "__id")
    on = (F.coalesce("text_id", F.xxhash64(own_id)) == F.col("__id")) & F.col("text_id").isNotNull()
    return keyed.join(named, on, "left").select(*[F.col(f"`{c}`") for c in names], "text_id", F.when(F.col("text_id").isNull(), own_id).otherwise(F.col("class_id")).alias("class_id"), "own", "first")


def _by_text(base: DataFrame, has_words: Column, known: DataFrame, body: Column, doc_id: str) -> DataFrame:
    """(text_id, class_id, own, first): a row for each text with words; only hashes and ids move."""
    rows = base.filter(has_words).select(F.col(f"`{doc_id}`").cast("long").alias("__doc"), F.xxhash64(body).alias("id"))
    nodes = rows.groupBy("id").agg(F.min("__doc").alias("first"))
    named = nodes.join(known, "id", "left").select("id", "first", F.coalesce("component", "id").alias("c"))
    smallest = named.groupBy("c").agg(F.min("first").alias("class_id"), F.min_by("id", F.struct(F.col("first").isNull(), F.col("first"), F.col("id"))).alias("keep_id"))
    return materialize(named.join(smallest, "c").select(F.col("id").alias("text_id"), "class_id", (F.col("id") == F.col("keep_id")).alias("own"), F.col("first")), "classes")


def keep_one(docs: DataFrame, params: DartParams | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with one of each class; rows without words all stay.

    Rows that repeat the keeper's doc_id and text are reduced to one. Rows meet their class by text and
    doc_id together, so many copies of one text are dealt over many tasks.
    """
    spark = docs.sparkSession
    ship(spark)
    params = params or DartParams()
    body, own_id = F.col(f"`{text}`"), F.col(f"`{doc_id}`").cast("long")
    has_words = F.coalesce(body.rlike(_WORD), F.lit(False))
    by_text = _by_text(docs, has_words, _linked(docs.filter(has_words), params, body), body, doc_id)
    keepers = by_text.filter("own").select(F.col("text_id").alias("__text"), F.coalesce("first", F.lit(_NO_ID)).alias("__doc"))
    keyed = docs.filter(has_words).withColumns({"__text": F.xxhash64(body), "__doc": F.coalesce(own_id, F.lit(_NO_ID))})
    turn = F.row_number().over(Window.partitionBy("__text", "__doc").orderBy(F.lit(1)))
    kept = keyed.join(keepers, ["__text", "__doc"], "left_semi").withColumn("__turn", turn).filter("__turn = 1")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter(~has_words))
