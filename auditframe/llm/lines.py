"""Fuzzy line deduplication.

Lines are sets of character shingles. A one-permutation MinHash signature (each of k bins keeps its
smallest hash, empty bins borrow from others) is banded for high recall; candidate pairs are verified
by exact Jaccard similarity, and distributed union-find gives components. The first line of each
component, in the order of doc_id and line number, stays. A changed character breaks as many shingles
as they are long, so short lines have shorter shingles; lines about the border have both kinds, as two
nodes, and meet lines of either side. Lines too short for that take part by equality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm.candidates import Bands, bin_signatures, classes, sampled
from auditframe.llm.common import mix64, text_slices
from auditframe.llm.dart import band_keys
from auditframe.session import materialize, ship

_HASH_BITS = np.uint64(44)


@dataclass(frozen=True)
class LineParams:
    """Lines under ``min_chars`` code points take part by equality alone, blank ones not at all. ``shingle`` and
    ``short_shingle`` are powers of two; a pair whose shorter line has under ``short_chars`` is compared by the
    latter."""

    min_chars: int = 20
    shingle: int = 8
    short_shingle: int = 4
    short_chars: int = 80
    bands: int = 14
    rows: int = 4
    similarity: float = 0.8
    seed: int = 1

    @property
    def border(self) -> int:
        """The first length with which no line under ``short_chars`` can be similar, repeats within lines aside."""
        return int((self.short_chars - self.short_shingle) / self.similarity) + self.short_shingle


def char_hashes(lines: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Character shingles of each line as (line number, 44-bit hash), in the order of the text.

    A line shorter than a shingle is padded by one shingle of its own characters and the border.
    """
    joined = "\n".join(lines) + "\n" * shingle
    h = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    step, factor = 1, 0x9E3779B97F4A7C15
    while step < shingle:
        rolled = h[:-step] * np.uint64(factor)
        rolled += h[step:]
        h = rolled
        step *= 2
        factor = (factor * 0xD6E8FEB86659FD93 + 2) & 0xFFFFFFFFFFFFFFFF | 1
    count = np.maximum(n - shingle + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(lines)), count)
    # Of each line and the break after it, the places where a shingle begins.
    begins = np.repeat(np.tile([True, False], len(lines)), np.stack([count, n + 1 - count], axis=1).reshape(-1))[: len(h)]
    hashes = mix64(h[: len(begins)][begins])
    hashes >>= np.uint64(20)
    return owner, hashes


def char_sets(lines: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct character shingles of each line as (line number, 44-bit hash, 1), sorted."""
    return _distinct(*char_hashes(lines, shingle))


def _distinct(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.sort((owner.astype(np.uint64) << _HASH_BITS) | hashes)
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    keys = keys[first]
    return (keys >> _HASH_BITS).astype(np.int64), keys & np.uint64((1 << 44) - 1), np.ones(len(keys), np.int64)


#: Before a line's text as the node of its short shingles; no line holds it.
_TWIN = "\n"


def line_elements(nodes: list[str], params: LineParams) -> tuple[np.ndarray, np.ndarray]:
    """``char_hashes`` of nodes: short shingles for lines under ``short_chars`` and twins, else long ones."""
    short = np.fromiter((x.startswith(_TWIN) or len(x) < params.short_chars for x in nodes), bool, len(nodes))
    found = []
    for kind, size in ((True, params.short_shingle), (False, params.shingle)):
        at = np.flatnonzero(short == kind)
        if len(at):
            owner, hashes = char_hashes([nodes[k].removeprefix(_TWIN) for k in at], size)
            found.append((at[owner], hashes))
    return (np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def line_sets(nodes: list[str], params: LineParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``char_sets`` of nodes, by the shingles of ``line_elements``."""
    return _distinct(*line_elements(nodes, params))


def _has_twin(params: LineParams, line: Column) -> Column:
    return F.length(line).between(params.short_chars, params.border)


#: Lines whose shingles are hashed at a time: they fit a CPU's cache.
HASHED = 512
#: Lines that a task remembers, by a hash of 64 bits that serves only in the task.
SEEN = 1 << 16


def _line_ids(lines: list[str]) -> np.ndarray:
    """Spark's xxhash64 of each line."""
    return np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in lines), np.uint64, len(lines)).view(np.int64)


def _line_bands(params: LineParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in text_slices(batches, "text", 1 << 20):
            fresh = {x for t in part.column("text").to_pylist() if t for x in t.split("\n") if len(x) >= params.min_chars}
            # Lines that this task has met give no more band rows.
            fresh = [x for x, h in zip(fresh, map(hash, fresh), strict=True) if not (h in seen or seen.add(h))] if seen else list(fresh)
            if len(seen) > SEEN or not seen:
                seen = set(map(hash, fresh))
            short = [x for x in fresh if len(x) < params.short_chars] + [_TWIN + x for x in fresh if params.short_chars <= len(x) <= params.border]
            long = [x for x in fresh if len(x) >= params.short_chars]
            for nodes, size in ((short, params.short_shingle), (long, params.shingle)):
                for a in range(0, len(nodes), 1 << 13):
                    some = nodes[a : a + (1 << 13)]
                    parts = [[x.removeprefix(_TWIN) for x in some[b : b + HASHED]] for b in range(0, len(some), HASHED)]
                    keys = np.concatenate([band_keys(bin_signatures(*char_hashes(x, size), len(x), params.bands * params.rows), params.bands, params.rows) for x in parts])
                    ids = _line_ids(some)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, params.bands))], ["key", "id"])

    return run


def _row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("null")), text)


def _takes_part(params: LineParams, line: Column) -> Column:
    return (F.length(line) >= params.min_chars) | (F.length(F.btrim(line, F.lit(_BLANKS))) > 0)


#: What a line of white space is made of.
_BLANKS = " \t\n\x0b\f\r"


def _named_lines(params: LineParams):
    """Adds to rows of (doc_id, row_key, text) the ids of their lines, null for those that take no part, and which lines are short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", 1 << 20):
            lists = [[] if t is None else t.split("\n") for t in part.column("text").to_pylist()]
            flat = [x for lines in lists for x in lines]
            ends = np.cumsum([0, *map(len, lists)])
            brief = np.fromiter((len(x) < params.min_chars for x in flat), bool, len(flat))
            blank = np.zeros(len(flat), bool)
            for k in np.flatnonzero(brief):
                blank[k] = not flat[k].strip(_BLANKS)
            ids = pa.array(_line_ids(flat), mask=blank)
            offsets = pa.array(ends.astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, pa.array(brief))], ["doc_id", "row_key", "ids", "brief"])

    return run


def named_lines(docs: DataFrame, params: LineParams, text: str, doc_id: str) -> DataFrame:
    """(doc_id, row_key, ids, brief) of every row: its lines by their 64-bit hashes, so that texts are split once for all steps."""
    ship(docs.sparkSession)
    own, body = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")
    keyed = docs.select(own.alias("doc_id"), _row_key(own, body).alias("row_key"), body.alias("text"))
    return materialize(keyed.mapInArrow(_named_lines(params), "doc_id long, row_key long, ids array<long>, brief array<boolean>"), "lines")


def kept_lines(docs: DataFrame, params: LineParams | None = None, text: str = "text", doc_id: str = "doc_id", named: DataFrame | None = None) -> DataFrame:
    """(row_key, kept): numbers of the lines of each row that are the first of their component.

    Rows all of whose lines go are absent. Equal lines are one node, named by a 64-bit hash. ``named``: ``named_lines`` of
    the rows, if there.
    """
    params = params or LineParams()
    named = named if named is not None else named_lines(docs, params, text, doc_id)
    texts = docs.filter(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`").alias("text"))
    found = _line_bands(params)
    line = F.explode(F.split("text", "\n", -1)).alias("line")
    twin = F.concat(F.lit(_TWIN), "line")
    nodes = F.explode(F.when(_has_twin(params, F.col("line")), F.array("line", twin)).otherwise(F.array("line")))
    fuzzy = texts.select(line).filter(F.length("line") >= params.min_chars).select(nodes.alias("text")).select(F.xxhash64("text").alias("id"), "text")
    line_of = F.when(F.startswith("text", F.lit(_TWIN)), F.xxhash64(F.substring("text", 2, 1 << 30)))
    known = classes(
        Bands(texts, found), fuzzy, lambda both: line_sets(both, params), params.similarity, sample=sampled(texts, F.col("text")).mapInArrow(found, "key long, id long"),
        twin_of=line_of, elements=lambda both: line_elements(both, params),
    )
    place = F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "row_key", "pos")
    # The first of equal lines, then the first of each component: both are minima with partial sums.
    lines = named.select("doc_id", "row_key", F.posexplode("ids").alias("pos", "id")).filter("id is not null")
    first = lines.groupBy("id").agg(F.min(place).alias("at"))
    keepers = first.join(known, "id", "left").groupBy(F.coalesce("component", "id").alias("c")).agg(F.min("at").alias("at"))
    return keepers.groupBy(F.col("at.row_key").alias("row_key")).agg(F.sort_array(F.collect_list("at.pos")).alias("kept"))


def line_report(docs: DataFrame, params: LineParams | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_lines, n_removed, removed, n_removed_short, removed_short (line numbers from 0) of every row.

    ``removed`` has lines of ``min_chars`` or more, ``removed_short`` shorter ones that equal an earlier line.
    Null and empty texts: a null has no lines, an empty text has one, which stays. Lines of white
    space under ``min_chars`` stay. Rows that repeat a doc_id and text share their
    lines' fate. Extra columns take no part.
    """
    params = params or LineParams()
    named = named_lines(docs, params, text, doc_id)
    kept = kept_lines(docs, params, text, doc_id, named)
    where = lambda brief: F.array_compact(F.transform("ids", lambda x, i: F.when(x.isNotNull() & (F.get("brief", i) == brief), i)))
    kept_parts = F.coalesce("kept", F.array().cast("array<int>"))
    out = named.join(kept, "row_key", "left").select(
        "doc_id", F.size("ids").cast("long").alias("n_lines"),
        F.array_except(where(False), kept_parts).alias("removed"), F.array_except(where(True), kept_parts).alias("removed_short"),
    )
    count = lambda name: F.size(name).cast("long").alias(f"n_{name}")
    return out.select("doc_id", "n_lines", count("removed"), "removed", count("removed_short"), "removed_short")


def dedup_lines(docs: DataFrame, params: LineParams | None = None, text: str = "text", doc_id: str = "doc_id", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; every row and column stays.

    ``n_chars``, if the table has it, becomes the length of the new text.
    """
    params = params or LineParams()
    kept = kept_lines(docs, params, text, doc_id)
    body = F.col(f"`{text}`")
    joined = docs.withColumn("__key", _row_key(F.col(f"`{doc_id}`").cast("long"), body)).join(kept.select(F.col("row_key").alias("__key"), F.col("kept").alias("__kept")), "__key", "left")
    stay = F.filter(F.split(body, "\n", -1), lambda x, i: ~_takes_part(params, x) | F.coalesce(F.array_contains("__kept", i), F.lit(False)))
    out = joined.withColumn(text, F.array_join(stay, "\n"))
    if n_chars and n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(body).cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
