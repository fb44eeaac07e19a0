"""Passages that repeat across documents, by level-wise doubling.

A window is ``window`` consecutive words. Whether one repeats is asked at about a quarter of its length
first, then at half of it, then whole: only what repeats at one length is extended to twice that
length, and the levels end as soon as nothing survives. Below the whole length a window stands for itself by one gram, the
one of the smallest hash among all grams of that length inside it. Equal windows hold equal grams, so they have
the same such gram: no repeat is lost, and a document sends about 2 / (window - length + 2) grams a word instead of all.
Grams are 64-bit hashes, whole windows are compared by 128 bits.

Documents of equal words are one node: of each group only the smallest doc_id takes part, the others are
repeats as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import mix64, text_slices
from auditframe.session import materialize, ship

WINDOW = 50
#: The shortest grams that a level may ask for.
SHORTEST = 8
#: Words whose bytes are hashed at a time.
HASH_WORDS = 1 << 16
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BASE = 0x9E3779B97F4A7C15
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def levels(window: int) -> list[int]:
    """Lengths asked for one after another: halves of the window, rounded up, from ``SHORTEST`` words on."""
    found = [window]
    while (half := (found[0] + 1) // 2) >= SHORTEST:
        found.insert(0, half)
    return found


class Words:
    """The words of a slice of texts: bytes, where words begin and end, and the words of each text."""

    def __init__(self, texts: pa.Array) -> None:
        column = texts.fill_null("").cast(pa.large_string())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.raw = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]]
        bounds = at - at[0]
        word = _WORD[self.raw]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        edge = bounds[(bounds > 0) & (bounds < len(word))]
        first[edge] = word[edge]
        last[edge - 1] = word[edge - 1]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.begin, bounds)
        self.n_words = np.diff(self.bounds)

    def hashes(self, seed: int) -> np.ndarray:
        """64 bits of each word: a polynomial in an odd base, with a random value for each byte."""
        values = mix64(np.arange(256, dtype=np.uint64), 2 * seed + 1)
        base = mix64(np.array([seed], np.uint64), 77)[0] | np.uint64(1)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        out = np.empty(len(self.begin), np.uint64)
        for a in range(0, len(out), HASH_WORDS):
            begin, end = self.begin[a : a + HASH_WORDS], self.end[a : a + HASH_WORDS]
            low = begin[0]
            part = self.raw[low : end[-1]]
            power, back = _powers(base, len(part)), _powers(inverse, len(part))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(values[part] * power, out=sums[1:])
            out[a : a + HASH_WORDS] = (sums[end - low] - sums[begin - low]) * back[begin - low]
        return mix64(out, seed)

    def starts(self, window: int) -> np.ndarray:
        """Of each word whether a whole window starts there."""
        left = np.repeat(self.bounds[1:], self.n_words) - np.arange(len(self.begin))
        return left >= window

    def joined(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """The words of text ``i`` (those of the mask ``keep``), joined by one space."""
        a, b = self.bounds[i], self.bounds[i + 1]
        begin, end = self.begin[a:b], self.end[a:b]
        if keep is not None:
            begin, end = begin[keep], end[keep]
        if not len(begin):
            return b""
        low, high = begin[0], end[-1]
        mark = np.zeros(high - low + 1, np.int8)
        mark[begin - low] += 1
        mark[end - low] -= 1
        inside = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
        inside[begin[1:] - 1 - low] = True  # the separator before each word but the first
        out = self.raw[low:high].copy()
        out[begin[1:] - 1 - low] = 0x20
        return out[inside].tobytes()


_tables: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** (0 to n - 1); kept for parts of usual size."""
    table = _tables.get(int(base))
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 16), base, np.uint64)
        table[0] = 1
        table = np.cumprod(table)
        if n <= 1 << 20:
            _tables[int(base)] = table
    return table[:n]


def grams(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all ``length`` consecutive words, each made of two of half that length."""
    if length == 1:
        return hashes
    half = (length + 1) // 2
    short = grams(hashes, half)
    step = length - half
    if len(short) <= step:
        return np.zeros(0, np.uint64)
    return mix64(short[:-step] * np.uint64(_BASE) + mix64(short[step:]))


def smallest(values: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each ``n`` consecutive values."""
    k = 1
    while 2 * k <= n:
        values, k = np.minimum(values[:-k], values[k:]), 2 * k
    return np.minimum(values[: len(values) - (n - k)], values[n - k :]) if n > k else values


def _keys(words: np.ndarray, length: int, window: int) -> np.ndarray:
    """Of each start of a window the gram of ``length`` words that stands for it."""
    if len(words) < window:
        return np.zeros(0, np.uint64)
    return smallest(grams(words, length), window - length + 1)


def _alive(words: Words, batch: pa.RecordBatch, first: np.ndarray, level: int, window: int) -> np.ndarray:
    """Starts whose key at ``level`` is among the row's surviving ones (column ``alive``)."""
    keys = _keys(first, level, window)
    at = np.flatnonzero(words.starts(window))
    owner = np.repeat(np.arange(len(words.n_words)), words.n_words)[at].astype(np.uint64)
    lists = batch.column("alive")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    of = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), np.asarray(lists.value_lengths().fill_null(0)))
    known = np.sort(mix64(flat ^ mix64(of)))
    if not len(known):
        return at[:0]
    asked = mix64(keys[at] ^ mix64(owner))
    return at[known[np.searchsorted(known, asked).clip(max=len(known) - 1)] == asked]


def _lists(values: np.ndarray, at: np.ndarray, words: Words, kind: pa.DataType) -> pa.Array:
    """Values of the starts ``at`` as a list for each text."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, words.bounds), pa.int32()), pa.array(values, kind))


def _changes(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions of ``at`` where the key differs from that of the start right before; a text's first start always counts."""
    new = np.ones(len(at), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (at[1:] != at[:-1] + 1)
    return new


def _first_level(level: int, window: int):
    """Rows (doc_id, text) to (doc_id, n_words, seq, keys): the hash of all words, and the keys of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            words = Words(part.column("text"))
            keys = _keys(words.hashes(0), level, window)
            at = np.flatnonzero(words.starts(window))
            at = at[_changes(keys[at], at)]
            seq = [hashlib.sha256(words.joined(i)).hexdigest() for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.n_words, pa.int64()), pa.array(seq), _lists(keys[at].view(np.int64), at, words, pa.int64())], ["doc_id", "n_words", "seq", "keys"])

    return run


def _next_level(before: int, level: int, window: int):
    """Rows (doc_id, text, alive) to (doc_id, keys): the keys at ``level`` of windows that survived at ``before``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            words = Words(part.column("text"))
            first = words.hashes(0)
            at = _alive(words, part, first, before, window)
            keys = _keys(first, level, window)
            at = at[_changes(keys[at], at)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(keys[at].view(np.int64), at, words, pa.int64())], ["doc_id", "keys"])

    return run


def _whole_level(before: int, window: int):
    """Rows (doc_id, text, alive) to (doc_id, seq, start, a, b): whole windows that survived at ``before``; all of them where that is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            words = Words(part.column("text"))
            first = words.hashes(0)
            at = _alive(words, part, first, before, window) if before else np.flatnonzero(words.starts(window))
            a, b = (_keys(x, window, window)[at].view(np.int64) for x in (first, words.hashes(1)))
            seq = [hashlib.sha256(words.joined(i)).hexdigest() for i in range(part.num_rows)]
            start = at - words.bounds[np.searchsorted(words.bounds, at, "right") - 1]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(seq), _lists(start, at, words, pa.int32()), _lists(a, at, words, pa.int64()), _lists(b, at, words, pa.int64())], ["doc_id", "seq", "start", "a", "b"])

    return run


def _survivors(keys: DataFrame) -> DataFrame:
    """(doc_id, alive): the keys of each document that a second document has, from (doc_id, keys)."""
    flat = keys.select("doc_id", F.explode("keys").alias("key"))
    # Written, so that both sides of the join are dealt anew and Spark can split a key of many documents.
    repeated = materialize(flat.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("key"), "repeated-keys")
    return flat.join(repeated, "key").groupBy("doc_id").agg(F.collect_set("key").alias("alive"))


def repeated_passages(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, seq, n_words and spans of every row: what is covered by windows that also start in a document of a smaller doc_id.

    Words are runs of characters other than blanks (``[^\\x20\\x09-\\x0D]+``), taken unchanged from whole
    texts; ``seq`` is the lowercase SHA-256 of all words joined by one space. Spans are (first word, word
    behind the last), in order and apart from each other. All windows are judged on the input.

    Null and empty texts have no words and no spans. Rows of one doc_id are not repeats of one another;
    a null doc_id is neither smaller nor larger than any, so such a row has no spans and gives none to
    others. Rows that repeat doc_id and text share their result. An empty table gives an empty result.
    Other columns take no part.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text"))
    lengths = levels(window)
    seen = materialize(rows.mapInArrow(_first_level(lengths[0], window), "doc_id long, n_words long, seq string, keys array<long>"), "passages")
    # Written, so that both sides of the join are dealt anew and Spark can split a large group of copies.
    lowest = materialize(seen.filter("doc_id is not null").groupBy("seq").agg(F.min("doc_id").alias("rep")), "passage-firsts")
    ranked = materialize(seen.select("doc_id", "seq", "n_words").join(lowest, "seq", "left"), "passage-groups")
    copies = ranked.filter(F.col("doc_id") > F.col("rep")).select("doc_id", "seq").distinct()
    one = seen.filter(F.size("keys") > 0).join(ranked.filter("doc_id = rep").select("doc_id", "seq").distinct(), ["doc_id", "seq"])
    keys = one.select("doc_id", "keys")
    span = "array<struct<begin:long,end:long>>"
    found = None
    for before, level in zip([0, *lengths], lengths, strict=False):
        if before:
            alive = materialize(_survivors(keys), f"passages-{before}")
            if alive.isEmpty():
                break
            left = rows.join(alive, "doc_id")
        else:
            left = rows.filter("doc_id is not null").withColumn("alive", F.array().cast("array<long>"))
        if level == window:
            whole = left.mapInArrow(_whole_level(before, window), "doc_id long, seq string, start array<int>, a array<long>, b array<long>")
            found = _repeated(materialize(whole, "windows"), window)
        elif before:
            keys = materialize(left.mapInArrow(_next_level(before, level, window), "doc_id long, keys array<long>"), f"keys-{level}")
    plain = ranked.select("doc_id", "seq", "n_words")
    all_of_it = F.when(F.col("n_words") >= window, F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_words").alias("end"))))
    marked = plain.join(copies.withColumn("copy", F.lit(True)), ["doc_id", "seq"], "left")
    if found is not None:
        marked = marked.join(found, ["doc_id", "seq"], "left")
    spans = F.when(F.col("copy"), all_of_it).otherwise(F.col("spans") if found is not None else F.lit(None).cast(span))
    return marked.select("doc_id", "seq", "n_words", F.coalesce(spans, F.array().cast(span)).alias("spans"))


def _repeated(windows: DataFrame, window: int) -> DataFrame:
    """(doc_id, seq, spans) of documents that hold windows of a smaller doc_id, from whole windows."""
    zipped = windows.select("doc_id", F.xxhash64("seq").alias("row"), F.explode(F.arrays_zip("start", "a", "b")).alias("w"))
    flat = zipped.select("doc_id", "row", "w.*")
    # Written for the same reason as the keys of a level.
    lowest = materialize(flat.groupBy("a", "b").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("a", "b", "low"), "repeated-windows")
    later = flat.join(lowest, ["a", "b"]).filter(F.col("doc_id") > F.col("low"))
    starts = later.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("start")).alias("starts"))
    of = windows.select("doc_id", "seq", F.xxhash64("seq").alias("row")).distinct()
    return starts.join(of, ["doc_id", "row"]).select("doc_id", "seq", _merged(F.col("starts"), window).alias("spans"))


def _merged(starts: Column, window: int) -> Column:
    """Ascending starts of windows as spans (begin, end) apart from each other."""
    n = F.size(starts)
    opens = F.filter(starts, lambda x, i: (i == 0) | (x > F.get(starts, i - 1) + window))
    closes = F.filter(starts, lambda x, i: (i == n - 1) | (F.get(starts, i + 1) > x + window))
    return F.zip_with(opens, closes, lambda a, b: F.struct(a.cast("long").alias("begin"), (b + window).cast("long").alias("end")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        words = Words(part.column("text"))
        seq, texts = [], []
        for i, spans in enumerate(part.column("spans").to_pylist()):
            seq.append(hashlib.sha256(words.joined(i)).hexdigest())
            keep = np.ones(words.n_words[i], bool)
            for s in spans:
                keep[s["begin"] : s["end"]] = False
            texts.append(words.joined(i, keep).decode())
        rest = [part.column(c) for c in ("doc_id", "seq")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(seq), pa.array(texts)], ["doc_id", "seq", "own", "kept_text"])


def remove_passages(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, seq, kept_text of documents that lose words: the words outside the spans of ``passages``, joined by one space.

    Only texts that have spans are moved. Rows that repeat doc_id and words give one row.
    """
    ship(docs.sparkSession)
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text"))
    some = passages.filter(F.size("spans") > 0).select("doc_id", "seq", "spans").dropDuplicates(["doc_id", "seq"])
    cut = rows.join(some, "doc_id").mapInArrow(_cut, "doc_id long, seq string, own string, kept_text string")
    return cut.filter("seq = own").drop("own").dropDuplicates(["doc_id", "seq"])


def dedup_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans of every row, by ``repeated_passages`` and ``remove_passages``."""
    found = materialize(repeated_passages(docs, window), "spans")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    counted = found.withColumn("n_removed", removed)
    partly = counted.filter((F.col("n_removed") > 0) & (F.col("n_removed") < F.col("n_words")))
    digests = remove_passages(docs, partly).select("doc_id", "seq", F.sha2("kept_text", 256).alias("rest"))
    joined = counted.join(digests, ["doc_id", "seq"], "left")
    kept = F.when(F.col("n_removed") == 0, F.col("seq")).when(F.col("n_removed") == F.col("n_words"), F.lit(_EMPTY_SHA)).otherwise(F.col("rest"))
    return joined.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"), "spans")
