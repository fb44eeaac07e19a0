"""Token-id output in plane-shuffled files.

File layout (all integers little-endian)::

    "TPLANES1"
    chunk*          each: the compressed planes of up to ``block`` ids, one after another
    document table  as chunks of int64 pairs (doc_id or the null mark, n_ids)
    index           JSON: mode, n_ids, n_docs, and per chunk offset, count, plane sizes, crc32
    int64 index offset, int64 index size, "TPLANES1"

A block of ids is seen as a matrix of bytes (or bits) with a row for each id; its transpose gives
one plane for each byte (or bit) position, and each plane is compressed by zstandard on its own.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditframe.llm.common import kept, text_slices
from auditframe.llm.pieces import Ages, cut_words, encode_plain, not_plain
from auditframe.session import materialize, scratch_path, ship

MAGIC = b"TPLANES1"
BLOCK = 1 << 16
LEVEL = 1
#: Bytes of text behind one file.
FILE_BYTES = 1 << 28
NULL_ID = -(1 << 63)


def shuffle(ids: np.ndarray, mode: str) -> list[bytes]:
    """Planes of little-endian unsigned integers, least significant byte or bit first."""
    ids = np.ascontiguousarray(ids)
    octets = ids.view(np.uint8).reshape(len(ids), ids.dtype.itemsize)
    if mode == "byte":
        return [octets[:, k].tobytes() for k in range(octets.shape[1])]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(bits.shape[1])]


def unshuffle(planes: list[bytes], count: int, dtype: str, mode: str) -> np.ndarray:
    if mode == "byte":
        octets = np.stack([np.frombuffer(p, np.uint8, count) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=count, bitorder="little") for p in planes], axis=1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view(dtype).reshape(-1)


class PlaneWriter:
    """Streams documents' ids into one file; holds one block and the document table."""

    def __init__(self, out: BinaryIO, mode: str = "byte", block: int = BLOCK, level: int = LEVEL) -> None:
        if mode not in {"byte", "bit"}:
            raise ValueError("mode is byte or bit")
        self.out, self.mode, self.block = out, mode, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.at, self.n_ids, self.chunks, self.docs, self.held, self.n_held = 0, 0, [], [], [], 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _chunk(self, values: np.ndarray) -> dict:
        planes = [self.zstd.compress(p) for p in shuffle(values, self.mode)]
        entry = {"at": self.at, "n": len(values), "planes": [len(p) for p in planes], "crc": zlib.crc32(values.tobytes())}
        for p in planes:
            self._put(p)
        return entry

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((NULL_ID if doc_id is None else doc_id, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.block:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        values = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        end = len(values) if all_of_it else len(values) // self.block * self.block
        for a in range(0, end, self.block):
            self.chunks.append(self._chunk(values[a : min(a + self.block, end)]))
        self.held, self.n_held = [values[end:]], len(values) - end

    def close(self) -> None:
        self._flush(True)
        table = np.array(self.docs, dtype="<i8").reshape(-1)
        docs = [self._chunk(table[a : a + 2 * self.block]) for a in range(0, len(table), 2 * self.block)]
        index = json.dumps({"mode": self.mode, "n_ids": self.n_ids, "n_docs": len(self.docs), "chunks": self.chunks, "docs": docs}).encode()
        at = self.at
        self._put(index)
        self._put(struct.pack("<qq", at, len(index)) + MAGIC)


class PlaneReader:
    """Random access by chunk; every chunk is checked against its crc32."""

    def __init__(self, file) -> None:  # a seekable binary file
        self.file = file
        file.seek(0, 2)
        size = file.tell()
        file.seek(size - 24)
        at, length, magic = struct.unpack("<qq8s", file.read(24))
        if magic != MAGIC:
            raise ValueError("not a plane file")
        file.seek(at)
        self.index = json.loads(file.read(length))
        self.zstd = zstandard.ZstdDecompressor()

    def _read(self, entry: dict, dtype: str) -> np.ndarray:
        self.file.seek(entry["at"])
        raw = self.file.read(sum(entry["planes"]))
        planes, at = [], 0
        for n in entry["planes"]:
            planes.append(self.zstd.decompress(raw[at : at + n]))
            at += n
        values = unshuffle(planes, entry["n"], dtype, self.index["mode"])
        if zlib.crc32(values.tobytes()) != entry["crc"]:
            raise ValueError("damaged chunk")
        return values

    def chunk(self, k: int) -> np.ndarray:
        return self._read(self.index["chunks"][k], "<u4")

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """Each document's id and its ids, as the parts that chunks hold; one chunk in memory at a time."""
        k, held = 0, np.zeros(0, "<u4")
        for entry in self.index["docs"]:
            for doc_id, n in self._read(entry, "<i8").reshape(-1, 2).tolist():
                parts = []
                while n:
                    if not len(held):
                        held = self.chunk(k)
                        k += 1
                    parts.append(held[:n])
                    held, n = held[n:], n - len(parts[-1])
                yield None if doc_id == NULL_ID else doc_id, parts


def _filesystem(uri: str):
    """A pyarrow file system and path for a folder's URI (file:, hdfs:, s3:, gs:), or a plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_planes(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[np.ndarray]]], folder: str, text: str = "text", doc_id: str = "doc_id", mode: str = "byte", partitions: int | None = None) -> DataFrame:
    """Encode ``text`` and write plane files in ascending doc_id order (null first); returns the file table.

    ``encoder()`` is called in the worker and gives a function from texts to id arrays. Each task of
    a range partitioning writes one file under a name of its own attempt, then renames it to
    ``part-NNNNN.planes``: a task run again writes the same bytes. There are as many files as shuffle
    partitions, or more, so that a file holds about ``FILE_BYTES`` of text. Rows that repeat a doc_id
    (or have none) are in the order of a hash of the text, then the text, and may be dealt over several
    files. File table: part, file, n_docs, n_ids; ascending part is ascending doc_id.
    The table is written, so reading it again does not write the files again. An empty table gives no file.
    """
    spark = docs.sparkSession
    ship(spark)
    columns = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(columns.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES))
    place = ["doc_id", F.xxhash64("text")]
    ordered = columns.repartitionByRange(n, *place).sortWithinPartitions(*place, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, writer, encode, stream = TaskContext.get(), None, None, None
        system, root = _filesystem(folder)
        part = context.partitionId()
        name = f"{root}/part-{part:05d}.planes"
        own = f"{name}.{context.taskAttemptId()}.tmp"
        try:
            for piece in text_slices(batches, "text", 2 << 20, keeps=_tokenizers):
                if writer is None:
                    system.create_dir(root, recursive=True)
                    stream = system.open_output_stream(own)
                    writer, encode = PlaneWriter(stream, mode), encoder()
                for i, ids in zip(piece.column("doc_id").to_pylist(), encode([t or "" for t in piece.column("text").to_pylist()]), strict=True):
                    writer.add(i, ids)
            if writer is not None:
                writer.close()
                stream.close()
                system.move(own, name)
                yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"part-{part:05d}.planes"], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]}, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
        except BaseException:
            if stream is not None and not stream.closed:
                stream.close()
                system.delete_file(own)
            raise

    return materialize(ordered.mapInArrow(run, "part int, file string, n_docs long, n_ids long"), "plane-files")


def read_planes(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Read plane files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    One task a file (a file is as large as one partition of the writer). The offsets of the files
    come from a running sum over the file table, which has a row for each file, not each document.
    """
    ship(spark)
    based = files.withColumn("base", F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    based = based.select("part", "file", F.coalesce("base", F.lit(0)).cast("long").alias("base")).repartitionByRange(max(files.count(), 1), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                rows: list[tuple] = []
                with system.open_input_file(f"{root}/{file}") as stream:
                    for doc_id, parts in PlaneReader(stream).documents():
                        crc, n = 0, 0
                        for x in parts:
                            crc, n = zlib.crc32(x.tobytes(), crc), n + len(x)
                        rows.append((doc_id, base, n, crc))
                        base += n
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return based.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


# --- encoding by the tokenizers library -------------------------------------------------------

#: Words that a worker keeps.
CACHE_WORDS = 700_000


class WordTokenizer:
    """Encodes texts by the tokenizers library; words of plain Latin text are encoded once and kept.

    The library normalises plain text character by character (NFC leaves it, white space parts words,
    lower case), so its words can be cut beforehand. They are encoded by the library in one text, a
    space between; each ends with a token whose string ends in ``</w>``. Other text goes to it whole,
    and so does text with the string of an added token, which the library gives the token's own id.
    """

    def __init__(self, model: str, end_id: int | None) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(model)
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        vocabulary = self.lib.get_vocab(with_added_tokens=False)
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        self.cache = Ages(CACHE_WORDS)

    def whole(self, text: str) -> bytes:
        """The library's ids of the text itself."""
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str], into: dict[str, bytes]) -> None:
        words = sorted(words)
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            ids = np.array(self.lib.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):  # not the expected shape: one by one
                into.update((w, self.whole(w)) for w in part)
                continue
            raw, at = ids.tobytes(), 0
            for word, end in zip(part, (4 * ends).tolist(), strict=True):
                into[word] = raw[at:end]
                at = end

    def lookup(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        return self.cache.lookup(words, self._learn)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        low = [t.lower() for t in texts]
        plain = [not not_plain(t) and not not_plain(x) and not any(a in t or a in x for a in self.added) for t, x in zip(texts, low, strict=True)]  # two capitals have small letters beyond the range
        cut = iter(encode_plain([x for x, p in zip(low, plain, strict=True) if p], cut_words, self.lookup, True))
        return [np.frombuffer((next(cut) if p else self.whole(t)) + self.end, "<u4") for t, p in zip(texts, plain, strict=True)]


_tokenizers: dict[tuple[int, int | None], WordTokenizer] = kept()


def word_encoder(spark: SparkSession, model_path: str, end_id: int | None = 1) -> Callable[[], WordTokenizer]:
    """An encoder for ``write_planes``: the model file (fixed size, about 1.7 MB) is read by the driver and broadcast."""
    with open(model_path, encoding="utf-8") as file:
        model = file.read()
    key, shared = zlib.crc32(model.encode()), spark.sparkContext.broadcast(model)

    def make() -> WordTokenizer:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if (key, end_id) not in _tokenizers:
            _tokenizers.clear()
            _tokenizers[(key, end_id)] = WordTokenizer(shared.value, end_id)
        return _tokenizers[(key, end_id)]

    return make


def encode_to_planes(docs: DataFrame, model_path: str, folder: str | None = None, end_id: int | None = 1, mode: str = "byte", **columns: str) -> tuple[DataFrame, str]:
    """Write ``docs`` as plane files; returns the file table and the folder.

    Null text counts as empty (only the end id is written), null doc_ids come first and stay null,
    repeated rows are written as often as they occur, other columns take no part.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "planes")
    return write_planes(docs, word_encoder(spark, model_path, end_id), folder, mode=mode, **columns), folder
