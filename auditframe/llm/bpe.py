"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token with which the BPE encoding of
that prefix ends. ``PrefixEncoder`` stores it per prefix, so appending bytes only extends the
table and an edit only recomputes the table from the edit on, until it meets the old table again.
A candidate token ending at position i is the right one if it begins the piece, or if it and the
last token of the prefix before it stay apart under the merges (``pair_ok``).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from auditframe.llm.common import kept, text_slices
from auditframe.llm.pieces import Ages, cut_gpt, encode_plain, not_plain
from auditframe.session import ship

#: Entries that a worker's caches may hold.
CACHE_ENTRIES = 250_000
PAIR_ENTRIES = 200_000
#: The pattern that ``pieces.cut_gpt`` knows (a fixed value of the vocabulary).
GPT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_INF = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class PrefixBPE:
    """Exact BPE over the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        # Tokens by their bytes from the last to the first: (node << 8 | byte) to the next node, and each node's token.
        self.step: dict[int, int] = {}
        self.ends: list[int | None] = [None]
        for token, rank in ranks.items():
            node = 0
            for byte in reversed(token):
                node = self.step.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(None)
            self.ends[node] = rank
        self._parents: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}
        self._left: dict[int, list[int]] = {}
        self._right: dict[int, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Plain BPE by repeated lowest-rank merges: the definition, quadratic."""
        parts, last = [bytes([b]) for b in piece], None
        while len(parts) > 1:
            best = min(((self.ranks.get(a + b, _INF), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == _INF:
                break
            i = best[1]
            last = (self.ranks[parts[i]], self.ranks[parts[i + 1]])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 1:
            self._parents[self.ranks[piece]] = last
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte."""
        if token not in self._parents:
            if self.merge(self.token[token]) != [token]:
                raise ValueError(f"token {token} cannot be reached by merges")
        return self._parents[token]

    def _spine(self, token: int, side: int) -> list[int]:
        """Tokens that stand at one end of ``token`` while it is merged, first its byte."""
        spine = [token]
        while (parts := self.halves(spine[-1])) is not None:
            if max(parts) >= spine[-1] and len(self.token[spine[-1]]) > 2:
                raise ValueError("ranks must grow along merges")
            spine.append(parts[side])
        return spine[::-1]

    def pair_ok(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a and b apart when one follows the other.

        Both sides grow along their spines in rank order. They join if, at some time, the two
        tokens then at the border make a token of lower rank than what either side does next
        (at equal ranks the leftmost merge comes first).
        """
        known = self._pairs.get(a << 32 | b)
        if known is not None:
            return known
        left = self._right.get(a) or self._right.setdefault(a, self._spine(a, 1))
        right = self._left.get(b) or self._left.setdefault(b, self._spine(b, 0))
        i = j = 0
        ok = True
        while True:
            nxt = left[i + 1] if i + 1 < len(left) else _INF
            nyt = right[j + 1] if j + 1 < len(right) else _INF
            joined = self.ranks.get(self.token[left[i]] + self.token[right[j]], _INF)
            if joined < nxt and joined <= nyt and joined != _INF:
                ok = False
                break
            if nxt == nyt == _INF:
                break
            if nxt <= nyt:
                i += 1
            else:
                j += 1
        if len(self._pairs) >= PAIR_ENTRIES:
            self._pairs.clear()
        self._pairs[a << 32 | b] = ok
        return ok


class PrefixEncoder:
    """The table of last tokens of one growing, editable piece."""

    def __init__(self, bpe: PrefixBPE, piece: bytes = b"") -> None:
        self.bpe, self.piece, self.last = bpe, b"", []
        self.append(piece)

    def _token_at(self, end: int) -> int:
        piece, last, bpe = self.piece, self.last, self.bpe
        step, ends, pairs = bpe.step.get, bpe.ends, bpe._pairs
        node, found = 0, []
        for start in range(end - 1, -1, -1):
            node = step(node << 8 | piece[start])
            if node is None:
                break
            if ends[node] is not None:
                found.append((start, ends[node]))
        for start, token in reversed(found):  # the longest first
            if not start:
                return token
            before = last[start - 1]
            ok = pairs.get(before << 32 | token)
            if ok or ok is None and bpe.pair_ok(before, token):
                return token
        raise ValueError("no token ends here: a byte lacks a rank")

    def append(self, more: bytes) -> None:
        """Extend the piece; the table of what stood before stays as it is."""
        first = len(self.piece)
        self.piece += more
        for end in range(first + 1, len(self.piece) + 1):
            self.last.append(self._token_at(end))

    def truncate(self, length: int) -> None:
        """Cut the piece; every prefix keeps its entry."""
        self.piece = self.piece[:length]
        del self.last[length:]

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in the place of piece[start:end]; returns how many entries were recomputed.

        An entry depends on the ``longest`` entries before it and as many bytes. Once that many
        entries in a row equal the old ones, all later ones do.
        """
        tail, old = self.piece[end:], self.last[end:]
        self.truncate(start)
        self.append(new)
        self.piece += tail
        done, same = len(new), 0
        for k in range(len(tail)):
            token = self._token_at(len(self.last) + 1)
            self.last.append(token)
            done += 1
            same = same + 1 if token == old[k] else 0
            if same >= self.bpe.longest:
                self.last.extend(old[k + 1 :])
                break
        return done

    def ids(self) -> list[int]:
        out, end = [], len(self.piece)
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.bpe.token[token])
        return out[::-1]


class PieceCodec:
    """Encodes texts piece by piece, each match of the pattern by itself, with a bounded cache."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.bpe, self.find = PrefixBPE(ranks), regex.compile(pattern).findall
        self.cut = cut_gpt if pattern == GPT_PATTERN else None  # other patterns: the regular expression itself
        self.packed = {rank: rank.to_bytes(4, "little") for rank in ranks.values()}
        self.cache = Ages(CACHE_ENTRIES)

    def learn(self, pieces: list[str], cache: dict[str, bytes]) -> None:
        """Encode unseen pieces in byte order: a piece only appends to the prefix it shares with the one before."""
        ranks, packed = self.bpe.ranks, self.packed
        encoder = PrefixEncoder(self.bpe)
        for raw, piece in sorted((p.encode("utf-8", "surrogatepass"), p) for p in pieces):
            whole = ranks.get(raw)
            if whole is not None:
                cache[piece] = packed[whole]
                continue
            old, most, shared = encoder.piece, min(len(raw), len(encoder.piece)), 0
            while shared < most and old[shared] == raw[shared]:
                shared += 1
            encoder.truncate(shared)
            encoder.append(raw[shared:])
            cache[piece] = b"".join([packed[i] for i in encoder.ids()])

    def lookup(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        return self.cache.lookup(pieces, self.learn)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        plain = [self.cut is not None and not not_plain(t) for t in texts]
        cut = iter(encode_plain([t for t, p in zip(texts, plain, strict=True) if p], self.cut, self.lookup, False))
        return [next(cut) if p else b"".join(self._encode_found(t)) for t, p in zip(texts, plain, strict=True)]

    def _encode_found(self, text: str) -> list[bytes]:
        pieces = self.find(text)
        distinct = list(set(pieces))
        return list(map(dict(zip(distinct, self.lookup(distinct), strict=True)).__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bpe.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_codecs: dict[tuple[int, str], PieceCodec] = kept()


def _codec(ranks: dict[bytes, int], key: int, pattern: str) -> PieceCodec:
    """One codec a worker process and vocabulary, so that its cache serves all its tasks."""
    if (key, pattern) not in _codecs:
        _codecs.clear()
        _codecs[(key, pattern)] = PieceCodec(ranks, pattern)
    return _codecs[(key, pattern)]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add column ``ids`` (little-endian unsigned 32-bit token ids), and the decoded bytes if named.

    The driver reads the vocabulary (its size is fixed by the file, about 1 MB) and broadcasts it.
    Null text counts as empty: no ids. Columns named like an output are replaced; all others,
    repeated rows included, pass through. An empty table gives an empty table.
    """
    import zlib

    spark = docs.sparkSession
    ship(spark)
    ranks = read_ranks(ranks_path)
    key = zlib.crc32(repr(sorted(ranks.items())[:: max(1, len(ranks) // 997)]).encode())
    shared = spark.sparkContext.broadcast(ranks)
    keep = [c for c in docs.columns if c not in {ids, decoded}]
    added = [ids, decoded] if decoded else [ids]
    schema = StructType(list(docs.select(*[docs[f"`{c}`"] for c in keep]).schema.fields))
    for c in added:
        schema = schema.add(c, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, key, pattern)
        for part in text_slices(batches, text, 2 << 20, keeps=_codecs):
            out = codec.encode([t or "" for t in part.column(text).to_pylist()])
            columns = [*part.columns, pa.array(out, pa.binary())]
            if decoded:
                columns.append(pa.array([codec.decode(x) for x in out], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, *added])

    return docs.select(*[docs[f"`{c}`"] for c in keep]).mapInArrow(run, schema)
