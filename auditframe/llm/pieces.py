"""Pieces of many texts at once: cut by character class in numpy, encoded once per distinct piece.

Works on *plain* text: printable Latin up to U+024F without U+0130 (and without a few format
characters), where letters, digits, white space and the rest are told by a table. Callers send
other text through their exact slow path.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Finds a character that makes a text not plain.
not_plain = re.compile("[^\t\n\\x20-\\x7e\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]").search

SPACE, LETTER, DIGIT, OTHER, BORDER = range(5)
_BORDER = "\0"


def _classes() -> np.ndarray:
    table = np.full(0x250, OTHER, np.uint8)
    for c in range(0x250):
        ch = chr(c)
        if ch.isalpha():
            table[c] = LETTER
        elif ch.isnumeric():
            table[c] = DIGIT
        elif ch.isspace():
            table[c] = SPACE
    table[0] = BORDER
    return table


CLASSES = _classes()


def _contractions(cp: np.ndarray, kind: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of 's 't 're 've 'm 'll 'd where a match can begin at the apostrophe."""
    at = np.flatnonzero(free)
    nxt = np.concatenate([cp, np.zeros(2, cp.dtype)])
    a, b = nxt[at + 1], nxt[at + 2]
    one = np.isin(a, [ord(x) for x in "stmd"])
    two = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    hit = one | two
    return at[hit], np.where(one[hit], 2, 3)


def cut_words(cp: np.ndarray) -> np.ndarray:
    """Segment starts under ``'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+``; white space and borders are segments too."""
    kind = CLASSES[cp]
    start = np.ones(len(cp), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | (kind[1:] == BORDER)
    quote = cp == ord("'")
    if quote.any():
        at, size = _contractions(cp, kind, quote & start)
        start[at + 1] = False
        start[at[size == 3] + 2] = False
        after = at + size
        start[after[after < len(cp)]] = True
    return np.flatnonzero(start)


def cut_gpt(cp: np.ndarray) -> np.ndarray:
    """Segment starts under the pattern of byte-level vocabularies with an optional blank before a run."""
    kind = CLASSES[cp]
    n = len(cp)
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == BORDER)
    first = start.copy()
    space = kind == SPACE
    last = np.zeros(n, bool)  # the last white space before something that is not white space
    last[:-1] = space[:-1] & ~space[1:] & (kind[1:] != BORDER)
    start[last] = True
    at = np.flatnonzero(last & (cp == 32))
    start[at + 1] = False  # the blank belongs to the run after it
    quote = cp == ord("'")
    if quote.any():
        at, size = _contractions(cp, kind, quote & first & start)
        start[at + 1] = False
        start[at[size == 3] + 2] = False
        after = at + size
        start[after[after < n]] = True
        # a blank cannot stand right after a contraction's letters and be cut by it: it starts a segment anyway
    return np.flatnonzero(start)


def encode_plain(texts: list[str], cut: Callable[[np.ndarray], np.ndarray], lookup: Callable[[list[str]], list[bytes]], drop_space: bool) -> list[bytes]:
    """Ids (little-endian unsigned 32-bit) of each plain text.

    ``lookup`` gives the ids of distinct pieces; pieces of white space are dropped if asked.
    """
    if not texts:
        return []
    joined = _BORDER.join(texts)
    raw = joined.encode("utf-8")
    if not raw:
        return [b""] * len(texts)
    cp = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    starts = cut(cp)
    kinds = CLASSES[cp[starts]]
    keep = kinds != BORDER
    if drop_space:
        keep &= kinds != SPACE
    at = starts.astype(np.int32) if len(raw) == len(cp) else (np.cumsum(1 + (cp >= 0x80), dtype=np.int32) - (1 + (cp >= 0x80)).astype(np.int32))[starts]
    width = np.diff(at, append=np.int32(len(raw)))
    # Only kept pieces are looked at from here on; the others' bytes are left out.
    body = np.frombuffer(raw, np.uint8)[np.repeat(keep, width)]
    offsets = np.zeros(int(keep.sum()) + 1, np.int32)
    np.cumsum(width[keep], out=offsets[1:])
    pieces = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(body)).dictionary_encode()
    which = pieces.indices.to_numpy(zero_copy_only=False)
    codes = lookup(pieces.dictionary.to_pylist())
    sizes = np.fromiter(map(len, codes), np.int32, len(codes)) // 4
    flat = np.frombuffer(b"".join(codes), "<u4")
    first = np.cumsum(sizes, dtype=np.int32) - sizes
    n = sizes[which]
    ends = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=ends[1:])
    total = int(ends[-1])
    ids = flat[np.repeat(first[which] - ends[:-1].astype(np.int32), n) + np.arange(total, dtype=np.int32)].tobytes() if total else b""
    cuts = [0, *(4 * ends[np.cumsum(keep)[kinds == BORDER]]).tolist(), 4 * total]
    return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Ages:
    """A bounded cache of pieces' ids in two ages: when the younger is full it becomes the older, whose pieces
    come back as they are met again. So frequent pieces outlast many that are met once."""

    def __init__(self, entries: int) -> None:
        self.most = entries // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def lookup(self, pieces: list[str], learn: Callable[[list[str], dict[str, bytes]], None]) -> list[bytes]:
        """Ids of distinct pieces; ``learn(unseen, into)`` encodes those that are in neither age."""
        found = list(map(self.young.get, pieces))
        if None in found:
            gaps = [k for k, ids in enumerate(found) if ids is None]
            if len(self.young) + len(gaps) > self.most:
                self.young, self.old = {}, self.young
            young, old, unseen = self.young, self.old, []
            for k in gaps:
                piece = pieces[k]
                ids = old.get(piece)
                if ids is None:
                    unseen.append(piece)
                else:
                    young[piece] = found[k] = ids
            learn(unseen, young)
            for k in gaps:
                if found[k] is None:
                    found[k] = young[pieces[k]]
        return found
