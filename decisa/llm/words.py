"""Words and their hashes, computed with numpy over whole batches of UTF-8 texts.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Its hash is a polynomial over its bytes, taken from
prefix sums, then mixed to 64 bits. Texts longer than a block are cut at white space, so memory follows the block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np

BLOCK = 1 << 19
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: What may follow a word as a split of its own.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Kinds of bytes: marks, ASCII's letters, and the first bytes of characters some of which are white space.
MARKED, LETTER, WIDE = 1, 2, 4
_kinds = np.zeros(256, np.uint8)
_kinds[list(MARKS.encode())] = MARKED
_kinds[[*range(65, 91), *range(97, 123)]] = LETTER
_kinds[[0xC2, 0xE1, 0xE2, 0xE3]] = WIDE
_codes = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_lowered = _codes.copy()
_lowered[65:91] = _codes[97:123]
_powers: dict = {}


#: What operators keep in a Python worker between tasks. Spark uses a worker again for other operators' tasks.
CACHES: list[dict] = [_powers]


def release_caches(keep: dict | None = None) -> None:
    """Empty the caches of other operators, and give unused memory of Arrow and of the C library back to the system."""
    import ctypes

    import pyarrow as pa

    for cache in CACHES:
        if cache is not keep:
            cache.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run, keep: dict | None = None):
    """run, a task's function over batches, that starts and leaves its Python worker without other memory than `keep`:
    idle workers stay beside an executor's later tasks."""

    def tidied(batches):
        release_caches(keep)
        try:
            yield from run(batches)
        finally:
            release_caches(keep)

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept for the next call."""
    if len(_powers.get("up", ())) < n:
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(max(n, BLOCK + 1024), base, U64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def segments(text: bytes, block: int = BLOCK) -> Iterator[bytes]:
    """The text in pieces of about a block, cut at white space only."""
    at = 0
    while len(text) - at > block:
        cut = at + block
        found = -1
        while found < 0 and cut < len(text):
            window = np.frombuffer(text, np.uint8, min(4096, len(text) - cut), cut)
            hit = np.flatnonzero(SPACE[window])
            found = cut + int(hit[0]) if len(hit) else -1
            cut += len(window)
        if found < 0:
            break
        yield text[at:found]
        at = found
    yield text[at:]


class Block:
    """Byte-level arrays of some joined pieces of text."""

    def __init__(self, pieces: list[bytes], lower: bool):
        joined = b"\n".join(pieces) + b"\n"
        self.bytes = np.frombuffer(joined, np.uint8)
        space = SPACE[self.bytes]
        edge = np.empty(len(space), bool)
        edge[0] = not space[0]
        np.not_equal(space[1:], space[:-1], out=edge[1:])
        at = np.flatnonzero(edge)
        self.space, self.starts, self.ends = space, at[0::2], at[1::2]
        up, self.down = powers(len(joined) + 1)
        terms = (_lowered if lower else _codes)[self.bytes]
        terms *= up[:-1]
        self.sums = np.zeros(len(joined) + 1, U64)
        np.cumsum(terms, out=self.sums[1:])
        sizes = np.fromiter((len(p) + 1 for p in pieces), np.int64, len(pieces))
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        #: words in each piece
        self.counts = np.diff(np.searchsorted(self.starts, self.offsets))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each byte range."""
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U64))

    def words(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    @cached_property
    def kinds(self) -> np.ndarray:
        return np.frombuffer(self.bytes.tobytes().translate(_kinds.tobytes()), np.uint8)

    def of(self, kind: int) -> np.ndarray:
        """Which bytes are of a kind."""
        return self.kinds == kind

    @cached_property
    def letters(self) -> np.ndarray:
        """Which bytes belong to ASCII's or Latin-1's letters."""
        x, letter = self.bytes, self.of(LETTER)
        at = np.flatnonzero(x[:-1] == 0xC3)
        tail = x[at + 1]
        at = at[((tail & 0xC0) == 0x80) & (tail != 0x97) & (tail != 0xB7)]  # not the signs of times and division
        letter[at] = letter[at + 1] = True
        return letter

    def characters(self) -> tuple[np.ndarray, np.ndarray]:
        """The byte at which each UTF-8 character starts, and the number of the character at each byte."""
        first = (self.bytes & 0xC0) != 0x80
        return np.flatnonzero(first), np.cumsum(first) - 1


def blocks(texts: Iterable[bytes | None], lower: bool, block: int = BLOCK) -> Iterator[tuple[Block, list[int]]]:
    """Blocks over all texts in order, each with the index of the text that a piece comes from."""
    pieces, owner, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in segments(text or b"", block):
            if pieces and size + len(piece) > block:
                yield Block(pieces, lower), owner
                pieces, owner, size = [], [], 0
            pieces.append(piece)
            owner.append(i)
            size += len(piece) + 1
    if pieces:
        yield Block(pieces, lower), owner


def groups(texts: list[bytes | None], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a block in total; a longer text stands alone."""
    start = total = 0
    for i, text in enumerate(texts):
        n = len(text or b"")
        if i > start and total + n > size:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes of the texts in order, and the number of words of each text."""
    parts, counts = [], np.zeros(len(texts), np.int64)
    for b, owner in blocks(texts, lower):
        parts.append(b.words())
        np.add.at(counts, owner, b.counts)
    return np.concatenate(parts) if parts else np.zeros(0, U64), counts


def shingle_sets(texts: list[bytes | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles; a shorter text is one shingle, none without words."""
    out: list[np.ndarray] = []
    for a, b in groups(texts):
        h, counts = word_hashes(texts[a:b])
        if len(h) >= width:
            n = len(h) - width + 1
            rolled = np.full(n, width, U64)
            for k in range(width):
                rolled = rolled * U64(_BASE) + h[k : k + n]
            rolled = mix(rolled)
        at = 0
        for c in counts:
            if c >= width:
                out.append(np.unique(rolled[at : at + c - width + 1]))
            elif c:
                x = np.array([c], U64)
                for k in range(c):
                    x = x * U64(_BASE) + h[at + k : at + k + 1]
                out.append(mix(x))
            else:
                out.append(np.zeros(0, U64))
            at += c
    return out


def fingerprint(s: np.ndarray) -> bytes:
    """128 bits that stand for a whole set of hashes."""
    with np.errstate(over="ignore"):
        a, b = mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64), mix(s + U64(0x14057B7EF767814F)).sum(dtype=U64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")
