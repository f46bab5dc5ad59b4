"""Fill-in-middle examples, cut at lines that content-defined chunks locate.

A text is cut into chunks where a rolling hash of its last WINDOW bytes has CHUNK_BITS zero bits, so a passage that many
documents share falls into the same chunks wherever it stands. A worker keeps a summary of each chunk it has met, by its
bytes: where its lines end, how many characters are before each end, whether a sentinel is inside and whether one may go
on over its end. A document's number of lines, the chunk that holds a cut and the characters before it are sums of
summaries; only the bytes at the joints of chunks are looked at again, for sentinels that cross them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisa.llm.words import CACHES, groups, tidy

WINDOW, CHUNK_BITS, LONGEST = 16, 10, 1 << 14
#: Bytes of chunks that a worker remembers at most; a full memory is emptied, which costs time only.
MEMORY = 32 << 20
#: Prefix, suffix and middle marks.
SENTINELS = ("<P>", "<S>", "<M>")
_GEAR = np.random.default_rng(20240731).integers(0, 1 << 32, 256, dtype=np.uint32)

_chunks: dict[bytes, tuple] = {}
CACHES.append(_chunks)


def chunk_ends(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Where the chunks of joined texts end; `starts` holds the texts' first bytes and the end of data. Chunks of a text
    depend on its own bytes only: no cut is within WINDOW bytes of its start. A run of bytes without a cut is cut every
    LONGEST bytes."""
    x = np.frombuffer(data, np.uint8)
    h = _GEAR[x]
    width = 1
    while width < WINDOW:  # hash of the last 2 * width bytes out of two of the last width
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    cuts = np.flatnonzero((h >> np.uint32(32 - CHUNK_BITS)) == 0) + 1
    of = np.searchsorted(starts, cuts - 1, "right") - 1
    cuts = cuts[cuts - starts[of] > WINDOW]
    ends = np.union1d(cuts, starts[1:])
    begins = np.concatenate(([0], ends[:-1]))
    pieces = np.maximum(1, -(-(ends - begins) // LONGEST))
    inner = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.minimum(np.repeat(begins, pieces) + (inner + 1) * LONGEST, np.repeat(ends, pieces))


def summary(chunk: bytes, sentinels: tuple[bytes, ...]) -> tuple:
    """(characters, offsets just after each line end, characters up to each, a sentinel is inside, one may begin near the
    end)."""
    x = np.frombuffer(chunk, np.uint8)
    ends = np.flatnonzero(x == 0x0A) + 1
    first = (x & 0xC0) != 0x80
    characters = int(np.count_nonzero(first))
    upto = np.cumsum(first)[ends - 1].tolist() if len(ends) else []
    opens = any(s[:1] in chunk[-(len(s) - 1) :] for s in sentinels if len(s) > 1)
    return characters, ends.tolist(), upto, any(s in chunk for s in sentinels), opens


def _summary_of(chunk: bytes, sentinels: tuple[bytes, ...], room: list[int]) -> tuple:
    found = _chunks.get(chunk)  # equal bytes, not only an equal hash
    if found is None:
        room[0] -= len(chunk) + 200
        if room[0] < 0:
            _chunks.clear()
            room[0] = MEMORY
        found = _chunks[chunk] = summary(chunk, sentinels)
    return found


class Lines:
    """A text's lines and characters out of its chunks' summaries."""

    def __init__(self, text: bytes, ends: list[int], sentinels: tuple[bytes, ...], room: list[int]):
        self.ends, self.size, self.parts = ends, len(text), []
        self.lines, self.chars, self.marked = [0], [0], False
        at, reach = 0, max(len(s) for s in sentinels) - 1
        for end in ends:
            part = _summary_of(text[at:end], sentinels, room)
            self.parts.append(part)
            self.lines.append(self.lines[-1] + len(part[1]))
            self.chars.append(self.chars[-1] + part[0])
            self.marked |= part[3] or (part[4] and any(s in text[max(0, end - reach) : end + reach] for s in sentinels))
            at = end
        self.n = self.lines[-1] + (self.size > 0 and text[-1] != 0x0A)

    def cut(self, lines: int) -> tuple[int, int]:
        """(bytes, characters) before the end of the first `lines` lines."""
        if lines == 0:
            return 0, 0
        if lines > self.lines[-1]:
            return self.size, self.chars[-1]
        k = bisect_left(self.lines, lines) - 1
        inner = lines - self.lines[k] - 1
        begin = self.ends[k - 1] if k else 0
        return begin + self.parts[k][1][inner], self.chars[k] + self.parts[k][2][inner]


def _check(sentinels: tuple[str, ...]) -> tuple[bytes, ...]:
    """The sentinels as bytes, if a text without them keeps being told apart from them wherever they are put into it."""
    marks = tuple(s.encode() for s in sentinels)
    heads = {m[:1] for m in marks}
    if len(set(marks)) != 3 or not all(marks) or any(h in m[1:] for h in heads for m in marks) or any(x != y and x.startswith(y) for x in marks for y in marks):
        raise ValueError("three different sentinels are needed, whose first characters occur in none of them again")
    return marks


def _example(text: bytes, ends: list[int], key: object, seed: int, fim_rate: int, spm_rate: int, marks: tuple[bytes, ...], room: list[int]) -> tuple:
    at = Lines(text, ends, marks, room)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or at.marked or h3 % 100 >= fim_rate:
        return at.n, "plain", None, None, text
    low, high = sorted((h1 % (at.n + 1), h2 % (at.n + 1)))
    (a, before), (b, upto) = at.cut(low), at.cut(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    spm = h4 % 100 < spm_rate
    output = b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))
    return at.n, "spm" if spm else "psm", before, upto - before, output


def fim_examples(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, fim_rate: int = 100, spm_rate: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output): each whole text as a fill-in-middle example.

    A line is what ends with a line feed, or the rest after the last one; n counts them. Two draws out of the key's hash
    cut the text at lines into prefix, middle and suffix, any of which may be empty. form: psm writes prefix, suffix,
    middle, spm suffix, prefix, middle, each after its sentinel; fim_rate of 100 texts are cut, spm_rate of 100 of these
    are spm. A text that is null (read as empty), empty or contains a sentinel stays as it is: plain, without numbers of
    characters.

    Rows of equal keys are cut alike; a null key draws as an empty one. Other columns are not returned, so their names
    don't matter. An empty table gives none. Texts of any length are handled one at a time, in memory of a small multiple
    of their size."""
    marks = _check(tuple(sentinels))
    key_type = docs.schema[key].dataType.simpleString()
    schema = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = [MEMORY]
        for b in batches:
            keys, texts, names = b.column(0), b.column(2).to_pylist(), b.column(1).to_pylist()
            for low, high in groups(texts, 1 << 20):
                some = texts[low:high]
                starts = np.concatenate(([0], np.cumsum([len(t) for t in some])))
                ends = chunk_ends(b"".join(some), starts) if starts[-1] else np.zeros(0, np.int64)
                stops = np.searchsorted(ends, starts, "right")
                rows = []
                for i, t in enumerate(some):
                    own = (ends[stops[i] : stops[i + 1]] - starts[i]).tolist() if t else []
                    rows.append(_example(t, own, names[low + i], seed, fim_rate, spm_rate, marks, room))
                columns = [pa.array(c, type=f.type) for c, f in zip(list(zip(*rows, strict=True))[:4], schema, strict=False)]
                output = pa.array([r[4] for r in rows], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([keys.slice(low, high - low), *columns, output], names=["key", *schema.names])

    rows = docs.select(F.col(key).alias("key"), F.col(key).cast("string").alias("name"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    out = rows.mapInArrow(tidy(run, _chunks), f"key {key_type}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("key", key)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an example was made from, out of its output and form alone. Null for a form that isn't known, and
    where the sentinels aren't there in the form's order."""
    p, s, m = _check(tuple(sentinels)) and sentinels
    between = lambda at, mark, until: F.substring(output, at + len(mark), until - at - len(mark))

    def whole(first: str, second: str, order: tuple[int, int]) -> Column:
        one = F.lit(1)
        two = F.locate(second, output)
        three = F.locate(m, output)
        parts = (between(one, first, two), between(two, second, three))
        rest = F.substring(output, three + len(m), F.length(output))
        ok = output.startswith(first) & (two > 0) & (three > two)
        return F.when(ok, F.concat(parts[order[0]], rest, parts[order[1]]))

    return F.when(form == "plain", output).when(form == "psm", whole(p, s, (0, 1))).when(form == "spm", whole(s, p, (1, 0)))
