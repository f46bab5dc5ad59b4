"""Token-ID output with Re-Pair grammar compression.

Token ids are written in shards of about SHARD_TOKENS ids. In a shard, frequent pairs of neighbouring ids are replaced
by nonterminals, again and again: each round counts all pairs, takes the most frequent ones that can be replaced
side by side, and gives each a rule, until no pair is left LEAST times or a round would win less than a GAIN-th. A pair of equal ids is counted and replaced
from left to right without overlaps. A rule never crosses a document's end, so any document can be decoded alone from
its range of symbols; each rule's expansion length is stored, so its place in the output is known without expanding.

A shard is one row: part, shard (order of the file), docs, tokens, doc_ids (int64; missing ones are flagged in
doc_null), doc_symbols and doc_tokens (uint32 for each document), base, rules (pairs of uint32; rule k is symbol
base + k), lengths (uint32 for each rule), all little-endian, and symbols, packed in `width` bits each.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from decisa.llm.words import CACHES, LETTER, MARKED, MARKS, U64, WIDE, Block, blocks, groups, tidy
from decisa.session import fresh_path, own_batches

SHARD_TOKENS = 1 << 20
PAIRS_A_ROUND = 8192
#: A rule takes 12 bytes, its two symbols and its length, and each use of it saves a symbol of about two. Pairs of fewer
#: places would save another twelfth of a shard, for a fifth more time.
LEAST = 32
#: A round is a pass over the shard: one that would shorten it by less than a GAIN-th is the end.
GAIN = 1000
#: Distinct pieces that a worker remembers, about 40 bytes each, and how many of them are new since the last merge.
CACHE, RECENT = 1_000_000, 60_000
#: Where a piece stands: at a text's start, after a space, after a line end, or marks after a word. A hash plus its kind
#: is a piece's key.
FIRST, SPACED, LINE, TAIL = 0, 1, 2, 3
HASH_BITS = 18
_MARK = np.zeros(256, bool)
_MARK[list(MARKS.encode())] = True
#: Words of letters by which merges alone are tried against the whole tokenizer: some of ASCII, and Latin-1's letters.
WORDS = "a The qzx anthematically zzzzzzzzzzzz don \u00e9t\u00e9 \u00d6l " + "".join(map(chr, (x for x in range(0xC0, 0x100) if x not in (0xD7, 0xF7))))
#: The character that stands for each byte in a byte-level vocabulary.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
CHARACTERS = np.zeros(256, "<u4")
CHARACTERS[_SHOWN] = _SHOWN
CHARACTERS[CHARACTERS == 0] = 0x100 + np.arange(256 - len(_SHOWN))

SHARD = "part int, shard int, docs int, tokens long, base int, width int, doc_ids binary, doc_null binary, doc_symbols binary, doc_tokens binary, rules binary, lengths binary, symbols binary"


class Encoder:
    """Token ids of whole texts by a tokenizers file of byte-level BPE.

    Such a tokenizer splits a text before it merges: where no two white-space characters meet, a single space begins
    a split and a line end is one by itself; punctuation after a word is a split too. So texts are cut there with numpy,
    each distinct piece is encoded once by the library and found again by its 64-bit hash, and a text is the sum of its
    pieces. A text in which white space meets, or is of another kind, goes to the tokenizer whole. Special tokens'
    strings are ordinary text.
    """

    #: whether words of letters go to the tokenizer's merges alone
    by_words = False

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers, processors

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if isinstance(self.tokenizer.post_processor, processors.ByteLevel):  # it only trims offsets, which aren't used
            self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        self.line = self.whole("\n")
        joins = [("\n", "b c"), ("a", "\n"), ("a", " b"), ("a", "\nb c"), ("a.", " b"), ("a.", "\nb c")]
        self.splits = len(self.line) == 1 and all(self._sum(x, y) for x, y in joins)
        self.marks = all(self._sum(x, y) for x in ("a", " a") for y in [*MARKS, "...", "!!?", "***", '".', "),", "--"])
        # a word of letters is one match of the splitting pattern: in the vocabulary's characters it needs only merges
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        #: bytes of each id
        self.id_bytes = np.array([len(self.plain.id_to_token(i) or "") for i in range(self.plain.get_vocab_size())])
        self.by_words = self.splits and self.tokenizer.normalizer is None and all(self._same(kind, lead) for kind, lead in ((FIRST, ""), (SPACED, " "), (LINE, "\n")))
        if self.by_words:
            self.marks = self.marks and all(self._sum(x, y) for x in ("\u00e9", " a\u00df") for y in [*MARKS, "...", "),"])
        # rows of known pieces by hash: in a large table, and in a small one of the latest
        self.old, self.new = _Pieces(), _Pieces()

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _sum(self, head: str, tail: str) -> bool:
        """Whether a text's ids are those of its two parts."""
        return np.array_equal(self.whole(head + tail), np.concatenate([self.whole(head), self.whole(tail)]))

    def _same(self, kind: int, lead: str) -> bool:
        """Whether words have the whole tokenizer's ids."""
        b = Block([WORDS.encode()], lower=False)
        got = self._word_ids(b, b.starts, b.ends, np.full(len(b.starts), kind))
        return got is not None and np.array_equal(got[0], np.concatenate([self.whole(lead + w) for w in WORDS.split()]))

    def _make_room(self) -> None:
        if len(self.old.keys) > CACHE:  # what came up again stays, the rare rest goes
            self.old = self.old.part(self.old.used)
            if len(self.old.keys) > CACHE // 2:
                self.old = _Pieces()

    def _keep(self, pieces: _Pieces) -> None:
        if len(self.new.keys) + len(pieces.keys) > RECENT:
            self.old, self.new = self.old.with_(self.new), _Pieces()
        self.new = self.new.with_(pieces)

    def _word_ids(self, b: Block, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of words of letters, one after another, and each one's number of ids; None if they aren't as long as
        the words. A line end before a word is a word of its own."""
        sizes, lead = ends - starts, np.array([0, 1, 2])[kinds]
        wide = sizes + lead + 1
        at = np.cumsum(wide) - wide
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        shown = np.full(int(wide.sum()), 0x20, "<u4")
        shown[np.repeat(at + lead, sizes) + inner] = CHARACTERS[b.bytes[np.repeat(starts, sizes) + inner]]
        shown[at[kinds == SPACED]] = CHARACTERS[0x20]
        shown[at[kinds == LINE]] = CHARACTERS[0x0A]
        edges = np.append(at[::256], len(shown)).tolist()
        texts = [shown[x:y].tobytes().decode("utf-32-le") for x, y in zip(edges, edges[1:], strict=False)]
        ids = np.concatenate([np.asarray(e.ids, np.uint32) for k in range(0, len(texts), 32) for e in self.plain.encode_batch_fast(texts[k : k + 32], add_special_tokens=False)])
        reached, until = np.cumsum(self.id_bytes[ids]), np.cumsum(sizes + (lead > 0))
        last = np.searchsorted(reached, until)
        if last[-1] != len(ids) - 1 or (reached[last] != until).any():
            return None
        return ids, np.diff(last, prepend=-1)

    def _learn(self, b: Block, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray, keys: np.ndarray) -> None:
        """Encode pieces that aren't known."""
        if self.by_words:
            others = np.flatnonzero(~b.letters)
            plain = np.searchsorted(others, starts) == np.searchsorted(others, ends)
            if plain.any() and (got := self._word_ids(b, starts[plain], ends[plain], kinds[plain])):
                ids, counts = got
                self._keep(_Pieces()._take(keys[plain], np.cumsum(counts) - counts, counts, ids, np.zeros(len(counts), bool), np.argsort(keys[plain])))
                starts, ends, kinds, keys = starts[~plain], ends[~plain], kinds[~plain], keys[~plain]
        self._learn_others(b, starts, ends, kinds, keys)

    def _learn_others(self, b: Block, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray, keys: np.ndarray) -> None:
        """Encode pieces of any bytes, many at once; line ends keep them apart."""
        data, line = b.bytes.tobytes(), self.line.astype("<u4").tobytes()
        for kind in (FIRST, SPACED, LINE, TAIL):
            at = np.flatnonzero(kinds == kind)
            prefix = " " if kind == SPACED else ""
            pieces = [prefix + data[x:y].decode(errors="replace") for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            found: list[bytes] = []
            for k in range(0, len(pieces), 8192):
                texts = ["\n".join(pieces[j : min(j + 256, k + 8192)]) for j in range(k, min(k + 8192, len(pieces)), 256)]
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                    found += _cut(np.asarray(e.ids, "<u4"), int(self.line[0]))
            if len(at):
                self._keep(_Pieces(keys[at], [line + x for x in found] if kind == LINE else found))

    def _ids(self, keys: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known pieces one after another, and each one's number of ids. a: their rows in the large table."""
        b = self.new.find(keys)
        self.old.used[a[a >= 0]] = True
        size = np.where(a >= 0, self.old.size_of(a), self.new.size_of(b))
        start = np.where(a >= 0, self.old.start_of(a), self.new.start_of(b) + len(self.old.flat))
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        at, split = np.repeat(start, size) + inner, len(self.old.flat)
        out = np.empty(len(at), np.uint32)
        late = at >= split
        out[~late], out[late] = self.old.flat[at[~late]], self.new.flat[at[late] - split]
        return out, size

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        odd = np.full(len(texts), not self.splits)
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for b, owner in blocks(texts if self.splits else [], lower=False):
            self._make_room()
            own = np.asarray(owner)
            leads = np.concatenate(([True], own[1:] != own[:-1])) & np.array([not parts[i] for i in owner])
            odd[own[_odd_pieces(b, leads)]] = True
            counts = np.where(odd[own], 0, b.counts)
            plain = np.repeat(~odd[own], b.counts)
            starts, ends, piece = b.starts[plain], b.ends[plain], np.repeat(np.arange(len(own)), counts)
            before = b.bytes[np.maximum(starts - 1, 0)]
            kinds = np.where(leads[piece] & (starts == b.offsets[piece]), FIRST, np.where(before == 0x20, SPACED, LINE))
            if self.marks:
                letter = b.letters if self.by_words else b.of(LETTER)
                starts, ends, kinds, of = _split_marks(b, letter, starts, ends, kinds)
                counts = np.bincount(piece[of], minlength=len(own))
            keys = b.hashes(starts, ends) + kinds.astype(U64)
            some, first, back = _distinct(keys)
            old, rows = self.old, self.old.find(some)
            new = np.flatnonzero((rows < 0) & (self.new.find(some) < 0))
            if len(new):
                self._learn(b, starts[first[new]], ends[first[new]], kinds[first[new]], some[new])
            flat, size = self._ids(some, rows if self.old is old else self.old.find(some))
            start, each = (np.cumsum(size) - size)[back], size[back]
            ids = flat[np.repeat(start, each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)]
            stops = np.concatenate(([0], np.cumsum(each)))[np.concatenate(([0], np.cumsum(counts)))]
            for k, i in enumerate(owner):
                parts[i].append(ids[stops[k] : stops[k + 1]])
        for i in np.flatnonzero(odd).tolist():
            parts[i] = [self.whole(texts[i].decode(errors="replace"))]
        return [p[0] if len(p) == 1 else np.concatenate([*p, np.zeros(0, np.uint32)]) for p in parts]


class _Pieces:
    """Ids of pieces by hash: sorted keys, and each one's range of one flat array."""

    def __init__(self, keys: np.ndarray | None = None, ids: list[bytes] | None = None):
        order = np.argsort(keys) if ids else np.zeros(0, int)
        self.keys = keys[order] if ids else np.zeros(0, U64)
        ids = [ids[i] for i in order.tolist()] if ids else []
        self.size = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(ids), "<u4").astype(np.uint32)
        self.used = np.zeros(len(self.keys), bool)

    def _take(self, keys, start, size, flat, used, order) -> _Pieces:
        self.keys, self.start, self.size, self.used, self.flat = keys[order], start[order], size[order], used[order], flat
        return self

    def with_(self, other: _Pieces) -> _Pieces:
        keys = np.concatenate([self.keys, other.keys])
        start, size = np.concatenate([self.start, other.start + len(self.flat)]), np.concatenate([self.size, other.size])
        used = np.concatenate([self.used, np.ones(len(other.keys), bool)])
        return _Pieces()._take(keys, start, size, np.concatenate([self.flat, other.flat]), used, np.argsort(keys, kind="stable"))

    def part(self, keep: np.ndarray) -> _Pieces:
        at = np.flatnonzero(keep)
        size = self.size[at]
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flat = self.flat[np.repeat(self.start[at], size) + inner]
        return _Pieces()._take(self.keys[at], np.cumsum(size) - size, size, flat, np.zeros(len(at), bool), np.arange(len(at)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, -1)

    def size_of(self, rows: np.ndarray) -> np.ndarray:
        return self.size[rows] if len(self.size) else np.zeros(len(rows), np.int64)

    def start_of(self, rows: np.ndarray) -> np.ndarray:
        return self.start[rows] if len(self.size) else np.zeros(len(rows), np.int64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, a place of each, and each key's row among them; by hash, as most keys come up often."""
    coded = pa.array(keys).dictionary_encode()
    some, code = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    place, row, order = np.empty(len(some), np.intp), np.empty(len(some), np.intp), np.argsort(some)
    place[code] = np.arange(len(code))
    row[order] = np.arange(len(order))
    return some[order], place[order], row[code]


def _split_marks(b: Block, letter: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words with the marks after their last letter as pieces of their own, and the word of each piece. A tokenizer
    splits between a letter and a mark whatever stands around them."""
    last, marks = ends - 1, np.flatnonzero(b.of(MARKED))
    ran = np.ones(len(marks), bool)  # whether a run of marks begins
    ran[1:] = marks[1:] != marks[:-1] + 1
    marked = np.flatnonzero(_MARK[b.bytes[last]])
    last[marked] = marks[ran][(np.cumsum(ran) - 1)[np.searchsorted(marks, last[marked])]] - 1
    cut = (last >= starts) & (last < ends - 1) & letter[np.maximum(last, 0)]
    of = np.repeat(np.arange(len(starts)), 1 + cut)
    tail = np.zeros(len(of), bool)
    tail[1:] = of[1:] == of[:-1]
    head = np.append(tail[1:], False) if len(tail) else tail
    return np.where(tail, last[of] + 1, starts[of]), np.where(head, last[of] + 1, ends[of]), np.where(tail, TAIL, kinds[of]), of


def _odd_pieces(b: Block, leads: np.ndarray) -> np.ndarray:
    """Which pieces have white space that meets or is neither a space nor a line end, or begin (where a text begins) or
    end with it."""
    x, joints = b.bytes, b.offsets[1:] - 1
    gap = b.space
    odd = np.zeros(len(joints), bool)
    of = lambda at: np.searchsorted(b.offsets, at, "right") - 1
    meets = np.flatnonzero(gap[:-1] & gap[1:])
    joint = np.zeros(len(x), bool)
    joint[joints] = True
    odd[of(meets[~joint[meets]])] = True
    begins = b.offsets[:-1][leads & (np.diff(b.offsets) > 1)]
    odd[of(begins[gap[begins]])] = True
    other = (gap & (x != 0x20) & (x != 0x0A)) | ((x >= 0x1C) & (x <= 0x1F))
    odd[of(np.flatnonzero(other))] = True
    wide = np.flatnonzero(b.of(WIDE))
    y, z = x[np.minimum(wide + 1, len(x) - 1)], x[np.minimum(wide + 2, len(x) - 1)]
    lead = x[wide]
    blank = (lead == 0xC2) & ((y == 0x85) | (y == 0xA0))
    blank |= (lead == 0xE1) & (y == 0x9A) & (z == 0x80)
    blank |= (lead == 0xE2) & (((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((y == 0x81) & (z == 0x9F)))
    blank |= (lead == 0xE3) & (y == 0x80) & (z == 0x80)
    odd[of(wide[blank])] = True
    return odd


def _cut(ids: np.ndarray, at: int) -> list[bytes]:
    """The ids between the ones that equal `at`."""
    stops, data = (4 * np.flatnonzero(ids == at)).tolist(), ids.tobytes()
    return [data[a:b] for a, b in zip([0, *[s + 4 for s in stops]], [*stops, len(data)], strict=True)]


def _lanes(width: int):
    """(lane, first byte, shift, bytes) of each of eight symbols of `width` bits, which fill `width` bytes."""
    for lane in range(8):
        first, shift = divmod(lane * width, 8)
        yield lane, first, U64(shift), -(-(shift + width) // 8)


def pack(symbols: np.ndarray, width: int) -> bytes:
    """Symbols of `width` bits each, one after another, lowest bit first."""
    eights = np.zeros((-(-len(symbols) // 8), 8), U64)
    eights.reshape(-1)[: len(symbols)] = symbols
    out = np.zeros((len(eights), width), np.uint8)
    for lane, first, shift, n in _lanes(width):
        value = eights[:, lane] << shift
        for k in range(n):
            out[:, first + k] |= (value >> U64(8 * k)).astype(np.uint8)
    return out.tobytes()[: -(-len(symbols) * width // 8)]


def unpack(data: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Symbols start to stop of packed ones; only the bytes around them are read."""
    low, high = start // 8, -(-stop // 8)
    part = np.frombuffer(data, np.uint8)[low * width : high * width]
    rows = np.zeros((high - low, width), np.uint8)
    rows.reshape(-1)[: len(part)] = part
    out = np.empty((high - low, 8), np.uint32)
    for lane, first, shift, n in _lanes(width):
        value = np.zeros(high - low, U64)
        for k in range(n):
            value |= rows[:, first + k].astype(U64) << U64(8 * k)
        out[:, lane] = (value >> shift) & U64((1 << width) - 1)
    return out.reshape(-1)[start - 8 * low : stop - 8 * low]


def _frequent(symbols: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent pairs that may be replaced together, where no symbol both ends one and begins another; then
    the places that hold one, and which. Only places marked in `may` are looked at, and those that can't hold a frequent
    pair lose their mark. Pairs are counted by hash first, then exactly in the full buckets; none is chosen only when no
    pair is there LEAST times. In a run of one symbol, every other place counts, from its left."""
    live = np.flatnonzero(may)
    spot = _bucket(symbols[live], symbols[live + 1]).astype(np.intp)
    hot = np.bincount(spot, minlength=1 << HASH_BITS)
    full = (hot >= LEAST)[spot]
    may[live] = full
    full = np.flatnonzero(full)  # many times faster to take by than a mask
    live, spot = live[full], spot[full]
    floors = [LEAST]
    if np.count_nonzero(hot >= LEAST) > 2 * PAIRS_A_ROUND:
        floors = sorted({LEAST, max(LEAST, int(np.partition(hot, -2 * PAIRS_A_ROUND)[-2 * PAIRS_A_ROUND]))}, reverse=True)
    for floor in floors:
        at = live if floor == LEAST else live[(hot >= floor)[spot]]
        x, y = symbols[at], symbols[at + 1]
        equal = np.flatnonzero(x == y)
        if len(equal):
            n = np.arange(len(equal))
            follows = np.zeros(len(equal), bool)
            follows[1:] = at[equal[1:]] == at[equal[:-1]] + 1
            odd = (n - np.maximum.accumulate(np.where(follows, 0, n))) % 2 == 1
            counted = np.ones(len(at), bool)
            counted[equal[odd]] = False
            counted = np.flatnonzero(counted)
            at, x, y = at[counted], x[counted], y[counted]
        coded = pa.array((x.astype(np.uint64) << np.uint64(32)) | y).dictionary_encode()
        pairs, code = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        counts = np.bincount(code, minlength=len(pairs))
        often = np.flatnonzero(counts >= LEAST)
        often = often[np.argsort(-counts[often], kind="stable")]
        heads, tails, chosen = set(), set(), []
        for k, pair in zip(often.tolist(), pairs[often].tolist(), strict=True):
            x, y = pair >> 32, pair & 0xFFFFFFFF
            if x not in tails and y not in heads:
                heads.add(x)
                tails.add(y)
                chosen.append(k)
                if len(chosen) == PAIRS_A_ROUND:
                    break
        if chosen:
            break
    which = np.full(len(pairs), -1)
    which[chosen] = np.arange(len(chosen))
    which = which[code]
    held = np.flatnonzero(which >= 0)
    return pairs[chosen], at[held], which[held]


def _bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77))) >> np.uint32(32 - HASH_BITS)


def compress(ids: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols of each document, rules, expansion lengths) of ids below base, whose documents end before
    `ends`. Rule k is symbol base + k. It ends when no pair is left LEAST times, or all that are left together would
    shorten the symbols by less than a GAIN-th."""
    symbols, rules = ids.astype(np.uint32), []
    # where a frequent pair may begin: a pair of old symbols never gets more places, so only marked places and the
    # surroundings of new symbols are counted again; none begins at a document's end
    may = np.ones(len(symbols), bool)
    may[ends - 1] = False
    while len(symbols) > 1:
        chosen, hit, which = _frequent(symbols, may)
        if len(hit) * GAIN < len(symbols) or not len(hit):
            break
        symbols[hit] = base + len(rules) + which
        may[hit] = True
        may[np.maximum(hit, 1) - 1] = True
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        keep = np.flatnonzero(keep)
        symbols, may = symbols[keep], may[keep]
        ends = ends - np.searchsorted(hit + 1, ends)
        may[ends - 1] = False
        rules += zip((chosen >> np.uint64(32)).tolist(), (chosen & np.uint64(0xFFFFFFFF)).tolist(), strict=True)
    of_doc = np.diff(ends, prepend=0)
    sizes = [1] * base
    for x, y in rules:
        sizes.append(sizes[x] + sizes[y])
    return symbols, of_doc.astype("<u4"), np.array(rules, "<u4").reshape(-1, 2), np.array(sizes[base:], "<u4")


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids of a range of symbols."""
    flat: list[bytes] = []
    for x, y in rules.tolist():
        flat.append((flat[x - base] if x >= base else x.to_bytes(4, "little")) + (flat[y - base] if y >= base else y.to_bytes(4, "little")))
    table = np.concatenate([np.arange(base, dtype=np.uint32), np.frombuffer(b"".join(flat), "<u4")])
    sizes = np.concatenate([np.ones(base, np.int64), lengths])
    starts, size = np.cumsum(sizes) - sizes, sizes[symbols]
    ends = np.cumsum(size)
    return table[np.repeat(starts[symbols] - ends + size, size) + np.arange(int(size.sum()))]


def _shard(part: int, shard: int, ids: list, texts: list[np.ndarray]) -> dict:
    sizes = np.array([len(t) + 1 for t in texts], "<u4")
    end = np.zeros(1, np.uint32)
    tokens = np.concatenate([x for t in texts for x in (t, end)])
    base = int(tokens.max()) + 1
    symbols, of_doc, rules, lengths = compress(tokens, np.cumsum(sizes.astype(np.int64)), base)
    width = max(1, (base + len(rules) - 1).bit_length())
    return {
        "part": part, "shard": shard, "docs": len(ids), "tokens": len(tokens), "base": base, "width": width,
        "doc_ids": np.array([x or 0 for x in ids], "<i8").tobytes(), "doc_null": np.array([x is None for x in ids], bool).tobytes(),
        "doc_symbols": of_doc.tobytes(), "doc_tokens": sizes.tobytes(), "rules": rules.tobytes(), "lengths": lengths.tobytes(), "symbols": pack(symbols, width),
    }


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every whole text, append id 0 to each document and write the shards in ascending doc_id order.

    docs: (doc_id, text). Null texts are empty; null doc_ids come first; rows of one doc_id are ordered by
    the hash of their text. An
    empty table writes no shard. The ids of one document are never split, so a shard may be as long as one text.
    """
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("docs", pa.int32()), ("tokens", pa.int64()), ("base", pa.int32()), ("width", pa.int32()), *[(c, pa.binary()) for c in ("doc_ids", "doc_null", "doc_symbols", "doc_tokens", "rules", "lengths", "symbols")]])

    def run(batches):
        from pyspark import TaskContext

        encode, part, shard, ids, texts, size = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0, [], [], 0
        for b in batches:
            some, whole = b.column(0).to_pylist(), b.column(1).to_pylist()
            for a, z in groups(whole, 4 << 20):
                for i, t in zip(some[a:z], encode(whole[a:z]), strict=True):
                    ids.append(i)
                    texts.append(t)
                    size += len(t) + 1
                    if size >= shard_tokens:
                        yield pa.RecordBatch.from_pylist([_shard(part, shard, ids, texts)], schema)
                        shard, ids, texts, size = shard + 1, [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_shard(part, shard, ids, texts)], schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    ranged = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    with own_batches(docs.sparkSession):
        ranged.mapInArrow(tidy(run, _encoders), SHARD).write.parquet(path)


_encoders: dict[str, Encoder] = {}
CACHES.append(_encoders)


def _encoder(path: str) -> Encoder:
    """One encoder, with what it has learnt, for all tasks of a Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _decode(shard: dict, start: int, stop: int) -> np.ndarray:
    """The ids of a shard's symbols start to stop."""
    symbols = unpack(shard["symbols"], shard["width"], start, stop)
    return expand(symbols, np.frombuffer(shard["rules"], "<u4").reshape(-1, 2), np.frombuffer(shard["lengths"], "<u4"), shard["base"])


def decode_document(shard: dict, k: int) -> np.ndarray:
    """The ids of document k of a shard, from its own range of symbols alone."""
    of_doc = np.frombuffer(shard["doc_symbols"], "<u4").astype(np.int64)
    start = int(of_doc[:k].sum())
    return _decode(shard, start, start + int(of_doc[k]))


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of written shards; start counts all ids before it.

    Each shard's own start comes from the sums of the parts before it, of which there is one row for each file.
    """
    spark = files.sparkSession
    by_part = files.groupBy("part").agg(F.sum("tokens").alias("tokens")).orderBy("part").collect()  # a row a task of the writer
    starts, at = [], 0
    for row in by_part:
        starts.append((row["part"], at))
        at += row["tokens"]
    before = spark.createDataFrame(starts, "part int, part_start long")
    sizes = files.select("part", "shard", "tokens")
    run = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", "shard", F.coalesce(F.sum("tokens").over(run), F.lit(0)).alias("shard_start")).join(F.broadcast(before), "part")
    sizes = sizes.select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("start"))
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run_decode(batches):
        for b in batches:
            for k in range(len(b)):
                s = b.slice(k, 1).to_pylist()[0]
                ids = _decode(s, 0, int(np.frombuffer(s["doc_symbols"], "<u4").sum(dtype=np.int64)))
                n = np.frombuffer(s["doc_tokens"], "<u4").astype(np.int64)
                data, ends = memoryview(ids.astype("<u4")).cast("B"), np.cumsum(n)
                crc = [zlib.crc32(data[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                doc_ids = pa.array(np.frombuffer(s["doc_ids"], "<i8"), mask=np.frombuffer(s["doc_null"], bool))
                yield pa.RecordBatch.from_arrays([pa.array([s["part"]] * len(n), pa.int32()), pa.array([s["shard"]] * len(n), pa.int32()), doc_ids, pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())], schema=schema)

    docs = files.mapInArrow(tidy(run_decode), "part int, shard int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    out = docs.join(sizes, ["part", "shard"])
    return out.select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the shards into the shared folder and read them back."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, path)
    return read_tokens(docs.sparkSession.read.schema(SHARD).parquet(path))
