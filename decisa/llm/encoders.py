"""Whole texts to ids of other tokenizer kinds, by the piece cache of repair.Encoder, and the bytes of each id."""

from __future__ import annotations

import os

import numpy as np

from decisa.llm.repair import LINE, Encoder, _Pieces
from decisa.llm.words import Block

APART, BAR = "\x01", "|"
SMALL = np.zeros(256, bool)
SMALL[97:123] = True


class WordEncoder(Encoder):
    """Ids by a tokenizers file that lowers letters, drops white space and splits at it, as BPE with word ends does: a
    text's ids are those of its words one after another. Special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.splits = all(self._sum(x, y) for x, y in (("a", " b"), ("a", "\nb c"), ("a.", " b"), ("a b", "\n"), ("A", " Bc")))
        self.marks = all(self._sum(x, y) for x in ("a", " a") for y in ("!", ",", ".", "...", "!!?", "***", '".', "),", "--", "'", "',"))
        self.old, self.new = _Pieces(), _Pieces()
        #: the id of a character that keeps words apart; a word that holds it is encoded alone
        self.apart = self.whole(APART)
        self.lowers = np.array_equal(self.whole("ABC xYZ"), self.whole("abc xyz"))
        # words of a to z are what they are in every normal form, and one match of the splitting pattern
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.bar = np.asarray(self.plain.encode(BAR, add_special_tokens=False).ids, np.uint32)
        same = all(self.plain.encode(w, add_special_tokens=False).ids == self.whole(w).tolist() for w in ("a", "the", "qzx", "anthematically", "s", "zzzzzzzzzzzz", "don t"))
        self.plainly = same and len(self.bar) == 1 and np.array_equal(self.bar, self.whole(BAR))

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        return super().__call__([t.lower() for t in texts] if self.lowers else texts)  # A-Z only: fewer words to learn

    def _learn(self, b: Block, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray, keys: np.ndarray) -> None:
        sizes = ends - starts
        plain = np.zeros(len(starts), bool)
        if self.plainly and len(starts):
            other = np.concatenate(([0], np.cumsum(~SMALL[b.bytes])))
            plain = other[ends] == other[starts]
        for some, tokenizer, apart, id_ in ((plain, self.plain, BAR, self.bar), (~plain, self.tokenizer, APART, self.apart)):
            if some.any():
                self._learn_some(b, starts[some], sizes[some], keys[some], tokenizer, apart, id_)

    def _learn_some(self, b: Block, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray, tokenizer, apart: str, id_: np.ndarray) -> None:
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        words = b.bytes[np.repeat(starts, sizes) + inner]
        if len(id_) != 1 or (words == ord(apart)).any():
            ends = starts + sizes
            self._keep(_Pieces(keys, [self.whole(b.bytes[x:y].tobytes().decode(errors="replace")).astype("<u4").tobytes() for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]))
            return
        at = np.cumsum(sizes + 3) - sizes - 3  # a space, the character and a space after each word
        joined = np.full(int((sizes + 3).sum()), 0x20, np.uint8)
        joined[np.repeat(at, sizes) + inner] = words
        joined[at + sizes + 1] = ord(apart)
        edges = np.append(at[::256], len(joined)).tolist()
        texts = [joined[x:y].tobytes().decode(errors="replace") for x, y in zip(edges, edges[1:], strict=False)]
        found = [np.asarray(e.ids, np.uint32) for k in range(0, len(texts), 32) for e in tokenizer.encode_batch_fast(texts[k : k + 32], add_special_tokens=False)]
        ids = np.concatenate(found)
        stops = np.flatnonzero(ids == id_[0])
        counts = np.diff(stops, prepend=-1) - 1
        order = np.argsort(keys)
        self._keep(_Pieces()._take(keys, np.cumsum(counts) - counts, counts, ids[ids != id_[0]], np.zeros(len(keys), bool), order))


class SpacedEncoder(Encoder):
    """Ids, by a tokenizers file of byte-level BPE, of a space and the text. The space is a text's own, so that its first
    word is encoded as one after a space: a letter is put before it, which is a split of its own, and taken off again."""

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        lead = self.whole("x")
        return [ids[len(lead) :] for ids in super().__call__([b"x " + t for t in texts])]

    def token_bytes(self) -> list[bytes]:
        """Each id's bytes; empty for ids that stand for none."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        known = {chr(x): x for x in plain}
        known |= {chr(0x100 + k): x for k, x in enumerate(x for x in range(256) if x not in set(plain))}
        names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        special = {str(t) if isinstance(t, str) else t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        return [b"" if n is None or n in special else bytes(known[c] for c in n) for n in names]


class PieceEncoder(Encoder):
    """Ids by a sentencepiece model that adds a space before a text and keeps all others, in which no piece goes on over
    a space or a line end: a text's ids are those of its words, each with the space or line end before it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        #: what an added space before a line end makes
        self.blank = self.whole("\n")[: len(self.whole("a")) - len(self.whole("a\n"))]
        inner = any("▁" in n.lstrip("▁") or "\n" in n for n in names)
        joins = [("a", " b"), ("a.", " b"), ("a", " b c")]
        self.splits = not inner and all(np.array_equal(self.whole(x + y), np.concatenate([self.whole(x), self.whole(y[1:])])) for x, y in joins)
        self.marks = False
        self.old, self.new = _Pieces(), _Pieces()

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.model.encode(text), np.uint32)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        mark = "▁".encode()  # in a text, it may go together with a space after it
        marked = [i for i, t in enumerate(texts) if mark in t]
        out = super().__call__([b"" if mark in t else t for t in texts]) if marked else super().__call__(texts)
        for i in marked:
            out[i] = self.whole(texts[i].decode(errors="replace"))
        return out

    def _learn(self, b: Block, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray, keys: np.ndarray) -> None:
        data, lines = b.bytes.tobytes(), kinds == LINE
        words = [("\n" if line else "") + data[x:y].decode(errors="replace") for x, y, line in zip(starts.tolist(), ends.tolist(), lines.tolist(), strict=True)]
        skip = len(self.blank)
        found = self.model.encode(words, num_threads=1)
        self._keep(_Pieces(keys, [np.asarray(ids[skip:] if line else ids, "<u4").tobytes() for ids, line in zip(found, lines.tolist(), strict=True)]))

    def token_bytes(self) -> list[bytes]:
        """Each id's bytes; empty for ids that stand for none."""
        m, out = self.model, []
        for i in range(m.vocab_size()):
            name = m.id_to_piece(i)
            out.append(bytes([int(name[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) or m.is_unknown(i) else name.replace("▁", " ").encode())
        return out

