"""Token ids of whole texts by the tokenizers library, with a bounded memo of words.

The byte-level pre-tokenizer always cuts before a space that neither follows nor precedes another space. So a
text without double spaces is the sequence of its pieces between spaces, each with its leading space, and the
library has to encode each distinct piece only once per worker: as given pre-tokens, many in one call, if the piece is
plainly one or some of these, else by the whole tokenizer. Texts with double spaces are encoded whole. The memo is emptied when it
holds ``MEMO_WORDS`` pieces.
"""

from __future__ import annotations

import os

import numpy as np
import regex

MEMO_WORDS = 500_000
#: Unseen words that the library gets in one call.
BATCH_WORDS = 4000
#: Characters of text that are encoded together, so that a batch's arrays stay small.
CHUNK_CHARS = 2_000_000

#: The pattern by which the byte-level pre-tokenizer cuts (a fixed value of the format). It is applied here to pieces
#: of Latin letters, where all versions of Unicode agree; others go through the library.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
LATIN_END = "\u0250"

_ENCODERS: dict[str, "Encoder"] = {}


def _byte_level() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in kept]
    return {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LEVEL = _byte_level()


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> "Encoder":
    """One encoder per worker process and vocabulary file; it outlives tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class _Codes(dict):
    """Piece -> dense code; a new piece gets the next code and waits to be encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece):
        code = self[piece] = len(self)
        self.new.append(piece)
        return code


class Encoder:
    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer, self.memo_words = Tokenizer.from_file(path), memo_words
        self.model = self.tokenizer.model
        self.bare = Tokenizer(self.model)  # without a pre-tokenizer: words are given
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.reset()

    def reset(self) -> None:
        self.codes, self.words = _Codes(), {}
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.off, self.len = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.done = 0

    def _plain(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _word(self, word: str) -> list[int]:
        """Ids of one pre-token, which the library's model takes in the byte-level alphabet."""
        if word.isascii() and word.isprintable():  # all but the space stand for themselves
            word = word.replace(" ", "Ġ")
        else:
            word = word.encode().decode("latin-1").translate(BYTE_LEVEL)
        return [t.id for t in self.model.tokenize(word)]

    def _batch(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens that begin with a space and hold no other, and how many each has: the model takes them as
        given, and an id whose token begins with a space begins a word."""
        level = ["Ġ" + w[1:] if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(BYTE_LEVEL) for w in words]
        got = self.bare.encode_batch_fast([level[i:i + BATCH_WORDS] for i in range(0, len(level), BATCH_WORDS)], is_pretokenized=True,
                                          add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in got])
        return flat, np.diff(np.append(np.flatnonzero(self.spaced[flat]), len(flat)))

    def _enter(self, codes: list[int], flat: np.ndarray, lens: np.ndarray) -> None:
        """Put the ids of some pieces into the memo."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used:self.used + len(flat)] = flat
        self.off[codes] = self.used + np.cumsum(lens) - lens
        self.len[codes] = lens
        self.used += len(flat)

    def _learn(self) -> None:
        new, self.codes.new = self.codes.new, []
        while self.done + len(new) > len(self.off):
            self.off, self.len = (np.concatenate([x, np.empty_like(x)]) for x in (self.off, self.len))
        whole, whole_at, cut, cut_at, ask, ask_at, fresh = [], [], [], [], [], [], {}
        for i, p in enumerate(new, self.done):
            if p.__class__ is not tuple and p.isalpha():  # a space and letters: one pre-token
                whole.append(" " + p)
                whole_at.append(i)
                continue
            p = p[0] if p.__class__ is tuple else " " + p  # the first of its text has no leading space
            if p and max(p) < LATIN_END and "<|" not in p:
                parts = PRE_TOKENS(p)
                cut.append(parts)
                cut_at.append(i)
                for w in parts:
                    if w not in self.words and w not in fresh:
                        if w[0] == " " and len(w) > 1:
                            fresh[w] = len(fresh)
                        else:
                            self.words[w] = self._word(w)
            else:
                ask.append(p)
                ask_at.append(i)
        if whole or fresh:
            flat, lens = self._batch([*whole, *fresh])
            n = int(lens[:len(whole)].sum())
            self._enter(whole_at, flat[:n], lens[:len(whole)])
            ends = np.cumsum(lens[len(whole):])
            ids = flat[n:].tolist()
            a = 0
            for w, b in zip(fresh, ends.tolist(), strict=True):
                self.words[w] = ids[a:b]
                a = b
        for at, got in ((cut_at, [[x for w in parts for x in self.words[w]] for parts in cut]), (ask_at, self._plain(ask))):
            if at:
                self._enter(at, np.array([x for g in got for x in g], np.uint32), np.array([len(g) for g in got], np.int64))
        self.done += len(new)

    def _chunk(self, texts: list[str | None]):
        if len(self.codes) > self.memo_words:
            self.reset()
        pieces, counts, whole = [], [], {}
        for i, t in enumerate(texts):
            if not t:
                counts.append(0)
            elif "  " in t:
                whole[i] = np.asarray(self._plain([t])[0], np.uint32)
                counts.append(0)
            else:
                words = t.split(" ")
                words[0] = (words[0],)
                pieces += words
                counts.append(len(words))
        codes = np.fromiter(map(self.codes.__getitem__, pieces), np.int64, len(pieces))
        if self.codes.new:
            self._learn()
        lens = self.len[codes]
        ends = np.cumsum(lens)
        ids = self.ids[np.repeat(self.off[codes] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return [whole[i] if i in whole else ids[bounds[i]:bounds[i + 1]] for i in range(len(texts))]

    def encode(self, texts: list[str | None]):
        """Yields a uint32 array for each text, in order; null is empty."""
        chunk, chars = [], 0
        for t in texts:
            chunk.append(t)
            chars += len(t or "")
            if chars >= CHUNK_CHARS:
                yield from self._chunk(chunk)
                chunk, chars = [], 0
        if chunk:
            yield from self._chunk(chunk)
