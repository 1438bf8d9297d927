"""Word shingles of whole texts as 64-bit hashes, vectorised over the bytes of many texts."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

#: Bytes of text that are hashed together (a longer text makes a block of its own).
BLOCK = 1 << 20
#: Longer words are hashed by blake2b, since the rolling polynomial modulo 2**64 can be fooled by long ones.
LONG_WORD = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the polynomial's base and of its inverse modulo 2**64, up to n at least."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, 1 << 16)
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a block."""
    data = _LOWER[data]
    word = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        h[i] = int.from_bytes(blake2b(data[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
    return h, start


def words(texts: list[bytes]):
    """Yields for each text the hashes of its words (A-Z lower-cased, cut at ASCII white space), in order."""
    block: list[bytes] = []
    size = 0

    def flush():
        data = np.frombuffer(b"\n".join(block) + b"\n", np.uint8)
        h, start = _words(data)
        ends = np.cumsum([len(t) + 1 for t in block])
        cut = np.searchsorted(start, ends)
        a = 0
        for b in cut.tolist():
            yield h[a:b]
            a = b

    for t in texts:
        if block and size + len(t) > BLOCK:
            yield from flush()
            block, size = [], 0
        block.append(t)
        size += len(t) + 1
    if block:
        yield from flush()


def shingle_set(h: np.ndarray, width: int = 3) -> np.ndarray:
    """The distinct shingles of a word sequence, sorted; fewer words than ``width`` make one shingle."""
    n = len(h)
    if not n:
        return np.empty(0, np.uint64)
    w = min(n, width)
    out = np.full(n - w + 1, w, np.uint64)
    for k in range(w):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[k:n - w + 1 + k])
    return np.unique(out)
