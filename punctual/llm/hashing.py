"""Words and rolling hashes of a text as numpy arrays.

A text is an array of bytes.  All hashes are 64 bits, computed with wrapping arithmetic; two
different strings share a hash with probability about 2**-64, and such strings count as equal.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Texts are cut into pieces of about this many bytes, so that scratch arrays stay small.
PIECE = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept for the next call."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 2 * PIECE)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit values evenly; a bijection for each seed."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Element i is the polynomial of the first i bytes."""
    up, _ = powers(len(data))
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end (arrays), wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def pieces(data: np.ndarray, space: np.ndarray):
    """Ranges that cover the text and end at white space, so no word is cut."""
    start = 0
    while start < len(data):
        end = min(start + PIECE, len(data))
        if end < len(data):
            gaps = np.flatnonzero(space[start:end])
            if len(gaps):
                end = start + int(gaps[-1]) + 1
            else:
                later = np.flatnonzero(space[end:])
                end = end + int(later[0]) + 1 if len(later) else len(data)
        yield start, end
        start = end


def edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words ``[^\\x20\\x09-\\x0D]+`` start and end."""
    step = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` in order, A-Z lower-cased."""
    if not len(data):
        return np.empty(0, np.uint64)
    space = _SPACE[data]
    out = []
    for lo, hi in pieces(data, space):
        low = _LOWER[data[lo:hi]]
        out.append(span_hashes(prefix_hashes(low), *edges(low)))
    return np.concatenate(out)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes, ascending, of n words in a row; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    if len(words) < n:
        total = np.array([len(words)], np.uint64)
        for i in range(len(words)):
            total = mix(total * BASE + words[i : i + 1], 7)
        return total
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total = total * BASE + words[i : len(words) - n + 1 + i]
    return np.unique(mix(total, 3))


def as_bytes(text: str | None) -> np.ndarray:
    """The UTF-8 bytes of a text; none for null."""
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
