"""Words of many texts at once, as numpy arrays; a helper of the tasks in Python."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

#: The bytes that separate words: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_MASKS = np.array([0] + [2 ** (8 * k) - 1 for k in range(1, 9)], dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(29)
_LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> _SHIFT)) * _B
    return h ^ (h >> np.uint64(32))


class Words:
    """``buffer`` holds the texts; word ``i`` is ``buffer[start[i]:end[i]]``.

    The words of text ``d`` are those from ``first[d]`` to ``first[d + 1]``.
    """

    def __init__(self, texts: list[bytes]):
        self.buffer = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.buffer, dtype=np.uint8)
        space = IS_SPACE[raw]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if raw.size and not space[0]:
            edges = np.concatenate(([0], edges))
        self.start, self.end = edges[0::2], edges[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        padded = self.buffer + bytes(8)
        eight = np.ndarray((len(self.buffer),), dtype="<u8", buffer=padded, strides=(1,))
        length = self.end - self.start
        h = length.astype(np.uint64) * _A
        at = np.flatnonzero(length <= _LONG)
        done = 0
        while at.size:
            left = np.minimum(length[at] - done, 8)
            part = eight[self.start[at] + done] & _MASKS[left]
            h[at] = mix((h[at] ^ part) * _A)
            done += 8
            at = at[length[at] > done]
        for k in np.flatnonzero(length > _LONG):
            h[k] = xxhash.xxh3_64_intdigest(self.buffer[self.start[k] : self.end[k]])
        return mix(h)

    def of_text(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive words; there are ``len(h) - k + 1``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _A
        out += h[j : j + n]
    return mix(out)


def chunks(rows: Iterable, size, most: int) -> Iterator[list]:
    """Lists of rows of about ``most`` bytes; a longer row makes a list of its own."""
    now, total = [], 0
    for row in rows:
        n = size(row)
        if now and total + n > most:
            yield now
            now, total = [], 0
        now.append(row)
        total += n
    if now:
        yield now
