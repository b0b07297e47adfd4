"""Words and word hashes of many texts at once, by whole-array operations on their UTF-8 bytes.

The hash of a word is a polynomial over its bytes modulo 2**64, taken from one running sum over the whole buffer and
then mixed; a shingle's hash combines those of its words. Two different words share a hash with a chance near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 18

_BYTE = np.arange(256)
#: Words are runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
NOT_SPACE = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))
#: Words are runs of digits, letters a-z and everything beyond ASCII.
ALNUM = (_BYTE >= 0x80) | ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A))
LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)

_RNG = np.random.Generator(np.random.PCG64(20))
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES * 5 // 4)
        for name, base in (("up", _BASE), ("back", _BACK)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    out = _POWERS["up"][:n], _POWERS["back"][:n]
    if n > CHUNK_BYTES * 5 // 4:
        _POWERS.clear()  # not kept for one long text
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts. data: the bytes (texts separated by line feeds); starts, ends: of the words; hashes;
    first: for each text the index of its first word, and at the end the number of words."""

    def __init__(self, data: np.ndarray, begins: np.ndarray, in_word: np.ndarray):
        self.data = data
        self.begins = begins  # of the texts, and at the end the length of data
        word = np.zeros(len(data) + 2, np.int8)
        word[1:-1] = in_word[data]
        edge = np.diff(word)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.starts, begins)
        up, back = _powers(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * up, out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * back[self.starts]) if len(self.starts) else np.zeros(0, np.uint64)

    def windows(self, size: int) -> np.ndarray:
        """The hash of the window of so many words from each word on; those that leave the text mean nothing."""
        h = self.hashes
        if len(h) < size:
            return np.zeros(0, np.uint64)
        total = h[: len(h) - size + 1] * _PLACE[0]
        for k in range(1, size):
            total = total + h[k : len(h) - size + 1 + k] * _PLACE[k]
        return mix(total)


def chunks(items: Sequence[str], in_word: np.ndarray = NOT_SPACE, lower: bool = True, most: int = CHUNK_BYTES) -> Iterator[tuple[int, Words]]:
    """(index of the first text, Words) for runs of whole texts of about `most` bytes."""
    at, held, size = 0, [], 0
    for i, text in enumerate(items):
        b = text.encode("utf-8", "surrogatepass")
        if held and size + len(b) > most:
            yield at, _words(held, in_word, lower)
            at, held, size = i, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield at, _words(held, in_word, lower)


def _words(held: list[bytes], in_word: np.ndarray, lower: bool) -> Words:
    data = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
    begins = np.zeros(len(held) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in held], out=begins[1:])
    return Words(LOWER[data] if lower else data, begins, in_word)


def shingles(items: Sequence[str], size: int = 5) -> Iterator[np.ndarray]:
    """For each text the hashes of its word windows, in order with repeats; of fewer words, of the whole sequence; without words, none."""
    for _, words in chunks(items):
        windows, first = words.windows(size), words.first
        for d in range(len(first) - 1):
            a, b = int(first[d]), int(first[d + 1])
            if b - a >= size:
                yield windows[a : b - size + 1]
            elif b > a:
                yield mix((words.hashes[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + _PLACE[16 + b - a])
            else:
                yield np.zeros(0, np.uint64)
