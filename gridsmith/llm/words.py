"""The words of many texts at once, as 64-bit numbers.

A word is a run of bytes other than ASCII white space, A-Z in lower case. Its
number is a polynomial over random letter values, taken from running sums over
the whole buffer, so no word becomes a Python object; words of more than LONG
bytes, for which a polynomial modulo 2^64 is weak, get their xxh3 digest.

A text of any length goes through in pieces of about CHUNK bytes, cut at white
space; a single word longer than that is hashed as it stands.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import xxhash

CHUNK = 1 << 19
LONG = 64

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93)
_BLANK = re.compile(rb"[\x09-\x0d\x20]")
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def stir(x: np.ndarray) -> np.ndarray:
    """Mixes the bits of an array of its own, in place."""
    x ^= x >> _U(32)
    x *= _C
    x ^= x >> _U(29)
    x *= _A
    x ^= x >> _U(32)
    return x


_LETTERS = stir(np.arange(1, 257, dtype=_U) * _B)
_LETTERS[65:91] = _LETTERS[97:123]
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK)
        one = int(_B)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(size, x, _U)])) for x in (_U(one), _U(pow(one, -1, 1 << 64)))]
    return _POWERS[0][:n], _POWERS[1][:n]


def _numbers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Every word's number and first byte."""
    code = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(_WHITE[code], prepend=True, append=True))
    start, end = edges[::2], edges[1::2]
    if len(start) == 1 and end[0] - start[0] > LONG:
        return np.array([xxhash.xxh3_64_intdigest(data[start[0] : end[0]].lower())], _U), start
    power, inverse = powers(len(code))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_LETTERS[code] * power)])
    size = end - start
    number = stir((sums[end] - sums[start]) * inverse[start] + size.astype(_U) * _C) if len(start) else np.zeros(0, _U)
    for i in np.flatnonzero(size > LONG).tolist():
        number[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].lower())
    return number, start


def _pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > CHUNK:
        blank = _BLANK.search(data, at + CHUNK)
        stop = blank.start() if blank else len(data)
        if stop - at > 2 * CHUNK:  # a word of more than a chunk stands by itself
            word = 1 + max(data.rfind(c, at, at + CHUNK) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
            if word > at:
                yield data[at:word]
                at = word
        yield data[at:stop]
        at = stop
    yield data[at:]


def word_numbers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has, and all their numbers in turn."""
    many = np.zeros(len(texts), np.int64)
    found: list[np.ndarray] = []
    waiting: list[bytes] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if waiting:
            number, start = _numbers(b"\n".join(waiting) if len(waiting) > 1 else waiting[0])
            begins = np.cumsum([0] + [len(w) + 1 for w in waiting[:-1]])
            np.add.at(many, np.array(owner)[np.searchsorted(begins, start, "right") - 1], 1)
            found.append(number)
        waiting.clear()
        owner.clear()
        size = 0

    for i, text in enumerate(texts):
        for piece in _pieces(text.encode("utf-8", "surrogatepass")):
            if size + len(piece) > CHUNK:
                flush()
            waiting.append(piece)
            owner.append(i)
            size += len(piece)
    flush()
    return many, np.concatenate(found) if found else np.zeros(0, _U)


def planes(values: np.ndarray) -> bytes:
    """Non-negative numbers byte by byte, all first bytes first. The last plane, or both of small numbers, are far from even and are deflated; the others are left to the shuffle's own compression."""
    wide = np.ascontiguousarray(values).astype("<u8")
    need = max(1, (int(wide.max()).bit_length() + 7) // 8) if len(wide) else 1
    table = wide.view("u1").reshape(-1, 8).T[:need].tobytes()
    plain = 0 if need <= 2 else (need - 1) * len(wide)
    return struct.pack("<BI", need, plain) + table[:plain] + zlib.compress(table[plain:], 1)


def unplanes(blob: bytes) -> np.ndarray:
    need, plain = struct.unpack("<BI", blob[:5])
    table = np.frombuffer(blob[5 : 5 + plain] + zlib.decompress(blob[5 + plain :]), "u1").reshape(need, -1)
    out = np.zeros((table.shape[1], 8), "u1")
    out[:, :need] = table.T
    return out.view("<u8").ravel()


def steps(ascending: np.ndarray) -> bytes:
    """Ascending unsigned numbers as their differences."""
    return planes(np.diff(ascending, prepend=ascending.dtype.type(0)))


def unsteps(blob: bytes) -> np.ndarray:
    return np.cumsum(unplanes(blob), dtype=_U)


def ranges(numbers: np.ndarray, many: int) -> list[slice]:
    """The range of sorted hashes that each of so many buckets gets; some may be empty."""
    cuts = np.searchsorted(numbers, np.arange(1, many, dtype=_U) * _U((2**64 - 1) // many)).tolist()
    return [slice(i, j) for i, j in zip([0, *cuts], [*cuts, len(numbers)], strict=True)]
