"""Words of many texts at once: numpy over the buffers of Arrow arrays, without a Python object per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled together; one longer text is handled alone.
CHUNK_BYTES = 1 << 19

SPACE = bytes([9, 10, 11, 12, 13, 32])
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_M64 = (1 << 64) - 1


def table(separators: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(is a word's byte, the byte as it counts) for each byte."""
    word, value = np.ones(256, bool), np.arange(256, dtype=np.uint8)
    word[list(separators)] = False
    if lower:
        value[65:91] += 32
    return word, value


#: Words of all but ASCII white space, as they are or with A-Z lowered; words of digits, letters and all beyond ASCII.
PLAIN, LOWER = table(SPACE, False), table(SPACE, True)
ALNUM = table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done, step = done + more, step * step & _M64
    return out


def _room(n: int) -> int:
    return 1 << max(20, int(n).bit_length())


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each span, for values that are hashes themselves; equal runs have equal hashes wherever they stand."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(base, _room(n))[:n], out=total[1:])
    back = _powers(pow(base, -1, 1 << 64), _room(n))
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


#: Masks of the first 0 to 8 bytes of eight; words of more bytes than LONG are hashed one by one.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG = 1024


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, with zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def bytes_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span: eight at a time are mixed into what the ones before gave, so no pattern of bytes makes two spans collide."""
    size = ends - starts
    eight = lanes(data)
    out = mix(size.astype(np.uint64) * np.uint64(_BASE))
    live, k = np.arange(len(size)), 0
    while len(live):
        left = size[live] - k
        live, left = live[(left > 0) & (size[live] <= LONG)], left[(left > 0) & (size[live] <= LONG)]
        out[live] = mix(out[live] ^ (eight[starts[live] + k] & _FIRST[np.minimum(left, 8)])) + np.uint64(_STEP)
        k += 8
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


@dataclass
class Words:
    """Words of texts first to last of an array: their hashes, the first word of each text (with an end), and their bytes as
    they count, data[at:to]."""

    first: int
    last: int
    hashes: np.ndarray
    bounds: np.ndarray
    data: np.ndarray
    at: np.ndarray
    to: np.ndarray

    def grams(self, k: int) -> np.ndarray:
        """Hash of words i to i+k-1 for each i that has k words after it; runs over a text's end mean nothing."""
        return grams_of(self.hashes, k)

    def whole(self, i: int) -> int:
        """Hash of all words of text i of this chunk, as grams() gives it for that many words."""
        a, b = self.bounds[i : i + 1], self.bounds[i + 1 : i + 2]
        return int(spans_hash(self.hashes[a[0] : b[0]], a - a, b - a, _STEP)[0])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array; a null has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunked_words(texts: pa.Array, kind: tuple[np.ndarray, np.ndarray], chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    offsets, data = buffers(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk_bytes, "right")) - 1)
        yield words_of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], kind, first, last)
        first = last


def words_of(data: np.ndarray, offsets: np.ndarray, kind: tuple[np.ndarray, np.ndarray], first: int, last: int) -> Words:
    is_word, value = kind
    inside = is_word[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:n]
    at, to = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    counted = value[data]
    return Words(first, last, bytes_hash(counted, at, to), np.searchsorted(at, offsets), counted, at, to)


def text_of(words: Words) -> np.ndarray:
    """For each word the number of its text in the chunk."""
    return np.repeat(np.arange(words.last - words.first), np.diff(words.bounds))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of values[i:i+width] for each i with so many values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def grams_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes."""
    at = np.arange(max(0, len(hashes) - k + 1))
    return spans_hash(hashes, at, at + k, _STEP)
