"""Character n-grams of many texts at once: numpy over code points, without a Python object per n-gram."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Characters of text counted together; longer texts are counted in slices.
CHUNK = 32_000
#: Characters that the terms of a dictionary may have, and an alphabet: with CHUNK new ones there is room.
DICTIONARY_CHARS, ALPHABET = 32_000, 65_534
#: n-grams held before they are merged, and merged ones before they are given out.
HELD = 1 << 21
_NONE = np.zeros(0, np.uint64)
_BITS = np.uint64(16)


class Grams:
    """n-grams of low to high characters (4 at most), each a key of 16 bits a character by an alphabet that grows. A full alphabet starts anew from `chars`; `before` is called before that."""

    def __init__(self, low: int, high: int, chars: np.ndarray = _NONE, before: Callable[[], None] = lambda: None):
        if not 1 <= low <= high <= 4:
            raise ValueError("n-grams have 1 to 4 characters")
        self.low, self.high, self.first, self.before = low, high, chars.astype(np.uint32), before
        self._start()

    def _start(self) -> None:
        self.codes = np.zeros(0x110000, np.uint16)
        self.chars = np.zeros(1, np.uint32)
        self._learn(self.first)

    def _learn(self, chars: np.ndarray) -> None:
        self.codes[chars] = np.arange(len(self.chars), len(self.chars) + len(chars))
        self.chars = np.concatenate([self.chars, chars])

    def _encode(self, points: np.ndarray) -> np.ndarray:
        codes = self.codes[points]
        if codes.all():
            return codes
        new = np.unique(points[codes == 0])
        if len(self.chars) - 1 + len(new) > ALPHABET:
            self.before()
            self._start()
            new = np.unique(points[self.codes[points] == 0])
        self._learn(new)
        return self.codes[points]

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the text, key, times) of each text's distinct n-grams; the texts have about CHUNK characters in all."""
        points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        codes = self._encode(points).astype(np.uint64)
        codes[ends - 1] = 0
        width = self.high - self.low + 1
        grams = np.zeros((len(codes), width), np.uint64)
        key, whole = codes, codes > 0
        for k in range(1, min(self.high, len(codes)) + 1):
            if k > 1:
                key, whole = (key[:-1] << _BITS) | codes[k - 1 :], whole[:-1] & (codes[k - 1 :] > 0)
            if k >= self.low:
                grams[: len(key), k - self.low] = np.where(whole, key, 0)
        flat, ends = grams.ravel(), ends * width
        at = 0
        for end in ends.tolist():
            flat[at:end].sort()
            at = end
        first = np.ones(len(flat), bool)
        np.not_equal(flat[1:], flat[:-1], out=first[1:])
        first[ends[:-1]] = True
        runs = np.flatnonzero(first)
        times, keys = np.diff(runs, append=len(flat)), flat[runs]
        keep = keys > 0
        return np.searchsorted(ends, runs[keep], side="right"), keys[keep], times[keep]

    def terms(self, keys: np.ndarray) -> list[str]:
        out, size = np.empty(len(keys), object), sum((keys >> np.uint64(16 * k)) > 0 for k in range(4))
        for k in range(self.low, self.high + 1):
            of = np.flatnonzero(size == k)
            codes = (keys[of, None] >> np.arange(16 * (k - 1), -1, -16, dtype=np.uint64)) & np.uint64(0xFFFF)
            s = self.chars[codes].tobytes().decode("utf-32-le")
            out[of] = [s[i : i + k] for i in range(0, len(s), k)]
        return out.tolist()


def keys_of(terms: list[str], chars: np.ndarray) -> np.ndarray:
    """Keys by an alphabet that starts with `chars`, which has all the terms' characters."""
    code = {chr(c): i + 1 for i, c in enumerate(chars.tolist())}
    keys = np.zeros(len(terms), np.uint64)
    for i, t in enumerate(terms):
        key = 0
        for c in t:
            key = key << 16 | code[c]
        keys[i] = key
    return keys


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        ids, texts, at, size = batch.column(0), batch.column(1).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            if size + len(t) > CHUNK and i > at:
                yield ids.slice(at, i - at), texts[at:i]
                at, size = i, 0
            size += len(t)
        if texts:
            yield ids.slice(at), texts[at:]


def frequencies(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
    """(term, texts that have it), in parts that add up, of (id, text)."""
    kept, counts, held, size, out = _NONE, np.zeros(0, np.int64), [], 0, []

    def merge() -> None:
        nonlocal kept, counts, size
        keys, n = np.unique(np.concatenate([_NONE, *held]), return_counts=True)
        both, n = np.concatenate([kept, keys]), np.concatenate([counts, n])
        kept, index = np.unique(both, return_inverse=True)
        counts = np.zeros(len(kept), np.int64)
        np.add.at(counts, index, n)
        held.clear()
        size = 0

    def give() -> None:
        nonlocal kept, counts
        merge()
        if len(kept):
            out.append(pa.RecordBatch.from_arrays([pa.array(grams.terms(kept), pa.string()), pa.array(counts, pa.int64())], ["term", "df"]))
        kept, counts = _NONE, counts[:0]

    grams = Grams(low, high, before=give)
    for _, texts in _chunks(batches):
        keys = grams.count(texts)[1]
        held.append(keys)
        size += len(keys)
        if size > HELD:
            merge()
            if len(kept) > HELD:
                give()
        yield from out
        out.clear()
    give()
    yield from out


def pairs(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
    """(id, term, times), in parts that add up, of (id, text) of any length."""
    grams = Grams(low, high)
    for batch in batches:
        for i, text in enumerate(batch.column(1).to_pylist()):
            for at in range(0, len(text), CHUNK):
                # n-grams that begin in the slice: what lies in the overlap alone begins in the next
                part = text[at : at + CHUNK + high - 1]
                _, keys, times = grams.count([part])
                keys, times = [keys], [times]
                if len(part) > CHUNK:
                    _, k, t = grams.count([part[CHUNK:]])
                    keys.append(k)
                    times.append(-t)
                keys, times = np.concatenate(keys), np.concatenate(times)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(keys), i))), pa.array(grams.terms(keys), pa.string()), pa.array(times, pa.int64())], ["message_id", "term", "tf"])


def weigh(batches: Iterator[pa.RecordBatch], low: int, high: int, dictionary: tuple[np.ndarray, np.ndarray, np.ndarray], absent: float | None) -> Iterator[pa.RecordBatch]:
    """Of (id, text): sums over the terms that have a weight; terms without one, where `absent` gives none, with their times.

    A dictionary is (characters, keys in order and one above all, rarity of each).
    """
    chars, known, rarity = dictionary
    grams = Grams(low, high, chars)
    names = ["message_id", "term", "tf", "terms", "total", "squares"]
    for ids, texts in _chunks(batches):
        row, keys, times = grams.count(texts)
        at = np.searchsorted(known, keys)
        found = known[at] == keys
        if absent is None:
            rest = ~found
            n = int(rest.sum())
            if n:
                none = pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[rest])), pa.array(grams.terms(keys[rest]), pa.string()), pa.array(times[rest], pa.int64()), *none], names)
            row, times, at = row[found], times[found], at[found]
            w = rarity[at]
        else:
            w = np.where(found, rarity[at], absent)
        w = w * (1 + np.log(times))
        n = np.bincount(row, minlength=len(texts))
        has = np.flatnonzero(n)
        sums = [pa.array(np.bincount(row, x, len(texts))[has], pa.float64()) for x in (w, w * w)]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(has)), pa.nulls(len(has), pa.string()), pa.nulls(len(has), pa.int64()), pa.array(n[has], pa.int64()), *sums], names)
