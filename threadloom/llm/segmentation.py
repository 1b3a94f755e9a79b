"""SentencePiece encoding with sampled segmentations: forward filtering and backward sampling over the lattice of pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import buffers, mix

#: The vocabulary of the query; where it lies is a parameter of the operator.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"

SPACE = "▁"
_UNIT = re.compile("\n| *[^ \n]+| +")
#: Where one of these ends and another begins.
_CUT = re.compile(r"(?<=[^ \n])(?=[ \n])|\n")

#: Characters of text that are sampled together: what a worker holds beyond a batch and its ids grows with these (and the longest word), not with texts.
BLOCK_CHARS = 1 << 19


_BASE = 0xC2B2AE3D27D4EB4F


def _key(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(0x51ED270B))


@dataclass
class Pieces:
    """A vocabulary: log weights for sampling, ids of byte pieces, bytes of each piece, and a hash table of pieces by characters.

    The vocabulary ranks its pieces instead of giving probabilities, so a piece of rank r has the weight of a Zipf law, 1/(r + 1).
    """

    weight: np.ndarray
    byte: np.ndarray
    text: list[bytes]
    flat: np.ndarray
    begin: np.ndarray
    longest: int
    slots: np.ndarray
    hashes: np.ndarray

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        weight, byte, text, ids = np.full(n, -np.inf), np.zeros(256, np.int64), [b""] * n, {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte[int(piece[3:5], 16)], text[i] = i, bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ids[piece], text[i] = i, piece.replace(SPACE, " ").encode()
                weight[i] = -np.log(1.0 - sp.get_score(i) if -n < sp.get_score(i) <= 0 else n)
        slots, hashes = np.full(1 << 18, -1, np.int32), np.zeros(n, np.uint64)
        for piece, i in ids.items():
            h = np.zeros(1, np.uint64)
            for c in piece:
                h = h * np.uint64(_BASE) + _key(np.array([ord(c)], np.uint32))
            hashes[i] = h = _finish(h, len(piece))[0]
            at = int(h >> np.uint64(46))
            while slots[at] >= 0:
                at = (at + 1) % len(slots)
            slots[at] = i
        begin = np.append(0, np.cumsum([len(t) for t in text]))
        return Pieces(weight, byte, text, np.frombuffer(b"".join(text), np.uint8), begin, max(map(len, ids), default=1), slots, hashes)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Id of the piece of each hash, -1 for none."""
        at = (h >> np.uint64(46)).astype(np.int64)
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        while len(todo):
            i = self.slots[at[todo]].astype(np.int64)
            same = (i >= 0) & (self.hashes[i] == h[todo])
            out[todo[same]] = i[same]
            todo = todo[(i >= 0) & ~same]
            at[todo] = (at[todo] + 1) % len(self.slots)
        return out


def _finish(h: np.ndarray, length: int) -> np.ndarray:
    return mix(h ^ np.uint64(length * 0x2545F4914F6CDD1D & (1 << 64) - 1))


@dataclass
class Lattices:
    """Lattices of all units, the longest unit first. Place (unit, end) has number depth[end] + unit; its edges, the longest piece first, are
    those from first[place] on, with the place in the unit where each starts, its piece (-1: the bytes of a character that is no
    piece) and its cumulative probability among the edges into the place, by forward filtering."""

    units: list[str]
    length: np.ndarray
    depth: np.ndarray
    first: np.ndarray
    start: np.ndarray
    piece: np.ndarray
    chance: np.ndarray


def _lattices(names: list[str], pieces: Pieces, theta: float) -> tuple[np.ndarray, Lattices]:
    """(new number of each unit, lattices)."""
    size = np.array([len(u) for u in names], np.int64)
    order = np.argsort(-size, kind="stable")
    units, length = [names[i] for i in order], size[order]
    number = np.empty(len(names), np.int64)
    number[order] = np.arange(len(names))
    # U+2581 itself isn't a space: no piece has a NUL
    codes = np.frombuffer("".join(units).replace(SPACE, "\0").replace(" ", SPACE).encode("utf-32-le"), np.uint32)
    deep = int(length[0])
    alive = np.searchsorted(-length, -np.arange(deep + 1), "right")  # units that reach each place
    depth = np.append(0, np.cumsum(alive))
    unit = np.repeat(np.arange(len(units)), length)
    pos = np.arange(len(codes)) - np.repeat(np.cumsum(length) - length, length)
    k, found = _key(codes), []
    h = np.zeros(len(codes), np.uint64)
    at = np.arange(len(codes))
    for n in range(1, min(pieces.longest, deep) + 1):
        # h: hash of the n characters up to each place (across units at the first places, which at leaves out)
        h[1:] = h[:-1] * np.uint64(_BASE) + k[1:]
        h[0] = k[0]
        at = at[pos[at] >= n - 1]
        got = pieces.find(_finish(h[at], n))
        hit = got >= 0
        found.append((at[hit], got[hit], np.full(int(hit.sum()), n)))
        if n == 1:
            bare = at[~hit]
            found.append((bare, np.full(len(bare), -1), np.ones(len(bare), np.int64)))
    char, piece, n = (np.concatenate([f[i] for f in reversed(found)]) for i in range(3))
    place = depth[pos[char] + 1] + unit[char]
    sort = np.argsort(place, kind="stable")
    place, piece, n, char = place[sort], piece[sort], n[sort], char[sort]
    start, owner = pos[char] + 1 - n, unit[char]
    total = depth[-1]
    first = np.searchsorted(place, np.arange(total + 1))
    least = pieces.weight[np.isfinite(pieces.weight)].min(initial=0.0)
    weight = np.exp(theta * np.where(piece >= 0, pieces.weight[piece], least) + 3.0 * n)  # 3 for each character: keeps sums near 1
    source = depth[start] + owner
    forward = np.zeros(total)
    forward[: alive[0]] = 1.0
    share = np.zeros(len(place))
    for end in range(1, deep + 1):
        a, b = first[depth[end]], first[depth[end + 1]]
        ways = forward[source[a:b]] * weight[a:b]
        heads = first[depth[end] : depth[end + 1]] - a
        sums = np.add.reduceat(ways, heads)
        share[a:b] = ways / np.repeat(sums, np.diff(np.append(heads, b - a)))
        forward[depth[end] : depth[end + 1]] = sums
        if end % 16 == 0 and end < deep:  # only ratios within the longest piece's reach count
            m = alive[end + 1]
            back = [slice(depth[e], depth[e] + m) for e in range(max(0, end - pieces.longest), end + 1)]
            top = np.maximum.reduce([forward[x] for x in back])
            for x in back:
                forward[x] /= top
    # sums of each place on its own, so that they don't depend on what else is in the block
    chance, heads = share, first[:-1]
    many = np.diff(first)
    for k in range(1, int(many.max(initial=0))):
        deeper = heads[many > k] + k
        chance[deeper] += chance[deeper - 1]
    chance[first[1:][many > 0] - 1] = 2.0
    return number, Lattices(units, length, depth, first, start, piece, chance)


def _blocks(texts: list[str]) -> Iterator[tuple[list[int], list[int], list[list[str]]]]:
    """(text, number of its first word here, words) of parts of texts, some BLOCK_CHARS of them at a time; long texts are cut between words."""
    row, first, words, size = [], [], [], 0
    for i, text in enumerate(texts):
        text, at, nth = " " + text if text else "", 0, 0
        while at < len(text):
            to = min(len(text), at + BLOCK_CHARS - size)
            if to < len(text):
                cut = _CUT.search(text, to)
                to = cut.end() if cut else len(text)
            found = _UNIT.findall(text, at, to)
            row.append(i)
            first.append(nth)
            words.append(found)
            size, at, nth = size + to - at, to, nth + len(found)
            if size >= BLOCK_CHARS:
                yield row, first, words
                row, first, words, size = [], [], [], 0
    if row:
        yield row, first, words


@dataclass
class Sampler:
    """theta: exponent of the weights (0: all segmentations alike; larger: nearer to the best one); seed: of all rows."""

    path: str = MODEL_PATH
    theta: float = 1.0
    seed: int = 0

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text). A text's sample depends on its key and the seed only.

        A space goes before each text, as the vocabulary's own encoder has it. No piece crosses from a character into a space, so each
        word with the spaces before it is a lattice of its own; all words of a block are sampled together, one backward step of each at a time.
        """
        ids, count = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        with np.errstate(over="ignore"):
            seeds = mix(keys.astype(np.uint64) + np.uint64(self.seed) * np.uint64(_BASE))
        for row, first, words in _blocks(texts):
            n_words = np.fromiter(map(len, words), np.int64, len(words))
            row_of = np.repeat(np.array(row, np.int64), n_words)
            nth = np.arange(len(row_of)) + np.repeat(np.array(first, np.int64) - np.cumsum(n_words) + n_words, n_words)
            out, owner = self._block(words, mix(seeds[row_of] + nth.astype(np.uint64)), row_of)
            ids.append(out)
            count += np.bincount(owner, minlength=len(texts))
        return np.concatenate(ids), count

    def _block(self, words: list[list[str]], seeds: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words, the row of each id); a seed and a row for each word."""
        units: dict[str, int] = {}
        word = np.fromiter((units.setdefault(u, len(units)) for u in chain.from_iterable(words)), np.int64, len(row))
        number, lat = _lattices(list(units), Pieces.load(self.path), self.theta)
        word = number[word]
        live, place = np.arange(len(word)), lat.length[word]
        steps, taken = np.zeros(len(word), np.int32), []
        while len(live):
            u = (mix(seeds[live] + np.uint64((len(taken) + 1) * _BASE & (1 << 64) - 1)) >> np.uint64(11)).astype(float) * 2.0**-53
            edge = lat.first[lat.depth[place] + word[live]]
            going = np.flatnonzero(u >= lat.chance[edge])
            while len(going):
                edge[going] += 1
                going = going[u[going] >= lat.chance[edge[going]]]
            taken.append((live, edge))
            steps[live] += 1
            place = lat.start[edge]
            more = place > 0
            live, place = live[more], place[more]
        end = np.cumsum(steps)
        edges = np.empty(int(end[-1]), np.int64)
        for k, (w, e) in enumerate(taken):
            edges[end[w] - 1 - k] = e
        out, at_row = lat.piece[edges], np.repeat(row, steps)
        bad = np.flatnonzero(out < 0)
        if len(bad):
            owner = np.repeat(word, steps)[bad]
            spelled = [self.spell(lat.units[o][int(i)]) for o, i in zip(owner, lat.start[edges[bad]], strict=True)]
            size = np.ones(len(out), np.int64)
            size[bad] = [len(b) for b in spelled]
            spread, to = np.repeat(out, size), np.cumsum(size) - size
            where = np.repeat(to[bad], size[bad]) + np.concatenate([np.arange(len(b)) for b in spelled])
            spread[where] = np.concatenate(spelled)
            out, at_row = spread, np.repeat(at_row, size)
        return out.astype(np.int32), at_row

    @lru_cache(maxsize=4096)  # noqa: B019
    def spell(self, char: str) -> np.ndarray:
        return Pieces.load(self.path).byte[list(char.encode())]

    def __hash__(self):
        return hash((self.path, self.theta, self.seed))

    def decode(self, ids: list[int]) -> str:
        """The text of encoded ids, byte for byte."""
        text = Pieces.load(self.path).text
        return b"".join([text[i] for i in ids])[1:].decode()


    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of pieces in order."""
        pieces = Pieces.load(self.path)
        begin = pieces.begin[ids]
        size = pieces.begin[ids + 1] - begin
        to = np.cumsum(size)
        return pieces.flat[np.repeat(begin - to + size, size) + np.arange(to[-1] if len(to) else 0)]


#: Bytes of text handed to the sampler together in a Python worker, at least one text.
SLICE_BYTES = 1 << 20


def encode_pieces(docs: DataFrame, sampler: Sampler | None = None, id_col: str = "doc_id", text_col: str = "text", name: str = "piece_ids") -> DataFrame:
    """docs and a sampled segmentation of each text, as ids of pieces.

    The sample is drawn by forward filtering and backward sampling, from a seed that depends on the row's id and the sampler's seed, so it is
    the same wherever and whenever the row is encoded; rows with one id and text are encoded alike, and null ids share a key. A null text has
    null ids, an empty text none. decode_pieces() gives back every text exactly. A column of docs that has the name is replaced.
    """
    sampler = sampler or Sampler()

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array, keys: pa.Array) -> pa.Array:
        return pa.concat_arrays([ids for _, ids in _slices(texts, keys, sampler)] or [pa.array([], pa.list_(pa.int32()))])

    return docs.withColumn(name, encode(F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")))


def _slices(texts: pa.Array, keys: pa.Array, sampler: Sampler) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """Some texts at a time with their ids."""
    key = np.asarray(keys.fill_null(-1)).astype(np.int64)
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + SLICE_BYTES, "right")))
        some = texts.slice(first, last - first)
        ids, n = sampler.encode(some.fill_null("").to_pylist(), key[first:last])
        at = pa.array(np.append(0, np.cumsum(n)).astype(np.int32), mask=np.append(np.asarray(some.is_null().to_numpy(zero_copy_only=False)), False))
        yield some, pa.ListArray.from_arrays(at, pa.array(ids))
        first = last


def _lossless(texts: pa.Array, lists: pa.ListArray, sampler: Sampler) -> np.ndarray:
    """Whether each text is what its ids spell, less the space before it; nulls are."""
    ids = np.asarray(lists.values)
    n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    data = sampler.spelled(ids)
    begin = Pieces.load(sampler.path).begin
    ends = np.append(0, np.cumsum(begin[ids + 1] - begin[ids]))[np.append(0, np.cumsum(n))]
    offsets, raw = buffers(texts)
    return np.array([data[a + 1 : b].tobytes() == raw[c:d].tobytes() for a, b, c, d in zip(ends[:-1], ends[1:], offsets[:-1], offsets[1:], strict=True)], bool)


def decode_pieces(docs: DataFrame, sampler: Sampler | None = None, ids_col: str = "piece_ids", name: str = "decoded") -> DataFrame:
    """docs and the text of the ids; null ids give null. A column of docs that has the name is replaced."""
    sampler = sampler or Sampler()

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        n = np.asarray(pc.fill_null(pc.list_value_length(ids), 0)).astype(np.int64)
        flat = np.asarray(ids.flatten()).astype(np.int64)
        begin = Pieces.load(sampler.path).begin
        ends = np.append(0, np.cumsum(begin[flat + 1] - begin[flat]))[np.append(0, np.cumsum(n))]
        keep = np.ones(int(ends[-1]), bool)
        keep[ends[:-1][n > 0]] = False  # the space before each text
        data = sampler.spelled(flat)[keep]
        offsets = pa.py_buffer(np.append(0, np.cumsum(np.diff(ends) - (n > 0))).astype(np.int64).tobytes())
        texts = pa.LargeStringArray.from_buffers(len(ids), offsets, pa.py_buffer(data.tobytes()))
        return pc.if_else(ids.is_null(), pa.scalar(None, pa.large_string()), texts).cast(pa.string())

    return docs.withColumn(name, decode(F.col(f"`{ids_col}`")))


def encoded(docs: DataFrame, sampler: Sampler | None = None) -> DataFrame:
    """(doc_id, n_pieces, piece_ids, lossless) of documents: lossless if the ids, decoded at once where they are made, give the text back."""
    sampler = sampler or Sampler()

    @F.arrow_udf("struct<ids: array<int>, lossless: boolean>")
    def both(texts: pa.Array, keys: pa.Array) -> pa.Array:
        lists, same = [pa.array([], pa.list_(pa.int32()))], [np.zeros(0, bool)]
        for some, ids in _slices(texts, keys, sampler):
            lists.append(ids)
            same.append(_lossless(some, ids, sampler))
        return pa.StructArray.from_arrays([pa.concat_arrays(lists), pa.array(np.concatenate(same))], ["ids", "lossless"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.select("doc_id", both("text", "doc_id").alias("e"))
    return out.select("doc_id", F.when(F.col("e.ids").isNull(), 0).otherwise(F.size("e.ids")).cast("long").alias("n_pieces"), F.col("e.ids").alias("piece_ids"), "e.lossless")


def op9_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
