"""Joins of near-duplicate texts: prefixes of shingles, alone where rare and in pairs where frequent, then exact checks.

The global order of shingles is that of their hashes. Of two sets that are similar enough each lacks few of the other's shingles, so
prefixes of the order share some. A frequent shingle says little alone: frequent ones count in pairs, which takes a longer
prefix. To keep pairs few, frequent shingles fall into groups and only those of one group pair up; each group costs the prefix
one more shingle. Documents of one shingle set are one node throughout.

Links within a large group of copies are not all made. Sketches tell which pairs may link. Pairs that they call surely close are joined first, under two
keys of each node, which leaves few parts of a group of copies; then all keys that still hold several parts give a spanning forest between
parts; then, for groups larger than a block, blocks meet two by two where parts are left. The forests' edges are checked word
by word. Only where a checked edge fails between texts that no other edge joins, the parts on its two sides meet again, without the pairs
already tried and with finer sketches, until no edge fails. So every link between different parts is found, and what is made and
checked grows with the documents.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_FILE, ROW_INDEX, Workspace, connected_components, stored, text_rows, without_rows
from .words import LOWER, chunked_words, mix

#: Documents up to which a shingle counts as rare, and documents compared together; larger groups are cut into blocks, two and two.
#: Tasks over which the rows of one part are dealt in joins; words of two texts from which on they are compared with less memory.
#: Forests made anew where edges fail, before all pairs that are left are compared.
RARE, BLOCK, SALTS, LONG_WORDS, FORESTS = 32, 1024, 16, 200_000, 1

_ID = [ROW_FILE, ROW_INDEX]


def _need(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap of a set of n with any that it links to."""
    return -(-percent * n // 100)


def _schemes(n: int, percent: int) -> list[int]:
    """Schemes of grouping for a set of n: one for each size that the smaller of two linked sets may have, in powers of two."""
    return sorted({int(n).bit_length(), int(_need(n, percent)).bit_length()})


def _groups(scheme: int, percent: int) -> int:
    """Groups of frequent shingles, so that a prefix of frequent ones alone has about four in each."""
    return max(1, (1 << scheme >> 1) * (100 - percent) // 320)


def _prefix(n: int, percent: int) -> int:
    return min(n, n - int(_need(n, percent)) + 1 + _groups(_schemes(n, percent)[-1], percent))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The distinct k-word shingles of each text as sorted hashes; with fewer words the whole sequence as one."""
    for words in chunked_words(texts, LOWER):
        grams, bounds = words.grams(k), words.bounds
        for i in range(words.last - words.first):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield np.array([words.whole(i)], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def sketch(hashes: np.ndarray, spread: int = 1) -> bytes:
    """A bit for each bucket: whether an odd number of the set falls there; as many buckets as spread times the set's size, at least, in
    powers of two. Bits that differ between two sets are no more than their elements that differ."""
    bits = max(64, spread << max(0, len(hashes) - 1).bit_length())
    bucket = (mix(hashes ^ np.uint64(0x9FB21C651E98DF25)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(bucket, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _signatures(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, prefixes, sketches = [], [], [], []
        for s in shingle_sets(batch.column("text"), k):
            sizes.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            prefixes.append(s[: _prefix(len(s), percent)] if len(s) else s)
            sketches.append(sketch(s) if len(s) else b"")
        flat = np.concatenate([*prefixes, np.zeros(0, np.uint64)]).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefixes)]).astype(np.int32)), pa.array(flat))
        columns = {**{n: batch.column(n) for n in (*_ID, "doc_id")}, "n": pa.array(sizes, pa.int64()), "digest": pa.array(digests, pa.binary()), "prefix": lists, "sketch": pa.array(sketches, pa.binary())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


@lru_cache(maxsize=512)
def _two_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _pairs_of_frequent(batches: Iterator[pa.RecordBatch], percent: int, flush: int = 200_000) -> Iterator[pa.RecordBatch]:
    """For each node a signature for every two frequent shingles of one group, under each of its schemes."""
    parts: list[tuple[np.ndarray, ...]] = []

    def made() -> pa.RecordBatch:
        a, b, scheme, node = (np.concatenate([p[k] for p in parts]) for k in range(4))
        mark = mix(mix(a.view(np.uint64) + scheme.view(np.uint64) * np.uint64(0x632BE59BD9B4E019)) ^ b.view(np.uint64))
        parts.clear()
        return pa.RecordBatch.from_arrays([pa.array(mark.view(np.int64)), pa.array(node)], ["mark", "node"])

    waiting = 0
    for batch in batches:
        nodes, sizes, lists = (batch.column(c) for c in ("node", "n", "tokens"))
        edges, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        for k, (node, n) in enumerate(zip(nodes.to_pylist(), sizes.to_pylist(), strict=True)):
            tokens = np.sort(flat[edges[k] : edges[k + 1]])
            for scheme in _schemes(n, percent):
                group = tokens.view(np.uint64) % np.uint64(_groups(scheme, percent))
                order = np.argsort(group, kind="stable")
                mine, cuts = tokens[order], np.flatnonzero(np.diff(group[order])) + 1
                for members in np.split(mine, cuts):
                    if len(members) > 1:
                        i, j = _two_of(len(members))
                        parts.append((members[i], members[j], np.full(len(i), scheme), np.full(len(i), node)))
                        waiting += len(i)
            if waiting > flush:
                yield made()
                waiting = 0
    if parts:
        yield made()


def _forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, ties: tuple[np.ndarray, ...] = ()) -> np.ndarray:
    """Indices of the edges of a spanning forest of least weight (ties by the nodes, then by these)."""
    order = np.lexsort((*ties[::-1], b, a, weight))
    nodes, ends = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label, live, chosen = np.arange(len(nodes)), np.arange(len(a)), []
    while True:
        lu, lv = label[u[live]], label[v[live]]
        apart = lu != lv
        live, lu, lv = live[apart], lu[apart], lv[apart]
        if not len(live):
            return order[np.unique(np.concatenate([*chosen, np.zeros(0, np.int64)]))]
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, lu, live)
        np.minimum.at(best, lv, live)
        roots = np.flatnonzero(best < len(a))
        edge = best[roots]
        chosen.append(edge)
        parent = np.arange(len(nodes))
        parent[roots] = np.where(label[u[edge]] == roots, label[v[edge]], label[u[edge]])
        both = roots[(parent[parent[roots]] == roots) & (roots < parent[roots])]
        parent[both] = both
        while (up := parent[parent]).tolist() != parent.tolist():
            parent = up
        label = parent[label]


def _plausible(key: np.ndarray, node: np.ndarray, n: np.ndarray, part: np.ndarray, sketches: list[bytes], percent: int, sure: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, weight) of pairs of one key and different parts that sizes and sketches don't rule out (sure: call close with a
    margin); rows are in order of key and n."""
    size = np.fromiter(map(len, sketches), np.int64, len(sketches)) // 8
    rows: dict[int, np.ndarray] = {}
    at = np.zeros(len(size), np.int64)
    sizes, kind = np.unique(size, return_inverse=True)
    for s in sizes:
        mine = np.flatnonzero(size == s)
        at[mine] = np.arange(len(mine))
        rows[int(s)] = np.frombuffer(b"".join([sketches[i] for i in mine]), np.uint64).reshape(len(mine), s)

    def close(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        cross = (part[a] != part[b]) & (node[a] != node[b])
        a, b = a[cross], b[cross]
        total = n[a] + n[b]
        most = total - 2 * -(-percent * total // (100 + percent))
        both = kind[a] * len(sizes) + kind[b]
        for code in np.flatnonzero(np.bincount(both)).tolist():
            s, wide = int(sizes[code // len(sizes)]), int(sizes[code % len(sizes)])
            some = np.flatnonzero(both == code)
            for part_ in np.array_split(some, max(1, len(some) * wide // 1_000_000)):
                if not len(part_):
                    continue
                x, y = rows[s][at[a[part_]]], rows[wide][at[b[part_]]]
                y = np.bitwise_xor.reduce(y.reshape(len(part_), wide // s, s), 1) if wide > s else y
                apart = np.bitwise_count(x ^ y).sum(1).astype(np.int64)
                if sure:  # elements that differ, as so many bits that differ let expect
                    bits = 64.0 * s
                    ok = -bits / 2 * np.log(np.maximum(1 - 2 * apart / bits, 1e-9)) <= 0.8 * most[part_]
                else:
                    ok = apart <= most[part_]
                yield a[part_[ok]], b[part_[ok]], apart[ok] / total[part_[ok]]

    # large groups some rows with all after them at a time; of small ones every row with the next, then the next but one and so on
    edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    large = np.flatnonzero(np.diff(edges) > 128)
    for lo, hi in zip(edges[large].tolist(), edges[large + 1].tolist(), strict=True):
        for first in range(lo, hi, 64):
            mine = np.arange(first, min(first + 64, hi))
            others = np.arange(first + 1, lo + int(np.searchsorted(n[lo:hi], 100 * n[mine[-1]] // percent, "right")))
            i, j = np.nonzero((others > mine[:, None]) & (100 * n[mine][:, None] >= percent * n[others]))
            yield from close(mine[i], others[j])
    i, d = np.flatnonzero(np.repeat(np.diff(edges) <= 128, np.diff(edges))), 0
    while True:
        d += 1
        i = i[i + d < len(key)]
        i = i[(key[i] == key[i + d]) & (100 * n[i] >= percent * n[i + d])]
        if not len(i):
            return
        yield from close(i, i + d)


def _candidates(batches: Iterator[pa.RecordBatch], percent: int, sure: bool, forest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of nodes for rows (key, node, n, part, sketch, tried) that come in order of key and n.

    forest: of all keys of a task together a spanning forest between parts, so fewer than the task has parts; else all pairs.
    tried are the greater nodes that a node has been compared with in vain.
    """
    held: list[pa.RecordBatch] = []
    found: list[tuple[np.ndarray, ...]] = []  # a, b, their parts, weight
    waiting = 0

    def reduce() -> None:
        if found:
            a, b, p, q, w = (np.concatenate([f[k] for f in found]) for k in range(5))
            if forest:
                keep = _forest(np.minimum(p, q), np.maximum(p, q), w, (a, b))
            else:
                _, keep = np.unique(np.stack([a, b]), axis=1, return_index=True)
            found[:] = [(a[keep], b[keep], p[keep], q[keep], w[keep])]

    def add(table: pa.Table) -> None:
        nonlocal waiting
        key, node, n, part = (np.asarray(table.column(c)) for c in ("key", "node", "n", "part"))
        tried = table.column("tried").combine_chunks()
        vain = np.zeros(0, np.int64)
        if tried.null_count < len(tried):
            # a pair is one number: places of its nodes among the nodes here
            names = np.unique(node)
            lists = pc.list_value_length(tried).fill_null(0).to_numpy(zero_copy_only=False)
            other = np.asarray(tried.flatten())
            at = np.minimum(np.searchsorted(names, other), len(names) - 1)
            here = names[at] == other
            vain = np.unique((np.searchsorted(names, np.repeat(node, lists)) * len(names) + at)[here])
        for i, j, w in _plausible(key, node, n, part, table.column("sketch").to_pylist(), percent, sure):
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            if len(vain):
                fresh = ~np.isin(np.searchsorted(names, a) * len(names) + np.searchsorted(names, b), vain)
                i, j, a, b, w = i[fresh], j[fresh], a[fresh], b[fresh], w[fresh]
            if len(a):
                found.append((a, b, part[i], part[j], w))
                waiting += len(a)
            if waiting > 1_000_000:
                reduce()
                waiting = 0

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        key = np.asarray(table.column("key"))
        cut = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
        held = table.slice(cut).to_batches()
        if cut:
            add(table.slice(0, cut))
            if not forest and found:
                reduce()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.pop()[:2]], ["a", "b"])
    if held:
        add(pa.Table.from_batches(held))
    reduce()
    for a, b, *_ in found:
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _split(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered."""
    return text.encode().translate(_LOWER).split()


def _shingles(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)} if words else set()


def _overlap_of_long(x: list[bytes], y: list[bytes], k: int) -> tuple[int, int, int]:
    """(shingles in both, of x, of y), by numbers that stand for words and then for runs of them, which takes little memory for long texts."""
    ids: dict[bytes, int] = {}
    run = np.fromiter((ids.setdefault(w, len(ids)) for w in chain(x, y)), np.int64, len(x) + len(y))
    word = run
    for i in range(1, k):
        _, run = np.unique(run[:-1] * np.int64(len(ids)) + word[i:], return_inverse=True)
    of = lambda words, a: np.unique(run[a : a + len(words) - k + 1]) if len(words) >= k else np.array([-1 - a])
    s, t = of(x, 0), of(y, len(x))
    if len(x) < k or len(y) < k:
        return int(x == y), len(s), len(t)
    return len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t)


def _verify(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Whether each pair's sets of shingles, made anew from the texts and compared word by word, are similar enough."""
    known: OrderedDict[int, set] = OrderedDict()

    def of(node: int, words: list[bytes]) -> set:
        if node not in known:
            known[node] = _shingles(words, k)
            if len(known) > 64:
                known.popitem(last=False)
        return known[node]

    for batch in batches:
        linked = []
        for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
            v, w = _split(x.as_py()), _split(y.as_py())
            if len(v) + len(w) > LONG_WORDS:
                both, m, n = _overlap_of_long(v, w, k)
            else:
                s, t = of(a, v), of(b, w)
                both, m, n = len(s & t), len(s), len(t)
            linked.append(100 * both >= percent * (m + n - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])


def _fine(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([sketch(s, 16) for s in shingle_sets(batch.column("text"), k)], pa.binary())], ["node", "sketch"])


def _salted(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has a row for a key at most; a key of many rows on the left is dealt out in SALTS."""
    one = left.withColumn("__salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    two = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return one.join(two, [key, "__salt"], how).drop("__salt")


class _Keys:
    """Keys under which nodes meet, from marks (mark, node, n): every two nodes of a mark that may link meet under some key.

    A mark of BLOCK nodes at most is a key. Larger ones fall apart by size first, as linked sets are near in size; what is still larger is dealt
    into blocks: within() has the keys inside blocks, between() those under which blocks meet.
    """

    def __init__(self, marks: DataFrame, ws: Workspace, name: str, percent: int, few: bool = False):
        """few: there are BLOCK nodes at most, so every mark is a key."""
        self.ws, self.name, self.cross = ws, name, False
        self.marks = ws.write(marks, f"{name}_marks")
        if few:
            self.within = self.marks.select(F.col("mark").alias("key"), "node")
            return
        counts = ws.write(self.marks.groupBy("mark").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), f"{name}_counts")
        shared = self.marks.hint("merge").join(counts, "mark")
        small = shared.where(F.col("m") <= BLOCK).select(F.col("mark").alias("key"), "node")
        band = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100)) + 1e-9)
        banded = shared.where(F.col("m") > BLOCK).withColumn("band", F.explode(F.array(band, band + 1))).withColumn("mark", F.xxhash64("mark", "band")).select("mark", "node")
        self.large = ws.write(banded, f"{name}_banded")
        blocks = self.large.groupBy("mark").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        cut = self.large.hint("merge").join(blocks, "mark").select(F.xxhash64("mark", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("key"), "node")
        self.within = ws.write(small.unionByName(cut), f"{name}_within")
        self.cross = self.large.limit(1).count() > 0
        ws.drop(f"{name}_counts")

    def drop(self, *tables: str) -> None:
        self.ws.drop(*[f"{self.name}_{t}" for t in tables])

    def apart(self, keyed: DataFrame, key: str, parts: DataFrame | None, name: str) -> DataFrame:
        """(key, node, part) of the keys that hold several parts; parts is None while each node is its own."""
        if parts is None:
            return keyed.withColumn("part", F.col("node"))
        placed = self.ws.write(keyed.hint("merge").join(parts, "node"), f"{self.name}_{name}_placed")
        several = placed.groupBy(key).agg(F.min("part").alias("one"), F.max("part").alias("other")).where("one < other").select(key)
        return placed.hint("merge").join(several, key, "left_semi")

    def between(self, parts: DataFrame, name: str) -> DataFrame:
        """(key, node, part) under which the blocks of large marks meet, where several parts are left. The largest part of a mark needn't meet
        itself: its blocks meet those of the rest, and these one another."""
        placed = self.ws.write(self.apart(self.large, "mark", parts, f"{name}_large"), f"{self.name}_{name}_apart")
        sizes = placed.groupBy("mark", "part").agg(F.count(F.lit(1)).alias("m"))
        top = sizes.groupBy("mark").agg(F.max_by("part", F.struct("m", "part")).alias("top"), F.max("m").alias("c"), F.sum("m").alias("m"))
        top = top.select("mark", "top", F.ceil(F.col("c") / BLOCK).cast("int").alias("cs"), F.ceil((F.col("m") - F.col("c")) / BLOCK).cast("int").alias("os"))
        core, h = F.col("part") == F.col("top"), F.xxhash64("node")
        upto = lambda n: F.sequence(F.lit(0), n - 1)
        mine = F.pmod(h, F.when(core, F.col("cs")).otherwise(F.col("os"))).cast("int")
        keys = F.when(core, F.transform(upto(F.col("os")), lambda j: F.xxhash64(F.lit("x"), "mark", mine, j))).otherwise(
            F.concat(F.transform(upto(F.col("cs")), lambda i: F.xxhash64(F.lit("x"), "mark", i, mine)), F.transform(upto(F.col("os")), lambda j: F.xxhash64(F.lit("o"), "mark", F.least(j, mine), F.greatest(j, mine))))
        )
        return placed.hint("merge").join(top, "mark").select(F.explode(keys).alias("key"), "node", "part")


def _compare(keyed: DataFrame, sizes: DataFrame, percent: int, sure: bool = False, forest: bool = True) -> DataFrame:
    """Pairs of nodes of different parts under some key of keyed (key, node, part), some more than once; sizes has node, n, sketch and tried. Sketches join here, for one shuffle only."""
    ordered = keyed.hint("merge").join(sizes, "node").select("key", "node", "n", "part", "sketch", "tried").repartition("key").sortWithinPartitions("key", "n", "node")
    return ordered.mapInArrow(lambda x: _candidates(x, percent, sure, forest), "a long, b long")


def _joined(parts: DataFrame | None, edges: DataFrame, nodes: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, part) after the parts that edges (a, b) connect are one; parts is None while each node is its own."""
    if parts is None:
        found = connected_components(edges, ws, name)
        return ws.write(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("part")), f"{name}_parts")
    one = edges.join(parts.select(F.col("node").alias("a"), F.col("part").alias("p")), "a").join(parts.select(F.col("node").alias("b"), F.col("part").alias("q")), "b")
    found = connected_components(one.where("p != q").select(F.col("p").alias("a"), F.col("q").alias("b")), ws, name)
    new = _salted(parts, found.withColumnRenamed("node", "part"), "part", "left")
    return ws.write(new.select("node", F.coalesce("component", "part").alias("part")), f"{name}_parts")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: identity, doc_id, n_shingles, component_id, component.

    Two texts link when their sets of distinct shingles (of words that ASCII white space separates, A-Z lowered) overlap in percent of their
    union at least; a text of fewer words is one shingle, one without words has none and links with nothing. component_id
    is the smallest doc_id reachable over links (null only if all of these are); component is one value for each set of texts
    that reach each other, and null for a text without words. Texts of one set link whatever their ids.
    """
    ws = Workspace(docs.sparkSession, "near_dedup")
    texts = text_rows(docs, ws, id_col, text_col)
    signed = texts.mapInArrow(lambda x: _signatures(x, shingle_words, percent), f"{ROW_FILE} long, {ROW_INDEX} long, doc_id long, n long, digest binary, prefix array<bigint>, sketch binary")
    signed = ws.write(signed, "signed")
    own = F.min(F.struct(*_ID))
    classes = signed.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least_id"), own.alias("row"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
    numbered = ws.write(classes.withColumn("node", F.monotonically_increasing_id()), "numbered")
    classes, rows = numbered.drop("prefix"), signed.drop("prefix", "sketch")

    # shingles of prefixes: what stands in one set only links nothing
    tokens = numbered.select("node", F.explode("prefix").alias("mark"))
    counts = ws.write(tokens.groupBy("mark").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts")
    shared = ws.write(tokens.hint("merge").join(counts, "mark"), "shared")
    ws.drop("counts")
    rare = shared.where(F.col("df") <= RARE).select("mark", "node")
    frequent = shared.where(F.col("df") > RARE).groupBy("node").agg(F.collect_list("mark").alias("tokens"))
    sizes = classes.select("node", "n", "sketch")
    paired = frequent.join(sizes.select("node", "n"), "node").mapInArrow(lambda x: _pairs_of_frequent(x, percent), "mark long, node long")
    keys = _Keys(rare.unionByName(paired).hint("merge").join(sizes.select("node", "n"), "node"), ws, "keys", percent)
    ws.drop("shared")
    plain = sizes.withColumn("tried", F.lit(None).cast("array<bigint>"))

    # what is surely close, under the least and the greatest key of each node
    two = keys.within.groupBy("node").agg(F.array_distinct(F.array(F.min("key"), F.max("key"))).alias("key")).select(F.explode("key").alias("key"), "node")
    near = ws.write(_compare(keys.apart(two, "key", None, "near"), plain, percent, sure=True), "near")
    parts = _joined(None, near, classes, ws, "near_joined")
    # all keys that still hold several parts, then blocks of large marks two by two
    wide = ws.write(_compare(keys.apart(keys.within, "key", parts, "wide"), plain, percent), "wide")
    edges = near.union(wide)
    keys.drop("wide_placed", "within")
    if keys.cross:
        parts = _joined(parts, wide, classes, ws, "wide_joined")
        edges = edges.union(ws.write(_compare(keys.between(parts, "cross"), plain, percent), "cross"))
        keys.drop("cross_large_placed", "cross_apart", "banded")
    edges = ws.write(edges.distinct(), "edges")
    wanted = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "row.*"), "node")
    bodies = ws.write(texts.select(*_ID, "text").hint("merge").join(wanted, _ID).select("node", "text"), "bodies")

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        one = pairs.hint("merge").join(bodies.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        two = one.hint("merge").join(bodies.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return ws.write(two.select("a", "b", "text_a", "text_b").mapInArrow(lambda x: _verify(x, shingle_words, percent), "a long, b long, linked boolean"), name)

    held = checked(edges, "held")
    ws.drop("edges", "near", "wide", "cross")
    parts = _joined(None, held.where("linked").select("a", "b"), classes, ws, "held_joined")
    vain = failed = held.where("NOT linked").select("a", "b")
    turn, fine = 0, None
    while True:
        # edges that failed and whose ends no other edge joins: their parts meet again. Once none fails, every pair that may link is in one part
        ends = failed.join(parts.select(F.col("node").alias("a"), F.col("part").alias("p")), "a").join(parts.select(F.col("node").alias("b"), F.col("part").alias("q")), "b").where("p != q")
        open_parts = ws.write(ends.select(F.explode(F.array("p", "q")).alias("part")).distinct(), f"open_{turn}")
        if not open_parts.limit(1).count():
            break
        open_nodes = ws.write(_salted(parts, open_parts, "part"), f"open_nodes_{turn}")
        few = open_nodes.count() <= BLOCK
        if fine is None:
            fine = ws.write(open_nodes.select("node").join(bodies, "node").mapInArrow(lambda x: _fine(x, shingle_words), "node long, sketch binary"), "fine").join(sizes.drop("sketch"), "node")
        again = _Keys(keys.marks.hint("merge").join(open_nodes.select("node"), "node", "left_semi"), ws, f"again_{turn}", percent, few)
        tried = vain.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("tried"))
        meet = again.within.join(open_nodes, "node") if few else again.apart(again.within, "key", open_nodes, "within")
        if again.cross:
            meet = meet.unionByName(again.between(open_nodes, "between"))
        more = ws.write(_compare(meet, fine.join(tried, "node", "left"), percent, forest=turn < FORESTS).distinct(), f"more_{turn}")
        again.drop("marks", "within", "banded", "within_placed", "between_large_placed", "between_apart")
        if not more.limit(1).count():
            break
        more = checked(more, f"more_held_{turn}")
        parts = _joined(parts, more.where("linked").select("a", "b"), classes, ws, f"more_joined_{turn}")
        if turn == FORESTS:  # all pairs that were left have been compared
            break
        failed = more.where("NOT linked").select("a", "b")
        vain, turn = vain.union(failed), turn + 1
    ws.drop("bodies", "fine")
    keys.drop("marks")

    named = classes.select("digest", "node", "least_id").join(parts.withColumnRenamed("part", "component"), "node")
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = ws.write(_salted(named, least, "component").select("digest", "component", "component_id"), "named")
    out = rows.select(*_ID, "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("digest")).alias("digest")).hint("merge").join(named, "digest", "left")
    return out.select(*_ID, "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id (a null id is the largest; of repeated ids the row stored first); texts without words all stay."""
    ws = Workspace(docs.sparkSession, "near_drop")
    docs = stored(docs, ws)
    found = ws.write(near_duplicates(docs, shingle_words, percent), "found").where("component IS NOT NULL")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *_ID)
    stays = found.groupBy("component").agg(F.min(place).alias("stays"))
    gone = found.hint("merge").join(stays, "component").where(place != F.col("stays"))
    return without_rows(docs, ws, gone)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


OP4_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_transform(range(0, len(w) - 2), lambda i: w[i + 1:i + 3]) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 90 * (na.n + nb.n - x)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS far FROM n UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.far)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, c.c AS component_id FROM n JOIN (SELECT node, min(far) AS c FROM r GROUP BY node) c ON c.node = n.doc_id
"""
