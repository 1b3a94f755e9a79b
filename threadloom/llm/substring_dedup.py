"""Repeated passages: suffix automata over reference shards, through which later text streams for its matching statistics.

Sending every shard to every document would take time in the square of the corpus. Here a shard holds what can
match at all: windows of `window` words are dealt by their minimizer (the least hash among the word runs inside), so equal windows
always meet in one shard. Neighbouring windows of one minimizer travel as one segment. A shard's
automaton takes its segments in the order of the documents; each first streams through what is already there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_FILE, ROW_INDEX, Workspace, text_rows
from .words import PLAIN, chunked_words, grams_of, sliding_min, text_of

#: Words that a minimizer is taken from, windows in a segment at most (a segment's decision is a bit for each), and distinct
#: segments of a shard beyond which it is dealt anew, by whole windows.
GRAM, SEGMENT_WINDOWS, SHARD_SEGMENTS = 5, 62, 2000

_FIRST = -(1 << 63)
_ID = [ROW_FILE, ROW_INDEX]


class SuffixAutomaton:
    """Suffix automaton of several word sequences: it accepts the runs of words of each, and none across two."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, moves: dict[bytes, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """A copy of q for the runs through p, which are shorter than q's longest."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            last = new

    def matching(self, words: list[bytes]) -> list[int]:
        """For each word the length of the longest run that ends there and that the automaton accepts."""
        state = have = 0
        out = []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                have = self.length[state]
            to = self.next[state].get(word)
            if to is None:
                have = 0
            else:
                state, have = to, have + 1
            out.append(have)
        return out


def shard_decisions(segments: list[list[bytes]], window: int) -> list[int]:
    """For each segment of a shard, in the documents' order, a bit for each window: whether its words start earlier."""
    automaton, out = SuffixAutomaton(), []
    for k, words in enumerate(segments):
        bits = 0
        if k:
            for end, length in enumerate(automaton.matching(words)):
                if length >= window:
                    bits |= 1 << (end - window + 1)
        if len(words) > window:
            seen = set()
            for i in range(len(words) - window + 1):
                run = tuple(words[i : i + window])
                if run in seen:
                    bits |= 1 << i
                seen.add(run)
        out.append(bits)
        if k + 1 < len(segments):
            automaton.add(words)
    return out


def _segments_of(hashes: np.ndarray, text: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, minimizer, weight) of the segments of a chunk's words; a segment that may repeat a window of
    its own weighs 2."""
    grams = grams_of(hashes, GRAM)
    width = window - GRAM + 1
    least = sliding_min(grams, width)
    valid = text[: len(least)] == text[window - 1 :]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (text[1 : len(least)] != text[: len(least) - 1])
    start = np.flatnonzero(new)
    if not len(start):
        return start, start, np.zeros(0, np.uint64), start
    ends = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
    size = ends - start
    parts = -(-size // SEGMENT_WINDOWS)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(start, parts) + nth * SEGMENT_WINDOWS
    size = np.minimum(np.repeat(ends, parts) - first, SEGMENT_WINDOWS)
    # two equal minimizers side by side: windows around them may repeat within their segment
    anchors = _anchors(grams, least, width)
    twice = np.flatnonzero((grams[anchors[1:]] == grams[anchors[:-1]]) & (np.diff(anchors) <= SEGMENT_WINDOWS + width))
    near = np.zeros(len(least) + 1, np.int64)
    np.add.at(near, np.clip(anchors[twice] - width + 1, 0, len(least)), 1)
    np.add.at(near, np.clip(anchors[twice + 1] + 1, 0, len(least)), -1)
    marked = np.append(0, np.cumsum(np.cumsum(near[:-1]) > 0))
    weight = np.where((marked[first + size] > marked[first]) & (size > 1), 2, 1)
    return first, size, least[first], weight


def _anchors(grams: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Places of grams that are the least of some window."""
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    most = ~sliding_min(~padded, width)  # the largest of the minima of all windows over a place
    return np.flatnonzero(most == grams)


def _find_segments(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        file, index, texts = (batch.column(n) for n in (*_ID, "text"))
        file, index = np.asarray(file), np.asarray(index)
        for words in chunked_words(texts, PLAIN):
            if len(words.hashes) < window:
                continue
            text = text_of(words)
            first, size, least, weight = _segments_of(words.hashes, text, window)
            if not len(first):
                continue
            row = text[first] + words.first
            columns = [file[row], index[row], (first - words.bounds[text[first]]).astype(np.int32), size.astype(np.int8), least.view(np.int64), weight.astype(np.int8)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*_ID, "start", "windows", "shard", "weight"])


def _cut_segments(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Words of the listed segments of each text."""
    for batch in batches:
        texts, lists = batch.column("text"), batch.column("found")
        sizes = np.diff(np.asarray(lists.offsets))
        flat = lists.flatten()
        start, windows = (np.asarray(flat.field(n)) for n in ("start", "windows"))
        bodies, at = [], 0
        for k, n in enumerate(sizes.tolist()):
            words = texts[k].as_py().encode().split()
            for i in range(at, at + n):
                s = int(start[i])
                bodies.append(b" ".join(words[s : s + int(windows[i]) + window - 1]))
            at += n
        row = np.repeat(np.arange(len(sizes)), sizes)
        take = lambda n: batch.column(n).take(pa.array(row))  # noqa: B023, E731
        marks = np.fromiter((xxhash.xxh64_intdigest(b) for b in bodies), np.uint64, len(bodies)).view(np.int64)
        columns = {**{n: take(n) for n in (*_ID, "rank")}, "start": pa.array(start), "windows": pa.array(windows), "shard": flat.field("shard"), "mark": pa.array(marks), "body": pa.array(bodies, pa.binary()).cast(pa.string())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _decide(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Decisions for rows (shard, mark, body) that come shard by shard."""
    held: list[pa.RecordBatch] = []

    def decided(batch: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
        shard = np.asarray(batch.column("shard"))
        bodies = batch.column("body").to_pylist()
        edges = [*np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist(), len(shard)]
        bits: list[int] = []
        for a, b in zip(edges, edges[1:]):
            bits += shard_decisions([x.encode().split(b" ") for x in bodies[a:b]], window)
        return pa.RecordBatch.from_arrays([batch.column("shard").combine_chunks(), batch.column("mark").combine_chunks(), pa.array(bits, pa.int64())], ["shard", "mark", "bits"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        shard = np.asarray(table.column("shard"))
        cut = int(np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))[-1])  # the last shard may go on
        held = table.slice(cut).to_batches()
        if cut:
            yield decided(table.slice(0, cut))
    if held:
        yield decided(pa.Table.from_batches(held))


def _cut_out(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("word", pa.int32()), ("length", pa.int32())])
    for batch in batches:
        counts, spans, kept = [], [], []
        for text, found in zip(batch.column("text"), batch.column("gone"), strict=True):
            words = (text.as_py() or "").encode().split()
            counts.append(len(words))
            if not found.is_valid:
                spans.append([])
                kept.append(b" ".join(words))
                continue
            edge = np.zeros(len(words) + 1, np.int64)
            for x in found.as_py():
                bits, start = x["bits"], x["start"]
                at = [start + i for i in range(bits.bit_length()) if bits >> i & 1]
                edge[at] += 1
                np.subtract.at(edge, [i + window for i in at], 1)
            gone = np.cumsum(edge[:-1]) > 0
            turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            spans.append([{"word": int(a), "length": int(b - a)} for a, b in zip(turn[::2], turn[1::2], strict=True)])
            kept.append(b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x]))
        columns = {**{n: batch.column(n) for n in (*_ID, "doc_id")}, "n_words": pa.array(counts, pa.int64()), "removed": pa.array(spans, pa.list_(span)), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: identity, doc_id, n_words, removed (spans of words), kept_text.

    Words are what ASCII white space separates. A word goes if a window of `window` words covers it whose words also start earlier: in a
    text of a smaller doc_id, or earlier in the same text. A null id comes first, and of repeated ids the row stored first.
    Windows are judged on the input; removed has the maximal spans. kept_text joins what is left by one space. A null text has no words;
    a text of fewer words than a window stays whole.
    """
    ws = Workspace(docs.sparkSession, "substring_dedup")
    texts = text_rows(docs, ws, id_col, text_col)
    ids = f"{ROW_FILE} long, {ROW_INDEX} long"

    # segments whose minimizer occurs again: only these can hold a repeated window
    segments = texts.select(*_ID, "text").mapInArrow(lambda x: _find_segments(x, window), f"{ids}, start int, windows byte, shard long, weight byte")
    shared = ws.write(segments.groupBy("shard").agg(F.sum("weight").alias("n")).where("n > 1").select("shard"), "shared")
    found = segments.drop("weight").hint("merge").join(shared, "shard").groupBy(*_ID).agg(F.collect_list(F.struct("start", "windows", "shard")).alias("found"))
    found = ws.write(found, "found")
    rows = texts.select(*_ID, F.coalesce("doc_id", F.lit(_FIRST)).alias("rank"), "text").hint("merge").join(found, _ID)
    cut = rows.mapInArrow(lambda x: _cut_segments(x, window), f"{ids}, rank long, start int, windows byte, shard long, mark long, body string")
    cut = ws.write(cut, "segments")
    ws.drop("found", "shared")

    # a shard with too many distinct segments is dealt anew: each window is a shard of its own
    distinct = cut.groupBy("shard", "mark").agg(F.count(F.lit(1)).alias("n"))
    large = ws.write(distinct.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD_SEGMENTS).select("shard"), "large")
    small = cut.join(large, "shard", "left_anti")
    pieces = F.split("body", " ")
    each = F.transform(F.sequence(F.lit(0), F.col("windows").cast("int") - 1), lambda i: F.struct(i.alias("i"), F.array_join(F.slice("words", i + 1, window), " ").alias("body")))
    again = cut.join(large, "shard", "left_semi").withColumn("words", pieces).select(*_ID, "rank", "start", F.explode(each).alias("w"))
    again = again.select(*_ID, "rank", (F.col("start") + F.col("w.i")).alias("start"), F.lit(1).cast("byte").alias("windows"), F.xxhash64("w.body").alias("shard"), F.xxhash64(F.lit("mark"), "w.body").alias("mark"), "w.body")
    every = small.unionByName(again)

    place = F.struct("rank", *_ID, "start")
    kinds = every.groupBy("shard", "mark").agg(F.min(place).alias("first"), F.first("body").alias("body"))
    kinds = ws.write(kinds, "kinds")
    ordered = kinds.select("shard", "mark", "body", "first").repartition("shard").sortWithinPartitions("shard", "first", "mark").drop("first")
    bits = ws.write(ordered.mapInArrow(lambda x: _decide(x, window), "shard long, mark long, bits long"), "bits")
    decided = kinds.select("shard", "mark", "first").hint("merge").join(bits, ["shard", "mark"])
    all_bits = F.expr("shiftleft(1L, cast(windows as int)) - 1L")
    hit = every.drop("body").hint("merge").join(decided, ["shard", "mark"]).withColumn("bits", F.when(place == F.col("first"), F.col("bits")).otherwise(all_bits))
    gone = ws.write(hit.where("bits != 0").groupBy(*_ID).agg(F.collect_list(F.struct("start", "bits")).alias("gone")), "gone")
    ws.drop("segments", "kinds", "bits", "large")

    out = texts.hint("merge").join(gone, _ID, "left")
    return out.mapInArrow(lambda x: _cut_out(x, window), f"{ids}, doc_id long, n_words long, removed array<struct<word: int, length: int>>, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = """
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, i, w[i + 1:i + 20] AS win FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS i FROM t WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS rn FROM k) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM later, (SELECT unnest(range(0, 20)) AS o)),
each AS (SELECT doc_id, unnest(w) AS s, unnest(range(0, len(w))) AS i FROM t),
kept AS (SELECT e.doc_id, string_agg(e.s, ' ' ORDER BY e.i) AS s FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
