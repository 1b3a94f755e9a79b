"""Benchmark decontamination: every test suffix is looked up in suffix arrays over shards of the training texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_FILE, ROW_INDEX, Workspace, located_docs, stored, union_all
from .words import ALNUM, Words, chunked_words, words_of

#: Words of a test window, and test windows looked up in one pass; a larger benchmark takes more passes.
WINDOW, BLOCK_WINDOWS = 13, 50_000

MATCH = "array<struct<item_id: string, item_word: int, word: int, length: int>>"


@dataclass
class Tests:
    """A block of test windows: rows of word hashes (0 beyond a short window's end), with item, offset and length; ids and words of the items."""

    words: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    length: np.ndarray
    ids: list[str]
    spelled: list[list[bytes]]

    def __post_init__(self):
        self.order = np.argsort(self.words[:, 0], kind="stable")
        self.words, self.item, self.offset, self.length = (x[self.order] for x in (self.words, self.item, self.offset, self.length))
        self.firsts = np.unique(self.words[:, 0])
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.firsts >> np.uint64(48)).astype(np.int64)] = True


def test_blocks(items: Iterable[tuple[str, str | None]], window: int, block: int) -> Iterator[Tests]:
    """Blocks of the windows of the test items (id, text): every run of `window` words, or a shorter text's all words. One block is made at a time."""
    rows: list[tuple[np.ndarray, int, int]] = []
    ids: list[str] = []
    spelled: list[list[bytes]] = []

    def made() -> Tests:
        out = np.zeros((len(rows), window), np.uint64)
        for i, (w, _, _) in enumerate(rows):
            out[i, : len(w)] = w
        return Tests(out, *(np.array(x, np.int64) for x in ([r[1] for r in rows], [r[2] for r in rows], [len(r[0]) for r in rows])), ids, spelled)

    for name, text in items:
        ids.append(name)
        data = np.frombuffer((text or "").encode(), np.uint8)
        found = words_of(data, np.array([0, len(data)]), ALNUM, 0, 1)
        w = found.hashes
        spelled.append(_spelled(found, 0, len(w)))
        for i in range(max(len(w) - window, 0) + 1 if len(w) else 0):
            rows.append((w[i : i + window], len(ids) - 1, i))
            if len(rows) == block:
                yield made()
                rows, ids, spelled = [], [name], spelled[-1:]
    if rows:
        yield made()


def _spelled(words: Words, first: int, last: int) -> list[bytes]:
    """The bytes of some words, as they count."""
    if first == last:
        return []
    begin = int(words.at[first])
    data = words.data[begin : int(words.to[last - 1])].tobytes()
    return [data[a:b] for a, b in zip((words.at[first:last] - begin).tolist(), (words.to[first:last] - begin).tolist(), strict=True)]


def suffix_array(words: Words, starts: np.ndarray, depth: int) -> np.ndarray:
    """starts in the order of the suffixes there, compared word by word up to depth or the text's end."""
    end = words.bounds[1:][np.searchsorted(words.bounds[1:], starts, "right")]
    rank = np.zeros(len(starts), np.int64)
    open_ = np.arange(len(starts))
    at = np.arange(len(starts))  # place of each suffix
    for d in range(depth):
        if not len(open_):
            break
        pos = starts[open_] + d
        key = np.where(pos < end[open_], words.hashes[np.minimum(pos, len(words.hashes) - 1)], np.uint64(0))
        order = np.lexsort((key, rank[open_]))
        slots = np.sort(at[open_])
        open_, key = open_[order], key[order]
        at[open_] = slots
        new = np.ones(len(open_), bool)
        new[1:] = (key[1:] != key[:-1]) | (rank[open_][1:] != rank[open_][:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))
        rank[open_] = slots[first]
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone]
    out = np.empty(len(starts), np.int64)
    out[at] = starts
    return out


def _bound(words: Words, sa: np.ndarray, ends: np.ndarray, d: int, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, upper: bool) -> np.ndarray:
    lo, hi = lo.copy(), hi.copy()
    while (go := lo < hi).any():
        mid = (lo + hi) // 2
        at = np.where(go, mid, 0)
        pos = sa[at] + d
        have = np.where(pos < ends[at], words.hashes[np.minimum(pos, len(words.hashes) - 1)], np.uint64(0))
        left = (have <= want) if upper else (have < want)
        lo = np.where(go & left, mid + 1, lo)
        hi = np.where(go & ~left, mid, hi)
    return lo


def search(words: Words, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """(test window, word of the chunk) for every place where a window's words stand in one text."""
    none = np.zeros(0, np.int64)
    maybe = np.flatnonzero(tests.sieve[(words.hashes >> np.uint64(48)).astype(np.int64)])
    starts = maybe[np.isin(words.hashes[maybe], tests.firsts)]
    if not len(starts):
        return none, none
    sa = suffix_array(words, starts, tests.words.shape[1])
    ends = words.bounds[1:][np.searchsorted(words.bounds[1:], sa, "right")]
    heads = words.hashes[sa]
    lo, hi = np.searchsorted(heads, tests.words[:, 0], "left"), np.searchsorted(heads, tests.words[:, 0], "right")
    live = np.flatnonzero(lo < hi)
    lo, hi, found = lo[live], hi[live], []
    for d in range(1, tests.words.shape[1] + 1):
        over = tests.length[live] == d
        found.append((live[over], lo[over], hi[over]))
        live, lo, hi = live[~over], lo[~over], hi[~over]
        if not len(live):
            break
        want = tests.words[live, d]
        lo, hi = _bound(words, sa, ends, d, lo, hi, want, False), _bound(words, sa, ends, d, lo, hi, want, True)
        on = lo < hi
        live, lo, hi = live[on], lo[on], hi[on]
    q, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)
    n = hi - lo
    each = np.repeat(q, n)
    place = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return each, sa[place]


def longest(words: Words, tests: Tests) -> tuple[np.ndarray, ...]:
    """(text, item, item's word, text's word, length) of the longest verbatim matches, in this order. Their words are compared byte by byte."""
    q, at = search(words, tests)
    found = _chained(words, tests, q, at)
    same = lambda i, o, w, n: _spelled(words, w, w + n) == tests.spelled[i][o : o + n]
    places = words.bounds[found[0]] + found[3]
    if all(same(*x) for x in zip(found[1].tolist(), found[2].tolist(), places.tolist(), found[4].tolist(), strict=True)):
        return found
    # some words differ and have one hash: windows are compared one by one
    true = np.array([same(*x) for x in zip(tests.item[q].tolist(), tests.offset[q].tolist(), at.tolist(), tests.length[q].tolist(), strict=True)], bool)
    return _chained(words, tests, q[true], at[true])


def _chained(words: Words, tests: Tests, q: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """longest() of windows q at words `at`: those that follow one another in text and item are one match."""
    text = np.searchsorted(words.bounds[1:], at, "right")
    word, item, offset, length = at - words.bounds[text], tests.item[q], tests.offset[q], tests.length[q]
    order = np.lexsort((word, word - offset, item, text))
    text, item, word, offset, length = (x[order] for x in (text, item, word, offset, length))
    new = np.ones(len(text), bool)
    if len(text):
        same = (text[1:] == text[:-1]) & (item[1:] == item[:-1]) & (word[1:] - offset[1:] == word[:-1] - offset[:-1]) & (word[1:] == word[:-1] + 1)
        new[1:] = ~same
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text)) - 1 if len(text) else first
    return text[first], item[first], offset[first], word[first], word[last] + length[last] - word[first]


def _finder(tests: Tests | None):
    """A column function: for each text its number of words and its matches."""
    out_type = f"struct<n_words: int, matches: {MATCH}>"

    @F.arrow_udf(out_type)
    def find(texts: pa.Array) -> pa.Array:
        counts, parts, sizes = [], [], []
        for words in chunked_words(texts, ALNUM):
            counts.append(np.diff(words.bounds))
            if tests is None:
                sizes.append(np.zeros(len(counts[-1]), np.int64))
                continue
            text, *rest = longest(words, tests)
            sizes.append(np.bincount(text, minlength=words.last - words.first))
            parts.append(rest)
        join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        fields = [pa.array(join([p[k] for p in parts]).astype(np.int32)) for k in range(4)]
        fields[0] = pa.array(tests.ids if tests else [], pa.string()).take(fields[0])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(join(sizes))).astype(np.int32)), pa.StructArray.from_arrays(fields, ["item_id", "item_word", "word", "length"]))
        return pa.StructArray.from_arrays([pa.array(join(counts).astype(np.int32)), lists], ["n_words", "matches"])

    return find


def _union_length(matches: Column) -> Column:
    """Words that any match covers."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["word"].alias("a"), (m["word"] + m["length"]).alias("b"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(acc["end"], x["a"]))).alias("n"), F.greatest(acc["end"], x["b"]).alias("end"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, names: tuple[str, ...] = ("n_words", "n_hit", "item_ids", "matches", "contaminated")) -> DataFrame:
    """docs with n_words, n_hit, item_ids, matches and contaminated (names renames them).

    Words are runs of digits, letters and all beyond ASCII, A-Z lowered. A test window is `window` consecutive words of
    an item, or all words of a shorter one. matches are the longest verbatim matches: the item's id, its
    first word, the text's first word, and the length. contaminated: windows cover a twentieth of the
    words or more. item_ids are distinct and sorted as strings;
    a null id counts as ''. Nulls and texts without words
    have no match; repeated rows and items count each for itself. The benchmark is a stated query set: it is read in
    blocks of block_windows (some 10 MB), two of which the driver holds at most, so it may have any size. Where one block has
    it all, no row moves between executors. Else each block takes one pass over the texts, which leaves a table of the matches; these few
    join the texts at the end. A column of docs that has one of the names is replaced; __row_file and __row_index are reserved.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), item_text_col).toLocalIterator(prefetchPartitions=True)
    blocks = test_blocks(items, window, block_windows)
    first, second = next(blocks, None), next(blocks, None)
    n_words, n_hit, item_ids, matches, contaminated = names
    text, temp = F.col(f"`{text_col}`"), "__matches"
    if second is None:
        out = docs.withColumn(temp, _finder(first)(text))
        out = out.withColumns({n_words: F.col(temp).n_words.cast("long"), matches: F.col(temp).matches}).drop(temp)
    else:
        ws = Workspace(docs.sparkSession, "decontaminate")
        docs, tables = stored(docs, ws), []
        for k, block in enumerate(chain([first, second], blocks)):
            hit = located_docs(docs, ws).select(ROW_FILE, ROW_INDEX, _finder(block)(text).matches.alias("m")).where(F.size("m") > 0)
            tables.append(ws.write(hit, f"block_{k}"))
        every = ws.write(union_all(tables).groupBy(ROW_FILE, ROW_INDEX).agg(F.flatten(F.collect_list("m")).alias(temp)), "matches")
        ws.drop(*[f"block_{k}" for k in range(len(tables))])
        out = located_docs(docs, ws).hint("merge").join(every, [ROW_FILE, ROW_INDEX], "left").drop(ROW_FILE, ROW_INDEX)
        out = out.withColumns({n_words: _finder(None)(text).n_words.cast("long"), matches: F.coalesce(temp, F.array().cast(MATCH))}).drop(temp)
    # the ids of a hit only: most rows have none
    found = F.when(F.size(matches) > 0, F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["item_id"])))).otherwise(F.array().cast("array<string>"))
    out = out.withColumns({n_hit: _union_length(F.col(f"`{matches}`")).cast("long"), item_ids: found})
    return out.withColumn(contaminated, (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words)))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without contaminated rows; all columns as they are."""
    names = tuple(f"__decon_{k}" for k in range(5))
    found = find_contamination(docs, benchmark, text_col, names=names)
    return found.where(~F.col(names[4])).drop(*names)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, w[i + 1:i + 13] AS win FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS k FROM q),
p AS (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k),
hits AS (SELECT p.doc_id, p.i, p.k, q.item_id FROM (SELECT doc_id, i, k, w[i + 1:i + k] AS win FROM p) p JOIN q USING (win)),
cover AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM (SELECT DISTINCT doc_id, i, k FROM hits), (SELECT unnest(range(0, 13)) AS o) WHERE o < k GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""
