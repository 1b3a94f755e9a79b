"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Two lexicons give densities: a fixed one of common abuse, and one learnt from the labelled rows, of words and beginnings of words
that toxic rows have far more often than others, whatever their language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Trees, fit_isotonic, fit_trees, sigmoid
from .labels import SAMPLE_ROWS, held_out, sample
from .words import CHUNK_BYTES, Words, buffers, lanes, mix, table, text_of, words_of

#: Words of abuse, and words for the second person; parameters of the features.
LEXICON = (
    "stupid idiot idiots idiotic moron morons moronic trash disgusting pathetic worthless loser losers clown clowns scum dumb fool garbage filth filthy vermin "
    "imbecile cretin jerk scumbag lowlife despicable hateful ugly parasite brainless retarded bastard "
    "imbécile crétin débile ordure salaud pourriture dummkopf vollidiot abschaum trottel widerlich ekelhaft arschloch estúpido imbécil basura asqueroso inútil"
).split()
SECOND_PERSON = "you your yours yourself u ur tu toi vous votre vos ton du dich dir dein deine euch ihr usted tú ti vosotros".split()

_LETTER = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_LETTERS = table(bytes(set(range(256)) - set(_LETTER)), True)
#: Digits and signs that stand for letters count as those; a star stands for any one letter.
_LEET = dict(zip(b"013457@$", b"oieastas", strict=True))


def _leet() -> tuple[np.ndarray, np.ndarray]:
    word, value = table(bytes(set(range(256)) - set(_LETTER) - set(_LEET) - {42}), True)
    for a, b in _LEET.items():
        value[a] = b
    return word, value


_DISGUISED = _leet()

#: Beginnings of words that count as terms, in bytes; terms looked at, those of most toxic rows; what a learnt term must show:
#: toxic rows that have it, times as likely in toxic rows, and the log-likelihood ratio (24: by chance once in a million).
PREFIXES, CANDIDATES, LEAST_ROWS, LEAST_RATIO, LEAST_EVIDENCE = (4, 5, 6, 7, 8), 100_000, 5, 6.0, 24.0

FEATURES = ("learnt", "learnt_rate", "learnt_kinds", "learnt_top", "learnt_mean", "hits", "hit_rate", "distinct", "disguised", "disguised_rate", "near_you", "you_rate", "capitals", "capital_words", "exclaim", "question", "punct", "inner_signs", "digits", "words", "word_length")


def hashed(words: list[str], kind: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    data = " ".join(words).encode()
    return np.unique(words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]), kind, 0, 1).hashes)


def terms(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, hash of a term of each): the whole words, and their beginnings."""
    size, eight = w.to - w.at, lanes(w.data)[w.at]
    out = [(np.arange(len(size)), mix(w.hashes ^ np.uint64(0x5851F42D4C957F2D)))]
    for k in PREFIXES:
        some = np.flatnonzero(size >= k)
        out.append((some, mix((eight[some] & np.uint64((1 << 8 * k) - 1)) + np.uint64(k * 0x2545F4914F6CDD1D & (1 << 64) - 1))))
    return out


@dataclass
class Learnt:
    """Terms in order of their hashes, and the log of how many times likelier each is in toxic rows."""

    hashes: np.ndarray
    weight: np.ndarray

    def best(self, w: Words) -> np.ndarray:
        """For each word the largest weight among its terms, 0 without one."""
        out = np.zeros(len(w.hashes))
        if len(self.hashes):
            for some, h in terms(w):
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = np.flatnonzero(self.hashes[at] == h)
                out[some[hit]] = np.maximum(out[some[hit]], self.weight[at[hit]])
        return out


def _counts(batches: Iterator[pa.RecordBatch], among: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(part, term, n): rows of the part that have the term, for terms among these or all."""
    for batch in batches:
        part, (offsets, data) = np.asarray(batch.column("part")), buffers(batch.column("text"))
        found, first, n = [np.zeros((0, 2), np.uint64)], 0, batch.num_rows
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
            w = words_of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], _LETTERS, first, last)
            text = text_of(w)
            pairs = np.concatenate([np.stack([text[some].astype(np.uint64), h], 1) for some, h in terms(w)])
            if among is not None:
                at = np.minimum(np.searchsorted(among, pairs[:, 1]), len(among) - 1)
                pairs = pairs[among[at] == pairs[:, 1]]
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            pairs = pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(1))[: len(pairs)]]
            pairs[:, 0] = part[first:last][pairs[:, 0].astype(np.int64)]
            found.append(pairs)
            first = last
        every = np.concatenate(found)
        every = every[np.lexsort((every[:, 1], every[:, 0]))]
        new = np.append(True, (every[1:] != every[:-1]).any(1))[: len(every)]
        begin = np.flatnonzero(new)
        columns = [pa.array(every[begin, 0].astype(np.int32)), pa.array(every[begin, 1].view(np.int64)), pa.array(np.diff(np.append(begin, len(every))))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "term", "n"])


def learn_terms(rows: DataFrame) -> tuple[Learnt, dict[int, Learnt]]:
    """The terms that mark the toxic among rows (text, label, part), and for each part those that the other parts give.

    What comes to the driver is bounded: counts of CANDIDATES terms at most, and of the parts' rows.
    """
    size = {(r["part"], r["label"]): r["n"] for r in rows.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = Learnt(np.zeros(0, np.uint64), np.zeros(0))
    parts = sorted({p for p, _ in size})
    if not all(sum(size.get((p, y), 0) for p in parts) for y in (0, 1)):
        return none, dict.fromkeys(parts, none)
    schema = "part int, term long, n long"
    per = [F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).alias(f"p{p}") for p in parts]

    def counted(label: int, among: np.ndarray | None, least: int) -> pa.Table:
        found = rows.where(F.col("label") == label).select("text", "part").mapInArrow(lambda x: _counts(x, among), schema)
        found = found.groupBy("term").agg(F.sum("n").alias("n"), *per).where(F.col("n") >= least)
        return found.orderBy(F.desc("n"), "term").limit(CANDIDATES).toArrow()

    toxic = counted(1, None, LEAST_ROWS)
    hashes = np.asarray(toxic["term"]).astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    hashes = hashes[order]
    if not len(hashes):
        return none, dict.fromkeys(parts, none)
    clean = counted(0, hashes, 1)
    where = np.searchsorted(hashes, np.asarray(clean["term"]).astype(np.int64).view(np.uint64))
    t = np.stack([np.asarray(toxic[f"p{p}"])[order] for p in parts], 1).astype(float)
    n = np.zeros_like(t)
    n[where] = np.stack([np.asarray(clean[f"p{p}"]) for p in parts], 1)

    def chosen(without: int | None) -> Learnt:
        use = [k for k, p in enumerate(parts) if p != without]
        rows_t, rows_n = (sum(size.get((parts[k], y), 0) for k in use) for y in (1, 0))
        if not rows_t or not rows_n:
            return none
        a, b = t[:, use].sum(1), n[:, use].sum(1)
        share = rows_t / (rows_t + rows_n)
        with np.errstate(divide="ignore", invalid="ignore"):
            evidence = 2 * (np.nan_to_num(a * np.log(a / ((a + b) * share))) + np.where(b > 0, b * np.log(b / ((a + b) * (1 - share))), 0))
        weight = np.log(((a + 0.5) / rows_t) / ((b + 0.5) / rows_n))
        good = (a >= LEAST_ROWS) & (a * rows_n >= LEAST_RATIO * (b + 1) * rows_t) & (evidence >= LEAST_EVIDENCE)
        return Learnt(hashes[good], weight[good])

    return chosen(None), {p: chosen(p) for p in parts}


@dataclass
class Lexicon:
    plain: np.ndarray
    disguised: np.ndarray
    you: np.ndarray

    @staticmethod
    def of(words: list[str] = LEXICON, you: list[str] = SECOND_PERSON) -> Lexicon:
        starred = [w[:i] + "*" + w[i + 1 :] for w in words if len(w) > 3 and w.isascii() for i in range(1, len(w) - 1)]
        return Lexicon(hashed(list(words), _LETTERS), hashed([*words, *starred], _DISGUISED), hashed(list(you), _LETTERS))


def _chunk(data: np.ndarray, offsets: np.ndarray, lex: Lexicon, learnt: Learnt, near: int) -> np.ndarray:
    n = len(offsets) - 1
    per = lambda mask: np.diff(np.append(0, np.cumsum(mask))[offsets]).astype(float)
    w = words_of(data, offsets, _LETTERS, 0, n)
    text = text_of(w)
    words = np.diff(w.bounds).astype(float)
    some = np.maximum(words, 1)
    best = learnt.best(w)
    marked = np.flatnonzero(best > 0)
    hit = np.flatnonzero(np.isin(w.hashes, lex.plain))
    you = np.flatnonzero(np.isin(w.hashes, lex.you))
    count = lambda at, t=text: np.bincount(t[at], minlength=n).astype(float)
    hits, learned = count(hit), count(marked)

    def kinds(at: np.ndarray) -> np.ndarray:
        pairs = np.unique(np.stack([text[at].astype(np.uint64), w.hashes[at]], 1), axis=0)
        return np.bincount(pairs[:, 0].astype(np.int64), minlength=n).astype(float)

    top, total = np.zeros(n), np.bincount(text[marked], best[marked], n)
    np.maximum.at(top, text[marked], best[marked])
    distinct = kinds(hit)
    d = words_of(data, offsets, _DISGUISED, 0, n)
    disguised = np.maximum(count(np.isin(d.hashes, lex.disguised), text_of(d)) - hits, 0)
    hit = np.union1d(hit, marked)
    if len(hit) and len(you):
        k = np.searchsorted(you, hit)
        before, after = you[np.maximum(k - 1, 0)], you[np.minimum(k, len(you) - 1)]
        close = lambda other: (np.abs(other - hit) <= near) & (text[other] == text[hit])
        near_you = count(hit[close(before) | close(after)])
    else:
        near_you = np.zeros(n)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    letter = upper | lower | (data >= 128)
    alphabetic = np.maximum(per(upper | lower), 1)
    sign = (data > 32) & ~letter & ~((data >= 48) & (data <= 57))
    inner = np.zeros(len(data), bool)
    inner[1:-1] = letter[:-2] & (sign[1:-1] & (data[1:-1] != 39) & (data[1:-1] != 45)) & letter[2:]
    caps = per(upper)
    pairs_up = np.zeros(len(data), bool)
    pairs_up[1:] = upper[1:] & upper[:-1]
    # neighbours in another text don't count
    some_text = np.diff(offsets) > 0
    begin, end = offsets[:-1][some_text], offsets[1:][some_text] - 1
    inner[begin] = inner[end] = pairs_up[begin] = False
    return np.stack([
        np.log1p(learned), learned / some, np.log1p(kinds(marked)), top, total / np.maximum(learned, 1),
        np.log1p(hits), hits / some, np.log1p(distinct), np.log1p(disguised), disguised / some, np.log1p(near_you), count(you) / some, caps / alphabetic,
        per(pairs_up) / alphabetic, per(data == 33) / size, per(data == 63) / size, per(sign) / size, per(inner) / some, per((data >= 48) & (data <= 57)) / size, np.log1p(words), per(letter) / some,
    ], 1)


NOTHING_LEARNT = Learnt(np.zeros(0, np.uint64), np.zeros(0))


def features(texts: pa.Array, lex: Lexicon, learnt: Learnt = NOTHING_LEARNT, near: int = 5) -> np.ndarray:
    """A row of FEATURES for each text; a null counts as empty."""
    offsets, data = buffers(texts)
    out, first, n = [np.zeros((0, len(FEATURES)))], 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        out.append(_chunk(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], lex, learnt, near))
        first = last
    return np.concatenate(out)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    learnt: Learnt
    trees: Trees
    knots: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(x)
        return np.interp(raw, self.knots, self.values) if len(self.knots) else sigmoid(raw)

    def column(self, text: Column) -> Column:
        """The score of a text: 0 to 1, a null as an empty text."""
        model = self

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            return pa.array(model.score(features(texts, model.lexicon, model.learnt)))

        return score(text)


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, lexicon: Lexicon | None = None) -> ToxicityModel:
    """Fits on sample_rows labelled rows at most (see labels.sample); one part of these calibrates, the rest grows the trees.

    The terms of the learnt lexicon are cross-fitted: trees and calibration see a row by the terms that the other parts of the rows gave, so
    they don't trust terms more than rows not learnt from bear out. Texts are scored with the terms of all parts.
    Without labelled rows, or with one class, the score is the same for every text.
    """
    lexicon = lexicon or Lexicon.of()
    rows = sample(docs, labels, "toxic", sample_rows)
    learnt, by_part = learn_terms(rows)

    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array, parts: pa.Array) -> pa.Array:
        part, x = np.asarray(parts), np.zeros((len(texts), len(FEATURES)))
        for p in np.unique(part):
            x[part == p] = features(texts.filter(pa.array(part == p)), lexicon, by_part.get(int(p), NOTHING_LEARNT))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))

    got = rows.select("doc_id", "label", "part", measured(F.col("text"), F.col("part")).alias("x")).toArrow().sort_by("doc_id")
    x = np.array(got["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y, part = np.array(got["label"], float), np.array(got["part"])
    grow = part != 1
    trees = fit_trees(x[grow], y[grow])
    knots, values = fit_isotonic(trees.raw(x[~grow]), y[~grow]) if len(y[~grow]) else (np.zeros(0), np.zeros(0))
    return ToxicityModel(lexicon, learnt, trees, knots, values)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """docs and the score; no row moves. A column of docs that has the name is replaced."""
    return docs.withColumn(name, model.column(F.col(f"`{text_col}`").cast("string")))


def remove_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs that score below the threshold; all columns as they are."""
    return score_toxicity(docs, model, text_col, "__toxicity").where(F.col("__toxicity") < threshold).drop("__toxicity")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))
