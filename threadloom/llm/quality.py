"""Quality by a sparse ensemble of rules: tree paths over text statistics, lasso weights, compiled into Spark columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Trees, fit_lasso, fit_trees
from .labels import SAMPLE_ROWS, held_out, sample

#: Frequent short words of the languages; a parameter of the statistics.
STOPWORDS = (
    "the of and to a in is that for with was on are as by at be this from it or an not but his he she they we you "
    "de la le les et des en un une du que est pour qui dans par sur au pas plus avec ce der die das und den von zu mit sich "
    "des auf für ist im dem nicht ein eine als auch es el los las por con para del se una su al lo como más"
).split()

STATISTICS = ("words", "word_length", "distinct", "stopwords", "signs", "capitals", "stops", "digits", "line_words", "distinct_lines", "end_stop", "longest_run")


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text as column expressions; a null counts as empty, and every value is defined.

    All are taken over the whole text. Two saturate by definition: stopwords is the share of stop words among the distinct words, a
    hundred of which count at most, as a language has only so many; longest_run counts up to 20.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.split(text, "\n")
    n, chars = F.size(words), F.greatest(F.length(text), F.lit(1))
    some = F.greatest(n, F.lit(1))
    without = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / chars
    stop = F.array(*[F.lit(w) for w in sorted(set(STOPWORDS))])
    distinct = F.size(F.array_distinct(words))
    return {
        "words": F.log1p(n),
        "word_length": F.length(text) / some,
        "distinct": distinct / some,
        "stopwords": F.size(F.array_intersect(words, stop)) / F.greatest(F.least(distinct, F.lit(100)), F.lit(1)),
        "signs": without(r"[#$%&*|!~^<>{}=+\\\[\]]+"),
        "capitals": without("[A-Z]+"),
        "stops": without("[.,;:?]+"),
        "digits": without("[0-9]+"),
        "line_words": F.log1p(n / F.size(lines)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "end_stop": F.when(F.substring(F.rtrim(text), -1, 1) == ".", 1.0).otherwise(0.0),
        "longest_run": F.least(F.coalesce(F.aggregate(words, F.struct(F.lit("").alias("w"), F.lit(0).alias("run"), F.lit(0).alias("top")), lambda a, w: F.struct(w.alias("w"), F.when(a["w"] == w, a["run"] + 1).otherwise(1).alias("run"), F.greatest(a["top"], F.when(a["w"] == w, a["run"] + 1).otherwise(1)).alias("top")), lambda a: a["top"]), F.lit(0)), F.lit(20)).cast("double"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is at least, cut) and its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
        return np.logical_and.reduce([(x[:, names.index(s)] >= c) == up for s, up, c in self.terms])

    def column(self, stats: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a & b, [stats[s] >= F.lit(c) if up else stats[s] < F.lit(c) for s, up, c in self.terms])


def paths(trees: Trees, names: tuple[str, ...]) -> list[Rule]:
    """Every path from a root to an inner node's child or a leaf, as a rule; equal ones once."""
    found: dict[tuple, None] = {}
    for feature, cut in zip(trees.feature, trees.cut, strict=True):

        def walk(node: int, terms: tuple) -> None:
            if terms:
                found.setdefault(tuple(sorted(set(terms))))
            if node < len(feature) and np.isfinite(cut[node]):
                s, c = names[feature[node]], float(cut[node])  # noqa: B023
                walk(2 * node + 1, (*terms, (s, False, c)))
                walk(2 * node + 2, (*terms, (s, True, c)))

        walk(0, ())
    return [Rule(t) for t in found]


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[Rule]

    def column(self, stats: dict[str, Column]) -> Column:
        total = reduce(lambda a, b: a + b, [F.when(r.column(stats), F.lit(r.weight)).otherwise(F.lit(0.0)) for r in self.rules], F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, penalty: float = 0.002, rounds: int = 24, depth: int = 3) -> RuleEnsemble:
    """Fits on sample_rows labelled rows at most (see labels.sample). Without any, or with one class, no rule is left."""
    rows = sample(docs, labels, "quality", sample_rows)
    got = rows.select("doc_id", "label", *[c.alias(k) for k, c in statistics(F.col("text")).items()]).toArrow().sort_by("doc_id")
    x = np.stack([np.array(got[k], float) for k in STATISTICS], 1) if len(got) else np.zeros((0, len(STATISTICS)))
    y = np.array(got["label"], float)
    trees = fit_trees(x, y, rounds=rounds, depth=depth, rate=0.3, bins=24)
    rules = paths(trees, STATISTICS)
    if not rules:
        return RuleEnsemble(trees.base, [])
    on = np.stack([r.holds(x, STATISTICS) for r in rules], 1).astype(float)
    intercept, weights = fit_lasso(on, y, penalty)
    return RuleEnsemble(float(intercept), [Rule(r.terms, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6])


def score_quality(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", name: str = "quality") -> DataFrame:
    """docs and the score, 0 to 1, by column expressions alone; a null scores as an empty text. A column of docs that has the name is replaced."""
    temps = {k: f"__quality_{k}" for k in STATISTICS}
    stats = statistics(F.col(f"`{text_col}`"))
    out = docs.withColumns({temps[k]: stats[k].cast("double") for k in STATISTICS})
    return out.withColumn(name, model.column({k: F.col(t) for k, t in temps.items()})).drop(*temps.values())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality").alias("score"), F.when(F.col("quality") >= 0.3, 1).otherwise(0).alias("predicted"))
