"""Clusters of messages by weighted character n-grams."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ngrams
from ..storage import Steps

#: Cells that n-grams are hashed to for clustering; a fixed width keeps centres bounded whatever the vocabulary.
CELLS = 1 << 12

#: Terms of a dictionary that every task holds, the most frequent ones; rarer ones are joined.
DICTIONARY = 1 << 20


def char_ngrams(norm: str = "norm", low: int = 2, high: int = 4):
    """All n-grams of a text's characters, low to high long."""
    n = F.char_length(norm)
    one = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substr(norm, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[one(k) for k in range(low, high + 1)])


def tfidf(messages: DataFrame, low: int = 2, high: int = 4) -> DataFrame:
    """(message_id, term, weight): logarithmic counts by smoothed rarity, each message's to length 1."""
    terms = messages.select("message_id", F.explode(char_ngrams("norm", low, high)).alias("term")).groupBy("message_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = messages.agg(F.count(F.lit(1)).alias("n"))
    w = terms.join(df, "term").crossJoin(F.broadcast(total)).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = w.groupBy("message_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return w.join(length, "message_id").select("message_id", "term", (F.col("w") / F.col("length")).alias("weight"))


def _dictionary(vocabulary: DataFrame, n: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], bool]:
    """Terms of the highest frequencies, by powers of two, with their rarity in n messages; whether all terms of several messages are there."""
    bits = F.length(F.bin("df"))
    sizes = dict(vocabulary.groupBy(bits.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
    least, total = 65, 0
    while least > 2 and (total := total + sizes.get(least - 1, 0)) <= DICTIONARY:
        least -= 1
    found = vocabulary.where(bits >= least).toArrow()
    terms, df = found["term"].to_pylist(), found["df"].to_numpy()
    chars = np.frombuffer("".join(sorted(set().union(*terms))).encode("utf-32-le"), np.uint32)
    whole = least == 2
    if len(chars) > ngrams.DICTIONARY_CHARS:
        chars, whole = chars[: ngrams.DICTIONARY_CHARS], False
        keep = [max(map(ord, t)) <= chars[-1] for t in terms]
        terms, df = [t for t, k in zip(terms, keep) if k], df[keep]
    keys = ngrams.keys_of(terms, chars)
    order = np.argsort(keys)
    above = np.array([(1 << 64) - 1], np.uint64)
    return (chars, np.concatenate([keys[order], above]), np.append(np.log((1 + n) / (1 + df[order])) + 1, 0.0)), whole


def tfidf_totals(messages: DataFrame, low: int = 2, high: int = 4) -> DataFrame:
    """(message_id, terms, weight_sum): of each message that has terms, how many, and the sum of the weights that tfidf() gives.

    A message's terms are counted where its text is and weighed by a dictionary of the most frequent ones. What the dictionary lacks occurs in one message,
    or else, where the dictionary is full, is joined with its frequency; so are the terms of messages in several rows and of texts over ngrams.CHUNK characters.
    """
    steps = Steps(messages.sparkSession, "tfidf")
    rows = steps.cut(messages.select("message_id", "norm", F.count(F.lit(1)).over(Window.partitionBy("message_id")).alias("rows")))
    n = rows.count()
    some = rows.where("norm is not null")
    alone = F.col("rows") == 1
    short = F.char_length("norm") <= ngrams.CHUNK
    single, several = some.where(alone & short).select("message_id", "norm"), some.where(~(alone & short)).select("message_id", "norm")
    counted = several.mapInArrow(lambda x: ngrams.pairs(x, low, high), "message_id string, term string, tf long").groupBy("message_id", "term").agg(F.sum("tf").alias("tf"))
    counted = steps.cut(counted.where("tf > 0"))
    df = single.mapInArrow(lambda x: ngrams.frequencies(x, low, high), "term string, df long").unionByName(counted.select("term", F.lit(1).cast("long").alias("df")))
    vocabulary = steps.cut(df.groupBy("term").agg(F.sum("df").alias("df")))
    dictionary, whole = _dictionary(vocabulary, n)
    held = messages.sparkSession.sparkContext.broadcast(dictionary)
    absent = math.log((1 + n) / 2) + 1 if whole else None
    known = single.mapInArrow(lambda x: ngrams.weigh(x, low, high, held.value, absent), "message_id string, term string, tf long, terms long, total double, squares double")
    rest = counted
    if not whole:
        known = steps.cut(known)
        rest = rest.unionByName(known.where("term is not null").select("message_id", "term", "tf"))
        known = known.where("term is null")
    w = (1 + F.log("tf")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)
    rest = rest.join(vocabulary, "term").select("message_id", F.lit(1).cast("long").alias("terms"), w.alias("total"), (w * w).alias("squares"))
    sums = known.select("message_id", "terms", "total", "squares").unionByName(rest).groupBy("message_id").agg(*[F.sum(c).alias(c) for c in ("terms", "total", "squares")])
    return sums.select("message_id", "terms", (F.col("total") / F.sqrt("squares")).alias("weight_sum"))


def cluster_count(messages: DataFrame, most: int = 8) -> int:
    """The root of half the messages, rounded half to even, between 1 and `most`, and no more than there are distinct texts."""
    n, distinct = messages.agg(F.count(F.lit(1)), F.count_distinct(F.sha2("norm", 256))).first()
    return min(most, max(1, round(math.sqrt(n / 2))), distinct) if n else 0


def discover(messages: DataFrame, k: int, seed: int = 0, rounds: int = 10) -> DataFrame:
    """(message_id, cluster_id, distance, similarity): K-means over the weights, the best of `rounds` starts; clusters are named in order of their least message id."""
    steps = Steps(messages.sparkSession, "clusters")
    cells = tfidf(messages).select("message_id", F.pmod(F.xxhash64("term"), F.lit(CELLS)).cast("int").alias("cell"), "weight").groupBy("message_id", "cell").agg(F.sum("weight").alias("w"))

    @F.udf(VectorUDT())
    def vector(pairs: list) -> SparseVector:
        return Vectors.sparse(CELLS, sorted((p["cell"], p["w"]) for p in pairs))

    rows = steps.cut(cells.groupBy("message_id").agg(F.collect_list(F.struct("cell", "w")).alias("p")))
    rows = rows.select("message_id", vector("p").alias("features")).persist()
    best = min((KMeans(k=k, seed=seed + i, featuresCol="features").fit(rows) for i in range(rounds)), key=lambda m: m.summary.trainingCost)
    centers = messages.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(best.clusterCenters())], "prediction int, center array<double>")
    out = best.transform(rows).withColumn("v", vector_to_array("features")).join(F.broadcast(centers), "prediction")
    dots = F.aggregate(F.zip_with("v", "center", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm2 = lambda c: F.aggregate(F.transform(c, lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    out = out.select("message_id", "prediction", F.sqrt(F.greatest(norm2(F.col("v")) + norm2(F.col("center")) - 2 * dots, F.lit(0.0))).alias("distance"), (dots / F.sqrt(norm2(F.col("center")))).alias("similarity"))
    out = steps.cut(out)
    rows.unpersist()
    names = out.groupBy("prediction").agg(F.min("message_id").alias("first")).withColumn("n", F.row_number().over(Window.orderBy("first")))
    return out.join(F.broadcast(names), "prediction").select("message_id", F.format_string("cluster_%02d", "n").alias("cluster_id"), "distance", "similarity")


def describe(clusters: DataFrame, messages: DataFrame, terms: DataFrame) -> DataFrame:
    """Per cluster: messages, communities, three representatives by distance, eight top terms by mean weight, confidence."""
    near = Window.partitionBy("cluster_id").orderBy("distance", "message_id")
    reps = clusters.withColumn("r", F.row_number().over(near)).where("r <= 3").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("r", "message_id"))).alias("x"))
    weights = terms.join(clusters.select("message_id", "cluster_id"), "message_id").groupBy("cluster_id", "term").agg(F.sum("weight").alias("w"))
    strong = Window.partitionBy("cluster_id").orderBy(F.desc("w"), "term")
    top = weights.withColumn("r", F.row_number().over(strong)).where("r <= 8").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("r", "term"))).alias("y"))
    base = clusters.join(messages.select("message_id", "community_id"), "message_id").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("message_count"), F.count_distinct("community_id").alias("communities"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("similarity"))), 6).alias("confidence"))
    return base.join(reps, "cluster_id").join(top, "cluster_id").select("cluster_id", "message_count", "communities", "confidence", F.transform("x", lambda v: v["message_id"]).alias("representative_message_ids"), F.transform("y", lambda v: v["term"]).alias("top_terms"))
