"""Quality, grouping, association and status of metrics over observations."""

from __future__ import annotations

import math
from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Steps

# Sample sizes at which a test is exact or asymptotic, and thresholds of a finding.
EXACT_MOST, ASYMPTOTIC_LEAST, P_FLOOR = 8, 20, 1e-300
PROMISING_RHO, PROMISING_P, REDUNDANT_RHO = 0.3, 0.05, 0.9


def long_metrics(frame: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """A row (keys, metric_name, raw) for each observation and metric; values as they were given, as text."""
    return frame.select(*keys, *[F.col(m).cast("string").alias(m) for m in metrics]).unpivot(keys, metrics, "metric_name", "raw")


def census_columns(raw: Column) -> dict[str, Column]:
    """Counts that split a column of given values: missing, not a number, either infinity, finite."""
    x = raw.try_cast("double")
    missing, bad = raw.isNull() | x.eqNullSafe(float("nan")), raw.isNotNull() & x.isNull()
    up, down = x == float("inf"), x == float("-inf")
    finite = x.isNotNull() & ~F.isnan(x) & ~up & ~down
    return {"raw_missing_count": F.count_if(missing), "invalid_nonnumeric_count": F.count_if(bad), "positive_infinity_count": F.count_if(up), "negative_infinity_count": F.count_if(down), "finite_count": F.count_if(finite)}


def finite(raw: Column) -> Column:
    """The value, or null unless it is a finite number."""
    x = raw.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def quality(long: DataFrame, by: tuple[str, ...] = ("metric_name",)) -> DataFrame:
    """Census, mean and population variance of each metric."""
    v = finite(F.col("raw"))
    return long.groupBy(*by).agg(F.count(F.lit(1)).alias("sample_size"), *[c.alias(k) for k, c in census_columns(F.col("raw")).items()], F.avg(v).alias("mean"), F.var_pop(v).alias("variance"))


def group_diagnostics(long: DataFrame, group: str, minimum: int = 3) -> DataFrame:
    """Per metric: groups with a name, those of `minimum` finite values or more, and the spread of their means (null below two of these)."""
    named = F.col(group).isNotNull() & (F.trim(F.col(group)) != "")
    excluded = long.groupBy("metric_name").agg(F.count_if(~F.coalesce(named, F.lit(False))).alias("excluded_group_count"))
    means = quality(long.where(named), ("metric_name", group))
    ok = F.when(F.col("finite_count") >= minimum, F.col("mean"))
    out = means.groupBy("metric_name").agg(F.count(F.lit(1)).alias("group_count"), F.count(ok).alias("adequate_group_count"), (F.max(ok) - F.min(ok)).alias("spread"))
    out = excluded.join(out, "metric_name", "left").fillna(0, ["group_count", "adequate_group_count"])
    enough = F.col("adequate_group_count") >= 2
    return out.select("metric_name", "excluded_group_count", "group_count", "adequate_group_count", F.when(enough, F.col("spread")).alias("spread"), F.when(enough, "descriptive_comparison").otherwise("insufficient_groups").alias("status"))


def adapt_ratio(numerator: Column, denominator: Column) -> tuple[Column, Column]:
    """(value, reason): null and zero_denominator without a denominator."""
    return F.when(denominator != 0, numerator / denominator), F.when(denominator == 0, "zero_denominator").otherwise("observed")


def adapt_coverage(covered: Column, partial: Column, total: Column) -> tuple[Column, Column]:
    return adapt_ratio(covered + 0.5 * partial, total)


def adapter_violations(frame: DataFrame, fields: list[str], keys: list[str], at_most: tuple[str, str] | None = None) -> DataFrame:
    """(keys, field, problem) for count fields that aren't whole, finite and non-negative, and for a part larger than its whole."""
    long = long_metrics(frame, keys, fields)
    x = finite(F.col("raw"))
    problem = F.when(x.isNull(), "not_finite").when((x < 0) | (x % 1 != 0), "not_a_count")
    out = long.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(*keys, F.col("metric_name").alias("field"), "problem")
    if at_most:
        part, whole = at_most
        out = out.unionByName(frame.where(F.col(part) > F.col(whole)).select(*keys, F.lit(part).alias("field"), F.lit("exceeds_" + whole).alias("problem")))
    return out


def average_ranks(rows: DataFrame, value: str, by: list[str], name: str, steps: Steps | None = None) -> DataFrame:
    """Ranks within by, ties sharing the average.

    Values are counted, the counts dealt out by ranges of (by, value), and added up within each range and over the ranges before it, so that
    the values of one group, however many, are ranked by many tasks.
    """
    steps = steps or Steps(rows.sparkSession, "ranks")
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")).repartitionByRange(*by, value)
    counts = steps.cut(counts.withColumn("__range", F.spark_partition_id()))
    sums = counts.groupBy(*by, "__range").agg(F.sum("__n").alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    upto = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("__upto", F.sum("__n").over(upto)).join(sums, [*by, "__range"])
    rank = F.col("__before") + F.col("__upto") - (F.col("__n") - 1) / 2
    return rows.join(ranked.select(*by, value, rank.alias(name)), [*by, value])


def spearman(pairs: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Rank correlation of finite pairs within by: n and rho (null below three pairs or without variance)."""
    ok = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    steps = Steps(pairs.sparkSession, "ranks")
    ranked = average_ranks(average_ranks(ok, x, by, "rx", steps), y, by, "ry", steps)
    out = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("rx", "ry").alias("both"), F.var_pop("rx").alias("vx"), F.var_pop("ry").alias("vy"))
    return out.select(*by, "n", F.when((F.col("vx") > 0) & (F.col("vy") > 0) & (F.col("n") >= 3), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("both") / F.sqrt(F.col("vx") * F.col("vy"))))).alias("rho"))


def fisher_interval(rho: Column, n: Column) -> tuple[Column, Column]:
    """Approximate 95 % interval."""
    z = F.atanh(F.greatest(F.least(rho, F.lit(0.999999)), F.lit(-0.999999)))
    margin = 1.96 / F.sqrt(n - 3)
    return F.tanh(z - margin), F.tanh(z + margin)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def student_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's distribution."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def permutation_p(x: np.ndarray, y: np.ndarray) -> float:
    """Share of all orders of y whose rank correlation is as far from 0."""
    rx, ry = (pd.Series(v).rank().to_numpy() for v in (x, y))
    rx, ry = rx - rx.mean(), ry - ry.mean()
    seen = abs(float(rx @ ry))
    every = np.array(list(permutations(ry)))
    scale = float(np.linalg.norm(rx) * np.linalg.norm(ry))
    return float(np.mean(np.abs(every @ rx) / scale >= seen / scale - 1e-12))


def associations(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Spearman's rho with its p: exact over all orders up to 8 pairs, none up to 19, asymptotic beyond (with an interval).

    Only groups of 8 pairs or fewer have their values collected, so what a task holds is bounded.
    """
    base = spearman(pairs, by)
    small = base.where(F.col("n") <= EXACT_MOST).where(F.col("rho").isNotNull()).select(*by)
    values = pairs.where("x IS NOT NULL AND y IS NOT NULL").join(small, by, "left_semi").groupBy(*by).agg(F.collect_list(F.struct("x", "y")).alias("v"))

    @F.pandas_udf("double")
    def exact(v: pd.Series) -> pd.Series:
        return v.map(lambda rows: permutation_p(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])))

    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else student_two_sided(float(a), float(b)) for a, b in zip(t, df, strict=True)])

    exacts = values.select(*by, exact("v").alias("exact_p"))
    rho, n = F.col("rho"), F.col("n")
    t = rho * F.sqrt((n - 2) / F.greatest(1 - rho * rho, F.lit(1e-300)))
    out = base.join(exacts, by, "left").withColumn("tail_p", tail(F.when(n >= ASYMPTOTIC_LEAST, t), F.when(n >= ASYMPTOTIC_LEAST, n - 2)))
    p = F.when(n <= EXACT_MOST, F.col("exact_p")).when(n >= ASYMPTOTIC_LEAST, F.greatest("tail_p", F.lit(P_FLOOR)))
    low, high = fisher_interval(rho, n)
    method = F.when(rho.isNull(), "unavailable").when(n <= EXACT_MOST, "exact_two_sided_permutation_spearman").when(n < ASYMPTOTIC_LEAST, "descriptive_only_small_sample").otherwise("asymptotic_spearman")
    wide = n >= ASYMPTOTIC_LEAST
    return out.select(*by, "n", "rho", p.alias("raw_p"), method.alias("inference_method"), F.when(wide, low).alias("low"), F.when(wide, high).alias("high"))


def holm(tests: DataFrame, order: list[str], p: str = "raw_p", by: list[str] | None = None) -> DataFrame:
    """adjusted_p by the step-down rule over the whole family, which counts tests without a p too. The family is a set of metrics, not of rows of data."""
    by = by or []
    ranked = Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last(), *order)
    upto = ranked.rowsBetween(Window.unboundedPreceding, 0)
    m = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rows = tests.withColumn("__step", (m - F.row_number().over(ranked) + 1) * F.col(p))
    return rows.withColumn("adjusted_p", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("__step").over(upto)))).drop("__step")


def redundancy(long: DataFrame, keys: list[str], minimum: int = 5) -> DataFrame:
    """Every two metrics: rho of their common finite observations, and whether it reaches the threshold."""
    v = long.select(*keys, "metric_name", finite(F.col("raw")).alias("v"))
    pairs = v.select(*keys, F.col("metric_name").alias("metric_a"), F.col("v").alias("x")).join(v.select(*keys, F.col("metric_name").alias("metric_b"), F.col("v").alias("y")), keys).where("metric_a < metric_b")
    out = spearman(pairs, ["metric_a", "metric_b"])
    reason = F.when(F.col("n") < minimum, "insufficient_paired_sample").when(F.col("rho").isNull(), "zero_variance_metric").when(F.abs("rho") >= REDUNDANT_RHO, "absolute_spearman_at_or_above_threshold").otherwise("absolute_spearman_below_threshold")
    return out.select("metric_a", "metric_b", F.col("n").alias("paired_sample_size"), F.when(F.col("n") >= minimum, F.col("rho")).alias("rho"), reason.alias("reason"))


def key_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(side, n): keys of one side that the other lacks."""
    only = lambda a, b, s: a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("side"), "n")
    return only(left, right, "left_only").unionByName(only(right, left, "right_only"))


def metric_status(long: DataFrame, tests: DataFrame, minimum: int = 5) -> DataFrame:
    """Rejected (bad values, too few, or no variance), Promising (an association that holds after adjustment) or Candidate, for each metric."""
    good = (F.abs("rho") >= PROMISING_RHO) & (F.col("adjusted_p") <= PROMISING_P) & F.col("inference_method").isin("exact_two_sided_permutation_spearman", "asymptotic_spearman")
    promising = tests.groupBy("metric_name").agg(F.coalesce(F.bool_or(good), F.lit(False)).alias("promising"))
    bad = (F.col("invalid_nonnumeric_count") + F.col("positive_infinity_count") + F.col("negative_infinity_count") > 0) | (F.col("finite_count") < minimum) | (F.col("variance") == 0)
    return quality(long).join(promising, "metric_name", "left").withColumn("status", F.when(bad, "Rejected").when(F.coalesce("promising", F.lit(False)), "Promising").otherwise("Candidate")).drop("promising")


def _one_row_a_key(frame: DataFrame, keys: list[str], name: str) -> None:
    lost = F.count_if(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]))
    per = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    repeated = per.where("n > 1").limit(1).count()
    if repeated or frame.agg(lost).first()[0]:
        raise ValueError(f"{name}: observation keys must be given and unique")


def validate_metrics(frame: DataFrame, outcomes: DataFrame | None, keys: list[str], metric_columns: list[str], outcome_columns: list[str], minimum: int = 5, synthetic: bool = True) -> tuple[DataFrame, DataFrame]:
    """(statuses, tests): a row for each metric with its census, status and reasons; a row for each metric and outcome with rho, raw and adjusted p.

    Metrics and outcomes meet by keys, which must be unique and the same on both sides, else ValueError. All tests of metrics on outcomes are one
    family, in which p is adjusted step by step. Without outcomes no metric is promising.
    """
    if minimum < 3:
        raise ValueError("minimum must be 3 or more")
    _one_row_a_key(frame, keys, "metrics")
    long = long_metrics(frame, keys, metric_columns)
    tests = "metric_name string, outcome_name string, n long, rho double, raw_p double, inference_method string, low double, high double, adjusted_p double"
    if outcomes is None or not outcome_columns:
        tests = frame.sparkSession.createDataFrame([], tests)
    else:
        _one_row_a_key(outcomes, keys, "outcomes")
        apart = {r["side"]: r["n"] for r in key_differences(frame, outcomes, keys).collect()}
        if any(apart.values()):
            raise ValueError(f"keys differ: {apart['left_only']} of metrics only, {apart['right_only']} of outcomes only")
        side = lambda rows, name, v: rows.select(*keys, F.col("metric_name").alias(name), finite(F.col("raw")).alias(v))
        pairs = side(long, "metric_name", "x").join(side(long_metrics(outcomes, keys, outcome_columns), "outcome_name", "y"), keys)
        every = frame.sparkSession.createDataFrame([(m, o) for m in metric_columns for o in outcome_columns], "metric_name string, outcome_name string")
        found = every.join(associations(pairs, ["metric_name", "outcome_name"]), ["metric_name", "outcome_name"], "left")
        enough = F.coalesce(F.col("n") >= minimum, F.lit(False))
        found = found.withColumns({c: F.when(enough, F.col(c)) for c in ("rho", "raw_p", "low", "high")} | {"n": F.coalesce("n", F.lit(0)), "inference_method": F.when(enough, F.col("inference_method")).otherwise("unavailable")})
        tests = holm(found, ["metric_name", "outcome_name"])
    rows = metric_status(long, tests, minimum)
    bad = lambda c: F.col(c) > 0
    reasons = [
        (F.col("raw_missing_count") == F.col("sample_size"), "all_missing"), (bad("invalid_nonnumeric_count"), "invalid_nonnumeric_values"), (bad("positive_infinity_count") | bad("negative_infinity_count"), "infinite_values"),
        (F.col("finite_count") < minimum, "insufficient_sample"), (F.col("variance") == 0, "zero_variance"), (F.lit(outcomes is None), "no_outcome_frame"), (F.lit(outcomes is not None and not outcome_columns), "no_outcome_columns"),
        (F.col("status") == "Promising", "synthetic_association_only" if synthetic else "association_observed"),
    ]
    return rows.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in reasons]))), tests
