"""Scene-level robust numbers, each a one-row DataFrame to be cross-joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdatrace.model import DetectionConfig
from verdatrace.operators.reducers import median

#: Samples below which a population, or an adaptive threshold's, is too small.
MIN_POPULATION, MIN_ADAPTIVE = 32, 64
#: From the median absolute deviation to a standard deviation.
MAD_SCALE = 1.4826


def with_numbers(df: DataFrame, numbers: DataFrame) -> DataFrame:
    """Each row with the columns of a one-row table."""
    return df.crossJoin(F.broadcast(numbers))


def offsets(df: DataFrame, wanted: dict[str, tuple[Column, Column | None, float | None]]) -> DataFrame:
    """Medians of differences over stable populations: one row, a column for each name.

    ``wanted``: name to value, population and threshold.  Populations of less
    than 32 give way to all values; no values give 0.  With a threshold, values
    at or above offset + threshold are left out once and the median taken anew,
    unless less than 32 values or a twentieth remain.
    """
    first = []
    for k, (v, population, _) in wanted.items():
        p = F.lit(True) if population is None else F.coalesce(population, F.lit(False))
        first += [F.count(F.when(p, v)).alias(f"n_{k}"), median(v, p).alias(f"m_{k}"), median(v).alias(f"a_{k}")]
    step = df.agg(*first).select(*((F.col(f"n_{k}") >= MIN_POPULATION).alias(f"own_{k}") for k in wanted), *(F.coalesce(F.when(F.col(f"n_{k}") >= MIN_POPULATION, F.col(f"m_{k}")).otherwise(F.col(f"a_{k}")), F.lit(0.0)).alias(f"o_{k}") for k in wanted))
    second = []
    for k, (v, population, threshold) in wanted.items():
        p = F.lit(True) if population is None else F.coalesce(population, F.lit(False))
        of = F.when(p | ~F.col(f"own_{k}"), v)
        low = F.when(of < F.col(f"o_{k}") + threshold, of) if threshold is not None else F.lit(None).cast("double")
        second += [F.count(of).alias(f"s_{k}"), F.count(low).alias(f"c_{k}"), median(low).alias(f"r_{k}"), F.first(f"o_{k}").alias(f"o_{k}")]
    done = with_numbers(df, step).agg(*second)
    out = []
    for k, (*_, threshold) in wanted.items():
        kept = F.col(f"c_{k}") >= F.greatest(F.lit(float(MIN_POPULATION)), 0.05 * F.col(f"s_{k}"))
        value = F.when(kept, F.col(f"r_{k}")).otherwise(F.col(f"o_{k}")) if threshold is not None else F.col(f"o_{k}")
        out.append(F.coalesce(value, F.lit(0.0)).alias(k))
    return done.select(*out)


def woody_thresholds(df: DataFrame, config: DetectionConfig, valid: Column, ndvi: str, nbr: str, persistent: str) -> DataFrame:
    """The three woody limits: fixed, or quantiles of the scene with floors below them."""
    fixed = {"min_pre_ndvi": (config.min_pre_ndvi, ndvi, config.min_pre_ndvi_absolute), "min_pre_nbr": (config.min_pre_nbr, nbr, -1.0), "min_pre_ndvi_persistent": (config.min_pre_ndvi_persistent, persistent, config.min_pre_ndvi_absolute)}
    q = config.adaptive_woody_quantile
    if q is None:
        return df.sparkSession.range(1).select(*(F.lit(float(x)).alias(k) for k, (x, _, _) in fixed.items()))
    made = df.agg(*(c for k, (_, v, _) in fixed.items() for c in (F.count(F.when(valid, F.col(v))).alias(f"n_{k}"), F.percentile(F.when(valid, F.col(v)), F.lit(q)).alias(f"q_{k}"))))
    return made.select(*(F.when(F.col(f"n_{k}") < MIN_ADAPTIVE, F.lit(float(x))).otherwise(F.greatest(F.lit(floor), F.col(f"q_{k}"))).alias(k) for k, (x, _, floor) in fixed.items()))


def change_thresholds(df: DataFrame, wanted: dict[str, tuple[Column, Column, float, float | None]], floor: float) -> DataFrame:
    """Change limits: fixed, or median + k deviations of the population, at least ``floor`` of the fixed one.

    ``wanted``: name to value, population, fixed limit and k (None: fixed).
    """
    spark, made = df.sparkSession, {k: x for k, x in wanted.items() if x[3] is not None}
    plain = [F.lit(float(x[2])).alias(k) for k, x in wanted.items() if x[3] is None]
    if not made:
        return spark.range(1).select(*plain)
    of = {k: F.when(F.coalesce(p, F.lit(False)), v) for k, (v, p, _, _) in made.items()}
    first = df.agg(*(c for k in made for c in (F.count(of[k]).alias(f"n_{k}"), median(of[k]).alias(f"m_{k}"))))
    second = with_numbers(df, first).agg(*(c for k in made for c in (F.first(f"n_{k}").alias(f"n_{k}"), F.first(f"m_{k}").alias(f"m_{k}"), median(F.abs(of[k] - F.col(f"m_{k}"))).alias(f"d_{k}"))))
    out = [F.when((F.col(f"n_{k}") < MIN_ADAPTIVE) | (F.col(f"d_{k}") <= 0) | F.col(f"d_{k}").isNull(), F.lit(float(x[2]))).otherwise(F.greatest(F.col(f"m_{k}") + x[3] * MAD_SCALE * F.col(f"d_{k}"), F.lit(floor * x[2]))).alias(k) for k, x in made.items()]
    return second.select(*out, *plain)


def z_scores(df: DataFrame, values: list[str], stable: Column) -> DataFrame:
    """``values`` against mean and population deviation of stable rows; missing if fewer than 2 or all alike."""
    s = F.coalesce(stable, F.lit(False))
    numbers = df.agg(*(c for v in values for c in (F.avg(F.when(s, F.col(v))).alias(f"_a_{v}"), F.stddev_pop(F.when(s, F.col(v))).alias(f"_d_{v}"), F.count(F.when(s, F.col(v))).alias(f"_n_{v}"))))
    made = with_numbers(df, numbers)
    score = lambda v: F.when((F.col(f"_n_{v}") >= 2) & (F.col(f"_d_{v}") >= 1e-6), (F.col(v) - F.col(f"_a_{v}")) / F.col(f"_d_{v}")).alias(v)
    return made.select(*(score(c) if c in values else F.col(c) for c in df.columns))


def landscape(obs: DataFrame, reference: DataFrame, value: str, time: str = "acq_date") -> DataFrame:
    """Median of the reference pixels by date; dates without any have 0."""
    known = obs.join(reference.select("row", "col").distinct(), ["row", "col"], "left_semi").groupBy(time).agg(median(F.col(value)).alias("level"))
    return obs.select(time).distinct().join(known, time, "left").select(time, F.coalesce("level", F.lit(0.0)).alias("level"))
