"""Recovery of patches: means, anomalies, seasons, trajectories, re-clearing, classes.

Series are long: one row a patch, track and date.  Per-patch series are short
(a few dozen seasons), so ordered logic runs on sorted arrays of one grouping.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdatrace.model import RegrowthConfig
from verdatrace.operators.reducers import array_median, median
from verdatrace.storage import settle

DAYS_PER_YEAR = 365.25
# Bounds of the time constant in years, and ages at which recovery is read.
TAU_BOUNDS = (0.15, 25.0)
AGES = (1, 2, 5)
KEYS = ("patch_id", "track")


def patch_means(obs: DataFrame, patch_pixels: DataFrame, value: str, patch_ids: DataFrame | None = None, scene: str = "scene_id") -> DataFrame:
    """Mean of the present pixels by patch and acquisition; absent patches have a missing mean on every date."""
    joined = obs.select("row", "col", "acq_date", scene, value).join(patch_pixels.select("row", "col", "patch_id"), ["row", "col"])
    made = joined.groupBy("patch_id", "acq_date", scene).agg(F.avg(value).alias("value"))
    if patch_ids is None:
        return made
    every = patch_ids.select("patch_id").distinct().crossJoin(obs.select("acq_date", scene).distinct())
    return every.join(made, ["patch_id", "acq_date", scene], "left")


def anomaly(series: DataFrame, landscape: DataFrame, time: str = "scene_id") -> DataFrame:
    """Series less the landscape's level on the same acquisition."""
    return series.join(landscape.select(time, F.col("level").alias("_level")), time).withColumn("value", F.col("value") - F.col("_level")).drop("_level")


def seasonalise(series: DataFrame, months: int = 3, min_observations: int = 1, keys=KEYS) -> DataFrame:
    """Medians of the present values in bins of whole months: ``keys, season_date, value, n``.

    Bins count from the month of the first acquisition, present or not; a
    season's date is the 15th of its middle month.
    """
    origin = F.min("acq_date").over(W.partitionBy(*keys))
    count = lambda d: F.year(d) * 12 + F.month(d)
    binned = series.withColumn("_origin", F.trunc(origin, "MM")).where(F.col("value").isNotNull()).withColumn("_bin", F.floor((count(F.col("acq_date")) - count(F.col("_origin"))) / months).cast("int"))
    made = binned.groupBy(*keys, "_origin", "_bin").agg(median(F.col("value")).alias("value"), F.count("*").alias("n")).where(F.col("n") >= min_observations)
    return made.select(*keys, F.date_add(F.add_months("_origin", F.col("_bin") * months + months // 2), 14).alias("season_date"), "value", "n")


def swing(seasons: DataFrame, events: DataFrame, keys=KEYS) -> DataFrame:
    """Median over years with three seasons or more, since the event, of the range within the year."""
    since = seasons.join(events, "patch_id").where((F.col("season_date") >= F.col("event_date")) & F.col("value").isNotNull())
    years = since.groupBy(*keys, F.year("season_date").alias("y")).agg((F.max("value") - F.min("value")).alias("range"), F.count("*").alias("k")).where("k >= 3")
    return years.groupBy(*keys).agg(median(F.col("range")).alias("seasonal_amplitude"))


def deseasonalise(seasons: DataFrame, events: DataFrame, bins_per_year: int = 4, keys=KEYS) -> DataFrame:
    """Series less the mean of each part of the year since the event, around their common mean.

    Only where every part has two values or more; other series stay as they are.
    """
    if bins_per_year <= 1:
        return seasons
    phase = F.floor((F.month("season_date") - 1) * bins_per_year / 12).cast("int")
    dated = seasons.withColumn("_phase", phase)
    since = dated.join(events, "patch_id").where((F.col("season_date") >= F.col("event_date")) & F.col("value").isNotNull())
    parts = since.groupBy(*keys, "_phase").agg(F.avg("value").alias("_mean"), F.count("*").alias("k")).where("k >= 2")
    whole = parts.groupBy(*keys).agg(F.avg("_mean").alias("_grand"), F.count("*").alias("_parts")).where(F.col("_parts") >= bins_per_year)
    level = parts.join(whole, list(keys)).select(*keys, "_phase", (F.col("_grand") - F.col("_mean")).alias("_shift"))
    return dated.join(level, [*keys, "_phase"], "left").withColumn("value", F.col("value") + F.coalesce("_shift", F.lit(0.0))).select(*seasons.columns)


def years_since(seasons: DataFrame, events: DataFrame) -> DataFrame:
    """Present seasons since the event with their age in years."""
    joined = seasons.join(events, "patch_id").where((F.col("season_date") >= F.col("event_date")) & F.col("value").isNotNull())
    return joined.withColumn("years", F.datediff("season_date", "event_date") / DAYS_PER_YEAR)


def trajectories(seasons: DataFrame, events: DataFrame, keys=KEYS) -> DataFrame:
    """One row a series: ``baseline`` (median before the event) and ``post``, the sorted (years, v, d) since."""
    joined = seasons.join(events, "patch_id")
    age = F.datediff("season_date", "event_date") / DAYS_PER_YEAR
    before = F.col("season_date") < F.col("event_date")
    return joined.groupBy(*keys, "event_date").agg(
        median(F.col("value"), before).alias("baseline"),
        F.array_sort(F.collect_list(F.when(~before & F.col("value").isNotNull(), F.struct(age.alias("years"), F.col("value").alias("v"), F.col("season_date").alias("d"))))).alias("post"),
    )


def _v(points: Column) -> Column:
    return F.transform(points, lambda p: p["v"])


def recovery_metrics(of: DataFrame, config: RegrowthConfig | None = None) -> DataFrame:
    """Baseline, trough, current, fractions, ages and recent slope of :func:`trajectories`; missing with too few seasons."""
    c = config or RegrowthConfig()
    enough = F.col("baseline").isNotNull() & (F.col("n_seasons") >= c.min_seasons_post)
    when = lambda x: F.when(enough, x)
    first_year = F.filter("post", lambda p: p["years"] <= 1.0)
    last = F.slice("post", F.greatest(F.size("post") - 1, F.lit(1)), 2)
    out = of.withColumn("n_seasons", F.size("post"))
    out = out.withColumns({"trough": when(F.coalesce(F.array_min(_v(first_year)), F.array_min(_v(F.col("post"))))), "current": when(array_median(_v(last)))})
    span = F.col("baseline") - F.col("trough")
    r80p = F.when(F.col("baseline") > 1e-6, F.col("current") / (c.recovered_fraction * F.col("baseline")))
    oldest = F.try_element_at("post", F.lit(-1))["years"]
    recent = F.filter("post", lambda p: p["years"] >= F.greatest(F.lit(0.0), oldest - c.recent_years))
    slopes = F.flatten(F.transform("_recent", lambda p: F.transform(F.filter("_recent", lambda q: q["years"] > p["years"]), lambda q: (q["v"] - p["v"]) / (q["years"] - p["years"]))))
    out = out.withColumns({"recovery_fraction": F.when(span > 1e-6, (F.col("current") - F.col("trough")) / span), "_r80p": when(r80p), "_recent": F.when(enough & (F.size("post") > 0), recent)})
    out = out.withColumns({"r80p": F.when((F.col("baseline") >= 0.05) & (F.abs("_r80p") <= 20), F.col("_r80p")), "recent_slope_per_year": F.when(F.size("_recent") >= 3, array_median(slopes))})
    for age in AGES:
        a, b = F.coalesce(F.try_element_at(_up_to(age), F.lit(-1)), F.get("post", F.lit(0))), F.get(_from(age), F.lit(0))
        at = F.when(b["years"] > a["years"], a["v"] + (b["v"] - a["v"]) * (F.greatest(F.lit(float(age)), a["years"]) - a["years"]) / (b["years"] - a["years"])).otherwise(a["v"])
        out = out.withColumn(f"recovery_at_{age}yr", F.when(enough & (span > 1e-6) & (F.size("post") > 0) & (oldest >= age), F.round((at - F.col("trough")) / span, 4)))
    return out.drop("_r80p", "_recent")


def _up_to(age: float) -> Column:
    return F.filter("post", lambda p: p["years"] <= age)


def _from(age: float) -> Column:
    return F.filter("post", lambda p: p["years"] >= age)


def fit_grid(metrics: DataFrame, steps: int = 120, keys=KEYS) -> DataFrame:
    """Best saturating exponential over a logarithmic grid of time constants, in SQL aggregates alone.

    For a fixed time constant the curve is linear in ``exp(-t / tau)``, so the
    regression aggregates give asymptote, trough and squared error; candidates
    outside the bounds of the span are left out.
    """
    low, high = TAU_BOUNDS
    taus = metrics.sparkSession.range(steps).select((F.lit(low) * F.pow(F.lit(high / low), F.col("id") / F.lit(steps - 1.0))).alias("tau"))
    points = metrics.where("recovery_fraction IS NOT NULL").select(*keys, "baseline", "trough", F.explode("post").alias("p")).select(*keys, "baseline", "trough", "p.years", "p.v")
    x = F.exp(-F.col("years") / F.col("tau"))
    made = points.crossJoin(F.broadcast(taus)).groupBy(*keys, "baseline", "trough", "tau").agg(F.regr_intercept("v", x).alias("asymptote"), F.regr_slope("v", x).alias("slope"), F.regr_syy("v", x).alias("syy"), F.regr_sxx("v", x).alias("sxx"), F.count("*").alias("k"))
    span = F.col("baseline") - F.col("trough")
    sse = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"))
    inside = made.withColumns({"trough_fit": F.col("asymptote") + F.col("slope"), "sse": sse}).where(F.col("asymptote").between(F.col("trough") - 0.2 * span, F.col("baseline") + 0.6 * span) & F.col("trough_fit").between(F.col("trough") - 0.5 * span, F.col("trough") + 0.5 * span))
    best = inside.groupBy(*keys).agg(F.min_by(F.struct("asymptote", "trough_fit", "tau", F.sqrt(F.col("sse") / F.col("k")).alias("rmse")), F.struct("sse", "tau")).alias("b"))
    return best.select(*keys, "b.asymptote", "b.trough_fit", F.col("b.tau").alias("tau_years"), "b.rmse")


def _solve(x: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[float, np.ndarray]:
    """Least squares of ``y = a (1 - x) + r x`` within a box: squared error and (a, r)."""
    m = np.stack([1 - x, x], 1)
    best = (np.inf, low)
    tries = [np.linalg.lstsq(m, y, rcond=None)[0]]
    for k in (0, 1):  # one of both on a bound
        for edge in (low[k], high[k]):
            other = m[:, 1 - k]
            p = np.empty(2)
            p[k], p[1 - k] = edge, np.clip(other @ (y - m[:, k] * edge) / max(other @ other, 1e-12), low[1 - k], high[1 - k])
            tries.append(p)
    for p in tries:
        if np.all(p >= low - 1e-12) and np.all(p <= high + 1e-12):
            e = float(np.sum((m @ p - y) ** 2))
            if e < best[0]:
                best = (e, p)
    return best


def fit_one(years: np.ndarray, values: np.ndarray, baseline: float, trough: float) -> tuple[float, float, float, float] | None:
    """Asymptote, trough, time constant and rmse within the bounds of the span; None without a span."""
    span = baseline - trough
    if not span > 0:
        return None
    low, high = np.array([trough - 0.2 * span, trough - 0.5 * span]), np.array([baseline + 0.6 * span, trough + 0.5 * span])
    at = lambda t: _solve(np.exp(-years / np.exp(t)), values, low, high)
    grid = np.linspace(*np.log(TAU_BOUNDS), 60)
    errors = [at(t)[0] for t in grid]
    k = int(np.argmin(errors))
    a, b, g = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)], (np.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = at(c)[0], at(d)[0]
    for _ in range(60):  # golden section
        if fc <= fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = at(c)[0]
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = at(d)[0]
    t = min((a, b, (a + b) / 2, grid[k]), key=lambda t: at(t)[0])
    error, p = at(t)
    return float(p[0]), float(p[1]), float(np.exp(t)), float(np.sqrt(error / len(years)))


def fit_curves(metrics: DataFrame, config: RegrowthConfig | None = None) -> DataFrame:
    """Bounded fit of every series, as columns on :func:`recovery_metrics`; Arrow batches, one numeric fit a row."""
    c = config or RegrowthConfig()

    @F.pandas_udf("asymptote double, trough_fit double, tau_years double, rmse double")
    def fitted(years: pd.Series, values: pd.Series, baseline: pd.Series, trough: pd.Series) -> pd.DataFrame:
        rows = []
        for t, v, b, r in zip(years, values, baseline, trough, strict=True):
            done = None if b is None or r is None or not np.isfinite(b) or not np.isfinite(r) else fit_one(np.asarray(t, float), np.asarray(v, float), b, r)
            rows.append(done or (None, None, None, None))
        return pd.DataFrame(rows, columns=["asymptote", "trough_fit", "tau_years", "rmse"], dtype=float)

    made = metrics.withColumn("_fit", fitted(F.transform("post", lambda p: p["years"]), _v(F.col("post")), "baseline", "trough"))
    ok = F.col("_fit.tau_years").isNotNull() & ~F.isnan("_fit.tau_years")
    out = made.select(*metrics.columns, *(F.when(ok, F.col(f"_fit.{k}")).alias(k) for k in ("asymptote", "trough_fit", "tau_years", "rmse")), ok.alias("converged"))
    return derived(out, c)


def derived(fits: DataFrame, config: RegrowthConfig | None = None) -> DataFrame:
    """Half-life, whether the time constant lies at a bound, and years until the recovery target."""
    c = config or RegrowthConfig()
    tau, a, r = F.col("tau_years"), F.col("asymptote"), F.col("trough_fit")
    at_bound = (tau <= TAU_BOUNDS[0] * 1.01) | (tau >= TAU_BOUNDS[1] * 0.99)
    target = F.col("trough") + c.recovered_fraction * (F.col("baseline") - F.col("trough"))
    ratio = F.when(F.abs(r - a) > 1e-6, (target - a) / (r - a))
    return fits.withColumns({"half_life_years": tau * F.lit(float(np.log(2))), "at_bound": F.coalesce(at_bound, F.lit(False)), "years_to_80pct": F.when(~at_bound & (a > target) & (ratio > 0), -tau * F.log(ratio))})


def reclearing(of: DataFrame, amplitude: Column | None = None, config: RegrowthConfig | None = None, keys=KEYS) -> DataFrame:
    """First season that falls below the median of the four before it, and stays down for one more: ``reclear_date``.

    ``of``: :func:`trajectories`.  The site must have risen from its trough
    first, and the drop must exceed its own yearly swing.
    """
    c = config or RegrowthConfig()
    first_year = F.filter("post", lambda p: p["years"] <= 1.0)
    required = F.greatest(F.lit(c.reclear_drop), 0.8 * amplitude) if amplitude is not None else F.lit(c.reclear_drop)
    flat = of.where(F.size("post") >= 6).select(*keys, F.coalesce(F.array_min(_v(first_year)), F.get("post", F.lit(0))["v"]).alias("trough"), required.alias("required"), F.posexplode("post").alias("i", "p"))
    order = W.partitionBy(*keys).orderBy("i")
    level = F.percentile("p.v", F.lit(0.5)).over(order.rowsBetween(-4, -1))
    seen = flat.select(*keys, "i", F.col("p.d").alias("d"), "trough", "required", F.col("p.v").alias("v"), level.alias("level"), F.lead("p.v").over(order).alias("next"))
    hit = (F.col("i") >= 4) & F.col("next").isNotNull() & (F.col("level") - F.col("trough") >= c.min_recovery_for_reclear) & (F.col("level") - F.col("v") >= F.col("required")) & (F.col("level") - F.col("next") >= 0.7 * F.col("required"))
    return seen.where(hit).groupBy(*keys).agg(F.min("d").alias("reclear_date"))


def classify(fraction="recovery_fraction", slope="recent_slope_per_year", amplitude="seasonal_amplitude", reclear="reclear_date", config: RegrowthConfig | None = None) -> Column:
    """Class of a patch; cultivation comes before re-clearing, and both before recovery."""
    c = config or RegrowthConfig()
    f, s = F.col(fraction), F.col(slope)
    return (
        F.when(f.isNull(), "unknown").when(F.col(amplitude) >= c.cultivated_amplitude, "cultivated").when(F.col(reclear).isNotNull(), "recleared").when(f >= c.recovered_fraction, "recovered")
        .when((f < c.stalled_fraction) & (s.isNull() | (s < c.stalled_slope_per_year)), "stalled").otherwise("recovering")
    )


def class_summary(records: DataFrame) -> DataFrame:
    """Patches and area by class; classes without patches are left out."""
    return records.groupBy("classification").agg(F.count("*").alias("patches"), F.round(F.sum("area_ha"), 2).alias("area_ha"))


def flat_records(fits: DataFrame, values: list[str], tracks=("ndvi", "nbr", "vh")) -> DataFrame:
    """One row a patch with columns ``<track>_<value>``."""
    return fits.groupBy("patch_id").pivot("track", list(tracks)).agg(*(F.first(v).alias(v) for v in values)) if len(values) > 1 else fits.groupBy("patch_id").pivot("track", list(tracks)).agg(F.first(values[0])).select("patch_id", *(F.col(t).alias(f"{t}_{values[0]}") for t in tracks))


def early_recovery(fits: DataFrame) -> DataFrame:
    """Mean recovery by track and age over the patches that are old enough."""
    long = fits.select("track", *(F.col(f"recovery_at_{a}yr") for a in AGES)).unpivot("track", [f"recovery_at_{a}yr" for a in AGES], "age", "value")
    return long.where("value IS NOT NULL").groupBy("track", "age").agg(F.avg("value").alias("value"), F.count("*").alias("patches"))


def analyse(series: DataFrame, patches: DataFrame, events: DataFrame, config: RegrowthConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """Fits of every track, and one record a patch with class and re-clearing date.

    ``series``: anomalies ``patch_id, track, acq_date, value``; ``events``:
    ``patch_id, event_date``; ``patches``: ``patch_id, area_ha, tier``.
    """
    c = config or RegrowthConfig()
    raw = settle(seasonalise(series, c.season_months), "seasons")
    moved = deseasonalise(raw, events, max(1, 12 // max(1, c.season_months))) if c.deseasonalise else raw
    # Series are tiny next to the observations behind them; each cut keeps plans short.
    of = settle(trajectories(moved, events).join(swing(raw, events), list(KEYS), "left"), "trajectories")
    fits = settle(fit_curves(recovery_metrics(of, c), c), "fits")
    again = reclearing(of.where(F.col("track") == "nbr"), F.col("seasonal_amplitude"), c).select("patch_id", "reclear_date")
    primary = fits.where(F.col("track") == "nbr").select("patch_id", "event_date", "recovery_fraction", "recent_slope_per_year", "seasonal_amplitude")
    records = patches.select("patch_id", "area_ha", "tier").join(primary, "patch_id", "left").join(again, "patch_id", "left").withColumn("classification", classify(config=c))
    return fits.drop("post"), records
