"""Neighbourhood operators: boxcar mean, morphology, components, sieve, block means, outlines.

A mask is a table of its pixels ``row, col``; what is not in it is False.
Components work on runs of pixels, not on pixels: a row's pixels are islands by
``col - row_number()``, and runs of adjacent rows touch where their columns
overlap.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdatrace.functions.indices import db_to_linear, linear_to_db
from verdatrace.model import Grid
from verdatrace.storage import settle

#: Runs up to which one task labels them; counted first. Beyond, distributed stars do.
LOCAL_RUNS = 1_000_000


def boxcar(pixels: DataFrame, values: list[str], window: int, grid: Grid | None = None) -> DataFrame:
    """Mean of the present values in a square window; the edge pixels are repeated outwards.

    The edges are those of ``grid``, whether or not there are pixels, and pixels
    outside are left out; without a grid, those of the pixels.  Separable: sums
    and counts along columns, then along rows.
    """
    if window <= 1:
        return pixels
    low, high = window // 2, window - 1 - window // 2
    if grid is None:
        edges = pixels.agg(*(f(c).alias(f"_{n}_{c}") for c in ("row", "col") for n, f in (("lo", F.min), ("hi", F.max))))
        wide = pixels.crossJoin(F.broadcast(edges))
    else:
        wide = pixels.withColumns({"_lo_row": F.lit(0), "_hi_row": F.lit(grid.height - 1), "_lo_col": F.lit(0), "_hi_col": F.lit(grid.width - 1)})
    inside = F.col("row").between(F.col("_lo_row"), F.col("_hi_row")) & F.col("col").between(F.col("_lo_col"), F.col("_hi_col"))
    wide = wide.where(inside)
    for c in ("row", "col"):
        before = F.when(F.col(c) == F.col(f"_lo_{c}"), F.sequence(F.col(c) - low, F.col(c) - 1)).otherwise(F.array().cast("array<int>")) if low else F.array().cast("array<int>")
        after = F.when(F.col(c) == F.col(f"_hi_{c}"), F.sequence(F.col(c) + 1, F.col(c) + high)).otherwise(F.array().cast("array<int>")) if high else F.array().cast("array<int>")
        wide = wide.withColumn(c, F.explode(F.concat(before, F.array(F.col(c)), after)))
    # A place without a pixel has a column's sum as well: such places get empty rows, wherever a pixel of their row looks.
    order, c = W.partitionBy("row").orderBy("col"), F.col("col")
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    wide = wide.withColumns({"_left": F.greatest(c - low, F.lag("col").over(order) + (high + 1)), "_right": F.least(c + high, F.lead("col").over(order) - 1)})
    wide = wide.withColumn("_at", F.explode(F.concat(span(F.col("_left"), c - 1), F.array(c), span(c + 1, F.col("_right"))))).withColumn("_own", F.col("_at") == c)
    wide = wide.withColumns({"col": F.col("_at"), **{v: F.when(F.col("_own"), F.col(v)) for v in values}}).drop("_left", "_right", "_at")
    down, along = W.partitionBy("col").orderBy("row").rangeBetween(-low, high), order.rangeBetween(-low, high)
    summed = wide.select("*", *(F.sum(v).over(down).alias(f"_s_{v}") for v in values), *(F.count(v).over(down).alias(f"_n_{v}") for v in values))
    meant = summed.select("*", *((F.sum(f"_s_{v}").over(along) / F.nullif(F.sum(f"_n_{v}").over(along), F.lit(0))).alias(f"_b_{v}") for v in values))
    return meant.where(inside & F.col("_own")).select(*((F.col(f"_b_{c}").alias(c) if c in values else F.col(c)) for c in pixels.columns))


def _cross(mask: DataFrame) -> DataFrame:
    """Each pixel and its four neighbours, one row for each pixel that says so."""
    offsets = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))))
    return mask.select("row", "col", F.explode(offsets).alias("o")).select((F.col("row") + F.col("o.y")).alias("row"), (F.col("col") + F.col("o.x")).alias("col"))


def opening(mask: DataFrame, iterations: int = 1) -> DataFrame:
    """Erosion, then dilation, by the four-neighbour cross; outside counts as False."""
    out = mask.select("row", "col").distinct()
    for _ in range(iterations):
        out = _cross(out).groupBy("row", "col").count().where("count = 5").drop("count")
    for _ in range(iterations):
        out = _cross(out).distinct()
    return out


def runs(mask: DataFrame) -> DataFrame:
    """Maximal runs of pixels along rows: ``row, first, last``."""
    order = W.partitionBy("row").orderBy("col")
    islands = mask.select("row", "col").distinct().withColumn("_i", F.col("col") - F.row_number().over(order))
    return islands.groupBy("row", "_i").agg(F.min("col").alias("first"), F.max("col").alias("last")).drop("_i")


def gaps(of_runs: DataFrame, height: int, width: int) -> DataFrame:
    """Runs of the complement within a raster."""
    order = W.partitionBy("row").orderBy("first")
    left = of_runs.select("row", F.coalesce(F.lag("last").over(order) + 1, F.lit(0)).alias("first"), (F.col("first") - 1).alias("last"))
    right = of_runs.groupBy("row").agg((F.max("last") + 1).alias("first")).select("row", "first", F.lit(width - 1).alias("last"))
    rows = of_runs.sparkSession.range(height).select(F.col("id").cast("int").alias("row"))
    empty = rows.join(of_runs.select("row"), "row", "left_anti").select("row", F.lit(0).alias("first"), F.lit(width - 1).alias("last"))
    return left.unionAll(right).unionAll(empty).where("first <= last")


def _union_find(table: pd.DataFrame) -> pd.DataFrame:
    """Labels of runs, each component named by the least (row, first), packed."""
    table = table.sort_values(["row", "first"], ignore_index=True)
    row, first, last = (table[c].to_numpy() for c in ("row", "first", "last"))
    parent = list(range(len(table)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    above = 0
    for k in range(len(table)):
        while above < k and (row[above] < row[k] - 1 or (row[above] == row[k] - 1 and last[above] < first[k])):
            above += 1
        at = above
        while at < k and row[at] == row[k] - 1 and first[at] <= last[k]:
            a, b = find(at), find(k)
            parent[max(a, b)] = min(a, b)
            at += 1
    roots = [find(k) for k in range(len(table))]
    return table.assign(root_row=row[roots], root_col=first[roots])


def _stars(of_runs: DataFrame) -> DataFrame:
    """Labels of runs by alternating large and small stars over their contacts."""
    named = settle(of_runs.withColumn("id", (F.col("row").cast("bigint") * F.lit(1 << 31) + F.col("first"))), "runs")
    above = named.select((F.col("row") + 1).alias("row"), F.col("first").alias("f"), F.col("last").alias("l"), F.col("id").alias("v"))
    edges = settle(named.join(above, (named["row"] == above["row"]) & (F.col("first") <= F.col("l")) & (F.col("last") >= F.col("f"))).select(F.col("id").alias("u"), "v"), "contacts")
    sign = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = sign(edges)
    while seen[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(small.unionAll(lower.select("u", F.col("m").alias("v"))).distinct(), "contacts")
        now = sign(edges)
        if now == seen:
            break
        seen = now
    root = F.coalesce("v", "id")
    return named.join(edges, named["id"] == edges["u"], "left").select("row", "first", "last", F.floor(root / F.lit(1 << 31)).cast("int").alias("root_row"), (root % F.lit(1 << 31)).cast("int").alias("root_col"))


def label_runs(of_runs: DataFrame, local_runs: int = LOCAL_RUNS) -> DataFrame:
    """``row, first, last`` with the first pixel ``root_row, root_col`` of each run's component in scan order."""
    of_runs = of_runs.select(F.col("row").cast("int").alias("row"), F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))
    held = settle(of_runs, "runs")
    if held.count() > local_runs:
        return _stars(held)
    return held.groupBy().applyInPandas(_union_find, "row int, first int, last int, root_row int, root_col int")


def _numbered(labelled: DataFrame, min_pixels: int = 1) -> DataFrame:
    """Pixels of labelled runs with ``patch_id``, from 1 in scan order; smaller components are left out. Numbering sorts one row a component."""
    sized = labelled.groupBy("root_row", "root_col").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n")).where(F.col("n") >= min_pixels)
    numbers = sized.select("root_row", "root_col", F.row_number().over(W.orderBy("root_row", "root_col")).alias("patch_id"))
    return labelled.join(numbers, ["root_row", "root_col"]).select("row", F.explode(F.sequence("first", "last")).alias("col"), "patch_id")


def components(mask: DataFrame, local_runs: int = LOCAL_RUNS) -> DataFrame:
    """Pixels with ``patch_id``: four-connected components, from 1 in scan order of their first pixels."""
    return _numbered(label_runs(runs(mask), local_runs))


def fill_holes(mask: DataFrame, grid: Grid, local_runs: int = LOCAL_RUNS) -> DataFrame:
    """The mask and all regions of its complement that do not reach the raster's border by four-connection."""
    labelled = label_runs(gaps(runs(mask), grid.height, grid.width), local_runs)
    at_border = (F.col("row") == 0) | (F.col("row") == grid.height - 1) | (F.col("first") == 0) | (F.col("last") == grid.width - 1)
    outer = labelled.where(at_border).select("root_row", "root_col").distinct()
    holes = labelled.join(outer, ["root_row", "root_col"], "left_anti")
    return mask.select("row", "col").distinct().unionAll(holes.select("row", F.explode(F.sequence("first", "last")).alias("col")))


def sieve(mask: DataFrame, min_pixels: int, local_runs: int = LOCAL_RUNS) -> DataFrame:
    """The mask without components smaller than ``min_pixels``."""
    if min_pixels <= 1:
        return mask.select("row", "col").distinct()
    labelled = label_runs(runs(mask), local_runs)
    large = labelled.groupBy("root_row", "root_col").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n")).where(F.col("n") >= min_pixels)
    return labelled.join(large, ["root_row", "root_col"], "left_semi").select("row", F.explode(F.sequence("first", "last")).alias("col"))


def _opened(mask: DataFrame, grid: Grid, iterations: int, fill: bool) -> DataFrame:
    out = opening(mask, iterations) if iterations > 0 else mask.select("row", "col").distinct()
    return fill_holes(settle(out, "opened"), grid) if fill else out


def clean(mask: DataFrame, grid: Grid, iterations: int = 1, fill: bool = True, min_area_ha: float = 0.5) -> DataFrame:
    """Opening, holes filled, small components dropped."""
    return sieve(_opened(mask, grid, iterations, fill), grid.pixels_for_ha(min_area_ha))


def clean_components(mask: DataFrame, grid: Grid, iterations: int = 1, fill: bool = True, min_area_ha: float = 0.5, local_runs: int = LOCAL_RUNS) -> DataFrame:
    """The components of a cleaned mask, labelled once: the sieve drops whole components, so their labels serve for both."""
    return _numbered(label_runs(runs(_opened(mask, grid, iterations, fill)), local_runs), grid.pixels_for_ha(min_area_ha))


def block_mean_power(pixels: DataFrame, values: list[str], factor: int) -> DataFrame:
    """Means of linear power over blocks of ``factor`` x ``factor`` pixels; a block without values is missing."""
    if factor <= 1:
        return pixels.select("row", "col", *values)
    at = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("row", "col")]
    return pixels.groupBy(*at).agg(*(F.avg(v).alias(v) for v in values))


def block_mean_db(pixels: DataFrame, values: list[str], factor: int) -> DataFrame:
    """Block means of decibels, taken in linear power."""
    linear = pixels.select("row", "col", *(db_to_linear(v).alias(v) for v in values))
    return block_mean_power(linear, values, factor).select("row", "col", *(linear_to_db(v).alias(v) for v in values))


def perimeter(patch_pixels: DataFrame, grid: Grid) -> DataFrame:
    """``perimeter_m`` (holes included) and ``shape_index`` of each patch: exposed sides of its pixels."""
    sides = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((-1, 0), (1, 0), (0, -1), (0, 1))))
    own = patch_pixels.select("patch_id", "row", "col")
    facing = own.select("patch_id", F.explode(sides).alias("o"), "row", "col").select("patch_id", (F.col("row") + F.col("o.y")).alias("row"), (F.col("col") + F.col("o.x")).alias("col"))
    exposed = facing.join(own, ["patch_id", "row", "col"], "left_anti").groupBy("patch_id").agg((F.count("*") * F.lit(grid.resolution)).alias("perimeter_m"))
    area = own.groupBy("patch_id").agg((F.count("*") * F.lit(grid.pixel_area_m2)).alias("area_m2"))
    return area.join(exposed, "patch_id").select("patch_id", "perimeter_m", (F.col("perimeter_m") / (2 * F.sqrt(F.pi() * F.col("area_m2")))).alias("shape_index"))


def outlines(patch_pixels: DataFrame, grid: Grid) -> DataFrame:
    """One polygon a patch as well-known text, outer rings and holes traced along pixel sides."""

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = set(zip(pdf["row"].tolist(), pdf["col"].tolist(), strict=True))
        ahead: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r, c in cells:  # sides run with the patch on their right
            for off, a, b in (((-1, 0), (r, c), (r, c + 1)), ((0, 1), (r, c + 1), (r + 1, c + 1)), ((1, 0), (r + 1, c + 1), (r + 1, c)), ((0, -1), (r + 1, c), (r, c))):
                if (r + off[0], c + off[1]) not in cells:
                    ahead.setdefault(a, []).append(b)
        rings = []
        while ahead:
            start = at = min(ahead)
            ring, came = [start], None
            while True:
                options = ahead[at]
                # Where two corners meet, turn right, so that rings do not cross.
                turn = lambda b, at=at, came=came: 0 if came is None else {(0, 1): 0, (1, 0): 1, (0, -1): 2, (-1, 0): 3}[(b[0] - at[0], b[1] - at[1])] - {(0, 1): 0, (1, 0): 1, (0, -1): 2, (-1, 0): 3}[came]
                nxt = next((b for b in options if turn(b) % 4 == 1), options[0])
                options.remove(nxt)
                if not options:
                    del ahead[at]
                step = (nxt[0] - at[0], nxt[1] - at[1])
                if came == step:
                    ring[-1] = nxt
                else:
                    ring.append(nxt)
                at, came = nxt, step
                if at == start:
                    break
            rings.append(ring)
        area = lambda ring: sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(ring, ring[1:], strict=False))
        rings.sort(key=lambda ring: -abs(area(ring)))
        text = ", ".join("(" + ", ".join(f"{grid.c + grid.a * c:g} {grid.f + grid.e * r:g}" for r, c in ring) + ")" for ring in rings)
        return pd.DataFrame({"patch_id": [int(pdf["patch_id"].iloc[0])], "wkt": [f"POLYGON ({text})"]})

    return patch_pixels.select("patch_id", "row", "col").groupBy("patch_id").applyInPandas(trace, "patch_id int, wkt string")
