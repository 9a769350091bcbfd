"""Zones, lookup tables, moving averages and cumulative products; throttles are in ``scan``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.operators import scan
from sedimenta.operators.datasets import free_names
from sedimenta.sources.scratch import materialize


def tag_zones(points: DataFrame, rects: list[tuple[int, int, int, int]], circles: list[tuple[float, float, float, float]], width: int | None = None, height: int | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Add wall (in a half-open rectangle x, y, w, h), value (of the last circle x, y, r, value that holds the point strictly; 0
    if none), border and static (wall or border or a value above 0). Zones are configuration, tens of literals at most."""
    px, py = F.col(x), F.col(y)
    inside = [(px >= a) & (px < a + w) & (py >= b) & (py < b + h) for a, b, w, h in rects]
    wall = F.lit(False)
    for one in inside:
        wall = wall | one
    value = F.lit(0.0)
    for cx, cy, r, v in circles:  # later circles cover earlier ones
        value = F.when((px - cx) * (px - cx) + (py - cy) * (py - cy) < r * r, F.lit(float(v))).otherwise(value)
    border = F.lit(False) if width is None else (px == 0) | (py == 0) | (px == width - 1) | (py == height - 1)
    return points.withColumns({"wall": wall, "value": value, "border": border}).withColumn("static", F.col("wall") | F.col("border") | (F.col("value") > 0))


def _tiles(size: Column, x: Column, y: Column) -> list[Column]:
    return [F.floor(c / size).cast("long") for c in (x, y)]


def _zones(rects: DataFrame | None, circles: DataFrame | None, tile: float) -> DataFrame | None:
    """Both kinds of zones as one table: bounds x0, y0, x1, y1, ord (which of two circles wins; null for rectangles) and value, cx, cy, rr, and
    the level at which tiles are as large as the zone. Zones that hold nothing, or with null or non-finite numbers, are left out, and of zones
    of one place and size the winner stays."""
    number = lambda c: F.col(c).cast("double")
    none = F.lit(None).cast("double")
    x, y, parts = F.col("x"), F.col("y"), []
    if rects is not None:
        one = rects.select(*(number(c).alias(c) for c in ("x", "y", "w", "h"))).distinct()
        parts.append(one.select(x.alias("x0"), y.alias("y0"), (x + F.col("w")).alias("x1"), (y + F.col("h")).alias("y1"), F.lit(None).cast("long").alias("ord"), none.alias("value"), none.alias("cx"), none.alias("cy"), none.alias("rr")))
    if circles is not None:
        r = F.col("r")
        named = circles.select(*(number(c).alias(c) for c in ("x", "y", "seq", "value")), F.abs(number("r")).alias("r"))
        ranked = named.where("r > 0 AND seq IS NOT NULL AND value IS NOT NULL").orderBy("seq", "value", "x", "y", "r").withColumn("ord", F.monotonically_increasing_id())
        one = ranked.groupBy("x", "y", "r").agg(F.max("ord").alias("ord"), F.max_by("value", "ord").alias("value"))
        parts.append(one.select((x - r).alias("x0"), (y - r).alias("y0"), (x + r).alias("x1"), (y + r).alias("y1"), "ord", "value", x.alias("cx"), y.alias("cy"), (r * r).alias("rr")))
    if not parts:
        return None
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    fine = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (extent < float("inf"))
    for c in ("x0", "y0", "x1", "y1"):
        fine = fine & (F.abs(F.col(c)) < float("inf"))
    return whole.where(fine).withColumn("level", F.greatest(F.ceil(F.log2(extent / tile)), F.lit(0)).cast("int"))


#: Zones that are pruned together, cells of a tile's side that they are compared in, and rounds of it.
PRUNED, CELLS, ROUNDS = 4096, 8, 6


def needed_zones(zones: dict[str, np.ndarray], x: float, y: float, size: float) -> np.ndarray:
    """Which zones of a tile (its lower corner and size) some place may need: those that reach a cell of the tile in which no winner
    over them covers all. Of rectangles any may win. Cells are taken a little larger than they are, so that rounding loses none."""
    edge = np.arange(CELLS + 1) / CELLS * size
    slack = 1e-9 * (size + abs(x) + abs(y))
    left, low = (v.ravel() for v in np.meshgrid(x + edge[:-1] - slack, y + edge[:-1] - slack, indexing="ij"))
    right, high = (v.ravel() for v in np.meshgrid(x + edge[1:] + slack, y + edge[1:] + slack, indexing="ij"))
    x0, y0, x1, y1, cx, cy, rr = (zones[c][:, None] for c in ("x0", "y0", "x1", "y1", "cx", "cy", "rr"))
    circle = ~np.isnan(zones["rr"])
    # The rounded bounds of a circle may fall short of it by as much.
    reached = (x0 - slack <= right) & (x1 + slack >= left) & (y0 - slack <= high) & (y1 + slack >= low)
    far = np.maximum(np.abs(left - cx), np.abs(right - cx)) ** 2 + np.maximum(np.abs(low - cy), np.abs(high - cy)) ** 2
    whole = np.where(circle[:, None], far < rr * (1 - 1e-9), (x0 <= left) & (x1 > right) & (y0 <= low) & (y1 > high))
    rank = np.where(circle, zones["ord"], np.arange(len(circle)))[:, None]
    out = np.zeros(len(circle), dtype=bool)
    for kind in (circle, ~circle):
        if kind.any():
            out[kind] = (reached[kind] & (rank[kind] >= np.where(whole[kind], rank[kind], -1).max(axis=0))).any(axis=1)
    return out


def _pruned(tiled: DataFrame, tile: float, crowd: int) -> DataFrame:
    """Zones by tile, less those in tiles of more than ``crowd`` that can't count for any place there: chunks of a tile's zones are pruned
    apart, and what is left is pruned together in the next round, for as long as it shrinks."""
    place, names = ["level", "tx", "ty"], tiled.columns

    def crowded(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") > crowd)

    def prune(group: pa.Table) -> pa.Table:
        size = tile * 2.0 ** group["level"][0].as_py()
        columns = {c: group[c].to_numpy() for c in ("x0", "y0", "x1", "y1", "cx", "cy", "rr")}
        columns["ord"] = pc.fill_null(group["ord"], -1).to_numpy()
        return group.filter(pa.array(needed_zones(columns, group["tx"][0].as_py() * size, group["ty"][0].as_py() * size, size))).select(names)

    full = materialize(crowded(tiled), "crowded")
    rest, held = tiled.join(full, place, "left_anti"), tiled
    before = full.agg(F.sum("n")).first()[0] or 0
    if not before:
        return tiled
    for _ in range(ROUNDS):
        dealt = held.join(full, place).withColumn("chunk", F.pmod(F.xxhash64("x0", "y0", "x1", "y1", "ord"), F.ceil(F.col("n") / PRUNED)).cast("int")).drop("n")
        held = materialize(dealt.groupBy(*place, "chunk").applyInArrow(prune, tiled.schema), "zones")
        full = held.groupBy(*place).agg(F.count("*").alias("n"))  # all of it, so that nothing gets lost
        left, most = full.agg(F.sum("n"), F.max("n")).first()
        if most <= crowd or left > before * 0.7:
            break
        before = left
    return rest.unionByName(held)


def tag_zones_by_tile(points: DataFrame, rects: DataFrame | None = None, circles: DataFrame | None = None, width: int | None = None, height: int | None = None, x: str = "x", y: str = "y", tile: float = 1.0, crowd: int = 512) -> DataFrame:
    """What ``tag_zones`` adds, for zones that are tables: rects (x, y, w, h) and circles (seq, x, y, r, value), of which the one with the
    largest seq wins (of equal ones the larger value).

    A zone lies in tiles as large as itself (``tile`` times a power of two), so in four at most; each place is looked up once per size
    that occurs, among the zones of its tile alone. Zones of one place and size, and places that repeat, are taken once. In a tile with more than
    ``crowd`` zones, those that others cover are left out; where more are left, the tile is split into chunks, each of which meets the tile's
    places for itself. Rows with a null coordinate are in no zone; zones with null or non-finite numbers hold nothing. Columns beside the
    coordinates pass through. Zones by tile are written to the shared folder.
    """
    out = ["wall", "value", "border", "static"]
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    zones = _zones(rects, circles, tile)
    rows = points.drop(*out)
    ax, ay, wall, value = free_names(rows, "ax", "ay", "is_wall", "held")
    if zones is not None:
        zones = materialize(zones, "zones")
        size = F.lit(tile) * F.pow(F.lit(2.0), F.col("level"))
        (tx0, ty0), (tx1, ty1) = _tiles(size, F.col("x0"), F.col("y0")), _tiles(size, F.col("x1"), F.col("y1"))
        place = ["level", "tx", "ty"]
        tiled = _pruned(zones.withColumn("tx", F.explode(F.sequence(tx0, tx1))).withColumn("ty", F.explode(F.sequence(ty0, ty1))), tile, crowd)
        crowded = tiled.groupBy(*place).agg(F.ceil(F.count("*") / crowd).cast("int").alias("chunks"))
        dealt = tiled.join(crowded, place).withColumn("chunk", F.pmod(F.xxhash64("x0", "y0", "x1", "y1", "ord"), F.col("chunks")).cast("int")).drop("chunks")
        levels = sorted(r[0] for r in zones.select("level").distinct().collect())  # sizes that occur, powers of two
        asked = rows.select(px.alias("px"), py.alias("py")).where("px IS NOT NULL AND py IS NOT NULL").distinct().withColumn("level", F.explode(F.array(*(F.lit(v) for v in levels)) if levels else F.array().cast("array<int>")))
        tx, ty = _tiles(size, F.col("px"), F.col("py"))
        asked = asked.withColumn("tx", tx).withColumn("ty", ty).join(crowded, place).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        dx, dy = F.col("px") - F.col("cx"), F.col("py") - F.col("cy")
        round_ = F.col("cx").isNotNull()
        inside = F.when(round_, dx * dx + dy * dy < F.col("rr")).otherwise((F.col("px") >= F.col("x0")) & (F.col("px") < F.col("x1")) & (F.col("py") >= F.col("y0")) & (F.col("py") < F.col("y1")))
        # Numbers alone are compared, so that hits are aggregated as they come, without a sort. Tiles are small and their pairs many: either side
        # is dealt over all tasks, and none is sent to the few that hold the other.
        found = asked.join(dealt.hint("merge"), [*place, "chunk"]).where(inside).groupBy("px", "py").agg(F.bool_or(~round_).alias(wall), F.max_by("value", "ord").alias(value))
        found = found.withColumnsRenamed({"px": ax, "py": ay})
        rows = rows.join(found, (px == F.col(ax)) & (py == F.col(ay)), "left")
    else:
        rows = rows.withColumns({ax: F.lit(0), ay: F.lit(0), wall: F.lit(False), value: F.lit(0.0)})
    border = F.lit(False) if width is None else (F.col(x) == 0) | (F.col(y) == 0) | (F.col(x) == width - 1) | (F.col(y) == height - 1)
    rows = rows.withColumns({"wall": F.coalesce(wall, F.lit(False)), "value": F.coalesce(value, F.lit(0.0)), "border": F.coalesce(border, F.lit(False))})
    return rows.withColumn("static", F.col("wall") | F.col("border") | (F.col("value") > 0)).drop(ax, ay, wall, value)


def interpolate_by_table(df: DataFrame, at: str, table: DataFrame, out: str = "y", pos: str = "pos", value: str = "value") -> DataFrame:
    """Add ``out``: linear interpolation at a place in a table (pos from 0, value) of any length; null outside of it, at a null place or
    beside a missing position. Of rows that repeat a position the largest value counts.

    Each position is given its own and its successor's value by one grouping, which leaves the table partitioned for the join by the place's lower
    position; so table and places are shuffled once each.
    """
    own, low, first, after = free_names(df, "own_pos", "low", "first", "after")
    rows = table.where(F.col(pos).isNotNull()).select(F.col(pos).cast("long").alias(own), F.col(value).cast("double").alias(first))
    both = rows.select(own, first, F.lit(None).cast("double").alias(after)).unionByName(rows.select((F.col(own) - 1).alias(own), F.lit(None).cast("double").alias(first), F.col(first).alias(after)))
    pairs = both.groupBy(own).agg(F.max(first).alias(first), F.max(after).alias(after)).where(F.col(first).isNotNull())
    joined = df.withColumn(low, F.when((F.col(at) >= 0) & (F.col(at) < float(1 << 62)), F.floor(at))).join(pairs, F.col(low) == F.col(own), "left")
    part = F.col(at) - F.col(low)
    found = F.when(part == 0, F.col(first)).otherwise(F.col(first) + part * (F.col(after) - F.col(first)))
    return joined.withColumn(out, found).drop(own, low, first, after)


def interpolate(values: list[float], at: str | Column) -> Column:
    """Linear interpolation in a table of fixed values at a place between 0 and its last index; null outside."""
    at = F.col(at) if isinstance(at, str) else at
    n, table = len(values), F.array(*[F.lit(float(v)) for v in values])
    low = F.floor(at).cast("int")
    high = F.least(low + 1, F.lit(n - 1))
    a, b = F.get(table, low), F.get(table, high)
    return F.when((at >= 0) & (at <= n - 1), a + (at - low) * (b - a))


def moving_rate(df: DataFrame, key: str, order: str | list[str], value: str, n: int = 30, spread: bool = False) -> DataFrame:
    """Add mean (of the last ``n`` values) and rate (its reciprocal; null if it isn't positive). ``spread`` cuts long keys into ranges; without it
    a key is one task."""
    if spread:
        meant = scan.moving_mean(df, key, order, value, n)
    else:
        meant = df.withColumn("mean", F.avg(value).over(W.partitionBy(key).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(1 - n, 0)))
    return meant.withColumn("rate", F.when(F.col("mean") > 0, 1 / F.col("mean")))


def cumulative_product(df: DataFrame, key: str, order: str | list[str], column: str, out: str = "product", spread: bool = False) -> DataFrame:
    """Add the running product; zeros and negative factors are fine. ``spread`` as in ``moving_rate``."""
    if spread:
        return scan.running(df, key, order, **{out: ("product", F.col(column).cast("double"))}).withColumn(out, F.col(out) + 0.0)
    w = W.partitionBy(key).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.product(F.col(column)).over(w) + 0.0)


def noise_schedule(df: DataFrame, key: str, order: str | list[str], beta: str, spread: bool = False) -> DataFrame:
    """Add alphas_product (of 1 - beta) and sigma, the root of its odds against. ``spread`` as in ``moving_rate``."""
    alpha = free_names(df, "alpha")[0]
    out = cumulative_product(df.withColumn(alpha, 1 - F.col(beta)), key, order, alpha, "alphas_product", spread).drop(alpha)
    return out.withColumn("sigma", F.sqrt((1 - F.col("alphas_product")) / F.nullif(F.col("alphas_product"), F.lit(0.0))))


def betas(start: float, end: float, steps: int, kind: str = "linear") -> list[float]:
    """Noise levels: evenly spaced, or the squares of evenly spaced roots ("scaled")."""
    if kind == "linear":
        return np.linspace(start, end, steps).tolist()
    return (np.linspace(start**0.5, end**0.5, steps) ** 2).tolist()
