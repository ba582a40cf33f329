"""Zones as ring collections: point tests, interior points, and the grid cells that a zone touches.

A zone is one closed ring or a list of closed rings; islands and holes follow from the even-odd
rule over all rings. Zones are filed in a tree of bins at the level of their own size, so a
country and a village both have a few rows, and a point looks up one bin per level that occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from fieldframe.functions.text import let
from fieldframe.operators.picks import pick_one
from fieldframe.operators.scalars import with_row

#: Bins of one level are so many times as wide as those of the level below.
STEP = 4.0
BOX = ("_x1", "_x2", "_y1", "_y2")


def zones_from_rings(zones: DataFrame, ring: str) -> DataFrame:
    """Prepare zones for point tests: box and edge list per zone, computed once.

    ``ring`` is a closed ``array<struct<x, y>>`` or an array of such rings. Null rings and rings
    of fewer than two points add no edges; a zone without edges has no box and contains nothing.
    """
    many = isinstance(zones.schema[ring].dataType.elementType, ArrayType)
    rings = F.col(ring) if many else F.array(F.col(ring))
    pairs = lambda r: F.zip_with(
        F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )
    edges = F.flatten(F.transform(F.filter(rings, lambda r: r.isNotNull()), pairs))
    # a ring is closed, so every point of it starts an edge
    low = lambda axis: F.array_min(F.transform("_edges", lambda e: e[axis]))
    high = lambda axis: F.array_max(F.transform("_edges", lambda e: e[axis]))
    return zones.withColumn("_edges", edges).withColumns({
        "_x1": low("x1"), "_x2": high("x1"), "_y1": low("y1"), "_y2": high("y1"),
    }).drop(ring)


def crossings(y: Column) -> Column:
    """Where the edges cross the height y, from left to right."""
    hit = F.filter("_edges", lambda e: (e["y1"] > y) != (e["y2"] > y))
    return F.array_sort(F.transform(hit, lambda e: (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))


def contains_point(x: Column, y: Column) -> Column:
    """Ray casting: the point is inside when the ray to the right crosses the rings an odd number of times."""
    crosses = lambda e: F.when(
        ((e["y1"] > y) != (e["y2"] > y))
        & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]),
        F.lit(1),
    ).otherwise(F.lit(0))
    return F.aggregate("_edges", F.lit(0), lambda acc, e: acc + crosses(e)) % 2 == 1


def with_interior_point(zones: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """A point inside each prepared zone: the middle of the widest span at about half its height.

    Where no edge reaches half the height, as between the parts of a zone, the height is that of
    the middle of the nearest edge. The height then moves to between the two heights of corners
    around it, so that it meets no corner; the leftmost of equally wide spans is taken. A zone
    without area has no point.
    """
    half = (F.col("_y1") + F.col("_y2")) / 2
    met = F.exists("_edges", lambda e: (e["y1"] > half) != (e["y2"] > half))
    nearest = F.array_min(F.transform(F.filter("_edges", lambda e: e["y1"] != e["y2"]), lambda e: F.struct(
        F.abs((e["y1"] + e["y2"]) / 2 - half).alias("far"), ((e["y1"] + e["y2"]) / 2).alias("y"))))["y"]
    heights = F.transform("_edges", lambda e: e["y1"])
    between = lambda m: (F.array_max(F.filter(heights, lambda h: h <= m)) + F.array_min(F.filter(heights, lambda h: h > m))) / 2

    def widest(at: Column) -> Column:
        """Middle of the widest of the spans between the first and second, third and fourth … crossing."""
        pairs = F.filter(F.transform(at, lambda v, i: F.struct(v.alias("a"), F.get(at, i + 1).alias("b"), i.alias("i"))), lambda s: s["i"] % 2 == 0)
        spans = F.transform(pairs, lambda s: F.struct((s["a"] - s["b"]).alias("less"), ((s["a"] + s["b"]) / 2).alias("x")))
        return F.array_min(F.filter(spans, lambda s: s["less"] < 0))["x"]

    placed = zones.withColumn("_h", let(F.when(met, half).otherwise(nearest), between)).withColumn("_x", let(crossings(F.col("_h")), widest))
    return placed.withColumns({x: F.col("_x"), y: F.when(F.col("_x").isNotNull(), F.col("_h"))}).drop("_h", "_x")


# --- bins by size ---------------------------------------------------------------------------

def _level(size: Column) -> Column:
    """Lowest level whose bins are at least as wide as the zone."""
    return F.ceil(F.log(F.greatest(size, F.lit(1e-9))) / F.log(F.lit(STEP))).cast("int")


def binned_zones(zones: DataFrame) -> DataFrame:
    """One row per zone and bin of its own level that its box touches: four at most, nine if rounding lifts a box over a level."""
    size = F.greatest(F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1"))
    placed = zones.withColumn("_level", _level(size)).withColumn("_w", F.pow(F.lit(STEP), F.col("_level")))
    bins = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / F.col("_w")), F.floor(F.col(high) / F.col("_w"))))
    return placed.where(size.isNotNull()).withColumn("_bx", bins("_x1", "_x2")).withColumn("_by", bins("_y1", "_y2")).drop("_w")


def join_zones(points: DataFrame, zones: DataFrame, lon: str = "lon", lat: str = "lat", how: str = "inner", polygon: bool = True) -> DataFrame:
    """Points to the zones that contain them, or whose box does.

    The range condition becomes an equality on level and bin plus a residual test, so Spark hashes
    on the bin instead of comparing every point with every zone. The levels that occur, some twenty
    at most between a metre and the globe, are one scalar subquery. With a left join a point has
    an unmatched row for every level where it meets no zone; ``point_in_zone`` keeps one row.
    """
    x, y = F.col(lon), F.col(lat)
    right = binned_zones(zones)
    probing = with_row(points, right.agg(F.array_sort(F.collect_set("_level")).alias("_levels")))
    probing = probing.withColumn("_level", F.explode_outer("_levels")).withColumn("_w", F.pow(F.lit(STEP), F.col("_level")))
    left = probing.withColumns({"_bx": F.floor(x / F.col("_w")), "_by": F.floor(y / F.col("_w"))}).alias("p")
    test = x.between(F.col("_x1"), F.col("_x2")) & y.between(F.col("_y1"), F.col("_y2"))
    if polygon:
        test = test & contains_point(x, y)
    same = [F.col(f"p.{c}") == F.col(f"z.{c}") for c in ("_level", "_bx", "_by")]
    extra = [c for c in zones.columns if c not in ("_edges", *BOX)]
    joined = left.join(right.alias("z"), same[0] & same[1] & same[2] & test, how)
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"z.{c}") for c in extra])


def point_in_zone(points: DataFrame, zones: DataFrame, key: str, zone_order: str) -> DataFrame:
    """Left join of points to polygons, the first zone per point; points outside stay unmatched."""
    matched = join_zones(points, zones, how="left")
    return pick_one(matched, [key], [F.col(zone_order).asc_nulls_last()])


def assign_units(units: DataFrame, ring: str, zones: DataFrame, key: str, zone_order: str) -> DataFrame:
    """Units given by their rings to the first zone that holds a point inside them; (unit columns, lon, lat, zone columns)."""
    placed = with_interior_point(zones_from_rings(units, ring)).drop("_edges", *BOX)
    return point_in_zone(placed, zones, key, zone_order)


# --- cells that a zone touches --------------------------------------------------------------

def _walk(e: Column, size: float, x0: float, y0: float) -> Column:
    """Cells (column, row) whose inside the edge passes through, column by column."""
    ax, ay, bx, by = ((e[c] - F.lit(o)) / F.lit(size) for c, o in (("x1", x0), ("y1", y0), ("x2", x0), ("y2", y0)))
    left, right = F.least(ax, bx), F.greatest(ax, bx)
    steps = lambda low, high: F.when(F.ceil(high) > F.floor(low), F.sequence(F.floor(low), F.ceil(high) - 1)).otherwise(F.array().cast("array<bigint>"))
    at = lambda x: F.when(ax == bx, ay).otherwise(ay + (x - ax) / F.nullif(bx - ax, F.lit(0.0)) * (by - ay))

    def rows(i: Column) -> Column:
        enter, leave = F.greatest(left, i.cast("double")), F.least(right, (i + 1).cast("double"))
        # a vertical edge runs over its whole height; ends of a segment are not recomputed
        y = lambda x: F.when(x == ax, ay).when(x == bx, by).otherwise(at(x))
        low = F.when(ax == bx, F.least(ay, by)).otherwise(F.least(y(enter), y(leave)))
        high = F.when(ax == bx, F.greatest(ay, by)).otherwise(F.greatest(y(enter), y(leave)))
        return F.transform(steps(low, high), lambda j: F.struct(i.alias("ix"), j.alias("iy")))

    return F.flatten(F.transform(steps(left, right), rows))


def cell_zones(cells: DataFrame, zones: DataFrame, zone: str, size: float, x0: float = 0.0, y0: float = 0.0,
               all_touched: bool = False, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Cells, given by a point in them, to zones: (cell columns, zone columns).

    A cell belongs to a zone that contains its centre; with ``all_touched`` also to one whose
    outline passes through the cell's inside, so thin and small zones get cells too. An edge along
    a cell's side touches neither side. Cells are squares of ``size`` from (x0, y0). The test is
    made once per distinct cell and zone, not per row of the cell table.
    """
    place = lambda df: df.withColumns({"_ix": F.floor((F.col(lon) - x0) / size), "_iy": F.floor((F.col(lat) - y0) / size)})
    numbered = place(cells)
    grid = numbered.select("_ix", "_iy").distinct()
    centres = grid.withColumns({"lon": (F.col("_ix") + 0.5) * size + x0, "lat": (F.col("_iy") + 0.5) * size + y0})
    found = join_zones(centres, zones).select("_ix", "_iy", zone)
    if all_touched:
        walked = zones.select(zone, F.explode("_edges").alias("_e")).select(zone, F.explode(_walk(F.col("_e"), size, x0, y0)).alias("_c"))
        met = walked.select(F.col("_c.ix").alias("_ix"), F.col("_c.iy").alias("_iy"), zone)
        found = found.unionByName(met).distinct()
    kept = zones.drop("_edges", *BOX).withColumnRenamed(zone, "_zone")
    pairs = found.join(kept, F.col(zone).eqNullSafe(F.col("_zone"))).drop("_zone")
    return numbered.join(pairs, ["_ix", "_iy"]).drop("_ix", "_iy")
