"""Nearest station of every point, from coordinates.

Places are points on the unit sphere, so neither the poles nor the date line is special, and the straight line between two
of them grows with the distance along the ground. The stations form a tree of cubes: a cube with more than ``LEAF`` stations is divided into
4 x 4 x 4, so a crowded one is split however many stations it has. Every node keeps the box that its stations fill.

Points are reduced to distinct coordinates and go down the tree twice, one equi-join per level. The first time each takes only the
nearest box, so it stays one row, and the stations of the leaf it ends in give a length that the answer cannot exceed. The second time it
takes every box within that length, which are few, as the length is that of a real station; nothing is gathered per point on the way.
Only the stations of these leaves are measured. No pair of tables is crossed, and no distance is assumed: a lonely point just keeps the
nodes it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagline.functions.scalars import haversine_km
from lagline.session import materialize

LEAF = 32
# Each level divides a cube by four in each direction; at the last one a cube is about 12 m wide.
LEVELS = 10
_BITS = 2 * LEVELS
# The cubes of so many levels that meet the sphere are some 20,000 at most, whatever the stations: they are broadcast.
_TOP = 3
_AXES = "xyz"
# Points that one task takes down the tree.
_POINTS = 20_000


def _on_sphere(lat: Column, lon: Column) -> dict[str, Column]:
    lat, lon = F.radians(lat), F.radians(lon)
    return {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}


def _usable(lat: str, lon: str) -> Column:
    inside = F.col(lat).between(-90.0, 90.0) & F.col(lon).between(-180.0, 180.0)
    return F.coalesce(inside, F.lit(False))


def _cell(level: int | Column) -> Column:
    """The cube of a level that holds x, y, z, as one number; its parent's is that of the level before."""
    cut = lambda axis: F.least(F.floor((F.col(axis) + 1) * (1 << (_BITS - 1))), F.lit((1 << _BITS) - 1))
    shift = F.lit(_BITS) - 2 * (F.lit(level) if isinstance(level, int) else level)
    number = F.lit(0).cast("long")
    for axis in _AXES:
        number = number * (1 << _BITS) + F.call_function("shiftright", cut(axis).cast("long"), shift.cast("int"))
    return number


def station_tree(stations: DataFrame, station: str, lat: str, lon: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves): ``level, cell, parent, leaf, box`` of every node, and ``level, cell, station, lat, lon, x, y, z`` of the stations in the leaves.

    Stations at one place are one, under the smallest id; those without usable coordinates are left out.
    """
    places = stations.where(_usable(lat, lon)).groupBy(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).agg(F.min(station).alias("station"))
    placed = materialize(places.withColumns(_on_sphere(F.col("lat"), F.col("lon"))), "stations")
    levels = F.explode(F.sequence(F.lit(1), F.lit(LEVELS))).alias("level")
    box = F.struct(*(f(a).alias(f"{n}_{a}") for a in _AXES for n, f in (("low", F.min), ("high", F.max))))
    spread = placed.select("x", "y", "z", levels)
    nodes = spread.groupBy("level", _cell(F.col("level")).alias("cell"), _cell(F.col("level") - 1).alias("parent")).agg(F.count(F.lit(1)).alias("n"), box.alias("box"))
    # A node is used if its parent was too full to be a leaf.
    full = nodes.where(F.col("n") > LEAF).select((F.col("level") + 1).alias("l"), F.col("cell").alias("p"))
    used = nodes.join(full, (F.col("level") == F.col("l")) & (F.col("parent") == F.col("p")), "left").where((F.col("level") == 1) | F.col("p").isNotNull())
    nodes = materialize(used.select("level", "cell", "parent", ((F.col("n") <= LEAF) | (F.col("level") == LEVELS)).alias("leaf"), "box"), "nodes")
    ends = nodes.where("leaf").select(F.col("level").alias("l"), F.col("cell").alias("c"))
    listed = placed.select("station", "lat", "lon", levels, "x", "y", "z").select("station", "lat", "lon", "level", _cell(F.col("level")).alias("cell"), *_AXES)
    leaves = listed.join(ends, (F.col("level") == F.col("l")) & (F.col("cell") == F.col("c")), "left_semi")
    return nodes, leaves


def _reach(box: Column) -> tuple[Column, Column]:
    """Squared straight-line distance from x, y, z to the nearest and to the farthest corner of a box."""
    near = far = F.lit(0.0)
    for axis in _AXES:
        low, high, at = box[f"low_{axis}"], box[f"high_{axis}"], F.col(axis)
        gap = F.greatest(low - at, at - high, F.lit(0.0))
        width = F.greatest(F.abs(at - low), F.abs(at - high))
        near, far = near + gap * gap, far + width * width
    return near, far


def _below(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes of the level after ``level`` as ``child``, with the level and the cell of their parents as ``up`` and ``in``."""
    below = nodes.where(F.col("level") == level + 1).select((F.col("level") - 1).alias("up"), F.col("parent").alias("in"), F.struct("level", "cell", "box").alias("child"))
    return F.broadcast(below) if level < _TOP else below


def _inside(up: str = "level", cell: str = "cell") -> Column:
    return (F.col(up) == F.col("up")) & (F.col(cell) == F.col("in"))


def _apart(one: str, other: str) -> Column:
    """Squared straight-line distance of two places whose axes have these prefixes."""
    gap = lambda a: F.col(one + a) - F.col(other + a)
    return sum((gap(a) * gap(a) for a in _AXES[1:]), gap("x") * gap("x"))


def _bounded(asked: DataFrame, key: list[str], nodes: DataFrame, spots: DataFrame, tops: Column, depth: int) -> DataFrame:
    """``key`` with ``reach``, a squared straight-line distance within which the nearest station lies."""
    # The nearest part is the least of one number, its squared distance above the six bits of its place in the cube.
    places = [(2 * _BITS - _BITS * i, 4 - 2 * i) for i in range(len(_AXES))]
    part = sum((F.shiftleft(F.shiftright(F.col("child.cell"), bits).bitwiseAND(3), six) for bits, six in places), F.lit(0).cast("long"))
    near, _ = _reach(F.col("child.box"))
    rank = F.shiftleft(F.floor(near * 2.0**50).cast("long"), 6) + part
    cell = sum((F.shiftleft(F.shiftright(F.col("rank"), six).bitwiseAND(3), bits) for bits, six in places), F.col("cell") * 4)
    at = asked.select(*key, F.lit(0).cast("long").alias("cell"), F.explode(tops).alias("child"))
    at = at.groupBy(*key, "cell").agg(F.min(rank).alias("rank")).select(*key, F.lit(1).alias("level"), cell.alias("cell"))
    for level in range(1, depth):
        met = at.join(_below(nodes, level), _inside(), "left").groupBy(*key, "level", "cell").agg(F.min(rank).alias("rank"))
        # A leaf has nothing below it and stays as it is.
        at = met.select(*key, F.when(F.col("rank").isNull(), F.col("level")).otherwise(F.col("level") + 1).alias("level"), F.when(F.col("rank").isNull(), F.col("cell")).otherwise(cell).alias("cell"))
    met = at.join(spots, ["level", "cell"]).groupBy(*key).agg(F.min(_apart("", "s_")).alias("bound"))
    # Room for stations that are a millimetre farther, which are rounded to the same distance, and for rounding itself.
    return met.select(*key, (F.col("bound") + F.sqrt("bound") * 1e-9 + 1e-14).alias("reach"))


def nearest_station(
    points: DataFrame, stations: DataFrame, lat: str, lon: str, station: str, station_lat: str, station_lon: str,
    name: str = "nearest", distance: str = "distance_km",
) -> DataFrame:
    """``points`` with the id of the nearest station and its distance in kilometres, rounded to a millimetre.

    Equal distances go to the smaller id. Both are null for points without usable coordinates and where there are no stations.
    """
    nodes, leaves = station_tree(stations, station, station_lat, station_lon)
    depth = nodes.agg(F.max("level")).first()[0] or 0
    if not depth:
        empty = stations.schema[station].dataType
        return points.select("*", F.lit(None).cast(empty).alias(name), F.lit(None).cast("double").alias(distance))
    asked = points.where(_usable(lat, lon)).select(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    # Tasks grow in number and not in size; the steps per point keep this layout as long as nodes are broadcast.
    asked = asked.repartition(asked.count() // _POINTS + 1, "lat", "lon").distinct()
    asked = asked.withColumns(_on_sphere(F.col("lat"), F.col("lon")))
    key = ["lat", "lon", *_AXES]
    # The first level has 64 cubes at most; they come as one array.
    tops = nodes.where("level = 1").agg(F.collect_list(F.struct("level", "cell", "box")).alias("tops")).scalar()
    spots = leaves.withColumnsRenamed({c: f"s_{c}" for c in ("lat", "lon", *_AXES)})
    near, _ = _reach(F.col("child.box"))
    started = _bounded(asked, key, nodes, spots, tops, depth).select(*key, "reach", F.explode(tops).alias("child"))
    open_ = started.where(near <= F.col("reach")).select(*key, "reach", "child.level", "child.cell")
    for level in range(1, depth):
        met = open_.join(_below(nodes, level), _inside(), "left").where(F.col("child").isNull() | (near <= F.col("reach")))
        open_ = met.select(*key, "reach", *(F.coalesce(F.col(f"child.{c}"), F.col(c)).alias(c) for c in ("level", "cell")))
    measured = open_.join(spots, ["level", "cell"]).where(_apart("", "s_") <= F.col("reach"))
    length = F.round(haversine_km("lat", "lon", "s_lat", "s_lon"), 6)
    best = measured.groupBy(F.col("lat").alias("__lat"), F.col("lon").alias("__lon")).agg(F.min(F.struct(length.alias("km"), F.col("station"))).alias("__best"))
    joined = points.join(best, (F.col(lat).cast("double") == F.col("__lat")) & (F.col(lon).cast("double") == F.col("__lon")), "left")
    return joined.select(*(points[c] for c in points.columns), F.col("__best.station").alias(name), F.col("__best.km").alias(distance))
