"""Points and places: country borders, bounding boxes, nearest states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Approximate centres of states and territories, code: (lat, lon).
STATES = {
    "AL": (32.8, -86.8), "AK": (64.2, -152.5), "AZ": (34.0, -111.1), "AR": (35.2, -91.8), "CA": (36.8, -119.4), "CO": (39.5, -105.8),
    "CT": (41.6, -72.7), "DE": (38.9, -75.5), "FL": (27.8, -81.8), "GA": (32.2, -83.6), "HI": (19.9, -155.6), "ID": (44.1, -114.7),
    "IL": (40.3, -89.0), "IN": (40.3, -86.1), "IA": (42.0, -93.2), "KS": (38.5, -98.8), "KY": (37.8, -84.3), "LA": (30.5, -92.0),
    "ME": (45.3, -69.4), "MD": (39.0, -76.6), "MA": (42.4, -71.4), "MI": (44.3, -85.6), "MN": (46.4, -94.6), "MS": (32.7, -89.7),
    "MO": (38.5, -92.3), "MT": (46.8, -110.4), "NE": (41.1, -98.3), "NV": (38.8, -116.4), "NH": (43.2, -71.6), "NJ": (40.1, -74.4),
    "NM": (34.8, -106.2), "NY": (43.0, -75.0), "NC": (35.6, -79.0), "ND": (47.5, -100.5), "OH": (40.4, -82.9), "OK": (35.0, -97.1),
    "OR": (43.8, -120.6), "PA": (41.2, -77.2), "RI": (41.6, -71.5), "SC": (34.0, -81.0), "SD": (43.9, -99.4), "TN": (35.5, -86.6),
    "TX": (31.1, -99.7), "UT": (39.3, -111.1), "VT": (44.0, -72.7), "VA": (37.4, -78.2), "WA": (47.4, -120.7), "WV": (38.6, -80.6),
    "WI": (43.8, -89.5), "WY": (43.1, -107.6), "DC": (38.9, -77.0), "PR": (18.2, -66.6), "VI": (18.3, -64.9), "GU": (13.4, 144.8),
    "AS": (-14.3, -170.7), "MP": (15.2, 145.7),
}
STATE_REACH_DEGREES, MOST_STATES = 4.0, 5


#: Cells start this much off round coordinates, so that their sides go through no vertex.
OFF_X, OFF_Y = 0.000123456789, 0.000098765432
#: Edges to a cell that the grid is made for, and the bounds of its fineness.
EDGES_PER_CELL, COARSEST, FINEST = 8, 1, 256


def _cell(at: Column, off: float, n: int) -> Column:
    return F.floor((at + off) * n)


def _x_at(e: Column, y: Column) -> Column:
    return e["x1"] + (y - e["y1"]) / F.when(e["y2"] != e["y1"], e["y2"] - e["y1"]) * (e["x2"] - e["x1"])


def fineness(edges: DataFrame) -> int:
    """Cells per degree that leave a cell of the border about ``EDGES_PER_CELL`` edges."""
    n, length = edges.agg(F.count(F.lit(1)), F.sum(F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)))).first()
    return int(min(FINEST, max(COARSEST, -(-n // (EDGES_PER_CELL * max(length or 0, 1e-9))))))


def cover(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """A grid over regions: what a row of cells and what a cell of the border knows.

    Rows (_row, far): of each region the columns in whose cells the row's lower side crosses its border an odd number of
    times. So many of them as lie further east tell whether a cell without edges is inside.
    Cells (_row, _col, near): of each region with edges in the cell these, and whether its lower right corner is inside.
    """
    side = F.struct("x1", "y1", "x2", "y2")
    rows = edges.select("region_no", "region", side.alias("e"), F.explode(F.sequence(_cell(F.least("y1", "y2") - 1e-9, OFF_Y, n), _cell(F.greatest("y1", "y2") + 1e-9, OFF_Y, n))).alias("_row"))
    low, e = F.col("_row") / n - OFF_Y, F.col("e")
    crossing = rows.filter((e["y1"] > low) != (e["y2"] > low)).select("region_no", "region", "_row", _cell(_x_at(e, low), OFF_X, n).alias("c"))
    odd = crossing.groupBy("_row", "region_no", "region", "c").agg(F.count(F.lit(1)).alias("k")).filter("k % 2 = 1")
    columns = odd.groupBy("_row", "region_no", "region").agg(F.array_sort(F.collect_list("c")).alias("columns"))
    far = columns.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("region_no", "region", "columns"))).alias("far"))

    ends = [F.coalesce(_x_at(e, F.greatest(low, F.least(e["y1"], e["y2"]))), e["x1"]), F.coalesce(_x_at(e, F.least(low + 1 / n, F.greatest(e["y1"], e["y2"]))), e["x2"])]
    spread = F.sequence(_cell(F.least(*ends) - 1e-9, OFF_X, n), _cell(F.greatest(*ends) + 1e-9, OFF_X, n))
    held = rows.withColumn("_col", F.explode(spread)).groupBy("_row", "_col", "region_no", "region").agg(F.collect_list("e").alias("edges"))
    based = held.join(columns, ["_row", "region_no", "region"], "left")
    corner = F.size(F.filter(F.coalesce("columns", F.array().cast("array<bigint>")), lambda c: c > F.col("_col"))) % 2
    cells = based.groupBy("_row", "_col").agg(F.array_sort(F.collect_list(F.struct("region_no", "region", corner.alias("corner"), "edges"))).alias("near"))
    return far, cells


def classify(points: DataFrame, edges: DataFrame, x: str = "lon", y: str = "lat", cells_per_degree: int | None = None) -> DataFrame:
    """Adds ``region``, the first (by region_no) whose polygon covers the point, boundary included; else null.

    Ray casting over all rings (so holes count), and a test of lying on an edge, by way of a grid. A cell without edges is
    inside or outside as a whole. Of a point in a cell of the border only the cell's own edges are tested: those between
    it and the cell's right side, and those that the right side meets below it, down to a corner that is known. Both are
    equi-joins, on rows of cells and on cells, and keep points single. ``cells_per_degree`` is fitted to the
    edges unless it is given; any gives the same regions. Points without coordinates have no region.
    """
    n = cells_per_degree or fineness(edges)
    far, cells = cover(edges, n)
    px, py = F.col(x), F.col(y)
    known = F.when(~F.isnan(px) & ~F.isnan(py), F.lit(True))
    at = points.withColumns({"_row": F.when(known, _cell(py, OFF_Y, n)), "_col": F.when(known, _cell(px, OFF_X, n))})
    right, low = (F.col("_col") + 1) / n - OFF_X, F.col("_row") / n - OFF_Y

    def on(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"])
        within = px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        return (cross == 0) & within

    def crossed(e: Column) -> Column:
        """Once if the way goes through the edge: east to the cell's right side, then down it; twice counts as none."""
        meets = _x_at(e, py)
        east = ((e["y1"] > py) != (e["y2"] > py)) & F.coalesce((px < meets) & (meets < right), F.lit(False))
        height = e["y1"] + (right - e["x1"]) / F.when(e["x2"] != e["x1"], e["x2"] - e["x1"]) * (e["y2"] - e["y1"])
        down = ((e["x1"] >= right) != (e["x2"] >= right)) & F.coalesce((low < height) & (height <= py), F.lit(False))
        return east != down

    def covers(r: Column) -> Column:
        return F.exists(r["edges"], on) | ((r["corner"] + F.size(F.filter(r["edges"], crossed))) % 2 == 1)

    def within(r: Column) -> Column:
        beside = ~F.coalesce(F.exists("near", lambda c: c["region_no"] == r["region_no"]), F.lit(False))
        return beside & (F.size(F.filter(r["columns"], lambda c: c > F.col("_col"))) % 2 == 1)

    def named(found: Column) -> Column:
        return F.transform(found, lambda r: F.struct(r["region_no"].alias("region_no"), r["region"].alias("region")))

    none = F.array().cast("array<struct<region_no:int,region:string>>")
    joined = at.join(far, "_row", "left").join(cells, ["_row", "_col"], "left")
    every = F.concat(F.coalesce(named(F.filter("near", covers)), none), F.coalesce(named(F.filter("far", within)), none))
    return joined.withColumn("region", F.array_min(every)["region"]).drop("_row", "_col", "far", "near")


def source_of(region: Column) -> Column:
    """The data source for a region; the United States where there is none."""
    return F.coalesce(region, F.lit("us"))


def box_region(lat: Column, lon: Column) -> Column:
    """A rough classification by boxes, tested in order."""
    # Boxes as (code, south, north, west, east), all ends included but the third box's north.
    boxes = (
        ("au", -45.0, -10.0, 112.0, 155.0), ("ca", 42.0, 84.0, -141.0, -52.0), ("us", 24.0, 49.0, -125.0, -66.0),
        ("us", 51.0, 72.0, -180.0, -129.0), ("us", 18.0, 23.0, -161.0, -154.0),
    )
    out = F.lit(None).cast("string")
    for i, (code, south, north, west, east) in reversed(list(enumerate(boxes))):
        below = lat < north if i == 2 else lat <= north
        out = F.when((lat >= south) & below & lon.between(west, east), F.lit(code)).otherwise(out)
    return out


def nearby_states(points: DataFrame, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(key, state_no, state): the nearest state by plain degrees, then others under four degrees, five at most."""
    near = F.array_sort(
        F.array(
            *[
                F.struct(F.sqrt(F.pow(F.col(lat) - la, F.lit(2)) + F.pow(F.col(lon) - lo, F.lit(2))).alias("d"), F.lit(code).alias("state"))
                for code, (la, lo) in STATES.items()
            ]
        )
    )
    kept = F.filter(F.slice(near, 1, MOST_STATES), lambda s, i: (i == 0) | (s["d"] < STATE_REACH_DEGREES))
    return points.select(key, F.posexplode(kept).alias("state_no", "s")).select(key, (F.col("state_no") + 1).alias("state_no"), "s.state")
