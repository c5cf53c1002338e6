"""Grid geometry: cells of places on regular, projected and reduced Gaussian grids.

Cell numbers are computed from coordinates by arithmetic, so finding a place's cell, its neighbourhood or the cells of a
box never compares places with cells; data are joined by cell number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobarn.functions.meteo import col


def _round(x: Column) -> Column:
    """Halves away from zero."""
    return F.round(x).cast("long")


@dataclass(frozen=True)
class Projection:
    """lambert (lon0, lat0, lat1, lat2), lambert_area (lon0, lat1), stereographic (lat, lon) or rotated (lat, lon)."""

    kind: str
    params: dict[str, float] = field(hash=False, default_factory=dict)
    radius: float = 6371229.0

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        p, r, phi, lam = self.params, self.radius, F.radians(lat), F.radians(lon)
        if self.kind == "rotated":
            tilt, turn = math.radians(90 + p["lat"]), math.radians(p["lon"])
            x, y, z = F.cos(lam - turn) * F.cos(phi), F.sin(lam - turn) * F.cos(phi), F.sin(phi)
            x2, z2 = math.cos(tilt) * x + math.sin(tilt) * z, -math.sin(tilt) * x + math.cos(tilt) * z
            return -F.degrees(F.atan2(y, x2)), -F.degrees(F.asin(z2))
        if self.kind == "lambert":
            n, f, rho0, lam0 = self._cone()
            rho, theta = f / F.pow(F.tan(math.pi / 4 + phi / 2), F.lit(n)), n * (lam - lam0)
            return r * rho * F.sin(theta), r * (rho0 - rho * F.cos(theta))
        lam0, phi1 = math.radians(p["lon"]), math.radians(p["lat"])
        across = math.sin(phi1) * F.sin(phi) + math.cos(phi1) * F.cos(phi) * F.cos(lam - lam0)
        k = F.sqrt(2 / (1 + across)) if self.kind == "lambert_area" else 2 / (1 + across)
        return r * k * F.cos(phi) * F.sin(lam - lam0), r * k * (math.cos(phi1) * F.sin(phi) - math.sin(phi1) * F.cos(phi) * F.cos(lam - lam0))

    def point(self, lat: float, lon: float) -> tuple[float, float]:
        """forward for one place, as numbers."""
        p, r, phi, lam = self.params, self.radius, math.radians(lat), math.radians(lon)
        if self.kind == "rotated":
            tilt, turn = math.radians(90 + p["lat"]), lam - math.radians(p["lon"])
            x, y, z = math.cos(turn) * math.cos(phi), math.sin(turn) * math.cos(phi), math.sin(phi)
            return -math.degrees(math.atan2(y, math.cos(tilt) * x + math.sin(tilt) * z)), -math.degrees(math.asin(-math.sin(tilt) * x + math.cos(tilt) * z))
        if self.kind == "lambert":
            n, f, rho0, lam0 = self._cone()
            rho, theta = f / math.tan(math.pi / 4 + phi / 2) ** n, n * math.remainder(lam - lam0, 2 * math.pi)
            return r * rho * math.sin(theta), r * (rho0 - rho * math.cos(theta))
        away, phi1 = lam - math.radians(p["lon"]), math.radians(p["lat"])
        across = math.sin(phi1) * math.sin(phi) + math.cos(phi1) * math.cos(phi) * math.cos(away)
        k = math.sqrt(2 / (1 + across)) if self.kind == "lambert_area" else 2 / (1 + across)
        return r * k * math.cos(phi) * math.sin(away), r * k * (math.cos(phi1) * math.sin(phi) - math.sin(phi1) * math.cos(phi) * math.cos(away))

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Latitude and longitude, the latter in -180 to 180."""
        p = self.params
        if self.kind == "rotated":
            tilt, turn = math.radians(90 + p["lat"]), math.radians(p["lon"])
            lon, lat = F.radians(x), F.radians(y)
            found = -F.asin(math.cos(tilt) * F.sin(lat) - F.cos(lon) * math.sin(tilt) * F.cos(lat))
            around = turn - F.atan2(F.sin(lon), F.tan(lat) * math.sin(tilt) + F.cos(lon) * math.cos(tilt))
            return F.degrees(found), _wrapped(F.degrees(around))
        x, y = x / self.radius, y / self.radius
        if self.kind == "lambert":
            n, f, rho0, lam0 = self._cone()
            sign = 1.0 if n > 0 else -1.0
            rho, theta = sign * F.sqrt(x * x + (rho0 - y) * (rho0 - y)), F.atan2(sign * x, sign * (rho0 - y))
            return F.degrees(2 * F.atan(F.pow(f / rho, F.lit(1 / n))) - math.pi / 2), _wrapped(F.degrees(lam0 + theta / n))
        lam0, phi1 = math.radians(p["lon"]), math.radians(p["lat"])
        far = F.sqrt(x * x + y * y)
        c = 2 * F.asin(far / 2) if self.kind == "lambert_area" else 2 * F.atan(far / 2)
        lat = F.when(far == 0, F.lit(phi1)).otherwise(F.asin(F.cos(c) * math.sin(phi1) + y * F.sin(c) * math.cos(phi1) / far))
        return F.degrees(lat), _wrapped(F.degrees(lam0 + F.atan2(x * F.sin(c), far * math.cos(phi1) * F.cos(c) - y * math.sin(phi1) * F.sin(c))))

    def _cone(self) -> tuple[float, float, float, float]:
        p = self.params
        phi0, phi1, phi2 = (math.radians(p[k]) for k in ("lat0", "lat1", "lat2"))
        up = lambda a: math.tan(math.pi / 4 + a / 2)
        n = math.sin(phi1) if phi1 == phi2 else math.log(math.cos(phi1) / math.cos(phi2)) / math.log(up(phi2) / up(phi1))
        f = math.cos(phi1) * up(phi1) ** n / n
        return n, f, f / up(phi0) ** n, math.radians((p["lon0"] + 180) % 360 - 180)


def _wrapped(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


@dataclass(frozen=True)
class Grid:
    """A grid of nx by ny cells; x0, y0 is the first cell's centre in degrees, or in the projection's metres."""

    domain: str
    nx: int
    ny: int
    x0: float
    y0: float
    dx: float
    dy: float
    projection: Projection | None = None

    @property
    def circles(self) -> bool:
        return self.projection is None and self.nx * self.dx >= 359

    @property
    def reaches_poles(self) -> bool:
        return self.projection is None and self.ny * self.dy >= 179

    def _plane(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        x, y = (lon, lat) if self.projection is None else self.projection.forward(lat, lon)
        return (x - self.x0) / self.dx, (y - self.y0) / self.dy

    def xy(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """Nearest cell by rounding, each null outside. Circular grids take one cell beyond their border."""
        x, y = map(_round, self._plane(lat, lon))
        found_x, found_y = F.when(x.between(0, self.nx - 1), x), F.when(y.between(0, self.ny - 1), y)
        if self.circles:
            found_x = found_x.when(x == -1, F.lit(0)).when(x.isin(self.nx, self.nx + 1), F.lit(self.nx - 1))
        if self.reaches_poles:
            found_y = found_y.when(y == -1, F.lit(0)).when(y == self.ny, F.lit(self.ny - 1))
        return found_x, found_y

    def cell(self, lat: Column, lon: Column) -> Column:
        x, y = self.xy(lat, lon)
        return y * self.nx + x

    def coordinates(self, cell: Column) -> tuple[Column, Column]:
        x, y = (cell % self.nx) * self.dx + self.x0, F.floor(cell / self.nx) * self.dy + self.y0
        return (y, x) if self.projection is None else self.projection.inverse(x, y)

    def true_north(self, cell: Column) -> Column:
        """Degrees between the grid's y axis and the pole."""
        px, py = self._plane(F.lit(90.0), F.lit(0.0))
        return F.degrees(F.atan2(px - cell % self.nx, py - F.floor(cell / self.nx)))

    def cells(self, spark: SparkSession) -> DataFrame:
        """cell_id, x, y, lat, lon of all cells."""
        lat, lon = self.coordinates(F.col("id"))
        return spark.range(self.nx * self.ny).select(F.lit(self.domain).alias("domain"), F.col("id").alias("cell_id"), (F.col("id") % self.nx).alias("x"), F.floor(F.col("id") / self.nx).alias("y"), lat.alias("lat"), lon.alias("lon"))


def locate(places: DataFrame, grid: Grid, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add domain and cell_id; places outside of the grid go. Serves regular and projected grids."""
    return places.withColumns({"domain": F.lit(grid.domain), "cell_id": grid.cell(F.col(lat), F.col(lon))}).where("cell_id IS NOT NULL")


def octahedral_rows(spark: SparkSession, lines: int) -> DataFrame:
    """Rows of an octahedral reduced Gaussian grid with `lines` latitudes a hemisphere: y, nx, first cell, lat."""
    dy = 180 / (2 * lines + 0.5)
    y = F.col("id")
    nx = F.when(y < lines, 20 + 4 * y).otherwise((2 * lines - y - 1) * 4 + 20)
    back = 2 * lines - y
    first = F.when(y < lines, 2 * y * y + 18 * y).otherwise(4 * lines * (lines + 9) - (2 * back * back + 18 * back))
    return spark.range(2 * lines).select(y.alias("y"), nx.alias("nx"), first.alias("first"), ((lines - y - 1) * dy + dy / 2).alias("row_lat"))


def rows_from_counts(spark: SparkSession, counts: list[int]) -> DataFrame:
    """Rows of a reduced Gaussian grid from the cells of each northern latitude, given as a parameter."""
    lines, total = len(counts), 0
    dy, rows = 180 / (2 * len(counts) + 0.5), []
    for y, nx in enumerate([*counts, *counts[::-1]]):
        rows.append((y, nx, total, (lines - y - 1) * dy + dy / 2))
        total += nx
    return spark.createDataFrame(rows, "y bigint, nx bigint, first bigint, row_lat double")


def locate_gaussian(places: DataFrame, rows: DataFrame, lines: int, key: str, domain: str = "gaussian", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add domain and cell_id: the nearer of the nearest cells in the two rows around the place.

    rows has 2 * lines entries (2,560 for the finest grids), so it is broadcast; another number of rows is an error.
    """
    if rows.count() != 2 * lines:
        raise ValueError(f"rows of {2 * lines} latitudes are needed")
    dy = 180 / (2 * lines + 0.5)
    upper = F.greatest(F.lit(0), F.least(F.lit(2 * lines - 2), (lines - 1 - (F.col(lat) - dy / 2) / dy).cast("long")))
    near = places.withColumn("y", F.explode(F.array(upper, upper + 1))).join(F.broadcast(rows), "y")
    step = F.lit(360.0) / F.col("nx")
    x = _round(F.col(lon) / step)
    away = F.pow(F.col("row_lat") - F.col(lat), F.lit(2.0)) + F.pow(x * step - F.col(lon), F.lit(2.0))
    cell = F.col("first") + F.pmod(x, F.col("nx"))
    best = near.groupBy(key).agg(F.min_by(cell, F.struct(away, -F.col("y"))).alias("cell_id"))
    return places.join(best, key).withColumn("domain", F.lit(domain))


def neighbourhood(places: DataFrame, grid: Grid, radius: int = 1) -> DataFrame:
    """A row for each cell up to radius away from a located place's cell: near_id, and whether it is the centre."""
    x, y = F.col("cell_id") % grid.nx, F.floor(F.col("cell_id") / grid.nx)
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    spread = places.withColumn("_sx", F.explode(steps)).withColumn("_sy", F.explode(steps)).withColumns({"_x": x + F.col("_sx"), "_y": y + F.col("_sy")})
    inside = spread.where(f"_x >= 0 AND _x < {grid.nx} AND _y >= 0 AND _y < {grid.ny}")
    return inside.withColumns({"near_id": F.col("_y") * grid.nx + F.col("_x"), "centre": (F.col("_sx") == 0) & (F.col("_sy") == 0)}).drop("_sx", "_sy", "_x", "_y")


def _beside(places: DataFrame, cells: DataFrame, grid: Grid, radius: int, lat: str, lon: str) -> DataFrame:
    near = neighbourhood(locate(places, grid, lat, lon), grid, radius)
    here = cells.select(F.col("cell_id").alias("near_id"), F.col("elevation").alias("near_elevation"))
    cell_lat, cell_lon = grid.coordinates(F.col("near_id"))
    away = F.pow(cell_lat - F.col(lat), F.lit(2.0)) + F.pow(cell_lon - F.col(lon), F.lit(2.0))
    return near.join(here, "near_id").withColumn("_away", away)


def nearest_cell(places: DataFrame, cells: DataFrame, grid: Grid, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The place's own cell with its elevation; cells without data don't match."""
    here = cells.where("elevation IS NOT NULL").select("cell_id", F.col("elevation").alias("cell_elevation"))
    return locate(places, grid, lat, lon).join(here, "cell_id")


def best_terrain_cell(places: DataFrame, cells: DataFrame, grid: Grid, key: str, radius: int = 1, lat: str = "lat", lon: str = "lon", elevation: str = "elevation") -> DataFrame:
    """key, cell_id, cell_elevation: the centre within 100 m of the wanted height, else the neighbour with the least
    difference plus 30 m a kilometre, within 50 km, if below 1500 m; else the centre. Sea (-999) is skipped."""
    near = _beside(places, cells, grid, radius, lat, lon)
    kilometres = F.sqrt("_away") * 111
    height = F.col("near_elevation")
    off = F.abs(height - F.col(elevation))
    score = F.when(height >= 9999, F.lit(0.0)).otherwise(off) + kilometres * 30
    fits = height.isNotNull() & (height > -999) & (kilometres < 50)
    best = near.groupBy(key).agg(
        F.max(F.when(F.col("centre"), F.struct("near_id", "near_elevation", off.alias("off")))).alias("c"),
        F.min(F.when(fits, F.struct(score.alias("score"), F.col("near_id"), F.col("near_elevation")))).alias("b"),
    )
    take = (F.col("c.off") > 100) & (F.col("b.score") < F.col("c.off")) & (F.col("b.score") <= 1500)
    take = F.coalesce(take, F.col("c.near_elevation").isNull() & F.col("b.score").isNotNull() & (F.col("b.score") <= 1500), F.lit(False))
    pick = lambda name: F.when(take, F.col(f"b.{name}")).otherwise(F.col(f"c.{name}"))
    return best.select(key, pick("near_id").alias("cell_id"), pick("near_elevation").alias("cell_elevation")).where("cell_elevation IS NOT NULL")


def nearest_sea_cell(places: DataFrame, cells: DataFrame, grid: Grid, key: str, radius: int = 1, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """key, cell_id, sea: the centre if it is sea, else the nearest sea cell around, else the centre."""
    near = _beside(places, cells, grid, radius, lat, lon)
    sea = F.col("near_elevation") <= -999
    best = near.groupBy(key).agg(
        F.max(F.when(F.col("centre"), F.col("near_id"))).alias("c"),
        F.min(F.when(sea, F.struct(F.when(F.col("centre"), F.lit(-1.0)).otherwise(F.col("_away")).alias("away"), "near_id"))).alias("b"),
    )
    return best.select(key, F.coalesce("b.near_id", "c").alias("cell_id"), F.col("b").isNotNull().alias("sea"))


def bilinear_at(places: DataFrame, cells: DataFrame, grid: Grid, key: str, value: str, skip_missing: bool = True, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """key and value between the four cells around; missing corners are left out, or make the result null."""
    fx, fy = grid._plane(F.col(lat), F.col(lon))
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    spread = places.select(key, fx.alias("_fx"), fy.alias("_fy")).withColumn("_c", F.explode(corners))
    x, y = F.floor("_fx") + F.col("_c.a"), F.floor("_fy") + F.col("_c.b")
    share = lambda f, side: F.when(side == 1, f - F.floor(f)).otherwise(1 - (f - F.floor(f)))
    weight = share(F.col("_fx"), F.col("_c.a")) * share(F.col("_fy"), F.col("_c.b"))
    inside = (x >= 0) & (x < grid.nx) & (y >= 0) & (y < grid.ny)
    spread = spread.select(key, F.when(inside, y * grid.nx + x).alias("cell_id"), weight.alias("_w"))
    joined = spread.join(cells.select("cell_id", F.col(value).alias("_v")), "cell_id", "left")
    there = F.when(F.col("_v").isNotNull(), F.col("_w"))
    mean = F.when(F.sum(there) > 0, F.sum(F.col("_v") * F.col("_w")) / F.sum(there))
    if not skip_missing:
        mean = F.when(F.count(F.when(F.col("_w") > 0, F.col("_v"))) == F.count(F.when(F.col("_w") > 0, 1)), mean)
    return joined.groupBy(key).agg(mean.alias(value))


def filter_bounding_box(cells: DataFrame, grid: Grid, south: float, west: float, north: float, east: float) -> DataFrame:
    """Cells of a box, half open in cell numbers: the upper row and column are left out. Boxes must be ordered."""
    if not (-90 <= south < north <= 90 and -180 <= west < east <= 180):
        raise ValueError(f"not a box: {south}, {west}, {north}, {east}")
    if grid.projection is None:
        xs = [_round((F.lit(v) - grid.x0) / grid.dx) for v in (west, east)]
        ys = [_round((F.lit(v) - grid.y0) / grid.dy) for v in (south, north)]
        low, high = F.least(*ys), F.greatest(*ys)
        fits = (xs[0] >= 0) & (xs[1] <= grid.nx) & (low >= 0) & (high <= grid.ny)
        return cells.where(fits & (F.col("x") >= xs[0]) & (F.col("x") < xs[1]) & (F.col("y") >= low) & (F.col("y") < high))
    corner = {n: grid.xy(F.lit(a), F.lit(b)) for n, a, b in (("sw", south, west), ("se", south, east), ("nw", north, west), ("ne", north, east))}
    x1, x2 = F.least(corner["sw"][0], corner["nw"][0]), F.greatest(corner["se"][0], corner["ne"][0])
    y1, y2 = F.least(corner["sw"][1], corner["nw"][1]), F.greatest(corner["se"][1], corner["ne"][1])
    known = corner["sw"][0].isNotNull() & corner["se"][0].isNotNull() & corner["nw"][0].isNotNull() & corner["ne"][0].isNotNull()
    return cells.where(known & (F.col("x") >= x1) & (F.col("x") < x2) & (F.col("y") >= y1) & (F.col("y") < y2))


def box_is_covered(spark: SparkSession, grid: Grid, south: float, west: float, north: float, east: float) -> DataFrame:
    """One row: whether all four corners lie on the grid."""
    corners = [grid.cell(F.lit(float(a)), F.lit(float(b))).isNotNull() for a in (south, north) for b in (west, east)]
    return spark.range(1).select((corners[0] & corners[1] & corners[2] & corners[3]).alias("covered"))


def require_full_cover(boxes: DataFrame, grid: Grid) -> DataFrame:
    """Boxes (south, west, north, east) whose four corners all lie on the grid."""
    corners = [grid.cell(F.col(a), F.col(b)).isNotNull() for a in ("south", "north") for b in ("west", "east")]
    return boxes.where(corners[0] & corners[1] & corners[2] & corners[3])


def drop_open_sea(cells: DataFrame, radius: int = 1) -> DataFrame:
    """Cells of the domain without those whose whole neighbourhood is sea."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    land = cells.where("elevation > -999").select("domain", F.col("x").alias("_x0"), F.col("y").alias("_y0"))
    around = land.withColumn("_a", F.explode(steps)).withColumn("_b", F.explode(steps)).select("domain", (F.col("_x0") + F.col("_a")).alias("x"), (F.col("_y0") + F.col("_b")).alias("y")).distinct()
    return cells.join(around, ["domain", "x", "y"], "left_semi")


def normalise_orientation(raw: DataFrame, nx: int, ny: int, from_greenwich: bool = False, north_first: bool = False, alternating: bool = False) -> DataFrame:
    """Columns x, y of provider fields as west to east from -180, south to north, all rows in one direction."""
    x, y = F.col("x"), F.col("y")
    if alternating:
        x = F.when(y % 2 == 1, nx - 1 - x).otherwise(x)
    if from_greenwich:
        x = F.pmod(x + nx // 2, F.lit(nx))
    if north_first:
        y = ny - 1 - y
    return raw.withColumns({"x": x, "y": y})


def build_static_table(elevation: DataFrame, landmask: DataFrame) -> DataFrame:
    """Elevation by cell, -999 where the mask is below one half or missing. Heights from 9000 m on are an error."""
    joined = elevation.join(landmask, ["domain", "cell_id"], "left")
    fine = F.when(F.col("elevation") >= 9000, F.raise_error(F.lit("elevation above 9000 m"))).otherwise(F.col("elevation"))
    sea = F.col("landmask").isNull() | (F.col("landmask") < 0.5)
    return joined.withColumn("elevation", F.when(sea, F.lit(-999.0)).otherwise(fine.cast("double"))).drop("landmask")


def remap_cells(series: DataFrame, mapping: DataFrame) -> DataFrame:
    """Values of source cells on target cells; targets without a source are null."""
    return mapping.join(series.withColumnRenamed("cell_id", "source_cell"), "source_cell", "left").drop("source_cell").withColumnRenamed("target_cell", "cell_id")


def read_elevation(places: DataFrame, heights: DataFrame, rows_per_degree: int = 1200, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add elevation from a height model whose columns get fewer toward the poles: (lat_band, row, col, height)."""
    band = F.floor(F.col(lat)).cast("int")
    polar = F.abs(F.when(band < 0, band + 1).otherwise(band))
    columns = F.when(polar >= 85, rows_per_degree // 10).when(polar >= 80, rows_per_degree // 5).when(polar >= 70, rows_per_degree // 3).when(polar >= 60, rows_per_degree // 2).when(polar >= 50, rows_per_degree * 2 // 3).otherwise(rows_per_degree)
    row = F.floor((F.col(lat) - band) * rows_per_degree).cast("int")
    column = F.floor((F.col(lon) + 180) * columns).cast("long")
    keyed = places.withColumns({"lat_band": band, "row": row, "col": column})
    return keyed.join(heights.select("lat_band", "row", "col", F.col("height").alias("elevation")), ["lat_band", "row", "col"], "left").drop("lat_band", "row", "col")


def in_region(lat: Column, lon: Column, box: tuple[float, float, float, float], outside: list[tuple[float, float]] | None = None) -> Column:
    """In a box (south, west, north, east) but not in a triangle of (lat, lon) corners."""
    south, west, north, east = box
    found = (lat >= south) & (lat <= north) & (lon >= west) & (lon <= east)
    if not outside:
        return found
    sides = []
    for (a, b), (c, d) in zip(outside, outside[1:] + outside[:1]):
        sides.append((col(lon) - b) * (c - a) - (col(lat) - a) * (d - b))
    left = (sides[0] >= 0) & (sides[1] >= 0) & (sides[2] >= 0)
    right = (sides[0] <= 0) & (sides[1] <= 0) & (sides[2] <= 0)
    return found & ~(left | right)
