"""Geographic scalar functions: quadkeys, web-map tiles, UTM by the Krueger series, CRS names."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid and the fourth-order Krueger coefficients in n.
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
          13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
          61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280]
_BETA = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
         _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
         17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280]
_DELTA = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
          7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
          56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630]
_K0, _E0 = 0.9996, 500000.0
EDGE = 20037508.342789244

CRS_ALIASES = {"OGC:CRS84": "EPSG:4326", "CRS84": "EPSG:4326", "WGS84": "EPSG:4326"}


def to_utm(lon: Column, lat: Column, zone: int, south: bool) -> Column:
    """Longitude/latitude in degrees to UTM metres."""
    lam = F.radians(lon - (zone * 6 - 183))
    phi = F.radians(lat)
    e = 2 * _N**0.5 / (1 + _N)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((_E0 + _K0 * _R * east).alias("x"),
                    ((10_000_000.0 if south else 0.0) + _K0 * _R * north).alias("y"))


def from_utm(x: Column, y: Column, zone: int, south: bool) -> Column:
    """UTM metres to longitude/latitude in degrees."""
    xi = (y - (10_000_000.0 if south else 0.0)) / (_K0 * _R)
    eta = (x - _E0) / (_K0 * _R)
    xp, ep = xi, eta
    for j, b in enumerate(_BETA, 1):
        xp = xp - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        ep = ep - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xp) / F.cosh(ep))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.struct((F.degrees(F.atan2(F.sinh(ep), F.cos(xp))) + (zone * 6 - 183)).alias("lon"),
                    F.degrees(lat).alias("lat"))


def project_rings(rings: Column, zone: int, south: bool) -> Column:
    """Longitude/latitude rings (x = lon, y = lat) to UTM rings."""
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: to_utm(p.x, p.y, zone, south)))


def unproject_rings(rings: Column, zone: int, south: bool) -> Column:
    def point(p):
        q = from_utm(p.x, p.y, zone, south)
        return F.struct(q.lon.alias("x"), q.lat.alias("y"))
    return F.transform(rings, lambda ring: F.transform(ring, point))


def mercator_unit(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Position in the unit web-mercator square, origin at the north-west corner."""
    s = F.sin(F.radians(lat))
    return (lon + 180) / 360, F.lit(0.5) - F.ln((1 + s) / (1 - s)) / (4 * F.pi())


def web_tile(lon: Column, lat: Column, z: int) -> Column:
    u, v = mercator_unit(lon, lat)
    n = 2 ** z
    return F.struct(F.lit(z).alias("z"), F.floor(u * n).cast("long").alias("x"), F.floor(v * n).cast("long").alias("y"))


def tile_bounds(z: Column, x: Column, y: Column) -> Column:
    """Web-mercator metre bounds of a tile."""
    step = F.lit(2 * EDGE) / F.pow(F.lit(2.0), z)
    return F.struct((x * step - EDGE).alias("xmin"), (EDGE - (y + 1) * step).alias("ymin"),
                    ((x + 1) * step - EDGE).alias("xmax"), (EDGE - y * step).alias("ymax"))


def quadkey(lon: Column, lat: Column, z: int) -> Column:
    return tile_quadkey(web_tile(lon, lat, z), z)


def tile_quadkey(t: Column, z: int) -> Column:
    """Quadkey of a tile struct (x, y)."""
    digits = F.transform(F.sequence(F.lit(z - 1), F.lit(0), F.lit(-1)), lambda i: (
        F.call_function("getbit", t.x, i).cast("int") + 2 * F.call_function("getbit", t.y, i).cast("int")).cast("string"))
    return F.array_join(digits, "")


def area_quadkeys(spark, west: float, south: float, east: float, north: float, z: int):
    """``quadkey`` of every tile that meets an area: the whole tile range, made by the cluster."""
    corners = spark.range(1).select(web_tile(F.lit(west), F.lit(north), z).alias("a"), web_tile(F.lit(east), F.lit(south), z).alias("b"))
    rows = corners.select("a", "b", F.explode(F.sequence("a.y", "b.y")).alias("y"))
    return rows.select(F.explode(F.sequence("a.x", "b.x")).alias("x"), "y").select(tile_quadkey(F.struct("x", "y"), z).alias("quadkey"))


def normalise_crs(crs: Column, allowed: list[str]) -> Column:
    """Alias to a canonical name; NULL when it is not in the allow list (blank means EPSG:4326)."""
    raw = F.trim(F.coalesce(F.nullif(F.trim(crs), F.lit("")), F.lit("EPSG:4326")))
    table = F.create_map(*[F.lit(v) for kv in CRS_ALIASES.items() for v in kv])
    name = F.coalesce(F.try_element_at(table, F.upper(raw)), F.upper(raw))
    return F.when(name.isin(allowed), name)
