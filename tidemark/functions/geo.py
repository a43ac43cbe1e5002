"""Spherical geometry as column expressions. Angles are degrees unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants.
EARTH_RADIUS = 6.37122e6
OMEGA = 7.2921e-5
GRAVITY = 9.80616
KNOTS = 1.94384


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def great_circle(lon1, lat1, lon2, lat2) -> Column:
    """Angle between two points by the spherical law of cosines."""
    a, b = F.radians(c(lat1)), F.radians(c(lat2))
    return F.degrees(F.acos(clamp(F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(c(lon2) - c(lon1))))))


def xyz(lon, lat) -> tuple[Column, Column, Column]:
    """Unit vector of a point."""
    x, y = F.radians(c(lon)), F.radians(c(lat))
    return F.cos(x) * F.cos(y), F.sin(x) * F.cos(y), F.sin(y)


def lon_lat(x, y, z) -> tuple[Column, Column]:
    """Point of a vector; longitude in [0, 360)."""
    r = F.sqrt(c(x) * c(x) + c(y) * c(y) + c(z) * c(z))
    return norm_lon(F.degrees(F.atan2(c(y), c(x)))), F.degrees(F.asin(clamp(c(z) / r)))


def chord_of_angle(angle) -> Column:
    return 2 * F.sin(F.radians(c(angle)) / 2)


def angle_of_chord(chord) -> Column:
    return F.degrees(2 * F.asin(clamp(c(chord) / 2)))


def norm_lon(lon) -> Column:
    """Longitude in [0, 360)."""
    x = c(lon) - 360 * F.floor(c(lon) / 360)
    return F.when(x >= 360, 0.0).otherwise(x)


def lon_difference(a, b) -> Column:
    """a - b on the circle, in [-180, 180)."""
    return norm_lon(c(a) - c(b) + 180) - 180


def mid_lon(a, b) -> Column:
    """Middle of the shorter arc between two longitudes."""
    return norm_lon(c(a) + lon_difference(b, a) / 2)


def stereographic(lon, lat, lon0, lat0) -> tuple[Column, Column]:
    """Plane coordinates of a point about a centre (unit sphere)."""
    x, y, x0, y0 = (F.radians(c(v)) for v in (lon, lat, lon0, lat0))
    k = 2 / (1 + F.sin(y0) * F.sin(y) + F.cos(y0) * F.cos(y) * F.cos(x - x0))
    return k * F.cos(y) * F.sin(x - x0), k * (F.cos(y0) * F.sin(y) - F.sin(y0) * F.cos(y) * F.cos(x - x0))


def stereographic_inverse(px, py, lon0, lat0) -> tuple[Column, Column]:
    """Point whose plane coordinates about a centre these are."""
    x0, y0, a, b = F.radians(c(lon0)), F.radians(c(lat0)), c(px), c(py)
    rho = F.sqrt(a * a + b * b)
    arc = 2 * F.atan(rho / 2)
    lat = F.when(rho == 0, y0).otherwise(F.asin(clamp(F.cos(arc) * F.sin(y0) + b * F.sin(arc) * F.cos(y0) / rho)))
    lon = F.when(rho == 0, x0).otherwise(x0 + F.atan2(a * F.sin(arc), rho * F.cos(y0) * F.cos(arc) - b * F.sin(y0) * F.sin(arc)))
    return norm_lon(F.degrees(lon)), F.degrees(lat)


def direction(lon1, lat1, lon2, lat2) -> tuple[Column, Column]:
    """(east, north) of the great circle from one point to another; its length is the arc in
    radians. Both are 0 between equal points."""
    arc = F.radians(great_circle(lon1, lat1, lon2, lat2))
    y1, y2, d = F.radians(c(lat1)), F.radians(c(lat2)), F.radians(c(lon2) - c(lon1))
    east, north = F.cos(y2) * F.sin(d), F.cos(y1) * F.sin(y2) - F.sin(y1) * F.cos(y2) * F.cos(d)
    size = F.sqrt(east * east + north * north)
    return tuple(F.when(size > 1e-12, arc * v / size).otherwise(0.0) for v in (east, north))


def wind_xyz(u, v, lon, lat) -> tuple[Column, Column, Column]:
    """Cartesian vector of an (east, north) vector at a point."""
    x, y = F.radians(c(lon)), F.radians(c(lat))
    return -c(u) * F.sin(x) - c(v) * F.cos(x) * F.sin(y), c(u) * F.cos(x) - c(v) * F.sin(x) * F.sin(y), c(v) * F.cos(y)


def in_box(lon, lat, lon0, lon1, lat0, lat1) -> Column:
    """Whether a point is in a box that may wrap round longitude 0 (lon0 > lon1)."""
    a, b, x = norm_lon(lon0), norm_lon(lon1), norm_lon(lon)
    across = F.when(a <= b, (x >= a) & (x <= b)).otherwise((x >= a) | (x <= b))
    return across & (c(lat) >= c(lat0)) & (c(lat) <= c(lat1))


def boxes_overlap(a: tuple, b: tuple) -> Column:
    """Whether two (lon0, lon1, lat0, lat1) boxes meet; either may wrap round longitude 0."""
    inside = lambda x, box: F.when(c(box[0]) <= c(box[1]), (c(x) >= c(box[0])) & (c(x) <= c(box[1]))).otherwise((c(x) >= c(box[0])) | (c(x) <= c(box[1])))
    return (inside(a[0], b) | inside(b[0], a)) & (c(a[2]) <= c(b[3])) & (c(b[2]) <= c(a[3]))


def in_polygon(lon, lat, corners) -> Column:
    """Even-odd test against an array of (lon, lat) structs; unwrapped about the first corner."""
    ring, x0 = c(corners), c(corners)[0]["lon"]
    x, y = lon_difference(lon, x0), c(lat)
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        p, q = F.element_at(ring, (i + 1).cast("int")), F.element_at(ring, ((i + 1) % n + 1).cast("int"))
        px, qx = lon_difference(p["lon"], x0), lon_difference(q["lon"], x0)
        return F.when(((p["lat"] > y) != (q["lat"] > y)) & (x < (qx - px) * (y - p["lat"]) / (q["lat"] - p["lat"]) + px), 1).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crosses), F.lit(0), lambda s, v: s + v) % 2 == 1
