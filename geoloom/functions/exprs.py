"""Column expressions: filter operators with the engine's null rules, strings, times, geometry on the sphere and the plane."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FILTERS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "not_in", "contains", "exists", "between")
NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint")


WHOLE = ("int", "bigint", "smallint", "tinyint")


def _literal(value, kind: str) -> Column | None:
    """The value as the column's type, so that a scan can take the filter; None where no value of that type equals it."""
    if kind.startswith("array"):
        return F.array(*(F.lit(v) for v in value)).cast(kind) if isinstance(value, (list, tuple)) and all(isinstance(v, str) for v in value) else None
    if kind == "boolean":
        return F.lit(bool(value)) if isinstance(value, (bool, int, float)) and value in (0, 1) else None
    if kind in NUMERIC:
        if not isinstance(value, (bool, int, float)) or (kind in WHOLE and value != int(value)):
            return None
        return F.lit(int(value) if kind in WHOLE else float(value))
    return F.lit(value) if isinstance(value, str) else None


def _limit(col: Column, kind: str, value) -> tuple[Column, Column]:
    """Both sides of a comparison by size, as numbers; what is no number is null."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        number = None
    if kind.startswith(("array", "struct", "map")):
        return F.lit(None).cast("double"), F.lit(number).cast("double")
    if kind in WHOLE and number is not None and number == int(number):
        return col, F.lit(int(number))
    side = col if kind in ("double", "float") else col.cast("double") if kind in NUMERIC or kind == "boolean" else col.try_cast("double")
    return side, F.lit(number).cast("double")


def predicate(col: Column, kind: str, op: str, value=None, total: bool = True) -> Column:
    """True or false, and null (which WHERE takes for false) only without ``total``: on null every operator but ``exists`` is false."""
    if op == "exists":
        return col.isNotNull()
    if op in ("eq", "ne"):
        wanted = _literal(value, kind)
        test = col == wanted if wanted is not None else F.lit(False)
        test = test if op == "eq" else col != wanted if wanted is not None else col.isNotNull()
    elif op in ("in", "not_in"):
        wanted = [x for x in (_literal(v, kind) for v in value) if x is not None]
        test = col.isin(*wanted) if wanted else F.lit(False)
        test = test if op == "in" else ~test if wanted else col.isNotNull()
    elif op == "contains":
        text = str(value).lower()
        test = F.exists(col, lambda x: F.contains(F.lower(x.cast("string")), F.lit(text))) if kind.startswith("array") else F.contains(F.lower(col.cast("string")), F.lit(text))
    elif op == "between":
        (a, low), (b, high) = _limit(col, kind, value[0]), _limit(col, kind, value[1])
        test = (a >= low) & (b <= high)
    else:
        side, limit = _limit(col, kind, value)
        test = {"gt": side > limit, "gte": side >= limit, "lt": side < limit, "lte": side <= limit}[op]
    return F.coalesce(test, F.lit(False)) if total else test


# Strings


# Words that stand for a missing name.
NULL_LIKE = ("", "nan", "none", "null", "-")


def normalize_name(c: Column) -> Column:
    """Trimmed, blanks collapsed; empty and null-like words give null."""
    text = F.regexp_replace(F.trim(c), r"\s+", " ")
    return F.when(F.lower(text).isin(*NULL_LIKE), None).otherwise(text)


def name_key(c: Column) -> Column:
    """For comparing names: lower case, accents of Latin letters dropped, only letters and digits."""
    plain = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(plain, "[^a-z0-9]", "")


def safe_id(*parts: Column) -> Column:
    return F.regexp_replace(F.concat_ws(":", *parts), "[^A-Za-z0-9:_.-]+", "-")


def first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cols))


def position_id(*cols: Column) -> Column:
    """An id from a position: the first ten hex digits of a SHA-1."""
    return F.substring(F.sha1(F.concat_ws(",", *(c.cast("string") for c in cols))), 1, 10)


# Times of a service day, in seconds that may pass 86,400


def parse_service_time(c: Column) -> Column:
    ok = F.regexp_like(F.trim(c), F.lit(r"^[0-9]{1,3}:[0-5]?[0-9]:[0-5]?[0-9]$"))
    part = F.split(F.trim(c), ":")
    number = [F.try_element_at(part, F.lit(i)).try_cast("int") for i in (1, 2, 3)]
    return F.when(ok, number[0] * 3600 + number[1] * 60 + number[2])


def format_service_time(c: Column) -> Column:
    s = F.abs(c)
    return F.when(c.isNotNull(), F.concat(F.when(c < 0, "-").otherwise(""), F.format_string("%02d:%02d:%02d", (s / 3600).cast("int"), ((s % 3600) / 60).cast("int"), (s % 60).cast("int"))))


def parse_service_date(c: Column) -> Column:
    """yyyyMMdd between 1900 and 2100, else null."""
    d = F.try_to_date(F.when(F.regexp_like(c, F.lit("^[0-9]{8}$")), c), "yyyyMMdd")
    return F.when(F.year(d).between(1900, 2100), d)


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


# Geometry

EARTH_M = 6_371_000.0


def in_range(lon: Column, lat: Column) -> Column:
    """Usable degrees: numbers, no NaN, within the globe."""
    return F.coalesce(~F.isnan(lon) & ~F.isnan(lat) & lon.between(-180, 180) & lat.between(-90, 90), F.lit(False))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def to_lv95(lon: Column, lat: Column) -> tuple[Column, Column]:
    """East and north in metres by the survey office's published approximation (about a metre)."""
    p, q = (lat * 3600 - 169028.66) / 10000, (lon * 3600 - 26782.5) / 10000
    east = 2600072.37 + 211455.93 * q - 10938.51 * q * p - 0.36 * q * p * p - 44.54 * q * q * q
    north = 1200147.07 + 308807.95 * p + 3745.25 * q * q + 76.63 * p * p - 194.56 * q * q * p + 119.79 * p * p * p
    return east, north


def from_lv95(east: Column, north: Column) -> tuple[Column, Column]:
    y, x = (east - 2600000) / 1e6, (north - 1200000) / 1e6
    lon = 2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * x * x - 0.0436 * y * y * y
    lat = 16.9023892 + 3.238272 * x - 0.270978 * y * y - 0.002528 * x * x - 0.0447 * y * y * x - 0.0140 * x * x * x
    return lon * 100 / 36, lat * 100 / 36


def ring_area(ring: Column) -> Column:
    """Area of a closed ring of points (x, y) by the shoelace formula."""
    turns = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(turns, F.lit(0.0), lambda s, v: s + v)) / 2


def edges_of(ring: Column) -> Column:
    n = F.size(ring) - 1
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def on_boundary(x: Column, y: Column, ring: Column) -> Column:
    def on(e):
        a, b = e["a"], e["b"]
        turn = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return (turn == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return F.exists(edges_of(ring), on)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule; what lies on the boundary may come out either way."""

    def crosses(e):
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return F.size(F.filter(edges_of(ring), lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def inside(x: Column, y: Column, ring: Column, boundary: bool = False) -> Column:
    edge = on_boundary(x, y, ring)
    return (in_ring(x, y, ring) | edge) if boundary else (in_ring(x, y, ring) & ~edge)


def crosses_ring(ax: Column, ay: Column, bx: Column, by: Column, ring: Column) -> Column:
    """Whether a segment crosses or touches a side of the ring."""

    def side(px, py, qx, qy, x, y):
        return F.signum((qx - px) * (y - py) - (qy - py) * (x - px))

    def meets(e):
        a, b = e["a"], e["b"]
        apart = side(ax, ay, bx, by, a["x"], a["y"]) * side(ax, ay, bx, by, b["x"], b["y"]) <= 0
        boxes = (F.least(ax, bx) <= F.greatest(a["x"], b["x"])) & (F.least(a["x"], b["x"]) <= F.greatest(ax, bx)) & (F.least(ay, by) <= F.greatest(a["y"], b["y"])) & (F.least(a["y"], b["y"]) <= F.greatest(ay, by))
        return apart & (side(a["x"], a["y"], b["x"], b["y"], ax, ay) * side(a["x"], a["y"], b["x"], b["y"], bx, by) <= 0) & boxes

    return F.exists(edges_of(ring), meets)


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Centre of mass of a closed ring; of one without area the mean of its corners."""
    n = F.size(ring) - 1
    turn = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    sides = F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.struct(turn(a, b).alias("t"), ((a["x"] + b["x"]) * turn(a, b)).alias("x"), ((a["y"] + b["y"]) * turn(a, b)).alias("y"), a["x"].alias("px"), a["y"].alias("py")))
    total = lambda f: F.aggregate(F.transform(sides, lambda s: s[f]), F.lit(0.0), lambda s, v: s + v)
    whole = F.nullif(total("t"), F.lit(0.0))
    return F.coalesce(total("x") / (3 * whole), total("px") / n), F.coalesce(total("y") / (3 * whole), total("py") / n)


def iso_date(c: Column) -> Column:
    """yyyyMMdd with dashes; other texts as they are, empty ones null."""
    return F.nullif(F.when(F.regexp_like(c, F.lit("^[0-9]{8}$")), F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))).otherwise(c), F.lit(""))


def circle_ring(x: Column, y: Column, radius: Column, sides: int = 64) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(sides)), lambda i: F.struct((x + radius * F.cos(i * 2 * math.pi / sides)).alias("x"), (y + radius * F.sin(i * 2 * math.pi / sides)).alias("y")))


def snap_quality(distance: Column, poor: float = 150.0, most: float = 500.0) -> Column:
    return F.when(distance <= poor, "good").when(distance <= most, "poor").otherwise("unreachable")


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(part / F.nullif(whole.cast("double"), F.lit(0.0)), digits)
