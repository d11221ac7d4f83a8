"""Geohashes, Z-order, great-circle distances, boxes and covers as column expressions."""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column
from pyspark.sql import functions as F

# The geohash alphabet and the two Earth radii in metres.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
RADIUS = 6371008.8            # distance operator
INDEX_RADIUS = 6371000.0      # spatial index queries
MAX_COVER = 50_000


class CoverTooLarge(ValueError):
    pass


def _cell(value: Column, low: float, high: float, bits: int) -> Column:
    """The number of the cell that holds value when low..high is halved bits times."""
    cells = 1 << bits
    at = F.floor((value.cast("double") - low) / F.lit((high - low) / cells))
    return F.least(F.greatest(at, F.lit(0)), F.lit(cells - 1)).cast("long")


def geohash(lat: Column, lon: Column, precision: int) -> Column:
    """Base-32 geohash of 1 to 12 characters; null outside the globe."""
    if not 1 <= precision <= 12:
        raise ValueError("a geohash has 1 to 12 characters")
    bits = 5 * precision
    x, y = _cell(lon, -180, 180, (bits + 1) // 2), _cell(lat, -90, 90, bits // 2)
    letters = []
    for i in range(precision):
        index = F.lit(0).cast("long")
        for b in range(5 * i, 5 * i + 5):
            # even places come from the longitude, odd ones from the latitude, highest first
            source, width = (x, (bits + 1) // 2) if b % 2 == 0 else (y, bits // 2)
            index = index * 2 + F.shiftright(source, width - 1 - b // 2).bitwiseAND(F.lit(1))
        letters.append(F.substring(F.lit(BASE32), (index + 1).cast("int"), F.lit(1)))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.concat(*letters))


def cell_bounds(code: str) -> tuple[float, float, float, float]:
    """min lat, min lon, max lat, max lon of a geohash cell."""
    box = {0: [-180.0, 180.0], 1: [-90.0, 90.0]}
    turn = 0
    for letter in code:
        n = BASE32.index(letter)
        for b in (16, 8, 4, 2, 1):
            low, high = box[turn]
            box[turn] = [(low + high) / 2, high] if n & b else [low, (low + high) / 2]
            turn = 1 - turn
    return box[1][0], box[0][0], box[1][1], box[0][1]


def geohash_of(lat: float, lon: float, precision: int) -> str:
    """The same for one point, on the driver."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    x = min((1 << nx) - 1, max(0, math.floor((lon + 180) / 360 * (1 << nx))))
    y = min((1 << ny) - 1, max(0, math.floor((lat + 90) / 180 * (1 << ny))))
    bit = [(x >> (nx - 1 - b // 2)) & 1 if b % 2 == 0 else (y >> (ny - 1 - b // 2)) & 1 for b in range(bits)]
    return "".join(BASE32[int("".join(map(str, bit[i:i + 5])), 2)] for i in range(0, bits, 5))


def neighbours(code: str) -> list[str]:
    """The cells around a cell: longitudes wrap, cells beyond a pole are left out."""
    south, west, north, east = cell_bounds(code)
    high, wide = north - south, east - west
    lat, lon = (south + north) / 2, (west + east) / 2
    out = []
    for dy in (1, 0, -1):
        for dx in (-1, 0, 1):
            y = lat + dy * high
            if (dx or dy) and -90 < y < 90:
                out.append(geohash_of(y, (lon + dx * wide + 180) % 360 - 180, len(code)))
    return list(dict.fromkeys(c for c in out if c != code))


def cover(min_lat: float, min_lon: float, max_lat: float, max_lon: float, precision: int) -> list[str]:
    """Cells that together hold the box; more than MAX_COVER raise."""
    bits = 5 * precision
    high, wide = 180 / (1 << bits // 2), 360 / (1 << (bits + 1) // 2)
    rows = range(math.floor((min_lat + 90) / high), math.floor((max_lat + 90) / high) + 1)
    columns = range(math.floor((min_lon + 180) / wide), math.floor((max_lon + 180) / wide) + 1)
    if len(rows) * len(columns) > MAX_COVER:
        raise CoverTooLarge(f"{len(rows) * len(columns)} cells")
    return sorted({geohash_of(-90 + (r + .5) * high, -180 + (c + .5) * wide, precision) for r in rows for c in columns})


def boxes_around(lat: float, lon: float, metres: float) -> list[tuple[float, float, float, float]]:
    """One box, or two across the date line, that together hold every point within metres of
    the centre. A circle that holds a pole takes all longitudes; else its widest longitude
    is asin(sin(r) / cos(lat)) away, which lies nearer to the pole than the centre."""
    angle = metres / INDEX_RADIUS * (1 + 1e-9) + 1e-12
    dy = math.degrees(angle)
    south, north = lat - dy, lat + dy
    if south <= -90 or north >= 90 or angle >= math.pi / 2:
        return [(max(-90.0, south), -180.0, min(90.0, north), 180.0)]
    dx = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat)))))
    west, east = lon - dx, lon + dx
    if dx >= 180:
        return [(south, -180.0, north, 180.0)]
    if west < -180:
        return [(south, -180.0, north, east), (south, west + 360, north, 180.0)]
    if east > 180:
        return [(south, west, north, 180.0), (south, -180.0, north, east - 360)]
    return [(south, west, north, east)]


def in_boxes(lat: Column, lon: Column, boxes: list[tuple[float, float, float, float]]) -> Column:
    out = in_box(lat, lon, *boxes[0])
    for box in boxes[1:]:
        out = out | in_box(lat, lon, *box)
    return out


def in_box(lat: Column, lon: Column, min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> Column:
    """Inclusive; a missing coordinate is outside. Plain comparisons reach the scan."""
    return lat.isNotNull() & lon.isNotNull() & lat.between(min_lat, max_lat) & lon.between(min_lon, max_lon)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS) -> Column:
    """Metres along the great circle; null where a coordinate is off the globe."""
    a1, o1, a2, o2 = (c.cast("double") for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(a2 - a1) / 2), 2) + F.cos(F.radians(a1)) * F.cos(F.radians(a2)) * F.pow(F.sin(F.radians(o2 - o1) / 2), 2)
    h = F.least(F.lit(1.0), h)
    on_globe = a1.between(-90, 90) & a2.between(-90, 90) & o1.between(-180, 180) & o2.between(-180, 180)
    return F.when(on_globe, F.lit(2 * radius) * F.atan2(F.sqrt(h), F.sqrt(1 - h)))


def within(lat: Column, lon: Column, centre_lat: float, centre_lon: float, metres: float) -> Column:
    """At most metres from the centre. The boxes go first, as they can be pushed to the scan."""
    near = in_boxes(lat, lon, boxes_around(centre_lat, centre_lon, metres))
    far = haversine(lat, lon, F.lit(centre_lat), F.lit(centre_lon), INDEX_RADIUS)
    return near & F.coalesce(far <= metres, F.lit(False))


def normalise(value: Column, low: float, high: float) -> Column:
    """low..high as 0 .. 2**32 - 1, clamped and truncated."""
    at = (F.least(F.greatest(value.cast("double"), F.lit(float(low))), F.lit(float(high))) - low) / F.lit(float(high - low))
    return F.floor(at * F.lit(float((1 << 32) - 1))).cast("long")


def z_order(dimensions: list[Column], bits: int = 32) -> Column:
    """Interleaved bits of normalised dimensions as a hexadecimal text, which sorts as the
    number does; 32 bits of several dimensions don't fit a long."""
    digits = []
    places = [(d, bits - 1 - b) for b in range(bits) for d in dimensions]
    places = [(F.lit(0).cast("long"), 0)] * (-len(places) % 4) + places
    for i in range(0, len(places), 4):
        nibble = F.lit(0).cast("long")
        for column, shift in places[i:i + 4]:
            nibble = nibble * 2 + F.shiftright(column, shift).bitwiseAND(F.lit(1))
        digits.append(F.substring(F.lit("0123456789abcdef"), (nibble + 1).cast("int"), F.lit(1)))
    return F.concat(*digits)


def in_z_box(values: list[Column], ranges: list[tuple[float, float]], low: list[float], high: list[float]) -> Column:
    """Inclusive on the normalised integers, dimension by dimension."""
    out = F.lit(True)
    for v, (a, b), lo, hi in zip(values, ranges, low, high):
        bounds = [math.floor((min(max(x, a), b) - a) / (b - a) * ((1 << 32) - 1)) for x in (lo, hi)]
        out = out & normalise(v, a, b).between(*bounds)
    return F.coalesce(out, F.lit(False))


def z_ranges(ranges: list[tuple[float, float]], low: list[float], high: list[float], at_most: int = 64, bits: int = 32) -> list[tuple[str, str]]:
    """At most `at_most` inclusive ranges of z_order texts that together hold the box, in order.
    The curve is halved from the whole: halves outside the box go, those inside it stay, and
    the largest of the others are halved on while there is room."""
    box = []
    for (a, b), lo, hi in zip(ranges, low, high):
        box.append([math.floor((min(max(x, a), b) - a) / (b - a) * ((1 << 32) - 1)) >> 32 - bits for x in (lo, hi)])
    if any(lo > hi for lo, hi in box):
        return []
    n, depth_of_all = len(box), bits * len(box)
    whole = (0, 0, tuple((0, (1 << bits) - 1) for _ in box))
    open_parts, done = deque([whole]), []
    while open_parts:
        depth, prefix, sides = open_parts.popleft()
        if any(b < lo or a > hi for (a, b), (lo, hi) in zip(sides, box)):
            continue
        inside = all(lo <= a and b <= hi for (a, b), (lo, hi) in zip(sides, box))
        if inside or len(open_parts) + len(done) + 2 > at_most:
            done.append((prefix << depth_of_all - depth, ((prefix + 1) << depth_of_all - depth) - 1))
            continue
        a, b = sides[depth % n]
        middle = (a + b) // 2
        for bit, half in ((0, (a, middle)), (1, (middle + 1, b))):
            open_parts.append((depth + 1, prefix * 2 + bit, (*sides[:depth % n], half, *sides[depth % n + 1:])))
    joined = []
    for a, b in sorted(done):
        if joined and joined[-1][1] + 1 == a:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    digits = -(-depth_of_all // 4)
    return [(f"{a:0{digits}x}", f"{b:0{digits}x}") for a, b in joined]


def in_z_ranges(z: Column, ranges: list[tuple[str, str]]) -> Column:
    """Whether a stored z_order text lies in one of the ranges; the test reaches the scan, so a
    table sorted by it is read in part. in_z_box is the exact test to put behind it."""
    out = F.lit(False)
    for a, b in ranges:
        out = out | z.between(a, b)
    return z.isNotNull() & out
