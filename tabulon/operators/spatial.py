"""Points near other points, and points in regions, by latitude strips and a local sweep over longitude.

One pass counts the points per thin latitude cell (at most 180 / CELL rows reach the driver). From those exact counts
the driver cuts latitude into strips of about equal numbers of points, and splits cells that alone hold more than a
strip should into salted parts. A point goes to the one strip (and part) that owns it; a centre or region goes to every
strip its reach overlaps. Within a strip, points are sorted by longitude; for each centre the window of points with a
longitude in reach is found by binary search - the active set of a sweep - and distances are verified exactly. As the
point alone decides the strip, each pair is found once. Neither side is broadcast and no side has to be small.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.runtime import parallelism, union_all

EARTH_M = 6371008.8
CELL = 0.01
#: Candidate pairs verified at a time, which bounds a task's memory whatever the density of the points.
BLOCK = 1_000_000


def strip_plan(counts: dict[int, int], strips: int) -> pd.DataFrame:
    """Cells of latitude (floor(lat / CELL)) to strips of about equal counts: columns cell, strip, parts.

    A cell with more points than a strip should have becomes a strip of its own, split into salted parts.
    """
    total = sum(counts.values())
    goal = max(1.0, total / max(1, strips))
    rows, strip, filled = [], 0, 0.0
    for cell in sorted(counts):
        n = counts[cell]
        if filled and filled + n > 1.25 * goal:
            strip, filled = strip + 1, 0.0
        parts = max(1, int(np.ceil(n / goal))) if not filled else 1
        rows.append((cell, strip, parts))
        filled += n
        if filled >= goal:
            strip, filled = strip + 1, 0.0
    return pd.DataFrame(rows, columns=["cell", "strip", "parts"])


def great_circle_m(lon1, lat1, lon2, lat2):
    """Haversine distance in metres on a sphere of radius EARTH_M; degrees in, arrays allowed."""
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def lon_reach_deg(lat, radius_m):
    """Half width in degrees of longitude of a cap of radius_m at latitude lat (180 if it holds a pole)."""
    angle = np.minimum(np.asarray(radius_m, float) / EARTH_M, np.pi / 2)
    lat = np.radians(np.asarray(lat, float))
    with np.errstate(invalid="ignore", divide="ignore"):
        s = np.sin(angle) / np.cos(lat)
    return np.where((np.abs(lat) + angle < np.pi / 2 - 1e-12) & (s < 1), np.degrees(np.arcsin(np.clip(s, -1, 1))), 180.0) + 1e-9


def windows(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (k, i) with lo[k] <= i < hi[k], in blocks of about BLOCK pairs."""
    n = np.maximum(hi - lo, 0)
    ends = np.cumsum(n)
    start = 0
    while start < len(n):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        size = n[start:stop]
        if size.sum() > BLOCK * 2:  # one centre with more points than a block: split its window
            for a in range(int(lo[start]), int(hi[start]), BLOCK):
                i = np.arange(a, min(a + BLOCK, int(hi[start])))
                yield np.full(len(i), start), i
        elif size.sum():
            k = np.repeat(np.arange(start, stop), size)
            yield k, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[start:stop], size)
        start = stop


def near_in_strip(plon, plat, clon, clat, radius) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of points and centres within the centres' radius, and the distances; longitudes may wrap at 180."""
    order = np.argsort(plon, kind="stable")
    x = plon[order]
    reach = lon_reach_deg(clat, radius)
    out_p, out_c, out_d = [], [], []
    for shift in (-360.0, 0.0, 360.0):
        lo = np.searchsorted(x, np.maximum(clon + shift - reach, -180.0 - 1e-9), "left")
        hi = np.searchsorted(x, np.minimum(clon + shift + reach, 180.0 + 1e-9), "right")
        if shift:
            away = (clon + shift + reach < -180.0) | (clon + shift - reach > 180.0)
            hi = np.where(away, lo, hi)
        for k, i in windows(lo, hi):
            p = order[i]
            ok = np.abs(plat[p] - clat[k]) <= np.degrees(radius[k] / EARTH_M) + 1e-9
            p, k = p[ok], k[ok]
            d = great_circle_m(plon[p], plat[p], clon[k], clat[k])
            ok = d <= radius[k]
            out_p.append(p[ok])
            out_c.append(k[ok])
            out_d.append(d[ok])
    if not out_p:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    p, c, d = np.concatenate(out_p), np.concatenate(out_c), np.concatenate(out_d)
    if (reach >= 180).any() and len(p):  # a cap round a pole was scanned under several shifts
        keep = np.unique(p.astype(np.int64) * len(clon) + c, return_index=True)[1]
        p, c, d = p[keep], c[keep], d[keep]
    return p, c, d


_NUMBERS = re.compile(r"-?\d+\.?\d*(?:[eE][-+]?\d+)?")


def parse_wkt(text: str | None) -> list[np.ndarray]:
    """Rings (n x 2 arrays of longitude, latitude, closed) of a POLYGON or MULTIPOLYGON; anything else has none."""
    if not text or "POLYGON" not in text.upper():
        return []
    rings = []
    for part in re.findall(r"\(([^()]+)\)", text):
        xy = np.array([[float(v) for v in _NUMBERS.findall(pair)[:2]] for pair in part.split(",") if len(_NUMBERS.findall(pair)) >= 2])
        if len(xy) >= 3:
            rings.append(xy if (xy[0] == xy[-1]).all() else np.vstack([xy, xy[:1]]))
    return rings


def inside_rings(x: np.ndarray, y: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Even-odd rule over all rings, so holes are outside and pieces inside."""
    odd = np.zeros(len(x), bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:]):
            if y1 == y2:
                continue
            cross = (y1 > y) != (y2 > y)
            j = np.flatnonzero(cross)
            if len(j):
                odd[j] ^= x[j] < (x2 - x1) * (y[j] - y1) / (y2 - y1) + x1
    return odd


def inside_in_strip(lon, lat, ref_ids, boundaries) -> tuple[np.ndarray, np.ndarray]:
    """Indices of points and the ids of the regions that contain them."""
    order = np.argsort(lon, kind="stable")
    x = lon[order]
    at, ref = [np.empty(0, int)], [np.empty(0, np.int64)]
    for ref_id, text in zip(ref_ids, boundaries):
        rings = parse_wkt(text)
        a = np.searchsorted(x, min(g[:, 0].min() for g in rings), "left")
        b = np.searchsorted(x, max(g[:, 0].max() for g in rings), "right")
        i = order[a:b]
        i = i[(lat[i] >= min(g[:, 1].min() for g in rings)) & (lat[i] <= max(g[:, 1].max() for g in rings))]
        i = i[inside_rings(lon[i], lat[i], rings)]
        at.append(i)
        ref.append(np.full(len(i), ref_id, np.int64))
    return np.concatenate(at), np.concatenate(ref)


class Strips:
    """Latitude strips over one set of points (columns lon, lat, both double; other columns are carried along).

    Within, the carried columns have neutral names, so theirs can't clash with the operator's.
    """

    def __init__(self, points: DataFrame, strips: int | None = None):
        spark = points.sparkSession
        self.names = [c for c in points.columns if c not in ("lon", "lat")]
        points = points.select(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), *[F.col(f"`{c}`").alias(f"i{k}") for k, c in enumerate(self.names)])
        self.points = points.where(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90))
        cells = self.points.groupBy(F.floor(F.col("lat") / CELL).cast("int").alias("cell")).count().collect()
        self.plan = strip_plan({r.cell: r["count"] for r in cells}, strips or 4 * parallelism(spark))
        self.edges = self.plan.groupby("strip").agg(lo=("cell", "min"), hi=("cell", "max"), parts=("parts", "max")).reset_index()

    def owned(self) -> DataFrame:
        """The points with their strip and part. The plan has at most 180 / CELL rows, so its broadcast is bounded."""
        spark = self.points.sparkSession
        plan = spark.createDataFrame(self.plan if len(self.plan) else pd.DataFrame({"cell": [0], "strip": [0], "parts": [1]}), "cell int, strip int, parts int")
        p = self.points.withColumn("cell", F.floor(F.col("lat") / CELL).cast("int")).join(F.broadcast(plan), "cell")
        return p.withColumn("part", F.pmod(F.xxhash64(*self.points.columns), F.col("parts")).cast("int")).drop("cell", "parts")

    def reached(self, df: DataFrame, low: str, high: str) -> DataFrame:
        """df once for every strip part that the latitudes from low to high overlap."""
        spark = df.sparkSession
        edges = self.edges if len(self.edges) else pd.DataFrame({"strip": [0], "lo": [0], "hi": [0], "parts": [1]})
        los, his = [float(v) * CELL for v in edges.lo], [float(v + 1) * CELL for v in edges.hi]
        ids, parts = [int(v) for v in edges.strip], [int(v) for v in edges.parts]
        each = (f"named_struct('s', {s}, 'a', {a!r}D, 'b', {b!r}D, 'k', {k})" for s, a, b, k in zip(ids, los, his, parts))
        all_strips = F.expr(f"array({', '.join(each)})")
        hit = F.filter(all_strips, lambda e: (e["b"] + 1e-9 >= F.col(low)) & (e["a"] - 1e-9 <= F.col(high)))
        return df.withColumn("e", F.explode(hit)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("e.k") - 1))).withColumn("strip", F.col("e.s")).drop("e")


def match(points: DataFrame, centres: DataFrame | None, regions: DataFrame | None, strips: Strips | None = None) -> DataFrame:
    """near() and within() over one shuffle of the points: the points' columns, kind, ref_id and distance_m.

    kind is `near` or `inside` (then distance_m is null). Columns of points that are named like one of these three come out
    with _point behind their name. See near() and within() for the inputs and odd cases.
    """
    strips = strips or Strips(points)
    ids = [c for c in strips.points.columns if c not in ("lon", "lat")]
    sides = []
    if centres is not None:
        c = centres.select(F.col("ref_id").cast("bigint").alias("ref_id"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), F.col("radius_m").cast("double").alias("radius_m"))
        c = c.where(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90) & (F.col("radius_m") >= 0) & ~F.isnan("radius_m") & F.col("ref_id").isNotNull())
        reach = F.degrees(F.col("radius_m") / EARTH_M)
        sides.append(c.withColumn("boundary", F.lit(None).cast("string")).withColumn("lo", F.col("lat") - reach).withColumn("hi", F.col("lat") + reach))
    if regions is not None:

        @F.pandas_udf("struct<lo double, hi double>")
        def span(text: pd.Series) -> pd.DataFrame:
            rings = [parse_wkt(t) for t in text]
            return pd.DataFrame({"lo": [min((r[:, 1].min() for r in g), default=np.nan) for g in rings], "hi": [max((r[:, 1].max() for r in g), default=np.nan) for g in rings]})

        none = F.lit(None).cast("double")
        r = regions.select(F.col("ref_id").cast("bigint").alias("ref_id"), none.alias("lon"), none.alias("lat"), none.alias("radius_m"), F.col("boundary").cast("string").alias("boundary"))
        r = r.where("boundary is not null and ref_id is not null").withColumn("span", span("boundary"))
        sides.append(r.withColumn("lo", F.col("span.lo")).withColumn("hi", F.col("span.hi")).drop("span").where(~F.isnan("lo")))
    targets = strips.reached(union_all(sides), "lo", "hi").select("strip", "part", "ref_id", "lon", "lat", "radius_m", "boundary")
    fields = {f.name: f.dataType.simpleString() for f in strips.points.schema.fields}
    schema = ", ".join([f"`{i}` {fields[i]}" for i in ids] + ["kind string", "ref_id bigint", "distance_m double"])

    def sweep(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        lon, lat = p.lon.to_numpy(float), p.lat.to_numpy(float)
        area = t.boundary.notna().to_numpy(bool)
        c, r = t[~area], t[area]
        i, k, d = near_in_strip(lon, lat, c.lon.to_numpy(float), c.lat.to_numpy(float), c.radius_m.to_numpy(float))
        j, ref = inside_in_strip(lon, lat, r.ref_id.to_numpy(), r.boundary)
        out = p[ids].iloc[np.concatenate([i, j])].reset_index(drop=True)
        kind = np.repeat(np.array(["near", "inside"], object), [len(i), len(j)])
        return out.assign(kind=kind, ref_id=np.concatenate([c.ref_id.to_numpy()[k], ref]).astype(np.int64), distance_m=np.concatenate([d, np.full(len(j), np.nan)]))

    p = strips.owned()
    found = p.groupBy("strip", "part").cogroup(targets.groupBy("strip", "part")).applyInPandas(sweep, schema)
    ours = ("kind", "ref_id", "distance_m")
    found = found.select(*[F.col(i).alias(f"{n}_point" if n in ours else n) for i, n in zip(ids, strips.names)], *ours)
    return found.withColumn("distance_m", F.when(F.col("kind") == "near", F.col("distance_m")))


def near(points: DataFrame, centres: DataFrame, strips: Strips | None = None) -> DataFrame:
    """All pairs of a point and a centre at most the centre's radius_m apart (great circle).

    points: id columns (any type) and lon, lat in degrees. centres: ref_id bigint, lon, lat, radius_m. Returns the
    points' other columns, ref_id and distance_m, one row per pair. Rows with null, NaN or impossible coordinates, or
    a missing or negative radius, are in no pair; repeated points or centres give repeated pairs; empty tables give no
    rows. Columns of centres other than the four are ignored, so clashing names do no harm.
    """
    return match(points, centres, None, strips).drop("kind")


def within(points: DataFrame, regions: DataFrame, strips: Strips | None = None) -> DataFrame:
    """All pairs of a point and a region whose area contains it.

    points as in near(). regions: ref_id bigint and boundary (WKT polygon or multipolygon in longitude, latitude). Edges
    are straight in longitude and latitude; holes don't belong to the area; a point may lie in several regions. Other
    columns of regions are ignored. Regions with null or unreadable boundaries contain nothing.
    """
    return match(points, None, regions, strips).drop("kind", "distance_m")
