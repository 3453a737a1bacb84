"""Pictures as rows: grey, threshold, scaling, the quadrilateral of a photographed page, and its straightening.

A picture is image_id, width, height, channels (1, 3 or 4) and pixels (rows from the top, channels side by side). Arrow batches carry the pixels;
pictures of one size in a batch are worked on together, as one array, a bounded number of pixels at a time. What is said of a picture by few numbers
(lines, corners, sizes, the coefficients of a projection) is columns, worked out by built-in functions. Nothing is shuffled but the join of pictures with
their corners. Rows without an id or pixels, or with another number of bytes than their size says, are left out; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from math import hypot

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.functions import scalars as S

IMAGE = "image_id bigint, width int, height int, channels int, pixels binary"
NAMES = [c.split()[0] for c in IMAGE.split(", ")]
#: Pixels that are worked on together (or one picture).
AT_ONCE = 1 << 21
#: Pixels of a picture up to which the places of their votes are kept as a table.
TABLED = 1 << 15

# The largest picture that is decoded, in pixels; sizes and limits of the search for a page.
MOST_PIXELS = 50_000_000
WORKING_SIDE, LEAST_SIDE = 500, 32
BLUR = (2, 4, 5, 4, 2)
EDGES_FROM = 0.85
ANGLES, BIN = 180, 2.0
SLANT = 35.0
APART, LEAST_AREA, LEAST_VOTES = 0.25, 0.20, 0.25
ANGLE_SPAN = 50.0
#: Pixels from a line within which its edge is fitted.
NEAR = 4.0
# Weights of red, green and blue in 65,536ths.
LUMA = (19595, 38470, 7471)


def tasks(rows: DataFrame) -> int:
    """Into how many partitions pictures are dealt, or what they are made of: a file of some bytes for each picture is one task's, else."""
    spark = rows.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def by_size(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pictures of one size in the batch, and their pixels (picture, y, x, channel)."""
    data = b.column("pixels")
    sizes = list(zip(*(b.column(c).to_pylist() for c in ("height", "width", "channels"))))
    groups: dict[tuple[int, ...], list[int]] = {}
    for i, (size, n) in enumerate(zip(sizes, pc.binary_length(data).to_pylist())):
        if n is not None and None not in size and size[2] in (1, 3, 4) and min(size) > 0 and n == size[0] * size[1] * size[2]:
            groups.setdefault(size, []).append(i)
    for (h, w, c), places in groups.items():
        step = max(1, AT_ONCE // (h * w))
        for at in range(0, len(places), step):
            own = places[at : at + step]
            yield np.array(own), np.frombuffer(b"".join(data[i].as_buffer() for i in own), np.uint8).reshape(len(own), h, w, c)


def mapped(images: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Pictures made from pictures of the same size by a function of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for places, a in by_size(b):
                out = kernel(a)
                n, h, w, c = out.shape
                sizes = [pa.array(np.full(n, v, np.int32)) for v in (w, h, c)]
                yield pa.RecordBatch.from_arrays([b.column("image_id").take(pa.array(places)), *sizes, pa.array([x.tobytes() for x in out], pa.binary())], names=NAMES)

    own = images.where(F.col("image_id").isNotNull()).select(F.col("image_id").cast("long").alias("image_id"), *(F.col(c).cast("int").alias(c) for c in NAMES[1:4]), "pixels")
    return own.mapInArrow(run, IMAGE)


def grey(a: np.ndarray) -> np.ndarray:
    """(picture, y, x) of luma, rounded as of 16-bit channels."""
    if a.shape[3] == 1:
        return a[..., 0]
    wide = a[..., :3].astype(np.uint32) * 257
    return ((sum(np.uint32(k) * wide[..., i] for i, k in enumerate(LUMA)) + np.uint32(1 << 15)) >> np.uint32(24)).astype(np.uint8)


def grayscale(images: DataFrame) -> DataFrame:
    return mapped(images, lambda a: grey(a)[..., None])


def window_of(w: int, h: int, window: int) -> int:
    window = window if window > 0 else max(15, min(w, h) // 8)
    return window + (window % 2 == 0)


def above_mean(g: np.ndarray, window: int, bias: float) -> np.ndarray:
    """White where a pixel is more than (1 - bias) of the mean of the window around it, which is cut at the edges: sums by an integral image."""
    _, h, w = g.shape
    half = window_of(w, h, window) // 2
    total = np.zeros((len(g), h + 1, w + 1), np.int64)
    np.cumsum(np.cumsum(g, axis=1, dtype=np.int64), axis=2, out=total[:, 1:, 1:])
    y, x = np.arange(h), np.arange(w)
    y0, y1, x0, x1 = np.maximum(y - half, 0), np.minimum(y + half, h - 1) + 1, np.maximum(x - half, 0), np.minimum(x + half, w - 1) + 1
    rows = total[:, y1] - total[:, y0]
    mean = (rows[:, :, x1] - rows[:, :, x0]) / ((y1 - y0)[:, None] * (x1 - x0)[None, :])
    return np.where(g > mean * (1 - bias), np.uint8(255), np.uint8(0))


def thresholded(images: DataFrame, window: int = 0, bias: float = 0.15) -> DataFrame:
    """Black and white by the mean around each pixel, in a window of an odd side (0: an eighth of the shorter side, 15 at least)."""
    return mapped(images, lambda a: above_mean(grey(a), window, bias)[..., None])


def rounded(x: np.ndarray) -> np.ndarray:
    """Halves go up, also those that a sum misses by its last bits."""
    return np.clip(np.floor(x + (0.5 + 1e-9)), 0, 255).astype(np.uint8)


def boosted(images: DataFrame, contrast: float = 1.15, saturation: float = 1.25) -> DataFrame:
    """Channels pushed from the pixel's grey, then from the middle; pictures of one channel only the latter."""
    curve = rounded((np.arange(256) - 128) * contrast + 128)

    def kernel(a: np.ndarray) -> np.ndarray:
        if a.shape[3] == 1:
            return curve[a]
        out, colour = a.copy(), a[..., :3].astype(np.float64)
        middle = (colour @ np.array([0.299, 0.587, 0.114]))[..., None]
        out[..., :3] = curve[rounded(middle + saturation * (colour - middle))]
        return out

    return mapped(images, kernel)


def rotated(images: DataFrame, degrees: int) -> DataFrame:
    """Clockwise by a multiple of 90; other angles change nothing."""
    turns = degrees // 90 % 4 if degrees % 90 == 0 else 0
    return mapped(images, lambda a: np.ascontiguousarray(np.rot90(a, -turns, axes=(1, 2))))


def sampled(a: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    """Pictures (n, h, w, c) at places between pixels, by their four neighbours; places outside are those of the edge."""
    h, w = a.shape[1:3]
    sx, sy = np.clip(sx, 0, w - 1), np.clip(sy, 0, h - 1)
    x0, y0 = sx.astype(np.int64), sy.astype(np.int64)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]
    top = a[:, y0, x0] * (1 - fx) + a[:, y0, x1] * fx
    return rounded(top * (1 - fy) + (a[:, y1, x0] * (1 - fx) + a[:, y1, x1] * fx) * fy)


def smaller(a: np.ndarray, longest: int) -> np.ndarray:
    h, w = a.shape[1:3]
    if longest <= 0 or max(w, h) <= longest:
        return a
    scale = longest / max(w, h)
    nw, nh = max(1, int(w * scale)), max(1, int(h * scale))
    sy, sx = np.meshgrid((np.arange(nh) + 0.5) * h / nh - 0.5, (np.arange(nw) + 0.5) * w / nw - 0.5, indexing="ij")
    return sampled(a, sx, sy)


def downscaled(images: DataFrame, longest: int) -> DataFrame:
    """Pictures whose longer side is at most so long; smaller ones stay as they are."""
    return mapped(images, lambda a: smaller(a, longest))


def shifted_sum(p: np.ndarray, axis: int, weights: tuple[int, ...]) -> np.ndarray:
    """Weighted sums of neighbours along an axis of a padded array."""
    n = p.shape[axis] - len(weights) + 1
    return sum(k * p[(slice(None),) * axis + (slice(i, i + n),)] for i, k in enumerate(weights) if k)


def edges_of(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the blurred picture changes most, widened by a pixel; and how much it changes anywhere."""
    total = sum(BLUR)
    blurred = g.astype(np.int32)
    for axis in (2, 1):
        pad = [(0, 0), (0, 0), (0, 0)]
        pad[axis] = (2, 2)
        blurred = shifted_sum(np.pad(blurred, pad, mode="edge"), axis, BLUR) // total
    p = np.pad(blurred, [(0, 0), (1, 1), (1, 1)], mode="edge")
    size = np.abs(shifted_sum(shifted_sum(p, 2, (-1, 0, 1)), 1, (1, 2, 1))) + np.abs(shifted_sum(shifted_sum(p, 1, (-1, 0, 1)), 2, (1, 2, 1)))
    most = np.maximum(1, size.max(axis=(1, 2)))
    bins = size * 255 // most[:, None, None]
    target = int(g.shape[1] * g.shape[2] * EDGES_FROM)
    limit = np.array([np.searchsorted(np.cumsum(np.bincount(b.ravel(), minlength=256)), target) for b in bins]) * most // 255
    found = size >= np.maximum(1, limit)[:, None, None]
    wide = np.pad(found, [(0, 0), (1, 1), (1, 1)])
    h, w = found.shape[1:]
    return reduce(np.logical_or, [wide[:, i : i + h, j : j + w] for i in range(3) for j in range(3)]), size


@lru_cache(maxsize=2)
def line_places(h: int, w: int) -> np.ndarray:
    """For each pixel of a small picture, row by row, where its votes of all angles go."""
    y, x = np.divmod(np.arange(h * w), w)
    diagonal = hypot(w, h)
    angle = np.arange(ANGLES) * np.pi / ANGLES
    rho = np.outer(x, np.cos(angle)) + np.outer(y, np.sin(angle))
    return (((rho + diagonal) / BIN).astype(np.int64) * ANGLES + np.arange(ANGLES)).astype(np.int32)


def votes_of(edges: np.ndarray) -> tuple[np.ndarray, float]:
    """Votes of one picture's edge pixels for lines by distance (in bins) and angle, counted where there are any."""
    h, w = edges.shape
    diagonal = hypot(w, h)
    bins = int(2 * diagonal / BIN) + 1
    if h * w <= TABLED:
        return np.bincount(line_places(h, w)[np.flatnonzero(edges)].ravel(), minlength=bins * ANGLES)[: bins * ANGLES].reshape(bins, ANGLES), diagonal
    angle = np.arange(ANGLES) * np.pi / ANGLES
    y, x = np.nonzero(edges)
    votes = np.zeros(bins * ANGLES, np.int64)
    for at in range(0, len(x), 8192):
        rho = np.outer(x[at : at + 8192], np.cos(angle)) + np.outer(y[at : at + 8192], np.sin(angle))
        place = ((rho + diagonal) / BIN).astype(np.int64) * ANGLES + np.arange(ANGLES)
        votes += np.bincount(place.ravel(), minlength=len(votes))[: len(votes)]
    return votes.reshape(bins, ANGLES), diagonal


def fitted(x: np.ndarray, y: np.ndarray, change: np.ndarray, rho: float, theta: float) -> tuple[float, float]:
    """The line along which the picture changes most near a bin's line, by weighted least squares across it: finer than bins are wide. x, y and change: of the pixels with any."""
    rho += BIN / 2
    for _ in range(3):
        near = np.abs(x * np.cos(theta) + y * np.sin(theta) - rho) <= NEAR
        if near.sum() < 2:
            break
        at, weight = np.stack([x[near], y[near]]).astype(np.float64), change[near].astype(np.float64) ** 2
        _, axes = np.linalg.eigh(np.cov(at, aweights=weight))
        normal = axes[:, 0]  # across, where the weight spreads least
        if normal @ (np.cos(theta), np.sin(theta)) < 0:
            normal = -normal
        rho, theta = float(np.average(at, axis=1, weights=weight) @ normal), float(np.arctan2(normal[1], normal[0]))
    return rho, theta


def sides_of(edges: np.ndarray, change: np.ndarray) -> list[dict] | None:
    """Two lines across and two down, each pair the strongest that lies far enough apart; none if there is no such pair."""
    h, w = edges.shape
    votes, diagonal = votes_of(edges)
    around = np.pad(np.pad(votes, [(0, 0), (1, 1)], mode="wrap"), [(1, 1), (0, 0)], constant_values=-1)
    peak = votes >= max(1, int(min(w, h) * LEAST_VOTES))
    for i in range(3):
        for j in range(3):
            if (i, j) != (1, 1):
                other = around[i : i + votes.shape[0], j : j + ANGLES]
                peak &= (votes > other) if (i, j) < (1, 1) else (votes >= other)
    r, t = np.nonzero(peak)
    order = np.lexsort((t, r, -votes[r, t]))
    r, t = r[order], t[order]
    rho, theta, n = r * BIN - diagonal, t * np.pi / ANGLES, votes[r, t]
    slant = np.deg2rad(SLANT)
    y, x = np.nonzero(change > 0)
    some = change[y, x]
    out: list[dict] = []
    for own, apart in ((np.abs(theta - np.pi / 2) < slant, APART * h), ((theta < slant) | (theta > np.pi - slant), APART * w)):
        p, a, v = rho[own], theta[own], n[own]
        # lines near 0 and near 180 degrees are alike with distances of opposite signs
        other = np.where(np.abs(a[:, None] - a[None, :]) > np.pi / 2, -p[None, :], p[None, :])
        far = np.triu(np.abs(p[:, None] - other) >= apart, 1)
        if not far.any():
            return None
        for k in np.unravel_index(far.argmax(), far.shape):
            fine = fitted(x, y, some, float(p[k]), float(a[k]))
            out.append({"rho": fine[0], "theta": fine[1], "votes": int(v[k])})
    return out


SIDES = "image_id bigint, width int, height int, sides array<struct<rho:double,theta:double,votes:bigint>>"


def page_sides(images: DataFrame) -> DataFrame:
    """image_id, the size at which was searched, and the four lines of a page's sides (null where none were found)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("rho", pa.float64()), ("theta", pa.float64()), ("votes", pa.int64())]))
        for b in batches:
            for places, a in by_size(b):
                a = smaller(a, WORKING_SIDE)
                h, w = a.shape[1:3]
                sides = [sides_of(*e) for e in zip(*edges_of(grey(a)))] if min(w, h) >= LEAST_SIDE else [None] * len(a)
                sizes = [pa.array(np.full(len(a), v, np.int32)) for v in (w, h)]
                yield pa.RecordBatch.from_arrays([b.column("image_id").take(pa.array(places)), *sizes, pa.array(sides, kind)], names=["image_id", "width", "height", "sides"])

    return images.where(F.col("image_id").isNotNull()).select(F.col("image_id").cast("long").alias("image_id"), *NAMES[1:]).mapInArrow(run, SIDES)


CORNERS = ("tl", "tr", "br", "bl")
#: Corners of the whole picture.
WHOLE = {"tl": (0.0, 0.0), "tr": (1.0, 0.0), "br": (1.0, 1.0), "bl": (0.0, 1.0)}


def crossing(a: Column, b: Column) -> Column:
    """The point that two lines share, as a struct; null if they are as good as parallel."""
    a1, b1, a2, b2 = F.cos(a["theta"]), F.sin(a["theta"]), F.cos(b["theta"]), F.sin(b["theta"])
    det = a1 * b2 - a2 * b1
    return F.when(F.abs(det) >= 1e-6, F.struct(((a["rho"] * b2 - b["rho"] * b1) / det).alias("x"), ((a1 * b["rho"] - a2 * a["rho"]) / det).alias("y")))


def document_quads(images: DataFrame) -> DataFrame:
    """image_id, the page's corners (structs tl, tr, br and bl of x and y from 0 to 1) and a confidence from 0 to 1; the whole picture and 0 where no page is found."""
    lines = page_sides(images)
    points = F.array(*(crossing(F.col("sides")[i], F.col("sides")[j]) for i in (0, 1) for j in (2, 3)))
    ordered = lines.withColumn("points", points).withColumn("corners", F.when(F.forall("points", lambda p: p.isNotNull()), S.ordered_corners(F.col("points"))))
    inside = lambda v, size: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / F.col(size)))
    flat = ordered.select("image_id", "width", "height", "sides", *(inside(F.col(f"corners.{c}.{v}"), s).alias(f"{v}_{c}") for c in CORNERS for v, s in (("x", "width"), ("y", "height"))))
    x, y = ([F.col(f"{v}_{c}") for c in CORNERS] for v in "xy")
    area = S.quad_area(x, y)
    angles = S.quad_angles(x, y)
    told = flat.select("*", area.alias("area"), (S.quad_usable(x, y) & (area >= LEAST_AREA)).alias("usable"), (sum((F.abs(a - 90) for a in angles), F.lit(0.0)) / 4).alias("off"))
    between = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    strength = between(F.aggregate("sides", F.lit(0).cast("bigint"), lambda a, s: a + s["votes"]) / 4 / F.least("width", "height"))
    score = between(strength / 2 + between((F.col("area") - LEAST_AREA) / 0.4) / 4 + between(1 - F.col("off") / ANGLE_SPAN) / 4)
    usable = F.coalesce("usable", F.lit(False))
    corner = lambda c: F.struct(*(F.when(usable, F.col(f"{v}_{c}")).otherwise(F.lit(WHOLE[c][i])).alias(v) for i, v in enumerate("xy"))).alias(c)
    return told.select("image_id", *map(corner, CORNERS), F.when(usable, score).otherwise(0.0).alias("confidence"))


def projection(x: list[Column], y: list[Column]) -> list[Column]:
    """Coefficients a to h of the projection from the unit square to a quadrilateral (corners in order, from the square's origin on): (u, v) goes to
    ((a u + b v + c) / (g u + h v + 1), (d u + e v + f) / (g u + h v + 1)). Null where three corners lie in one line. The eight equations of the four corners in closed form."""
    sx, sy = x[0] - x[1] + x[2] - x[3], y[0] - y[1] + y[2] - y[3]
    dx1, dy1, dx2, dy2 = x[1] - x[2], y[1] - y[2], x[3] - x[2], y[3] - y[2]
    det = dx1 * dy2 - dx2 * dy1
    others = [(x[i] - x[j]) * (y[k] - y[j]) - (y[i] - y[j]) * (x[k] - x[j]) for i, j, k in ((3, 0, 1), (0, 1, 2), (2, 3, 0))]
    fine = reduce(lambda p, q: p & q, [F.abs(d) >= 1e-10 for d in (det, *others)])
    d = F.when(fine, det)
    g, h = (sx * dy2 - dx2 * sy) / d, (dx1 * sy - sx * dy1) / d
    return [x[1] - x[0] + g * x[1], x[3] - x[0] + h * x[3], F.when(fine, x[0]), y[1] - y[0] + g * y[1], y[3] - y[0] + h * y[3], F.when(fine, y[0]), g, h]


def projected(c: list[Column], u: Column, v: Column) -> tuple[Column, Column]:
    w = c[6] * u + c[7] * v + 1
    w = F.when(F.abs(w) >= 1e-12, w)
    return (c[0] * u + c[1] * v + c[2]) / w, (c[3] * u + c[4] * v + c[5]) / w


def upright_size(x: list[Column], y: list[Column], aspect: float = 0.0) -> tuple[Column, Column]:
    """Width and height of a straightened page, the longer ones of its sides in pixels, from 16 to 6,000; with an aspect the height is width / aspect."""
    far = lambda i, j: F.hypot(x[j] - x[i], y[j] - y[i])
    w = F.greatest(far(0, 1), far(3, 2))
    h = w / aspect if aspect > 0 else F.greatest(far(0, 3), far(1, 2))
    return tuple(F.least(F.lit(6000), F.greatest(F.lit(16), F.floor(v + 0.5))).cast("int") for v in (w, h))


def straightened(images: DataFrame, quads: DataFrame, aspect: float = 0.0) -> DataFrame:
    """The page of each picture as an upright rectangle; `quads` has image_id and corners as document_quads gives them. Pictures whose corners are degenerate are left out."""
    size = {"x": F.col("width"), "y": F.col("height")}
    x, y = ([F.col(f"{c}.{v}") * size[v] for c in CORNERS] for v in "xy")
    w, h = upright_size(x, y, aspect)
    # pixels are far more than Spark takes the output of a function for: their side is never the broadcast one, nor are its partitions made fewer by their compressed sizes
    both = images.select("image_id", *NAMES[1:]).repartition(tasks(images), "image_id").join(quads.select("image_id", *CORNERS).hint("shuffle_hash"), "image_id")
    planned = both.select("image_id", *NAMES[1:], w.alias("out_width"), h.alias("out_height"), *(c.alias(f"c{i}") for i, c in enumerate(projection(x, y)))).where("c6 IS NOT NULL AND c7 IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plan = list(zip(*(b.column(c).to_pylist() for c in ("out_width", "out_height", *(f"c{i}" for i in range(8))))))
            for places, a in by_size(b):
                for i, one in zip(places.tolist(), a):
                    w, h, *c = plan[i]
                    v, u = np.meshgrid(np.arange(h) / (h - 1), np.arange(w) / (w - 1), indexing="ij")
                    down = c[6] * u + c[7] * v + 1
                    down = np.where(np.abs(down) < 1e-12, np.inf, down)
                    out = sampled(one[None], (c[0] * u + c[1] * v + c[2]) / down, (c[3] * u + c[4] * v + c[5]) / down)[0]
                    sizes = [pa.array([k], pa.int32()) for k in (w, h, out.shape[2])]
                    yield pa.RecordBatch.from_arrays([b.column("image_id").slice(i, 1), *sizes, pa.array([out.tobytes()], pa.binary())], names=NAMES)

    return planned.mapInArrow(run, IMAGE)


def stated_size(content: Column) -> Column:
    """Width and height that a PNG or JPEG file's head states, as a struct; null for other files. JPEG's is in the first frame header behind its segments."""

    @F.pandas_udf("struct<width:int,height:int>")
    def of(heads):
        import pandas as pd

        def size(head: bytes | None) -> tuple[int | None, int | None]:
            if head is None:
                return None, None
            if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
                return int.from_bytes(head[16:20], "big") & 0x7FFFFFFF, int.from_bytes(head[20:24], "big") & 0x7FFFFFFF
            at = 2 if head[:2] == b"\xff\xd8" else len(head)
            while at + 9 <= len(head) and head[at] == 0xFF:
                if 0xC0 <= head[at + 1] <= 0xCF and head[at + 1] not in (0xC4, 0xC8, 0xCC):
                    return int.from_bytes(head[at + 7 : at + 9], "big"), int.from_bytes(head[at + 5 : at + 7], "big")
                at += 2 + int.from_bytes(head[at + 2 : at + 4], "big")
            return None, None

        return pd.DataFrame([size(h) for h in heads], columns=["width", "height"]).astype("Int32")

    return of(content)


def decoded(spark: SparkSession, path: str, most: int = MOST_PIXELS) -> DataFrame:
    """path, width, height, channels (red first) and pixels of the PNG and JPEG files of a folder that state at most so many pixels.

    The heads are read first and too large files are never decoded; decoding is Spark's own image source. Broken files are left out.
    """
    heads = spark.read.format("binaryFile").load(path).select("path", stated_size(F.substring("content", 1, 1 << 16)).alias("s"))
    fit = heads.where((F.col("s.width") > 0) & (F.col("s.height") > 0) & (F.col("s.width").cast("long") * F.col("s.height") <= most)).select("path")
    files = [r.path for r in fit.collect()]  # names only, as any listing of files has them on the driver
    if not files:
        return spark.createDataFrame([], "path string, width int, height int, channels int, pixels binary")
    image = spark.read.format("image").option("dropInvalid", True).load(files).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turned = []
            for pixels, c in zip(b.column("data").to_pylist(), b.column("nChannels").to_pylist()):
                a = np.frombuffer(pixels, np.uint8).reshape(-1, c)
                turned.append((a if c == 1 else a[:, [2, 1, 0, *range(3, c)]]).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("origin"), b.column("width"), b.column("height"), b.column("nChannels"), pa.array(turned, pa.binary())], names=["path", *NAMES[1:]])

    return image.mapInArrow(run, "path string, width int, height int, channels int, pixels binary")
