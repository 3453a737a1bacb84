"""Query keys of pictures, made of the tables' rows: a grid of grey or colours for each vector, a page on a dark ground for each supplier; each with DuckDB SQL of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.operators import pictures as P
from tallywell.sources.events import table

WIDTH, HEIGHT = 120, 150


def as_bytes(values: Column) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def grids(spark: SparkSession, sf_dir: str, channels: int = 1) -> DataFrame:
    """Vectors as pictures: 8 x 8 of grey, or 7 x 3 of colours."""
    level = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 0.5) * 256))).cast("int"))
    w, h = (8, 8) if channels == 1 else (7, 3)
    own = table(spark, sf_dir, "embeddings").where("size(embedding) = 64")
    return own.select(F.col("vec_id").alias("image_id"), F.lit(w).alias("width"), F.lit(h).alias("height"), F.lit(channels).alias("channels"), as_bytes(F.slice(level, 1, w * h * channels)).alias("pixels"))


def dots(images: DataFrame) -> DataFrame:
    """image_id, place (from 0, row by row) and value of each byte."""
    byte = F.transform(F.sequence(F.lit(1), F.octet_length("pixels")), lambda i: F.conv(F.hex(F.substring("pixels", i, F.lit(1))), 16, 10).cast("int"))
    return images.select("image_id", F.posexplode(byte).alias("place", "value"))


#: b: value of each byte of the grey grids.
G = """WITH b AS (SELECT vec_id AS image_id, unnest(range(64)) AS place, unnest(list_transform(embedding, lambda v: CAST(greatest(0, least(255, floor((v::DOUBLE + 0.5) * 256))) AS INTEGER))) AS v FROM embeddings WHERE len(embedding) = 64
), g AS (SELECT image_id, CAST(place % 8 AS INTEGER) AS x, CAST(place // 8 AS INTEGER) AS y, place, v FROM b)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quadrilateral for each supplier: corners tl, tr, br, bl from 0 to 1, as structs."""
    k = F.col("s_suppkey")
    off = lambda m: (k * m % 11) / 110.0
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    corners = {"tl": point(0.08 + off(3), 0.07 + off(5)), "tr": point(0.93 - off(7), 0.08 + off(2)), "br": point(0.92 - off(4), 0.93 - off(9)), "bl": point(0.07 + off(6), 0.92 - off(8))}
    return table(spark, sf_dir, "supplier").select(k.alias("image_id"), *(c.alias(n) for n, c in corners.items()))


def drawn(quads: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """Each quadrilateral as a bright page on a dark ground, in three channels; drawn in as many tasks as the session has, some pictures at a time."""
    flat = quads.select(F.col("image_id").cast("long").alias("image_id"), F.array(*(F.col(f"{c}.{v}").cast("double") for c in P.CORNERS for v in "xy")).alias("at"))
    step = max(1, P.AT_ONCE // (width * height))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.mgrid[:height, :width] + 0.5
        for b in (whole.slice(start, step) for whole in batches for start in range(0, whole.num_rows, step)):
            out = []
            for at in b.column("at").to_pylist():
                corner = np.array(at).reshape(4, 2) * (width, height)
                inside = np.ones((height, width), bool)
                for (ax, ay), (bx, by) in zip(corner, np.roll(corner, -1, axis=0)):
                    inside &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0
                out.append(np.where(inside[..., None], np.uint8([235, 234, 228]), np.uint8([33, 30, 38])).tobytes())
            sizes = [pa.array([v] * b.num_rows, pa.int32()) for v in (width, height, 3)]
            yield pa.RecordBatch.from_arrays([b.column("image_id"), *sizes, pa.array(out, pa.binary())], names=P.NAMES)

    return flat.repartition(P.tasks(flat), "image_id").mapInArrow(run, P.IMAGE)


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each drawn page is found where it was drawn."""
    quads = pages(spark, sf_dir)
    found = P.document_quads(drawn(quads)).select("image_id", "confidence", *(F.col(c).alias(f"found_{c}") for c in P.CORNERS))
    both = quads.join(found, "image_id")
    near = F.greatest(*(F.abs(F.col(f"{c}.{v}") - F.col(f"found_{c}.{v}")) for c in P.CORNERS for v in "xy")) <= 0.03
    return both.select("image_id", near.alias("near"), (F.col("confidence") >= 0.5).alias("sure"))


def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the straightened pages, and whether nearly all of each is the page's own white."""
    quads = pages(spark, sf_dir)
    out = P.grayscale(P.straightened(drawn(quads), quads))
    light = F.octet_length(F.regexp_replace(F.decode("pixels", "ISO-8859-1"), "[^È-ÿ]", "").cast("string")) / 2.0
    return out.select("image_id", "width", "height", (light / (F.col("width") * F.col("height")) > 0.95).alias("light"))


#: q: corners of the pages in pixels.
Q = f"""WITH o AS (SELECT s_suppkey AS image_id, s_suppkey * 2 % 11 / 110.0::DOUBLE AS a2, s_suppkey * 3 % 11 / 110.0::DOUBLE AS a3, s_suppkey * 4 % 11 / 110.0::DOUBLE AS a4, s_suppkey * 5 % 11 / 110.0::DOUBLE AS a5, s_suppkey * 6 % 11 / 110.0::DOUBLE AS a6,
  s_suppkey * 7 % 11 / 110.0::DOUBLE AS a7, s_suppkey * 8 % 11 / 110.0::DOUBLE AS a8, s_suppkey * 9 % 11 / 110.0::DOUBLE AS a9 FROM supplier
), q AS (SELECT image_id, (0.08::DOUBLE + a3) * {WIDTH} AS x0, (0.07::DOUBLE + a5) * {HEIGHT} AS y0, (0.93::DOUBLE - a7) * {WIDTH} AS x1, (0.08::DOUBLE + a2) * {HEIGHT} AS y1, (0.92::DOUBLE - a4) * {WIDTH} AS x2, (0.93::DOUBLE - a9) * {HEIGHT} AS y2, (0.07::DOUBLE + a6) * {WIDTH} AS x3, (0.92::DOUBLE - a8) * {HEIGHT} AS y3 FROM o)"""


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the projection takes the middle of the square, and its corner opposite to the origin."""
    q = pages(spark, sf_dir)
    x, y = ([F.col(f"{c}.{v}") * s for c in P.CORNERS] for v, s in (("x", WIDTH), ("y", HEIGHT)))
    c = P.projection(x, y)
    middle, far = P.projected(c, F.lit(0.5), F.lit(0.5)), P.projected(c, F.lit(1.0), F.lit(1.0))
    return q.select("image_id", *(F.round(v, 6).alias(n) for v, n in zip((*middle, *far), ("x", "y", "far_x", "far_y"))))


KEYS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "grayscale": (
        lambda s, d: dots(P.grayscale(grids(s, d, 3))),
        f"{G}, c AS (SELECT image_id, place // 3 AS place, max(v) FILTER (WHERE place % 3 = 0) * 257 AS r, max(v) FILTER (WHERE place % 3 = 1) * 257 AS g, max(v) FILTER (WHERE place % 3 = 2) * 257 AS bl FROM b WHERE place < 63 GROUP BY 1, 2)\nSELECT image_id, CAST(place AS INTEGER) AS place, CAST((19595 * r::BIGINT + 38470 * g::BIGINT + 7471 * bl::BIGINT + 32768) >> 24 AS INTEGER) AS value FROM c",
    ),
    "adaptive_threshold": (
        lambda s, d: dots(P.thresholded(grids(s, d), 5, 0.15)),
        f"{G} SELECT a.image_id, CAST(a.place AS INTEGER) AS place, CASE WHEN any_value(a.v) > sum(n.v) / count(*) * (1 - 0.15::DOUBLE) THEN 255 ELSE 0 END AS value FROM g a JOIN g n ON n.image_id = a.image_id AND abs(n.x - a.x) <= 2 AND abs(n.y - a.y) <= 2 GROUP BY a.image_id, a.place",
    ),
    "downscale": (
        lambda s, d: dots(P.downscaled(grids(s, d), 5)),
        f"""{G}, p AS (SELECT i AS place, (i % 5 + 0.5::DOUBLE) * 8 / 5 - 0.5::DOUBLE AS sx, (i // 5 + 0.5::DOUBLE) * 8 / 5 - 0.5::DOUBLE AS sy FROM range(25) AS r(i)
), w AS (SELECT image_id, p.place, sum(v * greatest(0::DOUBLE, 1 - abs(x - sx)) * greatest(0::DOUBLE, 1 - abs(y - sy))) AS v FROM g JOIN p ON abs(x - sx) < 1 AND abs(y - sy) < 1 GROUP BY image_id, p.place)
SELECT image_id, CAST(place AS INTEGER) AS place, CAST(floor(round(v, 9) + 0.5) AS INTEGER) AS value FROM w""",
    ),
    "rotate_right": (lambda s, d: dots(P.rotated(grids(s, d), 90)), f"{G} SELECT image_id, x * 8 + 7 - y AS place, v AS value FROM g"),
    "detect_quad": (detected, "SELECT s_suppkey AS image_id, true AS near, true AS sure FROM supplier"),
    "homography": (
        centres,
        f"""{Q}, t AS (SELECT *, ((x1 - x0) * (y1 - y3) - (y1 - y0) * (x1 - x3)) / ((x2 - x0) * (y1 - y3) - (y2 - y0) * (x1 - x3)) AS t FROM q)
SELECT image_id, round(x0 + t * (x2 - x0), 6) AS x, round(y0 + t * (y2 - y0), 6) AS y, round(x2, 6) AS far_x, round(y2, 6) AS far_y FROM t""",
    ),
    "warp": (
        flattened,
        f"""{Q} SELECT image_id, CAST(floor(greatest(sqrt((x1-x0)**2 + (y1-y0)**2), sqrt((x2-x3)**2 + (y2-y3)**2)) + 0.5) AS INTEGER) AS width, CAST(floor(greatest(sqrt((x3-x0)**2 + (y3-y0)**2), sqrt((x2-x1)**2 + (y2-y1)**2)) + 0.5) AS INTEGER) AS height, true AS light FROM q""",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: run for k, (run, _) in KEYS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in KEYS.items()}
