"""Pictures against plain versions: each window summed, each neighbour weighed, projections solved from their equations."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywell.operators import pictures as P
from tallywell.plans.pictures import drawn


def frame(spark, *arrays):
    rows = [(i, a.shape[1], a.shape[0], 1 if a.ndim == 2 else a.shape[2], bytearray(a.tobytes())) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, P.IMAGE)


def arrays(images):
    out = {}
    for r in images.collect():
        a = np.frombuffer(bytes(r.pixels), np.uint8).reshape(r.height, r.width, r.channels)
        out[r.image_id] = a[..., 0] if r.channels == 1 else a
    return out


RNG = np.random.default_rng(11)
GREY = RNG.integers(0, 256, (13, 21), dtype=np.uint8)
COLOUR = RNG.integers(0, 256, (9, 6, 3), dtype=np.uint8)
ALPHA = RNG.integers(0, 256, (9, 6, 4), dtype=np.uint8)


def test_grey(spark):
    found = arrays(P.grayscale(frame(spark, COLOUR, ALPHA, GREY)))
    for i, a in enumerate((COLOUR, ALPHA)):
        assert np.abs(found[i] - (a[..., :3] @ [0.299, 0.587, 0.114])).max() <= 1
    assert (found[2] == GREY).all()


@pytest.mark.parametrize("window,bias", [(3, 0.15), (6, 0.0), (0, 0.15), (99, 0.3)])
def test_threshold_sums_each_window(spark, window, bias):
    found = arrays(P.thresholded(frame(spark, GREY, np.zeros((4, 4), np.uint8)), window, bias))
    half = (window or 15) // 2
    for y in range(GREY.shape[0]):
        for x in range(GREY.shape[1]):
            around = GREY[max(0, y - half) : y + half + 1, max(0, x - half) : x + half + 1]
            assert found[0][y, x] == (255 if GREY[y, x] > around.mean() * (1 - bias) else 0)
    assert not found[1].any()


def test_downscaling(spark):
    found = arrays(P.downscaled(frame(spark, COLOUR, GREY), 10))
    assert (found[0] == COLOUR).all() and found[1].shape == (6, 10)
    for y in range(6):
        for x in range(10):
            sy, sx = (y + 0.5) * 13 / 6 - 0.5, (x + 0.5) * 21 / 10 - 0.5
            weight = np.maximum(0, 1 - np.abs(np.arange(13) - sy))[:, None] * np.maximum(0, 1 - np.abs(np.arange(21) - sx))[None, :]
            assert found[1][y, x] == int(np.floor((GREY * weight).sum() + 0.5 + 1e-9))


def test_turns_and_boost(spark):
    images = frame(spark, COLOUR, GREY)
    assert (arrays(P.rotated(images, 90))[1] == GREY[::-1].T).all() and (arrays(P.rotated(images, -90))[0] == np.rot90(COLOUR)).all()
    assert (arrays(P.rotated(images, 180))[1] == GREY[::-1, ::-1]).all() and (arrays(P.rotated(images, 45))[1] == GREY).all()
    assert (arrays(P.boosted(images, 1.0, 1.0))[0] == COLOUR).all()
    flat = np.full((2, 2, 3), 100, np.uint8)
    assert (arrays(P.boosted(frame(spark, flat), 1.5, 9.0))[0] == 86).all()  # grey has no saturation; (100 - 128) * 1.5 + 128


def quad_rows(spark, *quads):
    return spark.createDataFrame([(i, *q) for i, q in enumerate(quads)], "image_id bigint, " + ", ".join(f"{c} struct<x:double,y:double>" for c in P.CORNERS))


QUADS = [((0.17, 0.09), (0.83, 0.14), (0.91, 0.86), (0.10, 0.93)), ((0.22, 0.18), (0.9, 0.1), (0.86, 0.95), (0.13, 0.8))]


def test_pages_are_found_within_two_pixels(spark):
    quads = quad_rows(spark, *QUADS)
    found = {r.image_id: r for r in P.document_quads(drawn(quads, 360, 440)).collect()}
    for i, q in enumerate(QUADS):
        assert found[i].confidence > 0.5
        for c, (x, y) in zip(P.CORNERS, q):
            assert abs(found[i][c].x - x) * 360 <= 2 and abs(found[i][c].y - y) * 440 <= 2
    large = P.document_quads(drawn(quads, 1200, 900)).collect()  # searched at a working size
    assert all(abs(r[c].x - x) < 0.01 and abs(r[c].y - y) < 0.01 for r in large for c, (x, y) in zip(P.CORNERS, QUADS[r.image_id]))


def test_no_page_in_plain_noisy_or_tiny_pictures(spark):
    noise = RNG.integers(0, 256, (220, 180), dtype=np.uint8)
    found = {r.image_id: r for r in P.document_quads(frame(spark, np.full((220, 180), 90, np.uint8), noise, np.zeros((9, 9), np.uint8))).collect()}
    for i in (0, 2):
        assert found[i].confidence == 0 and [tuple(found[i][c]) for c in P.CORNERS] == [P.WHOLE[c] for c in P.CORNERS]
    assert found[1].confidence <= 0.7


def test_votes_are_those_of_each_edge_pixel():
    edges = RNG.random((37, 41)) < 0.1
    votes, diagonal = P.votes_of(edges)
    want = np.zeros_like(votes)
    for y, x in zip(*np.nonzero(edges)):
        for t in range(P.ANGLES):
            a = t * np.pi / P.ANGLES
            want[int((x * np.cos(a) + y * np.sin(a) + diagonal) / P.BIN), t] += 1
    assert (votes == want).all()


def test_projection_solves_the_eight_equations(spark):
    quads = quad_rows(spark, *QUADS, ((0.1, 0.1), (0.5, 0.1), (0.9, 0.1), (0.3, 0.8)), ((0.2, 0.2), (0.2, 0.2), (0.9, 0.9), (0.1, 0.9)))
    x, y = ([F.col(f"{c}.{v}") for c in P.CORNERS] for v in "xy")
    rows = quads.select("image_id", *(c.alias(f"c{i}") for i, c in enumerate(P.projection(x, y)))).collect()
    unit = [(0, 0), (1, 0), (1, 1), (0, 1)]
    for r in rows[:2]:
        a, b = [], []
        for (u, v), (px, py) in zip(unit, QUADS[r.image_id]):
            a += [[u, v, 1, 0, 0, 0, -u * px, -v * px], [0, 0, 0, u, v, 1, -u * py, -v * py]]
            b += [px, py]
        assert np.allclose(np.linalg.solve(a, b), r[1:], atol=1e-9)
    assert all(v is None for r in rows[2:] for v in (r.c6, r.c7))


def test_a_page_is_straightened_and_put_back(spark):
    """A smooth picture projected onto a page and straightened again is itself."""
    v, u = np.mgrid[:60, :80]
    smooth = np.stack([127 + 100 * np.sin(u / 13 + v / 29), 127 + 90 * np.cos(u / 17), 40 + 2.5 * v], axis=2).astype(np.uint8)
    whole = quad_rows(spark, ((0.0, 0.0), (79 / 80, 0.0), (79 / 80, 59 / 60), (0.0, 59 / 60)))
    same = arrays(P.straightened(frame(spark, smooth), whole))[0]
    assert same.shape == (59, 79, 3)
    v, u = np.mgrid[:59, :79] * np.array([59 / 58, 79 / 78]).reshape(2, 1, 1)  # the first and the last pixel are the corners
    want = np.stack([127 + 100 * np.sin(u / 13 + v / 29), 127 + 90 * np.cos(u / 17), 40 + 2.5 * v], axis=2)
    assert np.abs(same - want).max() <= 2
    # a page within a larger picture, whose pixels know where on the page they are
    corner = np.array([(20, 10), (170, 25), (180, 130), (8, 120)], float)
    a, b = [], []
    for (px, py), (du, dv) in zip(corner, [(0, 0), (1, 0), (1, 1), (0, 1)]):
        a += [[px, py, 1, 0, 0, 0, -px * du, -py * du], [0, 0, 0, px, py, 1, -px * dv, -py * dv]]
        b += [du, dv]
    h = np.append(np.linalg.solve(a, b), 1).reshape(3, 3)
    y, x = np.mgrid[:140, :200]
    p = h @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    picture = np.clip(np.stack([p[0] / p[2], p[1] / p[2], np.full(x.size, 0.5)], axis=1) * 200 + 20, 0, 255).astype(np.uint8).reshape(140, 200, 3)
    quad = quad_rows(spark, tuple((float(px) / 200, float(py) / 140) for px, py in corner))
    flat = arrays(P.straightened(frame(spark, picture), quad))[0].astype(float)
    rows, cols = flat.shape[:2]
    assert np.abs(flat[..., 0] - (20 + 200 * np.arange(cols) / (cols - 1))).max() < 3 and np.abs(flat[..., 1] - (20 + 200 * np.arange(rows) / (rows - 1))[:, None]).max() < 3
    assert arrays(P.straightened(frame(spark, picture), quad, aspect=2.0))[0].shape[:2] == (round(cols / 2), cols)
    line = quad_rows(spark, ((0.0, 0.0), (0.5, 0.0), (1.0, 0.0), (0.0, 1.0)))
    assert P.straightened(frame(spark, picture), line).count() == 0


def test_odd_rows(spark):
    rows = [(1, 2, 2, 1, bytearray(4)), (1, 2, 2, 1, bytearray(4)), (2, 2, 2, 1, bytearray(5)), (3, 2, 2, 2, bytearray(8)), (4, 0, 2, 1, bytearray()), (5, None, 2, 1, bytearray(4)), (6, 2, 2, 1, None), (None, 2, 2, 1, bytearray(4))]
    images = spark.createDataFrame([(*r, "x") for r in rows], P.IMAGE + ", sides string")
    for out in (P.grayscale(images), P.thresholded(images), P.downscaled(images, 1), P.document_quads(images)):
        assert sorted(r.image_id for r in out.collect()) == [1, 1]
    assert P.document_quads(images.limit(0)).collect() == []


def png(a: np.ndarray, stated=None) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = stated or a.shape[:2]
    body = b"".join(b"\0" + row.tobytes() for row in a)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_decoding_guards_its_size(spark, tmp_path):
    folder = tmp_path / "p"
    folder.mkdir()
    (folder / "a.png").write_bytes(png(COLOUR))
    (folder / "huge.png").write_bytes(png(COLOUR, (60_000, 60_000)))
    (folder / "b.png").write_bytes(png(COLOUR)[:40])
    (folder / "c.txt").write_text("no picture")
    rows = P.decoded(spark, str(folder)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.width, r.height, r.channels) for r in rows] == [("a.png", 6, 9, 3)]
    assert bytes(rows[0].pixels) == COLOUR.tobytes()
    assert P.decoded(spark, str(folder), most=53).collect() == []
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc4\x00\x02\xff\xc0\x00\x11\x08\x00\x07\x01\x02\x03"
    heads = spark.createDataFrame([(bytearray(jpeg),), (None,), (bytearray(b""),), (bytearray(b"\xff\xd8\xff"),)], "content binary")
    assert [(r.s.width, r.s.height) if r.s else None for r in heads.select(P.stated_size(F.col("content")).alias("s")).collect()][:1] == [(258, 7)]


def test_pictures_are_never_broadcast_and_their_makers_are_dealt_out(spark):
    """Spark takes the pixels for as small as the rows they are made of; one small file is one task's."""
    quads = quad_rows(spark, *QUADS * 40).coalesce(1)
    images = drawn(quads)
    assert images.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    both = P.straightened(images, quads)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("ShuffledHashJoin") == 1
    assert both.count() == 80


def test_the_search_for_pages_is_dealt_out(spark, tmp_path):
    """Suppliers are some bytes each, so even many lie in one file that one task reads."""
    from tallywell.plans.pictures import detected

    spark.range(24).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    seen = detected(spark, str(tmp_path))
    assert [r.near and r.sure for r in seen.collect()] == [True] * 24
    plan = seen._jdf.queryExecution().executedPlan().toString()
    searched = plan[plan.index("MapInArrow") :]
    assert "REPARTITION_BY_NUM" in searched and searched.index("MapInArrow") < searched.index("REPARTITION_BY_NUM")


def test_votes_from_a_table_are_those_worked_out(monkeypatch):
    """Small pictures' votes come from a table of places; the lines found are the same without it."""
    rng = np.random.default_rng(5)
    for h, w in ((40, 33), (150, 120), (64, 200)):
        edges = rng.random((h, w)) < 0.2
        change = np.where(edges, rng.integers(1, 900, (h, w)), 0)
        with monkeypatch.context() as m:
            m.setattr(P, "TABLED", 0)
            plain, far = P.votes_of(edges)
            sides = P.sides_of(edges, change)
        votes, diagonal = P.votes_of(edges)
        assert (votes == plain).all() and diagonal == far and votes.sum() == edges.sum() * P.ANGLES
        assert P.sides_of(edges, change) == sides
