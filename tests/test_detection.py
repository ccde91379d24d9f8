"""Recognition without models: geometry against brute force, and a stub reader from raster to items."""

import itertools
import math

import numpy as np
import pytest
from quire.operators import detection, recognition


def brute_rectangle(points):
    """The least area of a rectangle around points with an edge through two of them."""
    best = math.inf
    for (ax, ay), (bx, by) in itertools.permutations(points, 2):
        u = np.array([bx - ax, by - ay], float)
        u /= np.hypot(*u)
        p, q = np.array(points) @ u, np.array(points) @ np.array([-u[1], u[0]])
        if q.min() >= q[points.index((ax, ay))] - 1e-9:  # all on one side
            best = min(best, np.ptp(p) * np.ptp(q))
    return best


@pytest.mark.parametrize("seed", range(8))
def test_hull_and_rectangle(seed):
    rng = np.random.default_rng(seed)
    points = [tuple(map(int, p)) for p in {(int(x), int(y)) for x, y in rng.integers(0, 30, (12, 2))}]
    hull = detection.hull(np.array(points))
    turn = np.roll(hull, -1, 0) - hull
    after = np.roll(turn, -1, 0)
    assert (turn[:, 0] * after[:, 1] - turn[:, 1] * after[:, 0] > 0).all()  # strictly convex, counter-clockwise
    for p in points:
        side = turn[:, 0] * (p[1] - hull[:, 1]) - turn[:, 1] * (p[0] - hull[:, 0])
        assert (side >= 0).all()
    assert abs(abs(detection.area(detection.rectangle(hull))) - brute_rectangle(points)) < 1e-6
    assert abs(detection.area(detection.ordered(detection.rectangle(hull)))) == pytest.approx(brute_rectangle(points))


def test_grown_quadrilaterals():
    quad = np.array([(10, 10), (50, 10), (50, 20), (10, 20)], float)
    d = 400 * 1.6 / 100
    for q in (quad, quad[::-1]):
        big = detection.grown(q)
        assert big.min(0).tolist() == pytest.approx([10 - d, 10 - d]) and big.max(0).tolist() == pytest.approx([50 + d, 20 + d])
    turned = quad @ np.array([[math.cos(0.3), math.sin(0.3)], [-math.sin(0.3), math.cos(0.3)]])
    assert abs(detection.area(detection.grown(turned))) == pytest.approx((40 + 2 * d) * (10 + 2 * d))


def test_dilation_resize_and_crop():
    rng = np.random.default_rng(1)
    bits = rng.random((20, 30)) < 0.1
    for near, far in ((1, 1), (0, 1)):
        want = [[bits[max(y - near, 0) : y + far + 1, max(x - near, 0) : x + far + 1].any() for x in range(30)] for y in range(20)]
        assert (detection.dilated(bits, near, far) == np.array(want)).all()
    gray = rng.integers(0, 255, (40, 60)).astype(np.uint8)
    assert (detection.resized(gray, 60, 40) == gray).all()
    assert detection.resized(np.full((7, 9), 33, np.uint8), 50, 20).tolist() == [[33] * 50] * 20
    assert (detection.cropped(gray, np.array([(5, 6), (25, 6), (25, 16), (5, 16)], float)) == gray[6:16, 5:25]).all()
    assert detection.upright(np.zeros((30, 10))).shape == (10, 30) and detection.upright(np.zeros((14, 10))).shape == (14, 10)


def test_many_parts_and_none():
    p = np.zeros((400, 400))
    assert detection.quadrilaterals(p, 400, 400).shape == (0, 4, 2)
    p[::8, ::8] = 0.9  # 2500 specks, all too small
    p[390:398, 10:200] = 0.9
    assert detection.quadrilaterals(p, 400, 400).shape == (0, 4, 2)  # it comes after the first thousand parts
    p[::8, ::8] = 0
    p[390:398, 10:200] = 0.9
    assert len(detection.quadrilaterals(p, 400, 400)) == 1


def test_maps_are_spread(spark):
    """Probability maps are much work for a key; the keys may lie in a file of one split."""
    from quire.plans import outputs

    found = outputs.detected_boxes(spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() >= 8
    sizes = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(sizes) <= 2 * sum(sizes) / len(sizes) + 16


class Stub:
    """Reads dark bars: a bar's mean gray value, in tens, is its letter; a bar of 7 has a marker that a wider reading lengthens."""

    alphabet = list("abcdefghij.i ")

    def detect(self, gray):
        return (gray < 128).astype(float) * 0.95

    def upside_down(self, crops):
        return np.zeros(len(crops))

    def read(self, crops, stretch):
        out = []
        for crop in crops:
            letter = int(np.median(crop[crop < 128])) // 10
            text = [letter + 1]
            if letter == 7:
                text = [12, 0, 12, 11, 13, 1] if stretch > 1 else [12, 11, 13, 1]
            frames = np.full((2 * len(text), 14), 0.01)
            for k, c in enumerate(text):
                frames[2 * k, c], frames[2 * k + 1, 0] = 0.9, 0.9
            out.append(frames)
        return out


def test_pages_are_read(spark):
    px = np.full((300, 400), 255, np.uint8)
    px[50:62, 40:140], px[51:63, 200:330], px[150:165, 60:200] = 20, 0, 75
    blank, broken = np.full((300, 400), 255, np.uint8), b"short"
    pages = spark.createDataFrame([(1, 1, 400, 300, bytearray(px.tobytes())), (1, 2, 400, 300, bytearray(blank.tobytes())), (2, 1, 400, 300, bytearray(broken))], "doc_id long, page_no int, w int, h int, px binary")
    for options in (recognition.Options(), recognition.Options(lazy=True)):
        found = sorted(recognition.read_pages(pages, lambda o: Stub(), options).collect())
        assert [(r.doc_id, r.page_no, r.t) for r in found if r.error is None] == [(1, 1, "c"), (1, 1, "a"), (1, 1, "ii. a")]
        assert [r.seq for r in found if r.error is None] == [0, 1, 2]
        assert [(r.doc_id, r.page_no, r.error.split(":")[0]) for r in found if r.error] == [(2, 1, "ValueError")]
        first = found[0]
        assert first.x0 < 40 and first.x1 > 140 and first.y0 < 50 and first.y1 > 62


def test_plain_and_column_readings_agree(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    frames = [rng.random((int(n), 5)).round(1) for n in rng.integers(0, 12, 40)]
    rows = spark.createDataFrame([(k, f.tolist()) for k, f in enumerate(frames)], "k int, f array<array<double>>")
    text, score = recognition.decoded(F.col("f"), F.array(*map(F.lit, "abcd")))
    for r in rows.select("k", text.alias("t"), score.alias("s")).collect():
        t, s = recognition.greedy(frames[r.k], list("abcd"))
        assert t == r.t and s == pytest.approx(r.s)
