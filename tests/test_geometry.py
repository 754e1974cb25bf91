import math

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import colors as C
from tessella.functions import geometry as G
from tessella.functions.shapes import label_point, label_place, remove_degeneracies

from .fixtures import DUMBBELL, square


def ring(*points):
    return F.array(*(G.point(F.lit(float(x)), F.lit(float(y))) for x, y in points))


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_rings(spark):
    r = one(spark, G.signed_area(ring(*DUMBBELL)).alias("a"), G.perimeter(ring(*square(0, 0, 2))).alias("p"), G.ring_centroid(ring(*square(1, 1, 2))).alias("c"), G.signed_area(G.counter_clockwise(ring(*square(0, 0, 2)[::-1]))).alias("ccw"), G.ring_centroid(ring((0, 0), (1, 1), (2, 2))).alias("flat"), G.fatness(ring(*square(0, 0, 1))).alias("f"))
    assert (r.a, r.p, r.c.x, r.c.y, r.ccw, r.flat) == (208.0, 8.0, 2.0, 2.0, 4.0, None)
    assert math.isclose(r.f, math.sqrt(math.pi) / 2)


def test_contains(spark):
    pts = spark.createDataFrame([(5.0, 5.0), (12.0, 5.0), (12.0, 8.0), (0.0, 5.0), (10.0, 4.0), (-1.0, 0.0), (24.005, 5.0)], "x double, y double")
    got = pts.select(G.contains(ring(*DUMBBELL), F.col("x"), F.col("y")).alias("c"), G.contains(ring(*DUMBBELL), F.col("x"), F.col("y"), -0.01).alias("s")).collect()
    assert [r.c for r in got] == [True, True, False, True, True, False, False]
    assert [r.s for r in got] == [True, True, False, False, False, False, False]


def test_segments_and_angles(spark):
    p = lambda x, y: G.point(F.lit(float(x)), F.lit(float(y)))
    r = one(spark, G.segments_cross(p(0, 0), p(2, 2), p(0, 2), p(2, 0)).alias("x"), G.segments_cross(p(0, 0), p(1, 1), p(0, 2), p(2, 0)).alias("touch"), G.segment_distance(F.lit(1.0), F.lit(3.0), p(0, 0), p(2, 0)).alias("d"), G.ring_distance(ring(*square(0, 0, 1)), ring(*square(3, 0, 1))).alias("rd"), G.angle_difference(F.lit(0.1), F.lit(2 * math.pi - 0.1)).alias("a"), *(G.quadrant(F.lit(float(x)), F.lit(float(y))).alias(n) for n, x, y in (("q1", 1, 0), ("q2", 0, 1), ("q3", -1, 0), ("q4", 0, -1), ("q0", 0, 0))))
    assert (r.x, r.touch, r.d, r.rd) == (True, False, 3.0, 2.0)
    assert math.isclose(r.a, 0.2)
    assert [r.q1, r.q2, r.q3, r.q4, r.q0] == [1, 2, 3, 4, 0]


def test_half_up_and_offsets(spark):
    from tessella.functions.grids import grid

    g = grid("NS3")
    c = G.cell(F.lit(-7), F.lit(2))
    r = one(spark, G.half_up(F.lit(-0.5)).alias("h"), G.local_root(c, g).alias("r"), G.variant(F.lit(-7), g).alias("v"), G.times(G.cell(F.lit(3), F.lit(-3)), 0.5).alias("t"), G.is_lattice_offset(G.cell(F.lit(18), F.lit(1)), g).alias("l"), G.inverse(c).alias("i"), G.minus(c, c).alias("z"), G.shift_variant(c, 4, g).alias("s"))
    assert (r.h, tuple(r.r), r.v, tuple(r.t), r.l, tuple(r.i), tuple(r.z), tuple(r.s)) == (0, (-9, 2), 2, (2, -1), True, (7, -2), (0, 0), (-5, 2))


def test_degeneracies_and_labels(spark):
    bent = [(0, 0), (1, 0), (2, 0), (3, 0), (3, 3), (0, 3)]
    crescent = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 9), (9, 9), (9, 1), (0, 1)]
    r = one(spark, remove_degeneracies(ring(*bent)).alias("d"), label_point(ring(*crescent)).alias("l"))
    assert [(p.x, p.y) for p in r.d] == [(0, 0), (3, 0), (3, 3), (0, 3)]
    from tessella.functions.grids import inside

    assert inside(np.array(crescent, float), r.l.x, r.l.y)
    assert np.allclose(label_place(np.array(square(0, 0, 2), float)), (1, 1))


def test_transforms(spark):
    t = G.transform(F.lit(2.0), F.lit(-1.0), F.lit(1.0), F.lit(3.0))
    there = G.apply(t, F.lit(4.0), F.lit(5.0))
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("left", "bottom", "right", "top"), strict=True)))
    r = one(spark, there.alias("p"), G.unapply(t, there["x"], there["y"]).alias("q"), G.fit_box(box(0, 0, 2, 1), box(0, 0, 10, 10)).alias("f"), G.guide_point(F.lit(5.0), F.lit(7.0), F.lit(2.0), F.lit(1.0), F.lit(1.0)).alias("g"))
    assert (tuple(r.p), tuple(r.q), tuple(r.g)) == ((9.0, -2.0), (4.0, 5.0), (2.0, 3.0))
    assert tuple(r.f) == (5.0, 5.0, 0.0, 2.5)


def test_colors(spark):
    import colorsys

    rows = spark.createDataFrame([(h / 10, b / 4) for h in range(10) for b in range(5)], "h double, b double")
    for r in rows.select("h", "b", C.hsb(F.col("h"), 0.7, F.col("b")).alias("c")).collect():
        want = [math.floor(v * 255 + 0.5) for v in colorsys.hsv_to_rgb(r.h, 0.7, r.b)]
        assert all(abs(a - b) <= 1 for a, b in zip(want, r.c, strict=True))
    v = F.col("v")
    got = spark.createDataFrame([(0.0,), (1.0,), (5.0,), (-1.0,), (None,)], "v double").select(C.quality_color(v, F.lit(0.0), F.lit(1.0), True).alias("c"), C.comparison_color(v, 0, 0.5, 1).alias("k")).collect()
    assert [tuple(r.c) for r in got] == [C.DARK, C.LIGHT, C.LIGHT, C.DARK, C.GREY]
    assert [tuple(r.k) for r in got[:4]] == [C.LIGHT, (0, 0, 0), (0, 0, 0), C.LIGHT]
    assert tuple(one(spark, C.palette_color(F.lit(12)).alias("c")).c) == C.PALETTE[0]
    flat = spark.createDataFrame([("m", 1.0, 2.0)], "map_id string, x double, y double")
    assert C.color_sites(flat).count() == C.color_sites(flat, "radial", middle=(0.3, 0.4), zero_angle=90).count() == 1
