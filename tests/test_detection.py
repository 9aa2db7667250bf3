"""Tiled components, contours, rooms by class, cleaning, resizing and brush strokes against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import detect, raster, steps, strokes


def pixels_of(spark, mask, page=1, **more):
    y, x = np.nonzero(mask)
    rows = [(page, int(a), int(b), *more.values()) for a, b in zip(y, x, strict=True)]
    return spark.createDataFrame(rows, ", ".join(["page_id long, y int, x int", *[f"{k} {'string' if isinstance(v, str) else 'int'}" for k, v in more.items()]]))


def flood(mask, eight):
    """Label (smallest pixel) of each set pixel, by flooding."""
    label, h, w = {}, *mask.shape
    ways = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if eight else [])
    for start in zip(*map(list, np.nonzero(mask)), strict=True):
        if start in label:
            continue
        todo = [start]
        label[start] = start
        while todo:
            y, x = todo.pop()
            for dy, dx in ways:
                at = (y + dy, x + dx)
                if 0 <= at[0] < h and 0 <= at[1] < w and mask[at] and at not in label:
                    label[at] = start
                    todo.append(at)
    return label


@pytest.mark.parametrize("eight", [False, True])
def test_components_across_tiles(spark, eight):
    rng = np.random.default_rng(1)
    masks = [rng.random((23, 31)) < 0.55, np.ones((9, 40), bool)]
    spiral = np.zeros((25, 25), bool)
    spiral[0], spiral[:, 24], spiral[24], spiral[4:, 0], spiral[4, :20], spiral[4:20, 20], spiral[20, 4:20] = (True,) * 7
    masks.append(spiral)
    union = None
    for page, mask in enumerate(masks):
        one = pixels_of(spark, mask, page)
        union = one if union is None else union.unionByName(one)
    for tile in (7, 1024):
        got = {(r.page_id, r.y, r.x): (r.label_y, r.label_x) for r in raster.components(union, eight=eight, tile=tile).collect()}
        want = {(page, *at): first for page, mask in enumerate(masks) for at, first in flood(mask, eight).items()}
        assert got == want


def test_components_stay_inside_a_layer_and_an_empty_table(spark):
    mask = np.ones((6, 6), bool)
    both = pixels_of(spark, mask, layer=1).unionByName(pixels_of(spark, mask & (np.arange(6) != 3), layer=2))
    got = raster.components(both, by=("page_id", "layer"), tile=2).groupBy("layer").agg(F.countDistinct("label_y", "label_x").alias("n")).collect()
    assert {r.layer: r.n for r in got} == {1: 1, 2: 2}
    assert raster.components(both.where("false"), by=("page_id", "layer")).collect() == []


def test_contraction_of_a_long_chain(spark):
    links = spark.createDataFrame([(1, k, k + 1) for k in range(60)] + [(2, 5, 9), (2, 9, 5), (2, 7, 7)], "page_id long, u long, v long")
    got = {(r.page_id, r.node): r.root for r in steps.contract(links, ["page_id"]).collect()}
    assert got == {(1, k): 0 for k in range(61)} | {(2, 5): 5, (2, 9): 5}


def test_contours_follow_the_outside(spark):
    ring = np.zeros((12, 12), bool)
    ring[1:11, 1:11] = True
    ring[4:8, 4:8] = False
    touching = np.zeros((9, 9), bool)
    touching[0, 4], touching[1:4, 1:4], touching[1:4, 5:8] = True, True, True
    dot = np.zeros((3, 3), bool)
    dot[1, 1] = True
    for mask, length, area in ((ring, 36.0, 81.0), (touching, 16 + 4 * 2**0.5, 8.0), (dot, 0.0, 0.0)):
        r = detect.contours(raster.components(pixels_of(spark, mask), eight=True)).first()
        assert abs(r.perimeter - length) < 1e-9 and abs(r.contour_area - area) < 1e-9


def test_rooms_by_class(spark):
    classes = np.zeros((60, 90), int)
    classes[5:35, 5:35] = 3  # a kitchen with a hall inside
    classes[12:20, 12:20] = 7
    classes[5:35, 37:67] = 3  # another, two pixels from the first
    classes[10:12, 33:39] = 3  # a bridge that the opening removes
    classes[40:58, 5:30] = 11  # too small for a room: 450 pixels
    classes[40:58, 40:90] = 5
    y, x = np.indices(classes.shape)
    frame = spark.createDataFrame([(4, int(a), int(b), int(c)) for a, b, c in zip(y.ravel(), x.ravel(), classes.ravel(), strict=True)], "page_id long, y int, x int, room_cls int")
    got = [tuple(r) for r in detect.class_rooms(frame, 60, 90).orderBy("room_seq").collect()]
    assert [(r[1], r[2], r[3], r[4], r[6], r[7]) for r in got] == [(1, 3, "Kitchen", 900 - 64, 19, 19), (2, 3, "Kitchen", 900, 51, 19), (3, 5, "Bedroom", 900, 64, 48)]
    assert [r[5] for r in got] == [116.0, 116.0, 2 * (17 + 49)]
    pages = spark.createDataFrame([(4, 10.0), (5, 0.0), (6, None)], "page_id long, scale_factor double")
    masks = pixels_of(spark, np.ones((12, 12), bool), 4).withColumn("class", F.lit("door")).unionByName(pixels_of(spark, np.ones((3, 40), bool), 4).withColumn("class", F.lit("wall")))
    rows = {r.page_id: r for r in detect.summary(pages, masks, detect.class_rooms(frame, 60, 90)).collect()}
    assert (rows[4].wall_length, rows[4].doors, rows[4].windows, rows[4].rooms, rows[4].room_area) == (41.0, 1, 0, 3, 2636)
    assert rows[4].real_length == 4.1 and rows[4].real_area == 26.36 and rows[5].rooms == 0 and rows[5].real_length is None and rows[6].real_area is None


def test_annotation_cleaning(spark):
    page = np.full((40, 40), 250)
    page[5:20, 5:20] = 30  # thick ink stays
    page[30, :] = 40  # a line goes, with its margin
    y, x = np.indices(page.shape)
    frame = spark.createDataFrame([(1, int(a), int(b), int(c)) for a, b, c in zip(y.ravel(), x.ravel(), page.ravel(), strict=True)], "page_id long, y int, x int, gray int")
    got = {(r.y, r.x): r.gray for r in raster.clean_annotations(frame, 40, 40).collect()}
    want = page.copy()
    want[29:32] = 255
    assert got == {(a, b): want[a, b] for a in range(40) for b in range(40)}
    clean = frame.where("y < 35").withColumn("gray", F.when(F.col("y") < 10, 255).otherwise(F.lit(100)))
    got = {(r.y, r.x): r.gray for r in raster.clean_annotations(frame, 40, 40, clean).collect()}
    want = page.copy()
    want[:10][want[:10] < 200] = 255
    assert got == {(a, b): want[a, b] for a in range(40) for b in range(40)}


@pytest.mark.parametrize("size", [(5, 7), (64, 3), (150, 45), (10, 14)])
def test_resize_by_nearest_index(spark, size):
    a = np.arange(70).reshape(10, 7)
    y, x = np.indices(a.shape)
    frame = spark.createDataFrame([(1, int(p), int(q), int(v)) for p, q, v in zip(y.ravel(), x.ravel(), a.ravel(), strict=True)], "page_id long, y int, x int, v int")
    got = {(r.y, r.x): r.v for r in raster.resize(frame, 10, 7, *size).collect()}
    want = raster.resize_nearest(a, *size)
    assert got == {(p, q): want[p, q] for p in range(size[0]) for q in range(size[1])}


def near(points, h, w, reach=6.0):
    out = np.zeros((h, w), bool)
    for (x0, y0), (x1, y1) in zip(points[:-1], points[1:], strict=True):
        for y in range(h):
            for x in range(w):
                n = (x1 - x0) ** 2 + (y1 - y0) ** 2
                t = min(1, max(0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / n)) if n else 0
                out[y, x] |= (x - x0 - t * (x1 - x0)) ** 2 + (y - y0 - t * (y1 - y0)) ** 2 <= reach**2 + 1e-9
    return out


def test_brush_strokes(spark):
    drawings = [(1, [(10.0, 10.0), (30.0, 22.5), (5.0, 40.0)]), (2, [(-4.0, 5.0), (70.0, 5.0)]), (3, [(20.0, 20.0), (20.0, 20.0)]), (4, [(3.0, 3.0)]), (5, []), (6, None), (7, [(-500.0, -500.0), (-400.0, -450.0)])]
    rows = [(k, None if p is None else [{"x": a, "y": b} for a, b in p]) for k, p in drawings]
    frame = spark.createDataFrame(rows, "click_id long, points array<struct<x:double,y:double>>")
    got = {}
    for r in strokes.brush_runs(frame, ["click_id"], height=48, width=60).collect():
        got.setdefault(r.click_id, set()).update((r.y, x) for x in range(r.x0, r.x1 + 1))
    for k, points in drawings[:3]:
        assert got[k] == set(zip(*map(list, np.nonzero(near(points, 48, 60))), strict=True))
    assert set(got) == {1, 2, 3}
    image = raster.unpng(bytes(strokes.brush_png(frame.where("click_id = 1"), ["click_id"], height=48, width=60).first().png))
    assert (image[:, :, 3] > 0).sum() == len(got[1]) and image.shape == (48, 60, 4)


def test_openings(spark):
    rows = [(1, 100.7, 100.0, 150.2, 100.0, 25.0), (2, 3.0, 3.0, 3.0, 3.0, None), (3, 1990.0, 5.0, 2100.0, 5.0, 0.0)]
    got = {r.click_id: r for r in strokes.openings(spark.createDataFrame(rows, "click_id long, x0 double, y0 double, x1 double, y1 double, scale_factor double"), ["click_id"]).collect()}
    assert got[1].pixels == near([(100, 100), (150, 100)], 120, 170).sum() and abs(got[1].length - 49.5) < 1e-9 and abs(got[1].real_length - 1.98) < 1e-9
    # Through pixel centres: a box of 50 x 12 and two half discs.
    assert abs(got[1].area - 705) < 15 and abs(got[1].real_area - got[1].area / 625) < 1e-9
    assert (got[2].length, got[2].real_area, got[2].real_length) == (0.0, None, 0.0) and got[3].real_length == 0.0 and 0 < got[3].pixels < 250


def test_decoded_masks(spark):
    import base64

    a = np.zeros((6, 8), np.uint8)
    a[1:3, 2:5], a[5, 7] = 200, 9
    grey, rgb, alpha = a[:, :, None], np.dstack([a, a, a]), np.dstack([np.full_like(a, 255)] * 3 + [a])
    text = lambda image: base64.b64encode(raster.png(image)).decode()
    rows = [(1, text(grey)), (2, "data:image/png;base64," + text(rgb)), (3, text(alpha)), (4, text(grey)[:30]), (5, ""), (6, None), (7, "not base64!")]
    masks = spark.createDataFrame(rows, "page_id long, mask_b64 string")
    for over, image in ((10, a > 10), (5, a > 5)):
        got = {}
        for r in raster.decoded(masks, 13, 4, alpha_over=over, gray_over=over).collect():
            got.setdefault(r.page_id, set()).update((r.y, x) for x in range(r.x0, r.x1 + 1))
        want = set(zip(*map(list, np.nonzero(raster.resize_nearest(image, 13, 4))), strict=True))
        assert got == {k: want for k in (1, 2, 3)}


def test_prompts_and_weights(spark, tmp_path):
    from plumbline.operators import inference
    from plumbline.plans import stand_ins

    assert inference.discover(spark, [str(tmp_path / "none")]) is None
    page = np.full((20, 20), 250)
    page[8:12, 8:12] = 10
    y, x = np.indices(page.shape)
    frame = spark.createDataFrame([(1, int(a), int(b), int(c)) for a, b, c in zip(y.ravel(), x.ravel(), page.ravel(), strict=True)], "page_id long, y int, x int, gray int")
    images = inference.page_images(frame, 20, 20)
    point = "array<struct<x:double,y:double,label:int>>"
    prompts = spark.createDataFrame(
        [(1, 1, [{"x": 10.0, "y": 10.0, "label": 1}], None), (2, 1, [{"x": 10.0, "y": 10.0, "label": 1}], [8.0, 8.0, 11.0, 11.0]), (3, 1, None, None), (4, 2, [{"x": 1.0, "y": 1.0, "label": 1}], None)],
        f"key long, page_id long, points {point}, box array<double>")
    loader = stand_ins.shipped(spark, "file://" + str(tmp_path), stand_ins.Squares)
    got = {r.key: r for r in inference.best_masks(images, prompts, loader).collect()}
    assert set(got) == {1, 2} and (got[1].best, got[1].score) == (0, 16 / 49) and (got[2].best, got[2].score) == (0, 1.0)
    assert [tuple(r) for r in got[2].runs] == [(k, 8, 11) for k in range(8, 12)]


class Counting:
    """Squares that write a line for each prompt."""

    def __init__(self, path):
        from plumbline.plans import stand_ins

        self.inner, self.log = stand_ins.Squares(path), path + ".asked"
        self.set_image = self.inner.set_image

    def predict(self, points, labels, box):
        with open(self.log, "a") as file:
            file.write("asked\n")
        return self.inner.predict(points, labels, box)


def test_equal_prompts_are_asked_once(spark, tmp_path):
    import json

    from plumbline.operators import inference

    weights = tmp_path / "weights"
    weights.write_text(json.dumps({"radii": [1, 2]}))
    images = spark.createDataFrame([(1, 8, 8, bytes(range(100, 164)))], "page_id long, height int, width int, gray binary")
    rows = [(k, 1, [{"x": 3.0 + k % 2, "y": 3.0, "label": 1}], [0.0, 0.0, 4.0, 4.0] if k % 3 == 0 else None) for k in range(48)]
    prompts = spark.createDataFrame(rows, "key long, page_id long, points array<struct<x:double,y:double,label:int>>, box array<double>")
    got = inference.best_masks(images, prompts, lambda: Counting(str(weights))).collect()
    assert {r.key for r in got} == set(range(48)) and len({(r.key % 6, tuple(map(tuple, r.runs)), r.score) for r in got}) == 6
    assert len((tmp_path / "weights.asked").read_text().splitlines()) == 4


def test_rooms_by_table_function_equal_those_of_groups(spark, sf):
    from plumbline.operators import rooms
    from plumbline.plans.relations import HEIGHT, WIDTH, workspace

    ink = workspace(spark, sf)["ink2"]
    options = {"close": 0, "min_share": 0.002}
    want = sorted(map(tuple, rooms.split_rooms(ink, HEIGHT, WIDTH, **options).drop("mask").collect()))
    assert sorted(map(tuple, rooms.room_function(HEIGHT, WIDTH, **options)(ink.asTable().partitionBy("page_id")).collect())) == want and want
    spark.udtf.register("page_rooms", rooms.room_function(HEIGHT, WIDTH, **options))
    ink.createOrReplaceTempView("ink_pixels")
    assert spark.sql("SELECT * FROM page_rooms(TABLE(ink_pixels) PARTITION BY page_id)").count() == len(want)


def test_openings_of_one_shape_are_measured_once(spark, monkeypatch):
    from plumbline.operators import strokes

    rows = [(k, float(a), float(b), float(c), float(d), 2.0) for k, (a, b, c, d) in enumerate(
        [(x, y, x + dx, y + dy) for x in (0, 3, 11, 12, 500, 1970, 1999) for y in (-2, 5, 40, 1990) for dx, dy in ((0, 0), (7, 3), (-5, 9))])]
    got = strokes.openings(spark.createDataFrame(rows, "k long, x0 double, y0 double, x1 double, y1 double, scale_factor double"), ["k"]).collect()
    for r in got:
        _, _, mask = strokes.paint(np.array(rows[r.k][1:5]).reshape(2, 2), 12.0, 2000, 2000)
        assert (r.pixels, r.area) == (mask.sum(), strokes.precise_area(np.pad(mask, 1)))
    plan = strokes.openings(spark.range(9).selectExpr("id", "100D + id as x0", "100D as y0", "110D + id as x1", "104D as y1", "1D as scale_factor").coalesce(1), ["id"])
    assert plan.rdd.getNumPartitions() > 1  # the few bytes of a table of clicks do not make one task of all its drawings


def test_rooms_are_split_and_named_in_one_task(spark, sf):
    """The page's kernel names rooms as ``name_rooms`` does, and it stands once in the plan: no room's runs are joined with labels."""
    from plumbline.operators import rooms
    from plumbline.plans import catalog

    rng = np.random.default_rng(8)
    walls = [(p, *a, 2) for p in (1, 2, 3) for k in range(5) for a in [(10.0, 10.0 + 20 * k, 170.0, 10.0 + 20 * k), (10.0 + 40 * k, 10.0, 10.0 + 40 * k, 90.0)]]
    lines = spark.createDataFrame(walls, "page_id long, x0 double, y0 double, x1 double, y1 double, thick int")
    texts = [(int(rng.integers(1, 5)), str(rng.choice(["Hall", "Stue", "Bad"])), float(rng.integers(0, 200)) / 2, float(rng.integers(0, 110)) / 2, bool(rng.random() < 0.8)) for _ in range(40)]
    labels = spark.createDataFrame([t for t in texts if t[0] != 3], "page_id long, text string, x double, y double, is_room_label boolean")
    want = rooms.name_rooms(rooms.split_lines(lines, 110, 200, scale=2.0, close=1), labels, reach=6.0, scale=2.0).collect()
    got = rooms.named_rooms(lines, labels, 110, 200, scale=2.0, close=1, reach=6.0).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got[0].asDict().keys() == want[0].asDict().keys()
    assert {"Room"} < {t.name.split()[0] for t in got} and len(got) > 40
    plan = catalog.queries()["ras33_vector_rooms"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1 and "explode(runs" not in plan


def test_a_wands_page_is_gathered_once(spark, sf):
    """The item hit and its layer are found in one task a page; a layer's mask is the item's pixels as ``spine`` has them, widened."""
    import pandas as pd

    from plumbline.operators import drawings
    from plumbline.plans import catalog

    plan = catalog.queries()["ras32_magic_wand"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1 and "explode(sides" not in plan
    rng = np.random.default_rng(4)
    corners = {"l": 2, "re": 2, "qu": 4}
    kinds = [str(rng.choice(list(corners))) for _ in range(40)]
    rows = [(1, k, str(rng.choice(["fill", "stroke"])), str(rng.choice(["A", "B"])), None, float(rng.choice([1.0, 1.4, 12.0])), kind, [tuple(map(float, rng.integers(-10, 150, 2))) for _ in range(corners[kind])]) for k, kind in enumerate(kinds)]
    items = spark.createDataFrame(rows, "page_id long, item_id long, type string, color string, fill string, width double, kind string, points array<struct<x:double,y:double>>")
    frame = pd.DataFrame([(k, t, w, kind, [p[0] for p in at], [p[1] for p in at], t + c) for _, k, t, c, _, w, kind, at in rows], columns=["item_id", "type", "width", "kind", "xs", "ys", "kind_of"])
    page = drawings._Page(frame, 0.25, 30, 35)
    for k, wide in ((0, 1.0), (7, 12.0)):
        like = [i for _, i, t, c, _, w, *_ in rows if (t, c) == rows[k][2:4] and abs(w - wide) <= 0.5]
        want = np.zeros((30, 35), bool)
        for s in drawings.spine(items.where(F.col("item_id").isin(like)), F.lit(max(2, int(wide * 0.25))), 0.25, "item_id").collect():
            want[max(0, s.y - s.reach) : max(0, s.y + s.reach + 1), max(0, s.x - s.reach) : max(0, s.x + s.reach + 1)] = True
        assert want.any() and (page._mask(page.kind[k], wide) == want).all()


def test_labels_of_gaps_are_dealt_by_page_once(spark, sf):
    """Texts, edges, and gaps with labels are dealt once each; the nearest text is that of all pairs, ties by text."""
    from plumbline.operators import gaps
    from plumbline.plans import catalog

    rng = np.random.default_rng(6)
    own = [(int(p), k, float(x), float(y)) for k, (p, x, y) in enumerate(rng.integers(0, (3, 60, 60), (80, 3)))]
    points = [(int(p), float(x), float(y), t) for p, x, y, t in zip(*rng.integers(0, (3, 60, 60), (60, 3)).T, rng.choice(list("abcd"), 60), strict=True)]
    got = gaps.nearest_text(spark.createDataFrame(own, "page_id long, gap_id long, mx double, my double"), spark.createDataFrame(points, "page_id long, px double, py double, text string"), 9.0).collect()
    near = lambda g: [(np.hypot(p[1] - g[2], p[2] - g[3]), p[3]) for p in points if p[0] == g[0]]
    want = {(g[0], g[1]): min(((round(d, 9), t) for d, t in near(g) if d < 9), default=(0, None))[1] for g in own}
    assert {(r.page_id, r.gap_id): r.text for r in got} == want and len(got) == 80 and 0 < sum(t is None for t in want.values()) < 80
    plan = catalog.queries()["jn12_label_fallback"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and "Join" not in plan
    generate = plan.index("Generate posexplode(split(")
    assert "Exchange" in plan[generate:] and plan[generate:].count("Exchange") == 1  # texts, not their words
