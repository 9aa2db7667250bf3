"""Truth tables, invariants and tiny plans."""

import json
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators import drawings, edges, gaps, graph, labels, measure, raster, rooms, spatial, state, steps
from plumbline.sources import documents, fixtures
from plumbline.streaming import clicks


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(expr.alias("v")).first().v


def test_angles(spark):
    rows = [(9.99, True), (10.0, False), (80.01, True), (80.0, False), (170.0, False), (170.01, True), (90.0, True), (45.0, False)]
    table = spark.createDataFrame(rows, "a double, want boolean")
    assert table.where(g.is_axis(F.col("a")) != F.col("want")).count() == 0
    hatch = [(20.0, 5.0, False), (20.01, 19.99, True), (69.99, 19.99, True), (70.0, 5.0, False), (45.0, 20.0, False), (110.01, 5.0, True), (160.0, 5.0, False)]
    table = spark.createDataFrame(hatch, "a double, l double, want boolean")
    assert table.where(g.is_hatch(F.col("a"), F.col("l")) != F.col("want")).count() == 0
    pairs = [(0.0, 90.0, True), (45.0, 55.0, True), (45.0, 135.0, False), (0.0, 45.0, False)]
    table = spark.createDataFrame(pairs, "a double, b double, want boolean")
    assert table.where(g.orientations_compatible(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_distances_and_widths(spark):
    rows = [(0.0, 3.0, 0.0, 0.0, 10.0, 0.0, 3.0), (13.0, 4.0, 0.0, 0.0, 10.0, 0.0, 5.0), (3.0, 4.0, 0.0, 0.0, 0.0, 0.0, 5.0)]
    table = spark.createDataFrame(rows, "px double, py double, ax double, ay double, bx double, by double, want double")
    got = table.select(g.point_segment_distance(*(F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by"))).alias("d"), "want").collect()
    assert all(r.d == pytest.approx(r.want) for r in got)
    widths = [(None, None, True), (None, 1.0, False), (1.0, 1.5, True), (1.0, 1.51, False)]
    assert spark.createDataFrame(widths, "a double, b double, w boolean").where(g.width_matches(F.col("a"), F.col("b")) != F.col("w")).count() == 0


def test_polylines(spark):
    got = spark.createDataFrame([("0,0 3,4 3,4",), ("1,2 x",), ("1,2 a,b",), ("",)], "t string").select(g.parse_polyline(F.col("t")).alias("p")).select(F.size("p").alias("n"), g.polyline_length(F.col("p")).alias("l")).collect()
    assert [(r.n, r.l) for r in got][:2] == [(3, 5.0), (1, None)] and got[2].l is None and got[3].l is None


def test_room_labels(spark):
    want = {"entré": True, "Køkken 2": True, "KØKKEN": True, "Badeværelse": True, "r12": True, "R1234": False, "stuen": False, "gæsteværelse": True}
    got = spark.createDataFrame([(k,) for k in want], "t string").select("t", labels.names_room(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in got} == want
    sizes = {"12,5 mm": True, "3.4": True, "N": True, "±": True, "12 km": False, "Hall": False}
    got = spark.createDataFrame([(k,) for k in sizes], "t string").select("t", labels.is_dimension(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in got} == sizes


WALLS = [(0, 0, 0, 100, 0), (0, 130, 0, 230, 0), (0, 0, 100, 230, 100), (0, 0, 0, 0, 100), (0, 230, 0, 230, 100)]


def plan(spark, extra=()):
    rows = [(page, k, "line", True, False, 1.0, float(a), float(b), float(c), float(d), None, False) for k, (page, a, b, c, d) in enumerate([*WALLS, *extra])]
    raw = spark.createDataFrame(rows, "page_id long, raw_id long, object_type string, stroke boolean, fill boolean, linewidth double, x0 double, y0 double, x1 double, y1 double, color string, is_dashed boolean")
    return edges.normalise(raw)


def test_gap_becomes_door_window_or_opening(spark):
    arcs = spark.createDataFrame([(0, 1, 4, 115.0, 10.0, 30.0)], "page_id long, curve_id long, n_pts int, cx double, cy double, size double")
    none = arcs.where("false")
    e = plan(spark)
    gap = gaps.dedup_gaps(gaps.collinear_gaps(edges.walls(e)))
    assert [(r.width, r.mx, r.my) for r in gap.collect()] == [(30.0, 115.0, 0.0)]
    assert [r.type for r in gaps.classify(gap, arcs, e).collect()] == ["door"]
    assert [r.type for r in gaps.classify(gap, none, e).collect()] == ["opening"]
    lines = plan(spark, [(0, 100, y, 130, y) for y in (-4, 0, 4)])
    assert [r.type for r in gaps.classify(gap, none, lines).collect()] == ["window"]
    click = spark.createDataFrame([(7, 0, 120.0, 30.0), (8, 0, 115.0, 80.0)], "click_id long, page_id long, x double, y double")
    assert [r.click_id for r in gaps.pick(click, gaps.classify(gap, arcs, e), "door").collect()] == [7]


def test_erase_is_monotone_and_idempotent(spark):
    e = plan(spark)
    chosen = e.select("page_id", "edge_id")
    few = spark.createDataFrame([(0, 50.0, 3.0)], "page_id long, px double, py double")
    more = few.union(spark.createDataFrame([(0, 3.0, 50.0)], "page_id long, px double, py double"))
    a = {r.edge_id for r in spatial.erase(chosen, e, few).collect()}
    b = {r.edge_id for r in spatial.erase(chosen, e, more).collect()}
    assert a == {1, 2, 3, 4} and b == {1, 2, 4}
    assert {r.edge_id for r in spatial.erase(spatial.erase(chosen, e, few), e, few).collect()} == a


def test_two_rooms(spark):
    mask = np.zeros((60, 100), bool)
    mask[10, 10:91] = mask[50, 10:91] = True
    mask[10:51, 10] = mask[10:51, 50] = mask[10:51, 90] = True
    found = rooms.split_array(mask, close=1)
    assert len(found) == 2 and all(f["wall_count"] == 4 for f in found)
    assert all(abs(f["area"] - 40 * 40) < 250 for f in found)
    ys, xs = np.nonzero(mask)
    table = spark.createDataFrame([(1, int(y), int(x)) for y, x in zip(ys, xs, strict=True)], "page_id long, y int, x int")
    named = rooms.name_rooms(rooms.split_rooms(table, 60, 100), spark.createDataFrame([(1, "Hall", 30.0, 30.0, True), (1, "Hall", 70.0, 30.0, True)], "page_id long, text string, x double, y double, is_room_label boolean"), reach=9.0)
    assert sorted(r.name for r in named.collect()) == ["Hall 1", "Hall 2"]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.booleans())
def test_label_array_is_flood_fill(seed, eight):
    rng = np.random.default_rng(seed)
    mask = rng.random((rng.integers(1, 14), rng.integers(1, 14))) < 0.5
    got, h, w = raster.label_array(mask, eight), *mask.shape
    want = np.zeros((h, w), int)
    for i in range(h * w):
        if mask.flat[i] and not want.flat[i]:
            todo, want.flat[i] = [(i // w, i % w)], i + 1
            while todo:
                y, x = todo.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        v, u = y + dy, x + dx
                        if (eight or not (dy and dx)) and 0 <= v < h and 0 <= u < w and mask[v, u] and not want[v, u]:
                            want[v, u] = i + 1
                            todo.append((v, u))
    assert (got == want).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_kernels(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((12, 9)) < 0.7
    free = np.argwhere(~mask)
    if len(free):
        want = np.sqrt(((np.argwhere(np.ones_like(mask))[:, None] - free[None]) ** 2).sum(2).min(1)).reshape(mask.shape)
        assert np.allclose(raster.distance_transform(mask), want)
    rgba = rng.integers(0, 256, (7, 5, 4)).astype(np.uint8)
    assert (raster.unpng(raster.png(rgba)) == rgba).all()
    assert (raster.unpng(filtered_png(rgba, rng.integers(0, 5, 7))) == rgba).all()
    grown = rooms.grow(mask, 1)
    assert (grown >= mask).all() and grown.sum() >= mask.sum()


def filtered_png(rgba, kinds):
    """A PNG whose rows use the given filters, pixel by pixel."""
    import struct
    import zlib

    h, w, n = rgba.shape
    rows = b""
    for y in range(h):
        rows += bytes([kinds[y]])
        for x in range(w):
            for c in range(n):
                a = int(rgba[y, x - 1, c]) if x else 0
                b = int(rgba[y - 1, x, c]) if y else 0
                e = int(rgba[y - 1, x - 1, c]) if x and y else 0
                p = a + b - e
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - e), 2, e))[2]
                rows += bytes([(int(rgba[y, x, c]) - (0, a, b, (a + b) // 2, paeth)[kinds[y]]) % 256])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_distance_of_a_large_page():
    mask = np.zeros((2000, 1500), bool)
    mask[::100] = mask[:, ::100] = True
    assert raster.distance_transform(mask).max() == np.sqrt(2)  # where two lines cross
    assert raster.distance_transform(np.ones((3, 4), bool)).min() == 7


def test_contours():
    mask = np.zeros((20, 30), bool)
    mask[5:15, 4:25] = True
    ring = raster.contour(mask)
    assert len(raster.simplify(ring, 1.0)) == 4
    assert raster.area(ring) == 20 * 9 and raster.perimeter(ring) == 2 * (20 + 9)
    assert (raster.fill_polygon(raster.simplify(ring, 1.0), 20, 30) == mask).all()


def test_scale_null_and_zero(spark):
    rows = spark.createDataFrame([(50.0, None), (50.0, 0.0), (50.0, 25.0)], "v double, s double")
    assert [r[0] for r in rows.select(measure.real(F.col("v"), F.col("s"))).collect()] == [None, None, 2.0]


def test_state(spark):
    now = spark.createDataFrame([("a", 1.0, 2.4), ("b", None, 2.4)], "k string, s double, h double")
    new = spark.createDataFrame([("a", None, 3.0), ("b", None, None), ("c", 5.0, None)], "k string, s double, h double")
    got = {r.k: (r.s, r.h, r.status) for r in state.upsert(now, new, "k").collect()}
    assert got == {"a": (1.0, 3.0, "updated"), "b": (None, 2.4, "no_change"), "c": (5.0, None, "inserted")}


def test_workbooks_are_made_batch_by_batch(spark):
    rows = [(p, n, None if n == 2 else f"room {n}", p / 4 + n) for p in range(40) for n in (3, 1, 2)]
    made = documents.workbooks(spark.createDataFrame(rows, "project_id long, line long, a string, b double"))
    for r in made.collect():
        assert r.workbook == documents.workbook([["Room", "Value"], *[[None if n == 2 else f"room {n}", r.project_id / 4 + n] for n in (1, 2, 3)]])
    assert made.count() == 40
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().executedPlan().toString()  # no frame for each project


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"hello")
    found = documents.new_projects(documents.uploads(spark, str(tmp_path))).collect()
    assert [(r.filename, r.unit, r.wall_height, r.scale_factor) for r in found] == [("a.pdf", "m", 2.4, None)]
    import io
    import zipfile

    book = zipfile.ZipFile(io.BytesIO(documents.workbook([["a & b", 1.5], [None, 2]])))
    assert "a &amp; b" in book.read("xl/worksheets/sheet1.xml").decode()


def test_click_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n, rows in enumerate(([("p", 1, "x"), ("q", 1, "y")], [("p", 2, "z")])):
        (source / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("project_id", "seq", "v"), r, strict=True))) for r in rows))
    stream = spark.readStream.schema("project_id string, seq long, v string").option("maxFilesPerTrigger", 1).json(str(source))
    clicks.autosave(stream, str(tmp_path / "out"), str(tmp_path / "check"), "project_id", "seq").awaitTermination()
    last = spark.read.parquet(str(tmp_path / "out" / "v=1")).collect()
    assert {(r.project_id, r.v) for r in last} == {("p", "z"), ("q", "y")}


def test_bucketed_joins_equal_all_pairs(spark, sf):
    from plumbline.plans.relations import workspace

    w = workspace(spark, sf)
    walls = w["walls"].where("page_id < 3")
    found = {(r.page_id, r.ia, r.ib) for r in gaps.collinear_gaps(walls).collect()}
    rows, want = walls.collect(), set()
    for a in rows:
        for b in rows:
            if (a.page_id, a.orient) == (b.page_id, b.orient) and a.edge_id < b.edge_id and abs(a.perp - b.perp) <= 4 and (10 < b.lo - a.hi < 160 or 10 < a.lo - b.hi < 160):
                want.add((a.page_id, a.edge_id, b.edge_id))
    assert found == want and found


def test_render():
    assert fixtures.render("@half(@int(a, ), 2)".replace(", )", ")"), "spark") == "bround(CAST(a AS BIGINT), 2)"


def test_inference_by_stub(spark):
    from plumbline.operators import inference

    class Stub:
        def predict(self, image):
            out = np.zeros((44, *image.shape))
            out[21 + 3][image > 100] = 1
            out[33 + 2] = 1
            return out

    rows = [(1, 2, 2, bytes([0, 200, 50, 255])), (2, 1, 1, None)]
    got = inference.classify_pixels(spark.createDataFrame(rows, "page_id long, height int, width int, gray binary"), Stub).collect()
    assert [(r.page_id, bytes(r.room_cls), bytes(r.icon_cls)) for r in got] == [(1, bytes([0, 3, 0, 3]), bytes([2] * 4))]
    assert isinstance(inference.available(), list)
    names = spark.createDataFrame([("sam2_Base_Plus.pt",), ("x",)], "n string").select(inference.size_of(F.col("n")).alias("s")).collect()
    assert [r.s for r in names] == ["base_plus", "tiny"]


def test_every_click_is_answered(spark, sf):
    """Clicks on one pixel share its trace, and every click near ink has a row: ring distances by brute force."""
    from plumbline.plans import catalog
    from plumbline.plans.relations import WIDTH, workspace

    w = workspace(spark, sf)
    ink = {}
    for p in w["ink2"].collect():
        ink.setdefault(p.page_id, []).append((p.y, p.x))
    ink = {k: np.array(v) for k, v in ink.items()}
    height = w["raster"].agg({"y": "max"}).first()[0] + 1
    clicks = [(c.click_id, c.page_id % 8, int(c.y / 20), int(c.x / 20)) for c in w["clicks"].collect()]
    ring = {s: np.abs(ink[s[0]] - s[1:]).max(axis=1).min() for s in {c[1:] for c in clicks}}
    # Independently of the plans: every click within 25 pixels of ink has a stroke, every click on the page a wand.
    traced = catalog.queries()["ras12_trace_wall"](spark, sf).collect()
    assert sorted(t.click_id for t in traced) == sorted(c[0] for c in clicks if ring[c[1:]] <= 25) and all(t.n > 0 for t in traced)
    wands = {t.click_id: t for t in rooms.wand(w["ink2"], w.sql(catalog._EVERY_CLICK), height, WIDTH).collect()}
    on_ink = {(k, y, x) for k, v in ink.items() for y, x in v.tolist()}
    assert all(c[0] in wands and not wands[c[0]].filled for c in clicks if c[1:] in on_ink) and len(wands) > 100
    assert all(0 <= c[2] < height and 0 <= c[3] < WIDTH for c in clicks if c[0] in wands)
    assert catalog.queries()["ras38_cavity_fill"](spark, sf).count() == sum(t.filled for t in wands.values())
    hits = catalog.queries()["ras31_hybrid_select"](spark, sf).select("click_id").distinct().collect()
    assert len(hits) > len(clicks) / 10
    on_drawings = catalog.queries()["ras32_magic_wand"](spark, sf).collect()  # a click that meets an item selects strokes of its kind
    met = {t.click_id: t.item_id for t in catalog.queries()["jn14_topmost_drawing"](spark, sf).collect()}
    assert len(on_drawings) > 900 and all(met[t.click_id] == t.item_id and t.length > 0 for t in on_drawings)


def test_every_opening_is_drawn(spark, sf):
    """Openings and polylines of all clicks with a round brush of 12 pixels, by distance to the lines."""
    from plumbline.plans import catalog
    from plumbline.plans.relations import workspace

    def painted(points, height, width):
        y, x = np.indices((height, width))
        top, side = max(0, int(min(p[1] for p in points)) - 8), max(0, int(min(p[0] for p in points)) - 8)
        y, x = y[top : top + 70, side : side + 70], x[top : top + 70, side : side + 70]
        out = np.zeros(y.shape, bool)
        for (x0, y0), (x1, y1) in zip(points[:-1], points[1:], strict=True):
            n = (x1 - x0) ** 2 + (y1 - y0) ** 2
            t = np.clip(((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / n, 0, 1) if n else 0
            out |= (x - x0 - t * (x1 - x0)) ** 2 + (y - y0 - t * (y1 - y0)) ** 2 <= 36 + 1e-9
        return {(int(a), int(b)) for a, b in zip(y[out], x[out], strict=True)}

    lines, areas = {}, {}
    for c in workspace(spark, sf)["clicks"].collect():
        end = (c.x + c.click_id % 40, c.y + c.click_id % 30)
        lines[c.click_id] = painted([(c.x, c.y), (end[0], c.y), end], 842, 1191)
        areas[c.click_id] = len(painted([(c.x, c.y), end], 2000, 2000))
    got = {}
    for r in catalog.queries()["ras37_polyline_mask"](spark, sf).collect():
        got.setdefault(r.click_id, []).extend((r.y, x) for x in range(r.x0, r.x1 + 1))
    assert all(len(set(v)) == len(v) for v in got.values()) and {k: set(v) for k, v in got.items()} == lines
    assert {r.click_id: r.pixels for r in catalog.queries()["ras36_opening_line"](spark, sf).collect()} == areas


def test_vector_rooms_meet_no_barrier(spark, sf):
    """Narrow rooms between thick lines are found, and every wall, gap and polyline of a page is drawn."""
    from plumbline.plans import catalog
    from plumbline.plans.relations import workspace

    box = [(100, 100, 500, 100), (100, 200, 500, 200), (100, 100, 100, 200), (500, 100, 500, 200), (130, 100, 130, 200)]
    lines = spark.createDataFrame([(1, *map(float, b), 2) for b in box], "page_id long, x0 double, y0 double, x1 double, y1 double, thick int")
    found = rooms.split_lines(lines, 1060, 1500, scale=1.0, close=2).collect()
    assert sorted(r.wall_count for r in found) == [4, 4] and {round(r.cx) for r in found} == {115, 315}
    w = workspace(spark, sf)
    scale = 1500 / 1191
    barriers = catalog._barriers(w, scale)
    assert barriers.count() == w["walls"].count() + w["gaps"].count() + 2 * w["flat_paths"].count()
    page = barriers.where("page_id = 1").toPandas()
    mask = rooms.draw(page, 1060, 1500)
    for e in page.itertuples():
        x, y = int((e.x0 + e.x1) / 2 + 0.5), int((e.y0 + e.y1) / 2 + 0.5)
        assert not (0 <= x < 1500 and 0 <= y < 1060) or mask[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].any()
    assert catalog.queries()["ras33_vector_rooms"](spark, sf).where("cx < 0 or cy < 0 or cx > 1191 or cy > 842 or area <= 0").count() == 0


def test_pages_far_into_the_table(spark, tmp_path):
    """Rows of late pages, some of them missing, are dilated, closed, opened and cleaned as any others, each page by itself."""
    from plumbline.plans import catalog

    rng = np.random.default_rng(3)
    table = [(v, rng.normal(size=64).tolist()) for v in range(64 * 9000 + 50, 64 * 9001 + 14)]
    spark.createDataFrame(table, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    gray, there = {p: np.zeros((64, 64), int) for p in (9000, 9001)}, {p: np.zeros((64, 64), bool) for p in (9000, 9001)}
    for v, e in table:
        gray[v // 64][v % 64] = [int(abs(x) * 997) % 256 for x in e]
        there[v // 64][v % 64] = True
    want = {name: set() for name in ("ras05_dilate", "ras06_close", "ras06_open")}
    clean = {}
    for page in gray:
        ink, ink2 = (gray[page] >= 208) & there[page], (gray[page] % 8 < 3) & there[page]
        dilated = rooms.grow(ink, 1)
        thin = np.pad(ink2, ((0, 0), (1, 1)), constant_values=True)
        opened = np.pad(thin[:, :-2] & thin[:, 1:-1] & thin[:, 2:], ((0, 0), (1, 1)))
        for name, mask in {"ras05_dilate": dilated, "ras06_close": ~rooms.grow(~dilated, 1), "ras06_open": opened[:, :-2] | opened[:, 1:-1] | opened[:, 2:]}.items():
            want[name] |= {(page, int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)}
        clean |= {(page, y, x): 255 if dilated[y, x] else gray[page][y, x] for y in range(64) for x in range(64) if there[page][y, x]}
    for name, pixels in want.items():
        assert {(r.page_id, r.y, r.x) for r in catalog.queries()[name](spark, str(tmp_path)).collect()} == pixels, name
    assert {(r.page_id, r.y, r.x): r.gray for r in catalog.queries()["ras19_clean"](spark, str(tmp_path)).collect()} == clean
    off = spark.createDataFrame([(0, 12, 3), (0, -9, 3), (0, 10, 1)], "page_id long, y int, x int")
    assert {(r.y, r.x) for r in raster.dilate(off, 1, 1, 10, 8).collect()} == {(9, 0), (9, 1), (9, 2)}


def test_hits_on_strokes_of_any_width(spark):
    """Strokes of 0 to 100 points against all pairs."""
    rng = np.random.default_rng(3)
    edges = [(1, k, *map(float, rng.uniform(0, 600, 4).round(1)), float([0, 1, 10, 100][k % 4]), k % 3 == 0) for k in range(80)] + [(1, 99, 10.0, 49.0, 90.0, 49.0, 10.0, True)]
    clicks = [(k, 1, *map(float, rng.uniform(0, 600, 2).round(1))) for k in range(120)] + [(500, 1, 50.0, 63.5), (501, 1, 50.0, 60.5)]
    got = spatial.hit_test(spark.createDataFrame(clicks, "click_id long, page_id long, x double, y double"), spark.createDataFrame(edges, "page_id long, edge_id long, x0 double, y0 double, x1 double, y1 double, lw double, structural boolean")).collect()
    want = {}
    for c, _, px, py in clicks:
        for _, e, x0, y0, x1, y1, lw, _s in edges:
            a, d = np.array([x0, y0]), np.array([x1 - x0, y1 - y0])
            t = np.clip(np.dot(np.array([px, py]) - a, d) / max(np.dot(d, d), 1e-12), 0, 1)
            dist = np.hypot(*(np.array([px, py]) - a - t * d)) - lw / 2
            if dist <= 10:
                want[c, e] = max(dist, 0)
    assert {(r.click_id, r.edge_id) for r in got} == want.keys() and {(500, 99), (501, 99)} <= want.keys()
    assert all(abs(r.dist - want[r.click_id, r.edge_id]) < 1e-9 for r in got)


def test_ring_search_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    pixels = sorted({(int(p), int(y), int(x)) for p, y, x in zip(rng.integers(0, 2, 60), rng.integers(0, 90, 60), rng.integers(0, 70, 60), strict=True)})
    clicks = [(k, k % 2, int(rng.integers(-10, 100)), int(rng.integers(-10, 80))) for k in range(150)]
    got = {r.click_id: (r.ring, r.y, r.x) for r in spatial.ring_search(spark.createDataFrame(clicks, "click_id long, page_id long, cy int, cx int"), spark.createDataFrame(pixels, "page_id long, y int, x int"), 7).collect()}
    want = {}
    for c, page, cy, cx in clicks:
        near = sorted((max(abs(y - cy), abs(x - cx)), y, x) for p, y, x in pixels if p == page)
        if near and near[0][0] <= 7:
            want[c] = near[0]
    assert got == want


def test_clicks_on_one_pixel_are_searched_once(spark):
    clicks = spark.createDataFrame([(k, 1, 5, 5 + k % 2) for k in range(60)], "click_id long, page_id long, cy int, cx int")
    pixels = spark.createDataFrame([(1, 5, 8, 2)], "page_id long, y int, x int, label int")
    rings, modes = spatial.ring_search(clicks, pixels, 7), spatial.window_mode(clicks, pixels, "label")
    assert {(r.click_id, r.ring) for r in rings.collect()} == {(k, 3 - k % 2) for k in range(60)} and {r.click_id for r in modes.collect()} == set(range(60))
    for found in (rings, modes):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"Generate explode.*Aggregate \[page_id#\d+L?, cy#\d+, cx#\d+\]", plan, re.DOTALL)  # equal pixels are one before they go to cells


def test_tracing_is_cut_at_junctions(spark):
    """A cross of two strokes: each arm is a selection; a slant is one by all runs together or the box around the click."""
    page = np.zeros((160, 160), bool)
    page[78:82, 5:155] = page[5:155, 78:82] = True
    for k in range(40):
        page[100 + k, 100 + k : 104 + k] = True
    ink = spark.createDataFrame([(1, int(y), int(x)) for y, x in zip(*np.nonzero(page), strict=True)], "page_id long, y int, x int")
    clicks = spark.createDataFrame([(1, 1, 80, 30), (2, 1, 80, 130), (3, 1, 30, 80), (4, 1, 120, 121), (5, 1, 40, 40)], "click_id long, page_id long, cy int, cx int")
    got = {}
    for r in rooms.trace_walls(ink, clicks, 160, 160).collect():
        got.setdefault(r.click_id, set()).add((r.y, r.x))
    left, right, up, slant = (got[k] for k in (1, 2, 3, 4))
    assert max(x for _, x in left) < 76 and min(x for _, x in right) > 84 and max(y for y, _ in up) < 76
    assert {(80, x) for x in range(6, 60)} <= left and not left & right
    assert all(70 < y < 78 and 70 < x < 78 for y, x in left & up)  # only where both were widened
    assert {(100 + k, 101 + k) for k in range(40)} <= slant and 5 not in got
    local = {(r.cy, r.cx): r.area for r in rooms.local_spots(ink, clicks, 160, 160).collect()}
    box = rooms.local_part(page, 120, 121, 60)
    assert local[120, 121] == box.sum() == rooms.grow(np.triu(np.tril(page, 3)) & (np.indices(page.shape)[0] >= 100), 2).sum() and (40, 40) not in local


def test_rooms_are_named_by_labels_inside(spark):
    lines = spark.createDataFrame([(1, *a, 2) for a in [(10.0, 10.0, 90.0, 10.0), (10.0, 50.0, 90.0, 50.0), (10.0, 10.0, 10.0, 50.0), (90.0, 10.0, 90.0, 50.0), (70.0, 10.0, 70.0, 50.0)]], "page_id long, x0 double, y0 double, x1 double, y1 double, thick int")
    labels = spark.createDataFrame([(1, "Corner", 6.5, 6.5, True), (1, "Near", 20.0, 4.0, True), (1, "Outside", 40.0, 3.0, True)], "page_id long, text string, x double, y double, is_room_label boolean")
    found = rooms.split_lines(lines, 60, 100, scale=2.0, close=1)
    named = sorted((round(r.cx), r["name"]) for r in rooms.name_rooms(found, labels, reach=5.0, scale=2.0).collect())
    assert named == [(20, "Corner"), (40, "Room 2")]


DRAWN = "page_id long, drawing_id long, type string, color string, fill string, width double, is_dashed boolean, items array<struct<kind:string,points:array<struct<x:double,y:double>>>>"


def test_wand_selects_like_strokes(spark):
    line = lambda *p: ("l", [p[:2], p[2:]])
    rows = [
        (0, 0, "s", "A", None, 1.0, False, [("re", [(0.0, 0.0), (99.0, 99.0)])]),  # the page's border, a background
        (0, 1, "s", "A", None, 1.0, False, [line(10.0, 10.0, 60.0, 10.0), line(60.0, 10.0, 60.0, 40.0)]),
        (0, 2, "s", "B", None, 1.0, False, [line(30.0, 5.0, 30.0, 50.0)]),  # crosses it in another colour
        (0, 3, "s", "A", None, 1.6, False, [line(10.0, 10.0, 10.0, 90.0)]),  # too wide to be like it
        (0, 4, "s", "A", None, 1.5, False, [line(10.0, 12.0, 20.0, 12.0)]),  # just like it, and touching
        (0, 5, "s", "A", None, 1.0, True, [line(12.0, 10.0, 12.0, 90.0)]),  # dashed
        (0, 6, "f", None, "K", None, None, [("re", [(70.0, 60.0), (80.0, 80.0)]), ("qu", [(70.0, 85.0), (80.0, 85.0), (85.0, 95.0), (75.0, 95.0)])]),
        (1, 7, "s", "A", None, 1.0, False, [line(10.0, 10.0, 20.0, 10.0)]),
    ]
    items = drawings.items(spark.createDataFrame(rows, DRAWN), 100.0, 100.0)
    assert [(r.page_id, r.item_id, r.kind) for r in items.orderBy("page_id", "item_id").collect()] == [(0, k, x) for k, x in enumerate(("l", "l", "l", "l", "l", "re", "qu"))] + [(1, 0, "l")]
    clicks = [(1, 0, 10, 40), (2, 0, 10, 30), (3, 0, 70, 75), (4, 0, 90, 78), (5, 0, 50, 3), (6, 0, 45, 95), (7, 1, 5, 100), (8, 1, 12, 15)]
    found = drawings.wand(spark.createDataFrame(clicks, "click_id long, page_id long, cy int, cx int"), items, 1.0, 100, 100)
    got = {r.click_id: (r.item_id, r.area, r.length) for r in found.collect()}
    assert set(got) == {1, 2, 3, 4, 5, 8}  # 6 is on bare paper, 7 off the page
    assert got[1][0] == 0 and got[2][0] == 2 and got[3] == (5, 200.0, 30.0) and got[4][0] == 6 and got[5][0] == 3 and got[8][0] == 0
    assert got[8][1:] == (24.0, 14.0) and got[2][1:] == (94.0, 49.0)
    assert got[4][1] == pytest.approx(100, abs=12) and got[1][2] > 80
    same = drawings.layers(items.select("page_id", "item_id"), items).where("page_id = 0").groupBy("layer").agg(F.sort_array(F.collect_list("item_id")).alias("l")).collect()
    assert {r.layer: r.l for r in same} == {0: [0, 1, 4], 2: [2], 3: [3, 4], 4: [0, 1, 3, 4], 5: [5, 6]}
    none = spark.createDataFrame([], "click_id long, page_id long, cy int, cx int")
    assert drawings.wand(none, items, 1.0, 100, 100).count() == 0 == drawings.wand(none.union(spark.createDataFrame(clicks)), items.limit(0), 1.0, 100, 100).count()


def test_mask_routing(spark):
    rows = [
        (1, 1, None, [3], "1,2 3,4", None, None), (1, 2, "Doors", [], "1,2 3,4", "aGk=", None), (1, 3, "Doors", None, "1,x 3,4", "aGk=", None), (1, 4, "Walls", None, "1,2", None, "data:image/png;base64,aGk="),
        (1, 5, "Walls", None, "", "", "data:image/png;base64,aGk="), (1, 6, "Walls", None, None, None, "data:image/png;base64,"), (2, 7, "Windows", [1, 2], None, None, None), (2, 8, "Walls", None, None, "aGk=", "blob:x")]
    masks = spark.createDataFrame(rows, "project_id long, mask_seq long, category string, edge_ids array<int>, polyline_points string, mask_b64 string, src string")
    got = {r.mask_seq: (r.route, r.kind) for r in state.routed(masks).collect()}
    assert got == {1: ("edges", "wall"), 2: ("polyline", "opening"), 3: ("none", "opening"), 4: ("none", "wall"), 5: ("raster", "wall"), 6: ("none", "wall"), 7: ("edges", "opening"), 8: ("raster", "wall")}
    assert {r.project_id: r.engine for r in state.engine_choice(state.routed(masks)).collect()} == {1: "vector", 2: "raster"}
    assert [r.drawn for r in state.drawn_as(masks).orderBy("mask_seq").collect()] == ["polyline", "polyline", "polyline", "polyline", "image", "image", "svg", "image"]


def test_pixels_to_units(spark):
    row = spark.createDataFrame([(200.0, 36.0)], "px double, s double").select(
        measure.real_from_pixels(F.col("px"), F.col("s")).alias("a"), measure.real_from_pixels(F.col("px"), F.col("s"), 2).alias("b"), measure.real_from_pixels(F.col("px"), F.col("s"), compat=True).alias("c")).first()
    assert row.a == pytest.approx(2.0) and row.b == pytest.approx(200 * 0.36**2 / 36**2) and row.c == pytest.approx(200 / 36)


def joined(words):
    """Phrases of one page, word by word."""
    out = []
    for word_id, text, x0, top, x1, bottom in sorted(words, key=lambda w: (round(w[3] / 5), w[2], w[0])):
        if not text.strip():
            continue
        if out and abs(top - out[-1][1]) < 5 and x0 - out[-1][2] < 12:
            a = out[-1]
            out[-1] = (f"{a[0]} {text.strip()}", a[1], x1, max(a[3], bottom), a[4] + 1)
        else:
            out.append((text.strip(), top, x1, bottom, 1))
    return out


def test_phrases_against_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = []
    for page in range(12):
        for k in range(60 if page else 1):
            # Tops drift by less than a line, so pieces hold words of several tops and of neighbouring lines.
            x0, top = float(rng.integers(0, 40) * 5), float(rng.integers(0, 60) / 2)
            rows.append((page, k, rng.choice([f"w{k}", f" w{k}", "  "], p=[0.8, 0.1, 0.1]).item(), x0, top, x0 + float(rng.integers(1, 6) * 5), top + float(rng.integers(5, 9))))
    words = spark.createDataFrame(rows, "page_id long, word_id long, text string, x0 double, top double, x1 double, bottom double")
    got = {}
    for r in labels.phrases(words).collect():
        got.setdefault(r.page_id, []).append((r.text, r.y0, r.x1, r.y1, r.n_words))
    for page in range(12):
        assert sorted(got.get(page, [])) == sorted(joined([r[1:] for r in rows if r[0] == page]))
    assert labels.phrases(words.limit(0)).count() == 0


def test_gray_is_a_float_product_in_both_engines(spark, tmp_path):
    import duckdb

    v = np.arange(1, 200_001, dtype=np.float32) / np.float32(997)
    v = v[np.floor(v * np.float32(997)) != np.floor(v.astype(float) * 997)][:64]  # a double's product has another whole part
    assert len(v) == 64
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame([(3, [float(x) for x in v])], "vec_id long, embedding array<float>").coalesce(1).write.parquet(path)
    got = fixtures.Workspace(spark, str(tmp_path), {})["raster"].collect()
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(fixtures.oracle("SELECT * FROM [[raster]]", fixtures.ADAPTERS)).fetchall())


def test_saved_pixels_are_not_broadcast(spark):
    from plumbline.operators import steps

    pixels = steps.saved(spark.range(1 << 20).selectExpr("id div 4096 as page_id", "cast(id % 64 as int) as x"))
    plan = spark.range(300).toDF("page_id").join(pixels, "page_id", "left")
    assert "BroadcastHashJoin" not in plan._jdf.queryExecution().executedPlan().toString()


def test_gaps_stay_with_their_page(spark):
    # Walls, gaps and what classifies them are dealt by page alone; no join deals them again by cells or bands.
    raw = "page_id long, edge_id long, x0 double, y0 double, x1 double, y1 double, lw double, length double"
    rows = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 0.0, 1.0, 100.0), (1, 1, 150.0, 2.0, 250.0, 2.0, 1.0, 100.0), (1, 2, 150.0, 90.0, 250.0, 90.0, 1.0, 100.0)], raw).repartition("page_id")
    curves = spark.createDataFrame([(1, 4, 125.0, 1.0, 60.0)], "page_id long, n_pts int, cx double, cy double, size double")
    typed = gaps.classify(gaps.dedup_gaps(gaps.collinear_gaps(edges.walls(rows))), curves, rows)
    plan = typed._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(page_id" in plan
    assert [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and line.split("(", 1)[1].count("#") != 1] == []
    assert [(r.ia, r.ib, r.width, r.g0, r.g1, r.type, r.n_lines) for r in typed.collect()] == [(0, 1, 50.0, 100.0, 150.0, "door", 0)]


def test_full_seeds_go_no_further(spark, monkeypatch):
    # A chain of 40 edges: with two edges at most, the rounds end after the first.
    made = []
    monkeypatch.setattr(graph, "saved", lambda df: made.append(steps.saved(df)) or made[-1])
    chain = [(1, i, 10.0 * i, 0.0, 10.0 * i + 10, 0.0, 0.5, None, False, 0.0, True, True) for i in range(40)]
    table = spark.createDataFrame(chain, "page_id long, edge_id long, x0 double, y0 double, x1 double, y1 double, lw double, color string, filled boolean, angle double, axis boolean, structural boolean")
    seeds = spark.createDataFrame([(1, 20)], "page_id long, edge_id long")
    got = graph.flood_select(seeds, table, most=2)
    assert sorted(r.edge_id for r in got.collect()) == [19, 20] and len(made) == 4
    assert graph.flood_select(seeds, table).count() == 40


def test_contraction_writes_each_node_for_its_rounds_only(spark, monkeypatch):
    # Pairs end in the first round; a chain beside them must not have them written again in each of its rounds.
    rows, keep = [], steps.saved
    monkeypatch.setattr(steps, "saved", lambda df: (out := keep(df), rows.append(out.count()))[0])
    links = spark.range(1000).selectExpr("0L as g", "10000 + 2 * id as u", "10001 + 2 * id as v").union(spark.range(30).selectExpr("0L as g", "cast((id * 7) % 31 as long) as u", "cast((id * 7 + 7) % 31 as long) as v"))
    found = {r.node: r.root for r in steps.contract(links, ["g"]).collect()}
    assert found == {**{n: 0 for n in range(31)}, **{10000 + k: 10000 + k - k % 2 for k in range(2000)}}
    assert sum(n >= 2000 for n in rows) <= 2


def test_floods_of_pages_equal_the_rounds(spark):
    rng = np.random.default_rng(8)
    rows = []
    for p in range(4):
        for i in range(70):
            x, y, dx, dy = (float(v) for v in (*rng.integers(0, 8, 2) * 10, *rng.integers(-1, 2, 2) * 10))
            angle = float(abs(np.degrees(np.arctan2(dy, dx))) % 180)
            rows.append((p, 3 * i, x, y + float(rng.integers(0, 4)), None if i == 50 else x + dx, y + dy, float(rng.integers(1, 4)) / 4, [None, "r", ""][i % 3], bool(i % 2), angle, angle % 90 == 0, i % 7 > 0))
    table = spark.createDataFrame(rows, "page_id long, edge_id long, x0 double, y0 double, x1 double, y1 double, lw double, color string, filled boolean, angle double, axis boolean, structural boolean")
    seeds = spark.createDataFrame([(p, e) for p in range(5) for e in (*range(0, 90, 3), 1, 999)], "page_id long, edge_id long")
    for options in ({}, {"lw_tol": 1.0, "color_match": False}, {"structural_only": False, "most": 3, "lw_tol": 0.3, "gap": 4.0}):
        want = sorted(map(tuple, graph.flood_select(seeds, table, **options).collect()))
        assert sorted(map(tuple, graph.flood_pages(seeds, table, **options).collect())) == want and len(want) > 100
    plan = graph.flood_pages(seeds, table)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 2  # edges and seeds are dealt by page, and nothing else


def test_topmost_paints_where_a_page_is_gathered(spark):
    rng = np.random.default_rng(9)
    point = lambda: {"x": float(rng.integers(-40, 240)), "y": float(rng.integers(-40, 200))}
    rows = []
    for k in range(60):
        kind = ("l", "re", "qu")[k % 3]
        rows.append((k % 2, k, ("stroke", "fill")[k % 4 > 2], (None, 0.0, 3.0, 30.0)[int(rng.integers(0, 4))], kind, [point() for _ in range(4 if kind == "qu" else 2)]))
    items = spark.createDataFrame([*rows, (0, 99, "fill", None, "l", [{"x": 1.0, "y": None}, point()])], "page_id long, item_id long, type string, width double, kind string, points array<struct<x:double,y:double>>")
    clicks = spark.createDataFrame([(100 * y + x, (x + y) % 3, y, x) for y in range(-1, 41) for x in range(-1, 51)], "click_id long, page_id long, cy int, cx int")
    found = drawings.topmost(clicks, items, 0.25, 40, 50, reach=3)
    top = {}
    for r in drawings.spine(items.where("item_id < 99"), drawings.thickness(F.col("width"), 0.25, 3), 0.25, "item_id").collect():
        for y in range(max(0, r.y - r.reach), min(39, r.y + r.reach) + 1):
            for x in range(max(0, r.x - r.reach), min(49, r.x + r.reach) + 1):
                top[r.page_id, y, x] = max(r.item_id, top.get((r.page_id, y, x), -1))
    want = {}
    for y in range(40):
        for x in range(50):
            near = [(y, x), *sorted((a, b) for a in range(y - 3, y + 4) for b in range(x - 3, x + 4))]
            hit = [top[(x + y) % 3, *a] for a in near if ((x + y) % 3, *a) in top]
            if hit:
                want[100 * y + x] = hit[0]
    assert {r.click_id: r.item_id for r in found.collect()} == want and len(want) > 500
    plan = drawings.topmost(clicks, items, 0.25, 40, 50)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 2  # items and clicks are dealt by page; no pixel is


def test_edges_are_written_out_before_results_meet_them(spark):
    from plumbline.operators import hybrid

    edges = spark.createDataFrame([(1, e, 0.5, 2.0, 0.0, float(e), 2.0, float(e)) for e in range(3)], "page_id long, edge_id long, lw double, length double, x0 double, y0 double, x1 double, y1 double")
    snapped = spark.createDataFrame([(k, 1, e) for k in range(2) for e in range(k, 3)], "k long, page_id long, edge_id long")
    out = hybrid.drawn(snapped, edges, ["k"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("format_string") > plan.index("Join")
    assert {r.k: (r.edge_ids, r.total_length, r.svg_groups[0].d) for r in out.collect()}[1] == ([1, 2], 4.0, "M0.00,1.00L2.00,1.00 M0.00,2.00L2.00,2.00")


def test_sides_are_counted_in_linear_time(spark):
    from plumbline.plans import catalog

    out = catalog._side_counts(spark.createDataFrame([(1, 100.0)] * 5 + [(1, 1.0)] * 2 + [(2, 1.0)] * 3, "page_id long, side double"))
    assert sorted(map(tuple, out.collect())) == [(1, 5), (2, 3)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan  # a mean inside a filter's lambda was summed anew for each side


def test_phrases_across_batches(spark):
    """Phrases do not depend on where Arrow cuts the words, a page's tops may fall, and words are sorted within a page."""
    rng = np.random.default_rng(5)
    rows = [(int(p), i, rng.choice(["a", " b ", " ", "cc"]), float(rng.integers(0, 40)), float(rng.integers(0, 30))) for p in range(6) for i in range(40)]
    words = spark.createDataFrame([(p, i, t, x, top, x + 5.0 * len(t), top + 8) for p, i, t, x, top in rows], "page_id long, word_id long, text string, x0 double, top double, x1 double, bottom double")
    want = []
    for p in range(6):
        held = sorted((round(top / 5), x, i, t.strip(" "), top, x + 5.0 * len(t)) for q, i, t, x, top in rows if q == p and t.strip(" "))
        for ln, x, _, t, top, x1 in held:
            if want and want[-1][0] == p and x - want[-1][5] < 12 and abs(top - want[-1][4]) < 5:
                last = want[-1]
                last[2], last[5], last[6], last[7] = last[2] + " " + t, x1, max(last[6], top + 8), last[7] + 1
            else:
                want.append([p, ln, t, x, top, x1, top + 8, 1])
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("1", "7", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert sorted(map(tuple, labels.phrases(words).collect())) == sorted(map(tuple, want)), n
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
