"""Results of clicks from strokes, candidate masks and edges, against brute force; pages' kernels hand on results, not pixels."""

import numpy as np
import pytest

from plumbline.operators import hybrid, rooms


def _edges(rng, n):
    at = rng.integers(-2, 12, (n, 4)) * 1.5
    return [(1, int(e), bool(rng.random() < 0.6), float(rng.choice([0.1, 0.2, 0.7])), 1.0 + float(e), *map(float, at[k])) for k, e in enumerate(rng.permutation(n))]


def test_results_of_a_page_against_brute_force(spark):
    """Cut strokes and whole ones, walls and doors, strokes without edges; batches do not change a result."""
    rng = np.random.default_rng(3)
    lines = _edges(rng, 60)
    edges = spark.createDataFrame(lines, "page_id long, edge_id long, structural boolean, lw double, length double, x0 double, y0 double, x1 double, y1 double")
    block = [(y, x) for y in range(8) for x in range(8)]
    rows = [(1, "H", [p[0] for p in block], [p[1] for p in block], [(1, 1), (7, 7)]), (1, "V", [900], [900], [(5, 2)]), (2, "V", [1], [1], [(0, 0)])]
    strokes = spark.createDataFrame(rows, rooms.STROKES)
    asked = [(1, 1, 1, "Walls"), (1, 1, 1, "Doors"), (1, 1, 1, "Doors"), (1, 7, 7, "Doors"), (1, 5, 2, "Walls"), (1, 3, 3, "Walls"), (2, 0, 0, "Walls")]
    clicks = spark.createDataFrame(asked, "page_id long, cy int, cx int, category string")
    rule = lambda y, x, cy, cx: (abs(y - cy) <= 2) & (abs(x - cx) <= 2)

    want = {}
    for page, cy, cx, category in asked:
        for p, way, ys, xs, spots in rows:
            if p == page and (cy, cx) in spots:
                mask = set(zip(ys, xs, strict=True))
                cut = {(y, x) for y, x in mask if rule(y, x, cy, cx)}
                mask = cut if len(cut) > 10 else mask
                on = []
                for q, e, structural, lw, length, x0, y0, x1, y1 in lines:
                    places = {(int((y0 + (y1 - y0) * t) * 0.5), int((x0 + (x1 - x0) * t) * 0.5)) for t in hybrid.PLACES}
                    if q == page and places & mask and (structural or category != "Walls"):
                        on.append((e, lw, length, f"M{x0:.2f},{y0:.2f}L{x1:.2f},{y1:.2f}"))
                on.sort()
                groups = [(max(0.5, w), " ".join(o[3] for o in on if o[1] == w)) for w in dict.fromkeys(o[1] for o in on)]
                want[page, cy, cx, category] = (len(mask), way, len(on), sum(o[2] for o in on), [o[0] for o in on], groups)
    assert want[1, 1, 1, "Doors"][0] == 16 and want[1, 7, 7, "Doors"][0] == 64 and want[1, 5, 2, "Walls"][2] == 0
    for batch in (1, hybrid.BATCH):
        size, hybrid.BATCH = hybrid.BATCH, batch
        try:
            found = hybrid.select(clicks, strokes, edges, 0.5, candidate=rule, least=10).collect()
        finally:
            hybrid.BATCH = size
        got = {(r.page_id, r.cy, r.cx, r.category): (r.mask_pixels, r.direction, r.edge_count, r.total_length, r.edge_ids, [(g.stroke_width, g.d) for g in r.svg_groups]) for r in found}
        assert got == want and len(found) == len(want)


def test_components_are_strokes_once(spark):
    ink = spark.createDataFrame([(1, 2, 2), (1, 3, 3), (1, 3, 30)], "page_id long, y int, x int")
    clicks = spark.createDataFrame([(1, 2, 2), (1, 0, 0), (1, 4, 29), (1, 60, 60), (2, 1, 1), (1, 0, 0)], "page_id long, cy int, cx int")
    found = rooms.component_strokes(ink, clicks, 64, 64, radius=20).collect()
    got = sorted((r.page_id, r.direction, list(zip(r.ys, r.xs, strict=True)), sorted(map(tuple, r.spots))) for r in found)
    assert got == [(1, "LOCAL", [(2, 2), (3, 3)], [(0, 0), (2, 2)]), (1, "LOCAL", [(3, 30)], [(4, 29)])]


@pytest.mark.parametrize("name", ["ras31_hybrid_component", "ras31_hybrid_select"])
def test_only_results_meet_their_clicks(spark, sf, name):
    """Neither a result's pixels nor its pairs with edges are joined or written: one join names results by clicks."""
    from plumbline.plans import catalog

    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    lines = [line.lstrip(" :+-") for line in plan[: plan.index("FlatMapGroupsInArrow")].splitlines()]
    joins = [k for k, line in enumerate(lines) if line.startswith("Join") and "cy#" in line]
    digests = [k for k, line in enumerate(lines) if "md5" in line]
    assert len(joins) == len(digests) == 1 and digests > joins
