"""The engine's own queries, by inventory id, and their DuckDB SQL.

``_both`` registers a text that is one projection, filter or aggregate in either engine's SQL; ``_query`` registers an
operator of the library with an independent SQL text, or without one where SQL cannot say it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators import drawings as dr
from plumbline.operators import edges as ed
from plumbline.operators import gaps as gp
from plumbline.operators import detect, graph, hybrid, inference, labels, measure, raster, rooms, spatial, state, steps, strokes
from plumbline.plans import stand_ins
from plumbline.plans.relations import CLASS_HEIGHT, CLASS_WIDTH, DIMENSION_SQL, HEIGHT, MAP_HEIGHT, MAP_WIDTH, ROOM_SQL, SQL, TITLE_SQL, WIDTH, contours_sql, labels_sql, workspace
from plumbline.sources import documents
from plumbline.sources.fixtures import Workspace, oracle
from plumbline.streaming import clicks, debounce

_RUN: dict[str, Callable[[Workspace], DataFrame]] = {}
_TEXT: dict[str, str] = {}


def _both(key: str, text: str) -> None:
    _RUN[key] = lambda w: w.sql(text)
    _TEXT[key] = text


def _query(key: str, run: Callable[[Workspace], DataFrame], text: str | None = None) -> None:
    _RUN[key] = run
    if text is not None:
        _TEXT[key] = text


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: (lambda spark, sf_dir, run=run: run(workspace(spark, sf_dir))) for key, run in _RUN.items()}


def oracle_sql() -> dict[str, str]:
    return {key: oracle(text, SQL) for key, text in _TEXT.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings of each page by type, with their total width."""
    return _RUN["jn05_gap_types"](workspace(spark, sf_dir))


# --- sources -----------------------------------------------------------------------------------------------------------
_both("src04_edge_scan", "SELECT page_id, count(*) AS n, round(sum(x0 + y0 + x1 + y1), 4) AS s FROM [[edges_raw]] GROUP BY page_id")
_both("src05_curve_scan", "SELECT page_id, curve_id, n_pts, cx, cy, size FROM [[curves]]")
_both("src06_word_scan", "SELECT page_id, count(*) AS n, sum(x1 - x0) AS w FROM [[words]] GROUP BY page_id")
_query("src07_drawing_scan", lambda w: w["items"].select("page_id", "item_id", "type", "color", "fill", "width", "kind", F.get("points", 0).x.alias("x"), F.get("points", 1).y.alias("y")),
       "SELECT page_id, item_id, type, color, fill, width, kind, x0 AS x, CASE kind WHEN 're' THEN y1 + 8 ELSE y1 END AS y FROM [[items]]")
_both("src08_layers", "SELECT DISTINCT page_id, object_type AS layer FROM [[edges_raw]]")
_both("src09_project_lookup", "SELECT c.click_id, p.project_id, p.scale_factor, p.project_id IS NULL AS missing FROM [[clicks]] c LEFT JOIN [[projects]] p ON c.page_id = p.page_id")
_query("src10_stored_bytes", lambda w: w["projects"].select("project_id", F.unbase64(F.base64(F.encode("project_id", "UTF-8"))).cast("string").alias("bytes_back")),
       "SELECT project_id, project_id AS bytes_back FROM [[projects]]")
_SOURCE = "SELECT page_id, y, x, gray AS r, (gray * 3) % 256 AS g, (gray * 7) % 256 AS b, CASE page_id % 3 WHEN 0 THEN (gray * 5) % 256 END AS a FROM [[raster]]"


def _mask_files(w: Workspace, pixels: str) -> DataFrame:
    """Pages as PNG files in base64: with alpha on every third, as RGB or as gray on the others, every other one a data URL; one that is broken."""
    import base64

    import numpy as np
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        page = int(frame["page_id"].iloc[0])
        image = np.zeros((HEIGHT, WIDTH, 4), np.uint8)
        image[frame["y"], frame["x"]] = frame[["r", "g", "b", "a"]].fillna(0)
        text = base64.b64encode(raster.png(image[:, :, : (4, 3, 1)[page % 3]])).decode()
        return pd.DataFrame({"page_id": [page, page], "mask_b64": ["data:image/png;base64," * (page % 2) + text, text[:40]]})

    return w.sql(pixels).groupBy("page_id").applyInPandas(run, "page_id long, mask_b64 string")


def _decoded_masks(w: Workspace, alpha_over: int, gray_over: int) -> DataFrame:
    runs = raster.decoded(_mask_files(w, _SOURCE), 150, 45, alpha_over=alpha_over, gray_over=gray_over)
    return runs.select("page_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def _decoded_sql(alpha_over: int, gray_over: int) -> str:
    value = f"CASE page_id % 3 WHEN 0 THEN CASE WHEN a > {alpha_over} THEN 1 END WHEN 1 THEN CASE WHEN round_even(0.299 * r + 0.587 * g + 0.114 * b, 0) > {gray_over} THEN 1 END ELSE CASE WHEN r > {gray_over} THEN 1 END END"
    return f"SELECT s.page_id, CAST(v.x AS INT) AS y, CAST(u.x AS INT) AS x FROM @series(0, 149) v CROSS JOIN @series(0, 44) u JOIN ({_SOURCE}) s ON s.y = v.x * {HEIGHT} // 150 AND s.x = u.x * {WIDTH} // 45 WHERE {value} = 1"


_query("src11_decode_mask", lambda w: _decoded_masks(w, 10, 10), _decoded_sql(10, 10))
_query("src12_decode_mask_gray", lambda w: _decoded_masks(w, 10, 5), _decoded_sql(10, 5))


# --- vector projections and predicates --------------------------------------------------------------------------------
_both("vec01_drop_glyphs", "SELECT page_id, raw_id FROM [[edges_raw]] WHERE NOT (object_type = 'curve_edge' AND NOT stroke)")
_both("vec02_drop_bare_fills", "SELECT page_id, raw_id FROM [[edges_raw]] WHERE NOT (fill AND NOT stroke)")
_both("vec03_drop_hairlines", "SELECT page_id, raw_id FROM [[edges_raw]] WHERE NOT (fill AND coalesce(linewidth, 0) < 0.01)")
_query("vec04_endpoints", lambda w: ed.with_ends(_pointed(w["edges_raw"])).select("page_id", "raw_id", "x0", "y0", "x1", "y1"),
       "SELECT page_id, raw_id, x0, CASE WHEN raw_id % 5 < 2 THEN y0 - 1 ELSE y0 END AS y0, x1, CASE WHEN raw_id % 5 < 2 THEN y1 + 1 ELSE y1 END AS y1 FROM [[edges_raw]]")


def _pointed(raw: DataFrame) -> DataFrame:
    """Edges with points: three on some, one or none on others, whose box is a point higher either way."""
    a, b = (F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y1")))
    k = F.col("raw_id") % 5
    pts = F.when(k == 0, F.array(a)).when(k == 2, F.array(a, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), b)).when(k > 2, F.array(a, b))
    return raw.select("page_id", "raw_id", pts.alias("pts"), F.col("x0").alias("bx0"), (F.col("y0") - 1).alias("by0"), F.col("x1").alias("bx1"), (F.col("y1") + 1).alias("by1"))


_both("vec05_normalise", "SELECT page_id, raw_id, x0 - 12 AS x0, y0 - 7 AS y0, x1 - 12 AS x1, y1 - 7 AS y1 FROM [[edges_raw]]")
_query("vec06_clip", lambda w: w["visible"].select("page_id", "raw_id"), "SELECT page_id, raw_id FROM [[visible]]")
_query("vec07_colours", lambda w: w["edges_raw"].select("page_id", "raw_id", F.bround(F.col("linewidth") / 7, 3).alias("c"), F.col("color").alias("k")),
       "SELECT page_id, raw_id, @half(linewidth / 7, 3) AS c, color AS k FROM [[edges_raw]]")
_query("vec08_drop_hatch", lambda w: w["edges"].select("page_id", "raw_id"), "SELECT page_id, raw_id FROM [[edges]]")
_query("vec09_structural", lambda w: w["edges"].select("page_id", "edge_id", "axis", "structural"), "SELECT page_id, edge_id, axis, structural FROM [[edges]]")
_query("vec10_edge_ids", lambda w: w["edges"].select("page_id", "edge_id", "raw_id"), "SELECT page_id, edge_id, raw_id FROM [[edges]]")
_query("geo01_length", lambda w: w["edges_raw"].select("page_id", "raw_id", F.round(g.seg_length("x0", "y0", "x1", "y1"), 4).alias("length")),
       "SELECT page_id, raw_id, round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 4) AS length FROM [[edges_raw]]")
_query("geo02_angle", lambda w: w["edges_raw"].select("page_id", "raw_id", F.round(g.seg_angle("x0", "y0", "x1", "y1"), 4).alias("angle")),
       "SELECT page_id, raw_id, round(abs(degrees(atan2(y1 - y0, x1 - x0))) % 180, 4) AS angle FROM [[edges_raw]]")
_query("geo03_axis", lambda w: w["edges_raw"].select("page_id", "raw_id", g.is_axis(g.seg_angle("x0", "y0", "x1", "y1")).alias("axis")),
       "SELECT page_id, raw_id, a < 10 OR a > 170 OR abs(a - 90) < 10 AS axis FROM (SELECT *, abs(degrees(atan2(y1 - y0, x1 - x0))) % 180 AS a FROM [[edges_raw]])")
_query("geo04_compatible", lambda w: w["edges"].withColumn("next", F.lead("angle").over(_by_edge())).where("next is not null").select("page_id", "edge_id", g.orientations_compatible(F.col("angle"), F.col("next")).alias("ok")),
       """SELECT page_id, edge_id, (axis AND naxis) OR (NOT axis AND NOT naxis AND abs(angle - next) < 15) AS ok
          FROM (SELECT *, lead(angle) OVER w AS next, lead(axis) OVER w AS naxis FROM [[edges]] WINDOW w AS (PARTITION BY page_id ORDER BY edge_id)) WHERE next IS NOT NULL""")
_DIST = """(CASE WHEN l2 < 1e-12 THEN sqrt((px - x0) * (px - x0) + (py - y0) * (py - y0)) ELSE
 sqrt((px - (x0 + t * (x1 - x0))) * (px - (x0 + t * (x1 - x0))) + (py - (y0 + t * (y1 - y0))) * (py - (y0 + t * (y1 - y0)))) END)"""
_MET = """(SELECT *, greatest(0.0, least(1.0, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / CASE WHEN l2 < 1e-12 THEN 1 ELSE l2 END)) AS t
 FROM (SELECT c.*, e.edge_id, e.structural, e.lw, e.x0, e.y0, e.x1, e.y1, (e.x1 - e.x0) * (e.x1 - e.x0) + (e.y1 - e.y0) * (e.y1 - e.y0) AS l2 FROM %s c JOIN [[edges]] e ON c.page_id = e.page_id))"""
_CLICK = "(SELECT click_id, page_id, x AS px, y AS py FROM [[clicks]])"
_query("geo05_point_segment", lambda w: spatial.within(w["clicks"].withColumnsRenamed({"x": "px", "y": "py"}), w["edges"], 40.0).where("dist <= 40").select("click_id", "edge_id", F.round("dist", 4).alias("dist")),
       f"SELECT click_id, edge_id, round({_DIST}, 4) AS dist FROM {_MET % _CLICK} WHERE {_DIST} <= 40")
_query("geo06_grid_cover", lambda w: spatial.grid_cover(w["edges"], 10.0).select("page_id", "edge_id", "gx", "gy"),
       """SELECT page_id, edge_id, gx, unnest(range(@floor((least(y0, y1) - 10) / 60), @floor((greatest(y0, y1) + 10) / 60) + 1)) AS gy
          FROM (SELECT *, unnest(range(@floor((least(x0, x1) - 10) / 60), @floor((greatest(x0, x1) + 10) / 60) + 1)) AS gx FROM [[edges]])""")
_query("geo07_grid_lookup", lambda w: spatial.cells_of(w["clicks"].withColumnsRenamed({"x": "px", "y": "py"})).join(spatial.grid_cover(w["edges"], 10.0), ["page_id", "gx", "gy"]).groupBy("click_id").agg(F.count(F.lit(1)).alias("n")),
       """SELECT click_id, count(*) AS n FROM [[clicks]] c JOIN [[edges]] e ON c.page_id = e.page_id AND floor(x / 60) BETWEEN floor((least(x0, x1) - 10) / 60) AND floor((greatest(x0, x1) + 10) / 60)
          AND floor(y / 60) BETWEEN floor((least(y0, y1) - 10) / 60) AND floor((greatest(y0, y1) + 10) / 60) GROUP BY click_id""")
_both("geo08_endpoint_keys", "SELECT page_id, CAST(@half(x0 / 2.5) AS BIGINT) AS kx, CAST(@half(y0 / 2.5) AS BIGINT) AS ky, count(*) AS n FROM [[edges]] GROUP BY 1, 2, 3")
_both("geo09_to_pixels", "SELECT page_id, edge_id, @int(x0 * 200 / 72) AS px, @int(y0 * 200 / 72) AS py FROM [[edges]]")
_both("geo10_samples", "SELECT page_id, edge_id, x, x0 + (x1 - x0) * x / 4 AS sx, y0 + (y1 - y0) * x / 4 AS sy FROM [[edges]] CROSS JOIN @series(0, 4)")


def _by_edge():
    from pyspark.sql.window import Window

    return Window.partitionBy("page_id").orderBy("edge_id")


def _paths(w: Workspace) -> DataFrame:
    flat = F.array("x0", "y0", "x1", "y1", "x2", "y2", F.lit(99.0))
    return w["flat_paths"].withColumn("p", g.flat_to_points(flat))


def _side_counts(sides: DataFrame) -> DataFrame:
    """(page_id, wall_count): sides at least five per cent of their page's mean, three at least; of three or fewer, all."""
    from pyspark.sql.window import Window

    page = Window.partitionBy("page_id")
    mean = sides.withColumn("mean", F.sum("side").over(page) / F.count(F.lit(1)).over(page))
    n = mean.groupBy("page_id").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("side") >= 0.05 * F.col("mean")).alias("m"))
    return n.select("page_id", F.when(F.col("k") > 3, F.greatest(F.lit(3), F.col("m"))).otherwise(F.col("k")).alias("wall_count"))


_query("geo11_polyline_length", lambda w: _paths(w).select("click_id", F.round(g.polyline_length(F.col("p")), 4).alias("length")),
       "SELECT click_id, round((x1 - x0) + (y2 - y1), 4) AS length FROM [[flat_paths]]")
_both("geo12_two_point_length", "SELECT click_id, round(sqrt((x2 - x0) * (x2 - x0) + (y2 - y0) * (y2 - y0)), 4) AS length FROM [[flat_paths]]")
_query("geo13_flat_to_points", lambda w: _paths(w).select("click_id", F.posexplode("p").alias("i", "q")).select("click_id", "i", "q.x", "q.y"),
       "SELECT click_id, 0 AS i, x0 AS x, y0 AS y FROM [[flat_paths]] UNION ALL SELECT click_id, 1, x1, y1 FROM [[flat_paths]] UNION ALL SELECT click_id, 2, x2, y2 FROM [[flat_paths]]")
_query("geo14_parse_polyline", lambda w: w["flat_paths"].withColumn("t", F.concat_ws(" ", F.concat_ws(",", "x0", "y0"), F.when(F.col("click_id") % 7 == 0, F.lit("junk,1")), F.when(F.col("click_id") % 5 == 0, F.lit("alone")), F.concat_ws(",", "x1", "y1")))
       .withColumn("p", g.parse_polyline(F.col("t"))).select("click_id", F.size("p").alias("n"), F.col("p")[1].x.alias("x")).withColumn("n", F.when(F.col("x").isNotNull(), F.col("n"))),
       "SELECT click_id, CASE WHEN click_id % 7 <> 0 THEN 2 END AS n, CASE WHEN click_id % 7 <> 0 THEN x1 END AS x FROM [[flat_paths]]")
_query("geo15_shoelace", lambda w: _paths(w).select("click_id", F.round(g.shoelace(F.col("p")), 4).alias("area")), "SELECT click_id, round((x1 - x0) * (y2 - y1) / 2, 4) AS area FROM [[flat_paths]]")

# --- aggregates, windows -----------------------------------------------------------------------------------------------
_query("agg01_selected_length", lambda w: w["selection"].join(w["edges"], ["page_id", "edge_id"]).groupBy("page_id").agg(F.round(F.sum("length"), 4).alias("length")),
       "SELECT page_id, round(sum(length), 4) AS length FROM [[edges]] WHERE structural GROUP BY page_id")
_query("agg02_svg_groups", lambda w: ed.svg_groups(w["selection"], w["edges"], "page_id").withColumn("d", F.md5("d")),
       """SELECT page_id, @half(lw, 3) AS lwk, md5(string_agg(printf('M%.2f,%.2fL%.2f,%.2f', x0, y0, x1, y1), ' ' ORDER BY edge_id)) AS d,
          greatest(@half(lw, 3), 0.5) AS stroke_width, round(sum(length), 4) AS total_length, count(*) AS n FROM [[edges]] WHERE structural GROUP BY page_id, @half(lw, 3)""")
_both("agg03_page_info", "SELECT page_id, count(*) AS edge_count, CAST(@countif(structural) AS BIGINT) AS structural_count, count(DISTINCT type) AS layers FROM [[edges]] GROUP BY page_id")
_query("agg04_width_histogram", lambda w: ed.width_histogram(w["edges"]), "SELECT page_id, lw, n, seen FROM [[hist]]")
_query("agg05_wall_width", lambda w: w["wall_width"], "SELECT page_id, wall_lw FROM [[wall_width]]")
_query("agg06_walls", lambda w: w["walls"], "SELECT * FROM [[walls]]")
_query("agg07_gap_type_counts", lambda w: w["typed"].groupBy("page_id").pivot("type", ["door", "window", "opening"]).count().na.fill(0),
       "SELECT page_id, count(*) FILTER (WHERE type = 'door') AS door, count(*) FILTER (WHERE type = 'window') AS window, count(*) FILTER (WHERE type = 'opening') AS opening FROM [[typed]] GROUP BY page_id")
_query("agg08_gap_tolerance", lambda w: spatial.gap_tolerance(w["seeds"], w["edges"]),
       """SELECT s.page_id, s.edge_id, coalesce(q.tolerance, 5.0) AS tolerance FROM (SELECT DISTINCT page_id, edge_id FROM [[seeds]]) s LEFT JOIN (
 WITH e AS (SELECT s.page_id, s.edge_id AS seed, e.x0, e.y0, e.x1, e.y1, row_number() OVER (PARTITION BY s.page_id, s.edge_id ORDER BY e.edge_id) AS r
   FROM [[seeds]] s JOIN [[edges]] o ON s.page_id = o.page_id AND s.edge_id = o.edge_id JOIN [[edges]] e ON e.page_id = s.page_id AND e.structural AND abs(e.lw - o.lw) <= 0.2),
 p AS (SELECT page_id, seed, (r - 1) * 2 AS i, x0 AS x, y0 AS y FROM e WHERE r <= 200 UNION ALL SELECT page_id, seed, (r - 1) * 2 + 1, x1, y1 FROM e WHERE r <= 200),
 n AS (SELECT page_id, seed, count(*) AS n FROM p GROUP BY ALL),
 d AS (SELECT a.page_id, a.seed, a.i, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM p a JOIN p b ON a.page_id = b.page_id AND a.seed = b.seed
   WHERE a.i < 200 AND b.i < 200 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) > 0.01 GROUP BY ALL),
 l AS (SELECT page_id, seed, list_sort(list(d)) AS nn FROM d GROUP BY ALL)
 SELECT n.page_id, n.seed, round(CASE WHEN n.n < 10 OR nn IS NULL THEN 5.0 ELSE greatest(2.0, least(nn[least(len(nn) - 1, CAST(floor(len(nn) * 0.85) AS INT)) + 1] * 1.5, 20.0)) END, 4) AS tolerance
 FROM n LEFT JOIN l ON n.page_id = l.page_id AND n.seed = l.seed) q ON s.page_id = q.page_id AND s.edge_id = q.seed""")
_query("agg09_dedup_gaps", lambda w: w["gaps"], "SELECT * FROM [[gaps]]")
_query("agg10_phrases", lambda w: w["phrases"], "SELECT * FROM [[phrases]]")
_query("agg11_number_names", lambda w: labels.number_names(w["rooms"], "project_id", "room_seq").select("project_id", "room_seq", "name"),
       """SELECT project_id, room_seq, CASE WHEN count(*) OVER (PARTITION BY project_id, name) > 1
          THEN name || ' ' || row_number() OVER (PARTITION BY project_id, name ORDER BY room_seq) ELSE name END AS name FROM [[rooms]]""")
_query("agg12_wall_count", lambda w: _side_counts(w["phrases"].select("page_id", (F.col("x1") - F.col("x0")).alias("side"))),
       """SELECT page_id, CAST(CASE WHEN count(*) > 3 THEN greatest(3, count(*) FILTER (WHERE x1 - x0 >= 0.05 * m)) ELSE count(*) END AS BIGINT) AS wall_count
          FROM (SELECT *, sum(x1 - x0) OVER (PARTITION BY page_id) / count(*) OVER (PARTITION BY page_id) AS m FROM [[phrases]]) GROUP BY page_id""")

# --- joins -------------------------------------------------------------------------------------------------------------
_HITS = f"""(SELECT click_id, page_id, edge_id, structural, greatest(0.0, d) AS dist, row_number() OVER (PARTITION BY click_id ORDER BY NOT structural, round(greatest(0.0, d), 6), edge_id) AS pos
 FROM (SELECT *, {_DIST} - lw / 2 AS d FROM {_MET % _CLICK}) WHERE d <= 10)"""
_query("jn01_hit_test", lambda w: spatial.hit_test(w["clicks"], w["edges"]).select("click_id", "page_id", "edge_id", "structural", F.round("dist", 4).alias("dist"), F.col("pos").cast("long").alias("pos")),
       f"SELECT click_id, page_id, edge_id, structural, round(dist, 4) AS dist, pos FROM {_HITS}")
_query("jn02_collinear_gaps", lambda w: w["gaps_all"], "SELECT * FROM [[gaps_all]]")
_query("jn03_door_test", lambda w: gp.with_arcs(w["gaps"], w["curves"]), "SELECT page_id, gap_id FROM [[arcs]]")
_query("jn04_window_test", lambda w: gp.parallel_lines(w["gaps"], w["edges"]).where("n >= 3"), "SELECT page_id, gap_id, n FROM [[lines]] WHERE n >= 3")
_query("jn05_gap_types", lambda w: w["typed"].groupBy("page_id", "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("width"), 4).alias("total_width")),
       "SELECT page_id, type, count(*) AS n, round(sum(width), 4) AS total_width FROM [[typed]] GROUP BY page_id, type")


def _pick_sql(first: str | None) -> str:
    rank = f"CASE WHEN type = '{first}' THEN 0 ELSE 1 END, " if first else ""
    where = f" AND type IN ('{first}', 'opening')" if first else ""
    return f"""SELECT click_id, page_id, gap_id, type, round(d, 4) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY {rank}d, gap_id) AS r FROM (
 SELECT c.click_id, c.page_id, g.gap_id, g.type, sqrt((c.x - g.mx) * (c.x - g.mx) + (c.y - g.my) * (c.y - g.my)) AS d FROM [[clicks]] c JOIN [[typed]] g ON c.page_id = g.page_id{where}) WHERE d < 80) WHERE r = 1"""


_query("jn06_nearest_gap", lambda w: gp.pick(w["clicks"], w["typed"], None), _pick_sql(None))
_query("jn07_pick_door", lambda w: gp.pick(w["clicks"], w["typed"], "door"), _pick_sql("door"))
_query("jn08_pick_window", lambda w: gp.pick(w["clicks"], w["typed"], "window"), _pick_sql("window"))
_KEPT = f"""(SELECT page_id, edge_id FROM [[edges]] WHERE structural EXCEPT SELECT page_id, edge_id FROM {_MET % '[[erasers]]'} WHERE {_DIST} < 8)"""
_query("jn09_erase", lambda w: spatial.erase(w["selection"], w["edges"], w["erasers"]), f"SELECT page_id, edge_id FROM {_KEPT}")
_SAMPLE = "SELECT DISTINCT e.page_id % 8 AS page_id, e.edge_id, e.structural, @int((x0 + (x1 - x0) * x / 4) / 20) AS px, @int((y0 + (y1 - y0) * x / 4) / 20) AS py FROM [[edges]] e CROSS JOIN @series(0, 4)"
_query("jn10_snap_edges", lambda w: spatial.snap_edges(w["edges"].withColumn("page_id", F.col("page_id") % 8), w["ink"], 1 / 20), f"SELECT DISTINCT s.page_id, s.edge_id FROM ({_SAMPLE}) s JOIN [[ink]] i ON s.page_id = i.page_id AND s.px = i.x AND s.py = i.y WHERE s.structural")
_query("jn12_label_fallback", lambda w: _label_fallback(w), """
SELECT page_id, gap_id, coalesce(text, 'Room ' || (gap_id + 1)) AS name FROM (
 SELECT g.page_id, g.gap_id, l.text, row_number() OVER (PARTITION BY g.page_id, g.gap_id ORDER BY sqrt((l.x - g.mx) * (l.x - g.mx) + (l.y - g.my) * (l.y - g.my)), l.text) AS r
 FROM [[gaps]] g LEFT JOIN [[labels]] l ON g.page_id = l.page_id AND l.is_room_label AND sqrt((l.x - g.mx) * (l.x - g.mx) + (l.y - g.my) * (l.y - g.my)) < 1191 * 0.05) WHERE r = 1""")


def _label_fallback(w: Workspace) -> DataFrame:
    points = w["labels"].where("is_room_label").select("page_id", "text", F.col("x").alias("px"), F.col("y").alias("py"))
    room = F.concat(F.lit("Room "), (F.col("gap_id") + 1).cast("string"))
    return gp.nearest_text(w["gaps"], points, 1191 * 0.05).select("page_id", "gap_id", F.coalesce("text", room).alias("name"))


_query("jn13_dna_match", lambda w: dr.layers(w["items"].select("page_id", "item_id"), w["items"]).groupBy("page_id", "layer").agg(F.count(F.lit(1)).alias("n"), F.sum("item_id").alias("ids")), """
SELECT k.page_id, k.layer, count(*) AS n, CAST(sum(i.item_id) AS BIGINT) AS ids FROM (SELECT page_id, type, color, fill, width, min(item_id) AS layer FROM [[items]] GROUP BY ALL) k JOIN [[items]] i
 ON k.page_id = i.page_id AND k.type = i.type AND k.color IS NOT DISTINCT FROM i.color AND k.fill IS NOT DISTINCT FROM i.fill
 AND ((k.width IS NULL AND i.width IS NULL) OR abs(k.width - i.width) <= 0.5) GROUP BY k.page_id, k.layer""")
# Pages are drawn at a quarter of a pixel a point.
_DRAWN = {"scale": 0.25, "height": 211, "width": 298}
_ON_DRAWING = "SELECT click_id, page_id, CAST(@int(x / 4) AS INT) AS cx, CAST(@int(y / 4) AS INT) AS cy FROM [[clicks]]"
_SHAPES = """(SELECT page_id, item_id, kind, type = 'fill' AND kind <> 'l' AS filled, @int(x0 / 4) AS xa, @int(y0 / 4) AS ya,
 @int((CASE kind WHEN 're' THEN x1 + 5 ELSE x1 END) / 4) AS xb, @int((CASE kind WHEN 're' THEN y0 ELSE y1 END) / 4) AS yb,
 @int((CASE kind WHEN 're' THEN x1 + 5 ELSE x1 + 7 END) / 4) AS xc, @int((CASE kind WHEN 're' THEN y1 + 8 ELSE y1 + 12 END) / 4) AS yc,
 @int((CASE kind WHEN 're' THEN x0 ELSE x0 + 7 END) / 4) AS xd, @int((CASE kind WHEN 're' THEN y1 + 8 ELSE y0 + 12 END) / 4) AS yd FROM [[items]])"""
_PAINTED = f"""shapes AS {_SHAPES}, sides AS (SELECT page_id, item_id, filled, xa, ya, xb, yb FROM shapes UNION ALL SELECT page_id, item_id, filled, xb, yb, xc, yc FROM shapes WHERE kind <> 'l'
  UNION ALL SELECT page_id, item_id, filled, xc, yc, xd, yd FROM shapes WHERE kind <> 'l' UNION ALL SELECT page_id, item_id, filled, xd, yd, xa, ya FROM shapes WHERE kind <> 'l'),
 steps AS (SELECT *, unnest(range(CAST(n AS BIGINT) + 1)) AS k FROM (SELECT *, greatest(abs(xb - xa), abs(yb - ya)) AS n FROM sides)),
 spine AS (SELECT page_id, item_id, filled, CAST(floor(ya + (yb - ya) * t + 0.5) AS INT) AS y, CAST(floor(xa + (xb - xa) * t + 0.5) AS INT) AS x FROM (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE CAST(k AS DOUBLE) / n END AS t FROM steps)),
 rows_ AS (SELECT *, unnest(range(least(ya, yb), greatest(ya, yb) + 1)) AS y FROM sides WHERE filled AND ya <> yb),
 spans AS (SELECT page_id, item_id, y, min(x) AS lo, max(x) AS hi FROM (SELECT *, xa + CAST((y - ya) * (xb - xa) AS DOUBLE) / (yb - ya) AS x FROM rows_ WHERE (ya <= y) <> (yb <= y)) GROUP BY ALL),
 painted AS (SELECT page_id, y + v.x AS y, s.x + u.x AS x, max(item_id) AS item_id FROM (
   SELECT page_id, item_id, y, x, CASE WHEN filled THEN 0 ELSE 1 END AS reach FROM spine
   UNION ALL SELECT page_id, item_id, y, unnest(range(CAST(ceil(lo) AS BIGINT), CAST(floor(hi) AS BIGINT) + 1)), 0 FROM spans) s CROSS JOIN @series(-1, 1) u CROSS JOIN @series(-1, 1) v
  WHERE abs(u.x) <= reach AND abs(v.x) <= reach AND y + v.x BETWEEN 0 AND 210 AND s.x + u.x BETWEEN 0 AND 297 GROUP BY 1, 2, 3)"""
_query("jn14_topmost_drawing", lambda w: dr.topmost(w.sql(_ON_DRAWING), w["items"], **_DRAWN).select("click_id", "item_id"), f"""
SELECT click_id, item_id FROM (WITH {_PAINTED}, c AS (SELECT * FROM ({_ON_DRAWING}) WHERE cy BETWEEN 0 AND 210 AND cx BETWEEN 0 AND 297),
 exact AS (SELECT c.click_id, p.item_id FROM c JOIN painted p ON c.page_id = p.page_id AND c.cy = p.y AND c.cx = p.x),
 missed AS (SELECT * FROM c WHERE click_id NOT IN (SELECT click_id FROM exact)),
 near AS (SELECT m.click_id, p.item_id, row_number() OVER (PARTITION BY m.click_id ORDER BY p.y, p.x) AS r FROM missed m JOIN painted p ON m.page_id = p.page_id AND p.y BETWEEN m.cy - 10 AND m.cy + 10 AND p.x BETWEEN m.cx - 10 AND m.cx + 10)
 SELECT * FROM exact UNION ALL SELECT click_id, item_id FROM near WHERE r = 1)""")
_query("jn15_index_lists", lambda w: ed.by_index(w["clicks"].selectExpr("click_id", "page_id", "array(click_id % 7, click_id % 700, click_id, -1L) as ids"), w["edges"]).select("click_id", "edge_id", "length"),
       "SELECT c.click_id, e.edge_id, e.length FROM [[clicks]] c JOIN [[edges]] e ON c.page_id = e.page_id AND e.edge_id IN (c.click_id % 7, c.click_id % 700, c.click_id, -1)")
_ROUTED = """(SELECT *, CASE WHEN category IN ('Doors', 'Windows') THEN 'opening' ELSE 'wall' END AS kind,
 CASE WHEN edge_text LIKE '%_%' THEN 'edges' WHEN polyline_points LIKE '1,2 3%' THEN 'polyline' WHEN polyline_points LIKE '1%' THEN 'none' WHEN mask_b64 LIKE 'a%' OR src LIKE 'data%' THEN 'raster' ELSE 'none' END AS route FROM [[mask_texts]])"""
_query("jn16_mask_routing", lambda w: state.routed(w["mask_state"]).select("project_id", "mask_seq", "route", "kind"), f"SELECT project_id, mask_seq, route, kind FROM {_ROUTED}")
_query("jn17_engine_choice", lambda w: state.engine_choice(state.routed(w["mask_state"])),
       f"SELECT project_id, CASE WHEN count(*) FILTER (WHERE route = 'polyline' OR (route = 'edges' AND kind = 'wall')) > 0 THEN 'vector' ELSE 'raster' END AS engine FROM {_ROUTED} GROUP BY project_id")

# --- graph -------------------------------------------------------------------------------------------------------------
_ADJ = """adj AS (SELECT DISTINCT a.page_id, a.edge_id AS f, b.edge_id AS t FROM ends a JOIN ends b ON a.page_id = b.page_id AND a.edge_id <> b.edge_id AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3
  AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 3)"""
_ENDS = "ends AS (SELECT page_id, edge_id, x0 AS x, y0 AS y FROM [[edges]] UNION ALL SELECT page_id, edge_id, x1, y1 FROM [[edges]])"


def _flood_sql(lw_tol: float, color: bool) -> str:
    same = "e.color IS NOT DISTINCT FROM o.color AND " if color else ""
    return f"""SELECT page_id, seed, edge_id FROM (WITH RECURSIVE {_ENDS}, {_ADJ},
 ok AS (SELECT DISTINCT s.page_id, s.edge_id AS seed, e.edge_id FROM [[seeds]] s JOIN [[edges]] o ON s.page_id = o.page_id AND s.edge_id = o.edge_id JOIN [[edges]] e ON e.page_id = s.page_id
  WHERE abs(e.lw - o.lw) <= {lw_tol} AND {same}e.filled = o.filled AND e.structural AND ((o.axis AND e.axis) OR (NOT o.axis AND NOT e.axis AND abs(o.angle - e.angle) < 15) OR e.axis)),
 r AS (SELECT page_id, seed, edge_id FROM ok WHERE edge_id = seed
  UNION SELECT r.page_id, r.seed, ok.edge_id FROM r JOIN adj ON adj.page_id = r.page_id AND adj.f = r.edge_id JOIN ok ON ok.page_id = r.page_id AND ok.seed = r.seed AND ok.edge_id = adj.t)
 SELECT * FROM r)"""


def _capped_sql(most: int) -> str:
    """As _flood_sql, with the steps to each edge."""
    text = _flood_sql(0.2, True)
    text = text.replace("r AS (SELECT page_id, seed, edge_id FROM ok WHERE edge_id = seed", "r AS (SELECT page_id, seed, edge_id, 0 AS depth FROM ok WHERE edge_id = seed")
    text = text.replace("UNION SELECT r.page_id, r.seed, ok.edge_id FROM r JOIN adj", "UNION SELECT r.page_id, r.seed, ok.edge_id, r.depth + 1 FROM r JOIN adj").replace("ok.edge_id = adj.t)", "ok.edge_id = adj.t WHERE r.depth < 12)")
    text = text.replace("SELECT * FROM r)", "SELECT page_id, seed, edge_id, min(depth) AS depth FROM r GROUP BY ALL)")
    return f"SELECT * FROM ({text.replace('SELECT page_id, seed, edge_id FROM (WITH', 'SELECT * FROM (WITH', 1)}) QUALIFY row_number() OVER (PARTITION BY page_id, seed ORDER BY depth, edge_id) <= {most}"


_query("gr01_flood_select", lambda w: graph.flood_pages(w["seeds"].distinct(), w["edges"]), _flood_sql(0.2, True))
_query("gr01_flood_select_wide", lambda w: graph.flood_pages(w["seeds"].distinct(), w["edges"], lw_tol=1.0, color_match=False), _flood_sql(1.0, False))
_query("gr02_adjacency", lambda w: graph.adjacency(w["edges"]), f"SELECT page_id, f AS a, t AS b FROM (WITH {_ENDS}, {_ADJ} SELECT * FROM adj) WHERE f < t")
_query("gr03_components", lambda w: graph.components(w["edges"]),
       f"""SELECT page_id, edge_id, min(c) AS component FROM (WITH RECURSIVE {_ENDS}, {_ADJ}, r AS (SELECT page_id, edge_id, edge_id AS c FROM [[edges]]
           UNION SELECT r.page_id, adj.t, r.c FROM r JOIN adj ON adj.page_id = r.page_id AND adj.f = r.edge_id) SELECT * FROM r) GROUP BY page_id, edge_id""")

# --- sets --------------------------------------------------------------------------------------------------------------
_both("set01_union_barriers", "SELECT page_id, y, x FROM [[ink]] UNION SELECT page_id, y, x FROM [[ink2]]")
_both("set02_union_noise", "SELECT page_id, count(*) AS n FROM (SELECT page_id, y, x FROM [[ink]] UNION SELECT page_id, y, x FROM [[ink2]]) GROUP BY page_id")
_both("set03_intersection_guard", "SELECT page_id, y, x FROM (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM (SELECT page_id, y, x FROM [[ink]] INTERSECT SELECT page_id, y, x FROM [[ink2]])) WHERE n > 50")
_both("set04_difference", "SELECT page_id, y, x FROM [[ink]] EXCEPT SELECT page_id, y, x FROM [[ink2]]")
_query("set05_complement", lambda w: raster.complement(w["raster"], w["ink"]), "SELECT page_id, y, x FROM [[raster]] EXCEPT SELECT page_id, y, x FROM [[ink]]")
_query("set06_union_runs", lambda w: raster.runs_at_least(w["ink2"], 3).union(raster.runs_at_least(w["ink2"], 3, "y")).distinct(), """
SELECT page_id, y, x FROM (SELECT *, count(*) OVER (PARTITION BY page_id, y, g) AS n FROM (SELECT *, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS g FROM [[ink2]])) WHERE n >= 3
UNION SELECT page_id, y, x FROM (SELECT *, count(*) OVER (PARTITION BY page_id, x, g) AS n FROM (SELECT *, y - row_number() OVER (PARTITION BY page_id, x ORDER BY y) AS g FROM [[ink2]])) WHERE n >= 3""")
_both("set07_concatenate_gaps", "SELECT page_id, ia, ib, width FROM [[gaps_all]] WHERE orient = 'H' UNION ALL SELECT page_id, ia, ib, width FROM [[gaps_all]] WHERE orient = 'V'")

# --- order and limits --------------------------------------------------------------------------------------------------
_query("top01_best_hit", lambda w: spatial.hit_test(w["clicks"], w["edges"]).where("pos = 1").select("click_id", "edge_id"), f"SELECT click_id, edge_id FROM {_HITS} WHERE pos = 1")
_both("top02_widths_by_value", "SELECT page_id, lw, n, row_number() OVER (PARTITION BY page_id ORDER BY lw DESC) AS pos FROM (SELECT page_id, @half(lw, 2) AS lw, count(*) AS n FROM [[edges]] WHERE lw > 0 GROUP BY page_id, @half(lw, 2))")
_query("top05_best_mask", lambda w: w["masks"].groupBy("project_id").agg(F.max_by("mask_seq", F.struct(F.coalesce("real_length", F.lit(-1.0)), -F.col("mask_seq"))).alias("mask_seq")),
       "SELECT project_id, mask_seq FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY coalesce(real_length, -1) DESC, mask_seq) AS r FROM [[masks]]) WHERE r = 1")
_query("top06_edge_cap", lambda w: graph.flood_pages(w["seeds"].distinct(), w["edges"], most=2), f"SELECT page_id, seed, edge_id FROM ({_capped_sql(2)})")
_query("top07_undo", lambda w: state.undo(w["masks"]).select("project_id", "mask_seq"),
       "SELECT project_id, mask_seq FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY mask_seq DESC) AS r FROM [[masks]]) WHERE r > 1")
_query("top08_exists_arc", lambda w: w["gaps"].join(gp.with_arcs(w["gaps"], w["curves"]), ["page_id", "gap_id"], "left_semi").select("page_id", "gap_id", "width"),
       "SELECT g.page_id, g.gap_id, g.width FROM [[gaps]] g SEMI JOIN [[arcs]] a ON g.page_id = a.page_id AND g.gap_id = a.gap_id")

# --- strings -----------------------------------------------------------------------------------------------------------
_query("str01_dimension_text", lambda w: w["words"].select("page_id", "word_id", labels.is_dimension(F.col("text")).alias("is_dimension")), f"SELECT page_id, word_id, {DIMENSION_SQL} AS is_dimension FROM [[words]]")
_query("str02_room_names", lambda w: w["words"].select("page_id", "word_id", labels.names_room(F.col("text")).alias("is_room")), f"SELECT page_id, word_id, {ROOM_SQL} AS is_room FROM [[words]]")
_query("str03_title_case", lambda w: w["phrases"].select("page_id", "ln", "x0", labels.title_case(F.col("text")).alias("title")), f"SELECT page_id, ln, x0, {TITLE_SQL} AS title FROM [[phrases]]")
_query("str04_labels", lambda w: w["labels"], "SELECT * FROM [[labels]]")
_query("str05_svg_fragment", lambda w: w["edges"].select("page_id", "edge_id", F.format_string("M%.2f,%.2fL%.2f,%.2f", "x0", "y0", "x1", "y1").alias("d")),
       "SELECT page_id, edge_id, printf('M%.2f,%.2fL%.2f,%.2f', x0, y0, x1, y1) AS d FROM [[edges]]")
_both("str06_gap_svg", """
SELECT page_id, gap_id, concat('M', @fixed(x0, 2), ',', @fixed(y0, 2), ' L', @fixed(x1, 2), ',', @fixed(y1, 2)) AS line,
 CASE orient WHEN 'H' THEN concat('M', @fixed(x0, 2), ',', @fixed(y0 - 4, 2), ' L', @fixed(x0, 2), ',', @fixed(y0 + 4, 2)) ELSE concat('M', @fixed(x0 - 4, 2), ',', @fixed(y0, 2), ' L', @fixed(x0 + 4, 2), ',', @fixed(y0, 2)) END AS tick1,
 CASE orient WHEN 'H' THEN concat('M', @fixed(x1, 2), ',', @fixed(y1 - 4, 2), ' L', @fixed(x1, 2), ',', @fixed(y1 + 4, 2)) ELSE concat('M', @fixed(x1 - 4, 2), ',', @fixed(y1, 2), ' L', @fixed(x1 + 4, 2), ',', @fixed(y1, 2)) END AS tick2
FROM (SELECT *, CASE orient WHEN 'H' THEN a ELSE p END AS x0, CASE orient WHEN 'H' THEN p ELSE a END AS y0, CASE orient WHEN 'H' THEN b ELSE p END AS x1, CASE orient WHEN 'H' THEN p ELSE b END AS y1
      FROM (SELECT *, floor(g0 * 100 + 0.5) / 100 AS a, floor(g1 * 100 + 0.5) / 100 AS b, floor(perp * 100 + 0.5) / 100 AS p FROM [[gaps]]))""")
_query("str07_data_url", lambda w: w["projects"].select("project_id", F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode("project_id", "UTF-8"))).alias("u")).select("project_id", F.substring_index("u", ",", -1).alias("b64")),
       "SELECT project_id, to_base64(encode(project_id)) AS b64 FROM [[projects]]")
_query("str08_colours", lambda w: w["masks"].select("project_id", "mask_seq", F.coalesce(F.create_map(*[F.lit(x) for kv in CATEGORY_COLOURS.items() for x in kv])[F.col("category")], F.lit("rgba(128,128,128,0.4)")).alias("color")),
       "SELECT project_id, mask_seq, CASE category WHEN 'Walls' THEN 'rgba(59,130,246,0.4)' WHEN 'Doors' THEN 'rgba(16,185,129,0.4)' WHEN 'Windows' THEN 'rgba(245,158,11,0.4)' ELSE 'rgba(128,128,128,0.4)' END AS color FROM [[masks]]")
_both("str09_room_ids", "SELECT project_id, room_seq, concat('R', CAST(room_seq AS STRING)) AS room_id FROM [[rooms]]".replace("STRING", "VARCHAR(20)"))
_both("str10_line_text", "SELECT page_id, top, md5(@list(text, word_id)) AS h FROM [[words]] GROUP BY page_id, top")
_CHECKPOINTS = "SELECT s_suppkey AS k, concat('/models/', CASE s_suppkey % 5 WHEN 0 THEN 'Hiera_TINY_' WHEN 1 THEN 'small-and-tiny-' WHEN 2 THEN 'base_plus.' WHEN 3 THEN 'LARGE-' ELSE 'other_' END, s_name, '.pt') AS path FROM [[supplier]]"
_query("str11_config_by_name", lambda w: w.sql(_CHECKPOINTS).select("k", inference.size_of(F.col("path")).alias("cfg")),
       "SELECT s_suppkey AS k, ['tiny', 'tiny', 'base_plus', 'large', 'tiny'][s_suppkey % 5 + 1] AS cfg FROM [[supplier]]")
_both("str12_fixed_points", "SELECT page_id, edge_id, @fixed(x0, 1) AS a, @fixed(y1 - y0, 2) AS b FROM [[edges]]")

# Fill colours of the three categories.
CATEGORY_COLOURS = {"Walls": "rgba(59,130,246,0.4)", "Doors": "rgba(16,185,129,0.4)", "Windows": "rgba(245,158,11,0.4)"}

# --- measurement -------------------------------------------------------------------------------------------------------
_AREA = "coalesce(real_length, 0) * coalesce(height, 0)"
_OPEN = f"(SELECT project_id, sum({_AREA}) AS o FROM [[masks]] WHERE category IN ('Doors', 'Windows') GROUP BY project_id)"
_query("ms01_wall_area", lambda w: measure.wall_area(w["masks"], 2.4, 6),
       "SELECT project_id, round(sum(CASE category WHEN 'Walls' THEN coalesce(real_length, 0) * 2.4 WHEN 'Doors' THEN coalesce(real_length, 0) * greatest(0, 2.4 - height) WHEN 'Windows' THEN coalesce(real_length, 0) * greatest(0, 2.4 - height) ELSE 0 END), 6) AS wall_area FROM [[masks]] GROUP BY project_id")
_query("ms02_opening_area", lambda w: measure.category_area(w["masks"], 6), f"SELECT project_id, category, round(sum({_AREA}), 6) AS area FROM [[masks]] WHERE category IN ('Doors', 'Windows') GROUP BY project_id, category")
_query("ms03_ceiling_area", lambda w: measure.ceiling_area(w["rooms"], 6), "SELECT project_id, round(sum(real_area), 6) AS ceiling_area FROM [[rooms]] GROUP BY project_id")
_query("ms04_net_wall_area", lambda w: measure.net_wall_area(w["rooms"], w["masks"], 2.4, 6), f"""
SELECT coalesce(g.project_id, o.project_id) AS project_id, round(coalesce(g.g, 0) - coalesce(o.o, 0), 6) AS net_area
FROM (SELECT project_id, sum(real_perimeter * 2.4) AS g FROM [[rooms]] GROUP BY project_id) g FULL JOIN {_OPEN} o ON g.project_id = o.project_id""")
_ROOM = f"""(SELECT r.*, round(real_perimeter * 2.4 - coalesce(o.o, 0) / count(*) OVER (PARTITION BY r.project_id), 6) AS net_area FROM [[rooms]] r LEFT JOIN {_OPEN} o ON r.project_id = o.project_id)"""
_query("ms05_room_wall_area", lambda w: measure.room_wall_area(w["rooms"], w["masks"], 2.4, 6).select("project_id", "room_seq", "net_area"), f"SELECT project_id, room_seq, net_area FROM {_ROOM}")
_query("ms06_counts", lambda w: measure.counts(w["masks"]), "SELECT project_id, category, CAST(sum(coalesce(nullif(cnt, 0), 1)) AS BIGINT) AS n FROM [[masks]] GROUP BY project_id, category")
_query("ms07_export_rows", lambda w: measure.export_rows(w["rooms"], w["masks"], 2.4, 6),
       f"SELECT project_id, 'R' || room_seq AS room_no, name AS room_name, net_area AS inner_wall_area, round(real_area, 6) AS ceiling_area, round(real_perimeter, 6) AS inner_perimeter FROM {_ROOM}")
_SUMMARY = f"""
WITH r AS (SELECT project_id, sum(real_perimeter * 2.4) AS gross, sum(real_area) AS ceiling, count(*) AS n FROM [[rooms]] GROUP BY project_id),
m AS (SELECT project_id, sum(CASE category WHEN 'Doors' THEN {_AREA} ELSE 0 END) AS da, sum(CASE category WHEN 'Windows' THEN {_AREA} ELSE 0 END) AS wa,
 sum(CASE category WHEN 'Doors' THEN coalesce(nullif(cnt, 0), 1) ELSE 0 END) AS dn, sum(CASE category WHEN 'Windows' THEN coalesce(nullif(cnt, 0), 1) ELSE 0 END) AS wn FROM [[masks]] GROUP BY project_id),
j AS (SELECT r.*, coalesce(da, 0) AS da, coalesce(wa, 0) AS wa, coalesce(dn, 0) AS dn, coalesce(wn, 0) AS wn FROM r LEFT JOIN m ON r.project_id = m.project_id)
SELECT project_id, 'Total Wall Area' AS metric, round(gross - da - wa, 6) AS value FROM j UNION ALL SELECT project_id, 'Total Ceiling Area', round(ceiling, 6) FROM j
UNION ALL SELECT project_id, 'Total Door Area', round(da, 6) FROM j UNION ALL SELECT project_id, 'Total Window Area', round(wa, 6) FROM j UNION ALL SELECT project_id, 'Total Rooms', CAST(n AS DOUBLE) FROM j
UNION ALL SELECT project_id, 'Total Doors', CAST(dn AS DOUBLE) FROM j UNION ALL SELECT project_id, 'Total Windows', CAST(wn AS DOUBLE) FROM j"""
_query("ms08_export_summary", lambda w: measure.export_summary(w["rooms"], w["masks"], 2.4, 6), f"SELECT project_id, metric, value FROM ({_SUMMARY})")
_query("ms09_detected_masks", lambda w: measure.detected_masks(w["detected"]).withColumn("real_length", F.round("real_length", 4)), """
SELECT project_id, 'Walls' AS category, round(wall_length, 4) AS real_length, 0.0 AS height, NULL AS cnt FROM [[detected]] WHERE wall_length IS NOT NULL AND wall_length <> 0
UNION ALL SELECT project_id, 'Doors', round(CAST(0.9 AS DOUBLE) * doors, 4), CAST(2.1 AS DOUBLE), doors FROM [[detected]] WHERE doors > 0
UNION ALL SELECT project_id, 'Windows', round(CAST(1.2 AS DOUBLE) * windows, 4), CAST(1.2 AS DOUBLE), windows FROM [[detected]] WHERE windows > 0""")
_query("ms10_default_heights", lambda w: w["masks"].select("project_id", "mask_seq", measure.default_height().alias("height")), "SELECT project_id, mask_seq, CASE category WHEN 'Doors' THEN CAST(2.1 AS DOUBLE) WHEN 'Windows' THEN CAST(1.2 AS DOUBLE) ELSE coalesce(nullif(height, 0), CAST(2.4 AS DOUBLE)) END AS height FROM [[masks]]")
_query("ms11_segment_lengths", lambda w: _paths(w).select("click_id", g.polyline_length(F.col("p")).alias("total"), F.posexplode(g.segment_lengths(F.col("p"))).alias("part", "length")),
       "SELECT click_id, (x1 - x0) + (y2 - y1) AS total, 0 AS part, x1 - x0 AS length FROM [[flat_paths]] UNION ALL SELECT click_id, (x1 - x0) + (y2 - y1), 1, y2 - y1 FROM [[flat_paths]]")
_query("ms12_calibration_strokes", lambda w: measure.drawn_lengths(w["flat_paths"].select("click_id", "x0", "y0", F.col("x2").alias("x1"), F.col("y2").alias("y1")), 5).select("click_id", F.round("px", 4).alias("px")), "SELECT click_id, round(sqrt((x2 - x0) * (x2 - x0) + (y2 - y0) * (y2 - y0)), 4) AS px FROM [[flat_paths]] WHERE sqrt((x2 - x0) * (x2 - x0) + (y2 - y0) * (y2 - y0)) > 5")
_query("ms13_opening_lines", lambda w: measure.drawn_lengths(w["flat_paths"].select("click_id", "x0", "y0", F.col("x2").alias("x1"), F.col("y2").alias("y1")), 3).select("click_id", F.round("px", 4).alias("px")), "SELECT click_id, round(sqrt((x2 - x0) * (x2 - x0) + (y2 - y0) * (y2 - y0)), 4) AS px FROM [[flat_paths]] WHERE sqrt((x2 - x0) * (x2 - x0) + (y2 - y0) * (y2 - y0)) > 3")
_query("ms14_real_units", lambda w: _real_units(w), """
SELECT e.page_id, e.edge_id, round(e.length / nullif(p.scale_factor, 0), 6) AS real_length, round(e.length / nullif(p.scale_factor, 0), 6) AS from_pixels,
 round(e.length * e.length / nullif(p.scale_factor * p.scale_factor, 0), 6) AS area_from_pixels, round(e.length * 25 / 9 / nullif(p.scale_factor, 0), 6) AS compat_length
FROM [[edges]] e JOIN [[projects]] p ON e.page_id = p.page_id""")


def _real_units(w: Workspace) -> DataFrame:
    both, pixels, scale = w["edges"].join(w["projects"], "page_id"), F.col("length") * (200 / 72), F.col("scale_factor")
    return both.select("page_id", "edge_id", F.round(measure.real(F.col("length"), scale), 6).alias("real_length"), F.round(measure.real_from_pixels(pixels, scale), 6).alias("from_pixels"),
                       F.round(measure.real_from_pixels(pixels * pixels, scale, 2), 6).alias("area_from_pixels"), F.round(measure.real_from_pixels(pixels, scale, compat=True), 6).alias("compat_length"))


_query("ms15_erase_and_measure", lambda w: spatial.erase(w["selection"], w["edges"], w["erasers"]).join(w["edges"], ["page_id", "edge_id"]).groupBy("page_id").agg(F.round(F.sum("length"), 4).alias("length"), F.count(F.lit(1)).alias("n")),
       f"SELECT k.page_id, round(sum(e.length), 4) AS length, count(*) AS n FROM {_KEPT} k JOIN [[edges]] e ON k.page_id = e.page_id AND k.edge_id = e.edge_id GROUP BY k.page_id")
_both("ms16_mask_merge", "SELECT a.project_id, a.mask_seq, coalesce(b.real_length, a.real_length) AS real_length, coalesce(b.height, a.height) AS height FROM [[masks]] a LEFT JOIN (SELECT project_id, mask_seq + 100 AS mask_seq, real_length, nullif(height, 0) AS height FROM [[masks]]) b ON a.project_id = b.project_id AND a.mask_seq = b.mask_seq")
_query("ms17_render_priority", lambda w: state.drawn_as(w["mask_state"]).select("project_id", "mask_seq", "drawn"),
       "SELECT project_id, mask_seq, CASE WHEN mask_seq % 5 < 3 THEN 'polyline' WHEN mask_seq % 3 = 0 THEN 'svg' WHEN mask_seq % 7 = 0 OR mask_seq % 11 < 9 THEN 'image' END AS drawn FROM [[mask_texts]]")
_query("ms18_screen_to_points", lambda w: w["clicks"].select("click_id", *[F.round(measure.screen_to_points(F.col(c), off, F.col("click_id") % 10 / 4.0 + 0.25, 1.5), 6).alias(f"n{c}") for c, off in (("x", 17.0), ("y", 9.0))]), "SELECT click_id, round((x - 17) / (1.5 * greatest(0.5, least(2.0, 0.25 + click_id % 10 / 4.0))), 6) AS nx, round((y - 9) / (1.5 * greatest(0.5, least(2.0, 0.25 + click_id % 10 / 4.0))), 6) AS ny FROM [[clicks]]")

# --- sinks and state ---------------------------------------------------------------------------------------------------
_query("snk02_partial_update", lambda w: state.upsert(w["projects"].select("project_id", "scale_factor", "wall_height"), w.sql(_CHANGES), "project_id"), """
SELECT p.project_id, coalesce(c.scale_factor, p.scale_factor) AS scale_factor, coalesce(c.wall_height, p.wall_height) AS wall_height, CASE WHEN c.scale_factor IS NOT NULL OR c.wall_height IS NOT NULL THEN 'updated' ELSE 'no_change' END AS status
FROM [[projects]] p LEFT JOIN (SELECT s_name AS project_id, CASE WHEN s_suppkey % 3 = 0 THEN CAST(30 AS DOUBLE) END AS scale_factor, CASE WHEN s_suppkey % 4 = 0 THEN CAST(3 AS DOUBLE) END AS wall_height FROM [[supplier]] WHERE s_suppkey % 2 = 0) c ON p.project_id = c.project_id""")
_CHANGES = "SELECT s_name AS project_id, CASE WHEN s_suppkey % 3 = 0 THEN CAST(30 AS DOUBLE) END AS scale_factor, CASE WHEN s_suppkey % 4 = 0 THEN CAST(3 AS DOUBLE) END AS wall_height FROM [[supplier]] WHERE s_suppkey % 2 = 0"
_query("snk03_calibrate", lambda w: state.calibrate(w["projects"], w["strokes"]), """
SELECT p.project_id, round(coalesce(s.n, p.scale_factor), 6) AS scale_factor, s.n IS NOT NULL AS calibrated FROM [[projects]] p LEFT JOIN (
 SELECT project_id, d / nullif(real_length, 0) AS n FROM (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS d FROM [[strokes]]) WHERE d > 5) s ON p.project_id = s.project_id""")
_query("snk04_replace_rooms", lambda w: state.replaced(w["rooms"].select("project_id", "room_seq", "name"), w["rooms"].where("project_id % 3 = 0").select("project_id").distinct().select("project_id", F.lit(1).cast("long").alias("room_seq"), F.lit("Whole").alias("name")), "project_id"), "SELECT project_id, room_seq, name FROM [[rooms]] WHERE project_id % 3 <> 0 UNION ALL SELECT project_id, 1 AS room_seq, 'Whole' AS name FROM (SELECT DISTINCT project_id FROM [[rooms]] WHERE project_id % 3 = 0)")
_RENAMES = "SELECT DISTINCT project_id, concat('R', CAST(project_id % 4 + 1 AS VARCHAR(9))) AS room_id, 'Renamed' AS new_name FROM [[rooms]]"
_WITH_ID = "SELECT project_id, room_seq, concat('R', CAST((room_seq - 1) % 6 + 1 AS VARCHAR(9))) AS room_id, name FROM [[rooms]]"
_query("snk05_rename_room", lambda w: state.rename_rooms(w.sql(_WITH_ID), w.sql(_RENAMES)), f"""
SELECT r.project_id, r.room_seq, r.room_id, CASE WHEN n.room_id IS NOT NULL AND r.k = 1 THEN n.new_name ELSE r.name END AS name
FROM (SELECT *, row_number() OVER (PARTITION BY project_id, room_id ORDER BY room_seq) AS k FROM ({_WITH_ID})) r LEFT JOIN ({_RENAMES}) n ON r.project_id = n.project_id AND r.room_id = n.room_id""")
_query("snk05_missing_renames", lambda w: state.missing_renames(w.sql(_WITH_ID), w.sql(_RENAMES)), f"SELECT n.* FROM ({_RENAMES}) n ANTI JOIN ({_WITH_ID}) r ON r.project_id = n.project_id AND r.room_id = n.room_id")
_query("snk06_report_sheet", lambda w: _sheet(w), f"""
SELECT project_id, CAST(room_seq AS BIGINT) AS line, name AS a, round(real_area, 2) AS b FROM [[rooms]]
UNION ALL SELECT s.project_id, n.n + 3 + row_number() OVER (PARTITION BY s.project_id ORDER BY s.metric), s.metric, s.value FROM ({_SUMMARY}) s JOIN (SELECT project_id, count(*) AS n FROM [[rooms]] GROUP BY project_id) n ON s.project_id = n.project_id""")
_query("snk08_latest_state", lambda w: state.latest(w["masks"].select("project_id", "mask_seq", "category", "real_length"), "project_id", "mask_seq"),
       "SELECT project_id, mask_seq, category, real_length FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY mask_seq DESC) AS r FROM [[masks]]) WHERE r = 1")

_query("snk08_settled_states", lambda w: debounce.settled(w["events"].selectExpr("event_id", "user_id", "ts", "value"), key="user_id", time="ts", order="event_id", delay_ms=300_000).select("event_id", "user_id", "value"),
       "SELECT event_id, user_id, value FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM [[events]]) WHERE after IS NULL OR after - ts >= INTERVAL 300 SECONDS")


def _sheet(w: Workspace) -> DataFrame:
    """Room rows from line 1, the summary three lines below them."""
    from pyspark.sql.window import Window

    n = w["rooms"].groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    top = w["rooms"].select("project_id", F.col("room_seq").alias("line"), F.col("name").alias("a"), F.round("real_area", 2).alias("b"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("metric"))
    below = measure.export_summary(w["rooms"], w["masks"], 2.4, 6).join(n, "project_id").select("project_id", (F.col("n") + 3 + place).alias("line"), F.col("metric").alias("a"), F.col("value").alias("b"))
    return top.unionByName(below)


# --- rasters -----------------------------------------------------------------------------------------------------------
def _window_sql(relation: str, ry: int, rx: int, erode: bool = False, height: int = HEIGHT, width: int = WIDTH, layer: str = "page_id") -> str:
    grid = f"SELECT {layer}, p.y + dy.x AS y, p.x + dx.x AS x FROM {relation} p CROSS JOIN @series(-{ry}, {ry}) dy CROSS JOIN @series(-{rx}, {rx}) dx"
    inside = f"y >= 0 AND y < {height} AND x >= 0 AND x < {width}"
    if not erode:
        return f"SELECT DISTINCT {layer}, y, x FROM ({grid}) WHERE {inside}"
    need = f"(least({height} - 1, y + {ry}) - greatest(0, y - {ry}) + 1) * (least({width - 1}, x + {rx}) - greatest(0, x - {rx}) + 1)"
    return f"SELECT {layer}, y, x FROM ({grid}) WHERE {inside} GROUP BY {layer}, y, x HAVING count(*) = {need}"


def _class_sql(name: str, group: str, number: int, reach: int, least: int) -> str:
    """Closing and component filter of a class map."""
    page = {"height": CLASS_HEIGHT, "width": CLASS_WIDTH}
    one = f"(SELECT page_id, y, x FROM [[class_map]] WHERE {group} = {number})"
    closed = _window_sql(f"({_window_sql(one, reach, reach, **page)})", reach, reach, erode=True, **page)
    return f"SELECT '{name}' AS class, page_id, y, x FROM (SELECT *, count(*) OVER (PARTITION BY page_id, c) AS n FROM {labels_sql(closed)}) WHERE n >= {least}"


SQL["class_masks"] = " UNION ALL ".join(_class_sql(*c) for c in raster.CLASS_MASKS)


def _class_rooms_sql() -> str:
    page = {"height": CLASS_HEIGHT, "width": CLASS_WIDTH, "layer": "page_id, room_cls"}
    inside = "(SELECT page_id, room_cls, y, x FROM [[class_map]] WHERE room_cls BETWEEN 3 AND 11 QUALIFY count(*) OVER (PARTITION BY page_id, room_cls) >= 200)"
    opened = _window_sql(f"({_window_sql(inside, 2, 2, erode=True, **page)})", 2, 2, **page)
    names = ", ".join(f"'{n}'" for n in detect.ROOM_CLASSES)
    return f"""
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY room_cls, c) AS room_seq, room_cls, [{names}][room_cls + 1] AS class_name, area, perimeter, cx, cy
FROM (WITH parts AS (SELECT * FROM {labels_sql(opened, "page_id, room_cls")})
 SELECT * FROM (SELECT page_id, room_cls, c, count(*) AS area, CAST(floor(avg(x)) AS BIGINT) AS cx, CAST(floor(avg(y)) AS BIGINT) AS cy FROM parts GROUP BY ALL)
  JOIN {contours_sql("parts", "page_id, room_cls")} USING (page_id, room_cls, c) WHERE area >= 500)"""


SQL["class_rooms"] = _class_rooms_sql()
_RGB = "SELECT page_id, y, x, gray AS r, (gray * 3) % 256 AS g, (gray * 7) % 256 AS b FROM [[raster]]"
_SEGMENTS = "SELECT page_id % 8 AS page_id, floor(x0 / 20) AS x0, floor(y0 / 20) AS y0, floor(x1 / 20) AS x1, floor(y1 / 20) AS y1 FROM [[edges]] WHERE x1 >= 0 AND y1 >= 0"
_query("ras01_rasterise", lambda w: raster.rasterise(w.sql(_SEGMENTS).selectExpr("page_id", "cast(x0 as double) x0", "cast(y0 as double) y0", "cast(x1 as double) x1", "cast(y1 as double) y1")), f"""
SELECT DISTINCT page_id, CAST(floor(y0 + (y1 - y0) * t + 0.5) AS INT) AS y, CAST(floor(x0 + (x1 - x0) * t + 0.5) AS INT) AS x
FROM (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE k / n END AS t FROM (SELECT *, unnest(range(CAST(n AS BIGINT) + 1)) AS k FROM (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS n FROM ({_SEGMENTS}))))""")
_BOXES = "SELECT page_id % 8 AS page_id, x0 / 20 AS x0, top / 20 AS y0, x1 / 20 AS x1, bottom / 20 AS y1 FROM [[words]]"
_BOX_SQL = f"SELECT DISTINCT page_id, CAST(y AS INT) AS y, CAST(unnest(range(greatest(0, @floor(x0) - 1), @int(ceil(x1)) + 2)) AS INT) AS x FROM (SELECT *, unnest(range(greatest(0, @floor(y0) - 1), @int(ceil(y1)) + 2)) AS y FROM ({_BOXES}))"
_query("ras02_fill_boxes", lambda w: raster.fill_boxes(w.sql(_BOXES), 1), _BOX_SQL)
_query("ras03_gray", lambda w: raster.to_gray(w.sql(_RGB)), f"SELECT page_id, y, x, CAST(round(0.299 * r + 0.587 * g + 0.114 * b) AS INT) AS gray FROM ({_RGB})")
_query("ras04_otsu", lambda w: raster.otsu(w["raster"]), """
SELECT page_id, gray AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY round(coalesce(v, 0), 0) DESC, gray) AS r FROM (
 SELECT page_id, gray, CAST(s0 * w - s * w0 AS DOUBLE) * CAST(s0 * w - s * w0 AS DOUBLE) / nullif(CAST(w0 * (w - w0) AS DOUBLE), 0) AS v FROM (
  SELECT page_id, gray, sum(n) OVER u AS w0, sum(n * gray) OVER u AS s0, sum(n) OVER (PARTITION BY page_id) AS w, sum(n * gray) OVER (PARTITION BY page_id) AS s
  FROM (SELECT page_id, gray, count(*) AS n FROM [[raster]] GROUP BY page_id, gray) WINDOW u AS (PARTITION BY page_id ORDER BY gray ROWS UNBOUNDED PRECEDING)))) WHERE r = 1""")
_query("ras05_dilate", lambda w: raster.dilate(w["ink"], 1, 1, HEIGHT, WIDTH), _window_sql("[[ink]]", 1, 1))
_query("ras06_close", lambda w: w["closed"], _window_sql(f"({_window_sql('[[ink]]', 1, 1)})", 1, 1, erode=True))
_query("ras06_open", lambda w: raster.open_(w["ink2"], 0, 1, HEIGHT, WIDTH), _window_sql(f"({_window_sql('[[ink2]]', 0, 1, erode=True)})", 0, 1))
_COMPONENTS = """(SELECT page_id, y, x, min(c) AS c FROM (WITH RECURSIVE r AS (SELECT page_id, y, x, y * 4096 + x AS c FROM [[ink]]
 UNION SELECT i.page_id, i.y, i.x, r.c FROM r JOIN [[ink]] i ON i.page_id = r.page_id AND abs(i.y - r.y) + abs(i.x - r.x) = 1 WHERE r.c < i.y * 4096 + i.x) SELECT * FROM r) GROUP BY page_id, y, x)"""
_FULL = _COMPONENTS.replace(" WHERE r.c < i.y * 4096 + i.x", "")
_query("ras07_components", lambda w: raster.components(w["ink"]), f"SELECT page_id, y, x, CAST(c // 4096 AS INT) AS label_y, CAST(c % 4096 AS INT) AS label_x FROM {_FULL}")
_STATS = f"""(SELECT page_id, CAST(c // 4096 AS INT) AS label_y, CAST(c % 4096 AS INT) AS label_x, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy FROM {_FULL} GROUP BY page_id, c)"""
_query("agg13_component_stats", lambda w: raster.component_stats(raster.components(w["ink"])), f"SELECT * FROM {_STATS}")
_query("agg14_ink_box", lambda w: w["ink"].groupBy("page_id").agg(*[F.floor(F.percentile(c, F.lit(p))).alias(f"{c}_{n}") for c in ("x", "y") for n, p in (("lo", 0.02), ("hi", 0.98))]),
       "SELECT page_id, CAST(floor(quantile_cont(x, 0.02)) AS BIGINT) AS x_lo, CAST(floor(quantile_cont(x, 0.98)) AS BIGINT) AS x_hi, CAST(floor(quantile_cont(y, 0.02)) AS BIGINT) AS y_lo, CAST(floor(quantile_cont(y, 0.98)) AS BIGINT) AS y_hi FROM [[ink]] GROUP BY page_id")
_both("agg16_removed_share", "SELECT r.page_id, round(CAST(100 AS DOUBLE) * count(i.x) / count(*), 4) AS pct FROM [[raster]] r LEFT JOIN [[ink]] i ON r.page_id = i.page_id AND r.y = i.y AND r.x = i.x GROUP BY r.page_id")
_query("top03_smallest_component", lambda w: raster.component_stats(raster.components(w["ink"])).where("area > 2").groupBy("page_id").agg(F.min_by(F.struct("label_y", "label_x", "area"), F.struct("area", "label_y", "label_x")).alias("m")).select("page_id", "m.*"),
       f"SELECT page_id, label_y, label_x, area FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY area, label_y, label_x) AS r FROM {_STATS} WHERE area > 2) WHERE r = 1")
_query("top04_largest_component", lambda w: raster.component_stats(raster.components(w["ink"])).groupBy("page_id").agg(F.min_by(F.struct("label_y", "label_x", "area"), F.struct(-F.col("area"), "label_y", "label_x")).alias("m")).select("page_id", "m.*"),
       f"SELECT page_id, label_y, label_x, area FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY area DESC, label_y, label_x) AS r FROM {_STATS}) WHERE r = 1")
_PIXEL = "SELECT click_id, page_id % (SELECT max(page_id) + 1 FROM [[raster]]) AS page_id, @int(x / 20) AS cx, @int(y / 20) AS cy FROM [[clicks]]"
_query("ras10_ring_search", lambda w: spatial.ring_search(w.sql(_PIXEL), w["ink"], 25), f"""
SELECT click_id, y, x, ring FROM (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY ring, y, x) AS r FROM (
 SELECT c.click_id, i.y, i.x, greatest(abs(i.y - c.cy), abs(i.x - c.cx)) AS ring FROM ({_PIXEL}) c JOIN [[ink]] i ON c.page_id = i.page_id AND i.y BETWEEN c.cy - 25 AND c.cy + 25 AND i.x BETWEEN c.cx - 25 AND c.cx + 25)) WHERE r = 1""")
_query("ras13_width_recovery", lambda w: raster.recover_width(w["ink"], w["ink2"], 1, HEIGHT, WIDTH), "SELECT DISTINCT i.page_id, i.y, i.x FROM [[ink2]] i JOIN [[ink]] s ON i.page_id = s.page_id AND i.y BETWEEN s.y - 1 AND s.y + 1 AND i.x BETWEEN s.x - 1 AND s.x + 1")
_query("ras15_text_mask", lambda w: raster.fill_boxes(w.sql(_BOXES), 1), _BOX_SQL)
_both("ras16_thin_lines", "SELECT page_id, edge_id FROM [[edges]] WHERE lw < 0.2 AND type IN ('line', 'rect_edge')")
_both("ras17_dashed_lines", "SELECT page_id, edge_id, greatest(coalesce(nullif(lw, 0), 0.5), 0.5) AS thickness FROM [[edges]] WHERE is_dashed")
_query("ras18_grid_lines", lambda w: ed.grid_lines(w["edges"].withColumns({b: F.col(a) + 6 * (F.col(b) - F.col(a)) for a, b in (("x0", "x1"), ("y0", "y1"))})),
       "SELECT page_id, edge_id FROM [[edges]] WHERE type = 'line' AND (abs(6 * (x1 - x0)) > 0.65 * 1191 OR abs(6 * (y1 - y0)) > 0.65 * 842)")
_query("ras19_clean", lambda w: w["raster"].join(raster.dilate(w["ink"], 1, 1, HEIGHT, WIDTH).withColumn("noise", F.lit(True)), ["page_id", "y", "x"], "left").select("page_id", "y", "x", F.when(F.col("noise"), 255).otherwise(F.col("gray")).alias("gray")),
       f"SELECT r.page_id, r.y, r.x, CASE WHEN n.x IS NOT NULL THEN 255 ELSE r.gray END AS gray FROM [[raster]] r LEFT JOIN ({_window_sql('[[ink]]', 1, 1)}) n ON r.page_id = n.page_id AND r.y = n.y AND r.x = n.x")
_CLEANED = "SELECT page_id, y, x, CASE WHEN gray % 5 = 0 THEN 255 ELSE gray END AS gray FROM [[raster]]"
_query("ras21_annotation_cleaning", lambda w: raster.clean_annotations(w["raster"], HEIGHT, WIDTH, w.sql(_CLEANED)), "SELECT page_id, y, x, CASE WHEN gray < 200 AND gray % 5 = 0 THEN 255 ELSE gray END AS gray FROM [[raster]]")
# Blocks of classes as thick ink, with lines a pixel wide across them and the paper.
_DRAWN_MAP = "SELECT page_id, y, x, CAST(CASE WHEN x % 37 = 5 THEN 10 WHEN room_cls % 3 = 0 THEN 40 ELSE 220 END AS INT) AS gray FROM [[class_map]]"
_DARK_MAP = "(SELECT page_id, y, x FROM [[class_map]] WHERE x % 37 = 5 OR room_cls % 3 = 0)"
_THICK_MAP = _window_sql(f"({_window_sql(_DARK_MAP, 2, 2, erode=True, height=CLASS_HEIGHT, width=CLASS_WIDTH)})", 2, 2, height=CLASS_HEIGHT, width=CLASS_WIDTH)
_query("ras21_thin_line_cleaning", lambda w: raster.clean_annotations(w.sql(_DRAWN_MAP), CLASS_HEIGHT, CLASS_WIDTH).groupBy("page_id", "y", "gray").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("xs")), f"""
SELECT page_id, y, gray, count(*) AS n, CAST(sum(x) AS BIGINT) AS xs FROM (SELECT d.page_id, d.y, d.x, CASE WHEN t.x IS NOT NULL THEN 255 ELSE d.gray END AS gray FROM ({_DRAWN_MAP}) d LEFT JOIN (
 {_window_sql(f"(SELECT * FROM {_DARK_MAP} EXCEPT SELECT * FROM ({_THICK_MAP}))", 1, 1, height=CLASS_HEIGHT, width=CLASS_WIDTH)}) t ON d.page_id = t.page_id AND d.y = t.y AND d.x = t.x) GROUP BY page_id, y, gray""")
_query("ras22_normalise", lambda w: raster.normalise(w.sql(_RGB)).select("page_id", "y", "x", *[F.round(c, 6).alias(c) for c in "rgb"]), f"""
SELECT page_id, y, x, round((r / 255.0::DOUBLE - 0.485::DOUBLE) / 0.229::DOUBLE, 6) AS r, round((g / 255.0::DOUBLE - 0.456::DOUBLE) / 0.224::DOUBLE, 6) AS g, round((b / 255.0::DOUBLE - 0.406::DOUBLE) / 0.225::DOUBLE, 6) AS b FROM ({_RGB})""")
_query("ras22_model_size", lambda w: w["projects"].select("page_id", *[raster.model_side(F.lit(float(n)), F.col("page_id") % 7 / 4.0 + 0.5).alias(c) for c, n in (("height", 842), ("width", 1191))]),
       "SELECT page_id, CAST((CAST(842 * (page_id % 7 / 4.0 + 0.5) * 1000 AS BIGINT) + 63999) // 64000 * 64 AS INT) AS height, CAST((CAST(1191 * (page_id % 7 / 4.0 + 0.5) * 1000 AS BIGINT) + 63999) // 64000 * 64 AS INT) AS width FROM [[projects]]")
_query("ras24_argmax", lambda w: w["embeddings"].select(F.col("vec_id").alias("pixel_id"), F.expr("cast(floor((vec_id % 500) / 25) as int)").alias("y"), F.expr("cast(vec_id % 25 as int)").alias("x"), inference.class_of("embedding", 21, 12).alias("room_cls"), inference.class_of("embedding", 33, 11).alias("icon_cls")), "SELECT pixel_id, y, x, room_cls, icon_cls FROM [[logits]]")
_query("ras25_class_masks", lambda w: w["class_masks"], SQL["class_masks"])
_query("ras26_room_extraction", lambda w: w["class_rooms"], SQL["class_rooms"])
_SCALED = "SELECT page_id, CASE WHEN page_id % 3 <> 1 THEN CAST(20 + page_id AS DOUBLE) END AS scale_factor FROM (SELECT DISTINCT page_id FROM [[logits]])"
_query("ras29_detection_summary", lambda w: detect.summary(w.sql(_SCALED), w["class_masks"], w["class_rooms"]), f"""
SELECT page_id, wall_length, doors, windows, rooms, room_area, wall_length / scale_factor AS real_length, room_area / (scale_factor * scale_factor) AS real_area
FROM (SELECT s.page_id, s.scale_factor, coalesce(w.l, 0) AS wall_length, coalesce(w.d, 0) AS doors, coalesce(w.v, 0) AS windows, coalesce(r.n, 0) AS rooms, coalesce(r.a, 0) AS room_area FROM ({_SCALED}) s
 LEFT JOIN (SELECT page_id, sum(perimeter) FILTER (WHERE class = 'wall') / 2 AS l, count(*) FILTER (WHERE class = 'door' AND contour_area > 100) AS d, count(*) FILTER (WHERE class = 'window' AND contour_area > 100) AS v
  FROM {contours_sql(labels_sql("SELECT * FROM [[class_masks]]", "class, page_id"), "class, page_id")} GROUP BY page_id) w ON s.page_id = w.page_id
 LEFT JOIN (SELECT page_id, count(*) AS n, CAST(sum(area) AS BIGINT) AS a FROM [[class_rooms]] GROUP BY page_id) r ON s.page_id = r.page_id)""")
_query("ras27_class_names", lambda w: w["logits"].select("pixel_id", F.element_at(F.array(*[F.lit(n) for n in detect.ROOM_CLASSES]), F.col("room_cls") + 1).alias("room"), F.element_at(F.array(*[F.lit(n) for n in detect.ICON_CLASSES]), F.col("icon_cls") + 1).alias("icon")),
       f"SELECT pixel_id, ['Background', 'Outdoor', 'Wall', 'Kitchen', 'Living Room', 'Bedroom', 'Bathroom', 'Hallway', 'Storage', 'Garage', 'Undefined', 'Railing'][room_cls + 1] AS room, ['Background', 'Window', 'Door', 'Closet', 'Toilet', 'Sink', 'Sauna', 'Fireplace', 'Bathtub', 'Chimney', 'Undefined'][icon_cls + 1] AS icon FROM [[logits]]")
_both("ras28_uncrop", "SELECT page_id, y + 40 AS y, x + 25 AS x FROM [[ink]]")
_query("ras35_kernel_size", lambda w: w["projects"].select("page_id", raster.kernel_size(3, (F.col("page_id") % 5 + 1.0) / 1.5).alias("k")), "SELECT page_id, greatest(3, n + (1 - n % 2)) AS k FROM (SELECT page_id, @int(3 * (1.0 + page_id % 5) / 1.5) AS n FROM [[projects]])")
# A page made higher and narrower, by ratios that do not divide.
_query("ras41_resize_nearest", lambda w: raster.resize(w["raster"], HEIGHT, WIDTH, 150, 45), f"""
SELECT r.page_id, CAST(v.x AS INT) AS y, CAST(u.x AS INT) AS x, r.gray FROM @series(0, 149) v CROSS JOIN @series(0, 44) u JOIN [[raster]] r ON r.y = v.x * {HEIGHT} // 150 AND r.x = u.x * {WIDTH} // 45""")

_query("ras23_pixel_classes", lambda w: inference.classified(inference.classify_pixels(inference.page_images(w["raster"], HEIGHT, WIDTH), stand_ins.shipped(w.spark, steps.shared_dir(w.spark), stand_ins.Classes)))
       .join(w["raster"], ["page_id", "y", "x"]).select("page_id", "y", "x", "room_cls", "icon_cls"), f"""
SELECT page_id, y, x, list_position(r, list_max(r)) - 1 AS room_cls, list_position(i, list_max(i)) - 1 AS icon_cls
FROM (SELECT *, list_transform(range(21, 33), lambda c: (gray * (c + 3)) % {stand_ins.PRIME}) AS r, list_transform(range(33, 44), lambda c: (gray * (c + 3)) % {stand_ins.PRIME}) AS i FROM [[raster]])""")
_PROMPTS = """SELECT click_id AS key, page_id % (SELECT max(page_id) + 1 FROM [[raster]]) AS page_id, CAST(@int(x / 20) AS INT) AS cx, CAST(@int(y / 20) AS INT) AS cy FROM [[clicks]]"""


def _prompted(w: Workspace) -> DataFrame:
    """Each click as a point that is meant, one beside it that is not, and on every third a box."""
    point = lambda x, label: F.struct(x.cast("double").alias("x"), F.col("cy").cast("double").alias("y"), F.lit(label).alias("label"))
    box = F.when(F.col("key") % 3 == 0, F.array(*[(F.col(c) + d).cast("double") for c, d in (("cx", -4), ("cy", -2), ("cx", 4), ("cy", 6))]))
    prompts = w.sql(_PROMPTS).select("key", "page_id", F.array(point(F.col("cx"), 1), point(F.col("cx") + 2, 0)).alias("points"), box.alias("box"))
    found = inference.best_masks(inference.page_images(w["raster"], HEIGHT, WIDTH), prompts, stand_ins.shipped(w.spark, steps.shared_dir(w.spark), stand_ins.Squares))
    n = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r.x1 - r.x0 + 1)
    return found.select(F.col("key").alias("click_id"), "best", F.round("score", 6).alias("score"), n.alias("pixels"))


_query("ras30_prompt_masks", _prompted, f"""
SELECT click_id, CAST(k - 1 AS INT) AS best, round(score, 6) AS score, pixels FROM (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY score DESC, k) AS first FROM (
 SELECT p.key AS click_id, r.k, count(g.gray) AS pixels, coalesce(avg(CASE WHEN g.gray < 128 THEN 1.0::DOUBLE WHEN g.gray IS NOT NULL THEN 0 END), 0) AS score
 FROM ({_PROMPTS}) p CROSS JOIN (SELECT unnest(range(1, 4)) AS k, unnest([{', '.join(map(str, stand_ins.RADII))}]) AS r) r
 LEFT JOIN (SELECT v.x AS y, u.x, pages.page_id, coalesce(gray, 255) AS gray FROM (SELECT DISTINCT page_id FROM [[raster]]) pages CROSS JOIN @series(0, {HEIGHT - 1}) v CROSS JOIN @series(0, {WIDTH - 1}) u
  LEFT JOIN [[raster]] g ON g.page_id = pages.page_id AND g.y = v.x AND g.x = u.x) g
  ON g.page_id = p.page_id AND abs(g.x - cx) <= r.r AND abs(g.y - cy) <= r.r AND NOT (abs(g.x - cx - 2) <= r.r // 2 AND abs(g.y - cy) <= r.r // 2)
  AND (p.key % 3 <> 0 OR (g.x BETWEEN cx - 4 AND cx + 4 AND g.y BETWEEN cy - 2 AND cy + 6)) GROUP BY p.key, r.k)) WHERE first = 1""")

# --- kernels and composites, held by invariants in tests ----------------------------------------------------------------
_EVERY_CLICK = "SELECT click_id, page_id % (SELECT max(page_id) + 1 FROM [[raster]]) AS page_id, CAST(@int(x / 20) AS INT) AS cx, CAST(@int(y / 20) AS INT) AS cy FROM [[clicks]]"


def _traced(w: Workspace) -> DataFrame:
    return rooms.trace_spots(w["ink2"], w.sql(_EVERY_CLICK), HEIGHT, WIDTH)


def _outlined(w: Workspace) -> DataFrame:
    return rooms.outlines(raster.components(w["ink2"], eight=True))


_query("geo16_simplify", lambda w: _outlined(w).select("page_id", "label_y", "label_x", "corners", "points"))
_query("agg17_contour_length", lambda w: rooms.detection_summary(_outlined(w)).select("page_id", "length"))
_query("agg18_large_contours", lambda w: rooms.detection_summary(_outlined(w)).select("page_id", "large"))
_query("agg19_precise_area", lambda w: rooms.detection_summary(_outlined(w)).select("page_id", "area"))
_DEPTH = """depth AS (SELECT i.page_id, i.y, i.x, sqrt(min((i.y - f.y) * (i.y - f.y) + (i.x - f.x) * (i.x - f.x))) AS d FROM [[ink2]] i JOIN (
  SELECT page_id, y, x FROM (SELECT DISTINCT page_id FROM [[ink2]]) CROSS JOIN (SELECT unnest(range(max(y) + 1)) AS y FROM [[raster]]) CROSS JOIN (SELECT x FROM @series(0, 63)) EXCEPT SELECT page_id, y, x FROM [[ink2]]) f
 ON i.page_id = f.page_id GROUP BY ALL)"""
_query("ras08_distance", lambda w: rooms.depth(w["ink2"], HEIGHT, WIDTH).withColumn("d", F.round("d", 6)), f"SELECT page_id, y, x, round(d, 6) AS d FROM (WITH {_DEPTH} SELECT * FROM depth)")
_query("ras09_distance_band", lambda w: rooms.distance_bands(w["ink2"], w.sql(_EVERY_CLICK), HEIGHT, WIDTH).withColumn("d", F.round("d", 6)), f"""
SELECT click_id, round(any_value(d), 6) AS d, CAST(sum(m) AS BIGINT) AS n FROM (WITH {_DEPTH}, hist AS (SELECT page_id, d AS of_, count(*) AS m FROM depth GROUP BY ALL),
 spots AS (SELECT click_id, page_id, d FROM (SELECT c.click_id, c.page_id, k.d, row_number() OVER (PARTITION BY click_id ORDER BY greatest(abs(y - cy), abs(x - cx)), k.d DESC, y, x) AS r
  FROM ({_EVERY_CLICK}) c JOIN depth k ON c.page_id = k.page_id AND y BETWEEN cy - 25 AND cy + 25 AND x BETWEEN cx - 25 AND cx + 25) WHERE r = 1)
 SELECT a.click_id, a.d, h.m FROM spots a JOIN hist h ON a.page_id = h.page_id AND of_ >= greatest(0.3, 0.3 * a.d) AND of_ <= 4 * a.d) GROUP BY click_id""")
_PARTS = f"(SELECT page_id, y, x, CAST(c // 4096 AS INT) AS label_y, CAST(c % 4096 AS INT) AS label_x FROM {_FULL.replace('[[ink]]', '[[ink2]]')})"
_query("agg15_window_mode", lambda w: spatial.window_mode(w.sql(_EVERY_CLICK), raster.components(w["ink2"]), "label_y", "label_x"), f"""
SELECT click_id, label_y, label_x FROM (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY n DESC, label_y, label_x) AS r FROM (SELECT c.click_id, p.label_y, p.label_x, count(*) AS n
 FROM ({_EVERY_CLICK}) c JOIN {_PARTS} p ON c.page_id = p.page_id AND p.y >= cy - 10 AND p.y < cy + 10 AND p.x >= cx - 10 AND p.x < cx + 10 GROUP BY ALL)) WHERE r = 1""")
_query("jn11_label_in_room", lambda w: labels.labels_inside(raster.components(w["ink2"]), w["labels"].withColumn("page_id", F.col("page_id") % 8), 1 / 20), f"""
SELECT page_id, label_y, label_x, text FROM (SELECT p.page_id, p.label_y, p.label_x, l.text, row_number() OVER (PARTITION BY p.page_id, p.label_y, p.label_x
  ORDER BY round(sqrt((l.x / 20 - p.cx) * (l.x / 20 - p.cx) + (l.y / 20 - p.cy) * (l.y / 20 - p.cy)), 6), l.text) AS r
 FROM (SELECT *, avg(x) OVER u AS cx, avg(y) OVER u AS cy FROM {_PARTS} WINDOW u AS (PARTITION BY page_id, label_y, label_x)) p
 JOIN [[labels]] l ON p.page_id = l.page_id % 8 AND l.is_room_label AND p.y = @int(l.y / 20) AND p.x = @int(l.x / 20)) WHERE r = 1""")
_query("ras11_label_search", lambda w: spatial.ring_search(w.sql(_EVERY_CLICK), raster.components(w["ink2"]), 20, "label_y", "label_x").select("click_id", "label_y", "label_x"),
       f"""SELECT click_id, label_y, label_x FROM (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY greatest(abs(y - cy), abs(x - cx)), y, x) AS r FROM ({_EVERY_CLICK}) c
       JOIN (SELECT page_id, y, x, CAST(c // 4096 AS INT) AS label_y, CAST(c % 4096 AS INT) AS label_x FROM {_FULL.replace('[[ink]]', '[[ink2]]')}) i ON c.page_id = i.page_id AND y BETWEEN cy - 20 AND cy + 20 AND x BETWEEN cx - 20 AND cx + 20) WHERE r = 1""")
_query("ras12_trace_wall", lambda w: w.sql(_EVERY_CLICK).join(_traced(w).groupBy(*rooms.SPOT).agg(F.count(F.lit(1)).alias("n")), rooms.SPOT).select("click_id", "n"))
_OTSU_INK = f"(SELECT r.page_id, r.y, r.x FROM [[raster]] r JOIN ({_TEXT['ras04_otsu']}) t ON r.page_id = t.page_id WHERE r.gray <= t.threshold)"
_JOINED = f"SELECT page_id, y, x FROM ({_window_sql('(' + _window_sql(_OTSU_INK, 7, 7) + ')', 7, 7, erode=True)}) UNION SELECT * FROM {_OTSU_INK}"
_query("ras20_auto_crop", lambda w: rooms.auto_crop(w["raster"], HEIGHT, WIDTH), f"""
SELECT page_id, CAST(greatest(0, trunc(x0 - px)) AS INT) AS x0, CAST(greatest(0, trunc(y0 - py)) AS INT) AS y0, CAST(least({WIDTH - 1}, trunc(x1 + px)) AS INT) AS x1, CAST(least({HEIGHT - 1}, trunc(y1 + py)) AS INT) AS y1
FROM (SELECT *, 0.05::DOUBLE * (x1 - x0) AS px, 0.05::DOUBLE * (y1 - y0) AS py FROM (
 SELECT b.page_id, CASE WHEN few THEN i.x0 ELSE b.x0 END AS x0, CASE WHEN few THEN i.x1 ELSE b.x1 END AS x1, CASE WHEN few THEN i.y0 ELSE b.y0 END AS y0, CASE WHEN few THEN i.y1 ELSE b.y1 END AS y1
 FROM (SELECT p.*, i.n > 100 AND p.n < 0.1 * {HEIGHT * WIDTH} AS few FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, c) AS r FROM (
   SELECT page_id, c, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {labels_sql(_JOINED)} GROUP BY page_id, c)) p JOIN (SELECT page_id, count(*) AS n FROM {_OTSU_INK} GROUP BY page_id) i ON p.page_id = i.page_id WHERE r = 1) b
 JOIN (SELECT page_id, quantile_cont(x, 0.02) AS x0, quantile_cont(x, 0.98) AS x1, quantile_cont(y, 0.02) AS y0, quantile_cont(y, 0.98) AS y1 FROM {_OTSU_INK} GROUP BY page_id) i ON b.page_id = i.page_id))""")
# Edges of all pages on the pages of the raster, told apart by page; clicks with their category.
_FOLDED = "SELECT page_id % (SELECT max(page_id) + 1 FROM [[raster]]) AS page_id, page_id * 100000 + edge_id AS edge_id, structural, lw, length, x0, y0, x1, y1 FROM [[edges]]"
_CHOSEN = "SELECT click_id, page_id % (SELECT max(page_id) + 1 FROM [[raster]]) AS page_id, CAST(@int(x / 20) AS INT) AS cx, CAST(@int(y / 20) AS INT) AS cy, category FROM [[clicks]]"
# A model's mask: what lies within twelve pixels of the click, by a rule that leaves some out.
_CANDIDATE = "abs(y - cy) <= 12 AND abs(x - cx) <= 12 AND (y + x) % 5 > 0"


def _candidate(y, x, cy: int, cx: int):
    """``_CANDIDATE`` for arrays of pixels."""
    return (abs(y - cy) <= 12) & (abs(x - cx) <= 12) & ((y + x) % 5 > 0)


def _hybrid(w: Workspace, strokes: DataFrame) -> DataFrame:
    """Results of clicks with their paths as a digest; paths are long, so they are digested before a result meets its clicks."""
    path = F.concat_ws(";", F.transform("svg_groups", lambda g: F.concat(g.d, F.format_string("@%.3f", g.stroke_width))))
    key, asked = [*rooms.SPOT, "category"], w.sql(_CHOSEN)
    rows = hybrid.select(asked, strokes, w.sql(_FOLDED), 1 / 20, candidate=_candidate)
    shown = rows.select(*key, "mask_pixels", "direction", F.col("edge_count").cast("long").alias("edge_count"), F.round("total_length", 4).alias("total_length"), F.md5(path).alias("svg"))
    return asked.join(shown.hint("merge"), key).drop(*key)


_query("ras31_hybrid_select", lambda w: _hybrid(w, rooms.traced_strokes(w["ink2"], w.sql(_CHOSEN), HEIGHT, WIDTH)))
_query("ras31_hybrid_component", lambda w: _hybrid(w, rooms.component_strokes(w["ink2"], w.sql(_CHOSEN), HEIGHT, WIDTH)), f"""
SELECT * FROM (WITH parts AS MATERIALIZED (SELECT * FROM {labels_sql("SELECT page_id, y, x FROM [[ink2]]")}), clicked AS MATERIALIZED ({_CHOSEN}), folded AS MATERIALIZED ({_FOLDED}),
spots AS (SELECT DISTINCT page_id, cy, cx FROM clicked),
nearest AS (SELECT page_id, cy, cx, c FROM (SELECT s.*, p.c, row_number() OVER (PARTITION BY s.page_id, cy, cx ORDER BY greatest(abs(y - cy), abs(x - cx)), y, x) AS r
 FROM spots s JOIN parts p ON s.page_id = p.page_id AND y BETWEEN cy - 20 AND cy + 20 AND x BETWEEN cx - 20 AND cx + 20) WHERE r = 1),
traced AS MATERIALIZED (SELECT n.page_id, cy, cx, y, x, {_CANDIDATE} AS kept FROM nearest n JOIN parts p ON n.page_id = p.page_id AND n.c = p.c),
mask AS MATERIALIZED (SELECT page_id, cy, cx, y, x FROM (SELECT *, count(*) FILTER (WHERE kept) OVER (PARTITION BY page_id, cy, cx) AS n FROM traced) WHERE kept OR n <= 50),
places AS MATERIALIZED (SELECT DISTINCT page_id, edge_id, structural, @int((x0 + (x1 - x0) * t.x / 4.0) * (1.0::DOUBLE / 20)) AS px, @int((y0 + (y1 - y0) * t.x / 4.0) * (1.0::DOUBLE / 20)) AS py FROM folded CROSS JOIN @series(0, 4) t),
snapped AS (SELECT DISTINCT m.page_id, m.cy, m.cx, k.category, a.edge_id FROM mask m JOIN places a ON m.page_id = a.page_id AND m.y = a.py AND m.x = a.px
 JOIN (SELECT DISTINCT page_id, cy, cx, category FROM clicked) k ON m.page_id = k.page_id AND m.cy = k.cy AND m.cx = k.cx WHERE k.category <> 'Walls' OR a.structural),
paths AS (SELECT s.page_id, cy, cx, category, @half(lw, 3) AS width, count(*) AS n, sum(length) AS l, min(s.edge_id) AS first, string_agg(printf('M%.2f,%.2fL%.2f,%.2f', x0, y0, x1, y1), ' ' ORDER BY s.edge_id) AS d
 FROM snapped s JOIN folded f ON s.edge_id = f.edge_id GROUP BY s.page_id, cy, cx, category, @half(lw, 3)),
found AS (SELECT page_id, cy, cx, category, sum(n) AS n, sum(l) AS l, string_agg(d || printf('@%.3f', greatest(width, 0.5)), ';' ORDER BY first) AS svg FROM paths GROUP BY page_id, cy, cx, category)
SELECT c.click_id, m.n AS mask_pixels, 'LOCAL' AS direction, CAST(coalesce(f.n, 0) AS BIGINT) AS edge_count, round(coalesce(f.l, 0), 4) AS total_length, md5(coalesce(f.svg, '')) AS svg
FROM clicked c JOIN (SELECT page_id, cy, cx, count(*) AS n FROM mask GROUP BY ALL) m ON c.page_id = m.page_id AND c.cy = m.cy AND c.cx = m.cx
 LEFT JOIN found f ON c.page_id = f.page_id AND c.cy = f.cy AND c.cx = f.cx AND c.category = f.category)""")
_query("ras32_magic_wand", lambda w: dr.wand(w.sql(_ON_DRAWING), w["items"], **_DRAWN))
_query("ras33_vector_rooms", lambda w: _vector_rooms(w))
_query("ras34_raster_rooms", lambda w: rooms.split_rooms(w["ink2"], HEIGHT, WIDTH, close=0, min_share=0.002).drop("mask"))
_OPENINGS = "SELECT c.click_id, c.page_id, c.x0, c.y0, c.x2 AS x1, c.y2 AS y1, p.scale_factor FROM [[flat_paths]] c LEFT JOIN [[projects]] p ON c.page_id = p.page_id"


def _near_sql(lines: str, width: int, height: int) -> str:
    """Pixels (click_id, y, x) of the canvas within 6 of a line."""
    return f"""(SELECT click_id, y, x FROM (SELECT *, CASE WHEN n = 0 THEN 0 ELSE greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / n)) END AS t FROM (
  SELECT *, unnest(range(greatest(0, CAST(ceil(least(x0, x1)) AS BIGINT) - 6), least({width}, CAST(floor(greatest(x0, x1)) AS BIGINT) + 7))) AS x FROM (
   SELECT *, (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS n, unnest(range(greatest(0, CAST(ceil(least(y0, y1)) AS BIGINT) - 6), least({height}, CAST(floor(greatest(y0, y1)) AS BIGINT) + 7))) AS y FROM ({lines}))))
 WHERE pow(x - x0 - t * (x1 - x0), 2) + pow(y - y0 - t * (y1 - y0), 2) <= 36 + 1e-9)"""


_query("ras34_rooms_by_table_function", lambda w: rooms.room_function(HEIGHT, WIDTH, close=0, min_share=0.002)(w["ink2"].asTable().partitionBy("page_id")))
_query("ras36_opening_line", lambda w: strokes.openings(w.sql(_OPENINGS), ["click_id"]).select("click_id", "pixels", "length", "real_length"), f"""
SELECT o.click_id, n.pixels, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS length, coalesce(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / nullif(scale_factor, 0), 0) AS real_length
FROM ({_OPENINGS}) o JOIN (SELECT click_id, count(*) AS pixels FROM {_near_sql("SELECT click_id, trunc(x0) AS x0, trunc(y0) AS y0, trunc(x1) AS x1, trunc(y1) AS y1 FROM (" + _OPENINGS + ")", 2000, 2000)} GROUP BY click_id) n ON o.click_id = n.click_id""")
_query("ras36_opening_area", lambda w: strokes.openings(w.sql(_OPENINGS), ["click_id"]).select("click_id", "area", "real_area"))
_PATH = "SELECT click_id, x0, y0, x1, y1 FROM [[flat_paths]] UNION ALL SELECT click_id, x1, y1, x2, y2 FROM [[flat_paths]]"
_query("ras37_polyline_mask", lambda w: strokes.brush_runs(w["flat_paths"].select("click_id", F.expr("array(struct(x0 as x, y0 as y), struct(x1 as x, y1 as y), struct(x2 as x, y2 as y))").alias("points")), ["click_id"], height=842, width=1191), f"""
SELECT click_id, y, CAST(min(x) AS INT) AS x0, CAST(max(x) AS INT) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY click_id, y ORDER BY x) AS g FROM (SELECT DISTINCT click_id, CAST(y AS INT) AS y, x FROM {_near_sql(_PATH, 1191, 842)})) GROUP BY click_id, y, g""")
_query("ras38_cavity_fill", lambda w: rooms.wand(w["ink2"], w.sql(_EVERY_CLICK), HEIGHT, WIDTH).where("filled"))
_query("ras39_polygon_mask", lambda w: rooms.split_rooms(w["ink2"], HEIGHT, WIDTH, close=0, min_share=0.002).select("page_id", "room_seq", F.octet_length("mask").alias("png_bytes")))
_query("ras40_contours", lambda w: rooms.outlines(raster.components(w["ink2"], eight=True), eps=0.0).select("page_id", "label_y", "label_x", "corners"))
_query("ras14_local_fallback", lambda w: w.sql(_EVERY_CLICK).join(rooms.local_spots(w["ink2"], w.sql(_EVERY_CLICK), HEIGHT, WIDTH), rooms.SPOT).select("click_id", "area"))
_query("snk01_new_projects", lambda w: documents.new_projects(w["projects"].select(F.md5("project_id").alias("project_id"), F.col("project_id").alias("filename"), F.encode("project_id", "UTF-8").alias("pdf"))),
       "SELECT md5(project_id) AS project_id, project_id AS filename, CAST(NULL AS DOUBLE) AS scale_factor, 'm' AS unit, CAST(2.4 AS DOUBLE) AS wall_height, to_base64(encode(project_id)) AS pdf FROM [[projects]]")
_query("snk06_workbook", lambda w: documents.workbooks(_sheet(w)).select("project_id", F.octet_length("workbook").alias("n_bytes")))
_query("snk07_mask_png", lambda w: rooms.split_rooms(w["ink2"], HEIGHT, WIDTH, close=0, min_share=0.002).select("page_id", "room_seq", F.base64("mask").alias("png")))
_query("ext_click_windows", lambda w: clicks.clicks_per_window(w["events"]), "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM [[events]] GROUP BY 1, 2")
_query("ext_user_sessions", lambda w: clicks.sessions(w["events"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events")),
       """SELECT user_id, CAST(sum(s) AS BIGINT) AS sessions, count(*) AS events FROM (SELECT user_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS s
          FROM [[events]] WINDOW w AS (PARTITION BY user_id ORDER BY ts)) GROUP BY user_id""")


def _barriers(w: Workspace, scale: float) -> DataFrame:
    """Lines in pixels: all wall strokes, all gaps between walls (doors, windows and openings) and all drawn polylines, in their thickness."""
    to_pixel = lambda c: (F.col(c) * scale).cast("int").cast("double").alias(c)
    ends = ("x0", "y0", "x1", "y1")
    thick = F.greatest(F.lit(2), (F.col("lw") * scale * 1.5).cast("int")).alias("thick")
    walls = w["walls"].select("page_id", "edge_id").join(w["edges"], ["page_id", "edge_id"]).select("page_id", *map(to_pixel, ends), thick)
    flat = F.col("orient") == "H"
    gap = {c: F.when(flat, F.col(a)).otherwise(F.col(b)) for c, a, b in (("x0", "g0", "perp"), ("y0", "perp", "g0"), ("x1", "g1", "perp"), ("y1", "perp", "g1"))}
    gaps = w["gaps"].withColumns(gap).select("page_id", *map(to_pixel, ends), F.lit(2).alias("thick"))
    path = lambda *c: w["flat_paths"].select("page_id", *[F.col(x).alias(e) for x, e in zip(c, ends, strict=True)])
    drawn = path("x0", "y0", "x1", "y1").union(path("x1", "y1", "x2", "y2")).select("page_id", *map(to_pixel, ends), F.lit(max(3, int(2 * scale))).alias("thick"))
    return walls.union(gaps).union(drawn)


def _vector_rooms(w: Workspace) -> DataFrame:
    """Barriers drawn on a raster 1500 pixels wide, and those of stored masks, split into rooms and named from the page's labels."""
    scale = 1500 / 1191
    height = int(842 * scale)
    # A run of a mask is a line one pixel thick.
    stored = raster.decoded(_mask_files(w, f"SELECT * FROM ({_SOURCE}) WHERE r >= 253"), height, 1500)
    stored = stored.select("page_id", *[F.col(c).cast("double").alias(n) for c, n in (("x0", "x0"), ("y", "y0"), ("x1", "x1"), ("y", "y1"))], F.lit(1).alias("thick"))
    return rooms.named_rooms(_barriers(w, scale).unionByName(stored), w["labels"], height, 1500, scale=scale, close=2, reach=1191 * 0.05)

