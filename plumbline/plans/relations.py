"""Derived relations: as DataFrames by the operators, and as DuckDB SQL for the oracles."""

from __future__ import annotations

from plumbline.operators import detect, drawings, edges, gaps, labels, steps
from plumbline.operators import raster as pixels
from plumbline.sources.fixtures import ADAPTERS, Workspace

# Rows and columns of a raster's page; of a network's class map, and of the page that it is resized to.
HEIGHT, WIDTH = 64, 64
MAP_HEIGHT, MAP_WIDTH, CLASS_HEIGHT, CLASS_WIDTH = 20, 25, 320, 400

DERIVED = {
    # Dealt before they are given their page's name, edges keep their place for all that goes by page.
    "edges_raw": lambda w: w.sql(ADAPTERS["edges_raw"], lineitem=w["lineitem"].repartition("l_suppkey")),
    "visible": lambda w: edges.visible(w["edges_raw"]),
    "edges": lambda w: edges.normalise(w["edges_raw"]),
    "wall_width": lambda w: edges.wall_width(w["edges"]),
    "walls": lambda w: edges.walls(w["edges"]),
    "gaps_all": lambda w: gaps.collinear_gaps(w["walls"]),
    "gaps": lambda w: gaps.dedup_gaps(w["gaps_all"]),
    "typed": lambda w: gaps.classify(w["gaps"], w["curves"], w["edges"]),
    "phrases": lambda w: labels.phrases(page_words(w)),
    "labels": lambda w: labels.labels(page_words(w)),
    "ink": lambda w: w["raster"].where("gray >= 208").select("page_id", "y", "x"),
    "ink2": lambda w: w["raster"].where("gray % 8 < 3").select("page_id", "y", "x"),
    "closed": lambda w: pixels.close(w["ink"], 1, 1, HEIGHT, WIDTH),
    "selection": lambda w: w["edges"].where("structural").select("page_id", "edge_id"),
    "seeds": lambda w: w.sql(SQL["seeds"]),
    "erasers": lambda w: w.sql(SQL["erasers"]),
    "detected": lambda w: w.sql(SQL["detected"]),
    "flat_paths": lambda w: w.sql(SQL["flat_paths"]),
    "strokes": lambda w: w.sql(SQL["strokes"]),
    "drawings": lambda w: paths(w.sql(SQL["drawn"])),
    "mask_state": lambda w: w.sql(SQL["mask_texts"]).selectExpr("* except (edge_text)", "cast(filter(split(edge_text, ' '), z -> z <> '') as array<int>) as edge_ids"),
    "items": lambda w: drawings.items(w["drawings"], edges.PAGE_WIDTH, edges.PAGE_HEIGHT),
    "class_map": lambda w: pixels.resize(w["logits"].drop("pixel_id"), MAP_HEIGHT, MAP_WIDTH, CLASS_HEIGHT, CLASS_WIDTH),
    "class_masks": lambda w: pixels.class_masks(w["class_map"], CLASS_HEIGHT, CLASS_WIDTH),
    "class_rooms": lambda w: detect.class_rooms(w["class_map"], CLASS_HEIGHT, CLASS_WIDTH),
}

_HATCH = "(((angle > 20 AND angle < 70) OR (angle > 110 AND angle < 160)) AND length < 20)"
_AXIS = "(angle < 10 OR angle > 170 OR abs(angle - 90) < 10)"

SQL = dict(ADAPTERS) | {
    "visible": """
SELECT * FROM [[edges_raw]] WHERE NOT (object_type = 'curve_edge' AND NOT stroke) AND NOT (fill AND NOT stroke) AND NOT (fill AND coalesce(linewidth, 0) < 0.01)
 AND NOT (greatest(x0, x1) < -5 OR least(x0, x1) > 1196 OR greatest(y0, y1) < -5 OR least(y0, y1) > 847)""",
    "edges": f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY raw_id) - 1 AS BIGINT) AS edge_id, raw_id, x0, y0, x1, y1, lw, color, fill AS filled, object_type AS type,
 is_dashed, length, angle, {_AXIS} AS axis, ({_AXIS} OR length >= 12) AS structural
FROM (SELECT *, coalesce(linewidth, 0) AS lw, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS length, abs(degrees(atan2(y1 - y0, x1 - x0))) % 180 AS angle FROM [[visible]])
WHERE NOT {_HATCH}""",
    "hist": "SELECT page_id, @half(lw, 2) AS lw, count(*) AS n, min(edge_id) AS seen FROM [[edges]] WHERE lw > 0 GROUP BY page_id, @half(lw, 2)",
    "wall_width": """
SELECT p.page_id, coalesce(h.common, h.most, 0.15) AS wall_lw FROM (SELECT DISTINCT page_id FROM [[edges]]) p LEFT JOIN (
 SELECT page_id, min(CASE WHEN n > 0.02 * total AND lw >= 0.15 THEN lw END) AS common, max(lw) AS most
 FROM (SELECT *, sum(n) OVER (PARTITION BY page_id) AS total FROM [[hist]]) GROUP BY page_id) h ON p.page_id = h.page_id""",
    "walls": """
SELECT page_id, edge_id, orient, CASE orient WHEN 'H' THEN least(x0, x1) ELSE least(y0, y1) END AS lo, CASE orient WHEN 'H' THEN greatest(x0, x1) ELSE greatest(y0, y1) END AS hi,
 CASE orient WHEN 'H' THEN (y0 + y1) / 2 ELSE (x0 + x1) / 2 END AS perp
FROM (SELECT e.*, CASE WHEN abs(x1 - x0) > abs(y1 - y0) * 2.5 THEN 'H' WHEN abs(y1 - y0) > abs(x1 - x0) * 2.5 THEN 'V' END AS orient
      FROM [[edges]] e JOIN [[wall_width]] w ON e.page_id = w.page_id WHERE lw >= wall_lw AND length >= 25) WHERE orient IS NOT NULL""",
    "gaps_all": """
SELECT page_id, orient, ia, ib, width, g0, g1, perp, CASE orient WHEN 'H' THEN (g0 + g1) / 2 ELSE perp END AS mx, CASE orient WHEN 'H' THEN perp ELSE (g0 + g1) / 2 END AS my
FROM (SELECT a.page_id, a.orient, a.edge_id AS ia, b.edge_id AS ib, (a.perp + b.perp) / 2 AS perp,
  CASE WHEN b.lo - a.hi > 10 AND b.lo - a.hi < 160 THEN b.lo - a.hi ELSE a.lo - b.hi END AS width,
  CASE WHEN b.lo - a.hi > 10 AND b.lo - a.hi < 160 THEN a.hi ELSE b.hi END AS g0, CASE WHEN b.lo - a.hi > 10 AND b.lo - a.hi < 160 THEN b.lo ELSE a.lo END AS g1
 FROM [[walls]] a JOIN [[walls]] b ON a.page_id = b.page_id AND a.orient = b.orient AND a.edge_id < b.edge_id AND abs(a.perp - b.perp) <= 4
 WHERE (b.lo - a.hi > 10 AND b.lo - a.hi < 160) OR (a.lo - b.hi > 10 AND a.lo - b.hi < 160))""",
    "gaps": """
SELECT page_id, orient, ia, ib, width, g0, g1, perp, mx, my, CAST(row_number() OVER (PARTITION BY page_id ORDER BY orient, ia, ib) - 1 AS BIGINT) AS gap_id
FROM (SELECT *, row_number() OVER (PARTITION BY page_id, @half(mx / 10), @half(my / 10) ORDER BY width, orient, ia, ib) AS r FROM [[gaps_all]]) WHERE r = 1""",
    "arcs": """
SELECT DISTINCT g.page_id, g.gap_id FROM [[gaps]] g JOIN [[curves]] c ON g.page_id = c.page_id
WHERE c.n_pts >= 4 AND c.size >= 8 AND c.size <= 4 * g.width AND sqrt((c.cx - g.mx) * (c.cx - g.mx) + (c.cy - g.my) * (c.cy - g.my)) < 1.8 * g.width""",
    "lines": """
SELECT g.page_id, g.gap_id, count(*) AS n FROM [[gaps]] g JOIN [[edges]] e ON g.page_id = e.page_id
WHERE e.length > 0.5 * g.width AND e.length < 1.5 * g.width
 AND sqrt(((e.x0 + e.x1) / 2 - g.mx) * ((e.x0 + e.x1) / 2 - g.mx) + ((e.y0 + e.y1) / 2 - g.my) * ((e.y0 + e.y1) / 2 - g.my)) < 0.8 * g.width GROUP BY g.page_id, g.gap_id""",
    "typed": """
SELECT g.*, CASE WHEN a.gap_id IS NOT NULL THEN 'door' WHEN coalesce(l.n, 0) >= 3 THEN 'window' ELSE 'opening' END AS type, CAST(coalesce(l.n, 0) AS BIGINT) AS n_lines
FROM [[gaps]] g LEFT JOIN [[arcs]] a ON g.page_id = a.page_id AND g.gap_id = a.gap_id LEFT JOIN [[lines]] l ON g.page_id = l.page_id AND g.gap_id = l.gap_id""",
    "phrases": """
SELECT page_id, CAST(ln AS BIGINT) AS ln, string_agg(text, ' ' ORDER BY x0, word_id) AS text, min(x0) AS x0, min(top) AS y0, max_by(x1, x0) AS x1, max(bottom) AS y1, count(*) AS n_words FROM (
 SELECT *, sum(s) OVER (PARTITION BY page_id, ln ORDER BY x0, word_id ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, CASE WHEN lag(top) OVER l IS NULL OR abs(top - lag(top) OVER l) >= 5 OR x0 - lag(x1) OVER l >= 12 THEN 1 ELSE 0 END AS s
  FROM (SELECT *, @half(top / 5) AS ln FROM [[words]]) WINDOW l AS (PARTITION BY page_id, ln ORDER BY x0, word_id))) GROUP BY page_id, ln, g""",
    "ink": "SELECT page_id, y, x FROM [[raster]] WHERE gray >= 208",
    "ink2": "SELECT page_id, y, x FROM [[raster]] WHERE gray % 8 < 3",
    "selection": "SELECT page_id, edge_id FROM [[edges]] WHERE structural",
    # One seed for each kind of stroke on a page, one eraser stroke for each click, a detection for each user.
    "seeds": "SELECT page_id, min(edge_id) AS edge_id FROM [[edges]] WHERE structural GROUP BY page_id, filled, color, type",
    "erasers": "SELECT page_id, x AS px, y AS py FROM [[clicks]]",
    "detected": """
SELECT project_id, CASE WHEN count(*) % 5 = 0 THEN NULL ELSE CAST(@half(sum(coalesce(real_length, 0)), 3) AS DOUBLE) END AS wall_length,
 CAST(@countif(category = 'Doors') AS BIGINT) AS doors, CAST(@countif(category = 'Windows') AS BIGINT) AS windows FROM [[masks]] GROUP BY project_id""",
    # What clients store of a mask, with malformed and empty values.
    "mask_texts": """
SELECT project_id, mask_seq, category, CASE WHEN mask_seq % 3 = 0 THEN '3 5 8' WHEN mask_seq % 4 = 0 THEN '' END AS edge_text,
 CASE mask_seq % 5 WHEN 0 THEN '1,2 3.5,4' WHEN 1 THEN '1,2 9' WHEN 2 THEN '1,x 3,4' WHEN 3 THEN '' END AS polyline_points,
 CASE WHEN mask_seq % 7 = 0 THEN 'aGk=' WHEN mask_seq % 7 = 1 THEN '' END AS mask_b64, CASE WHEN mask_seq % 11 < 5 THEN 'data:image/png;base64,aGk=' WHEN mask_seq % 11 < 9 THEN 'blob:x' END AS src FROM [[masks]]""",
    # Paths of a page: a line, a box or a parallelogram by the kind of edge, and a closing line in each third.
    "drawn": """
SELECT page_id, raw_id AS drawing_id, CASE WHEN fill AND stroke THEN 'fs' WHEN fill THEN 'f' ELSE 's' END AS type, color, CASE WHEN fill THEN 'K' END AS fill, nullif(linewidth, 0) AS width, is_dashed,
 CASE object_type WHEN 'line' THEN 'l' WHEN 'rect_edge' THEN 're' ELSE 'qu' END AS kind, raw_id % 3 = 0 AS closed, x0, y0, x1, y1 FROM [[edges_raw]]""",
    "items": """
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY drawing_id, pos) - 1 AS BIGINT) AS item_id, CASE WHEN type = 's' THEN 'stroke' ELSE 'fill' END AS type, color, fill, width, kind, x0, y0, x1, y1
FROM (SELECT *, 0 AS pos FROM [[drawn]] UNION ALL SELECT * REPLACE ('l' AS kind, x1 AS x0, y1 AS y0, x0 AS x1, y0 + 12 AS y1), 1 FROM [[drawn]] WHERE closed) WHERE NOT is_dashed""",
    # Pointer paths: a click and the places it was dragged to; users' strokes for calibration.
    "flat_paths": """
SELECT click_id, page_id, x AS x0, y AS y0, x + CAST(click_id % 40 AS DOUBLE) AS x1, y AS y1, x + CAST(click_id % 40 AS DOUBLE) AS x2, y + CAST(click_id % 30 AS DOUBLE) AS y2 FROM [[clicks]]""",
    "strokes": """
SELECT s.project_id, p.x0, p.y0, p.x2 AS x1, p.y2 AS y1, CAST(p.click_id % 4 AS DOUBLE) AS real_length
FROM [[projects]] s JOIN (SELECT page_id, min(click_id) AS first FROM [[clicks]] GROUP BY page_id) f ON s.page_id = f.page_id JOIN [[flat_paths]] p ON p.click_id = f.first""",
}

# A class map by looking up each pixel of the page; labels by passing the smallest on; contours from the windows of four pixels that they cross.
SQL["class_map"] = f"""
SELECT l.page_id, CAST(v.x AS INT) AS y, CAST(u.x AS INT) AS x, l.room_cls, l.icon_cls FROM @series(0, {CLASS_HEIGHT - 1}) v CROSS JOIN @series(0, {CLASS_WIDTH - 1}) u
 JOIN [[logits]] l ON l.y = v.x * {MAP_HEIGHT} // {CLASS_HEIGHT} AND l.x = u.x * {MAP_WIDTH} // {CLASS_WIDTH}"""


def labels_sql(pixels: str, layer: str = "page_id", eight: bool = True) -> str:
    """(layer, y, x, c): c is the smallest y * 4096 + x of the component."""
    cols = [c.strip() for c in layer.split(",")]
    steps = "(-1, -1), (-1, 1), (1, -1), (1, 1), " if eight else ""
    return f"""(WITH RECURSIVE k AS MATERIALIZED ({pixels}), near AS (SELECT * FROM (VALUES {steps}(-1, 0), (1, 0), (0, -1), (0, 1)) t(dy, dx)),
 touch AS MATERIALIZED (SELECT a.*, b.y AS ny, b.x AS nx FROM (SELECT k.*, y + dy AS ty, x + dx AS tx FROM k CROSS JOIN near) a JOIN k b USING ({layer}) WHERE b.y = ty AND b.x = tx),
 r({layer}, y, x, c) USING KEY ({layer}, y, x) AS (SELECT {layer}, y, x, y * 4096 + x FROM k
  UNION SELECT {', '.join('n.' + c for c in cols)}, n.y, n.x, n.c FROM (SELECT {', '.join('t.' + c for c in cols)}, t.ny AS y, t.nx AS x, min(r.c) AS c FROM r JOIN touch t USING ({layer}, y, x) GROUP BY ALL) n
   JOIN recurring.r o ON {' AND '.join(f'o.{c} = n.{c}' for c in (*cols, 'y', 'x'))} WHERE n.c < o.c)
 SELECT * FROM r)"""


def contours_sql(labelled: str, layer: str = "page_id") -> str:
    """(layer, c, perimeter, contour_area) of components; those that the number of their corners says have holes are filled first, with
    what cannot be reached from around their boxes."""
    key = f"{layer}, c"
    quads = f"""SELECT {key}, wy, wx, count(*) AS n, count(DISTINCT y) = 2 AND count(DISTINCT x) = 2 AS both_ways FROM (
  SELECT {key}, y, p.x, y + v.x AS wy, p.x + u.x AS wx FROM %s p CROSS JOIN @series(-1, 0) v CROSS JOIN @series(-1, 0) u) GROUP BY {key}, wy, wx"""
    on = " AND ".join(f"g.{c.strip()} = r.{c.strip()}" for c in key.split(","))
    return f"""(WITH RECURSIVE own AS MATERIALIZED (SELECT {key}, y, x FROM {labelled}),
 holed AS MATERIALIZED (SELECT {key} FROM ({quads % 'own'}) GROUP BY {key}
  HAVING sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN n = 2 AND both_ways THEN -2 ELSE 0 END) < 4),
 box AS MATERIALIZED (SELECT {key}, min(y) - 1 AS y0, max(y) + 1 AS y1, min(x) - 1 AS x0, max(x) + 1 AS x1 FROM own SEMI JOIN holed USING ({key}) GROUP BY {key}),
 grid AS MATERIALIZED (SELECT {key}, y0, x0, y, x FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM box)) ANTI JOIN own USING ({key}, y, x)),
 reached AS (SELECT {key}, y, x FROM grid WHERE y = y0 AND x = x0
  UNION SELECT {', '.join('g.' + c.strip() for c in key.split(','))}, g.y, g.x FROM reached r JOIN grid g ON {on} AND abs(g.y - r.y) + abs(g.x - r.x) = 1),
 filled AS (SELECT {key}, y, x FROM own UNION ALL (SELECT {key}, y, x FROM grid ANTI JOIN reached USING ({key}, y, x)))
 SELECT {key}, sum(CASE WHEN n = 3 THEN sqrt(2) WHEN n = 2 AND both_ways THEN 2 * sqrt(2) WHEN n = 2 THEN 1 ELSE 0 END) AS perimeter, sum(CASE n WHEN 4 THEN 1 WHEN 3 THEN 0.5 ELSE 0 END)::DOUBLE AS contour_area
 FROM ({quads % 'filled'}) GROUP BY {key})"""


_DIMENSION = labels.DIMENSION.replace("'", "''")
_COMPASS = ", ".join(f"'{c}'" for c in labels.COMPASS)
DIMENSION_SQL = f"(@re(trim(text), '{_DIMENSION}') OR (@re(trim(text), '^[\\d.,]+$') AND length(trim(text)) <= 8) OR upper(trim(text)) IN ({_COMPASS}))"
ROOM_SQL = f"regexp_matches(text, '(?i){labels.ROOM_PATTERN}')"
TITLE_SQL = r"(length(text) >= 3 AND len(list_filter(string_split_regex(trim(text), '\s+'), lambda w: length(w) > 1 AND NOT regexp_matches(substr(w, 1, 1), '^\p{Lu}'))) = 0 AND NOT regexp_matches(text, '^[\d.,\s]+$'))"
SQL["labels"] = f"""
SELECT page_id, text, x, y, ({ROOM_SQL} OR {TITLE_SQL}) AS is_room_label
FROM (SELECT *, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM [[phrases]]) WHERE x >= 0 AND y >= 0 AND x <= 1191 AND y <= 842 AND NOT {DIMENSION_SQL}"""


def paths(drawn):
    """Drawings with arrays of items from their first items' corners."""
    from pyspark.sql import functions as F

    point = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    item = lambda kind, *points: F.struct(F.lit(kind).alias("kind"), F.array(*points).alias("points"))
    a, b = point("x0", "y0"), point("x1", "y1")
    main = F.when(F.col("kind") == "l", item("l", a, b)).when(F.col("kind") == "re", item("re", a, point("x1 + 5", "y1 + 8"))).otherwise(
        item("qu", a, b, point("x1 + 7", "y1 + 12"), point("x0 + 7", "y0 + 12")))
    some = F.when(F.col("closed"), F.array(main, item("l", b, point("x0", "y0 + 12")))).otherwise(F.array(main))
    return drawn.select("page_id", "drawing_id", "type", "color", "fill", "width", "is_dashed", some.alias("items"))


def page_words(w: Workspace):
    """Words by page: texts are dealt before they are split, as their words take several times the room."""
    return w.sql(ADAPTERS["words"], documents=steps.dealt(w["documents"].select("doc_id", "text"), "doc_id"))


def workspace(spark, sf_dir: str) -> Workspace:
    return Workspace(spark, sf_dir, DERIVED)
