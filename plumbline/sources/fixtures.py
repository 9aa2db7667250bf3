"""Adapters from the driver's parquet tables to the engine's relations.

Each adapter is one SELECT that both Spark and DuckDB run; [[x]] names another relation and @f(...) a function that the
two engines spell differently (see ``render``).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

_X = "CAST(60 * ((l_partkey * 5 + l_linenumber * 3) % 21) AS DOUBLE)"
_Y = "CAST(60 * ((l_orderkey * 5 + l_linenumber) % 14) AS DOUBLE)"

ADAPTERS = {
    "edges_raw": f"""
SELECT CAST(l_suppkey AS BIGINT) AS page_id,
 CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS BIGINT) AS raw_id,
 CASE l_linenumber % 3 WHEN 0 THEN 'line' WHEN 1 THEN 'rect_edge' ELSE 'curve_edge' END AS object_type,
 l_returnflag <> 'A' AS stroke, l_linestatus = 'F' AS fill, CAST(round(l_discount * 100) AS DOUBLE) / 10 AS linewidth,
 {_X} AS x0, {_Y} AS y0,
 {_X} + CASE (l_orderkey + l_partkey) % 4 WHEN 1 THEN 0 WHEN 3 THEN l_quantity WHEN 0 THEN 4 * l_quantity ELSE 60 * (1 + l_quantity % 3) END AS x1,
 {_Y} + CASE (l_orderkey + l_partkey) % 4 WHEN 1 THEN 60 * (1 + l_quantity % 3) WHEN 3 THEN CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE floor(l_quantity / 4) END ELSE 0 END AS y1,
 CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS color, l_tax >= 0.07 AS is_dashed
FROM [[lineitem]]""",
    "curves": """
SELECT CAST(floor(o_custkey / 15.0) AS BIGINT) AS page_id, o_orderkey AS curve_id, CAST(4 AS INT) AS n_pts,
 CAST(12 * ((o_orderkey * 7) % 99) AS DOUBLE) AS cx, CAST(12 * ((o_orderkey * 5 + o_custkey) % 68) AS DOUBLE) AS cy,
 CAST(4 + (o_orderkey * 3) % 80 AS DOUBLE) AS size
FROM [[orders]] WHERE o_orderkey % 8 = 0""",
    "clicks": """
SELECT event_id AS click_id, CAST(floor(user_id / 1.5) AS BIGINT) AS page_id,
 CAST((event_id * 37) % 1191 AS DOUBLE) AS x, CAST((event_id * 53) % 842 AS DOUBLE) AS y,
 CASE event_type WHEN 'purchase' THEN 'Doors' WHEN 'signup' THEN 'Windows' ELSE 'Walls' END AS category
FROM [[events]]""",
    "projects": """
SELECT CAST(s_suppkey AS BIGINT) AS page_id, s_name AS project_id,
 CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(20 + s_suppkey % 7 AS DOUBLE) END AS scale_factor,
 CAST(2.4 AS DOUBLE) AS wall_height
FROM [[supplier]]""",
    "masks": """
SELECT CAST(user_id AS BIGINT) AS project_id, event_id AS mask_seq,
 CASE event_type WHEN 'purchase' THEN 'Doors' WHEN 'signup' THEN 'Windows' WHEN 'error' THEN NULL ELSE 'Walls' END AS category,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS real_length,
 CASE event_type WHEN 'purchase' THEN CAST(2.1 AS DOUBLE) WHEN 'signup' THEN CAST(1.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS height,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 4 AS INT) END AS cnt
FROM [[events]]""",
    "rooms": """
SELECT CAST(o_custkey AS BIGINT) AS project_id,
 CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS room_seq,
 CASE o_orderstatus WHEN 'F' THEN 'Kitchen' WHEN 'P' THEN 'Bedroom' ELSE 'Hall' END AS name,
 o_totalprice / 10000 AS real_area, o_totalprice / 5000 AS real_perimeter
FROM [[orders]]""",
    "words": """
SELECT CAST(doc_id AS BIGINT) AS page_id, CAST(i AS BIGINT) AS word_id, w AS text,
 CAST(60 * (i % 20) AS DOUBLE) AS x0, CAST(20 * floor(i / 20.0) AS DOUBLE) AS top,
 CAST(60 * (i % 20) + 5 * length(w) AS DOUBLE) AS x1, CAST(20 * floor(i / 20.0) + 10 AS DOUBLE) AS bottom
FROM @words() WHERE w <> ''""",
    "logits": """
SELECT CAST(vec_id AS BIGINT) AS pixel_id, CAST(vec_id % 25 AS INT) AS x, CAST(floor((vec_id % 500) / 25.0) AS INT) AS y, CAST(floor(vec_id / 500.0) AS BIGINT) AS page_id,
 @argmax(embedding, 22, 12) AS room_cls, @argmax(embedding, 34, 11) AS icon_cls
FROM [[embeddings]]""",
    # A gray raster for pixel operators: a page for every 64 vectors, a row for each of them, a component of the vector for each x.
    "raster": """
SELECT CAST(floor(vec_id / 64.0) AS BIGINT) AS page_id, CAST(vec_id % 64 AS INT) AS y, CAST(x - 1 AS INT) AS x,
 CAST(@floor(@times(abs(@item(embedding, x)), 997)) % 256 AS INT) AS gray
FROM [[embeddings]] CROSS JOIN @series(1, 64)""",
}

_ENGINES: dict[str, dict[str, Callable[..., str]]] = {
    "spark": {
        "half": lambda x, n="0": f"bround({x}, {n})",
        "int": lambda x: f"CAST({x} AS BIGINT)",
        "floor": lambda x: f"CAST(floor({x}) AS BIGINT)",
        "div": lambda a, b: f"try_divide({a}, {b})",
        "words": lambda *_: r"(SELECT doc_id, i, w FROM [[documents]] LATERAL VIEW posexplode(split(text, '[ \\n\\t\\r]+')) t AS i, w)",
        "argmax": lambda a, start, n: f"CAST(array_position(slice({a}, {start}, {n}), array_max(slice({a}, {start}, {n}))) - 1 AS INT)",
        "item": lambda a, i: f"element_at({a}, {i})",
        # A float times an integer is a float in DuckDB and would be a double in Spark.
        "times": lambda a, b: f"{a} * CAST({b} AS FLOAT)",
        "series": lambda a, b: f"(SELECT explode(sequence({a}, {b})) AS x)",
        "countif": lambda c: f"count_if({c})",
        "re": lambda s, p: f"({s} rlike {p})",
        "iu": lambda: "(?iu)",
        "list": lambda x, order: f"array_join(transform(array_sort(collect_list(struct({order} AS o, {x} AS v))), z -> z.v), ' ')",
        "fixed": lambda x, n: f"format_string('%.{n}f', {x})",
        "bool": lambda x: f"({x})",
    },
    "duckdb": {
        "half": lambda x, n="0": f"round_even({x}, {n})",
        "int": lambda x: f"CAST(trunc({x}) AS BIGINT)",
        "floor": lambda x: f"CAST(floor({x}) AS BIGINT)",
        "div": lambda a, b: f"({a} / nullif({b}, 0))",
        "words": lambda *_: r"(SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS w FROM (SELECT doc_id, regexp_split_to_array(text, '[ \n\t\r]+') AS a FROM [[documents]]))",
        "argmax": lambda a, start, n: f"CAST(list_position({a}[{start}:{int(start) + int(n) - 1}], list_max({a}[{start}:{int(start) + int(n) - 1}])) - 1 AS INT)",
        "item": lambda a, i: f"{a}[{i}]",
        "times": lambda a, b: f"{a} * {b}",
        "series": lambda a, b: f"(SELECT unnest(range({a}, {b} + 1)) AS x)",
        "countif": lambda c: f"count(*) FILTER (WHERE {c})",
        "re": lambda s, p: f"regexp_matches({s}, {p})",
        "iu": lambda: "(?i)",
        "list": lambda x, order: f"string_agg({x}, ' ' ORDER BY {order})",
        "fixed": lambda x, n: f"printf('%.{n}f', {x})",
        "bool": lambda x: f"({x})",
    },
}


def _split_arguments(text: str) -> list[str]:
    out, depth, at = [], 0, 0
    for k, c in enumerate(text):
        depth += c in "([" or -(c in ")]")
        if c == "," and depth == 0:
            out.append(text[at:k].strip())
            at = k + 1
    last = text[at:].strip()
    return [*out, last] if last or out else []


def render(text: str, engine: str) -> str:
    """Replaces @f(...) by the engine's spelling, inner calls first."""
    while found := list(re.finditer(r"@(\w+)\(", text)):
        start = found[-1]
        depth, k = 1, start.end()
        while depth:
            depth += (text[k] == "(") - (text[k] == ")")
            k += 1
        text = text[: start.start()] + _ENGINES[engine][start[1]](*_split_arguments(text[start.end() : k - 1])) + text[k:]
    return text


def names_in(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\[\[(\w+)\]\]", text)))


def oracle(text: str, relations: dict[str, str]) -> str:
    """DuckDB SQL with the relations that the text needs as common table expressions; driver tables stand as they are."""
    order: list[str] = []

    def need(sql: str) -> None:
        for name in names_in(sql):
            if name in relations and name not in order:
                inner = render(relations[name], "duckdb")
                need(inner)
                order.append(name)

    body = render(text, "duckdb")
    need(body)
    flat = lambda sql: re.sub(r"\[\[(\w+)\]\]", lambda m: f"fx_{m[1]}" if m[1] in relations else m[1], sql)
    with_ = ",\n".join(f"fx_{n} AS ({flat(render(relations[n], 'duckdb'))})" for n in order)
    return (f"WITH {with_}\n" if with_ else "") + flat(body)


class Workspace:
    """The relations of one directory as DataFrames, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, derived: dict[str, Callable[[Workspace], DataFrame]]):
        self.spark, self.sf_dir, self.derived, self.made = spark, sf_dir, derived, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in self.derived:
                self.made[name] = self.derived[name](self)
            elif name in ADAPTERS:
                self.made[name] = self.sql(ADAPTERS[name])
            else:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]

    def sql(self, text: str, **own: DataFrame) -> DataFrame:
        """Spark SQL over relations named in [[...]], of which some may be given."""
        text = render(text, "spark")
        frames = {name: own[name] if name in own else self[name] for name in names_in(text)}
        return self.spark.sql(re.sub(r"\[\[(\w+)\]\]", r"{\1}", text), **frames)
