"""Embedding near-dedup by PCA-ordered tiled comparison.

Equal vectors of a label are collapsed first. Unit vectors are rotated to the principal axes of all of them,
so that leading dimensions carry most of each product. Vectors of a label are dealt into blocks along the first
axis, by bytes and not by rows where a label is large, so that a vector is sent a bounded number of times up to some
hundred thousand vectors a label and once for each dozens of thousands beyond; a tile is a pair of blocks. In a tile products are accumulated some leading dimensions at a time; what
remains of a product is at most the product of the two vectors' suffix norms, and pairs whose cosine cannot
reach the threshold are dropped. Survivors are confirmed in double precision on the vectors themselves. Block
pairs too far apart along the first axis to reach the threshold are not formed.

A tile returns a count for each vector and edges of a spanning forest, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.components import connected_components, forest
from plumbline.llm.scratch import Scratch

#: Vectors compared at a time inside a tile and the least of a block, blocks that a label is dealt into before blocks
#: grow, bytes at which they stop growing, and dimensions accumulated at a time.
BLOCK, BLOCKS, BLOCK_BYTES, STEP = 1024, 8, 16_000_000, 16
_SLACK = 1e-9


def _moments(size: int):
    """Sums of products of the unit vectors of a partition, as (place, value) rows of the upper triangle."""
    upper = np.triu_indices(size)

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            x = _matrix(batch.column(0), size)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(upper[0] * size + upper[1]), pa.array(total[upper])], names=["k", "s"])

    return run


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Unit rows of a list column, padded with zeros."""
    flat = np.asarray(column.flatten(), np.float64)
    n = np.asarray(column.value_lengths(), np.int64)
    out = np.zeros((len(n), size))
    out[np.arange(size) < n[:, None]] = flat
    return _unit(out)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # first, so that squares neither overflow nor vanish
    x = x / np.where(scale > 0, scale, 1)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def survivors(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rotated unit rows whose product may reach ``least``: leading dimensions first, the rest bounded."""
    size = a.shape[1]
    tail = lambda x: np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], 0))
    ta, tb = np.hstack((tail(a), np.zeros((len(a), 1)))), np.hstack((tail(b), np.zeros((len(b), 1))))
    part, done, i, j, partial = np.zeros((len(a), len(b))), 0, None, None, None
    while done < size:
        stop = min(done + STEP, size)
        if i is None:
            part += a[:, done:stop] @ b[:, done:stop].T
            may = part + np.outer(ta[:, stop], tb[:, stop]) >= least - _SLACK
            if stop == size or may.sum() * 16 < may.size:
                i, j = np.nonzero(may)
                partial = part[i, j]
        else:
            partial = partial + np.einsum("ij,ij->i", a[i, done:stop], b[j, done:stop])
            may = partial + ta[i, stop] * tb[j, stop] >= least - _SLACK
            i, j, partial = i[may], j[may], partial[may]
        done = stop
    return i, j


_TILE = "id long, other long, links long"
#: Components of pairs confirmed in double precision at a time, and edges held before they are cut to a forest.
_CONFIRMED, _EDGES = 4_000_000, 200_000


def _tile(axes, least: float):
    def run(_key, table):
        table = table.combine_chunks()
        ids = np.asarray(table.column("id"), np.int64)
        copies = np.asarray(table.column("copies"), np.int64)
        side = np.asarray(table.column("block"), np.int64)
        x = _matrix(table.column("v").combine_chunks() if isinstance(table.column("v"), pa.ChunkedArray) else table.column("v"), axes.value.shape[0])
        one = bool(side[0] == table.column("other_block")[0].as_py()) and len(np.unique(side)) == 1
        left = np.arange(len(ids)) if one else np.flatnonzero(side == side.min())
        right = left if one else np.flatnonzero(side != side.min())
        turned = x @ axes.value
        count, edges = np.zeros(len(ids), np.int64), []
        for a in range(0, len(left), BLOCK):
            for b in range(a if one else 0, len(right), BLOCK):
                rows, others = left[a : a + BLOCK], right[b : b + BLOCK]
                i, j = survivors(turned[rows], turned[others], least)
                i, j = rows[i], others[j]
                if one and a == b:
                    i, j = i[i < j], j[i < j]
                sure = np.zeros(len(i), bool)
                step = max(1, _CONFIRMED // x.shape[1])
                for at in range(0, len(i), step):
                    part = slice(at, at + step)
                    sure[part] = np.einsum("ij,ij->i", x[i[part]], x[j[part]]) >= least
                i, j = i[sure], j[sure]
                np.add.at(count, i, copies[j])
                np.add.at(count, j, copies[i])
                edges += forest(ids[i], ids[j])
                if len(edges) > _EDGES:
                    edges = forest(*np.array(edges, np.int64).T)
        edges = forest(*np.array(edges, np.int64).reshape(-1, 2).T)
        some = np.flatnonzero(count)
        return pa.table({
            "id": pa.array(np.concatenate((ids[some], np.array([e[0] for e in edges], np.int64)))),
            "other": pa.array([None] * len(some) + [e[1] for e in edges], pa.int64()),
            "links": pa.array(np.concatenate((count[some], np.zeros(len(edges), np.int64)))),
        })

    return run


def near_duplicates(spark: SparkSession, vectors: DataFrame, *, least: float = 0.93, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links, component_id, kept.

    Vectors of one label (not null) are linked when their cosine in double precision is at least ``least``. A vector
    that is null, empty or zero, or holds a null or a number that is not finite, is linked with nothing, and so are
    vectors of different lengths. Equal vectors are linked. n_links counts other rows. A row whose vec_id is null is
    linked with nothing, has a null component_id and is kept; rows that repeat a vec_id count as rows. Other columns are not read. An
    empty table gives an empty table.
    """
    scratch = Scratch(spark, "vectors")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    sound = F.expr("""label is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))
        and exists(v, x -> x <> 0)""")
    base = base.withColumn("v", F.when(F.coalesce(sound, F.lit(False)), F.transform("v", lambda x: x + F.lit(0.0)))).withColumn("key", F.sha2(F.to_json(F.struct("label", "v")), 256))
    rows = scratch.save(base.select("vec_id", "label", "v", F.when(F.col("v").isNotNull() & F.col("vec_id").isNotNull(), F.col("key")).alias("key")), "rows")
    items = scratch.save(
        rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")), "items")
    size = items.agg(F.max(F.size("v"))).first()[0]
    if size is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sums = items.select("v").mapInArrow(_moments(size), "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).toArrow()
    cov = np.zeros(size * size)
    cov[np.asarray(sums.column("k"))] = np.asarray(sums.column("s"))
    cov = cov.reshape(size, size)
    _, axes = np.linalg.eigh(cov + np.triu(cov, 1).T)
    axes = spark.sparkContext.broadcast(np.ascontiguousarray(axes[:, ::-1]))

    first_axis = [float(a) for a in axes.value[:, 0]]
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    lead = F.aggregate(F.zip_with("v", F.slice(F.array(*[F.lit(a) for a in first_axis]), 1, F.size("v")), lambda x, a: x * a), F.lit(0.0), lambda a, x: a + x) / norm
    placed = items.select("id", "copies", "v", F.concat_ws("|", "label", F.size("v").cast("string")).alias("part"), F.coalesce(F.when(norm > 0, lead), F.lit(0.0)).alias("lead"))
    placed = scratch.save(placed, "placed")
    # Blocks: equal shares of each part along the first axis, by borders that are quantiles of it; very large parts split them by hash.
    most = max(block, BLOCK_BYTES // (8 * size))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("lead", [k / 512 for k in range(1, 512)], 4096).alias("q"))
    counts = counts.withColumn("blocks", F.ceil(F.col("n") / F.greatest(F.lit(block), F.least(F.lit(most), F.ceil(F.col("n") / BLOCKS)))).cast("int"))
    counts = counts.withColumn("borders", F.expr(
        "case when blocks = 1 then cast(array() as array<double>) else transform(sequence(1, least(blocks, 512) - 1), k -> q[cast(least(510, greatest(0, 512 * k / least(blocks, 512) - 1)) as int)]) end"))
    spread = scratch.save(counts.select("part", "blocks", "borders", F.greatest(F.lit(1), F.ceil(F.col("blocks") / 512)).alias("split")), "spread")
    inside = placed.join(spread, "part")
    inside = inside.withColumn("block", F.expr("(size(filter(borders, x -> x < lead)) * split + pmod(xxhash64(id), split)) * 1L"))
    inside = scratch.save(inside.select("id", "copies", "v", "part", "lead", "block"), "blocks")
    extent = scratch.save(inside.groupBy("part", "block").agg(F.min("lead").alias("lo"), F.max("lead").alias("hi")), "extent")
    reach = math.sqrt(2 - 2 * least) + 1e-6
    tiles = extent.alias("a").join(extent.alias("b"), F.expr(f"a.part = b.part and a.block <= b.block and b.lo - a.hi <= {reach} and a.lo - b.hi <= {reach}"))
    tiles = tiles.select("a.part", F.col("a.block").alias("x"), F.col("b.block").alias("y"))
    # Two rows a tile; Spark broadcasts them while they are small and else joins by block, splitting large ones.
    ends = scratch.save(tiles.select("part", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block")), "ends")
    dealt = inside.select("id", "copies", "v", "part", "block").join(ends, ["part", "block"])
    dealt = dealt.select("id", "copies", "v", "part", "x", "y", "block", F.when(F.col("block") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("other_block"))
    found = scratch.save(dealt.groupBy("part", "x", "y").applyInArrow(_tile(axes, least), _TILE), "found")
    degree = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    classes = connected_components(found.where("other is not null").select(F.col("id").alias("u"), F.col("other").alias("v")), scratch)
    named = (
        items.select("key", "id", "copies").join(degree, "id", "left").join(classes.withColumnRenamed("node", "id"), "id", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    out = rows.select("vec_id", "key").join(named, "key", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
