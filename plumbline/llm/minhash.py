"""MinHash near-dedup with tensored banding.

Two collections of ``side`` sub-keys are drawn, each sub-key the minima of ``depth`` hash functions. Table
(i, j) is keyed by sub-key i of the first and j of the second collection, so ``side ** 2`` tables of
``2 * depth`` minima each cost ``2 * side * depth`` minima instead of ``2 * side ** 2 * depth``. A pair of
similarity s meets in some table with probability (1 - (1 - s^depth)^side)^2: 0.9996 at 0.8 with depth 3
and side 12.

Plan: equal shingle sets are collapsed first; sub-keys that only one set has are dropped before tables are
keyed. Each bucket's members are compared with its first, their pivot, on full sets. Where that leaves members of a pivot in different
components, they are dealt into tiles of at most some hundreds and compared there, exactly, by what they have
beyond the pivot and lack of it; a tile returns edges that join components, never its pairs. So no link between
members of a bucket that matters to its class is lost, and no task gets more than a tile.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.bytewords import SPACE_WORDS, column_words, mix, shingles
from plumbline.llm.components import connected_components, forest
from plumbline.llm.scratch import Scratch

_SIGNED = "doc_id long, n_shingles long, set_key binary, subkeys array<long>"


def shingle_sets(column: pa.Array, k: int):
    """Yields (row, distinct shingles in order) of each text; fewer than k words make one shingle, none make none."""
    for words in column_words(column, SPACE_WORDS):
        lo, h, bounds = words.row, words.hashes, words.bounds
        every = shingles(h, k)
        for row in range(lo, words.end_row):
            a, b = int(bounds[row - lo]), int(bounds[row - lo + 1])
            if b - a >= k:
                s = np.sort(every[a : b - k + 1])
                yield row, s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                yield row, shingles(h[a:b], b - a)
            else:
                yield row, np.zeros(0, np.uint64)


def subkeys(sets: list[np.ndarray], side: int, depth: int) -> np.ndarray:
    """2 * side sub-keys for each non-empty set."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    seeds = mix(np.arange(1, 4 * side * depth + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((len(sets), 2 * side), dtype=np.uint64)
    for j in range(2 * side):
        key = np.full(len(sets), j + 1, dtype=np.uint64)
        for d in range(depth):
            f = 2 * (j * depth + d)
            v = (flat ^ np.uint32(seeds[f] >> np.uint64(32))) * np.uint32((seeds[f + 1] >> np.uint64(32)) | np.uint64(1))
            key = mix(key + np.minimum.reduceat(v, starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        out[:, j] = key
    return out


def _signer(k: int, side: int, depth: int):
    block = 2048

    def sign(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            n_out, set_out, key_out = [], [], []
            held: list[np.ndarray] = []

            def flush():
                full = [s for s in held if len(s)]
                keys = iter(subkeys(full, side, depth).view(np.int64)) if full else iter(())
                for s in held:
                    n_out.append(len(s))
                    set_out.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    key_out.append(next(keys) if len(s) else None)
                held.clear()

            size = 0
            for _, s in shingle_sets(texts, k):
                held.append(s)
                size += len(s)
                if len(held) >= block or size > 400_000:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_out, pa.int64()), pa.array(set_out, pa.binary()), pa.array(key_out, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "subkeys"])

    return sign


def _set_maker(k: int):
    def make(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            lengths, flat = [0], []
            for _, s in shingle_sets(texts, k):
                flat.append(s)
                lengths.append(lengths[-1] + len(s))
            values = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(values))], names=["doc_id", "shingles"])

    return make


def _shared(lists: pa.Array, n: int) -> np.ndarray:
    """Sizes of the intersections of n lists, from products of 0/1 matrices over some of the elements at a time."""
    sizes = np.asarray(lists.value_lengths(), np.int64)
    values, which, times = np.unique(np.asarray(lists.flatten(), np.int64), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    place = np.cumsum(times > 1) - 1
    keep = times[which] > 1
    owner, column = owner[keep], place[which[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, b = np.searchsorted(column, (lo, lo + 2048))
        part = np.zeros((n, 2048), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    return out


def _tile(percent: int):
    """Links between the members of a tile that are in different components so far: edges of a spanning forest.

    Of A and B with pivot set P, |A and B| = |P| - |P - A| - |P - B| + |(P - A) and (P - B)| + |(A - P) and (B - P)|.
    """

    def run(table):
        table = table.combine_chunks()
        col = {name: table.column(name).combine_chunks() for name in table.column_names}
        u, c, n = (np.asarray(col[k], np.int64) for k in ("u", "c", "nu"))
        p = np.asarray(col["nv"], np.int64)[0]
        less = np.asarray(col["less"].value_lengths(), np.int64)
        both = p - less[:, None] - less[None, :] + _shared(col["less"], len(u)) + _shared(col["more"], len(u))
        link = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        if col["mixed"][0].as_py():
            far = ~np.asarray(col["linked"].cast(pa.int8()), bool)
            link &= far[:, None] & ~far[None, :]
        else:
            k = np.asarray(col["k"], np.int64)
            link &= np.triu(np.ones_like(link), 1)
            if col["x"][0].as_py() != col["y"][0].as_py():
                link &= k[:, None] != k[None, :]
        link &= c[:, None] != c[None, :]
        i, j = np.nonzero(link)
        edges = forest(c[i], c[j])
        return pa.table({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, *, shingle: int = 5, percent: int = 80, side: int = 12, depth: int = 3, tile: int = 256) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two texts are linked when 100 * |A and B| >= percent * |A or B| over their distinct word shingles.
    component_id is the smallest doc_id reachable over links, kept says whether the row's doc_id is it.
    Words are what white space separates, A-Z lower-cased. A null, empty or blank text has no shingles and is
    linked with nothing. Equal texts are linked (ties go to the smallest doc_id); repeated rows give repeated
    rows, and rows that share a doc_id are one document, linked by any of its texts. Sets are compared as sets of
    64-bit hashes. A row whose doc_id is null has a null component_id and is kept. Other columns are not read. An empty
    table gives an empty table.
    """
    scratch = Scratch(spark, "minhash")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.save(base.mapInArrow(_signer(shingle, side, depth), _SIGNED), "signed")
    items = scratch.save(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_key")
        .agg(F.min("doc_id").alias("item"), F.first("n_shingles").alias("n"), F.min_by("subkeys", "doc_id").alias("subkeys")), "items")

    sub = items.select("item", "n", F.posexplode("subkeys").alias("slot", "key"))
    shared = sub.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    held = (
        sub.join(shared, "key").groupBy("item", "n")
        .agg(F.collect_list(F.struct("slot", "key")).alias("s"))
        .select("item", "n", F.filter("s", lambda x: x.slot < side).alias("a"), F.filter("s", lambda x: x.slot >= side).alias("b"))
        .where("size(a) > 0 and size(b) > 0")
    )
    keyed = held.select("item", "n", F.explode("a").alias("a"), "b").select("item", "n", "a", F.explode("b").alias("b"))
    keyed = keyed.select("item", "n", F.xxhash64("a.key", "b.key").alias("bucket"))
    buckets = scratch.save(keyed, "buckets")
    full = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("item", "n")).alias("pivot")).where("c > 1")
    tables = scratch.save(buckets.join(full.select("bucket", "pivot"), "bucket"), "tables")
    scratch.drop(buckets)

    needed = tables.select(F.col("item").alias("doc_id")).distinct()
    texts = base.join(needed, "doc_id", "left_semi")
    sets = scratch.save(texts.mapInArrow(_set_maker(shingle), "doc_id long, shingles array<long>").where("size(shingles) > 0"), "sets")
    linked = f"100 * i >= {percent} * (nu + nv - i)"

    def met(pairs: DataFrame) -> DataFrame:
        """pairs(u, v) with both full sets and the size of what they share."""
        a = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("su"))
        b = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("sv"))
        return (pairs.join(b, "v").join(a, "u").withColumn("i", F.size(F.array_intersect("su", "sv")))
                .withColumn("nu", F.size("su")).withColumn("nv", F.size("sv")))

    # The first item of a bucket is its pivot.
    pairs = tables.where("item <> pivot.item").select(F.col("item").alias("u"), F.col("pivot.item").alias("v")).distinct()
    star = scratch.save(met(pairs).select("u", "v", F.expr(linked).alias("linked")), "star")
    links = star.where("linked").select("u", "v")
    classes = connected_components(links, scratch)

    # What pivots leave open: members of one pivot that are not in one component, dealt into tiles of bounded size.
    # Members linked to the pivot are in one component, so only tiles with members that are not are formed.
    by_node = classes.select(F.col("node").alias("u"), F.col("component").alias("c"))
    named = star.join(by_node, "u", "left").withColumn("c", F.coalesce("c", "u"))
    several = named.groupBy("v").agg(
        F.min("c").alias("lo"), F.max("c").alias("hi"), F.count_if("linked").alias("near"), F.count_if(~F.col("linked")).alias("far"))
    several = several.where("lo < hi").select("v", F.ceil(F.col("near") / tile).cast("int").alias("near"), F.ceil(F.col("far") / tile).cast("int").alias("far"))
    several = scratch.save(several, "several")  # so that the join has no aggregate below it and a hot pivot can be split
    left = scratch.save(named.join(several, "v").select("u", "v", "c", "linked", "near", "far"), "open")
    full = met(left.select("u", "v")).select("u", "v", "nu", "nv", F.array_except("su", "sv").alias("more"), F.array_except("sv", "su").alias("less"))
    block = left.withColumn("k", F.expr("pmod(xxhash64(u), if(linked, near, far))").cast("int"))
    far_far = F.transform(F.sequence(F.lit(0), F.col("far") - 1), lambda y: F.struct(F.lit(False).alias("mixed"), F.least("k", y).alias("x"), F.greatest("k", y).alias("y")))
    far_near = F.when(F.col("near") > 0, F.transform(F.sequence(F.lit(0), F.col("near") - 1), lambda y: F.struct(F.lit(True).alias("mixed"), F.col("k").alias("x"), y.alias("y"))))
    near_far = F.transform(F.sequence(F.lit(0), F.col("far") - 1), lambda x: F.struct(F.lit(True).alias("mixed"), x.alias("x"), F.col("k").alias("y")))
    empty = F.array().cast("array<struct<mixed:boolean,x:int,y:int>>")
    dealt = block.withColumn("t", F.explode(F.when(F.col("linked"), near_far).otherwise(F.concat(far_far, F.coalesce(far_near, empty)))))
    dealt = dealt.select("u", "v", "c", "linked", "k", "t.mixed", "t.x", "t.y")
    tiles = dealt.join(full, ["u", "v"]).groupBy("v", "mixed", "x", "y").applyInArrow(_tile(percent), "u long, v long")
    more = scratch.save(tiles, "more")
    if not more.isEmpty():
        scratch.drop(classes)
        classes = connected_components(links.unionAll(more), scratch)

    names = items.select("set_key", "item").join(classes.withColumnRenamed("node", "item"), "item", "left")
    names = names.select("set_key", F.coalesce("component", "item").alias("component_id"))
    rows = signed.select("doc_id", "n_shingles", "set_key").join(names, "set_key", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
