"""The Merkle manifest against a plain tree, and on nulls, ties, repeated rows, single leaves and empty tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, level int, digest string, tree string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        start = i // 16 * 16
        out.append((level[start:i], level[i + 1 : start + 16]))
        i //= 16
    return out


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[source] = tree([leaf(*r) for r in own])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, source in enumerate(order):
        for i, r in enumerate(groups[source]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if hit else r[4]
            digest, steps = leaf(*r[:4], lowered), path(trees[source], i) + path(top, k)
            for left, right in steps:
                digest = sha("".join(left) + digest + "".join(right))
            proof = sha("".join("".join(left) + "".join(right) for left, right in steps))
            out.append((r[0], leaf(*r), trees[source][-1][0], top[-1][0], proof, digest, digest == top[-1][0]))
    return sorted(out, key=str)


def found(spark, rows):
    docs = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in merkle.manifest(spark, docs, merkle.lowered()).collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [16], [17, 1, 256], [257, 0, 5000]])
def test_manifest_against_a_plain_tree(spark, sizes):
    rng = random.Random(7)
    ids = rng.sample(range(10**6), sum(sizes))
    rows = [(ids.pop(), f"s{k}é", "en", 5, "Some Text é") for k, n in enumerate(sizes) for _ in range(n)]
    assert found(spark, rows) == plain(rows)


def test_many_sources(spark):
    rows = [(k, f"site{k % 300}", None, None, f"T{k}") for k in range(700)]
    assert found(spark, rows) == plain(rows)


def test_nulls_ties_and_repeats(spark):
    rows = [(None, None, None, None, None), (None, "", "a", 1, ""), (5, None, "-", 2, "ABC"), (5, None, "-", 2, "ABC"), (5, "a", "b", 3, "x"), (5, "a", "b", 3, "X"), (6, "ab", "", 0, "Y" * 100_000), (None, None, "q", None, "Z")]
    rows += [(9, "hot", "en", 1, "Same Row")] * 600 + [(None, "hot", "en", k, "Null Id") for k in range(40)]
    assert found(spark, rows) == plain(rows)


def test_a_task_that_overflows_and_blocks_of_several_heights(spark, monkeypatch):
    state = merkle._Combiner()
    for i in random.Random(3).sample(range(300), 300):
        state.add("t", 300, 0, i, sha(str(i)))
        if len(state.open) > 2:
            state.frontier()
    state.frontier()
    again = merkle._Combiner()
    done = [r for r in state.out if r[5] is not None]
    for tree_, size, level, i, digest, run in state.out:
        if run is None:
            again.add(tree_, size, level, i, digest)
    roots = [r[4] for r in done + again.out if r[2] == 3]
    assert roots == [tree([sha(str(i)) for i in range(300)])[-1][0]] and not again.open
    # RISE is read on the driver and in each task, so a tree of three levels takes three steps down and up.
    monkeypatch.setattr(merkle, "RISE", 1)
    monkeypatch.setattr(merkle, "_BLOCK", 16)
    leaves = spark.range(700).select(F.lit("=t").alias("tree"), F.lit(700).cast("long").alias("size"), F.col("id").alias("i"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    from plumbline.llm.scratch import Scratch

    scratch = Scratch(spark, "m")
    nodes = merkle._climb(leaves.repartition(4), scratch)
    want = tree([sha(str(i)) for i in range(700)])
    assert {(r.level, r.i): r.digest for r in nodes.collect()} == {(lv, i): d for lv, row in enumerate(want) if lv for i, d in enumerate(row)}
    root = nodes.where(merkle._is_root()).select("tree", "size", F.array().cast("array<string>").alias("path"), F.col("digest").alias("root"))
    paths = merkle._descend(root, nodes, merkle._height(nodes), scratch)
    got = {r.block: r.path for r in paths.collect()}
    assert sorted(got) == list(range(44))
    for i in (0, 20, 43):
        assert got[i] == [x for left, right in path(want[1:], i) for x in ("".join(left), "".join(right))]


def test_empty_table(spark):
    assert found(spark, [(1, "a", "b", 2, "c")]) != []
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(spark, docs, merkle.lowered()).collect() == []
