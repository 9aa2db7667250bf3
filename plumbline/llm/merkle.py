"""Merkle manifest of a table: a digest tree for each source, one over the sources, and a proof for each row.

A leaf is the digest of a row's fields; every ``ARITY`` consecutive nodes of a level become their digest until one
remains. A node's place says which parent it has, and the size of its group how many children that parent waits for,
so nodes can come in any order: a task collects the indexed digests of a parent's children until they are complete,
emits the run, and goes on with the parent. What stays incomplete, at the edges of a task's rows, is the frontier. It is dealt
anew by blocks of ``ARITY ** RISE`` times as many leaves and combined by the same code, until nothing is left, so that a
group of any size takes as many rounds as its height divided by ``RISE`` and no task more than a block.

A completed run links its children back to their parent. Going down by blocks again, a node's path (what stands left and
right of it in its run, level by level up to the root) is that of the node above, put behind its own. Leaves meet the
path of their block last, in tasks of at most ``ARITY ** RISE`` leaves, and are hashed there; no leaf's path is stored.

The places of rows come from one sort by range and the counts of its partitions. Everything that is used twice is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.scratch import Scratch

ARITY, RISE = 16, 3
#: Levels' sizes in leaves, as powers of two.
_BITS = 4
_BLOCK = ARITY**RISE
#: Incomplete parents that a task holds before they go to the frontier.
HELD = 100_000

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "tree string, size long, level int, i long, digest string, run array<string>"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: str | Column = "text") -> Column:
    """The digest of a row's fields, with ``text`` as its text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.concat(*[_field(F.col(c)) for c in FIELDS[:-1]], _field(text)), 256)


def sizes(size: int) -> list[int]:
    """Nodes of each level of a tree, from its leaves to its root."""
    out = [size]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def _placed(rows: DataFrame, tree: str, order: list[str], scratch: Scratch) -> DataFrame:
    """rows with ``i``, the place in its tree by ``order``, and ``size``, the tree's leaves.

    A sort by range deals the rows; a last key that no two rows share splits equal ones. A row's place is its number in its
    partition, less that of its tree's first row there, plus the tree's rows in earlier partitions.
    """
    unique = rows.withColumn("__u", F.xxhash64(F.monotonically_increasing_id()))
    dealt = unique.repartitionByRange(tree, *order, "__u").sortWithinPartitions(tree, *order, "__u").drop("__u")
    dealt = scratch.save(dealt.withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", 33).alias("__part")
    counts = dealt.groupBy(tree, part).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__from"))
    before = Window.partitionBy(tree).orderBy("__part")
    offsets = counts.select(
        F.col(tree).alias("__tree"), "__part", (F.coalesce(F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("__from")).alias("__shift"),
        F.sum("__n").over(Window.partitionBy(tree)).alias("size"))
    offsets = scratch.save(offsets, "offsets")
    joined = dealt.withColumn("__part", part).join(offsets.withColumnRenamed("__part", "__p"), F.expr(f"`{tree}` <=> __tree and __part = __p"))
    return joined.select(*rows.columns, (F.col("__at") + F.col("__shift")).alias("i"), "size")


class _Combiner:
    """Partial parents of one task: indexed child digests until the arity that the tree's size gives is met."""

    def __init__(self):
        self.open: dict[tuple, dict[int, str]] = {}
        self.out: list[tuple] = []
        self.heights: dict[int, list[int]] = {}

    def add(self, tree: str, size: int, level: int, i: int, digest: str) -> None:
        if size not in self.heights:
            if len(self.heights) > 10_000:
                self.heights.clear()
            self.heights[size] = sizes(size)
        nodes = self.heights[size]
        while level < len(nodes) - 1:
            parent = i // ARITY
            arity = min(ARITY, nodes[level] - parent * ARITY)
            key = (tree, size, level, parent)
            children = self.open.setdefault(key, {})
            children[i % ARITY] = digest
            if len(children) < arity:
                return
            del self.open[key]
            run = [children[k] for k in range(arity)]
            level, i, digest = level + 1, parent, _sha("".join(run))
            self.out.append((tree, size, level, i, digest, run))
        if level == 0:
            self.out.append((tree, size, 0, 0, digest, []))

    def frontier(self) -> None:
        for (tree, size, level, parent), children in self.open.items():
            self.out += [(tree, size, level, parent * ARITY + k, digest, None) for k, digest in children.items()]
        self.open.clear()


def _combine(batches) -> Iterator[pa.RecordBatch]:
    """Completed nodes with their runs, and the frontier, whose runs are null, of a task's nodes (tree, size, level, i, digest)."""
    state = _Combiner()
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()))
    names = ["tree", "size", "level", "i", "digest", "run"]

    def flush():
        columns = list(zip(*state.out, strict=True)) if state.out else [[]] * len(names)
        state.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            state.add(*row)
            if len(state.open) > HELD:
                state.frontier()
        yield flush()
    state.frontier()
    yield flush()


def _climb(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """Every node above the leaves (tree, size, level, i, digest, run) of leaves(tree, size, i, digest); a tree of one leaf
    has that leaf, without a run, at level 0."""
    waiting = leaves.select("tree", "size", F.lit(0).alias("level"), "i", "digest")
    done, rise = [], 0
    while True:
        made = scratch.save(waiting.mapInArrow(_combine, _NODES), f"nodes{rise}")
        done.append(made.where("run is not null"))
        frontier = made.where("run is null").drop("run")
        if frontier.isEmpty():
            break
        rise += RISE
        block = F.expr(f"shiftright(i, greatest(0, {_BITS} * ({rise} - level)))")
        waiting = frontier.withColumn("block", block).repartition("tree", "block").drop("block")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return scratch.save(out, "nodes")


def _paths(digests: dict[tuple[int, int], list[str]], nodes: list[int], low: int, high: int, i: int) -> list[str]:
    """What stands left and right of node i of level ``low`` in its run, and so on up to level ``high``."""
    out = []
    for level in range(low, min(high, len(nodes) - 1)):
        run, k = digests[level + 1, i // ARITY], i % ARITY
        out += ["".join(run[:k]), "".join(run[k + 1 :])]
        i //= ARITY
    return out


def _descend(roots: DataFrame, nodes: DataFrame, height: int, scratch: Scratch) -> DataFrame:
    """The path of each block's top node: (tree, block, path, and the other columns of ``roots``), for blocks of
    ``ARITY ** RISE`` leaves; roots(tree, size, path, ...) has the path that follows each root.

    Goes down from the roots, a block's height at a time; each step joins paths with the runs of their block.
    """
    extra = [c for c in roots.columns if c not in ("tree", "size", "path")]
    steps = max(1, -(-height // RISE))
    paths = roots.select("*", F.lit(0).cast("long").alias("block"))
    for step in range(steps - 1, 0, -1):
        low, high = RISE * step, RISE * (step + 1)
        runs = nodes.where(F.col("level").between(low + 1, high) & (F.size("run") > 0))
        runs = runs.select("tree", F.expr(f"shiftright(i, {_BITS} * ({high} - level))").alias("block"), F.struct("level", "i", "run").alias("node"))
        inside = runs.groupBy("tree", "block").agg(F.collect_list("node").alias("nodes"))  # at most 273 runs
        joined = paths.join(inside, ["tree", "block"], "left")
        schema = ", ".join(["tree string, size long, path array<string>", *[f"{c} string" for c in extra], "block long"])
        paths = scratch.save(joined.select("tree", "size", "path", *extra, "block", "nodes").mapInArrow(_lower(low, high), schema), f"paths{low}")
    return paths


def _lower(low: int, high: int):
    def run(batches):
        for whole in batches:
            for at in range(whole.num_rows):
                batch = whole.slice(at, 1)
                out: list[list] = [[] for _ in range(batch.num_columns - 1)]
                for tree, size, path, *extra, block, inside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    nodes = sizes(size)
                    if low >= len(nodes) - 1:  # the root lies in the blocks below
                        found = [(path, block)]
                    else:
                        digests = {(n["level"], n["i"]): n["run"] for n in inside}
                        width = ARITY ** (high - low)
                        found = [(_paths(digests, nodes, low, high, i) + path, i) for i in range(block * width, min((block + 1) * width, nodes[low]))]
                    for p, i in found:
                        for column, value in zip(out, (tree, size, p, *extra, i), strict=True):
                            column.append(value)
                kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), *[pa.string()] * (len(out) - 4), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=batch.schema.names[:-1])

    return run


def _prove(ids: list[str], keep_path: bool):
    """For a block its leaves (i, digest, tampered and ids) and the one row with its path."""

    def run(leaves: pa.Table, paths: pa.Table) -> pa.Table:
        above = paths.to_pylist()[0]
        table = leaves.sort_by("i")
        size, block, first = above["size"], above["block"], above["block"] * _BLOCK
        nodes, digests = sizes(size), {}
        level, row = 0, table.column("digest").to_pylist()
        while level < min(RISE, len(nodes) - 1):
            runs = [row[k : k + ARITY] for k in range(0, len(row), ARITY)]
            start = first >> _BITS * (level + 1)
            digests.update({(level + 1, start + k): r for k, r in enumerate(runs)})
            row, level = [_sha("".join(r)) for r in runs], level + 1
        path_of = lambda i: _paths(digests, nodes, 0, RISE, i) + above["path"]
        columns, digest_of = [table.column(c) for c in ids], table.column("digest")
        if keep_path:
            paths_out = pa.array([path_of(i) for i in table.column("i").to_pylist()], pa.list_(pa.string()))
            return pa.table([*columns, digest_of, pa.array([above["root"]] * table.num_rows, pa.string()), paths_out], names=[*ids, "digest", "root", "path"])
        proofs, folded = [], []
        for i, digest in zip(table.column("i").to_pylist(), table.column("tampered").to_pylist(), strict=True):
            path = path_of(i)
            proofs.append(_sha("".join(path)))
            for k in range(0, len(path), 2):
                digest = _sha(path[k] + digest + path[k + 1])
            folded.append(digest)
        n = table.num_rows
        out = [*columns, digest_of, *[pa.array([above[c]] * n, pa.string()) for c in ("subroot", "root")], pa.array(proofs, pa.string()), pa.array(folded, pa.string())]
        return pa.table(out, names=[*ids, "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    return run


def _proofs(leaves: DataFrame, paths: DataFrame, ids: list[str], kinds: str, *, keep_path: bool) -> DataFrame:
    block = leaves.withColumn("block", F.shiftright("i", _BITS * RISE))
    out = kinds + (", digest string, root string, path array<string>" if keep_path else ", leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return block.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(_prove(ids, keep_path), out)


def _height(nodes: DataFrame) -> int:
    return nodes.agg(F.max("level")).first()[0] or 0


def manifest(spark: SparkSession, docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``docs``.

    ``tampered`` is the text that a row has when its proof is checked: the leaf of the row with that text is folded with the
    proof's siblings. Rows stand by doc_id, nulls first, those that share one by their leaves. A null source is a source of its own, first of all.
    Null fields count as ``-``; a row alone in its source is its subroot, and a source alone is the root, with an
    empty proof. Other columns are not read; an empty table gives an empty table.
    """
    scratch = Scratch(spark, "merkle")
    fields = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang")], F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"), tampered.cast("string").alias("__other"))
    # The tree's name tells a null source from any text and keeps the order of sources.
    named = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source")).alias("tree")
    rows = scratch.save(fields.select(named, "doc_id", leaf().alias("digest"), leaf("__other").alias("tampered")), "digests")
    leaves = scratch.save(_placed(rows, "tree", ["doc_id", "digest"], scratch), "leaves")
    nodes = _climb(leaves, scratch)
    tops = scratch.save(nodes.where(_is_root()).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("size").alias("rows"), "digest"), "subroots")
    top_leaves = scratch.save(_placed(tops, "tree", ["name"], scratch), "tops")
    top_nodes = _climb(top_leaves, scratch)
    root = top_nodes.where(_is_root()).select("tree", "size", F.array().cast("array<string>").alias("path"), F.col("digest").alias("root"))
    above = _descend(root, top_nodes, _height(top_nodes), scratch)
    subroots = _proofs(top_leaves, above, ["name", "rows"], "name string, rows long", keep_path=True)
    start = subroots.select(F.col("name").alias("tree"), F.col("rows").alias("size"), "path", F.col("digest").alias("subroot"), "root")
    paths = _descend(scratch.save(start, "starts"), nodes, _height(nodes), scratch)
    out = _proofs(leaves, paths, ["doc_id"], "doc_id long", keep_path=False)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _is_root() -> Column:
    """Whether a completed node is its tree's last: the only one of its level."""
    power = F.expr(f"shiftleft(1L, {_BITS} * level)")
    return F.col("size") <= power


def lowered() -> Column:
    """Of the rows whose doc_id has a crc32 that 5 divides the text with A-Z lower-cased, of others the text."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))


def _sql_field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


_HEAD = " || ".join(_sql_field(c) for c in FIELDS[:-1])
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# crc32 bit by bit: each byte of the decimal id comes in with the first of eight shifts.
_STEP = "xor(a, x) // 2, (xor(a, x) % 2) * 3988292384"
_CRC = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor({_STEP})))"""

ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, sha256({_HEAD} || {_sql_field('text')}) AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN sha256({_HEAD} || {_sql_field(_LOWER)}) ELSE sha256({_HEAD} || {_sql_field('text')}) END AS bad FROM documents),
i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
u(source, level, nodes) AS (
  SELECT source, 0, list(leaf ORDER BY pos) FROM i GROUP BY source
  UNION ALL SELECT source, level + 1, list_transform(range(0, len(nodes), 16), lambda k: sha256(array_to_string(nodes[k + 1:k + 16], ''))) FROM u WHERE len(nodes) > 1),
s AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM u WHERE len(nodes) = 1),
v(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY pos) FROM s
  UNION ALL SELECT level + 1, list_transform(range(0, len(nodes), 16), lambda k: sha256(array_to_string(nodes[k + 1:k + 16], ''))) FROM v WHERE len(nodes) > 1),
runs AS (
  SELECT source, level, nodes FROM u WHERE len(nodes) > 1
  UNION ALL SELECT s.source, top + v.level, v.nodes FROM v, s JOIN (SELECT source, max(level) AS top FROM u GROUP BY source) h ON s.source IS NOT DISTINCT FROM h.source WHERE len(v.nodes) > 1),
p AS (SELECT source, pos AS top_pos, subroot, (SELECT max(level) FROM u WHERE u.source IS NOT DISTINCT FROM s.source) AS top FROM s),
w(doc_id, source, leaf, row_pos, level, pos, proof, folded) AS (
  SELECT doc_id, source, leaf, pos, 0, pos, '', bad FROM i
  UNION ALL
  SELECT w.doc_id, w.source, leaf, row_pos, w.level + 1, x // 16,
    proof || array_to_string(nodes[x // 16 * 16 + 1:x], '') || array_to_string(nodes[x + 2:x // 16 * 16 + 16], ''),
    sha256(array_to_string(nodes[x // 16 * 16 + 1:x], '') || folded || array_to_string(nodes[x + 2:x // 16 * 16 + 16], ''))
  FROM (SELECT w.*, CASE WHEN w.level = p.top THEN p.top_pos ELSE w.pos END AS x FROM w JOIN p ON w.source IS NOT DISTINCT FROM p.source) w
  JOIN runs ON w.source IS NOT DISTINCT FROM runs.source AND w.level = runs.level),
e AS (SELECT *, row_number() OVER (PARTITION BY source, row_pos ORDER BY level DESC) AS last FROM w)
SELECT doc_id, leaf, subroot, r.root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.root AS verified
FROM e JOIN p ON e.source IS NOT DISTINCT FROM p.source, (SELECT nodes[1] AS root FROM v WHERE len(nodes) = 1) r WHERE last = 1
"""
