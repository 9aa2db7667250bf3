"""Cross-site line dedup: lines that occur on several distinct sites are boilerplate.

Lines are keyed by two 64-bit hashes of different seeds. Lines with fewer occurrences than the threshold cannot reach it and go first, by
a partial count. For the rest, HyperLogLog sketches of the sites merge by aggregation; where an estimate lies near
the threshold, the distinct sites are counted exactly. The first document (smallest doc_id) that has a boilerplate
line, with a source or without, keeps it, so a passage survives once; in all others the line is removed.

Everything is a built-in DataFrame operation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.scratch import Scratch

#: Relative error of a sketch at its setting (2^12 registers), and how many of it make an estimate sure.
LOG_SIZE, ERROR, SURE = 12, 0.0163, 5


def _lines(text: str | Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    """Two hashes of a line without the blanks around it; null for a blank line."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b")))


def boilerplate(spark: SparkSession, docs: DataFrame, *, sites: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """(line, n_sites, keeper) for the lines on at least ``sites`` distinct sites; line is the key, keeper the smallest doc_id with the line."""
    scratch = scratch or Scratch(spark, "lines")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("site"), F.explode(_lines(F.col("text").cast("string"))).alias("l"))
    rows = rows.select("doc_id", "site", _key(F.col("l")).alias("line")).where("line is not null").select("doc_id", "site", "line.a", "line.b")
    # Written, so that the join has no aggregate below it: a small table is broadcast by its size, a hot line of a large one is split.
    often = scratch.save(rows.groupBy("a", "b").agg(F.count("site").alias("n")).where(F.col("n") >= sites).select("a", "b"), "often")
    common = scratch.save(rows.join(often, ["a", "b"]), "common")
    sketches = common.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_SIZE))).alias("about"), F.min("doc_id").alias("keeper"))
    sketches = scratch.save(sketches, "sketches")
    band = max(1.0, SURE * ERROR * sites)
    near = sketches.where(F.abs(F.col("about") - sites) <= band).select("a", "b")
    exact = common.where("site is not null").join(near, ["a", "b"], "left_semi").select("a", "b", "site").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("sure"))
    spread = sketches.join(exact, ["a", "b"], "left").withColumn("n_sites", F.coalesce("sure", "about"))
    return spread.where(F.col("n_sites") >= sites).select(F.struct("a", "b").alias("line"), "n_sites", "keeper")


def dedup_lines(spark: SparkSession, docs: DataFrame, *, sites: int = 5) -> DataFrame:
    """All rows and columns of ``docs``, text without the lines that are boilerplate, and n_lines, n_removed.

    docs has doc_id, text and source, the site. A line is what "\\n" separates; blanks around it do not count, and
    blank lines are never removed. Rows without a source do not count as a site but lose boilerplate too, unless they
    are the first with it; so do rows whose doc_id is null, which are never the first. Rows that share a doc_id are
    treated alike, those with null ids each by its own text. A null text stays null and counts no lines. Clashing names of added columns are replaced. An empty
    table gives an empty table.
    """
    scratch = Scratch(spark, "lines")
    found = scratch.save(boilerplate(spark, docs, sites=sites, scratch=scratch), "boilerplate")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # Rows without an id are told apart by their texts, so that they are not one group.
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("__own")
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), own, F.explode(F.array_distinct(F.transform(_lines(F.col("text").cast("string")), _key))).alias("line"))
    drops = rows.where("line is not null").select("__id", "__own", "line.a", "line.b").join(found.select("line.a", "line.b", "keeper"), ["a", "b"]).where("not (keeper <=> __id)")
    drops = drops.groupBy("__id", "__own").agg(F.collect_set(F.struct("a", "b")).alias("__drop"))
    joined = docs.select(*names).join(drops, F.expr("cast(doc_id as long) <=> __id and if(doc_id is null, xxhash64(text), null) <=> __own"), "left")
    kept = F.filter(_lines("text"), lambda l: ~F.coalesce(F.array_contains("__drop", _key(l)), F.lit(False)))
    count = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(_lines("text"))).cast("long")
    touched = F.col("__drop").isNotNull()
    text = F.when(touched, F.array_join(kept, "\n")).otherwise(F.col("text").cast("string"))
    removed = F.when(touched, count - F.size(kept)).otherwise(F.lit(0)).cast("long")
    out = joined.select(*[F.col(f"`{n}`") for n in names if n != "text"], text.alias("text"), count.alias("n_lines"), removed.alias("n_removed"))
    return out.select(*[f"`{n}`" for n in names], "n_lines", "n_removed")


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, source, i, trim(line, ' ' || chr(9) || chr(13)) AS bare, line
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
b AS (SELECT bare, min(doc_id) AS keeper FROM l WHERE bare <> '' GROUP BY bare
      HAVING count(DISTINCT source) >= 5),
m AS (SELECT l.doc_id, l.i, l.line, b.bare IS NOT NULL AND b.keeper IS DISTINCT FROM l.doc_id AS gone
      FROM l LEFT JOIN b ON l.bare = b.bare)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE x.n END AS n_lines, x.g AS n_removed,
       sha256(coalesce(x.t, '')) AS text_sha256
FROM documents d JOIN (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS g, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS t
  FROM m GROUP BY doc_id) x ON d.doc_id = x.doc_id
"""
