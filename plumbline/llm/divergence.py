"""Audit of how the sources of a language diverge in their terms.

A term is a run of letters and non-ASCII characters, A-Z lower-cased; a language keeps the terms that occur in at
least ``least`` of its documents. A group (language, source) and the language itself give every kept term a smoothed
share in units of 1e-9, ``1 + floor(1e9 * (count + 5) / (N + 5 V))``, in integers throughout.

Counting: each batch of documents is counted before anything is shuffled, so a hot source or term leaves a task as one
row a batch; a long text is taken in slices.

Pairs: a term that a group lacks has one share there, the group's baseline. The difference of two groups is that of
their baselines on all V terms, corrected for the terms that one of them has (from prefix sums over the group's
distinct shares, at the other's baseline) and for those that both have (a join of the non-zero cells, dealt into
tiles of at most ``TILE`` sources a side, aggregated before the shuffle). Absent terms are never written out.

Ranks: the ``top`` largest gaps of a group are found by radix selection. Distributed histograms over the value's bits,
high ones first, give each group the value of rank ``top``; where that value is shared by too many terms, histograms over their
UTF-8 bytes, in windows that double, say which of them come first. Only rows that stay are ranked by a window.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.scratch import Scratch

UNIT, PSEUDO = 1_000_000_000, 5
#: Sources a side of a tile of the join of common terms.
TILE = 512
#: Bytes of a text counted at a time, and distinct entries after which a task's counts go out.
SLICE, HELD = 1 << 22, 200_000
#: Bits of a value in one histogram; four of them hold every gap, which is below 2^31.
DIGIT, ROUNDS = 8, 4

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = "lang string, source string, term string, n long, d long"


def _slices(raw: bytes):
    """Folded slices of a text that end between terms."""
    at = 0
    while at < len(raw):
        part = raw[at : at + SLICE].translate(_FOLD)
        if at + SLICE < len(raw):
            cut = part.rfind(b" ")
            while cut < 0:  # a term longer than a slice
                more = raw[at + len(part) : at + len(part) + SLICE].translate(_FOLD)
                part += more
                cut = part.rfind(b" ") if more else len(part)
            part = part[:cut]
        at += max(len(part), 1)
        yield part


def _count(batches):
    """Occurrences and documents of each term by group, for the rows since the last flush; a null term says that the group occurs."""
    words: dict[tuple[str, str], Counter] = defaultdict(Counter)
    seen: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def flush():
        rows = [(*group, None, 0, 0) for group in seen]
        rows += [(*group, term.decode("utf-8", "replace"), n, seen[group][term]) for group, found in words.items() for term, n in found.items()]
        words.clear()
        seen.clear()
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "source", "term", "n", "d"])

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            for lang, source, raw in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2).cast(pa.large_binary()).to_pylist(), strict=True):
                group, inside = (lang, source), set()
                for part in _slices(raw):
                    found = part.split()
                    words[group].update(found)
                    inside.update(found)
                seen[group].update(inside)
            if sum(map(len, words.values())) >= HELD:
                yield flush()
    yield flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents of each term in each group; a null term for each group."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*text).mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _share(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """The smoothed share of a count, exact at any size; null without terms."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")
    top = ((wide(count) + PSEUDO) * F.lit(UNIT)).cast("decimal(38,0)")
    bottom = (wide(total) + wide(terms) * PSEUDO).cast("decimal(38,0)")
    return F.when(bottom > 0, F.call_function("div", top, bottom) + 1).cast("long")


class Audit:
    """The counts, groups and cells of one table, written once and shared by both parts."""

    def __init__(self, spark: SparkSession, docs: DataFrame, least: int = 30):
        self.scratch = scratch = Scratch(spark, "divergence")
        counts = scratch.save(term_counts(docs), "counts")
        kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("d").alias("in_docs")).where(F.col("in_docs") >= least)
        kept = scratch.save(kept.select("lang", "term", "lang_n"), "kept")
        cells = scratch.save(counts.join(kept, ["lang", "term"]), "cells")
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
        totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")])
        groups = groups.withColumn("base", F.coalesce(_share(F.lit(0), "total", "terms"), F.lit(0)))
        #: A group for each row: its total and baseline, its language's terms and total.
        self.groups = scratch.save(groups, "groups")
        tiles = self.groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
        tiled = self.groups.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
        #: The same with the tile that a source falls in and how many its language has.
        self.tiled = scratch.save(tiled, "tiled")
        shares = cells.join(self.tiled, ["lang", "source"]).select("lang", "source", "term", "tile", "tiles", "base", _share("n", "total", "terms").alias("p"), _share("lang_n", "lang_total", "terms").alias("q"))
        #: A row for each kept term that a group has: the group's share p, the language's q.
        self.cells = scratch.save(shares, "shares")

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): for each group and each other source of its language the sum of share differences."""
        mine = self.tiled.select("lang", "source", "base", "terms", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other_tile"))
        others = self.tiled.select("lang", F.col("source").alias("item"), F.col("base").alias("item_base"), F.col("tile").alias("other_tile"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
        pairs = self.scratch.save(mine.join(others, ["lang", "tile", "other_tile"]).where("source <> item").select("lang", "source", "item", "base", "item_base", "terms"), "pairs")
        # What a group's own terms change: the sum of abs(p - x) - abs(base - x) over them, at each other group's baseline x.
        values = self.cells.groupBy("lang", "source", "base", F.col("p").alias("x")).agg(F.count(F.lit(1)).alias("m"))
        marks = values.select("lang", "source", "base", "x", "m", F.lit(None).cast("string").alias("item"))
        asked = pairs.select("lang", "source", "base", F.col("item_base").alias("x"), F.lit(0).alias("m"), "item")
        line = Window.partitionBy("lang", "source")
        upto = line.orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        sums = marks.unionByName(asked).select(
            "lang", "source", "base", "x", "item", F.sum("m").over(upto).alias("low_m"), F.sum(F.col("m") * F.col("x")).over(upto).alias("low_s"),
            F.sum("m").over(line).alias("all_m"), F.sum(F.col("m") * F.col("x")).over(line).alias("all_s")).where("item is not null")
        own = sums.select("lang", "source", "item", F.expr("x * low_m - low_s + (all_s - low_s) - x * (all_m - low_m) - abs(base - x) * all_m").alias("own"))
        own = own.select("lang", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"), F.col("own").alias("part"))
        # What the terms of both change beyond that.
        left = self.cells.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("base").alias("ba"), "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other_tile"))
        right = self.cells.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("base").alias("bb"), F.col("tile").alias("other_tile"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
        both = left.join(right, ["lang", "term", "tile", "other_tile"]).where("a < b")
        both = both.groupBy("lang", "a", "b").agg(F.sum(F.expr("abs(pa - pb) - abs(pa - bb) - abs(pb - ba) + abs(ba - bb)")).alias("part"))
        changes = self.scratch.save(own.unionByName(both).groupBy("lang", "a", "b").agg(F.sum("part").alias("part")), "changes")
        named = pairs.select("*", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"))
        total = F.expr("terms * abs(base - item_base)") + F.coalesce("part", F.lit(0))
        return named.join(changes, ["lang", "a", "b"], "left").select("lang", "source", "item", total.alias("value"))

    def gaps(self) -> DataFrame:
        """(lang, source, item, value): for each group the terms that it has and uses more than its language, and by how much."""
        return self.cells.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("p - q").alias("value"))


def _pick(rows: DataFrame, digit: Column, larger_first: bool) -> DataFrame:
    """Of rows (lang, source, need, ...): for each group the digit in which the row of rank ``need`` lies and how many of
    that digit are needed; groups with fewer rows have none."""
    bins = rows.groupBy("lang", "source", digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
    order = F.col("digit").desc() if larger_first else F.col("digit")
    upto = F.sum("n").over(Window.partitionBy("lang", "source").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = bins.withColumn("upto", upto).where("upto >= need and upto - n < need")
    return found.select("lang", "source", "digit", F.expr("need - (upto - n)").alias("left"), "n")


def largest(rows: DataFrame, top: int, scratch: Scratch) -> DataFrame:
    """The ``top`` rows of each group of (lang, source, item, value): value descending, equal ones by the item's UTF-8
    bytes. Values are at least 0 and below 2^32; a group's items differ."""
    state = None
    for round_ in range(ROUNDS):
        shift = DIGIT * (ROUNDS - 1 - round_)
        digit = F.shiftright("value", shift)
        if state is None:
            near = rows.withColumn("need", F.lit(top).cast("long"))
        else:
            near = rows.join(state.withColumnRenamed("left", "need"), ["lang", "source"]).where(F.shiftright("value", shift + DIGIT) == F.col("high"))
        state = scratch.save(_pick(near, digit, True).select("lang", "source", F.col("digit").alias("high"), "left", "n"), f"bits{round_}")
    marked = rows.join(state.select("lang", "source", F.col("high").alias("least"), "left", "n"), ["lang", "source"], "left")
    columns = ["lang", "source", "item", "value"]
    kept = marked.where("least is null or value > least or (value = least and n = left)").select(*columns)
    open_ = scratch.save(marked.where("value = least and n > left").select(*columns, F.col("left").alias("need")), "ties")
    taken, start, width = [], 1, 8
    while not open_.isEmpty():
        digit = F.substring(F.col("item").cast("binary"), start, width)
        found = scratch.save(_pick(open_, digit, False), f"bytes{start}")
        tied = open_.join(found, ["lang", "source"]).withColumn("own", digit)
        taken.append(tied.where(F.expr("own < digit or (own = digit and n = left)")).select(*columns))
        open_ = scratch.save(tied.where("own = digit and n > left").select(*columns, F.col("left").alias("need")), "ties")
        start, width = start + width, 2 * width
    for more in taken:
        kept = kept.unionByName(more)
    return kept


def audit(spark: SparkSession, docs: DataFrame, *, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group of ``docs``: part ``pair`` ranks the other sources of its
    language by their difference, part ``term`` its ``top`` terms that it uses more than its language.

    A row is a document, whatever its doc_id; null text, lang and source are read as ''. A group without kept terms
    has pairs as others have, with counts of zero, and no terms; where a language keeps no terms all values are 0. A
    source that is alone in its language has no pairs. Other columns are not read; an empty table gives an empty one.
    """
    found = Audit(spark, docs, least)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    terms = largest(found.gaps(), top, found.scratch).select("lang", "source", F.lit("term").alias("part"), "item", "value", rank.alias("rank"))
    return found.pairs().select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank")).unionByName(terms)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
g AS (SELECT lang, source FROM d GROUP BY ALL),
c AS (SELECT t.lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(c)::HUGEINT AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
        1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(s.total, 0) + 5 * l.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM y)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
