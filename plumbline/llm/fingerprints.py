"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, or of a long line 15 words and more up to the end of a sentence, 31 at most; its digest is a 64-bit hash. A sketch has
``3 * 8`` cells, each with the number of digests put into it and the XOR of them and of their check hashes; a digest
goes into one cell of each of three rows. Two versions' sketches subtract cell by cell, what they share cancels, and peeling
recovers the rest: a cell with one digest left names it, and taking it out of its other cells lays bare the next.

Where that fails, more differs than the cells hold, and a sketch two to eight times as large is tried: the digests fall
into parts by their next bits, each with a sketch of its own, and only the parts that fail are made larger again. So
the work follows the digests times the logarithm of what differs, and nothing is estimated.

Everything is built-in SQL functions within a row. The one shuffle of texts brings each document beside the next: keys are
cut into ranges at drawn keys, a document at a cut goes to both ranges, and a window in each range looks one row ahead.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.scratch import Scratch

#: Words of a paragraph before a sentence's end closes it, and how many may follow until one does; a line's end always closes it.
WORDS, MORE = 14, 16
PIECE = rf"(?:\S++[ \t\r]++){{0,{WORDS}}}(?:\S++(?<![.!?])[ \t\r]++){{0,{MORE}}}\S++"
#: Cells of each of a sketch's three rows (eight, as three bits choose one), rounds of peeling, larger sketches tried, and bits up to which
#: digests are told apart; digests of a part up to which it is cut in two, and in four.
ROW, PEELS, LARGER, BITS, IN_TWO, IN_FOUR = 8, 12, 20, 27, 32, 64
#: Rows of a range about, ranges at most, and keys drawn for each to cut at.
RANGE_ROWS, RANGES, DRAWN = 500, 16_384, 8
#: Copies of a row that one task writes.
CHUNK = 1000

_KEY = "struct<z:boolean,d:bigint,a:bigint,b:bigint>"
_ITEMS = "array<struct<x:bigint,y:bigint,z:bigint>>"
_BLOCK = f"struct<a:{_ITEMS},b:{_ITEMS},shift:int>"


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _all(*arrays: str) -> str:
    """SQL of arrays one after the other."""
    return f"flatten(array({', '.join(arrays)}))"


def _digit(bits: str, shift: str) -> str:
    """Three bits, which choose a cell of a row: a digest's own for the first row, two parts of its check for the others."""
    return f"shiftrightunsigned({bits}, {shift}) & 7L"


def digests(text: str) -> str:
    """SQL of the distinct paragraph digests of a text, each with its check and the check's upper part."""
    return rf"transform(array_distinct(transform(regexp_extract_all({text}, r'{PIECE}', 0), p -> xxhash64(p))), x -> named_struct('x', x, 'y', xxhash64(x, 1), 'z', shiftrightunsigned(xxhash64(x, 1), 31)))"


def sketch(items: str, shift: str = "0") -> str:
    """SQL of the cells of digests: arrays n, k and h of their number and of the XOR of them and of their checks, as long as three rows."""
    rows = [f"transform(sequence(0L, {ROW - 1}L), c -> filter({items}, e -> ({_digit(f'e.{bits}', shift)}) = c))" for bits in "xyz"]
    return _let("g", _all(*rows), (
        "named_struct('n', transform(g, m -> size(m)), 'k', transform(g, m -> aggregate(m, 0L, (s, e) -> s ^ e.x)), 'h', transform(g, m -> aggregate(m, 0L, (s, e) -> s ^ e.y)))"))


def _minus(one: str, other: str) -> str:
    xor = lambda c: f"zip_with({one}.{c}, {other}.{c}, (p, q) -> p ^ q)"
    return f"named_struct('n', zip_with({one}.n, {other}.n, (p, q) -> p - q), 'k', {xor('k')}, 'h', {xor('h')})"


def _peel(shift: str) -> str:
    """SQL of one round on s (n, k, h, lost, gained, go): the digests that cells with one digest name are taken out of all their cells."""
    cells, none = f"sequence(0, {3 * ROW - 1})", "cast(array() AS array<int>)"
    one = lambda n: f"array_distinct(transform(filter(lone, i -> s.n[i] = {n}), i -> s.k[i]))"
    row = lambda bits: f"transform(new, f -> cast({_digit(bits, shift)} AS int))"
    where = f"named_struct('j', sequence(0, size(new) - 1), 'y', transform(new, f -> xxhash64(f, 1)), 'x', {row('f')}, 'u', {row('xxhash64(f, 1)')}, 'v', {row('shiftrightunsigned(xxhash64(f, 1), 31)')})"
    # Which of the new digests lie in each cell; most cells have none.
    match = _all(*[f"transform(sequence(0, {ROW - 1}), c -> IF(array_contains(w.{r}, c), filter(w.j, j -> w.{r}[j] = c), {none}))" for r in "xuv"])
    cell = lambda c, less: f"transform(mine, (m, i) -> IF(size(m) = 0, s.{c}[i], aggregate(m, s.{c}[i], (t, j) -> t {less})))"
    taken = (
        f"named_struct('n', {cell('n', '- IF(j < size(plus), 1, -1)')}, 'k', {cell('k', '^ new[j]')}, 'h', {cell('h', '^ w.y[j]')}, "
        f"'lost', {_all('s.lost', 'plus')}, 'gained', {_all('s.gained', 'minus')}, 'go', true)")
    found = _let("plus", one(1), _let("minus", one(-1), _let("new", _all("plus", "minus"), _let("w", where, _let("mine", match, taken)))))
    stop = "named_struct('n', s.n, 'k', s.k, 'h', s.h, 'lost', s.lost, 'gained', s.gained, 'go', false)"
    return _let("lone", f"filter({cells}, i -> abs(s.n[i]) = 1 AND xxhash64(s.k[i], 1) = s.h[i])", f"IF(size(lone) = 0, {stop}, {found})")


def _attempt(cells: str) -> str:
    """SQL of peeling ``cells``, the difference of the sketches of a block o: the digests of its first version alone, of its second alone,
    and the smaller blocks to try if cells are left."""
    none = "cast(array() AS array<bigint>)"
    start = f"named_struct('n', {cells}.n, 'k', {cells}.k, 'h', {cells}.h, 'lost', {none}, 'gained', {none}, 'go', true)"
    peeled = f"aggregate(sequence(1, {PEELS}), {start}, (s, r) -> IF(s.go, {_peel('o.shift')}, s))"
    part = lambda side: f"filter(o.{side}, e -> (shiftrightunsigned(e.x, o.shift) & (parts - 1)) = c)"
    bits = f"IF(size(o.a) + size(o.b) <= {IN_TWO}, 1, IF(size(o.a) + size(o.b) <= {IN_FOUR}, 2, 3))"
    cut = f"filter(transform(sequence(0L, parts - 1), c -> named_struct('a', {part('a')}, 'b', {part('b')}, 'shift', o.shift + bits)), v -> size(v.a) + size(v.b) > 0)"
    smaller = f"IF(o.shift > {BITS}, array(o), {_let('bits', bits, _let('parts', 'shiftleft(1L, bits)', cut))})"
    zero = "forall(p.n, v -> v = 0) AND forall(p.k, v -> v = 0) AND forall(p.h, v -> v = 0)"
    return _let("p", peeled, (
        f"IF({zero}, named_struct('lost', p.lost, 'gained', p.gained, 'open', cast(array() AS array<{_BLOCK}>)), named_struct('lost', {none}, 'gained', {none}, 'open', {smaller}))"))


def difference(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """SQL of (lost, gained, open): the digests of version ``a`` that ``b`` lacks and the other way round, from their
    sketches; ``open`` are blocks that no sketch could settle, empty but for colliding hashes."""
    first = _let("cells", _minus(cells_a, cells_b), _attempt("cells"))
    two = f"named_struct('a', {sketch('o.a', 'o.shift')}, 'b', {sketch('o.b', 'o.shift')})"
    retry = _let("two", two, _let("cells", _minus("two.a", "two.b"), _attempt("cells")))
    step = _let("tried", f"transform(s.open, o -> {retry})", (
        "named_struct('lost', flatten(array(s.lost, flatten(transform(tried, t -> t.lost)))), 'gained', flatten(array(s.gained, flatten(transform(tried, t -> t.gained)))), 'open', flatten(transform(tried, t -> t.open)))"))
    start = _let("o", f"named_struct('a', {a}, 'b', {b}, 'shift', 0)", first)
    return f"aggregate(sequence(1, {LARGER}), {start}, (s, r) -> IF(size(s.open) = 0, s, {step}))"


def _settled(d: str) -> str:
    """SQL of the number of digests that one version alone has, blocks left open compared one by one; d names lost or gained."""
    side, other = ("a", "b") if d.endswith("lost") else ("b", "a")
    left = f"transform({d.split('.')[0]}.open, o -> size(array_except(o.{side}, o.{other})))"
    return f"(size({d}) + aggregate({left}, 0, (s, n) -> s + n))"


def written(cells: str, items: str) -> str:
    """SQL of a sketch as text: the number of digests, then each cell's number and XORs in hexadecimals, nothing for empty ones."""
    cell = f"IF({cells}.n[i] = 0, '', concat_ws(':', {cells}.n[i], hex({cells}.k[i]), hex({cells}.h[i])))"
    return f"concat(size({items}), '|', lower(array_join(transform(sequence(0, {3 * ROW - 1}), i -> {cell}), ',')))"


def likeness(a: str, d: str) -> str:
    """SQL of the share of the paragraphs of either version that both have; 1 where neither has any."""
    either = f"(size({a}) + {_settled(d + '.gained')})"
    return f"IF({either} = 0, 1D, (size({a}) - {_settled(d + '.lost')}) / cast({either} AS double))"


def _cuts(keys: DataFrame) -> list[list[dict]]:
    """Keys to cut at, first the smallest of all, in blocks of about the root of their number. At most RANGES * DRAWN keys come to the driver."""
    n, least = keys.agg(F.count(F.lit(1)), F.min("key")).first()
    ranges = min(RANGES, -(-n // RANGE_ROWS))
    drawn = keys.orderBy(F.xxhash64("key"), "key").limit(ranges * DRAWN).select("key").collect()
    cuts = [tuple(least)] + [k for k in sorted(tuple(r.key) for r in drawn)[DRAWN::DRAWN] if k > tuple(least)]
    width = math.isqrt(len(cuts) - 1) + 1
    return [[dict(zip("zdab", k, strict=True)) for k in cuts[at : at + width]] for at in range(0, len(cuts), width)]


def with_next(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """(key, text, copies, next_text): each distinct (doc_id, text) of ``docs``, how many rows have it, and the text of the one after it by
    doc_id, the first after the last; and whether any row has copies. ``key.d`` is the doc_id, null where ``key.z``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"))
    key = F.struct(F.col("id").isNull().alias("z"), F.coalesce("id", F.lit(0)).cast("long").alias("d"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), F.col("text")).alias("b"))
    rows = rows.select(key.alias("key"), "text")
    keys = scratch.save(rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies")), "keys")
    several = scratch.save(keys.where("copies > 1"), "several")
    copied = not several.isEmpty()
    if copied:  # rows without copies would pass through this unchanged
        salts = 32
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
        every = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        one = dealt.join(every, ["key", "salt"]).groupBy("key", "salt", "copies").agg(F.first("text").alias("text")).groupBy("key", "copies").agg(F.first("text").alias("text"))
        rows = rows.join(several, "key", "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(one)
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    if keys.isEmpty():
        return rows.withColumn("next_text", F.col("text")), False
    cuts = _cuts(keys)
    known, width, last = F.from_json(F.lit(json.dumps(cuts)), f"array<array<{_KEY}>>").alias("cuts"), len(cuts[0]), sum(map(len, cuts)) - 1
    rows = rows.select("*", known).withColumn("upper", F.expr("size(filter(cuts, c -> c[0] <= key))"))
    rows = rows.withColumn("lower", F.expr("size(filter(cuts[upper - 1], c -> c <= key))")).withColumn("at_cut", F.expr("cuts[upper - 1][lower - 1] = key"))
    rows = rows.withColumn("part", F.expr(f"(upper - 1) * {width} + lower - 1")).select("key", "text", "copies", "part", "at_cut")
    seats = f"IF(at_cut, array(named_struct('part', part, 'guest', false), named_struct('part', IF(part = 0, {last}, part - 1), 'guest', true)), array(named_struct('part', part, 'guest', false)))"
    rows = rows.select("key", "text", "copies", F.explode(F.expr(seats)).alias("seat")).select("key", "text", "copies", "seat.part", "seat.guest")
    ahead = F.lead("text").over(Window.partitionBy("part").orderBy("guest", "key"))
    return rows.withColumn("next_text", ahead).where("not guest").select("key", "text", "copies", "next_text"), copied


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of ``docs``.

    The edited text has the last half of its code points replaced by the first as many, or all, of the next
    document. Documents stand by doc_id, null ids last, those that share one by a hash of their texts; rows with the same doc_id and text
    are one document here, and each gets the same result. The last document's next is the first; one alone is
    its own. A null text is empty; a text without words has no paragraphs, and two such are wholly alike. Other
    columns are not read; an empty table gives an empty table.
    """
    scratch = Scratch(spark, "fingerprints")
    pairs, copied = with_next(spark, docs, scratch)
    half = "(length(text) div 2)"
    edited = f"concat(substring(text, 1, cast(length(text) - {half} AS int)), substring(next_text, 1, cast({half} AS int)))"
    texts = pairs.select(F.expr("IF(key.z, null, key.d)").alias("doc_id"), "copies", "text", "next_text", F.expr(edited).alias("edited"))
    items = texts.select(
        "doc_id", "copies", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        *[F.expr(digests(t)).alias(name) for t, name in (("text", "a"), ("edited", "e"), ("next_text", "b"))])
    cells = items.select("*", *[F.expr(sketch(name)).alias(f"cells_{name}") for name in "aeb"])
    found = cells.select("*", F.expr(difference("a", "e", "cells_a", "cells_e")).alias("to_edited"), F.expr(difference("a", "b", "cells_a", "cells_b")).alias("to_next"))
    out = found.select(
        "doc_id", "copies", "n_chars", "edited_sha256", F.expr(written("cells_a", "a")).alias("fingerprint"), F.expr(written("cells_e", "e")).alias("edited_fingerprint"),
        F.expr(likeness("a", "to_edited")).alias("near_edited"), F.expr(likeness("a", "to_next")).alias("near_next"))
    if not copied:
        return out.drop("copies")
    many = out.where("copies > 1").withColumn("chunk", F.explode(F.expr(f"sequence(0L, (copies - 1) div {CHUNK})"))).repartition("doc_id", "chunk")
    many = many.withColumn("copy", F.explode(F.expr(f"sequence(1L, least({CHUNK}L, copies - chunk * {CHUNK}))")))
    return out.where("copies = 1").drop("copies").unionByName(many.drop("copies", "chunk", "copy"))
