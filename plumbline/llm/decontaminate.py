"""Benchmark decontamination by a prefix-filtered set join.

A window is ``width`` consecutive words of a benchmark item (a shorter item is one window). A window occurs in
a document only if all its word shingles do, so with shingles ordered by rarity over the corpus the first one,
the rarest, is a necessary prefix. Documents' shingles are joined with those prefixes only; a candidate's
position must leave room for the window before and after it (the length and positional bounds), and survivors
are confirmed on the bytes of every word of the window.

The benchmark, long items cut into overlapping segments, is broadcast in parts of bounded size, kept as flat
arrays; each part is one pass over the documents. Corpus statistics are counts for shingles of the part,
gathered over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.bytewords import ALNUM_WORDS, Words, buffers, column_words, lanes, same_spans, shingles, word_blocks
from plumbline.llm.scratch import Scratch

#: Bytes of benchmark text in a broadcast part and in a segment of an item, and words of a shingle.
PART_BYTES, SEGMENT_BYTES, SHINGLE = 16_000_000, 1_000_000, 3
_BITS, _ROWS = 22, 100_000


class Members:
    """Whether hashes are in a set: a bitmap of their top bits, then a search in order."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that are members, and which member each is."""
        if not len(self.hashes) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        hit = self.hashes[k] == h[at]
        return at[hit], k[hit]


def _expanded(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... (count[i] of them) for each i."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


class Windows:
    """Distinct windows of a benchmark part by their number of words, with the items that hold them.

    A window is the place of its first word in the part's words; nothing is kept a window but some numbers.
    """

    def __init__(self, items: list[str], texts: pa.Array, width: int):
        self.items = sorted(set(items))
        number = {i: k for k, i in enumerate(self.items)}
        raw, offsets = buffers(texts)
        blocks = list(word_blocks(raw, offsets, ALNUM_WORDS))
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        base = np.cumsum([0, *(len(b.low) for b in blocks)])
        self.low = joined([b.low for b in blocks], np.uint8)
        self.first = joined([b.first + at for b, at in zip(blocks, base, strict=False)], np.int64)
        self.size = joined([b.end - b.first for b in blocks], np.int64)
        self.hashes = joined([b.hashes for b in blocks], np.uint64)
        n = joined([np.diff(b.bounds) for b in blocks], np.int64)
        begin = np.cumsum(n) - n
        owner = np.array([number[i] for i in items], np.int64)
        self.start, self.owner_first, self.owner = {}, {}, {}
        for w in np.unique(np.minimum(n[n > 0], width)).tolist():
            rows = np.flatnonzero(np.minimum(n, width) == w)
            starts = _expanded(begin[rows], n[rows] - w + 1)
            of = np.repeat(owner[rows], n[rows] - w + 1)
            _, where, which = np.unique(shingles(self.hashes, w)[starts], return_index=True, return_inverse=True)
            pairs = np.unique(which * len(self.items) + of)
            self.start[w] = starts[where]
            self.owner[w] = pairs % len(self.items)
            self.owner_first[w] = np.searchsorted(pairs // len(self.items), np.arange(len(where) + 1))

    def tokens(self) -> dict[int, np.ndarray]:
        """By shingle length, the distinct shingles of all windows, in order."""
        out: dict[int, np.ndarray] = {}
        for w, start in self.start.items():
            q = min(SHINGLE, w)
            every, inside = shingles(self.hashes, q), np.zeros(len(self.hashes), bool)
            for place in range(w - q + 1):
                inside[start + place] = True
            out[q] = np.union1d(out.get(q, np.zeros(0, np.uint64)), every[np.flatnonzero(inside)])
        return out

    def prefixed(self, frequency: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, Members, np.ndarray, np.ndarray, np.ndarray]]:
        """For each window length: shingle length, prefix members, and by member its windows and places in them."""
        out = []
        for w, start in self.start.items():
            q = min(SHINGLE, w)
            every = shingles(self.hashes, q)
            known, times = frequency.get(q, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            place = np.zeros(len(start), np.int64)
            for lo in range(0, len(start), _ROWS):
                grid = every[start[lo : lo + _ROWS, None] + np.arange(w - q + 1)]
                rare = np.zeros(grid.shape, np.int64)
                if len(known):
                    k = np.minimum(np.searchsorted(known, grid), len(known) - 1)
                    rare = np.where(known[k] == grid, times[k], 0)
                place[lo : lo + _ROWS] = rare.argmin(axis=1)
            prefix = every[start + place]
            members = Members(prefix)
            of = np.searchsorted(members.hashes, prefix)
            order = np.argsort(of, kind="stable")
            out.append((w, q, members, np.searchsorted(of[order], np.arange(len(members.hashes) + 1)), order, place))
        return out


def _counts(tokens):
    """Documents that hold each benchmark shingle, summed over a partition."""

    def run(batches):
        sets = {q: Members(h) for q, h in tokens.value.items()}
        sums = {q: np.zeros(len(m.hashes), np.int64) for q, m in sets.items()}
        for batch in batches:
            for words in column_words(batch.column(0), ALNUM_WORDS):
                h, bounds = words.hashes, np.asarray(words.bounds, np.int64)
                for q, members in sets.items():
                    at, k = members.find(shingles(h, q))
                    doc = np.searchsorted(bounds, at, side="right") - 1
                    fits = at + q <= bounds[doc + 1]
                    pairs = np.unique(doc[fits] * len(members.hashes) + k[fits])
                    np.add.at(sums[q], pairs % max(len(members.hashes), 1), 1)
        for q, members in sets.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(members.hashes), q)), pa.array(members.hashes.view(np.int64)), pa.array(sums[q])], names=["q", "h", "n"])

    return run


class Finder:
    """Places in documents where windows of a part occur."""

    def __init__(self, windows: Windows, index: list):
        self.windows, self.index, self.lanes = windows, index, lanes(windows.low)

    def matches(self, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each window length, the places where windows occur, and which windows."""
        h, bounds, hashed, own, part = words.hashes, np.asarray(words.bounds, np.int64), {}, None, self.windows
        for w, q, members, first, order, place in self.index:
            if q not in hashed:
                hashed[q] = shingles(h, q)
            at, k = members.find(hashed[q])
            n = first[k + 1] - first[k]
            window = order[_expanded(first[k], n)]
            at = np.repeat(at, n)
            doc = np.searchsorted(bounds, at, side="right") - 1
            start = at - place[window]
            fits = (start >= bounds[doc]) & (start + w <= bounds[doc + 1])
            start, window = start[fits], window[fits]
            for j in range(w):
                same = h[start + j] == part.hashes[part.start[w][window] + j]
                start, window = start[same], window[same]
            if len(start):
                own = lanes(words.low) if own is None else own
                here = (start[:, None] + np.arange(w)).ravel()
                there = (part.start[w][window][:, None] + np.arange(w)).ravel()
                same = same_spans(own, words.first[here], words.end[here] - words.first[here], self.lanes, part.first[there], part.size[there])
                same = same.reshape(-1, w).all(axis=1)
                start, window = start[same], window[same]
            yield w, start, window

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are hit, and the distinct (row of the block, item) pairs, in order."""
        bounds, part = np.asarray(words.bounds, np.int64), self.windows
        change = np.zeros(len(words.hashes) + 1, np.int64)
        held = [np.zeros(0, np.int64)]
        for w, start, window in self.matches(words):
            np.add.at(change, start, 1)
            np.add.at(change, start + w, -1)
            doc = np.searchsorted(bounds, start, side="right") - 1
            pairs = np.unique(doc * len(part.start[w]) + window)
            doc, window = np.divmod(pairs, max(len(part.start[w]), 1))
            n = part.owner_first[w][window + 1] - part.owner_first[w][window]
            held.append(np.repeat(doc, n) * len(part.items) + part.owner[w][_expanded(part.owner_first[w][window], n)])
        doc, item = np.divmod(np.unique(np.concatenate(held)), max(len(part.items), 1))
        return np.cumsum(change)[:-1] > 0, doc, item


_FINDERS: list[tuple[object, Finder]] = []


def _finder(shared) -> Finder:
    """The worker's own finder for a broadcast part."""
    value = shared.value
    if not _FINDERS or _FINDERS[0][0] is not value:
        _FINDERS[:] = [(value, Finder(*value))]
    return _FINDERS[0][1]


_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64())])
_HITS = "doc_id long, text_key string, n_words long, n_hit long, items array<string>, spans array<struct<first:long,last:long>>"


def _marker(shared, with_key: bool):
    def run(batches):
        finder = _finder(shared)
        names = pa.array(finder.windows.items, pa.string())
        for batch in batches:
            n_words, n_hit, item_sizes, items, span_sizes, firsts, lasts = ([np.zeros(0, np.int64)] for _ in range(7))
            for words in column_words(batch.column(1), ALNUM_WORDS):
                bounds = np.asarray(words.bounds, np.int64)
                hit, doc, item = finder.hits(words)
                total = np.concatenate(([0], np.cumsum(hit)))
                n_words.append(np.diff(bounds))
                n_hit.append(total[bounds[1:]] - total[bounds[:-1]])
                item_sizes.append(np.bincount(doc, minlength=words.end_row - words.row))
                items.append(item)
                edge = np.zeros(len(hit) + 1, bool)
                edge[bounds] = True
                past, ahead = np.concatenate(([False], hit[:-1])), np.concatenate((hit[1:], [False]))
                first = np.flatnonzero(hit & (~past | edge[:-1])) if len(hit) else np.zeros(0, np.int64)
                last = np.flatnonzero(hit & (~ahead | edge[1:])) if len(hit) else np.zeros(0, np.int64)
                row = np.searchsorted(bounds, first, side="right") - 1
                span_sizes.append(np.bincount(row, minlength=words.end_row - words.row))
                firsts.append(first - bounds[row])
                lasts.append(last - bounds[row])
            n_words, n_hit, item_sizes, items, span_sizes, firsts, lasts = map(np.concatenate, (n_words, n_hit, item_sizes, items, span_sizes, firsts, lasts))
            listed = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)
            key = batch.column(2) if with_key else pa.nulls(batch.num_rows, pa.string())
            spans = pa.StructArray.from_arrays([pa.array(firsts), pa.array(lasts)], fields=list(_SPAN))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), key, pa.array(n_words), pa.array(n_hit), listed(item_sizes, names.take(pa.array(items))), listed(span_sizes, spans)],
                names=["doc_id", "text_key", "n_words", "n_hit", "items", "spans"])

    return run


def _keeper(shared, place: int):
    """Rows without a hit."""

    def run(batches):
        finder = _finder(shared)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for words in column_words(batch.column(place), ALNUM_WORDS):
                clean[words.row + finder.hits(words)[1]] = False
            yield batch.filter(pa.array(clean))

    return run


def _segmenter(width: int):
    """Texts beyond a segment's bytes as segments that share width - 1 words, so that each window is in one."""

    def run(batches):
        for batch in batches:
            items, texts = [], []
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                item = one.column(0)[0].as_py()
                raw, offsets = buffers(one.column(1))
                if len(raw) <= SEGMENT_BYTES:
                    items.append(item)
                    texts.append(one.column(1)[0].as_py())
                    continue
                for words in word_blocks(raw, offsets, ALNUM_WORDS):
                    n, a = len(words.hashes), 0
                    while a < n:
                        b = max(min(a + width, n), int(np.searchsorted(words.end, words.first[a] + SEGMENT_BYTES, side="right")))
                        items.append(item)
                        texts.append(words.low[words.first[a] : words.end[b - 1]].tobytes().decode())
                        a = n if b >= n else b - width + 1
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.string())], names=["item", "text"])

    return run


def _parts(spark: SparkSession, texts: DataFrame, benchmark: DataFrame, width: int, part_bytes: int) -> Iterator[tuple[int, object]]:
    """(number of parts, broadcast windows and index) for each part of the benchmark; texts is the corpus counted."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null")
    bench = bench.mapInArrow(_segmenter(width), "item string, text string")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("b")).first()["b"]
    parts = max(1, -(-size // part_bytes))
    for part in range(parts):
        rows = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).toArrow()
        windows = Windows(rows.column("item").to_pylist(), rows.column("text").combine_chunks(), width)
        tokens = spark.sparkContext.broadcast(windows.tokens())
        sums = texts.mapInArrow(_counts(tokens), "q long, h long, n long").groupBy("q", "h").agg(F.sum("n").alias("n")).toArrow()
        q, h, n = (np.asarray(sums.column(c).combine_chunks(), np.int64) for c in ("q", "h", "n"))
        frequency = {}
        for k in np.unique(q).tolist():
            of = h[q == k].view(np.uint64)
            order = np.argsort(of)
            frequency[k] = (of[order], n[q == k][order])
        yield parts, spark.sparkContext.broadcast((windows, windows.prefixed(frequency)))


def uncontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, width: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns.

    Rows are judged by their own text only, so null and repeated doc_ids are rows like others. What a window is, and
    nulls and empty tables, are as in contamination().
    """
    out = docs.withColumn("text", F.col("text").cast("string"))
    for _, shared in _parts(spark, out.select("text"), benchmark, width, part_bytes):
        out = out.mapInArrow(_keeper(shared, out.columns.index("text")), out.schema)
    return out


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, width: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (sorted ids, as strings), spans of hit words.

    Words are runs of 0-9, a-z and non-ASCII characters, A-Z lower-cased. A word is hit if it lies in an occurrence
    of a window. Null texts have no words; benchmark rows without words or with a null item_id match nothing; rows
    that repeat an item_id add their windows to it. Repeated documents repeat in the result; a null doc_id stays
    null; other columns are not read; an empty table on either side gives no hits.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed, passes, scratch = base.withColumn("text_key", F.sha2("text", 256)), [], None
    for parts, shared in _parts(spark, base.select("text"), benchmark, width, part_bytes):
        if parts == 1:
            return base.mapInArrow(_marker(shared, False), _HITS).drop("text_key")
        scratch = scratch or Scratch(spark, "decontaminate")
        found = keyed.mapInArrow(_marker(shared, True), _HITS)
        passes.append(scratch.save(found.where("n_hit > 0") if passes else found, "hits"))
    hits = passes[0].where("n_hit > 0")
    for one in passes[1:]:
        hits = hits.unionAll(one)
    # Repeated rows have the same hits in a part, so one of them stands for all.
    hits = hits.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("every"))
    merged = F.expr("""aggregate(every, cast(array() as array<struct<first:long,last:long>>), (acc, x) ->
        if(size(acc) > 0 and x.first <= acc[size(acc) - 1].last + 1,
           concat(slice(acc, 1, size(acc) - 1), array(struct(acc[size(acc) - 1].first as first, greatest(acc[size(acc) - 1].last, x.last) as last))),
           concat(acc, array(x))))""")
    hits = hits.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "items", merged.alias("spans"))
    out = passes[0].select("doc_id", "text_key", "n_words").join(hits, F.expr("doc_id <=> d and text_key <=> k"), "left")
    empty = F.expr("cast(array() as array<string>)")
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<first:long,last:long>>)"))
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x.last - x.first + 1)
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", empty).alias("items"), spans.alias("spans"))
