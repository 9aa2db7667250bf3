"""Toxicity scores from averaged subword embeddings and a linear softmax.

A word is the bag of its character n-grams and itself, each hashed to an embedding; a bag of consecutive words
is the mean of its words. A text is the weighted average of its bags, all of them, which a linear softmax gives a
class; a bag's weight grows with its own logit (exp(``FOCUS`` * logit)), so a few words count in a long text.
Embeddings and softmax are trained jointly in numpy on the driver, on a bounded sample of labelled rows (``max_toxic``
and ``max_clean`` rows, the first by a hash of doc_id, without texts above ``max_bytes``). Each epoch draws ``draws``
bags of a text by their weights, an estimate of the average in which every bag can come. A misspelt or inflected word
shares most n-grams with the word it comes from and so lies near it.

With the model fixed a bag's logit is linear in its words, so scoring needs one number for each embedding: a table of
fixed size, which is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plumbline.llm.bytewords import mix, span_hashes
from plumbline.llm.charclass import LETTER, NUMBER, classes

#: Embeddings, their size, words of a bag, and lengths of n-grams.
BUCKETS, SIZE, BAG, GRAMS = 1 << 18, 8, 16, (3, 4, 5, 6)
#: How much a bag's logit counts in its weight.
FOCUS = 10.0
#: Characters taken at once in training, and in scoring, where workers of other stages lie beside.
_BLOCK, _SCORED = 500_000, 150_000
_OPEN, _CLOSE = 0x110000, 0x110001


def held_out(doc_id="doc_id"):
    """Rows that no label is learned from: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of texts, first and end of each word, and n + 1 word offsets by text."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    kind = classes()[points]
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = (kind == LETTER) | (kind == NUMBER)
    cuts = np.zeros(len(points) + 1, bool)
    cuts[bounds] = True
    first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cuts[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cuts[1:])) + 1
    return points, first, end, np.searchsorted(first, bounds)


def distinct_words(points: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of distinct words, and for each word which of them it is."""
    _, where, which = np.unique(_hashes(points, first, end), return_index=True, return_inverse=True)
    return where, which


def _hashes(points: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the code points of each span."""
    return span_hashes(points.view(np.uint8), 4 * first, 4 * end)


def subwords(points: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each n-gram of the words with marked ends, and of the words themselves."""
    n = end - first
    size = n + 2
    stop = np.cumsum(size)
    start = stop - size
    flat = np.empty(int(stop[-1]) if len(stop) else 0, np.uint64)
    inner = np.ones(len(flat), bool)
    inner[start] = inner[stop - 1] = False
    flat[start], flat[stop - 1] = _OPEN, _CLOSE
    flat[inner] = points[np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
    owner = np.repeat(np.arange(len(n)), size)
    words, buckets = [np.arange(len(n))], [_hashes(flat.astype(np.uint32), start, stop)]
    for g in GRAMS:
        at = np.flatnonzero(np.arange(len(flat)) + g <= stop[owner])
        h = np.full(len(at), g, np.uint64)
        for j in range(g):
            h = (h + flat[at + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        words.append(owner[at])
        buckets.append(mix(h))
    return np.concatenate(words), (np.concatenate(buckets) >> np.uint64(46)).astype(np.int64)


@dataclass
class Model:
    """One number an embedding, the bias, the share of toxic training rows (the score of a text without words), and
    the slope and offset that calibrate a text's logit."""

    weight: np.ndarray
    bias: float
    base: float
    slope: float = 1.0
    offset: float = 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        points, first, end, bounds = words_of(texts)
        out = np.full(len(texts), self.base)
        if not len(first):
            return out
        where, which = distinct_words(points, first, end)
        word, bucket = subwords(points, first[where], end[where])
        count = np.bincount(word, minlength=len(where))
        value = np.bincount(word, weights=self.weight[bucket], minlength=len(where)) / count
        starts, doc = bags(bounds)
        sums = np.add.reduceat(value[which], starts)
        logit = sums / np.diff(np.append(starts, len(first))) + self.bias
        average = averaged(logit, doc, len(texts))
        some = np.isfinite(average)
        out[some] = 1 / (1 + np.exp(-np.clip(self.slope * average[some] + self.offset, -40, 40)))
        return out


def averaged(logit: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Logit of each text: that of the weighted average of its bags; minus infinity without bags."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, doc, logit)
    weight = np.exp(FOCUS * (logit - top[doc]))
    total = np.bincount(doc, weights=weight, minlength=n)
    return np.where(total > 0, np.bincount(doc, weights=weight * logit, minlength=n) / np.maximum(total, 1e-300), -np.inf)


def bags(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the bags of all texts, and the text of each bag."""
    n = -(-np.diff(bounds) // BAG)
    doc = np.repeat(np.arange(len(n)), n)
    return bounds[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * BAG, doc


def vocabulary(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts by number, n + 1 word offsets by text, and the embeddings of each distinct word with their count; block by block."""
    number: dict[int, int] = {}
    words, offsets, buckets, counts, total, at = [], [np.zeros(1, np.int64)], [], [], 0, 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= _BLOCK):
            size += len(texts[stop])
            stop += 1
        points, first, end, bounds = words_of(texts[at:stop])
        hashes, where, which = np.unique(_hashes(points, first, end), return_index=True, return_inverse=True)
        keys = hashes.tolist()
        new = np.array([k for k, h in enumerate(keys) if h not in number], np.int64)
        if len(new):
            number.update((keys[k], len(number)) for k in new.tolist())
            word, bucket = subwords(points, first[where[new]], end[where[new]])
            buckets.append(bucket[np.argsort(word, kind="stable")].astype(np.int32))
            counts.append(np.bincount(word, minlength=len(new)))
        words.append(np.array([number[h] for h in keys], np.int32)[which] if keys else np.zeros(0, np.int32))
        offsets.append(bounds[1:] + total)
        total, at = total + int(bounds[-1]), stop
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return joined(words, np.int32), np.concatenate(offsets), joined(buckets, np.int32), joined(counts, np.int64)


def calibrated(logit: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make a logistic of the logits fit the labels, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -40, 40)))
        r, h = weight * (p - labels), weight * p * (1 - p)
        g = np.array([(r * logit).sum() + 1e-2 * (a - 1), r.sum()])
        m = np.array([[(h * logit**2).sum() + 1e-2, (h * logit).sum()], [(h * logit).sum(), h.sum() + 1e-2]])
        step = np.linalg.solve(m, g)
        step *= min(1.0, 2.0 / np.abs(step).max())
        a, b = max(0.05, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return a, b


def train(texts: list[str], labels: np.ndarray, *, base: float | None = None, epochs: int = 10, rate: float = 0.3, draws: tuple[int, int] = (8, 3), seed: int = 7) -> Model:
    """Jointly trained embeddings and softmax, its logits then calibrated on the same rows to the share ``base`` of
    toxic rows (that of the labels given, if None). draws: bags drawn of a text in each of the first two epochs, in
    which all weigh the same, and in each later one. Rows of one class only give a constant score."""
    labels = np.asarray(labels, np.int64)
    sampled = float(labels.mean()) if len(labels) else 0.0
    base = sampled if base is None else base
    which, bounds, bucket, count = vocabulary(texts)
    if sampled in (0.0, 1.0) or not len(which):
        return Model(np.zeros(BUCKETS), float(np.clip(np.log((base + 1e-6) / (1 - base + 1e-6)), -20, 20)), base)
    rng = np.random.default_rng(seed)
    begin = np.cumsum(count) - count
    starts, doc = bags(bounds)
    ends = np.append(starts[1:], len(which))
    embed = rng.normal(0, 0.05, (BUCKETS, SIZE))
    soft = rng.normal(0, 0.5, (SIZE, 2))
    bias = np.array([0.0, 0.0])
    seen = np.full((BUCKETS, SIZE), 1e-6), np.full(soft.shape, 1e-6), np.full(2, 1e-6)
    some = np.flatnonzero(np.diff(bounds) > 0)
    weight = np.where(labels == 1, 0.5 / sampled, 0.5 / (1 - sampled))
    for epoch in range(epochs):
        linear = (embed @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
        value = np.add.reduceat(linear[bucket], begin) / count
        logit = np.add.reduceat(value[which], starts) / (ends - starts)
        # Gumbel noise: the largest keys of a text are draws by weight, without putting back.
        key = (0.0 if epoch < 2 else FOCUS) * logit + rng.gumbel(size=len(logit))
        rank = np.lexsort((-key, doc))
        place = np.arange(len(doc)) - np.repeat(np.searchsorted(doc[rank], np.unique(doc)), np.bincount(doc)[np.unique(doc)])
        chosen = rank[place < draws[epoch >= 2]]
        chosen = chosen[np.argsort(rng.random(len(some))[np.searchsorted(some, doc[chosen])], kind="stable")]
        for part in np.array_split(chosen, max(1, len(chosen) // 768)):
            n = (ends - starts)[part]
            bag = np.repeat(np.arange(len(part)), n)
            words = which[np.repeat(starts[part] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            m = count[words]
            slot = bucket[np.repeat(begin[words] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))]
            share = np.repeat(1 / (m * n[bag]), m)
            bag = np.repeat(bag, m)
            used, local = np.unique(slot, return_inverse=True)
            rows = embed[used]
            mean = np.stack([np.bincount(bag, weights=rows[local, d] * share, minlength=len(part)) for d in range(SIZE)], axis=1)
            out = mean @ soft + bias
            out = np.exp(out - out.max(axis=1, keepdims=True))
            out /= out.sum(axis=1, keepdims=True)
            y = labels[doc[part]]
            out[np.arange(len(part)), y] -= 1
            out *= (weight[doc[part]] / len(part))[:, None]
            back = out @ soft.T
            up = np.stack([np.bincount(local, weights=back[bag, d] * share, minlength=len(used)) for d in range(SIZE)], axis=1)
            for table, grad, past in ((embed, up, seen[0]), (soft, mean.T @ out, seen[1]), (bias, out.sum(axis=0), seen[2])):
                if table is embed:
                    past[used] += grad**2
                    embed[used] -= rate * grad / np.sqrt(past[used])
                else:
                    past += grad**2
                    table -= 0.3 * rate * grad / np.sqrt(past)
    linear = embed @ (soft[:, 1] - soft[:, 0])
    logit = np.add.reduceat((np.add.reduceat(linear.astype(np.float32)[bucket], begin) / count)[which], starts) / (ends - starts) + bias[1] - bias[0]
    average = averaged(logit, doc, len(labels))
    share = np.where(labels == 1, base / sampled, (1 - base) / (1 - sampled))
    slope, offset = calibrated(average[some], labels[some], share[some])
    return Model(linear, float(bias[1] - bias[0]), base, slope, offset)


def fit(docs: DataFrame, labels: DataFrame, *, max_toxic: int = 2500, max_clean: int = 4000, max_bytes: int = 20_000) -> Model:
    """A model of at most max_toxic + max_clean labelled rows that are not held out, the first by a hash of doc_id;
    those of them above max_bytes are left out, so that the sample's size is bounded too.

    Of a doc_id with several labels the largest counts, of one with several rows the first by a hash of the text; null
    labels and ids are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    picked = [known.where(where).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for where, n in (("toxic = 1", max_toxic), ("toxic = 0", max_clean))]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes).join(F.broadcast(picked[0].unionAll(picked[1])), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    rows = some.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m")).select("doc_id", "m.text", "toxic").toArrow()
    rows = sorted(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True))
    return train([r[1] for r in rows], np.array([r[2] for r in rows], np.int64), base=share)


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of ``docs``; a null or wordless text gets the model's base rate.

    A null doc_id stays null, repeated rows stay, other columns are not read, an empty table gives an empty table.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_scorer(spark, model), "doc_id long, score double")


def _scorer(spark: SparkSession, model: Model, text: int = 1, keep: bool = False):
    """Adds a score to batches by their column number ``text``, which is dropped unless ``keep``."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            out, held, size = [], [], 0
            for at in range(0, batch.num_rows, 256):
                for value in batch.column(text).slice(at, 256).cast(pa.large_binary()).to_pylist():
                    value = value or b""
                    held.append(value.decode("utf-8", "replace"))
                    size += len(value)
                    if size >= _SCORED:
                        out.append(shared.value.scores(held))
                        held, size = [], 0
            if held:
                out.append(shared.value.scores(held))
            scores = np.concatenate(out) if out else np.zeros(0)
            kept = [k for k in range(batch.num_columns) if keep or k != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(scores)], names=[*(batch.schema.names[k] for k in kept), "score"])

    return run


def with_scores(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs`` with a score column, in one pass."""
    if docs.schema["text"].dataType.typeName() == "string":
        schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
        return docs.mapInArrow(_scorer(spark, model, docs.columns.index("text"), keep=True), schema)
    names = docs.columns
    ordered = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("scored_text"), *names[0:])
    schema = ordered.drop("scored_text").schema.add("score", "double")
    return ordered.toDF("__id", "__text", *names).mapInArrow(_scorer(spark, model), ", ".join(
        f"`{n}` {f.dataType.simpleString()}" for n, f in zip(["__id", *names, "score"], schema.fields, strict=True))).drop("__id")
