"""Fingerprints against exact paragraph sets, and on nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, lang string, key string, part int, copies int"


def paragraphs(text):
    """Of each line 15 words, and up to 16 more until one ends a sentence, as they stand."""
    out = []
    for line in re.split(r"[\n\v\f]", text):
        words = list(re.finditer(r"\S+", line, re.ASCII))
        while words:
            n = min(15, len(words))
            while n < min(31, len(words)) and words[n - 1][0][-1] not in ".!?":
                n += 1
            out.append(line[words[0].start() : words[n - 1].end()])
            words = words[n:]
    return out


def alike(a, b):
    a, b = set(paragraphs(a)), set(paragraphs(b))
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(rows, order):
    """(doc_id, n_chars, edited_sha256, near_edited, near_next) of each row; order: distinct (doc_id, text) as they stand."""
    out, following = [], dict(zip(order, order[1:] + order[:1], strict=True))
    for doc_id, text in rows:
        own, other = text or "", following[doc_id, text or ""][1]
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        out.append((doc_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), round(alike(own, edited), 12), round(alike(own, other), 12)))
    return Counter(out)


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "en", "k", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = fp.fingerprints(spark, docs).collect()
    return got, Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 12), round(r.near_next, 12)) for r in got)


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"wörd{i}" for i in range(300)] + ["字" * 5, "end.", "Stop!"]
    pool = [" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(400)]
    return ["\n".join(rng.sample(pool, rng.choice([0, 1, 2, 5, 30, 150]))) for _ in range(n)]


@pytest.mark.parametrize("rows_a_range", [500, 3])
def test_fingerprints_against_exact_sets(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(fp, "RANGE_ROWS", rows_a_range)
    monkeypatch.setattr(fp, "DRAWN", 2)
    rng = random.Random(1)
    rows = list(zip(rng.sample(range(-500, 500), 40), texts(40, 2), strict=True))
    # A later version of the first document with few changes, and an exact copy, beside it.
    rows.sort()
    rows[10] = (rows[10][0], rows[9][1] + "\none more line")
    rows[20] = (rows[20][0], rows[19][1])
    got, seen = found(spark, rows)
    assert seen == plain(rows, [(i, t or "") for i, t in rows])
    by_text = {}
    for r in got:
        by_text.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len(set.union(*by_text.values())) == len(by_text)
    edited = {r.edited_fingerprint for r in got}
    assert all(re.fullmatch(r"\d+\|[0-9a-f:,-]*", f) for f in edited)


def test_difference_recovers_the_digests(spark):
    rng = random.Random(3)
    rows = []
    for n, lost, gained in ((0, 0, 0), (40, 0, 0), (50, 1, 0), (50, 3, 4), (0, 0, 30), (200, 20, 25), (3000, 40, 0), (1000, 900, 950)):
        a = [f"line {rng.random()}" for _ in range(n)]
        b = a[lost:] + [f"more {rng.random()}" for _ in range(gained)]
        rows.append(("\n".join(a), "\n".join(b)))
    items = spark.createDataFrame(rows, "s string, t string").select("s", "t", F.expr(fp.digests("s")).alias("a"), F.expr(fp.digests("t")).alias("b"))
    cells = items.select("*", F.expr(fp.sketch("a")).alias("p"), F.expr(fp.sketch("b")).alias("q"))
    for r in cells.select("*", F.expr(fp.difference("a", "b", "p", "q")).alias("d")).collect():
        a, b = {i.x for i in r.a}, {i.x for i in r.b}
        assert len(a) == len(set(paragraphs(r.s))) and r.d.open == []
        assert sorted(r.d.lost) == sorted(a - b) and sorted(r.d.gained) == sorted(b - a)
        assert len(r.p.n) == len(r.p.k) == len(r.p.h) == 24 and sum(r.p.n) == 3 * len(a)


def test_blocks_that_no_sketch_settles(spark, monkeypatch):
    monkeypatch.setattr(fp, "LARGER", 1)
    lines = [("\n".join(f"a{i}" for i in range(900)), "\n".join(f"a{i}" for i in range(300, 1500)))]
    items = spark.createDataFrame(lines, "s string, t string").select(F.expr(fp.digests("s")).alias("a"), F.expr(fp.digests("t")).alias("b"))
    cells = items.select("*", F.expr(fp.sketch("a")).alias("p"), F.expr(fp.sketch("b")).alias("q")).select("*", F.expr(fp.difference("a", "b", "p", "q")).alias("d"))
    got = cells.select(F.size("d.open"), F.expr(fp.likeness("a", "d"))).first()
    assert got[0] > 0 and got[1] == 600 / 1500


def test_nulls_empty_long_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(fp, "CHUNK", 7)
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "x" * 200_000), (6, long), (7, "same"), (7, "same"), (None, "no id"), (8, "a. b! c?\r\nd  e\tf"), (9, "tie")]
    rows += [(9, "tie")] * 50
    _, seen = found(spark, rows)
    order = [(i, next(t or "" for j, t in rows if j == i)) for i in range(1, 10)] + [(None, "no id")]
    assert seen == plain(rows, order)
    # Different texts of one id, and of no id, stand next to each other in some order.
    got, _ = found(spark, [(1, "a b"), (1, "c d"), (1, "a b"), (None, "e"), (None, "f"), (None, "e")])
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter({(1, 3): 3, (None, 1): 3})


def test_one_document_and_none(spark):
    got, seen = found(spark, [(5, "alone in here")])
    assert seen == plain([(5, "alone in here")], [(5, "alone in here")]) and got[0].near_next == 1.0
    docs = spark.createDataFrame([], SCHEMA)
    assert fp.fingerprints(spark, docs).collect() == []


def test_plan_has_no_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = fp.fingerprints(spark, docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
