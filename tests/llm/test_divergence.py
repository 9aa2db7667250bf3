"""The divergence audit against a plain computation of the contract, and on nulls, empty and long texts, ties and repeats."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import divergence
from plumbline.llm.scratch import Scratch

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, value int, tile int"


def plain(rows, least, top):
    """(lang, source, part, item, value, rank) by the definition, dense."""
    docs = [(lang or "", source or "", TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    n_docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        n_docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, source in counts:
        kept = [t for t, n in n_docs[lang].items() if n >= least]
        sources = [s for other, s in counts if other == lang]

        def shares(found):
            total = sum(found[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (found[t] + 5) // (total + 5 * len(kept)) for t in kept}

        mine, whole = shares(counts[lang, source]), shares(sum((counts[lang, s] for s in sources), Counter()))
        theirs = {s: shares(counts[lang, s]) for s in sources if s != source}
        pairs = [(s, sum(abs(mine[t] - p[t]) for t in kept)) for s, p in theirs.items()]
        terms = [(t, mine[t] - whole[t]) for t in kept if counts[lang, source][t] and mine[t] > whole[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 3, 4) for i, r in enumerate(rows)], SCHEMA).repartition(3)


def found(spark, docs, least, top):
    return sorted(tuple(r) for r in divergence.audit(spark, docs, least=least, top=top).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_against_the_definition(spark, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "ABcdéß漢" for b in "xyz字"] + ["same" + c for c in "abcdefgh"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(40))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "É", None])) for _ in range(120)]
    # Nulls, a group without terms, a language of one source, one without kept terms, repeated rows, digits and marks.
    rows += [(None, "en", "mute"), ("", None, "mute"), ("alone alone", "xx", "only"), ("a1b2_c-d", "de", "s1"), ("Rare", "yy", "p"), ("rarer", "yy", "q"), (None, None, None)]
    rows += [("copy copy of a row", "en", "s1")] * 40
    for least, top in ((3, 5), (30, 50)):
        assert found(spark, table(spark, rows), least, top) == plain(rows, least, top)


def test_long_texts_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 64)
    raw = (" ".join(["word", "other"] * 500) + " " + "y" * 500 + " end").encode()
    assert [w for part in divergence._slices(raw) for w in part.split()] == raw.split()
    rows = [("Word other " * 50_000 + "z" * 100_000, "en", "a"), ("other", "en", "b")]
    assert found(spark, table(spark, rows), 1, 50) == plain(rows, 1, 50)


def test_ties_beyond_the_top_by_bytes(spark):
    items = [f"{'p' * k}{c}" for k in (0, 7, 8, 30) for c in "abcdeé字"]
    values = [(f"g{g}", "s", item, v) for g in range(2) for k, item in enumerate(items) for v in [5 if g else 5 + (k % 3 == 0) * (1 << 29)]]
    rows = spark.createDataFrame(values, "lang string, source string, item string, value long")
    for top in (1, 4, 9, 27, 28, 40):
        got = sorted(tuple(r) for r in divergence.largest(rows, top, Scratch(spark, "t")).collect())
        want = []
        for g in ("g0", "g1"):
            want += sorted((v for v in values if v[0] == g), key=lambda v: (-v[3], v[2].encode()))[:top]
        assert got == sorted(want)


def test_many_sources_meet_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 3)
    rng = random.Random(4)
    rows = [(" ".join(rng.choices("abcdefg", k=6)), "en", f"s{i % 17}") for i in range(90)]
    assert found(spark, table(spark, rows), 2, 3) == plain(rows, 2, 3)


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, terms = 9_123_456_789_012_345, 30_123_456_789_012_347, 1_234_567
    got = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(terms))).first()[0]
    assert got == 1 + 1_000_000_000 * (n + 5) // (total + 5 * terms)


def test_empty_table(spark):
    assert divergence.audit(spark, table(spark, [("a", "b", "c")]).where("false")).collect() == []
