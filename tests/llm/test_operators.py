"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest

from plumbline.llm import bpe, decontaminate, htmltext, licenses, linededup, minhash, queries, toxicity, transducer, vectordup, warc

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, k):
    w = SPACE.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes_of(ids, linked):
    comp = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return comp


def documents(spark):
    """Nulls, empty, blank, long and repeated texts, and columns whose names the operators use themselves."""
    rng = random.Random(5)
    words = [f"w{i}é" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t ", "c"), (4, "one Two", "a"), (5, "ONE two", "b"), (6, "x" * 30000, "c"), (7, " ".join(rng.choice(words) for _ in range(40000)), None), (None, "lost and found text here", "a")]
    rows += [(10, " ".join(base), "a"), (11, " ".join(base), "b"), (11, " ".join(base), "b")]
    for i in range(12, 30):
        edited = list(base)
        for _ in range(i - 11):
            edited[rng.randrange(len(edited))] = rng.choice(words)
        rows.append((i, " ".join(edited), f"s{i % 5}"))
    return spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, source string, component_id int, key string, n int").repartition(3)


def test_minhash_against_brute_force(spark, sf):
    table = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    for docs, rows in ((spark.read.parquet(f"{sf}/documents.parquet"), [(r["doc_id"], r["text"]) for r in table]), (documents(spark), None)):
        rows = rows or [(r.doc_id, r.text) for r in documents(spark).collect()]
        got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark, docs, shingle=4).collect()]
        known = [(i, shingle_set(t, 4)) for i, t in rows if i is not None]
        linked = [(a, b) for k, (a, sa) in enumerate(known) for b, sb in known[:k] if sa and sb and 100 * len(sa & sb) >= 80 * len(sa | sb)]
        comp = classes_of([i for i, _ in known], linked)
        want = [(i, len(shingle_set(t, 4)), comp.get(i), i is None or comp[i] == i) for i, t in rows]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_minhash_open_members_meet_in_tiles(spark):
    """A chain in which the pivot is linked with few; tiles of four members."""
    rows = [(i, " ".join(f"v{j}" for j in range(i * 3, i * 3 + 90))) for i in range(40)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), shingle=4, tile=4).collect()}
    sets = [(i, shingle_set(t, 4)) for i, t in rows]
    comp = classes_of([i for i, _ in rows], [(a, b) for a, sa in sets for b, sb in sets if a < b and 100 * len(sa & sb) >= 80 * len(sa | sb)])
    assert got == comp


def contaminated(rows, items, width=10):
    windows = {}
    for item, text in items:
        w = ALNUM.findall(lower(text))
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in rows:
        w, own = ALNUM.findall(lower(text)), set()
        hit = [0] * len(w)
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    own |= found
                    hit[i : i + n] = [1] * n
        out.append((doc, len(w), sum(hit), sorted(own)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part", [decontaminate.PART_BYTES, 3000])
def test_decontamination(spark, sf, part, monkeypatch):
    if part == 3000:
        monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 150)
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()] + [(900, None), (901, ""), (902, "lost And"), (903, "w1é"), (903, "w2é w3é")]
    bench = spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, n_words int")
    for docs in (documents(spark), spark.read.parquet(f"{sf}/documents.parquet").drop("source")):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = decontaminate.contamination(spark, docs, bench, part_bytes=part).collect()
        want = contaminated(rows, items)
        assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=repr) == want
        assert all(sum(x.last - x.first + 1 for x in r.spans) == r.n_hit for r in got)
        clean = decontaminate.uncontaminated(spark, docs, bench, part_bytes=part)
        assert clean.columns == docs.columns
        assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((w[0] for w in want if not w[2]), key=repr)


def thue_morse(n):
    """Words of n letters that polynomial hashes modulo a power of two confuse."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [64, 256, 1024, 4096])
def test_structured_words_do_not_collide(spark, n):
    import base64

    import tiktoken

    one, other = thue_morse(n)
    docs = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(spark, docs).collect()} == {1, 2}
    bench = spark.createDataFrame([(5, one)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.contamination(spark, docs, bench).collect()} == {1: 1, 2: 0}
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {r.doc_id: list(r.ids) for r in bpe.encode_ids(spark, docs, path, P.PATTERN).collect()}
    assert ids == {1: library.encode_ordinary(one), 2: library.encode_ordinary(other)}


def test_bpe_against_library(spark):
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.ByteBpe(open(path, "rb").read(), P.PATTERN)
    rng = random.Random(1)
    letters = "ab '\n\t sdtrevl’éß中漢字०1²٣ :;<|endoftext|>Ᲊ😀\U00010d40  　\x1c\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(2000)] + ["", "abc" * 5000]
    for text, ids in zip(texts, coder.encode_all(t.encode() for t in texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()
    got = bpe.encode_digests(spark, documents(spark), path, P.PATTERN).collect()
    want = sorted((r.doc_id, len(i := library.encode_ordinary(r.text or "")), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest(), True) for r in documents(spark).where("doc_id is not null").collect())
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == want
    ids = bpe.encode_ids(spark, documents(spark), path, P.PATTERN)
    back = {r.doc_id: r.text for r in bpe.decode_ids(spark, ids, path, P.PATTERN).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in documents(spark).collect())


def test_forest_is_the_single_tree():
    ranks = bpe.parse_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    pairs, rng = bpe.PairRanks(ranks), random.Random(2)
    pieces = ["".join(rng.choice("etaoin shrdlu") for _ in range(rng.randrange(1, 17))).encode() for _ in range(500)]
    assert bpe.encode_forest(pieces, ranks, pairs) == [bpe.encode_piece(p, ranks) for p in pieces]


def test_token_counts_against_library(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    machine = transducer.Transducer(open(path, "rb").read())
    rng = random.Random(3)
    letters = "ab '\n\t sdtrevl’éß中漢字०1²٣ :;Ᲊ😀\U00010d40  　\x1c\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1000)]
    texts += ["a<|endoftext|> b", "<|endoftext|>", " " * 700, "x" * 3000, "'re've'll'a 's's", "".join(rng.choice("abcde") for _ in range(3000)), ""]
    assert machine.count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in transducer.token_counts(spark, documents(spark), path).collect())
    rows = documents(spark).collect()
    n = [len(e.ids) for e in library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
    assert got == sorted((r.doc_id or 0, len((r.text or "").encode()), k, k > 1024) for r, k in zip(rows, n, strict=True))


def test_token_counts_of_documents_against_library(spark):
    """All of documents at sf0.01."""
    from tokenizers import Tokenizer

    path, docs = P.path("byte_bpe_50k.json"), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    library, rows = Tokenizer.from_file(path), docs.select("doc_id", "text").collect()
    n = [len(e.ids) for e in library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
    want = sorted((r.doc_id, len((r.text or "").encode()), k, k > 1024) for r, k in zip(rows, n, strict=True))
    assert sorted(tuple(r) for r in transducer.token_counts(spark, docs, path).collect()) == want


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghijklmnopqrstuvwxyz", "中漢字国", "é ", " \n", "'s", "aaaaaaaaaaaaab"])
def test_long_texts_in_slices_of_bounded_states(letters, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(transducer, "_BLOCK", 20000)
    monkeypatch.setattr(transducer, "_SLICE", 3000)
    monkeypatch.setattr(transducer, "_STATES", 2000)
    path = P.path("byte_bpe_50k.json")
    library, machine, rng = Tokenizer.from_file(path), transducer.Transducer(open(path, "rb").read()), random.Random(12)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (50000, 300, 7000, 0, 21000)] + ["x<|endoftext|>" + letters * 9]
    assert machine.count(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(machine.states) < 20000


def test_maps_that_never_meet_are_followed():
    """Chunks as permutations of states: no guess helps, and every prefix is still right."""
    rng = np.random.default_rng(13)
    turn = np.array([rng.permutation(200) for _ in range(90)])
    text = np.repeat([0, 1, 2], [50, 1, 39])
    constant = np.append(True, text[1:] != text[:-1])
    maps = transducer.Maps(text, constant, lambda k, e: (turn[k, e], e + 1))
    exits, totals = maps.prefixes(np.where(constant, 7, 3))
    for k in range(90):
        state, total = (7, 0) if constant[k] else (exits[k - 1], totals[k - 1])
        assert (exits[k], totals[k]) == (turn[k, state], total + state + 1)


def test_bpe_of_documents_against_library(spark):
    """All of documents at sf0.01."""
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    ids = library.encode_ordinary_batch([r.text or "" for r in rows])
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    want = sorted((r.doc_id, len(i), sha(",".join(map(str, i)).encode()), sha((r.text or "").encode())) for r, i in zip(rows, ids, strict=True))
    assert sorted(tuple(r)[:4] for r in bpe.encode_digests(spark, docs, path, P.PATTERN).collect()) == want


def test_warc_round_trip(spark, tmp_path):
    long, other = "<p>" + "é" * 200, "<i>" + "z" * 300
    rows = [(1, "http://b.example/x", long), (2, "http://a.example/y?q=1", long), (3, None, None), (4, "not a url", "short"), (5, "http://a.example/", "short"), (6, "http://c.example/", other), (6, "http://c.example/", other), (None, "http://n.example/", long), (7, "http://[bad", other)]
    rows += [(None, None, None), (None, None, None), (None, "http://n.example/", other), (8, "http://l.example/", "ü" * 3_000_000)]
    rows += [(i, f"http://h{i % 7}.example/{i}", f"{i % 50}" * 80) for i in range(100, 1400)]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, digest string, copy int")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark, pages).collect()), key=repr)
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want, used = [], set()
    for i, _, h in rows:
        raw = (h or "").encode()
        lead = first.get(h)
        revisit = lead is not None and (i != lead or h in used)
        if lead is not None and i == lead:
            used.add(h)
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", lead if revisit else None))
    assert got == sorted(want, key=repr)
    folder = tmp_path / "archives"
    made = [(1, "http://a.example/", long.encode(), "d1", 0, None, False), (2, None, long.encode(), "d1", 0, "1~0", True), (None, None, None, "d2", 0, None, False)] * 9
    table = spark.createDataFrame(made, "page_id long, url string, html binary, digest string, copy long, first string, revisit boolean").coalesce(1)
    lines = table.mapInArrow(warc._writer(str(folder), "12345678123456781234567812345678", "2024-01-02T03:04:05Z", 2000), warc._CAPTURE).collect()
    files = sorted({r.file for r in lines})
    assert len(files) > 1
    for name in files:
        raw, records = (folder / name).read_bytes(), []
        while raw:  # one gzip member a record
            member = zlib.decompressobj(31)
            text = member.decompress(raw)
            raw = member.unused_data
            head, _, block = text.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n") and {"WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length"} <= fields.keys()
            assert block[int(fields["Content-Length"]) :] == b"\r\n\r\n"
            records.append(fields)
        assert [f["WARC-Type"] for f in records].count("warcinfo") == 1 and records[0]["WARC-Type"] == "warcinfo"
        assert all(f["WARC-Target-URI"] and f["Content-Type"].startswith("application/http") for f in records[1:])
        assert all(("WARC-Refers-To" in f) == (f["WARC-Type"] == "revisit") for f in records)
    assert warc.url_key("https://www.Blog.example.org:443/A?b") == "org,example,blog)/a?b"


def test_line_dedup(spark):
    shared, rare = "a boilerplate line of words", "seen twice"
    rows = [(i, f"own {i}\n {shared} \n\n{rare if i < 4 else 'x' + str(i)}", f"s{i % 6}") for i in range(2, 14)] + [(1, shared, None), (40, None, "s1"), (41, "", "s2"), (None, shared, "s3"), (50, shared, "s4"), (50, shared, "s4")]
    docs = spark.createDataFrame([(*r, 9, 8) for r in rows], "doc_id long, text string, source string, n_lines int, line int")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in linededup.dedup_lines(spark, docs).collect()), key=repr)
    sites = {}
    for i, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(" \t\r"):
                sites.setdefault(line.strip(" \t\r"), (set(), []))[0].update([s] if s is not None else [])
                sites[line.strip(" \t\r")][1].append(i)
    gone = {k: min(x for x in v[1] if x is not None) for k, v in sites.items() if len(v[0]) >= 5}
    want = []
    for i, t, _ in rows:
        kept = [x for x in (t or "").split("\n") if not (x.strip(" \t\r") in gone and gone[x.strip(" \t\r")] != i)]
        n = 0 if t is None else len(t.split("\n"))
        want.append((i, None if t is None else "\n".join(kept), n, n - len(kept) if t is not None else 0))
    assert got == sorted(want, key=repr)
    # The first document keeps the line, source or not; rows without an id lose it, each judged by its own text.
    assert (1, shared, 1, 0) in got
    nameless = [(None, f"alone {i}\n{shared}", "s1") for i in range(40)] + [(i, shared, f"s{i}") for i in range(6)]
    out = linededup.dedup_lines(spark, spark.createDataFrame(nameless, "doc_id long, text string, source string")).collect()
    assert sorted(r.text for r in out if r.doc_id is None) == sorted(f"alone {i}" for i in range(40))


def test_common_notices(spark):
    notices = {
        "Licensed under GPL version 2.": "gpl-2.0", "GNU GPL version 3 or later": "gpl-3.0", "covered by the GPL": "gpl", "LGPL v3": "lgpl-3.0", "LGPL version 2.1": "lgpl-2.1", "lgpl v2 or later": "lgpl-2.0",
        "LGPLv3": "lgpl-3.0", "AGPL v3": "agpl-3.0", "The MIT licence": "mit", "released under the MIT terms": "mit", "under the LGPL": "lgpl",
    }
    rows = list(enumerate([*notices, "a course at MIT", "the mit press", "gpl 7"]))
    got = {r.doc_id: set(r.labels) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (text, label) in enumerate(notices.items()):
        assert label in got[k], (text, got[k])
    assert not any(got[k] for k in range(len(notices), len(rows)))


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    rows = [(1, f"text {i % 700}") for i in range(3000)] + [(i, "a clean one") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 40)], "doc_id long, toxic int")
    sent = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, base: sent.append((texts, toxic.tolist())) or "model")
    for _ in range(2):
        assert toxicity.fit(docs, labels) == "model"
    assert sent[0] == sent[1] and sum(sent[0][1]) == 1 and len(sent[0][0]) <= 39


def test_formulas_are_text():
    page = "<article><p>Energy is <math><mi>E</mi>=<mi>m</mi></math> here.</p><form><label>Name</label><input></form><p>Second paragraph of words.</p></article>"
    assert htmltext.main_text(page) == "Energy is E=m here.\nSecond paragraph of words."


def test_licenses(spark):
    assert len(licenses.rules()) > 300
    text = "Licensed under the GNU General Public License, version 3. MIT license mit license. CC BY-NC 4.0"
    rows = [(1, text), (2, None), (3, ""), (4, "K mit  License" + " word" * 9000), (4, "unrelated text"), (None, "apache license")]
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, s int")).collect()}
    for i, t in rows:
        w = ALNUM.findall(lower(t))
        places = sorted((k, label) for p, label in licenses.BASE_PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert sorted((p.word, p.label) for p in got[i, len(w)].places) == places
    assert set(got[1, len(ALNUM.findall(lower(text)))].labels) == {"gpl", "gpl-3.0", "mit", "cc-by", "cc-by-nc"}
    assert [d.label for d in got[1, len(ALNUM.findall(lower(text)))].detections][:1] == ["gpl-3.0"]


def example(pattern):
    """A shortest text of a rule: optional parts left out, first alternatives and first letters taken."""
    text, before = re.sub(r"\(\?![^()]*\)|\[(.)[^\]]*\]", r"\1", pattern), None
    while text != before:
        before, text = text, re.sub(r"\(\?:([^()|]*)[^()]*\)([?*]?)", lambda m: "" if m[2] else m[1], text)
    return re.sub(r".\?", "", text.replace(r"\S+", "x"))


def detected(text, rules):
    """Detections by Python's regular expressions, each pair of intervals compared."""
    s, found = f" {' '.join(ALNUM.findall(lower(text)))} ", []
    words = set(s.split())
    for rank, r in enumerate(rules):
        if r.keyword in words:
            for m in re.finditer(f" {r.pattern}(?= )", s):
                first = s[: m.start()].count(" ")
                found.append((first, first + m[0].count(" ") - 1, r.priority, r.label, r.confidence, rank))
    over = lambda y, x: y[0] <= x[0] and y[1] >= x[1] and (y[2] > x[2] or (y[2] == x[2] and (y[1] - y[0] > x[1] - x[0] or (y[1] - y[0] == x[1] - x[0] and y[5] < x[5]))))
    return sorted(x[:5] for x in found if not any(over(y, x) for y in found))


def test_license_detections_against_brute_force(spark):
    """All of documents at sf0.01 and texts full of overlapping forms."""
    rules, docs = licenses.rules(), spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(11)
    forms = [example(r.pattern) for r in rules] + ["the", "version 2", "and", "license", "cc by nc sa 4 0"]
    made = [(10**6 + k, " ".join(rng.choice(forms) for _ in range(30))) for k in range(60)]
    made += [(2 * 10**6, "MIT License, " * 3000), (2 * 10**6 + 1, "gnu general public license version 3 " * 400)]
    rows = [tuple(r) for r in docs.collect()] + made
    got = {r.doc_id: r for r in licenses.scan(docs.unionAll(spark.createDataFrame(made, docs.schema))).collect()}
    for i, text in rows:
        want = detected(text, rules) if len(text or "") < 20000 or i >= 10**6 else None
        if i == 2 * 10**6:  # too many for all pairs: the names stand apart
            want = [(2 * k, 2 * k + 1, 2, "mit", 0.7) for k in range(3000)]
        assert want is None or sorted(tuple(d) for d in got[i].detections) == want


def test_license_scan_plan_is_native_and_quick(spark):
    import time

    docs = spark.createDataFrame([(1, "Released under the MPL 2.0")], "doc_id long, text string").coalesce(1)
    licenses.scan(docs).collect()
    began = time.time()
    out = licenses.scan(docs)
    out.collect()
    assert time.time() - began < 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.replace("Exchange RoundRobin", "")


def test_license_rules_alone(spark):
    """Each rule finds a text that holds nothing else, at the end of a text too; rules of a custom set as well."""
    rules = licenses.rules()
    texts = [example(r.pattern) for r in rules]
    assert all(re.fullmatch(r.pattern, t) for r, t in zip(rules, texts, strict=True))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect()}
    for k, (r, t) in enumerate(zip(rules, texts, strict=True)):
        assert r.keyword in t.split(" "), (r, t)
        # What suppresses a rule covers its words and stands at least as high.
        assert any(d.first == 0 and d.last == t.count(" ") and d.priority >= r.priority for d in got[k].detections), (r, t, got[k].detections)
    named = [("Released under the MPL 2.0", "mpl-2.0", 0.95), ("Distributed under EUPL 1.2", "eupl", 0.95), ("dedicated: CC0", "cc0-1.0", 0.5), ("FreeBSD License", "bsd-2-clause", 0.7), ("the Beerware license", "beerware", 0.7)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(named)], "doc_id long, text string")).collect()}
    assert all(label in got[k].labels and got[k].score == score for k, (_, label, score) in enumerate(named))
    own = [licenses.Rule("zork", "zork terms", 1, "zork", 0.6), licenses.Rule("éa", "éa 9", 2, "ea", 0.8)]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame([(0, "ZORK terms"), (1, "under éA 9"), (2, "zorks terms")], "doc_id long, text string"), own).collect()}
    assert got == {0: ["zork"], 1: ["ea"], 2: []}


def test_toxicity_learns_and_generalises(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioumnrst") for _ in range(rng.randrange(2, 8)))
    texts, labels = [], []
    for k in range(400):
        t = [word() for _ in range(rng.randrange(10, 150))]
        if k % 4 == 0:
            t[rng.randrange(len(t))] = rng.choice(["pathetic", "pathetics", "xpathetic", "worthless"])
        texts.append(" ".join(t))
        labels.append(int(k % 4 == 0))
    model = toxicity.train(texts, np.array(labels))
    bad, good, empty = model.scores(["so pathetik a " + word(), " ".join(word() for _ in range(50)), ""])
    assert bad > good and empty == pytest.approx(0.25)
    assert toxicity.train([], np.zeros(0)).scores(["x"])[0] < 0.5
    docs = documents(spark)
    scored = toxicity.score(spark, docs, model)
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    kept = toxicity.with_scores(spark, docs, model)
    assert kept.columns == [*docs.columns, "score"] and kept.drop("score").exceptAll(docs).count() == 0
    held = docs.select("doc_id", toxicity.held_out().alias("h")).where("doc_id is not null").collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)


def test_toxicity_averages_every_bag():
    logit, doc = np.array([1.0, 3.0, -2.0, 0.5]), np.array([0, 0, 0, 2])
    weight = np.exp(toxicity.FOCUS * logit[:3])
    assert np.allclose(toxicity.averaged(logit, doc, 3), [(weight * logit[:3]).sum() / weight.sum(), -np.inf, 0.5])


def test_toxicity_learns_nothing_of_held_out_labels(spark, sf):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert flipped.exceptAll(labels).count() > 0
    moved = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("s"))
    for other in (toxicity.fit(docs, flipped), toxicity.fit(moved, labels), toxicity.fit(docs, labels.where(~toxicity.held_out()))):
        assert np.array_equal(model.weight, other.weight) and (model.bias, model.base, model.slope, model.offset) == (other.bias, other.base, other.slope, other.offset)
    assert toxicity.fit(docs, labels, max_bytes=0).base == model.base


@pytest.mark.parametrize("block", [8, 32, 1024])
def test_vectors_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(vectordup, "BLOCK", min(block, 16))
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(30, 16))
    rows = [(k, (centers[k % 30] + 0.25 * rng.normal(size=16)).tolist(), k % 3 if k % 11 else None) for k in range(400)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None, 1.0], 1), (504, [], 1), (505, [1.0, 2.0], 1), (506, [2.0, 4.0], 1)]
    rows += [(600 + k, rows[0][1], rows[1][2]) for k in range(40)] + [(600, rows[0][1], rows[1][2]), (None, rows[1][1], 0), (None, rows[1][1], rows[1][2]), (None, [9.0, -9.0], 1)]
    half = np.arccos(0.93)
    rows += [(700, [1.0, 0.0, 0.0], 9), (701, [0.93, float(np.sin(half)), 0.0], 9), (702, [0.9299999, float(np.sin(half)), 0.0], 9), (703, [1e-200, 0.0, 0.0], 9), (704, [1e200, 1e200, 0.0], 9)]
    table = spark.createDataFrame([(*r, 5, "p") for r in rows], "vec_id long, embedding array<double>, label int, copies int, part string")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in vectordup.near_duplicates(spark, table, block=block).collect()), key=repr)

    def cos(a, b):
        if a is None or b is None or len(a) != len(b) or not a or any(x is None or not np.isfinite(x) for x in [*a, *b]) or not any(a) or not any(b):
            return -2
        a, b = np.array(a) / np.abs(a).max(), np.array(b) / np.abs(b).max()
        return np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))

    links = [0] * len(rows)
    linked = []
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if a[0] is not None and b[0] is not None and a[2] is not None and a[2] == b[2] and cos(a[1], b[1]) >= 0.93:
                links[i] += 1
                links[j] += 1
                linked.append((i, j))
    comp = {}
    for i, c in classes_of(list(range(len(rows))), linked).items():
        comp.setdefault(c, []).append(rows[i][0])
    named = {i: min((x for x in comp[c] if x is not None), default=None) for i, c in classes_of(list(range(len(rows))), linked).items()}
    want = sorted(((r[0], links[i], None if r[0] is None else named[i]) for i, r in enumerate(rows)), key=repr)
    assert got == want


def test_main_text():
    page = """<html><head><title>t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><nav><a href=x>menu</a></nav><div class="ad box">buy</div>
    <article><header>by me</header><h1>Title &amp; more</h1><p><b>First,&nbsp; paragraph
    goes on, and on, and on.<br><p>Second one, with <a href=y>a link</a>, here.<div id="comments"><p>reader says a lot, lot, lot of things here</div></article><footer>foot</footer>"""
    assert htmltext.main_text(page) == "Title & more\nFirst, paragraph goes on, and on, and on.\nSecond one, with a link, here."
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<script>x") == htmltext.main_text("<nav>a</nav>") == ""
    plain = "<body><div><div class=sidebar>side</div><div><p>" + "word, " * 60 + "</p><p>tail</p></div><div><a href=z>link only</a></div></div>"
    assert htmltext.main_text(plain) == ("word, " * 60).strip() + "\ntail"
    assert htmltext.main_text("a < b & c") == "a < b & c"


def test_main_text_of_named_parts():
    inside = "<article><h1 class='post-header'>Head</h1><p class='social-science'>About a science, of people.</p><div class='relatedWork'><p>Work that is related, in prose.</p></div>%s</article>"
    want = "Head\nAbout a science, of people.\nWork that is related, in prose."
    assert htmltext.main_text(inside % "") == want
    for part in ("<div class='related-posts'><a href=x>more</a></div>", "<div id=comments><p>Readers, they say much.</div>", "<section class='siteFooter'>foot</section>", "<p class=ad>buy</p>",
                 "<div class='ad-slot-2'>buy</div>", "<div class='x cookie-notice'>cookies</div>", "<button>go</button>", "<label>name <select><option>a</select></label>", "<svg><text>t</text></svg>",
                 "<video>no video</video>", "<div hidden>h</div>", "<div style='display: none'>h</div>", "<p aria-hidden=true>h</p>"):
        assert htmltext.main_text(inside % part) == want, part
    # A page whose wrapper has such a name, and elements left open.
    assert htmltext.main_text("<body><div class=widget><p>" + "Prose, and more of it. " * 20 + "</p></div><div class=widget>side</div>") == ("Prose, and more of it. " * 20).strip()
    for broken in ("<object data=x>", "<button>", "<select>", "<svg>", "<label>", "<title>", "<a href=x>", "<iframe>"):
        assert htmltext.main_text(f"<article><p>One, two.</p>{broken}<p>Three, four.</p></article>") == "One, two.\nThree, four.", broken
    assert htmltext.main_text("<article><p>One</p><button>a<p>Two</p><button>b</button><p>Three</p></article>") == "One\na\nTwo\nThree"


@pytest.mark.parametrize("unit", ["<a ", "<a '\">", "<a \"'>'\"", "<div>", "</div>", "<center><p>x", "<li><center>", "<object>", "<script>", "<!-- ", "<p aaaa", "<td><tr>", "a=b ", "<svg><b>"])
def test_broken_pages_take_linear_time(unit):
    import time

    began = time.time()
    htmltext.main_text("<article>" + unit * (300_000 // len(unit)) + ">")
    htmltext.main_text(f"<p {unit * (300_000 // len(unit))}>")
    assert time.time() - began < 4


def test_main_text_against_a_plain_parser(spark, sf):
    """Pages of the tables: blocks of the article element by the standard library's parser."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.blocks = 0, [""]

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            if tag in ("p", "h1", "div", "article"):
                self.blocks.append("")
            elif tag == "br":
                self.blocks[-1] += " "

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            if tag in ("p", "h1", "div", "article"):
                self.blocks.append("")

        def handle_data(self, data):
            self.blocks[-1] += data if self.depth else ""

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in htmltext.extract(pages).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html or "")
        text = "\n".join(b for b in (" ".join(x.split()) for x in plain.blocks) if b)
        assert got[r.page_id] == (r.url, text, len(text))


def test_extract_keeps_rows(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)]
    got = htmltext.extract(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "a", 1), ("1", "a", 1), ("None", "", 0)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
    labels, bench = spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], "item_id long, text string")
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    for out in (minhash.near_duplicates(spark, docs), decontaminate.contamination(spark, docs, bench), bpe.encode_digests(spark, docs, ranks, P.PATTERN),
                transducer.token_counts(spark, docs, P.path("byte_bpe_50k.json")), linededup.dedup_lines(spark, docs), licenses.scan(docs), toxicity.score(spark, docs, toxicity.fit(docs, labels)),
                vectordup.near_duplicates(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")),
                warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")), htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string"))):
        assert out.count() == 0
    assert decontaminate.contamination(spark, documents(spark), bench).where("n_hit > 0").count() == 0


def test_registered_queries_have_rows(spark, sf):
    assert [k.split("_")[0] for k in queries.queries()] == [f"op{n}" for n in range(1, 14)]
    for name in ("op6_license_scan", "op10_main_text"):
        assert queries.queries()[name](spark, sf).count() > 0


def test_oracles(spark, sf):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf)
        cols = sorted(got.columns)
        rel = con.sql(sql)
        assert cols == sorted(rel.columns)
        want = sorted((tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()), key=repr)
        assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == want


