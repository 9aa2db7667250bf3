"""The stages of the document pipeline on planted cases."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioumnrst") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        t = text(90)
        if toxic:
            t = t.replace(" ", " pathetic worthless ", 3)
        rows.append([i, t, "en", f"s{i % 7}", 0])
        labels.append((i, 1, int(toxic)))
    item = text(30)
    rows[1][1] += "\n" + item
    line = "this boilerplate line stands on every site of all"
    for i in range(2, 40):
        rows[i][1] += "\n" + line
    copy = rows[51][1]
    rows += [[1000 + k, copy.replace(copy.split()[40 + k], "changed", 1), "en", "s1", 0] for k in range(3)]
    for r in rows:
        r[4] = len(r[1])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "byte_bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
    toxic = {i for i in range(0, 300, 5)}
    assert len(toxic & kept["toxicity"].keys()) <= 3 and len({r[0] for r in rows} - toxic - kept["toxicity"].keys()) <= 6
    with_line = [i for i, r in kept["line_dedup"].items() if line in r.text]
    assert len(with_line) == 1 and min(i for i in range(2, 40) if i in kept["line_dedup"]) == with_line[0]
    assert kept["line_dedup"].keys() == kept["toxicity"].keys()
    group = {51, 1000, 1001, 1002} & kept["line_dedup"].keys()
    assert group & kept["minhash_near_dedup"].keys() == {min(group)}
    assert kept["minhash_near_dedup"].keys() - kept["decontamination"].keys() == {1} & kept["minhash_near_dedup"].keys()
    assert kept["byte_bpe"].keys() == kept["decontamination"].keys() and all(r.ok for r in kept["byte_bpe"].values())
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == set(kept["byte_bpe"])


def columns(spark, rows):
    """Rows as documents, with columns whose names the stages use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, component_id long, line string"
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 9.0, 1, 2, "l") for i, t, s in rows], schema)


def test_stages_on_nulls_repeats_and_clashes(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("aeioumnrst") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    item, clean, twin, long = text(12), text(40), text(60), text(30000)
    rows = [(None, "one two three " + item, "a"), (None, clean, "b"), (3, "four five six " + item, "a"), (3, text(30), "b"), (4, twin, "c"), (4, twin, "c"), (None, twin, "d"), (5, None, "a"), (5, "", None), (6, long, "a"), (7, long, "b"), (8, "  ", "c")]
    spark.createDataFrame([(1, item), (None, clean), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(3, 0), (4, 0), (None, 1), (6, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs, stages = columns(spark, rows), dict(corpus_pipeline.STAGES)
    key = lambda out: sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=repr)
    for name in ("toxicity", "line_dedup"):
        assert key(stages[name](spark, docs, str(tmp_path))) == sorted(rows, key=repr)
    assert key(stages["decontamination"](spark, docs, str(tmp_path))) == sorted((r for r in rows if not (r[1] or "").endswith(item)), key=repr)
    one = [r for r in rows if not (r[1] == twin and r[0] is None) and r[0] != 7]
    one.remove((4, twin, "c"))
    assert key(stages["minhash_near_dedup"](spark, docs, str(tmp_path))) == sorted(one, key=repr)
    coded = stages["byte_bpe"](spark, docs, str(tmp_path)).collect()
    assert len(coded) == len(rows) and all(r.ok for r in coded)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(one) - 2


def test_empty_tables_through_the_pipeline(spark, tmp_path):
    columns(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
