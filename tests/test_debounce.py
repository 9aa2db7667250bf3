"""Debounced saving as a stream and as a batch, against a plain loop, with late, equal and interleaved changes."""

from datetime import datetime, timedelta

from plumbline.streaming import debounce

SCHEMA = "project_id string, seq long, at timestamp, wall_height double"
START = datetime(2024, 5, 1, 12)


def change(project, seq, ms):
    return (project, seq, START + timedelta(milliseconds=ms), float(seq))


def plain(rows):
    out = []
    for project in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == project), key=lambda r: (r[2], r[1]))
        out += [a for a, b in zip(own, own[1:] + [None], strict=True) if b is None or b[2] - a[2] >= timedelta(milliseconds=1200)]
    return sorted((r[0], r[1]) for r in out)


def test_settled_in_a_batch(spark):
    rows = [change("a", k, ms) for k, ms in enumerate([0, 500, 1699, 2899, 2899, 9000])] + [change("b", 1, 100), change("b", 2, 1300), change("c", 7, 5)]
    got = debounce.settled(spark.createDataFrame(rows, SCHEMA), key="project_id", time="at", order="seq").select("project_id", "seq").collect()
    assert sorted(map(tuple, got)) == plain(rows)
    assert debounce.settled(spark.createDataFrame([], SCHEMA), key="project_id", time="at", order="seq").collect() == []


def test_settled_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batches = [
        [change("a", 1, 0), change("b", 1, 100), change("a", 2, 700)],
        [change("b", 2, 900), change("a", 3, 1500)],  # each cancels what is pending
        [change("a", 4, 5000), change("a", 5, 5100), change("b", 3, 2099)],  # a: the third goes out; b: 1199 ms later, so the second does not
        [change("c", 1, 20_000)],  # moves the watermark, so all timers expire
        [change("c", 2, 60_000), change("a", 6, 59_000)],
        [change("d", 1, 200_000)],
    ]
    source = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(tmp_path / f"part{k}"))
    source.mkdir()
    for k in range(len(batches)):
        (part,) = (tmp_path / f"part{k}").glob("part-*.json")
        part.rename(source / f"{k}.json")
        import os

        os.utime(source / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    saved = []
    out = debounce.settled_stream(stream, key="project_id", time="at", order="seq")
    query = out.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda df, _: saved.extend((r.project_id, r.seq) for r in df.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    every = [r for rows in batches for r in rows]
    # What the watermark has not passed at the end is still pending: the last change of all.
    assert sorted(saved) == [x for x in plain(every) if x != ("d", 1)]
