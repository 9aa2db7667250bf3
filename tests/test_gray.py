"""Queries on the gray raster against their SQL, where a double's product would give other grays than a float's."""

import duckdb
import numpy as np
import pytest

from plumbline.plans import catalog
from tests.test_catalog import plain

NAMES = (
    "ras19_clean",
    "ras21_annotation_cleaning",
    "ras22_normalise",
    "ras23_pixel_classes",
    "ras41_resize_nearest",
    "set01_union_barriers",
    "set02_union_noise",
    "set06_union_runs",
    "ras03_gray",
    "ras06_open",
    "ras08_distance",
    "ras09_distance_band",
)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two pages and a part of one, every gray of which is another by a double's product; clicks on them."""
    path, rng = str(tmp_path_factory.mktemp("gray")), np.random.default_rng(5)
    v = np.arange(1, 619, dtype=np.float32) / np.float32(997)
    v = v[np.floor(v * np.float32(997)) != np.floor(v.astype(float) * 997)]
    vectors = [(i, [float(x) for x in rng.choice(v, 64) * rng.choice((-1, 1), 64)]) for i in range(150)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    clicks = [(i, i % 7, "view") for i in range(60)]
    spark.createDataFrame(clicks, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_float_grays_against_sql(spark, tables, name):
    con = duckdb.connect()
    for table in ("embeddings", "events"):
        con.execute(f"create view {table} as select * from '{tables}/{table}.parquet/*.parquet'")
    rel, got = con.sql(catalog.oracle_sql()[name]), catalog.queries()[name](spark, tables)
    assert got.columns == rel.columns
    rows = lambda found: sorted((tuple(map(plain, r)) for r in found), key=repr)
    want = rows(rel.fetchall())
    assert want and rows(got.collect()) == want
