"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from vialattice.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def rows(columns, found):
    """Rows with columns by name, numbers rounded, in any order."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return repr(round(float(x), 5) + 0.0) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(plain(r[k]) for k in order) for r in found)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, DATA)
    mine = got.collect()
    if name in registry.ORACLE_SQL:
        run = db.execute(registry.ORACLE_SQL[name])
        columns = [d[0] for d in run.description]
        assert sorted(columns) == sorted(got.columns)
        assert rows(got.columns, mine) == rows(columns, run.fetchall())
    else:
        assert mine


SMALL_GROUPS = ["directed_relational", "directed_rightmost", "directed_warm_start", "generate_leftmost", "generate_merge", "generate_rightmost", "group_geometry", "lateral_offset", "spatial_context", "spatial_context_merge", "spatial_context_replace"]


@pytest.mark.parametrize("name", SMALL_GROUPS)
def test_groups_that_lack_lanes(spark, tmp_path, name):
    """One lane alone (the first, second, third, last; with a successor), two of five, and one group that is whole."""
    con = duckdb.connect()
    path = tmp_path / "embeddings.parquet"
    con.execute(f"copy (select * from '{DATA}/embeddings.parquet' where vec_id < 5 or vec_id in (5, 6, 10, 21, 27, 32, 35, 44, 49, 53, 54)) to '{path}' (format parquet)")
    con.execute(f"create view embeddings as select * from '{path}'")
    run = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in run.description]
    got = registry.QUERIES[name](spark, str(tmp_path))
    assert rows(got.columns, got.collect()) == rows(columns, run.fetchall())


def test_densified_lanes_are_spread_over_tasks(spark, tmp_path):
    """A lane's points are much work and few bytes: their number of tasks isn't that of the bytes."""
    rows = spark.range(60).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: (k / 64.0).cast("float")).alias("embedding"), F.lit(0).alias("label"))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = registry.QUERIES["densified_lanes"](spark, str(tmp_path))
    assert out.count() == 60
    assert out.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
