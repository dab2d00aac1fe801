"""Losses over whole tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vialattice.operators import match
from vialattice.plans import match_queries
from vialattice.plans.fixtures import index


def test_every_lane_has_a_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).tolist(), 0) for k in [*range(1130), 1500]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["lane"]: r for r in match_queries.infonce_batches(spark, str(tmp_path)).collect()}
    assert sorted(got) == [*range(1130), 1500] and {r["batch"] for r in got.values()} == {0, 1, 2, 3}
    assert (got[1500]["loss"], got[1500]["n_pos"]) == (None, 0) and all(r["loss"] > 0 and r["n_pos"] for k, r in got.items() if k < 1000)
    # the same as by pairs
    batch = index(spark, str(tmp_path)).where("lane >= 500 and lane < 1000")
    e = {r["lane"]: np.array(r["e"]) for r in batch.collect()}
    pairs = {(r["i"], r["j"]) for r in match.positive_pairs(batch).collect()}
    for a in range(500, 1000, 37):
        x = {b: np.exp(e[a] @ e[b] / 0.07) for b in e if b != a}
        own = [x[b] for b in x if (min(a, b), max(a, b)) in pairs]
        assert abs(np.log(sum(x.values())) - np.log(sum(own)) - got[a]["loss"]) < 1e-5 and len(own) == got[a]["n_pos"]


def test_loss_of_three_lanes(spark):
    """Lanes 0 and 1 are positives of each other, 2 of none: log(exp(s01) + exp(s02)) - s01 for lane 0."""
    rows = [(0, "a", 0.0, True, False, [0.0, 1.0], [1.0, 0.0]), (1, "b", 0.0, True, False, [0.0, 1.0], [0.6, 0.8]), (2, "c", 1.0, False, True, [1.0, 0.0], [0.0, 1.0])]
    batch = spark.createDataFrame(rows, "lane long, camera string, rank double, is_left boolean, is_right boolean, role array<double>, e array<double>")
    got = {r["lane"]: (r["loss"], r["n_pos"]) for r in match.info_nce_batches(batch, temperature=1.0).collect()}
    assert abs(got[0][0] - (np.log(np.exp(0.6) + np.exp(0.0)) - 0.6)) < 1e-12 and abs(got[1][0] - (np.log(np.exp(0.6) + np.exp(0.8)) - 0.6)) < 1e-12
    assert got[0][1] == got[1][1] == 1 and got[2] == (None, 0)
    # of two positives the sum counts, not the mean
    rows.append((3, "d", 0.0, True, False, [0.0, 1.0], [0.8, 0.6]))
    more = {r["lane"]: r["loss"] for r in match.info_nce_batches(spark.createDataFrame(rows, batch.schema), temperature=1.0).collect()}
    assert abs(more[0] - (np.log(np.exp(0.6) + 1 + np.exp(0.8)) - np.log(np.exp(0.6) + np.exp(0.8)))) < 1e-12


def test_groups_to_match_grow_with_the_table(spark, tmp_path):
    rng = np.random.default_rng(3)
    for n in (200, 1000):
        rows = [(k, rng.normal(size=8).tolist(), 0) for k in range(n)]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        got = match_queries.heading_match_all(spark, f"{tmp_path}/{n}").collect()
        assert sorted(r["query"] for r in got) == [*range(n)] and all(r["group_id"] // 10 == r["query"] // 50 for r in got)
        assert len({r["group_id"] for r in got}) > n / 5 * 0.7


def test_positive_pairs_across_blocks(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).tolist(), 0) for k in range(230)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    lanes = index(spark, str(tmp_path))
    got = [(r["i"], r["j"]) for r in match.positive_pairs(lanes, block=7).collect()]
    t = lanes.orderBy("lane").toPandas()
    i, j = np.nonzero(np.triu(match._positives(t, match.DEFAULT)))
    assert sorted(got) == list(zip(t.lane[i], t.lane[j], strict=True)) and len(got) > 3000


def test_pairs_of_two_blocks_come_in_slices(spark):
    """No more than a slice is held at a time, however many pairs two blocks have; lanes without a camera have none."""
    n = 900
    rows = [(k, None if k % 300 == 7 else f"c{k // 50}", 0.0, True, False, [1.0, 0.0]) for k in range(n)]
    lanes = spark.createDataFrame(rows, "lane long, camera string, rank double, is_left boolean, is_right boolean, role array<double>")
    of = np.array([-1 - k if r[1] is None else k // 50 for k, r in enumerate(rows)])
    want = np.triu((of[:, None] != of) & (of[:, None] >= 0) & (of >= 0), 1)
    got = match.positive_pairs(lanes)
    for block in (1024, 400):
        pairs = match.positive_pairs(lanes, block=block).toPandas()
        assert len(pairs) == want.sum() and want[pairs.i, pairs.j].all() and not pairs.duplicated().any()
    assert got.schema.simpleString() == "struct<i:bigint,j:bigint>"
    held = [r.num_rows for r in match._expanded(iter([match._met(lanes, match.DEFAULT, 1024).toArrow().combine_chunks().to_batches()[0]]))]
    assert sum(held) == want.sum() and len(held) > 2 and max(held) <= match.SLICE


def test_pair_stats_of_any_ranks(spark):
    """Quartiles of pairs by kind over several blocks, with many different ranks and vectors that are equal or opposite."""
    rng = np.random.default_rng(11)
    e = rng.normal(size=(150, 6))
    e[10:20], e[20] = e[9], -e[9]
    e /= np.sqrt((e * e).sum(1))[:, None]
    camera, grp, rank = np.arange(150) // 12, np.arange(150) // 4, rng.random(150)
    rank[::7] = 0.5
    df = spark.createDataFrame([(k, f"c{camera[k]}", int(grp[k]), float(rank[k]), e[k].tolist()) for k in range(150)], "lane long, camera string, grp long, rank double, e array<double>")
    got = {r["kind"]: r for r in match.pair_type_stats(df, block=40).collect()}
    i, j = np.triu_indices(150, 1)
    same = camera[i] == camera[j]
    kind = np.where(same, np.where(grp[i] == grp[j], 0, 1), np.where(np.round(np.abs(rank[i] - rank[j]), 9) < 0.15, 2, 3))
    sim = (e[i] * e[j]).sum(1)
    for k, name in enumerate(match.KINDS):
        want = sim[kind == k]
        assert got[name]["n"] == len(want)
        assert [got[name][c] for c in ("q1", "median", "q3", "mean")] == pytest.approx([*np.quantile(want, [0.25, 0.5, 0.75]), want.mean()], abs=1e-9)


def test_pair_stats_shuffle_grows_with_the_lanes(spark):
    rows = spark.range(40_000).select(F.col("id").alias("lane"), F.lit("c").alias("camera"), F.lit(0).alias("grp"), F.lit(0.0).alias("rank"), F.array(F.lit(1.0)).alias("e"))
    assert match._grid(rows, None).count() <= 16 * 40_000


def test_nearest_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(stream):
        for t in stream:
            made.add(len(t))
            yield t

    rows = spark.createDataFrame([(k, f"c{k % 3}", [float(k), 1.0]) for k in range(30)], "lane long, camera string, e array<double>").mapInPandas(count, "lane long, camera string, e array<double>")
    assert match.nearest(rows, rows).count() == 30
    assert made.value == 30
