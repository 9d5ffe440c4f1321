"""Values of what has no SQL: fitted trees, clusters, grids of parameters, and jobs made of them."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkbars.operators import engines, metrics, ml
from sparkbars.operators import indicators as I
from sparkbars.plans import jobs, queries
from sparkbars.plans.inputs import FEATURES, features


def test_trees_learn_what_is_there(spark):
    """A label that two columns decide is found on later rows; the noise column is not used much; rows with a gap go."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 3))
    rows = [("s", n, *map(float, v), int((v[0] > 0) != (v[1] > 0.5))) for n, v in enumerate(x)]
    rows[7] = ("s", 7, None, 0.0, 0.0, 1)
    frame = spark.createDataFrame(rows, "symbol string, ts long, a double, b double, c double, label int")
    model = ml.gbt_train(frame.filter("ts < 1000"), ["a", "b", "c"])
    got = ml.gbt_predict(frame, ["a", "b", "c"], model).toPandas()
    assert len(got) == 1499 and got.prob.between(0, 100).all()
    late = got[got.ts >= 1000]
    assert ((late.prob > 50) == (late.label == 1)).mean() > 0.95
    shares = dict(ml.importances(model, ["a", "b", "c"]))
    assert shares["c"] < 0.15


def test_trees_do_not_see_later_rows(spark, small):
    """The same model from rows up to a time, whatever comes after."""
    b = I.barrier_label(features(spark, small)).filter("ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    cols = ["ret1", "ret5", "z20", "atr_ratio"]
    changed = b.unionByName(b.limit(20).withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 DAYS")).withColumn("label", F.lit(None).cast("int")))
    one, two = (ml.gbt_predict(b, cols, ml.gbt_train(x, cols)).orderBy("symbol", "ts").toPandas().prob for x in (b, changed))
    assert np.allclose(one, two)


def test_gbt_query_has_each_whole_row(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{small}/events.parquet'")
    want = con.sql(f"WITH {FEATURES} SELECT count(*) FROM features WHERE ret1 IS NOT NULL AND ret5 IS NOT NULL AND z20 IS NOT NULL AND atr_ratio IS NOT NULL").fetchall()[0][0]
    got = queries.QUERIES["gbt_predict"](spark, small).toPandas()
    assert len(got) == want == len(got.drop_duplicates(["symbol", "ts"])) and got.prob.between(0, 100).all() and got.prob.nunique() > 1


def test_clusters_of_blobs(spark):
    rng = np.random.default_rng(3)
    centres = [(0.0, 0.0), (9.0, 0.0), (0.0, 9.0)]
    rows = [(f"a{k}", f"h{n % 2}", *map(float, rng.normal(c, 0.3)), k) for k, c in enumerate(centres) for n in range(30 + 10 * k)]
    frame = spark.createDataFrame(rows, "asset string, hypothesis string, x double, y double, blob int")
    clusters, cost = ml.kmeans(frame, ["x", "y"], (2, 3))
    assert cost[3] < cost[2] / 10
    p = clusters.toPandas()
    assert p.groupby("blob").cluster.nunique().eq(1).all() and p.cluster.nunique() == 3
    got = metrics.cluster_profiles(clusters, ["x", "y"]).toPandas().set_index("cluster")
    for k, part in p.groupby("cluster"):
        blob = part.blob.iloc[0]
        assert got.n[k] == 30 + 10 * blob and got.mean_x[k] == pytest.approx(part.x.mean()) and got.mean_y[k] == pytest.approx(part.y.mean())
        assert got.top_asset[k] == f"a{blob}:{len(part)}"


def test_failure_clusters_keep_all_failures(spark, small):
    got = queries.QUERIES["failure_clusters"](spark, small).toPandas()
    fails = queries.results(spark, small).filter("oos_verdict = 'FAIL' AND test_pf IS NOT NULL AND test_sharpe IS NOT NULL")
    assert got.n.sum() == fails.count() and 2 <= len(got) <= 5
    assert (got.n * got.mean_test_sharpe).sum() == pytest.approx(fails.agg(F.sum("test_sharpe")).first()[0], abs=1e-3)


def test_cells_go_by_the_columns_that_spread(spark):
    """Points that differ in the third column alone: as many neighbours as by brute force."""
    rng = np.random.default_rng(5)
    p = np.round(np.column_stack([np.zeros(300), rng.uniform(0, 0.1, 300), rng.uniform(0, 40, 300)]), 3)
    frame = spark.createDataFrame([(n, *map(float, v)) for n, v in enumerate(p)], "k int, x double, y double, z double")
    got = {r.k: r.neighbours for r in ml.dbscan_core(frame, ["x", "y", "z"], 0.5, 4, "k").collect()}
    near = (((p[:, None] - p[None]) ** 2).sum(2) <= 0.25).sum(1)
    assert [got[k] for k in range(300)] == near.tolist()
    assert ml._points(frame, ["x", "y", "z"], 0.5, ml._spread(frame, ["x", "y", "z"])).select("_x", "_y").distinct().count() > 50


def test_grid_is_each_combination_alone(spark, small):
    """Two combinations at once, and each through the scan of one signal."""
    b = jobs._live(spark, small).select("symbol", "ts", "close", "atr", "rsi_w")
    side = lambda g: F.when(F.col("rsi_w") < g, 1).when(F.col("rsi_w") > 100 - g, -1).otherwise(0)
    combos, exits = [44, 48], [(2.0, 3.0), (2.5, 4.0)]
    got = engines.close_only_grid(b, F.array(*(side(g) for g in combos)), exits).toPandas()
    for k, (g, (sl, tp)) in enumerate(zip(combos, exits)):
        want = engines.close_only_trades(b.withColumn("signal", side(g)), sl, tp).toPandas()
        mine = got[got.combo == k].sort_values(["symbol", "exit_idx"]).reset_index(drop=True)
        want = want.sort_values(["symbol", "exit_idx"]).reset_index(drop=True)
        assert len(want) > 5
        pd.testing.assert_series_equal(mine.pnl, want.pnl, check_names=False)
        assert mine.exit_idx.tolist() == want.exit_idx.tolist() and mine.symbol.tolist() == want.symbol.tolist()
