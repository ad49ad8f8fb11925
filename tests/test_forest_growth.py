"""The forest is fitted on every training row: against brute force, and however its nodes are dealt out."""

import math

import numpy as np
from pyspark.sql import functions as F

from emporion.operators import forest as T
from emporion.operators import grow as G
from emporion.operators import model as M
from emporion.operators import trees as K


def rows_of(spark, n, late):
    """Rows of the v1 table; ``hash``: what the forest once took its rows by, the 5,000 smallest."""
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double")
    table = spark.range(n).withColumn("order_id", F.col("id").cast("string")).withColumn("order_item_id", F.lit(1))
    table = table.withColumn("hash", F.xxhash64("order_id", "order_item_id")).withColumn("label", late.cast("double"))
    return table.select(
        "order_id", "order_item_id", F.lit("a").alias("product_category_name"), F.when(F.col("hash") > 0, "SP").otherwise("RJ").alias("seller_state"),
        noise.alias("price"), (F.col("hash") / 2.0**63).alias("freight_value"), noise.alias("product_weight_g"),
        (F.col("id") % 7).cast("double").alias("purchase_day_of_week"), "label", (F.col("id") % 5 == 0).alias("test"),
    )


def test_every_training_row_is_in_the_forest(spark):
    table = rows_of(spark, 8000, F.col("hash") > F.lit(int(0.8 * 2**63)))  # late rows: the tenth with the largest hashes
    late = table.filter("test AND label = 1").count()
    for key in ("v1_balanced", "v1_naive"):
        ev = M.evaluate(None, key, num_trees=10, table=table)
        assert late > 100 and ev.confusion.get((1, 1), 0) > 0.95 * late and ev.auc > 0.99
    few = M.evaluate(None, "v1_naive", num_trees=10, train_rows=5000, table=table)  # a caller's own bound
    assert few.confusion == {(0, 0): 1600 - late, (1, 0): late}


def test_drawn_rows_of_all_trees_add_up_to_the_whole_split():
    keys = K.mixed(np.arange(50_000, dtype=np.uint64))
    table = K.poisson_table()
    w = np.array([K.draws(keys, t, 42, table) for t in range(40)])
    assert (w.sum(0) > 0).all()  # no row is left out of all trees
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - math.exp(-1)) < 0.01
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.02
    lay = K.Layout((2,), (0,), (False,), 81, 9, 42, (1.0, 1.0), 30)
    S = np.sort(K.picked(np.arange(20_000), 3, lay), 1)
    assert (np.diff(S, axis=1) > 0).all() and S.min() == 0 and S.max() == 80  # distinct slots
    n = np.bincount(S.ravel(), minlength=81)
    assert abs(n - n.mean()).max() < 6 * math.sqrt(n.mean())  # each as often


def test_cuts_are_quantiles_of_all_rows(spark):
    rng = np.random.default_rng(1)
    many = np.concatenate([rng.lognormal(3, 2, 40_000), -rng.lognormal(1, 1, 9_000), np.full(15_000, 7.5), [math.inf, -math.inf, 0.0, -0.0]])
    few = rng.integers(0, 50, len(many)) / 4
    few[5] = 1000.0  # one row alone
    df = spark.createDataFrame([(float(a), float(b), 3) for a, b in zip(many, few)] + [(math.nan, None, 3), (None, math.nan, 3)], "many double, few double, one int").repartition(5)
    got = G.cuts_of(df, ["many", "few", "one"], 128)
    values = np.unique(few)
    assert got["few"].tolist() == ((values[1:] + values[:-1]) / 2).tolist() and len(got["one"]) == 0
    ordered = np.sort(many)
    want = np.unique([ordered[math.ceil(i * len(many) / 128) - 1] for i in range(1, 128)])
    assert len(got["many"]) == len(want)
    np.testing.assert_allclose(got["many"], want, rtol=2e-6)
    assert (got["many"] >= want).all()


def brute(rec, tree, lay, node=0, depth=0):
    """id -> (slot, cut) or the late share, by trying every split of every node."""
    cw, column, level = lay.class_weights, *lay.by_slot()
    w, y = rec[:, -1] >> 1, rec[:, -1] & 1
    weigh = lambda some: (cw[0] * float(w[some & (y == 0)].sum()), cw[1] * float(w[some & (y == 1)].sum()))
    gini = lambda a, b: 2 * a * b / (a + b) if a + b else 0.0
    a, b = weigh(np.ones(len(rec), bool))
    best = (K.GAIN * gini(a, b), None)
    if a and b and depth < lay.max_depth:
        for s in K.picked(np.array([node]), tree, lay)[0].tolist():
            c = column[s]
            for cut in [0] if level[s] >= 0 else range(lay.sizes[c] - 1):
                right = rec[:, c] == level[s] if level[s] >= 0 else rec[:, c] > cut
                gain = gini(a, b) - gini(*weigh(right)) - gini(*weigh(~right))
                if gain > best[0] + 1e-9:
                    best = (gain, (s, cut, right))
    if best[1] is None:
        return {node: b / (a + b)}
    s, cut, right = best[1]
    return {node: (s, cut), **brute(rec[~right], tree, lay, 2 * node + 1, depth + 1), **brute(rec[right], tree, lay, 2 * node + 2, depth + 1)}


def test_trees_take_the_best_split_of_their_picks(monkeypatch):
    rng = np.random.default_rng(2)
    sizes, numeric = (6, 4, 20, 1, 7), (False, False, True, True, True)
    for tree, (n, depth, weights) in enumerate([(400, 30, (0.7, 1.9)), (300, 4, (1.0, 1.0)), (1, 30, (1.0, 1.0)), (60, 30, (1.0, 3.0))]):
        lay = K.Layout(sizes, (0, 5, 8, 9, 10), numeric, 11, 4, 42, weights, depth)
        rec = np.column_stack([*[rng.integers(0, s - (not x), n) for s, x in zip(sizes, numeric)], 2 * rng.integers(1, 4, n) + (rng.random(n) < 0.4)]).astype(np.uint8)
        want = brute(rec, tree, lay)
        for block in (1 << 17, 50):  # nodes together, and large ones by themselves
            monkeypatch.setattr(K, "BLOCK_ROWS", block)
            slot, cut, share, levels, _ = K.grown(rec, tree, 0, 0, lay)
            ids = K.heap_ids(slot, 0).tolist()
            got = {i: (s, c) if s >= 0 else x for i, s, c, x in zip(ids, slot.tolist(), cut.tolist(), share.tolist())}
            assert got.keys() == want.keys() and levels == max(int(i + 1).bit_length() - 1 for i in ids)
            for i, x in want.items():
                assert got[i] == x if isinstance(x, tuple) else abs(got[i] - x) < 1e-12
            leaf = K.walked(rec[:, :-1], slot, cut, lay)
            assert (slot[leaf] < 0).all() and len(np.unique(leaf)) == (slot < 0).sum()


def test_cells_grow_and_score_the_same_forest(spark, monkeypatch):
    table = rows_of(spark, 6000, F.pmod(F.xxhash64("id"), F.lit(3)) == 0)
    v, kw = M.VARIANTS["v1_naive"], dict(num_trees=5, max_depth=12)

    def fitted():
        _, test, model = M.fit(table, v, **kw)
        forest = model.stages[-1]
        encoded = M.PipelineModel(model.stages[:-1]).transform(test).select("order_id", "label", "features", *forest.columns)
        nodes = sorted(map(str, T.node_table(forest, spark).collect()))
        return forest, nodes, lambda: sorted(map(str, T.scored(forest, encoded)[0].collect()))

    forest, nodes, score = fitted()
    late = score()
    assert len(forest.ends) == 5 and forest.size == len(nodes) > 500 and len(late) == 1200
    monkeypatch.setattr(T, "BROADCAST_NODES", 0)
    assert score() == late  # in cells as with the nodes sent to every task
    monkeypatch.setattr(G, "CELL_ROWS", 300)  # many cells, below a top that several passes split
    monkeypatch.setattr(G, "TURN_BYTES", 1)  # a tree at a time
    monkeypatch.setattr(G, "CHUNK_ROWS", 700)
    cut_up, again, score = fitted()
    assert len(cut_up.ends) > 50 and again == nodes and score() == late
    np.testing.assert_allclose(cut_up.featureImportances.toArray(), forest.featureImportances.toArray(), rtol=1e-9)


def test_importances_and_comparison_see_a_signal_past_the_first_rows(spark):
    table = rows_of(spark, 8000, F.col("hash") > F.lit(int(0.8 * 2**63)))
    kw = dict(num_trees=10, table=table)
    every, few = M.evaluate(None, "v1_naive", **kw), M.evaluate(None, "v1_naive", train_rows=5000, **kw)
    assert every.importances[0][0] == "remainder__freight_value" and every.importances[0][1] > 0.5  # h12
    assert {x for _, x in few.importances} == {0.0}
    assert every._pr(1)[1] > 0.95 and every.auc > 0.99 and few._pr(1)[1] == 0 and few.auc == 0.5  # h13
