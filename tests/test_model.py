"""Classifier on a planted signal (FIXTURES planted_signal) and metric bookkeeping."""

from pyspark.sql import functions as F

from emporion.operators import model as M
from tests_support import planted_star


def test_planted_signal_is_learned(spark):
    ev = M.evaluate(planted_star(spark), "v2_balanced", num_trees=20, max_depth=5)
    assert ev.auc > 0.95
    assert ev.importances[0][0] == "remainder__seller_customer_distance_km"
    assert abs(sum(v for _, v in ev.importances) - 1.0) < 1e-9  # importances sum to 1
    report = {r[0]: r for r in ev.report_rows()}
    assert report["accuracy"][4] == sum(ev.confusion.values())  # every test row counted once
    assert not any("unknown" in name for name, _ in ev.importances)  # no slot for unseen levels
    assert ev.weight_median is not None  # NULL weights were filled from the training split


def test_report_arithmetic():
    v = M.VARIANTS["v1_naive"]
    ev = M.Evaluation(v, None, {(0, 0): 50, (0, 1): 10, (1, 0): 20, (1, 1): 20}, 0.5)
    rows = {r[0]: r for r in ev.report_rows()}
    assert rows["late"][1:] == (20 / 30, 20 / 40, 2 * (2 / 3) * 0.5 / (2 / 3 + 0.5), 40)
    assert rows["accuracy"][3] == 70 / 100
    assert rows["weighted avg"][2] == (50 / 60 * 60 + 0.5 * 40) / 100


def test_forests_are_as_deep_as_the_engine_allows_by_default():
    import inspect

    default = inspect.signature(M.evaluate).parameters
    assert default["max_depth"].default == 30 and default["max_bins"].default == M.MAX_BINS


def test_metrics_of_a_rule_have_sql():
    from emporion.plans import catalog

    rows = {"h5_split_summary", "h7_class_weights", "b10_median_fill", "h9b_report_of_rule", "h10_auc_of_rule", "h11b_confusion_of_rule"}
    assert rows <= set(catalog.oracle_sql()) & set(catalog.queries())


def test_levels_come_from_all_training_rows(spark):
    from pyspark.sql import functions as F

    last = F.xxhash64("order_id", "order_item_id")
    table = M.prepared(planted_star(spark), "v2")
    rare = table.filter(~F.col("test")).orderBy(last.desc()).first()["order_id"]  # not among the forest's rows
    name = F.when(F.col("order_id") == rare, "rare").otherwise(F.col("product_category_name"))
    ev = M.evaluate(None, "v2_balanced", num_trees=3, max_depth=3, train_rows=100, table=table.withColumn("product_category_name", name))
    names = {n for n, _ in ev.importances if n.startswith("cat__product_category_name_")}
    assert names == {f"cat__product_category_name_{c}" for c in ("a", "b", "c", "rare")}


def test_a_signal_deeper_than_ten_is_learned(spark):
    from pyspark.sql import functions as F

    stripe = (F.col("id") % 60).cast("double")  # more stripes than 32 bins, in an order that no shallow tree follows
    late = (F.xxhash64(stripe) % 2 != 0).cast("double")
    table = spark.range(6000).select(
        F.col("id").cast("string").alias("order_id"), F.lit(1).alias("order_item_id"), F.lit("a").alias("product_category_name"),
        F.lit("SP").alias("seller_state"), *[stripe.alias(c) for c in ("price", "freight_value", "product_weight_g", "purchase_day_of_week")],
        late.alias("label"), (F.col("id") % 7 == 0).alias("test"),
    )
    kw = dict(num_trees=3, table=table)
    accuracy = lambda ev: sum(n for (a, p), n in ev.confusion.items() if a == p) / sum(ev.confusion.values())
    assert accuracy(M.evaluate(None, "v1_naive", **kw)) > 0.99
    assert accuracy(M.evaluate(None, "v1_naive", max_depth=5, **kw)) < 0.95
    assert accuracy(M.evaluate(None, "v1_naive", max_bins=32, **kw)) < 0.99


def test_forest_table_scores_like_the_model(spark):
    from emporion.operators import forest as T
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    star = planted_star(spark)
    M.evaluation(star, "v2_balanced", num_trees=7, max_depth=6)
    kw = dict(num_trees=7, max_depth=6)
    got = {r.order_id: r for r in T.late_probabilities(star, **kw).collect()}
    ev = M.evaluation(star, "v2_balanced", **kw)
    test = M.prepared(star, "v2").filter("test").withColumn("product_weight_g", F.coalesce(F.col("product_weight_g").cast("double"), F.lit(ev.weight_median)))
    want = ev.model.transform(test).select("order_id", "label", "prediction", vector_to_array("probability")[1].alias("p")).collect()
    assert len(got) == len(want) > 50
    for r in want:
        assert abs(got[r.order_id].p_late - r.p) < 1e-9 and got[r.order_id].prediction == r.prediction
        assert got[r.order_id].is_late == r.label


def test_forest_table_without_a_broadcast_gives_the_same(spark, monkeypatch):
    from emporion.operators import forest as T

    star = planted_star(spark)
    kw = dict(num_trees=3, max_depth=4)
    first = sorted(map(tuple, T.late_probabilities(star, **kw).collect()))
    monkeypatch.setattr(T, "BROADCAST_NODES", 0)
    assert sorted(map(tuple, T.late_probabilities(star, **kw).collect())) == first
    nodes = T.node_table(M.evaluation(star, "v2_balanced", **kw).model.stages[-1], spark)
    leaves = nodes.filter("feature < 0")
    assert leaves.filter("late_share IS NULL OR late_share NOT BETWEEN 0 AND 1").count() == 0
    assert nodes.count() == 2 * leaves.count() - 3  # a binary tree has one leaf more than inner nodes


def test_levels_are_numbered_densely_in_ranges(spark):
    from emporion.operators import encode as N

    rows = [(i, f"l{i % 700:03d}", None if i % 5 else "x") for i in range(3000)]
    train = spark.createDataFrame(rows, "id int, a string, b string")
    levels = N.level_table(train, ["a", "b"])
    got = [(r.slot, r.column_name, r.level) for r in levels.orderBy("slot").collect()]
    want = [("a", f"l{i:03d}") for i in range(700)] + [("b", N.NULL_LEVEL), ("b", "x")]
    assert got == [(i, *w) for i, w in enumerate(want)]
    test = spark.createDataFrame([(1, "l005", "x"), (2, "unseen", None), (3, "unseen", "new"), (4, "x", "l005")], "id int, a string, b string")
    hot = {(r.id, r.slot) for r in N.encoded(test, levels, ["a", "b"], ["id"]).collect()}
    assert hot == {(1, 5), (1, 701), (2, 700)}  # unseen levels, and levels of the other column: all zeros


def test_exact_split_meets_the_quota_of_every_class(spark):
    from emporion.operators import features as H

    rows = [(i, 1, i % 3 == 0) for i in range(1000)] + [(7, 1, True)] * 400 + [(5000 + i, 1, None) for i in range(13)]
    df = spark.createDataFrame([(o, n, None if x is None else int(x)) for o, n, x in rows], "order_id int, order_item_id int, is_late int")
    for pct in (20, 50, 0, 100):
        out = H.exact_split(df, test_pct=pct)
        assert out.count() == len(rows)
        got = {r.is_late: (r.n, r.t) for r in out.groupBy("is_late").agg(F.count("*").alias("n"), F.count_if("test").alias("t")).collect()}
        assert got == {c: (n, (n * pct + 50) // 100) for c, n in {0: 666, 1: 734, None: 13}.items()}
    again = [r.order_id for r in H.exact_split(df).filter("test").orderBy("order_id").collect()]
    assert again == [r.order_id for r in H.exact_split(df.repartition(3, "order_id")).filter("test").orderBy("order_id").collect()]
    assert H.exact_split(df.limit(0)).count() == 0


def test_forest_arrays_walk_like_the_joins_on_every_kind_of_split(spark, monkeypatch):
    import math

    from emporion.operators import forest as T
    from pyspark.ml.linalg import Vectors

    leaf = lambda t, n, share: (t, n, -1, None, None, -1, -1, share)
    nodes = spark.createDataFrame([
        (0, 0, 1, None, 2.5, 1, 2, None), (0, 1, 0, [0.0, 3.0], None, 3, 4, None), leaf(0, 2, 0.9), leaf(0, 3, 0.1), leaf(0, 4, None),
        (1, 0, 2, [1.0], None, 1, 2, None), leaf(1, 1, 0.25), (1, 2, 1, None, -1.0, 3, 4, None), leaf(1, 3, 0.5), leaf(1, 4, 0.75),
    ], "tree int, node int, feature int, categories array<double>, threshold double, left int, right int, late_share double")
    rows = [(i, Vectors.dense([i % 5, x, i % 2, 0, 0, 7]) if i % 3 else Vectors.sparse(6, [(0, i % 5), (1, x), (2, i % 2), (5, 7)]))
            for i in range(400) for x in (2.5, 2.6, -1.0, 0.0, math.inf, math.nan)]
    rows = spark.createDataFrame(rows, ["id", "features"]).repartition(3)
    near = lambda df: sorted(map(str, df.collect()))
    for few in (256, 0):  # by nodes only, and row by row
        monkeypatch.setattr(T, "FEW_ROWS", few)
        monkeypatch.setattr(T, "BROADCAST_NODES", 1_000_000)
        found = T.score(nodes, rows, 2)
        assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()  # no row a tree
        got = near(found)
        monkeypatch.setattr(T, "BROADCAST_NODES", 0)
        assert got == near(T.score(nodes, rows, 2)) and len(got) == 2400
    binary = nodes.withColumn("categories", F.when(F.size("categories") > 1, F.array(F.lit(0.0))).otherwise(F.col("categories")))
    want = near(T.score(binary, rows, 2))
    monkeypatch.setattr(T, "BROADCAST_NODES", 1_000_000)
    for few in (256, 0):
        monkeypatch.setattr(T, "FEW_ROWS", few)
        assert near(T.score(binary, rows, 2)) == want


def test_variants_of_a_family_share_their_table(spark, monkeypatch):
    star, made, real = planted_star(spark), [], M.prepared
    monkeypatch.setattr(M, "prepared", lambda star, which, seed=42: made.append(which) or real(star, which, seed))
    first = M.evaluations(star, list(M.VARIANTS), num_trees=2, max_depth=3)
    assert made == ["v1", "v2"] and [e.variant for e in first] == list(M.VARIANTS.values())
    assert M.evaluation(star, "v1_balanced", num_trees=2, max_depth=3) is first[1] and made == ["v1", "v2"]
