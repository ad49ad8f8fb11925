"""The fitted forest as a table, and rows scored on it.

A forest is one row for each node: ``tree, node, feature, categories, threshold, left, right,
late_share`` (``feature`` -1 for a leaf).  P(late) is the mean, over the trees and in their order, of
the late class's share among the (weighted) training rows of the leaf that a row falls into.

The forest is fitted on all training rows, so the table grows with them.  Up to ``BROADCAST_NODES`` nodes it is
sent to all tasks as arrays, and each task passes its rows, ``SCORE_ROWS`` at a time, down the trees:
the rows at a node are split in two by one column until only ``FEW_ROWS`` are there; from then on
each of them looks its node up, a level at a time.  A cell is coded as the number of thresholds below
it, which decides every split.  A larger forest is not made a table of nodes: the rows are sent to its cells
(:func:`emporion.operators.grow.scored_in_cells`).

A table of more nodes is scored by joins, which deal out rows and nodes by (tree, node): each (row, tree) starts at node 0
and walks one level for each join with the node table.  A row travels with its features other than
zero only (a one-hot row has one for each categorical column, plus the numeric ones).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from emporion.operators import features as H
from emporion.operators.grow import Forest, nodes_of, scored_in_cells
from emporion.session import materialize
from emporion.sources.adapter import StarSchema

BROADCAST_NODES = 100_000  # the driver holds them as Python objects for a moment
SCORE_ROWS = 1 << 18  # rows that a task passes down the trees at a time
SCORE_CELLS = 1 << 26  # and the most cells of them
FEW_ROWS = 256  # at a node: they go on one by one, together with those of other nodes


def node_table(forest: Forest, spark) -> DataFrame:
    """The nodes of a fitted forest."""
    return materialize(nodes_of(forest), "forest-nodes")


def _walker(nodes: DataFrame, keys: list[str], schema: pa.Schema) -> Callable:
    """The function of a task: batches of ``keys`` and a feature vector to ``keys``, ``p_late`` and
    ``prediction``.  It is self-contained, so that executors need no copy of this package."""
    t = nodes.select("tree", "node", "feature", "categories", "threshold", "left", "right", "late_share").toArrow()
    of = {c: t.column(c).combine_chunks() for c in t.column_names}
    number = {c: of[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tree", "node", "feature", "left", "right")}
    order = np.lexsort((number["node"], number["tree"]))
    tree, node, feature, left, right = (number[c][order] for c in ("tree", "node", "feature", "left", "right"))
    at = {x: i for i, x in enumerate(zip(tree.tolist(), node.tolist()))}
    inner = np.flatnonzero(feature >= 0)
    child = [(0, 0)] * len(tree)
    for i in inner.tolist():
        child[i] = at[tree[i], left[i]], at[tree[i], right[i]]
    roots = np.flatnonzero(node == 0).tolist()
    share = of["late_share"].to_numpy(zero_copy_only=False).astype(float)[order]
    threshold = of["threshold"].to_numpy(zero_copy_only=False).astype(float)[order]
    sets = of["categories"].take(pa.array(order)).to_pylist()
    # Per feature the values that its splits compare with, and per node the codes that go left: a range,
    # or, where a set of categories is none, a table of codes.
    cuts, nominal, table = {}, {}, {}
    low, high = np.zeros(len(tree), np.int64), np.zeros(len(tree), np.int64)
    for f in np.unique(feature[inner]).tolist():
        own = np.flatnonzero(feature == f).tolist()
        nominal[f] = any(sets[i] is not None for i in own)
        cuts[f] = np.unique([v for i in own for v in sets[i]] if nominal[f] else threshold[own])
        high[own] = 0 if nominal[f] else np.searchsorted(cuts[f], threshold[own])
        for i in own if nominal[f] else []:
            codes = np.unique(np.searchsorted(cuts[f], sets[i]))
            low[i], high[i] = codes[0], codes[-1]
            if len(codes) <= high[i] - low[i]:
                table[i] = np.append(np.isin(cuts[f], sets[i]), False)
    slots = {f: i for i, f in enumerate(cuts)}
    place = np.full(max(cuts, default=0) + 2, -1)
    place[list(cuts)] = range(len(cuts))
    values = [(cuts[f], nominal[f]) for f in cuts]
    code_type = np.min_scalar_type(max((len(c) for c in cuts.values()), default=0))
    feature = np.array([slots.get(f, -1) for f in feature.tolist()], np.int32)
    low, span = low.astype(code_type), (high - low).astype(code_type)
    children = np.array([(r, l) for l, r in child], np.int32).ravel()  # right, left of each node
    few = 0 if table else FEW_ROWS
    features, lows, spans, shares = feature.tolist(), list(low), list(span), share.tolist()
    unknown = bool(np.isnan(share[feature < 0]).any())

    def coded(x, cut, is_nominal):
        code = np.searchsorted(cut, x)
        if is_nominal:
            code[cut[np.minimum(code, len(cut) - 1)] != x] = len(cut)
        return code

    def cells(vectors):
        """(row, slot, value) of the cells of sparse and dense vectors."""
        kind, _, index, value = vectors.flatten()
        n = pc.fill_null(pc.list_value_length(value), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(n)), n)
        slot = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        slot[np.repeat(kind.to_numpy(zero_copy_only=False) == 0, n)] = index.flatten().to_numpy(zero_copy_only=False)
        return row, slot, value.flatten().to_numpy(zero_copy_only=False)

    def scored(batches, n):
        rows, base = [], 0
        for b in batches:
            row, slot, value = cells(b.column(b.num_columns - 1))
            own = place[np.minimum(slot, len(place) - 1)]
            some = own >= 0
            rows.append((row[some] + base, own[some], value[some]))
            base += b.num_rows
        row, own, value = (np.concatenate(x) for x in zip(*rows))
        by = np.argsort(own, kind="stable")
        edge = np.searchsorted(own[by], np.arange(len(values) + 1))
        codes = np.empty((len(values), n), code_type)
        for i, (cut, is_nominal) in enumerate(values):
            codes[i] = coded(np.zeros(1), cut, is_nominal)[0]
            here = by[edge[i] : edge[i + 1]]
            codes[i, row[here]] = coded(value[here], cut, is_nominal)
        columns, flat = list(codes), codes.ravel()
        total, counted = np.zeros(n), np.full(n, len(roots))
        for root in roots:
            waiting, last = [(root, np.arange(n))], []
            while waiting:
                at_node, who = waiting.pop()
                f = features[at_node]
                if f < 0:
                    if not unknown or shares[at_node] == shares[at_node]:
                        total[who] += shares[at_node]
                    else:
                        counted[who] -= 1
                elif len(who) <= few:
                    last.append((at_node, who))
                else:
                    x = columns[f].take(who)
                    go = table[at_node].take(x) if at_node in table else x - lows[at_node] <= spans[at_node]
                    for to, some in zip(child[at_node], (who[go], who[~go])):
                        if len(some):
                            waiting.append((to, some))
            if last:
                who = np.concatenate([w for _, w in last])
                now = np.repeat(np.array([x for x, _ in last], np.int32), [len(w) for _, w in last])
                while len(who):
                    f = feature.take(now)
                    ended = f < 0
                    if ended.any():
                        leaf = share.take(now[ended])
                        lost = np.isnan(leaf)
                        total[who[ended]] += np.where(lost, 0.0, leaf)
                        counted[who[ended]] -= lost
                        go_on = ~ended
                        who, now, f = who[go_on], now[go_on], f[go_on]
                    x = flat.take(f.astype(np.int64) * n + who)
                    now = children.take(2 * now + (x - low.take(now) <= span.take(now)))
        with np.errstate(invalid="ignore"):
            late = total / counted
        lost = np.isnan(late)
        given = pa.Table.from_batches(batches).select(keys).combine_chunks()
        out = [*given.columns, pa.array(late, mask=lost), pa.array((late > 0.5).astype(float), mask=lost)]
        return pa.table(out, schema=schema).to_batches(max_chunksize=10_000)

    most = max(1, min(SCORE_ROWS, SCORE_CELLS // max(1, len(values))))

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= most:
                yield from scored(held, n)
                held, n = [], 0
        if n:
            yield from scored(held, n)

    return run


def _joined(nodes: DataFrame, rows: DataFrame, keys: list[str], trees: int, depth: int, features: str) -> DataFrame:
    """``keys`` and ``p_late`` by joins with the node table, a level each."""
    inner = nodes.filter("feature >= 0").select(
        F.col("tree").alias("_t"), F.col("node").alias("_n"), "feature", "categories", "threshold", "left", "right")
    leaves = nodes.filter("feature < 0").select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "late_share")
    cells = F.filter(F.transform(vector_to_array(features), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda c: c["x"] != 0)
    state = rows.select(F.monotonically_increasing_id().alias("_row"), *keys, F.map_from_entries(cells).alias("_x"))
    state = state.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("_node", F.lit(0))
    at = (F.col("_tree") == F.col("_t")) & (F.col("_node") == F.col("_n"))
    for _ in range(depth):
        value = F.coalesce(F.try_element_at("_x", "feature"), F.lit(0.0))
        left = F.when(F.col("categories").isNull(), value <= F.col("threshold")).otherwise(F.array_contains("categories", value))
        step = F.when(F.col("feature").isNull(), F.col("_node")).when(left, F.col("left")).otherwise(F.col("right"))
        state = state.join(inner, at, "left").select("_row", *keys, "_x", "_tree", step.alias("_node"))
    # A share a tree, added up in the order of the trees: the same sum however the rows arrive.
    each = F.array_sort(F.collect_list(F.when(F.col("late_share").isNotNull(), F.struct("_tree", "late_share"))))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x["late_share"])
    late = F.try_divide(total, F.size(each)).alias("p_late")
    return state.join(leaves, at).groupBy("_row", *keys).agg(late).select(*keys, "p_late")


def score(nodes: DataFrame, rows: DataFrame, depth: int, features: str = "features") -> DataFrame:
    """``rows`` with ``p_late`` and ``prediction``; ``features`` is their feature vector, which the
    result leaves out.  ``depth``: levels below the roots."""
    keys = [c for c in rows.columns if c != features]
    trees, size = nodes.agg(F.max("tree") + 1, F.count(F.lit(1))).first()
    if size > BROADCAST_NODES:
        late = _joined(nodes, rows, keys, trees, depth, features)
        return late.withColumn("prediction", (F.col("p_late") > 0.5).cast("double"))
    given = rows.select(*keys, features)
    names = [ST.StructField(c, ST.DoubleType()) for c in ("p_late", "prediction")]
    out = ST.StructType([*given.schema.fields[:-1], *names])
    arrow = given.limit(0).drop(features).withColumns({"p_late": F.lit(0.0), "prediction": F.lit(0.0)}).toArrow().schema
    arrow = pa.schema([pa.field(f.name, f.type) for f in arrow])
    return given.mapInArrow(_walker(nodes, keys, arrow), out)


def scored(forest: Forest, rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` without the forest's coded columns and features, with ``p_late`` and ``prediction``, and the
    tables that this reads."""
    if forest.size > BROADCAST_NODES:
        return scored_in_cells(forest, rows)
    nodes = node_table(forest, rows.sparkSession)
    return score(nodes, rows.drop(*forest.columns), forest.depth, forest.features), [nodes]


def late_probabilities(star: StarSchema, key: str = "v2_balanced", seed: int = 42, **kw) -> DataFrame:
    """H8: label, P(late) and predicted class of every row of the test split, by a forest that is fitted on
    every row of the training split."""
    from emporion.operators import model as M

    v = M.VARIANTS[key]
    _, test, model = M.fit(M.prepared(star, v.table, seed), v, seed=seed, **kw)
    forest = model.stages[-1]
    encoded = PipelineModel(model.stages[:-1]).transform(test)
    rows = encoded.select("order_id", "order_item_id", F.col("label").cast("int").alias(H.LABEL), "features", *forest.columns)
    return scored(forest, rows)[0]
