"""A random forest grown on all training rows, and rows scored on it where it is large.

Every tree draws its rows from the whole training split (a bootstrap: each row's number of draws is Poisson
with mean 1, by a hash of its key), and the cuts of a numeric column are quantiles of all training rows.
Nothing is fitted on the driver, which holds neither rows nor the trees' nodes:

* :func:`cuts_of` counts the rows below ever finer prefixes of the values; the rows are then written once as
  records of small integers (:mod:`emporion.operators.trees`).
* While a node of a tree has more than ``CELL_ROWS`` rows, one pass over the records counts, for such nodes of
  all trees, the rows by picked slot, code and class; a task for each tree adds the counts up and takes the
  split.  This top of the forest has a few nodes for each ``CELL_ROWS`` rows of a tree.
* A smaller node is a cell: its rows are packed and sent to one task, which grows all that is below.  Trees are
  dealt out in turns, so that their rows (``TURN_BYTES`` at a time) do not lie on disk at once.

The nodes stay in the shared folder, a row a cell.  A forest too large to be sent to each task is scored in
the same way: test rows pass its top, are packed and sent to the cells, walk down there, and their shares
come back, a sum in the order of the trees.
"""

from __future__ import annotations

import math
import pickle
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emporion.operators.trees import (
    Layout, add_counts, best_cut, decided, draws, grown, heap_ids, numeric_counts, passed, picked, poisson_table, walked,
)
from emporion.session import drop_scratch, materialize, scratch_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

CELL_ROWS = 20_000_000  # drawn rows of a node whose subtree one task grows: about 10 bytes each
TURN_BYTES = 4 << 30  # of rows that are dealt out to cells at a time
CHUNK_ROWS = 1 << 16
CELLS = "end int, tree int, root bigint, depth int, n int, slots binary, cuts binary, shares binary, gains binary"
OPEN, INNER, LEAF, CELL = range(4)


# ---- cuts of numeric columns --------------------------------------------------------------
def _ordered(x):
    """Doubles as unsigned integers in the same order."""
    b = (np.ascontiguousarray(x, np.float64) + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(b & top, ~b, b | top)


def _value(u) -> float:
    u = np.uint64(u)
    top = np.uint64(1 << 63)
    return float(np.array([u ^ top if u & top else ~u], np.uint64).view(np.float64)[0])


def _counts_below(rows: DataFrame, columns: list[str], wanted: dict[str, np.ndarray], had: int, bits: int, most: int) -> dict:
    """Rows by the first ``had + bits`` bits of each column's value, of those whose first ``had`` bits are
    wanted; on the first pass (``had`` 0) also the column's values, up to ``most`` + 1 from each task."""
    prefixes = [wanted[c] for c in columns]
    rows_at_once = 4 * CHUNK_ROWS

    def joined(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= rows_at_once:
                yield pa.Table.from_batches(held)
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        found = [np.zeros(len(p) << bits, np.int64) for p in prefixes]
        values = [np.zeros(0, np.uint64) for _ in prefixes]
        for b in joined(batches):
            for i, p in enumerate(prefixes):
                x = b.column(i).to_numpy().astype(np.float64)
                u = _ordered(x[~np.isnan(x)])
                for part in np.array_split(u, 1 + len(u) // 10_000) if not had else ():
                    if len(values[i]) <= most:
                        values[i] = np.unique(np.concatenate([values[i], part]))[: most + 1]
                above = u >> np.uint64(64 - had) if had else np.zeros(len(u), np.uint64)
                at = np.searchsorted(p, above)
                ok = p[np.minimum(at, len(p) - 1)] == above
                below = (u[ok] >> np.uint64(64 - had - bits)) & np.uint64((1 << bits) - 1)
                found[i] += np.bincount((at[ok] << bits) + below.astype(np.int64), minlength=len(found[i]))
        for i, n in enumerate(found):
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i), pa.int32()), pa.array(np.full(len(some), False)),
                                              pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], names=["i", "is_value", "x", "n"])
            v = values[i].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i), pa.int32()), pa.array(np.full(len(v), True)),
                                              pa.array(v, pa.int64()), pa.array(np.ones(len(v)), pa.int64())], names=["i", "is_value", "x", "n"])

    got = rows.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(run, "i int, is_value boolean, x bigint, n bigint")
    out = {c: ([], []) for c in columns}
    for r in got.groupBy("i", "is_value", "x").agg(F.sum("n").alias("n")).orderBy("i", "x").collect():
        c = columns[r["i"]]
        out[c][r["is_value"]].append((r["x"], r["n"]))
    return {c: ([(int(wanted[c][x >> bits]) << bits | x & ((1 << bits) - 1), n) for x, n in ns], vs) for c, (ns, vs) in out.items()}


def cuts_of(rows: DataFrame, columns: list[str], max_bins: int) -> dict[str, np.ndarray]:
    """The values that splits of each column compare with, from all rows: the middles between its values, if
    these are ``max_bins`` at most, else the ``max_bins``-quantiles, each rounded up within the 32 leading
    bits of a double (a part in a million).  No row reaches the driver, only counts by prefix."""
    out: dict[str, np.ndarray] = {}
    wanted = {c: np.zeros(1, np.uint64) for c in columns}
    ranks: dict[str, list[tuple[int, int, int]]] = {}  # rank, prefix that holds it, rows before that prefix
    for had, bits in ((0, 16), (16, 8), (24, 8)):
        left = [c for c in columns if c not in out]
        if not left:
            break
        for c, (counts, values) in _counts_below(rows, left, wanted, had, bits, max_bins).items():
            if not had and len(values) <= max_bins:
                v = np.array(sorted(_value(x % 2**64) for x, _ in values))
                with np.errstate(invalid="ignore"):
                    middle = v[:-1] / 2 + v[1:] / 2
                out[c] = np.where(np.isfinite(middle) & (middle < v[1:]), middle, v[:-1])
                continue
            n = sum(k for _, k in counts)
            at = ranks[c] if had else [(math.ceil(i * n / max_bins), 0, 0) for i in range(1, max_bins)]
            below: dict[int, list[tuple[int, int]]] = {}
            for x, k in counts:
                below.setdefault(x >> bits, []).append((x, k))
            ranks[c] = []
            for rank, prefix, before in at:
                for x, k in sorted(below[prefix] if had else counts):
                    if before + k >= rank:
                        break
                    before += k
                ranks[c].append((rank, x, before))
            wanted[c] = np.array(sorted({x for _, x, _ in ranks[c]}), np.uint64)
            if had + bits == 32:
                ends = [_value(x << 32 | 0xFFFFFFFF) for x in wanted[c].tolist()]
                out[c] = np.array([math.inf if math.isnan(x) else x for x in ends])
    return out


# ---- coded rows ---------------------------------------------------------------------------
def _coder(cuts: list, dtype):
    """Codes of a batch whose first columns are the layout's; ``cuts`` has None for a categorical column."""

    def codes(b, width):
        out = np.empty((b.num_rows, width), dtype)
        for i, cut in enumerate(cuts):
            x = b.column(i).to_numpy(zero_copy_only=False)
            out[:, i] = x if cut is None else np.searchsorted(cut, x.astype(np.float64))
        return out

    return codes


def _row(schema: pa.Schema, *values):
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def _records(rows: DataFrame, columns: list[str], cuts: list, dtype, keys: list[str], label: str) -> DataFrame:
    """The rows as packed records: ``n``, their keys' hashes, the codes with the label."""
    code, width, most = _coder(cuts, dtype), len(columns) + 1, CHUNK_ROWS
    schema = pa.schema([("n", pa.int32()), ("keys", pa.binary()), ("codes", pa.binary())])

    def run(batches):
        held, n = [], 0

        def packed():
            return _row(schema, n, np.concatenate([k for k, _ in held]).tobytes(), np.concatenate([c for _, c in held]).tobytes())

        for b in batches:
            c = code(b, width)
            c[:, -1] = b.column(width - 1).to_numpy(zero_copy_only=False)
            held.append((b.column(width).to_numpy(zero_copy_only=False).astype(np.int64), c))
            n += len(c)
            if n >= most:
                yield packed()
                held, n = [], 0
        if n:
            yield packed()

    given = rows.select(*columns, F.col(label).cast("int"), F.xxhash64(*keys))
    return materialize(given.mapInArrow(run, "n int, keys binary, codes binary"), "forest-rows")


# ---- the top of the forest ----------------------------------------------------------------
class _Top:
    """The nodes of all trees down to their cells, on the driver."""

    def __init__(self, trees: int, state: int):
        self.tree, self.id, self.depth = list(range(trees)), [0] * trees, [0] * trees
        self.slot, self.cut, self.first = [-1] * trees, [0] * trees, [0] * trees
        self.share, self.gain, self.state = [math.nan] * trees, [0.0] * trees, [state] * trees

    def arrays(self):
        return np.array(self.slot), np.array(self.cut), np.array(self.first)

    def of(self, *states: int) -> list[int]:
        return [i for i, s in enumerate(self.state) if s in states]

    def add(self, parent: int, side: int, n0: int, n1: int, lay: Layout) -> None:
        self.tree.append(self.tree[parent])
        self.id.append(2 * self.id[parent] + 1 + side)
        self.depth.append(self.depth[parent] + 1)
        for x, y in ((self.slot, -1), (self.cut, 0), (self.first, 0), (self.gain, 0.0)):
            x.append(y)
        ended = not n0 or not n1 or self.depth[-1] >= lay.max_depth
        self.share.append(_share(n0, n1, lay))
        self.state.append(LEAF if ended else CELL if n0 + n1 <= CELL_ROWS else OPEN)


def _share(n0: int, n1: int, lay: Layout) -> float:
    a, b = lay.class_weights[0] * n0, lay.class_weights[1] * n1
    return b / (a + b) if n0 + n1 else math.nan


def _split_open(records: DataFrame, top: _Top, lay: Layout) -> None:
    """A pass: the open nodes get their splits, their children are added."""
    opened = top.of(OPEN)
    ids, by_tree, place, table = np.array(top.id), {}, top.arrays(), poisson_table()
    for i in opened:
        by_tree.setdefault(top.tree[i], set()).add(i)
    column, level = lay.by_slot()
    picks = {i: picked(ids[[i]], top.tree[i], lay) for i in opened}
    width, dtype = len(lay.sizes) + 1, lay.dtype
    schema = pa.schema([("tree", pa.int32()), ("counts", pa.binary())])

    def counted(batches):
        found = {}
        for b in batches:
            for keys, codes in zip(b.column(1), b.column(2)):
                keys = np.frombuffer(keys.as_buffer(), np.uint64)
                codes = np.frombuffer(codes.as_buffer(), dtype).reshape(-1, width)
                for tree, wanted in by_tree.items():
                    w = draws(keys, tree, lay.seed, table)
                    for at, who in passed(codes, np.flatnonzero(w), tree, place, column, level):
                        if at in wanted:
                            rec = codes[who]
                            rec[:, -1] += 2 * w[who]
                            if at not in found:
                                S = picks[at]
                                found[at] = np.zeros(2, np.int64), np.zeros((1, S.shape[1], 2), np.int64), numeric_counts(S, column, lay)
                            n, right, numeric = found[at]
                            n += np.bincount(rec[:, -1] & 1, rec[:, -1] >> 1, minlength=2).astype(np.int64)
                            add_counts(rec, picks[at], right, numeric, column, level, lay)
        for tree, wanted in by_tree.items():
            own = {at: found[at] for at in wanted if at in found}
            if own:
                yield _row(schema, tree, pickle.dumps(own))

    split_schema = pa.schema([(c, pa.int64()) for c in ("at", "slot", "cut", "n0", "n1", "right0", "right1")] + [("gain", pa.float64())])

    def decide(batches):
        found = {}
        for b in batches:
            for part in b.column(1):
                for at, (n, right, numeric) in pickle.loads(part.as_py()).items():
                    if at not in found:
                        found[at] = n, right, numeric
                    else:
                        found[at][0][:] += n
                        found[at][1][:] += right
                        for j, (_, x) in numeric.items():
                            found[at][2][j][1][:] += x
        for at, (n, right, numeric) in found.items():
            S, n0, n1 = picks[at], n[:1], n[1:]
            cuts = [(np.zeros(1, int), np.array([j]), *best_cut(x[None], n0, n1, lay.class_weights)) for j, (_, x) in numeric.items()]
            slot, cut, gain = (x[0] for x in decided(n0, n1, S, right, cuts, column, level, lay))
            j = int(np.flatnonzero(S[0] == slot)[0]) if slot >= 0 else 0
            side = numeric[j][1][cut + 1 :].sum(0) if j in numeric else right[0, j]
            yield _row(split_schema, at, int(slot), int(cut), int(n[0]), int(n[1]), int(side[0]), int(side[1]), float(gain))

    counts = records.mapInArrow(counted, "tree int, counts binary").repartitionById(max(by_tree) + 1, F.col("tree"))
    out = "at bigint, slot bigint, cut bigint, n0 bigint, n1 bigint, right0 bigint, right1 bigint, gain double"
    for r in sorted(counts.mapInArrow(decide, out).collect()):  # a row an open node
        i = r["at"]
        top.share[i] = _share(r["n0"], r["n1"], lay)
        top.state[i] = LEAF if r["slot"] < 0 else INNER
        if r["slot"] >= 0:
            top.slot[i], top.cut[i], top.first[i], top.gain[i] = r["slot"], r["cut"], len(top.tree), r["gain"]
            top.add(i, 0, r["n0"] - r["right0"], r["n1"] - r["right1"], lay)
            top.add(i, 1, r["right0"], r["right1"], lay)
    for i in opened:
        if top.state[i] == OPEN:  # a tree that drew no row
            top.state[i] = LEAF


# ---- cells --------------------------------------------------------------------------------
def _cells(records: DataFrame, top: _Top, ends: dict[int, int], turn: list[int], lay: Layout) -> DataFrame:
    """The cells of the trees of a turn, grown."""
    place, table, width, dtype = top.arrays(), poisson_table(), len(lay.sizes) + 1, lay.dtype
    column, level = lay.by_slot()
    at_cell = {ends[i]: i for i in top.of(CELL)}
    about = {end: (top.tree[i], top.id[i], top.depth[i]) for end, i in at_cell.items()}
    own = {i: end for end, i in at_cell.items()}
    dealt_schema = pa.schema([("end", pa.int32()), ("rows", pa.binary())])

    def deal(batches):
        for b in batches:
            for keys, codes in zip(b.column(1), b.column(2)):
                keys = np.frombuffer(keys.as_buffer(), np.uint64)
                codes = np.frombuffer(codes.as_buffer(), dtype).reshape(-1, width)
                for tree in turn:
                    w = draws(keys, tree, lay.seed, table)
                    for at, who in passed(codes, np.flatnonzero(w), tree, place, column, level):
                        if at in own and len(who):
                            rec = codes[who]
                            rec[:, -1] += 2 * w[who]
                            yield _row(dealt_schema, own[at], rec.tobytes())

    cell_schema = pa.schema([("end", pa.int32()), ("tree", pa.int32()), ("root", pa.int64()), ("depth", pa.int32()), ("n", pa.int32()),
                             ("slots", pa.binary()), ("cuts", pa.binary()), ("shares", pa.binary()), ("gains", pa.binary())])

    def grow(batches):
        held = {}
        for b in batches:
            for end, rows in zip(b.column(0).to_pylist(), b.column(1)):
                held.setdefault(end, []).append(np.frombuffer(rows.as_buffer(), dtype).reshape(-1, width))
        for end in sorted(held):
            tree, root, depth = about[end]
            slot, cut, share, levels, gains = grown(np.concatenate(held.pop(end)), tree, root, depth, lay)
            yield _row(cell_schema, end, tree, root, depth + levels, len(slot), slot.astype(np.int32).tobytes(), cut.astype(np.int32).tobytes(),
                      share.tobytes(), gains.tobytes())

    wanted = sorted(end for end, (tree, _, _) in about.items() if tree in set(turn))
    first = wanted[0]
    dealt = records.mapInArrow(deal, "end int, rows binary").repartitionById(wanted[-1] - first + 1, F.col("end") - F.lit(first))
    return dealt.mapInArrow(grow, CELLS)


class Forest(Transformer):
    """A grown forest: its cells in the shared folder, its top, and how columns are coded."""

    def __init__(self, cells, top, ends, lay, columns, cuts, features, size, depth, importances):
        super().__init__()
        self.cells, self.top, self.ends, self.layout = cells, top, ends, lay
        self.columns, self.cuts, self.features = columns, cuts, features
        self.size, self.depth, self.n_trees = size, depth, sum(i == 0 for i in top.id)
        self.featureImportances = importances

    def _transform(self, rows: DataFrame) -> DataFrame:
        """``probability`` and ``prediction``."""
        from emporion.operators import forest as T

        rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "forest-given")
        late, _ = T.scored(self, rows.select("_row", self.features, *self.columns))
        p = array_to_vector(F.array(1 - F.col("p_late"), F.col("p_late"))).alias("probability")
        return rows.join(late.select("_row", p, "prediction"), "_row").drop("_row")


def fit(rows: DataFrame, columns: list[str], levels: list[int | None], keys: list[str], label: str, class_weights: tuple[float, float],
        trees: int, max_depth: int, max_bins: int, seed: int, features: str = "features") -> Forest:
    """A forest on all ``rows``.  ``levels``: of each column, in the order of the slots, the number of its
    levels, or None for a numeric one."""
    spark = rows.sparkSession
    numeric = [c for c, n in zip(columns, levels) if n is None]
    cut = cuts_of(rows, numeric, max_bins) if numeric else {}
    cuts = [cut.get(c) for c in columns]
    sizes = tuple(n + 1 if x is None else len(x) + 1 for n, x in zip(levels, cuts))  # a level more: one not seen in training
    widths = [n if n is not None else 1 for n in levels]
    slots = tuple(int(x) for x in np.cumsum([0, *widths[:-1]]))
    n_slots = sum(widths)
    lay = Layout(sizes, slots, tuple(n is None for n in levels), n_slots, math.ceil(math.sqrt(n_slots)), seed, class_weights, max_depth)
    records = _records(rows, columns, cuts, lay.dtype, keys, label)
    n = records.agg(F.sum("n")).first()[0] or 0

    top = _Top(trees, CELL if n <= CELL_ROWS else OPEN)
    while top.of(OPEN):
        _split_open(records, top, lay)
    ends = {i: end for end, i in enumerate(sorted(top.of(CELL, LEAF), key=lambda i: (top.tree[i], top.id[i])))}
    path = scratch_dir(spark, "forest-cells")
    per_turn = max(1, int(TURN_BYTES // max(1, n * (len(columns) + 1) * lay.dtype.itemsize)))
    with_cells = sorted({top.tree[i] for i in top.of(CELL)})
    for i in range(0, len(with_cells), per_turn):
        _cells(records, top, ends, with_cells[i : i + per_turn], lay).write.mode("append").parquet(path)
        if per_turn < len(with_cells):
            _forget_shuffles(spark)
    got = spark.read.schema(CELLS).parquet(path).select("end", "tree", "root", "depth", "n", "gains").collect() if with_cells else []
    no_gains, empty = np.zeros(n_slots).tobytes(), {r["end"] for r in got}
    leaf = [(ends[i], top.tree[i], top.id[i], top.depth[i], 1, np.array([-1], np.int32).tobytes(), np.zeros(1, np.int32).tobytes(),
             np.array([top.share[i]]).tobytes(), no_gains) for i in ends if ends[i] not in empty]  # leaves of the top, cells without rows
    if leaf:
        spark.createDataFrame([tuple(map(lambda x: bytearray(x) if isinstance(x, bytes) else x, r)) for r in leaf], CELLS).write.mode("append").parquet(path)
    cells = spark.read.schema(CELLS).parquet(path)
    cells._emporion_scratch = path
    drop_scratch(records)

    gains = np.zeros((trees, n_slots))
    for r in sorted(got, key=lambda r: (r["tree"], r["root"])):
        gains[r["tree"]] += np.frombuffer(r["gains"], np.float64)
    for i in top.of(INNER):
        gains[top.tree[i], top.slot[i]] += top.gain[i]
    whole = gains.sum(1, keepdims=True)
    shares = np.divide(gains, whole, out=np.zeros_like(gains), where=whole > 0).sum(0)  # of each tree, then of the forest
    size = sum(r["n"] for r in got) + len(leaf) + len(top.of(INNER))
    depth = max([r["depth"] for r in got] + [top.depth[i] for i in ends], default=0)
    return Forest(cells, top, ends, lay, columns, cuts, features, size, depth, Vectors.dense(shares / shares.sum() if shares.sum() else shares))


def _forget_shuffles(spark) -> None:
    """Lets Spark delete the shuffle files of a turn that is over, which it does once their plan is collected."""
    import gc

    gc.collect()
    try:
        spark.sparkContext._jvm.System.gc()
    except Exception:  # no JVM handle (e.g. Spark Connect)
        pass


# ---- the forest as nodes, and rows on its cells -------------------------------------------
NODES = "tree int, node bigint, feature int, categories array<double>, threshold double, left bigint, right bigint, late_share double"


def nodes_of(forest: Forest) -> DataFrame:
    """A row for each node of the forest."""
    lay, cuts, top = forest.layout, forest.cuts, forest.top
    column, level = lay.by_slot()
    schema = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("feature", pa.int32()), ("categories", pa.list_(pa.float64())),
                        ("threshold", pa.float64()), ("left", pa.int64()), ("right", pa.int64()), ("late_share", pa.float64())])

    def threshold(slot, cut):
        return 0.5 if level[slot] >= 0 else float(cuts[column[slot]][cut])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                slot, cut, share = (np.frombuffer(r[c], t) for c, t in (("slots", np.int32), ("cuts", np.int32), ("shares", np.float64)))
                ids, inner = heap_ids(slot, r["root"]), slot >= 0
                at = np.array([threshold(s, c) if s >= 0 else 0.0 for s, c in zip(slot.tolist(), cut.tolist())])
                out = [pa.array(np.full(len(slot), r["tree"]), pa.int32()), pa.array(ids), pa.array(slot), pa.nulls(len(slot), schema.field(3).type),
                       pa.array(at, mask=~inner), pa.array(np.where(inner, 2 * ids + 1, -1)), pa.array(np.where(inner, 2 * ids + 2, -1)),
                       pa.array(share, mask=inner | np.isnan(share))]
                yield from pa.table(out, schema=schema).to_batches(max_chunksize=10_000)

    below = forest.cells.select("tree", "root", "slots", "cuts", "shares").mapInArrow(run, NODES)
    above = [(top.tree[i], top.id[i], top.slot[i], None, threshold(top.slot[i], top.cut[i]), 2 * top.id[i] + 1, 2 * top.id[i] + 2, None) for i in top.of(INNER)]
    return below.union(forest.cells.sparkSession.createDataFrame(above, NODES)) if above else below


def scored_in_cells(forest: Forest, rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` without the coded columns and features, with ``p_late``; and the tables that it reads."""
    lay, place, ends, top = forest.layout, forest.top.arrays(), forest.ends, forest.top
    column, level = lay.by_slot()
    own = [c for c in rows.columns if c not in (*forest.columns, forest.features)]
    given = materialize(rows.select(*own, *forest.columns).withColumn("_r", F.monotonically_increasing_id()), "score-rows")
    code, width, dtype, trees, most = _coder(forest.cuts, lay.dtype), len(lay.sizes), lay.dtype, forest.n_trees, CHUNK_ROWS
    tree_of = {end: top.tree[i] for i, end in ends.items()}
    schema = pa.schema([("end", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
    # A block is up to 65,536 rows whose numbers follow one another.

    def packed(ids, codes):
        for block in np.unique(ids >> 16).tolist():
            some = np.flatnonzero(ids >> 16 == block)
            for tree in range(trees):
                for at, who in passed(codes, some, tree, place, column, level):
                    if len(who):
                        yield _row(schema, ends[at], block, (ids[who] & 0xFFFF).astype(np.uint16).tobytes(), codes[who].tobytes(), None)

    def deal(batches):
        held, n = [], 0
        for b in batches:
            held.append((b.column(width).to_numpy(zero_copy_only=False), code(b, width)))
            n += b.num_rows
            if n >= most:
                yield from packed(*(np.concatenate(x) for x in zip(*held)))
                held, n = [], 0
        if n:
            yield from packed(*(np.concatenate(x) for x in zip(*held)))

    share_schema = pa.schema([("block", pa.int64()), ("tree", pa.int32()), ("at", pa.binary()), ("shares", pa.binary())])

    def walk(batches):
        for b in batches:
            for end, block, x, y, z in zip(*(b.column(i) for i in range(5))):
                x, y = x.as_buffer(), y.as_buffer()
                if block.as_py() < 0:  # the cell itself comes first
                    slot, cut, share = np.frombuffer(x, np.int32), np.frombuffer(y, np.int32), np.frombuffer(z.as_buffer(), np.float64)
                else:
                    leaf = walked(np.frombuffer(y, dtype).reshape(-1, width), slot, cut, lay)
                    yield _row(share_schema, block.as_py(), tree_of[end.as_py()], x.to_pybytes(), share[leaf].tobytes())

    def add(batches):
        held = None

        def summed():
            block, total, n, seen = held
            at = np.flatnonzero(seen)
            with np.errstate(invalid="ignore"):
                late = total[at] / n[at]
            lost = np.isnan(late)
            out = [pa.array((block << 16) + at), pa.array(late, mask=lost), pa.array((late > 0.5).astype(float), mask=lost)]
            return pa.RecordBatch.from_arrays(out, names=["_r", "p_late", "prediction"])

        for b in batches:
            for block, at, share in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                at, share = np.frombuffer(at.as_buffer(), np.uint16), np.frombuffer(share.as_buffer(), np.float64)
                if held is None or held[0] != block:
                    if held is not None:
                        yield summed()
                    held = block, np.zeros(1 << 16), np.zeros(1 << 16), np.zeros(1 << 16, bool)
                known = ~np.isnan(share)
                held[1][at[known]] += share[known]
                held[2][at[known]] += 1
                held[3][at] = True
        if held is not None:
            yield summed()

    cells = forest.cells.select("end", F.lit(-1).cast("bigint").alias("block"), F.col("slots").alias("a"), F.col("cuts").alias("b"), F.col("shares").alias("c"))
    dealt = given.select(*forest.columns, "_r").mapInArrow(deal, "end int, block bigint, a binary, b binary, c binary")
    met = cells.unionByName(dealt).repartitionById(len(ends), F.col("end")).sortWithinPartitions("end", "block")
    shares = met.mapInArrow(walk, "block bigint, tree int, at binary, shares binary")
    late = shares.repartition("block").sortWithinPartitions("block", "tree").mapInArrow(add, "_r bigint, p_late double, prediction double")
    return given.select("_r", *own).join(late, "_r").select(*own, "p_late", "prediction"), [given]
