"""Operator 8, mixing sources to target weights by hash-threshold histograms.

Each source gets a target number of words; a document is taken whole, 0, 1 or 2 times.  Every
document has a 64-bit hash of its id and text.  For a source, words are summed per hash bucket
(the leading bits); the bucket in which the running sum crosses the budget is the boundary,
and only boundary buckets are summed again by the next bits.  The result is one threshold a
source and epoch: a document's copies are the number of thresholds above its hash.  The
epochs' thresholds are nested (the second copy's threshold lies below the first's), nothing is
sorted and reruns agree.

Defined cases: a null text has size 0; null is a source of its own, the last one; an empty
source has target 0; repeated rows share a hash and are taken alike; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emporion.llm.common import WORD, id_order, materialize, text_or_empty

WEIGHTS = (5, 2, 1)  # fixed value: repeated over the sources in order
SHARE = 1.5  # fixed value: all targets together, as a share of all sizes
MOST = 2  # fixed value: a source is taken this often at most
STEP_BITS = 12
HASH_BITS = 60


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Target words of each source.  Whatever a source cannot take is shared again by weight
    among the others until no target is above ``most`` times its source's size."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, out = share * sum(size.values()), list(size), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * size[s]]
        if not full:
            out.update({s: unit * weight[s] for s in open_})
            break
        for s in full:
            out[s] = float(most * size[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
    return out


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(oid, doc_id, rk, source, size, h): what the mix needs of each document."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        id_order(id_col).alias("oid"),
        F.xxhash64(text).alias("rk"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.shiftrightunsigned(F.xxhash64(id_order(id_col), text), 64 - HASH_BITS).alias("h"),
    )


def thresholds(rows: DataFrame, budgets: DataFrame, step_bits: int = STEP_BITS) -> DataFrame:
    """(source, epoch, threshold): documents of the source with ``h < threshold`` make up the
    epoch's budget, as near as whole documents allow.

    ``rows`` has (source, size, h); ``budgets`` has (source, epoch, budget), one row for each
    source and epoch.  Each round sums one histogram for the boundary buckets only."""
    at = budgets.select(F.col("source").alias("_s"), "epoch", F.col("budget").cast("double").alias("rest"))
    inside = rows.join(at, F.col("source").eqNullSafe(F.col("_s"))).select("source", "epoch", "size", "h", "rest")
    shift, got = HASH_BITS, None
    while shift > 0:
        step = min(step_bits, shift)
        shift -= step
        cells = inside.groupBy("source", "epoch", "rest", F.shiftrightunsigned("h", shift).alias("cell"))
        cells = cells.agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = F.sum("words").over(Window.partitionBy("source", "epoch").orderBy("cell"))
        cells = cells.withColumn("upto", upto)
        # The first cell whose running sum passes the rest of the budget is the boundary.
        cross = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("cell", (F.col("upto") - F.col("words")).alias("below"), "words", "n")))
        edge = materialize(cells.groupBy("source", "epoch", "rest").agg(cross.alias("edge")), "mix-edge")
        # A budget that the cells never pass takes them all.  A boundary bucket of one document
        # (or one hash value) is left out or taken, whichever is nearer.
        take = F.col("edge.below") + F.col("edge.words") - F.col("rest") < F.col("rest") - F.col("edge.below")
        at_edge = F.shiftleft(F.col("edge.cell") + take.cast("long"), shift)
        final = F.col("edge").isNull() | (F.col("edge.n") == 1) | F.lit(shift == 0)
        settled = edge.where(final).select("source", "epoch", F.when(F.col("edge").isNull(), F.lit(1 << HASH_BITS)).otherwise(at_edge).alias("threshold"))
        got = settled if got is None else got.unionByName(settled)
        edge = edge.where(~final).select(
            F.col("source").alias("_s"), F.col("epoch").alias("_e"), F.col("edge.cell").alias("_c"), (F.col("rest") - F.col("edge.below")).alias("_r")
        )
        if edge.isEmpty():
            break
        on = F.col("source").eqNullSafe(F.col("_s")) & (F.col("epoch") == F.col("_e")) & (F.shiftrightunsigned("h", shift) == F.col("_c"))
        inside = inside.join(edge, on).select("source", "epoch", "size", "h", F.col("_r").alias("rest"))
    return got


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per document: ``doc_id, oid, rk, source, size, source_size, target, copies,
    taken``.

    Only the per-source sums (a row a source) reach the driver, to share out the targets: some 100
    bytes a source, so the number of sources must be one that the driver can hold (tested with
    100,000)."""
    rows = materialize(sized(docs, id_col, text_col, source_col), "mix-sizes")
    sums = [(r["source"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    aim = targets(sums, weights, share, most)
    per_source = [(s, n, float(aim[s])) for s, n in sums]
    budget = [(s, e, min(t - e * n, float(n))) for s, n, t in per_source for e in range(most) if t > e * n]
    spark = rows.sparkSession
    budgets = spark.createDataFrame(budget, "source string, epoch int, budget double")
    goal = spark.createDataFrame(per_source, "_s string, source_size long, target double")
    got = thresholds(rows.select("source", "size", "h"), budgets)
    cuts = got.groupBy(F.col("source").alias("_cs")).agg(F.collect_list("threshold").alias("cuts"))
    goal = goal.join(cuts, F.col("_s").eqNullSafe(F.col("_cs")), "left")
    goal = materialize(goal.select("_s", "source_size", "target", F.coalesce("cuts", F.array().cast("array<long>")).alias("cuts")), "mix-cuts")
    out = rows.join(goal, F.col("source").eqNullSafe(F.col("_s")))
    copies = F.size(F.filter("cuts", lambda c: c > F.col("h"))).cast("long")
    out = out.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0).cast("long")))
    return out.select("doc_id", "oid", "rk", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` as the mix takes them: each document repeated ``copies`` times."""
    given = docs.columns
    got = mix(docs, id_col, text_col, source_col, **how).where("copies > 0").select("oid", "rk", "copies").distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("row"), id_order(id_col).alias("oid"), F.xxhash64(text_or_empty(text_col)).alias("rk"))
    taken = own.join(got.hint("shuffle_hash"), ["oid", "rk"])
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
