"""Operator 6, sharding by extendible hashing.

Every document gets a 64-bit hash of its id and text.  The directory is indexed by the
leading hash bits; only shards over the byte limit split on another bit.  Rows with equal
hashes (repeated rows) cannot be told apart by bits: a shard of such rows that is still too
large is cut into overflow pages of whole rows.

Defined cases: a null text has 0 bytes; a document over the limit is alone in its shard; null
and repeated ids are hashed like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emporion.llm.common import id_order, materialize, text_or_empty
from emporion.llm.extendible import split_overfull

SHARD_BYTES = 8 << 20


def assign_shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, shard`` (bits of its prefix, then ``.page``),
    ``depth, page, shard_bytes, shard_docs``."""
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(id_order(id_col), text).alias("h"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    # Repeated rows become one row with a count before anything is dealt out.
    rows = materialize(rows.groupBy("doc_id", "h", "n_bytes").agg(F.count("*").alias("copies")).withColumn("w", F.col("n_bytes") * F.col("copies")), "shard-rows")
    placed = split_overfull(rows, "h", "w", shard_bytes, count="copies")
    per_page = F.greatest(F.lit(1).cast("long"), F.expr(f"{int(shard_bytes)} div greatest(n_bytes, 1)"))
    over = F.col("bucket_weight") > shard_bytes
    placed = placed.withColumn("per_page", F.when(over, F.least(per_page, "copies")).otherwise(F.col("copies")))
    placed = placed.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(copies + per_page - 1) div per_page - 1"))))
    in_page = F.least(F.col("per_page"), F.col("copies") - F.col("page") * F.col("per_page"))
    placed = placed.withColumn("in_page", in_page)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.substring(F.lpad(F.bin("bucket"), 64, "0"), F.lit(65) - F.col("depth"), F.col("depth")))
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "in_page")))
    return placed.select(
        "doc_id",
        "n_bytes",
        F.concat(bits, F.lit("."), F.col("page")).alias("shard"),
        "depth",
        "page",
        F.when(over, F.col("in_page") * F.col("n_bytes")).otherwise(F.col("bucket_weight")).alias("shard_bytes"),
        F.when(over, F.col("in_page")).otherwise(F.col("bucket_count")).alias("shard_docs"),
    )
