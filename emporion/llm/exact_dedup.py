"""Operator 1, exact dedup: an extendible-hash index kept in shared files.

Only DataFrame functions.  One pass over the documents writes their postings: id, 64-bit hash
and SHA-256 of the normalised text.  The directory doubles where a bucket holds more hashes than
its limit.  Texts that share neither hash nor digest with another row are an entry as they are;
for all others the texts themselves are grouped, which compares their bytes.  Every entry is
routed through the directory to its bucket; the entries are dealt out by ranges of (bucket,
hash), and the owner task of a range chains the entries that collide in a hash and writes them.
Documents are routed through the same directory, and walk the chain of their bucket and hash to
their entry.  A copy is thus never called one by its hashes alone: two texts that agree in both
but differ in their bytes would be two entries of one digest, and the owner task stops the job.

Only texts with a copy are shuffled, combined map-side: a text that fills a third of the table
sends one row per task.  Their hashes are sent to all tasks while there are at most
``BROADCAST_KEYS``; beyond that all texts are grouped, with the same result.

Defined cases: a null text counts as empty; null ids come after all others and their
``keep_id`` is null if no row of the group has an id; of rows with the same id and text one
is kept; a very long text is one value of its row, hashed where it is read; other columns are
never read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emporion.llm.common import LAST_ID, SPACE_RUN, id_order, materialize, text_or_empty
from emporion.llm.extendible import route, split_overfull

BUCKET_ENTRIES = 100_000
BROADCAST_KEYS = 500_000
ENTRY = ["key", "text_sha256", "keep", "group_size"]


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """(oid, norm, key): the id, the normalised text and its hash."""
    norm = F.regexp_replace(text_or_empty(text_col), SPACE_RUN, " ")
    key = F.xxhash64("norm")
    if hash_bits < 64:  # for tests of collisions
        key = F.shiftleft(F.shiftrightunsigned(key, 64 - hash_bits), 64 - hash_bits)
    return docs.select(id_order(id_col).alias("oid"), norm.alias("norm")).withColumn("key", key)


def digest() -> Column:
    return F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")


def postings(rows: DataFrame) -> DataFrame:
    """(oid, key, text_sha256, copies) for each different (id, text) of ``rows`` (from
    :func:`hashed`); ``copies`` counts its repeated rows; written to the shared folder."""
    found = rows.select("oid", "key", digest()).groupBy("oid", "key", "text_sha256")
    return materialize(found.agg(F.count("*").alias("copies")), "dedup-postings")


def compared(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """The entries of the (key, text_sha256) in ``shared``, from texts grouped by their bytes."""
    keys = shared.select("key").distinct()
    if shared.count() <= BROADCAST_KEYS:
        rows = rows.join(F.broadcast(keys), "key", "left_semi")
    groups = rows.groupBy("key", "norm").agg(F.min("oid").alias("keep"), F.count("*").alias("group_size"))
    return groups.select("key", digest(), "keep", "group_size").join(shared, ["key", "text_sha256"], "left_semi")


def build_index(rows: DataFrame, posted: DataFrame, bucket_entries: int = BUCKET_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """The index and its directory (``bucket``, ``depth``).  The index has one entry for each
    different text: ``bucket``, ``depth``, ``key``, ``chain`` (place among the entries of its key,
    from 1), ``keep`` (smallest id), ``group_size`` and ``text_sha256``; written to the shared
    folder by owner tasks of ranges of (bucket, key)."""
    seen = posted.groupBy("key", "text_sha256").agg(F.min("oid").alias("keep"), F.sum("copies").alias("group_size"))
    seen = materialize(seen, "dedup-seen")
    hashes = materialize(seen.select("key", F.lit(1).cast("long").alias("one")).distinct(), "dedup-hashes")
    directory = materialize(split_overfull(hashes, "key", "one", bucket_entries).select("bucket", "depth").distinct(), "dedup-directory")
    single, shared = seen.where("group_size = 1"), seen.where("group_size > 1").select("key", "text_sha256")
    entries = materialize(single.select(*ENTRY).unionByName(compared(rows, shared)), "dedup-entries")
    chain = Window.partitionBy("bucket", "key").orderBy("text_sha256", "keep")
    unlike = F.lag("text_sha256").over(chain) == F.col("text_sha256")
    owned = (
        route(entries, "key", directory)
        .repartitionByRange("bucket", "key")
        .withColumn("chain", F.row_number().over(chain))
        .withColumn("chain", F.when(unlike, F.raise_error(F.lit("texts of one hash and digest, but other bytes"))).otherwise(F.col("chain")))
    )
    return materialize(owned.sortWithinPartitions("bucket", "key", "chain"), "dedup-index"), directory


def probe(posted: DataFrame, index: DataFrame, directory: DataFrame) -> DataFrame:
    """(oid, copies, keep, group_size, text_sha256) for each of the postings, from the chain of
    its bucket and key."""
    entry = index.select("bucket", *ENTRY)
    found = route(posted, "key", directory).join(entry, ["bucket", "key", "text_sha256"])
    return found.select("oid", "copies", "keep", "group_size", "text_sha256")


def looked_up(rows: DataFrame, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    posted = postings(rows)
    return probe(posted, *build_index(rows, posted, bucket_entries))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    found = looked_up(hashed(docs, id_col, text_col, hash_bits), bucket_entries)
    back = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select(
        back("oid").alias("doc_id"),
        back("keep").alias("keep_id"),
        F.col("group_size"),
        ((F.col("oid") == F.col("keep")) & (F.col("copy") == 1)).alias("kept"),
        F.col("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each different text, all columns as they were."""
    found = materialize(looked_up(hashed(docs, id_col, text_col)), "dedup-found")
    stay = found.where("oid = keep").select("oid", F.col("text_sha256").alias("sha"), "copies")
    given = docs.columns
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in given]).alias("row"),
        id_order(id_col).alias("oid"),
        F.sha2(F.regexp_replace(text_or_empty(text_col), SPACE_RUN, " ").cast("binary"), 256).alias("sha"),
    )
    kept = own.join(stay.hint("shuffle_hash"), ["oid", "sha"], "left_semi")
    if not stay.where("copies > 1").isEmpty():  # repeated rows: one stays
        kept = kept.dropDuplicates(["oid", "sha"])
    return kept.select("row.*")
