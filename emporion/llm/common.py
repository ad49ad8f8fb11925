"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import math
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emporion.session import materialize

SPACE_RUN = r"[\x20\x09-\x0D]+"  # fixed value: the white space of the contracts
WORD = r"[^\x20\x09-\x0D]+"  # fixed value: a word of the contracts
LAST_ID = 2**63 - 1  # stands for a null id: such a row comes after every other one

__all__ = ["LAST_ID", "SPACE_RUN", "WORD", "id_order", "materialize", "partitions_for", "read_table", "row_keyed", "ship_code", "text_or_empty"]


def read_table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """Reader of one driver table, through Spark so that any file system works."""
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def id_order(id_col: str = "doc_id") -> Column:
    """The id as a never-null long; null ids come last."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))


def row_keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` (as given), ``oid`` (never null), ``rk`` (hash of the text) and ``text``
    (never null).  (oid, rk) names a row: ids may be null or repeated with other texts; rows
    with the same id and text have the same result in every operator.  Other columns are
    dropped, so clashing names cannot matter."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        id_order(id_col).alias("oid"),
        F.xxhash64(text_or_empty(text_col)).alias("rk"),
        text_or_empty(text_col).alias("text"),
    )


def partitions_for(total_bytes: int, target_bytes: int, least: int = 1) -> int:
    """Number of shuffle partitions that keeps each near ``target_bytes``."""
    return max(least, math.ceil(total_bytes / target_bytes))



def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once a session, so that functions of it run wherever
    the driver was started."""
    context = spark.sparkContext
    if not getattr(context, "_emporion_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        if os.path.isdir(os.path.join(root, "emporion")):  # else it runs from an archive that was shipped already
            to = os.path.join(tempfile.mkdtemp(prefix="emporion-code-"), "emporion")  # served by the driver
            context.addPyFile(shutil.make_archive(to, "zip", root, "emporion"))
        context._emporion_shipped = True
