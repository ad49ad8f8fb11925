"""Warehouse-side load operators.

* :func:`insert_if_absent` — A4/F6: add known rows whose key is missing, never overwrite.
* :func:`reduce_geolocation` — A5: one row per zip prefix (mean coordinates, first city/state).
* :func:`full_refresh` — A2: replace a table so that a rerun yields the same table and a failure keeps the old one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emporion.session import drop_folder

# The two category translations the raw translation file lacks
# (Portuguese name, English name), inserted if absent after the load.
KNOWN_MISSING_CATEGORIES = [
    ("pc_gamer", "gaming_pc"),
    ("portateis_cozinha_e_preparadores_de_alimentos", "portable_kitchen_food_preparers"),
]


def literal_rows(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    """A small literal table built JVM-side (an inline array of structs), so no Python
    worker is involved when it is scanned."""
    from pyspark.sql import types as T

    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    fields = schema.fields if isinstance(schema, T.StructType) else schema
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, fields)]) for r in rows
    ]
    if not structs:
        return spark.createDataFrame([], T.StructType(list(fields)))
    return spark.range(1).select(F.inline(F.array(*structs)))


def values_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short literal table of whole numbers, booleans and strings, given to Spark as one SQL text (a
    call to the JVM for the whole table, where :func:`literal_rows` makes several for each cell)."""
    names, kinds = zip(*(f.rsplit(" ", 1) for f in schema.split(", ")))

    def cell(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return str(v)

    typed = ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in zip(names, kinds))
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {k}) AS {n}" for n, k in zip(names, kinds)) + " WHERE false")
    text = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    return spark.sql(f"SELECT {typed} FROM VALUES {text} AS t({', '.join(names)})")


def insert_if_absent(
    spark: SparkSession, base: DataFrame, rows: list[tuple], key: str
) -> DataFrame:
    """A4: ``INSERT … ON CONFLICT (key) DO NOTHING`` as a set operation.

    ``rows`` is a short literal list supplied by the caller (its size is fixed in code, not by
    the data); duplicate keys inside it keep the first one, as sequential inserts would.  The
    patch is anti-joined against the base keys and appended: the base is scanned once and
    never rewritten.
    """
    seen, patch_rows = set(), []
    k = base.columns.index(key)
    for r in rows:
        if r[k] not in seen:
            seen.add(r[k])
            patch_rows.append(r)
    patch = literal_rows(spark, patch_rows, base.schema)
    missing = patch.join(base.select(key), key, "left_anti")
    return base.unionByName(missing)


def reduce_geolocation(
    raw: DataFrame,
    zip_col: str = "geolocation_zip_code_prefix",
    seq_col: str | None = "_seq",
) -> DataFrame:
    """A5: collapse raw geolocation rows to one row per zip prefix.

    Coordinates are averaged and stored as DECIMAL(10,6).  City and state take the first
    non-null value in ingest order (T8): ``min_by(value, seq)`` over non-null values, which is
    deterministic, unlike ``first``.  Without a sequence column the smallest value is used.
    NULL zip prefixes are dropped, as a pandas group-by does.  Both aggregates are
    partial-aggregable, so a zip prefix holding a large share of the rows is combined
    map-side before the shuffle.
    """

    def first_non_null(c: str) -> Column:
        if seq_col is None:
            return F.min(c)
        return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq_col)))

    return (
        raw.filter(F.col(zip_col).isNotNull())
        .groupBy(zip_col)
        .agg(
            F.avg(F.col("geolocation_lat").cast("double")).cast("decimal(10,6)").alias("geolocation_lat"),
            F.avg(F.col("geolocation_lng").cast("double")).cast("decimal(10,6)").alias("geolocation_lng"),
            first_non_null("geolocation_city").alias("geolocation_city"),
            first_non_null("geolocation_state").alias("geolocation_state"),
        )
    )


def full_refresh(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """A2: truncate-and-load.  The new content is written beside the folder and takes its place when
    it is complete: a job that fails leaves the old table as it was, a rerun produces the same table, and a
    failed task is retried by Spark without duplicates.  (Between the two renames there is a moment
    without a table; :class:`emporion.sources.versions.Warehouse` has none.)"""
    spark = df.sparkSession
    head, _, name = path.rstrip("/").rpartition("/")
    mark = uuid.uuid4().hex[:12]
    staged, old = f"{head}/.{name}.staged-{mark}", f"{head}/.{name}.old-{mark}"
    w = df.write.format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    try:
        w.save(staged)
    except BaseException:
        drop_folder(spark, staged)
        raise
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(jpath(path)) and not fs.rename(jpath(path), jpath(old)):
        raise OSError(f"cannot move {path} away")
    if not fs.rename(jpath(staged), jpath(path)):
        raise OSError(f"cannot move {staged} to {path}; the old table is in {old}")
    fs.delete(jpath(old), True)
    spark.catalog.refreshByPath(path)  # file lists that this session keeps
    return path


# Tables written bucketed by order id: the fact tables and the order-grain dimensions that
# are joined to them on ``order_id``.
ORDER_GRAIN = ("fact_order_items", "fact_order_payments", "dim_orders", "dim_reviews")


def write_bucketed_star(tables: dict[str, DataFrame], database: str, location: str, buckets: int) -> dict[str, str]:
    """Write a star schema as catalog tables, the order-grain ones bucketed and sorted by
    ``order_id`` into the same number of buckets.

    Joins between those tables on ``order_id`` then need no shuffle and no sort (both sides
    already have ``hashpartitioning(order_id, buckets)``).  Each table is repartitioned on
    the bucket column first, so every write task produces one file per bucket instead of
    one per (task, bucket).  Other tables are plain Parquet tables.  ``location`` must be on
    storage every executor reaches.

    Bucketing places every row of a key in one bucket by construction: if a single order
    could hold a large share of all items, keep the unbucketed layout, where AQE splits a
    skewed join partition at query time instead."""
    spark = next(iter(tables.values())).sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
    written = {}
    for name, df in tables.items():
        qualified = f"{database}.{name}"
        path = f"{location.rstrip('/')}/{name}"
        if name in ORDER_GRAIN:
            (df.repartition(buckets, "order_id").write.mode("overwrite")
             .bucketBy(buckets, "order_id").sortBy("order_id")
             .option("path", path).saveAsTable(qualified))
        else:
            df.write.mode("overwrite").option("path", path).saveAsTable(qualified)
        written[name] = qualified
    return written
