"""CSV ingest and export and the full warehouse load.

Raw files are read as text with a header — record-aware (``multiLine``) where a table has free
text, whose comments may contain newlines; all others in splits, by many tasks — then typed column by column from the schema
registry — by name, so a file with fewer columns than the DDL leaves the rest NULL.  Casts run
in ANSI mode: a value that does not fit its type fails the load, as an INSERT into a typed
warehouse would.  pandas' default NULL markers become NULL except in free-text columns (T11);
zip prefixes stay text, so ``01037`` keeps its zero (T10).
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emporion.schemas import LOAD_ORDER, TABLES, Col, Table
from emporion.session import materialize
from emporion.sources.warehouse import KNOWN_MISSING_CATEGORIES, full_refresh, insert_if_absent, reduce_geolocation, values_table

# The text cells pandas' CSV reader treats as missing by default.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

SEQ = "_seq"


def _reader(spark: SparkSession, free_text: bool):
    return (
        spark.read.option("header", True)
        .option("multiLine", free_text)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .option("inferSchema", False)
        .option("nullValue", None)
        .option("emptyValue", "")
    )


def read_raw_text(spark: SparkSession, path: str, free_text: bool = True) -> DataFrame:
    """All columns as text, one row per CSV record.  ``free_text``: a record may span lines, so
    each file is read by one task; without it a record is a line and files are split."""
    return _reader(spark, free_text).csv(path)


def type_columns(raw: DataFrame, table: Table, keep_seq: bool = False) -> DataFrame:
    """Registry columns by name: NULL-token normalisation, then ANSI casts."""
    present = set(raw.columns)
    cols = []
    for c in table.columns:
        if c.name not in present:
            cols.append(F.lit(None).cast(c.dtype).alias(c.name))
            continue
        v = F.col(f"`{c.name}`")
        if c.name not in table.text_columns:
            v = F.when(v.isin(NULL_TOKENS), F.lit(None)).otherwise(v)
        elif isinstance(c.dtype, T.StringType):
            v = F.when(v == "", F.lit(None)).otherwise(v)
        cols.append(v.cast(c.dtype).alias(c.name))
    if keep_seq:
        cols.append(F.col(SEQ))
    return raw.select(*cols)


def read_table_csv(spark: SparkSession, path: str, table: str | Table, with_seq: bool = False) -> DataFrame:
    """A1: read one raw file into the typed shape of ``table``.

    ``with_seq`` adds the record's position, used for "first value" semantics (T8): files by
    name, then the place of the split in its file, then the order in which the task reads it
    (Spark deals out large splits first, so a running number alone would not do)."""
    meta = TABLES[table] if isinstance(table, str) else table
    raw = read_raw_text(spark, path, bool(meta.text_columns))
    if with_seq:
        at = ("_metadata.file_path", "_metadata.file_block_start")
        raw = raw.select("*", F.struct(*[F.col(c) for c in at], F.monotonically_increasing_id().alias("n")).alias(SEQ))
    return type_columns(raw, meta, keep_seq=with_seq)


CORRUPT, FILE, BLOCK, BROKEN = "_corrupt", "_file", "_block", "_broken"
RULE_BITS = 60
QUARANTINE = "table_name string, file string, record_no bigint, column_name string, rule string, value string, record string"


def _cell(c: Col, table: Table) -> Column:
    """A raw cell with its NULL tokens gone."""
    v = F.col(f"`{c.name}`")
    return F.when(~(v == "" if c.name in table.text_columns else v.isin(NULL_TOKENS)), v)


def cell_rules(table: Table, present: set[str]) -> list[tuple[str, str, Column]]:
    """(column, rule, broken) for the raw text cells of a table: what an INSERT into the declared
    table would refuse, judged without raising."""
    rules = []
    for c in table.columns:
        if c.name not in present:
            continue
        v = _cell(c, table)
        if c.not_null:
            rules.append((c.name, "not_null", v.isNull()))
        if c.max_len:
            rules.append((c.name, f"max_length_{c.max_len}", F.length(v) > c.max_len))
        if isinstance(c.dtype, T.DecimalType):
            rules.append((c.name, f"decimal_{c.dtype.precision}_{c.dtype.scale}", v.isNotNull() & v.try_cast(c.dtype).isNull()))
        elif not isinstance(c.dtype, T.StringType):
            rules.append((c.name, f"type_{c.dtype.simpleString()}", v.isNotNull() & v.try_cast(c.dtype).isNull()))
    for name, low in table.min_values:
        if name in present:
            rules.append((name, f"at_least_{low:g}", _cell(table.col(name), table).try_cast(table.col(name).dtype) < low))
    for name, low, high in table.ranges:
        if name in present:
            rules.append((name, f"between_{low:g}_and_{high:g}", ~_cell(table.col(name), table).try_cast(table.col(name).dtype).between(low, high)))
    return rules


def read_checked_csv(spark: SparkSession, path: str, table: str | Table, for_load: bool = False,
                     patch: list[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """A1 that does not stop at bad records: (typed rows, quarantine).

    A record that cannot be parsed (too many or too few cells, an open quote) or breaks a rule of the
    registry is left out of the rows and listed in the quarantine, once for each broken rule, with its
    file and its number in that file (the header is not counted), the cell and the whole record.
    Columns that a file lacks are NULL; one that is declared NOT NULL is listed once, without a record,
    and breaks no record.  The parsed text is written once to the shared folder, with the rules that each
    record breaks, so that rows, quarantine and record numbers come from one reading and one judgement."""
    meta = TABLES[table] if isinstance(table, str) else table
    free = bool(meta.text_columns)
    names = read_raw_text(spark, path, free).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    raw = _reader(spark, free).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(schema).csv(path)
    rules = cell_rules(meta, set(names))
    fine = F.col(CORRUPT).isNull()
    cells = {c.name: _cell(c, meta) for c in meta.columns if c.name in names}
    rules = [(c, r, fine & F.coalesce(bad, F.lit(False)), cells[c]) for c, r, bad in rules]
    rules.append((None, "malformed", ~fine, F.lit(None).cast("string")))
    marks = {}  # a bit a rule, RULE_BITS in a column: the list is made for broken records only
    for i, (_, _, bad, _) in enumerate(rules):
        bit = F.when(bad, F.lit(1 << i % RULE_BITS).cast("long")).otherwise(F.lit(0).cast("long"))
        at = f"{BROKEN}{i // RULE_BITS}"
        marks[at] = marks[at].bitwiseOR(bit) if at in marks else bit
    raw = materialize(raw.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK),
                                 F.monotonically_increasing_id().alias(SEQ), *[x.alias(c) for c, x in marks.items()]), "raw-text")
    unbroken = reduce(lambda x, y: x & y, [F.col(c) == 0 for c in marks])
    good = raw.filter(unbroken)
    broken = F.array(*[
        F.when(F.col(f"{BROKEN}{i // RULE_BITS}").bitwiseAND(F.lit(1 << i % RULE_BITS)) != 0,
               F.struct(F.lit(c).cast("string").alias("c"), F.lit(r).alias("r"), v.alias("v")))
        for i, (c, r, _, v) in enumerate(rules)])

    blocks = raw.groupBy(FILE, BLOCK).agg(F.count(F.lit(1)).alias("n"), F.min(SEQ).alias("first"))  # a row a split
    before = F.coalesce(F.sum("n").over(Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select(FILE, BLOCK, (before - F.col("first") + 1).alias("offset"))
    record = F.coalesce(CORRUPT, F.to_json(F.struct(*[F.col(f"`{n}`") for n in names])))
    bad = raw.filter(~unbroken).join(offsets, [FILE, BLOCK]).select(
        F.lit(meta.name).alias("table_name"), F.col(FILE).alias("file"), (F.col("offset") + F.col(SEQ)).alias("record_no"),
        F.explode(F.array_compact(broken)).alias("b"), record.alias("record"),
    ).select("table_name", "file", "record_no", F.col("b.c").alias("column_name"), F.col("b.r").alias("rule"), F.col("b.v").alias("value"), "record")
    absent = [(meta.name, path, None, c.name, "absent", None, None) for c in meta.columns if c.not_null and c.name not in names]
    bad = bad.unionByName(values_table(spark, absent, QUARANTINE))
    if for_load:
        seq = F.struct(F.col(FILE), F.col(BLOCK), F.col(SEQ))
        return _shaped(spark, type_columns(good.withColumn(SEQ, seq), meta, keep_seq=meta.name == "dim_geolocation"), meta, patch), bad
    return type_columns(good, meta), bad


def _shaped(spark: SparkSession, df: DataFrame, meta: Table, patch: list[tuple[str, str]] | None) -> DataFrame:
    """A table on its way into the warehouse: geolocation reduced (A5), translations patched (A4)."""
    if meta.name == "dim_geolocation":
        return reduce_geolocation(df)
    if meta.name == "dim_product_category_translation":
        return insert_if_absent(spark, df, patch if patch is not None else KNOWN_MISSING_CATEGORIES, "product_category_name")
    return df


def read_for_load(spark: SparkSession, path: str, name: str, patch: list[tuple[str, str]] | None = None) -> DataFrame:
    """A raw file as it goes into the warehouse."""
    meta = TABLES[name]
    return _shaped(spark, read_table_csv(spark, path, meta, with_seq=name == "dim_geolocation"), meta, patch)


def count_records(spark: SparkSession, path: str, free_text: bool = True) -> int:
    """Records (not lines, if ``free_text``) in a raw file; no column is materialised."""
    return read_raw_text(spark, path, free_text).count()


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Export a result with a header row (overwrite: reruns give the same folder).
    ``single_file`` is for small report tables only."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def read_result_csv(spark: SparkSession, path: str, schema: str | T.StructType, top: int | None = None,
                    order_by: list | None = None) -> DataFrame:
    """Read an exported result with its schema, optionally the first ``top`` rows in
    ``order_by`` order (e.g. the 15 most important features)."""
    df = spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)
    if top:
        df = df.orderBy(*(order_by or [])).limit(top)
    return df


def load_warehouse(spark: SparkSession, raw_dir: str, out_dir: str,
                   patch: list[tuple[str, str]] | None = None,
                   raw_files: dict[str, str] | None = None) -> dict[str, str]:
    """A2 + A3 (+ A4, A5): load every raw file into a Parquet table, parents first.

    ``raw_files`` maps a table to its source file name inside ``raw_dir`` (default: the
    registry's name).  Each table replaces its own folder, so a rerun
    replaces rather than appends; the category patch is applied right after the
    translation table, and the geolocation file is reduced to one row per zip prefix on
    the way in.  :func:`emporion.sources.versions.refresh` does the same with versions, resumably and
    with independent tables at the same time."""
    written = {}
    for name in LOAD_ORDER:
        src = os.path.join(raw_dir, (raw_files or {}).get(name, TABLES[name].raw_file))
        df = read_for_load(spark, src, name, patch)
        written[name] = full_refresh(df, os.path.join(out_dir, name))
    return written


def export_raw_files(tables: dict[str, DataFrame], raw_dir: str) -> dict[str, str]:
    """Write star-schema-shaped frames as raw CSV folders named like the source files."""
    out = {}
    for name, df in tables.items():
        out[name] = write_csv(df.drop(SEQ) if SEQ in df.columns else df, os.path.join(raw_dir, TABLES[name].raw_file))
    return out


def export_model_outputs(star, out_dir: str, model_key: str = "v2_balanced") -> dict[str, str]:
    """The modelling outputs as CSV folders — per-person segments (no index column),
    the segment summary (the group column first, as an indexed export) and the feature
    importances sorted by importance.  Per-person rows are written by the executors in
    parallel; only the two small tables are coalesced to one file."""
    from pyspark.sql import functions as F

    from emporion.operators import model as M
    from emporion.operators import rfm as R

    segments = R.rfm_segments(star, R.rfm_customers(star, materialize=True))  # medians fixed once
    out = {
        "customer_rfm_segments": write_csv(segments, os.path.join(out_dir, "customer_rfm_segments")),
        "rfm_segment_summary": write_csv(R.segment_summary(star, segments), os.path.join(out_dir, "rfm_segment_summary"),
                                         single_file=True),
        "feature_importances": write_csv(
            M.feature_importances(star, model_key).orderBy(F.desc("importance"), "feature"),
            os.path.join(out_dir, "feature_importances"), single_file=True,
        ),
    }
    return out
