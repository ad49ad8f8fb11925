"""Data-quality checks as result tables.

The original suite printed one line per check; here every check returns a DataFrame, and the
rules come from the schema registry (:mod:`emporion.schemas`) rather than hand-written SQL.
The checks that judge rows one by one (C1-C3, C5, C7, C8) are rules of :mod:`emporion.operators.rules`:
all that a report asks of a table is one aggregate over one scan.  Uniqueness and
orphan checks aggregate keys map-side before their shuffle, so a hot key is combined early.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emporion.functions.quantiles import quantiles_and
from emporion.operators.rules import OBSERVATION, absent_columns, observe, raw_counts, rules_of
from emporion.schemas import TABLES
from emporion.sources.adapter import StarSchema

# Fixed value: documented number of review ids that occur on more than one order.
DOCUMENTED_REVIEW_ID_REPEATS = 789

# The foreign keys the original suite checks (child, column, parent, column).
REFERENCE_FKS = [
    ("fact_order_items", "product_id", "dim_products", "product_id"),
    ("fact_order_items", "seller_id", "dim_sellers", "seller_id"),
    ("fact_order_items", "order_id", "dim_orders", "order_id"),
    ("dim_reviews", "order_id", "dim_orders", "order_id"),
]

# The primary keys the original suite re-verifies.
PK_CHECKS = [
    ("dim_customers", "customer_id"),
    ("dim_orders", "order_id"),
    ("dim_products", "product_id"),
    ("dim_sellers", "seller_id"),
]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _count_if(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")


def _safe_pct(num: str, den: str) -> Column:
    return F.when(F.col(den) == 0, F.lit(0.0)).otherwise(
        F.round(F.lit(100).cast("decimal(3,0)") * F.col(num).cast("decimal(38,0)") / F.col(den).cast("decimal(38,0)"), 2).cast("double")
    )


# ---- C1 --------------------------------------------------------------------------------
def adapter_raw_sources(star: StarSchema) -> list[tuple[str, DataFrame, bool]]:
    """(loaded table, raw source rows, exact match expected) for the adapter's tables."""
    t = star._t
    return [
        ("dim_customers", t("orders"), True),
        ("dim_sellers", t("supplier"), True),
        ("dim_product_category_translation", star.categories_raw, False),  # + patched rows
        ("dim_products", t("part"), True),
        ("dim_orders", t("orders"), True),
        ("dim_reviews", t("orders"), True),
        ("fact_order_items", t("lineitem"), True),
        ("fact_order_payments", t("orders"), True),
    ]


def csv_raw_sources(spark, raw_dir: str, raw_files: dict[str, str] | None = None) -> list[tuple[str, DataFrame, bool]]:
    """C1's sources for a loaded warehouse: the records of the raw files themselves.  The
    translation table may hold more rows (the patch) and geolocation is reduced, so it is not
    compared."""
    from emporion.sources.csv_io import read_raw_text

    out = []
    for name, meta in TABLES.items():
        if name != "dim_geolocation":
            path = f"{raw_dir.rstrip('/')}/{(raw_files or {}).get(name, meta.raw_file)}"
            out.append((name, read_raw_text(spark, path, bool(meta.text_columns)), name != "dim_product_category_translation"))
    return out


def row_count_reconciliation(star: StarSchema, sources: list[tuple[str, DataFrame, bool]], observed: DataFrame | None = None) -> DataFrame:
    """Raw rows (``sources``: table, raw rows, whether the counts must be equal) vs loaded
    rows; ``OK`` / ``OK (expected difference)`` / ``MISMATCH``.  This and the other checks by row take
    ``observed``, counts of their rules that an :func:`observe` has made already."""
    wanted = {name for name, _, _ in sources}
    seen = _seen(observed, "C1") if observed is not None else observe(star, [r for r in rules_of(star, {"C1"}) if r.table in wanted])
    rows = raw_counts(sources, star.spark).join(seen, "table_name")
    return rows.select("table_name", "raw_rows", F.col("observed").alias("loaded_rows"), _loaded_status().alias("status"))


def _seen(observed: DataFrame, check: str) -> DataFrame:
    return observed.filter(F.col("check_id") == check)


def _loaded_status() -> Column:
    even, enough = F.col("observed") == F.col("raw_rows"), F.col("observed") >= F.col("raw_rows")
    return F.when(F.col("exact") & even, "OK").when(~F.col("exact") & enough, "OK (expected difference)").otherwise("MISMATCH")


# ---- C2 / C9 ---------------------------------------------------------------------------
def null_profile(df: DataFrame, columns: list[str] | None = None, table_name: str | None = None) -> DataFrame:
    """NULL count per column (one scan), with the table's row count."""
    cols = columns or df.columns
    wide = df.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_rows"),
        *[_count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)],
    )
    long = wide.unpivot(
        ["total_rows"], [F.col(f"n{i}").alias(c) for i, c in enumerate(cols)], "column_name", "null_count"
    )
    out = long.select(
        *([F.lit(table_name).alias("table_name")] if table_name else []),
        "column_name", "null_count", "total_rows",
    )
    return out


def null_thresholds(star: StarSchema, required: list[tuple[str, str]] | None = None, observed: DataFrame | None = None) -> DataFrame:
    """Hard-required columns — NULL count, share of rows (0 % on an empty table), status."""
    seen = _seen(observed, "C2") if observed is not None else observe(star, rules_of(star, {"C2"}, required=required))
    return seen.select(
        "table_name", "column_name", F.col("observed").alias("null_count"), "total_rows",
        _safe_pct("observed", "total_rows").alias("null_pct"),
        F.when(F.col("observed") == 0, "OK").otherwise("FAIL").alias("status"),
    )


# ---- C3 --------------------------------------------------------------------------------
def status_dependent_nulls(star: StarSchema, columns: list[str] | None = None, observed: DataFrame | None = None) -> DataFrame:
    """NULLs of each date column broken down by order status (one scan of the orders),
    with the column's total; statuses without NULLs are not listed."""
    # The window runs over the aggregated rows: (#statuses x #columns), not over orders.
    seen = _seen(observed, "C3") if observed is not None else observe(star, rules_of(star, {"C3"}, status_columns=columns))
    return seen.select(
        "column_name", F.col("value_of").alias("order_status"), F.col("observed").alias("null_count"),
        F.sum("observed").over(Window.partitionBy("column_name")).cast("bigint").alias("total_nulls"),
    )


# ---- C4 / C5 keys -----------------------------------------------------------------------
def _duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return (
        df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
        .agg(_count_if(F.col("_n") > 1).alias("duplicate_keys"))
    )


def duplicates(star: StarSchema, documented_review_repeats: int = DOCUMENTED_REVIEW_ID_REPEATS,
               include_registry_keys: bool = True) -> DataFrame:
    """Number of key values that occur more than once.

    The primary keys of the original suite must show 0 (``UNEXPECTED`` otherwise); the
    review id must show its documented repeat count (``CHANGED - INVESTIGATE`` otherwise);
    with ``include_registry_keys`` every declared key (composite ones too) is added.
    """
    tables = star.tables()
    checks: list[tuple[str, list[str], str]] = [(t, [c], "pk") for t, c in PK_CHECKS]
    checks.append(("dim_reviews", ["review_id"], "documented"))
    if include_registry_keys:
        seen = {(t, tuple(k)) for t, k, _ in checks}
        for name, meta in TABLES.items():
            if name in tables and meta.key and (name, meta.key) not in seen:
                checks.append((name, list(meta.key), "declared"))
    parts = []
    for t, key, kind in checks:
        expected = documented_review_repeats if kind == "documented" else 0
        if kind == "documented":
            status = F.when(F.col("duplicate_keys") == expected, "MATCHES DOCUMENTED FINDING").otherwise("CHANGED - INVESTIGATE")
        else:
            status = F.when(F.col("duplicate_keys") == 0, "OK").otherwise("UNEXPECTED")
        parts.append(
            _duplicate_keys(tables[t], key).select(
                F.lit(t).alias("table_name"), F.lit(",".join(key)).alias("key_columns"),
                "duplicate_keys", F.lit(expected).cast("bigint").alias("expected"), status.alias("status"),
            )
        )
    return _union(parts)


def people_vs_records(star: StarSchema) -> DataFrame:
    """Customer records, distinct people, and the difference (returning records)."""
    return star.customers.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_records"),
        F.count_distinct("customer_unique_id").cast("bigint").alias("distinct_people"),
    ).withColumn("returning_records", F.col("total_records") - F.col("distinct_people"))


def people_by_state(star: StarSchema) -> DataFrame:
    """C4c per state, from bitmaps that merge: customer records and distinct people of two loads (by
    the parity of the customer id), each kept as bitmaps over one dictionary of people and merged
    without reading either load again.  A person may live in several states, or come in both loads."""
    from emporion.functions import distinct as D
    from emporion.session import materialize

    customers = star.customers.select("customer_id", F.col("customer_unique_id").alias("key"), "customer_state")
    even = F.pmod(F.xxhash64("customer_id"), F.lit(2)) == 0
    first, second = customers.filter(even), customers.filter(~even)
    known = D.extended(None, first.select("key"))
    loads = [materialize(D.bitmaps(first, known, ["customer_state"]), "people-bitmaps")]
    known = D.extended(known, second.select("key"))
    loads.append(materialize(D.bitmaps(second, known, ["customer_state"]), "people-bitmaps"))
    merged = D.counted(D.merged(loads, ["customer_state"]), ["customer_state"])
    return merged.select("customer_state", F.col("rows").alias("records"), F.col("distinct_keys").alias("people"))


# ---- C5 column rules ----------------------------------------------------------------------
def declared_constraints(star: StarSchema, observed: DataFrame | None = None) -> DataFrame:
    """NOT NULL, VARCHAR length and decimal-fit rules of the registry, one scan per table, and
    a violation of ``present`` for each declared column that a table lacks."""
    from emporion.sources.warehouse import values_table

    seen = _seen(observed, "C5") if observed is not None else observe(star, rules_of(star, {"C5"}))
    found = seen.select(
        "table_name", "column_name", F.col("metric").alias("rule"), F.col("observed").alias("violations"))
    absent = [(t, c, "present", 1) for t, c, _ in absent_columns(star)]
    return found.unionByName(values_table(star.spark, absent, "table_name string, column_name string, rule string, violations bigint"))


# ---- C6 --------------------------------------------------------------------------------
def orphans(star: StarSchema, relaxed: tuple[tuple[str, str], ...] = (("dim_closed_deals", "seller_id"),),
            fks: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """Child rows whose key has no parent (NULL keys count as orphans, like
    ``LEFT JOIN … WHERE parent.key IS NULL``).  Relaxed keys report ``RELAXED`` instead of
    ``BROKEN``.

    Per child table, one scan: every row is exploded into (foreign key index, key value) and
    counted per pair (map-side combined), so a hot key is one row per task.  One anti join
    against the union of the parents' keys (tagged with the same index) finds the orphan
    pairs; both sums per index read the same key aggregate, whose exchange Spark reuses.
    Keys keep their type; only foreign keys of different types are compared as text."""
    from emporion.sources.warehouse import values_table

    tables = star.tables()
    if fks is None:
        fks = [(child, col, parent, pcol) for child, meta in TABLES.items() for col, parent, pcol in meta.foreign_keys]
    fks = [fk for fk in fks if fk[0] in tables and fk[2] in tables]
    parts = []
    for child in dict.fromkeys(fk[0] for fk in fks):
        mine = [fk for fk in fks if fk[0] == child]
        types = {tables[child].schema[col].dataType for _, col, _, _ in mine}
        types |= {tables[parent].schema[pcol].dataType for _, _, parent, pcol in mine}
        key_type = types.pop() if len(types) == 1 else T.StringType()  # text only when types differ
        pairs = F.explode(F.array(*[
            F.struct(F.lit(i).alias("k"), F.col(col).cast(key_type).alias("v")) for i, (_, col, _, _) in enumerate(mine)
        ]))
        keys = (
            tables[child].select(pairs.alias("p")).select("p.k", "p.v")
            .groupBy("k", "v").agg(F.count(F.lit(1)).alias("_n"))
        )
        parent_keys = _union([
            tables[parent].select(F.lit(i).alias("k"), F.col(pcol).cast(key_type).alias("v"))
            for i, (_, _, parent, pcol) in enumerate(mine)
        ])
        lost = keys.join(parent_keys, ["k", "v"], "left_anti").groupBy("k").agg(F.sum("_n").alias("orphan_rows"))
        total = keys.groupBy("k").agg(F.sum("_n").alias("child_rows"))
        labels = values_table(star.spark, [
            (i, c, col, parent, pcol, "RELAXED" if (c, col) in relaxed else "BROKEN")
            for i, (c, col, parent, pcol) in enumerate(mine)
        ], "k int, child_table string, child_column string, parent_table string, parent_column string, bad string")
        parts.append(
            labels.join(total, "k", "left").join(lost, "k", "left").select(
                "child_table", "child_column", "parent_table", "parent_column",
                F.coalesce(F.col("orphan_rows"), F.lit(0)).cast("bigint").alias("orphan_rows"),
                F.coalesce(F.col("child_rows"), F.lit(0)).cast("bigint").alias("child_rows"),
                "bad",
            )
            .withColumn("orphan_pct", _safe_pct("orphan_rows", "child_rows"))
            .withColumn("status", F.when(F.col("orphan_rows") == 0, "OK").otherwise(F.col("bad")))
            .drop("bad")
        )
    return _union(parts)


# ---- C7 / C8 -----------------------------------------------------------------------------
def value_ranges(star: StarSchema, observed: DataFrame | None = None) -> DataFrame:
    """Declared CHECK rules (minimum values, ranges) plus delivered-before-purchased."""
    seen = _seen(observed, "C7") if observed is not None else observe(star, rules_of(star, {"C7"}))
    return seen.select(
        "table_name", F.col("metric").alias("rule"), F.col("observed").alias("violations"),
        F.when(F.col("observed") == 0, "OK").otherwise("FAIL").alias("status"))


def delivered_without_date(star: StarSchema, delivered_status: str, observed: DataFrame | None = None) -> DataFrame:
    """Orders whose status (``delivered_status``) says delivered but that carry no delivery
    date; these are excluded by the delivered-only filter, never imputed."""
    said = F.col("metric") == f"status_{delivered_status}_without_date"
    seen = _seen(observed, "C8") if observed is not None else observe(star, rules_of(star, {"C8"}, delivered_status=delivered_status))
    return seen.agg(
        F.max(F.when(said, F.col("observed"))).alias("status_without_date"),
        F.max(F.when(~said, F.col("observed"))).alias("all_without_date"),
    ).select(F.lit(delivered_status).alias("delivered_status"), "status_without_date", "all_without_date")


# ---- C10 / C11 ---------------------------------------------------------------------------
def describe(df: DataFrame, columns: list[str], scale: int = 6) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles, max per column (long format).

    Moments come from the pass that sketches the quartiles, which a counting pass settles: never from a
    sort or from one task holding all values."""
    spark = df.sparkSession
    quartiles, moments = quantiles_and(df, columns, [0.25, 0.5, 0.75], [
        e for c in columns for e in (
            F.count(c).cast("bigint").alias(f"{c}__count"),
            F.avg(F.col(c).cast("double")).alias(f"{c}__mean"),
            F.stddev_samp(F.col(c).cast("double")).alias(f"{c}__std"),
            F.min(F.col(c).cast("double")).alias(f"{c}__min"),
            F.max(F.col(c).cast("double")).alias(f"{c}__max"),
        )
    ])
    rows = []
    for c in columns:
        q = quartiles[c]
        rows.append((
            c, moments[f"{c}__count"],
            *[None if v is None else round(float(v), scale) for v in (
                moments[f"{c}__mean"], moments[f"{c}__std"], moments[f"{c}__min"], *q, moments[f"{c}__max"])],
        ))
    schema = "column_name string, count bigint, mean double, std double, min double, p25 double, p50 double, p75 double, max double"
    return spark.createDataFrame(rows, schema)  # one row per described column


def value_counts(df: DataFrame, column: str, scale: int = 6) -> DataFrame:
    """C11: absolute and relative frequency of each non-null value (pandas ``value_counts``
    with and without ``normalize``); the total is summed over the counts."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    total = counts.agg(F.sum("count")).scalar()  # a window without keys would move all values to one task
    return counts.select(
        column, "count",
        F.round(F.col("count").cast("decimal(38,0)") / total.cast("decimal(38,0)"), scale).cast("double").alias("share"),
    )


SUITE = {
    "row_counts": row_count_reconciliation,
    "null_thresholds": null_thresholds,
    "status_dependent_nulls": status_dependent_nulls,
    "duplicates": duplicates,
    "people_vs_records": people_vs_records,
    "declared_constraints": declared_constraints,
    "orphans": orphans,
    "value_ranges": value_ranges,
    "delivered_without_date": delivered_without_date,
}


#: The checks by row, with the id of their rules.
BY_ROW = {
    "row_counts": "C1", "null_thresholds": "C2", "status_dependent_nulls": "C3", "declared_constraints": "C5",
    "value_ranges": "C7", "delivered_without_date": "C8",
}


def run_quality_suite(star: StarSchema, delivered_status: str, checks: list[str] | None = None,
                      sources: list[tuple[str, DataFrame, bool]] | None = None,
                      reference_scope: bool = False, parallelism: int = 4) -> dict[str, list]:
    """Run the validation checks and return their (small) result rows per check.

    * ``sources`` are the raw sources of C1; without them it is left out;
    * ``reference_scope`` restricts keys and foreign keys to the original script's lists
      instead of every key the registry declares;
    * the checks by row (``BY_ROW``) share one observation, in which each table is scanned once;
    * the others are submitted beside it as concurrent Spark jobs from ``parallelism`` driver
      threads, so the cluster is not idle while one small job finishes.
    """
    from concurrent.futures import ThreadPoolExecutor
    from functools import partial

    from emporion.sources.warehouse import values_table

    fns = {name: SUITE[name] for name in (checks or list(SUITE)) if sources is not None or name != "row_counts"}
    given = {"row_counts": {"sources": sources}, "delivered_without_date": {"delivered_status": delivered_status}}
    if reference_scope:
        given |= {"duplicates": {"include_registry_keys": False}, "orphans": {"fks": REFERENCE_FKS}}
    fns = {name: partial(f, **given.get(name, {})) for name, f in fns.items()}
    wanted = {BY_ROW[name] for name in fns if name in BY_ROW}

    def observed_rows():
        counted = {name for name, _, _ in sources or []}
        rules = [r for r in rules_of(star, wanted, delivered_status=delivered_status) if r.check != "C1" or r.table in counted]
        return values_table(star.spark, [tuple(r) for r in observe(star, rules).collect()], OBSERVATION)  # one row a rule

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        seen = pool.submit(observed_rows) if wanted else None
        futures = {name: pool.submit(lambda f=f: f(star).collect()) for name, f in fns.items() if name not in BY_ROW}
        futures |= {name: pool.submit(lambda f=f: f(star, observed=seen.result()).collect()) for name, f in fns.items() if name in BY_ROW}
        return {name: futures[name].result() for name in fns}


def quality_report(star: StarSchema, delivered_status: str, sources: list[tuple[str, DataFrame, bool]] | None = None,
                   reference_scope: bool = False) -> DataFrame:
    """C1-C8 in one result table with a common schema:
    ``check_id, table_name, column_name, metric, observed, expected, status``.

    ``observed`` is the measured count, ``expected`` the value or bound it is judged against
    (as text), ``status`` the verdict of the individual check.  C1 compares the raw ``sources``
    (see :func:`row_count_reconciliation`) with the star's tables and is left out without them;
    ``delivered_status`` is the order status that C8 judges."""
    from emporion.sources.warehouse import values_table

    dups = duplicates(star, include_registry_keys=not reference_scope)
    orph = orphans(star, fks=REFERENCE_FKS if reference_scope else None)
    checks = {"C2", "C3", "C5", "C7", "C8"} | ({"C1"} if sources is not None else set())
    rules = rules_of(star, checks, delivered_status=delivered_status)
    raw_tables = {name for name, _, _ in sources or []}
    rules = [r for r in rules if r.metric != "without_date" and (r.check != "C1" or r.table in raw_tables)]
    seen = observe(star, rules)  # one scan of each table
    if sources is not None:
        seen = seen.join(raw_counts(sources, star.spark).withColumn("check_id", F.lit("C1")), ["check_id", "table_name"], "left")
    else:
        seen = seen.withColumn("raw_rows", F.lit(None).cast("bigint")).withColumn("exact", F.lit(None).cast("boolean"))
    check, clean = F.col("check_id"), F.col("observed") == 0
    status = (
        F.when(check == "C1", _loaded_status()).when(check == "C3", "INFO")
        .when(clean, "OK").when(check == "C8", "ANOMALY").otherwise("FAIL")
    )
    columns = ["check_id", "table_name", "column_name", "metric", "observed", "expected", "status"]
    by_row = seen.select(
        "check_id", "table_name", "column_name", F.when(check == "C3", F.concat("metric", "value_of")).otherwise(F.col("metric")).alias("metric"), "observed",
        F.when(check == "C1", F.col("raw_rows").cast("string")).when(check != "C3", "0").alias("expected"), status.alias("status"),
    )
    absent = [("C5", t, c, "present", 1, "0", "FAIL" if required else "ABSENT") for t, c, required in absent_columns(star)]
    kind = ", ".join(f"{c} {'bigint' if c == 'observed' else 'string'}" for c in columns)

    def rows(df, check, table, column, metric, observed, expected):
        return df.select(
            F.lit(check).alias("check_id"), table.alias("table_name"), column.alias("column_name"),
            metric.alias("metric"), observed.cast("bigint").alias("observed"),
            expected.cast("string").alias("expected"), F.col("status"),
        )

    return _union([
        by_row,
        values_table(star.spark, absent, kind),
        rows(dups, "C4", F.col("table_name"), F.col("key_columns"), F.lit("duplicate_keys"), F.col("duplicate_keys"), F.col("expected")),
        rows(orph, "C6", F.col("child_table"), F.col("child_column"),
             F.concat(F.lit("orphans_to_"), F.col("parent_table")), F.col("orphan_rows"), F.lit("0")),
    ])
