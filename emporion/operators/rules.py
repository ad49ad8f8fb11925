"""Column rules of the star schema, all counted in one pass over each table.

Every check that judges rows one by one (row counts, NULLs, NULLs by order status, declared
constraints, value ranges, the delivered-without-date anomaly) is a :class:`Rule`: a condition whose
rows are counted.  :func:`observe` stacks the conditions of all wanted checks of a table into one
aggregate, so a table is scanned once however many checks read it; equal conditions of several checks
are one aggregate expression.  The counts are turned into rows and named by a join with the list of
rules, which also gives a rule of an empty table its zero.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emporion.schemas import TABLES
from emporion.sources.adapter import StarSchema
from emporion.sources.warehouse import values_table

# Columns that must never be NULL (table, column), as checked by the
# original validation script.
HARD_REQUIRED = [
    ("dim_customers", "customer_id"),
    ("dim_orders", "order_id"),
    ("dim_orders", "customer_id"),
    ("dim_orders", "order_purchase_timestamp"),
    ("dim_products", "product_id"),
    ("dim_sellers", "seller_id"),
    ("fact_order_items", "price"),
    ("fact_order_items", "freight_value"),
    ("fact_order_payments", "payment_value"),
]

# Order date columns whose NULLs are expected to follow the order status.
STATUS_DEPENDENT = ["order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date"]

OBSERVED = "check_id string, table_name string, column_name string, metric string"
OBSERVATION = f"{OBSERVED}, value_of string, observed bigint, total_rows bigint"


@dataclass(frozen=True)
class Rule:
    """Rows of ``table`` that meet ``hit`` are counted; ``by`` splits the count by a column."""

    check: str
    table: str
    column: str | None
    metric: str
    hit: Column
    by: str | None = None


def decimal_misfit(column: str, kind: T.DecimalType) -> Column:
    """A value that does not fit a declared DECIMAL(p, s)."""
    return F.col(column).isNotNull() & F.col(column).try_cast(kind).isNull()


def declared_rules(name: str, df: DataFrame) -> list[Rule]:
    """NOT NULL, VARCHAR length and decimal fit as declared; a declared column that the table
    lacks is a rule that counts no rows, see :func:`absent_columns`."""
    out = []
    for col in TABLES[name].columns:
        kind = df.schema[col.name].dataType if col.name in df.columns else None
        if kind is None:
            continue
        if col.not_null:
            out.append(Rule("C5", name, col.name, "not_null", F.col(col.name).isNull()))
        if col.max_len and isinstance(kind, T.StringType):
            out.append(Rule("C5", name, col.name, f"max_length_{col.max_len}", F.length(col.name) > col.max_len))
        if isinstance(col.dtype, T.DecimalType):
            metric = f"decimal_{col.dtype.precision}_{col.dtype.scale}"
            out.append(Rule("C5", name, col.name, metric, decimal_misfit(col.name, col.dtype)))
    return out


def absent_columns(star: StarSchema) -> list[tuple[str, str, bool]]:
    """(table, column, whether it is declared NOT NULL) of declared columns that a table lacks."""
    return [(n, c.name, c.not_null) for n, df in star.tables().items() for c in TABLES[n].columns if c.name not in df.columns]


def range_rules(name: str) -> list[Rule]:
    """Declared CHECK rules (minimum values, ranges) plus delivered-before-purchased."""
    meta = TABLES[name]
    rules = [(f"{c} < {v:g}", F.col(c) < v) for c, v in meta.min_values]
    rules += [(f"{c} NOT BETWEEN {lo:g} AND {hi:g}", ~F.col(c).between(lo, hi)) for c, lo, hi in meta.ranges]
    if name == "dim_orders":
        early = F.col("order_delivered_customer_date") < F.col("order_purchase_timestamp")
        rules.append(("order_delivered_customer_date < order_purchase_timestamp", early))
    return [Rule("C7", name, None, metric, hit) for metric, hit in rules]


def rules_of(star: StarSchema, checks: set[str], required: list[tuple[str, str]] | None = None,
             status_columns: list[str] | None = None, delivered_status: str | None = None) -> list[Rule]:
    """The rules of the wanted checks (C1, C2, C3, C5, C7, C8) over the star's tables."""
    out = []
    for name, df in star.tables().items():
        if "C1" in checks:
            out.append(Rule("C1", name, None, "loaded_rows", F.lit(True)))
        if "C2" in checks:
            out += [Rule("C2", t, c, "null_count", F.col(c).isNull()) for t, c in required or HARD_REQUIRED if t == name]
        if "C3" in checks and name == "dim_orders":
            columns = status_columns or STATUS_DEPENDENT
            out += [Rule("C3", name, c, "null_count_status_", F.col(c).isNull(), by="order_status") for c in columns]
        if "C5" in checks:
            out += declared_rules(name, df)
        if "C7" in checks:
            out += range_rules(name)
        if "C8" in checks and name == "dim_orders":
            undated = F.col("order_delivered_customer_date").isNull()
            said = F.col("order_status") == delivered_status
            out.append(Rule("C8", name, "order_delivered_customer_date", f"status_{delivered_status}_without_date", said & undated))
            out.append(Rule("C8", name, "order_delivered_customer_date", "without_date", undated))
    return out


def _counts(df: DataFrame, numbered: list[tuple[int, Rule]]) -> DataFrame:
    """(rule, value_of, observed, total): the counts of a table's rules, from one scan of it."""
    by = next((r.by for _, r in numbered if r.by), None)
    values = [F.count_if(r.hit).alias(f"r{i}") for i, r in numbered]  # a NULL condition is not counted
    wide = (df.groupBy(F.col(by).alias("by")) if by else df).agg(F.count(F.lit(1)).alias("total"), *values)
    cells = ", ".join(f"named_struct('rule', {i}, 'value_of', {'by' if r.by else 'CAST(NULL AS STRING)'}, 'observed', r{i})" for i, r in numbered)
    long = wide.select("total", F.expr(f"inline(array({cells}))"))
    if by:  # over the few rows of the statuses
        long = long.groupBy("rule", "value_of").agg(F.sum("observed").alias("observed"), F.sum("total").alias("total"))
    return long


def observe(star: StarSchema, rules: list[Rule]) -> DataFrame:
    """check_id, table_name, column_name, metric, value_of, observed, total_rows: one row a rule (a
    rule split by a column: one for each value with rows that meet it)."""
    tables = star.tables()
    numbered = list(enumerate(rules))
    names = dict.fromkeys(r.table for r in rules)
    parts = [_counts(tables[t], [x for x in numbered if x[1].table == t]) for t in names]
    seen = reduce(lambda a, b: a.unionByName(b), parts)
    known = values_table(star.spark, [(i, r.check, r.table, r.column, r.metric, r.by is not None) for i, r in numbered],
                         f"rule int, {OBSERVED}, split boolean")
    zero = F.lit(0).cast("bigint")
    return (
        known.join(seen, "rule", "left")
        .filter(~F.col("split") | (F.col("observed") > 0))
        .select("check_id", "table_name", "column_name", "metric", "value_of",
                F.coalesce("observed", zero).alias("observed"), F.coalesce("total", zero).alias("total_rows"))
    )


def raw_counts(sources: list[tuple[str, DataFrame, bool]], spark) -> DataFrame:
    """(table_name, raw_rows, exact); a raw table that several tables come from is counted once."""
    groups: list[tuple[DataFrame, list[tuple[str, bool]]]] = []
    for name, raw, exact in sources:
        own = next((g for g in groups if g[0] is raw or g[0].sameSemantics(raw)), None)
        if own:
            own[1].append((name, exact))
        else:
            groups.append((raw, [(name, exact)]))
    parts = [
        raw.agg(F.count(F.lit(1)).cast("bigint").alias("raw_rows")).select(
            F.inline(F.array(*[F.struct(F.lit(n).alias("table_name"), F.lit(e).alias("exact")) for n, e in users])), "raw_rows")
        for raw, users in groups
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
