"""emporion — marketplace analytics as Spark jobs.

Layers:

* ``sources``   — readers for the driver tables, the star-schema adapter, CSV ingest,
                  full-refresh loads into a Parquet warehouse.
* ``functions`` — reusable column expressions (late flag, day floor, weekday, haversine…).
* ``operators`` — the analyses: revenue/delay aggregations, repeat purchase, RFM,
                  seller funnel, KPIs, data-quality checks, features and model evaluation.
* ``plans``     — the named query catalogue (what ``__spark_entry__`` exposes) and the
                  equivalent DuckDB SQL used as a correctness oracle.
"""

from emporion.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
