"""The named query catalogue, its DuckDB oracle and the parity harness."""
