"""Readers and writers: driver tables, the star-schema adapter, CSV ingest, warehouse loads."""
