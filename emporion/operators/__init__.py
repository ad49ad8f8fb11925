"""Spark jobs of the analyses: aggregations, RFM, data quality, features and the model."""
