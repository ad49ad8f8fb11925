"""Operators for large-scale training-data preparation.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries when the
package is present.
"""
