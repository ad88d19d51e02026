"""Data quality operators for Spark: clean, flag, de-duplicate, check and reconcile linked tables."""
