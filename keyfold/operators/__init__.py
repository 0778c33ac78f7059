"""Spark operators for ordered, versioned key-value tables."""
