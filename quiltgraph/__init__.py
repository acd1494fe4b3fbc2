"""Labeled-graph analytics on Spark: cardinality estimation, match-order planning, exact matching."""
