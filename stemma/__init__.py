"""Temporal text analytics on Spark: versioned documents, their graph, search over them, and measures of it."""
