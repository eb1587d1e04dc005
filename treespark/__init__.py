"""Treebank analytics on Spark: trees, spans, examples and scores as DataFrame jobs."""
