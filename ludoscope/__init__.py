"""Catalogue and review analytics on Spark: typed sources, operators, five composite
queries, language identification, replay-safe streams and reconciliation of results."""
